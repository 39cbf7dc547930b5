"""Tar archives in parts: ranges, pruning, odd members; files written whole; clips and odometry."""

from __future__ import annotations

import gzip
import io
import json
import random
import tarfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kinetrace.plans.shared import shared_dir
from kinetrace.sources import archives
from kinetrace.sources import readers as R


def packed(path, entries) -> None:
    with tarfile.open(path, "w", format=tarfile.PAX_FORMAT) as tar:
        for name, content in entries:
            info = tarfile.TarInfo(name)
            if content is None:
                info.type = tarfile.DIRTYPE
                tar.addfile(info)
            else:
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))


@pytest.mark.parametrize("partition_bytes", [1, 4000, 1 << 30])
def test_members_by_ranges(spark, tmp_path, partition_bytes):
    rng = random.Random(3)
    (tmp_path / "deep").mkdir()
    want = {}
    for a in ("one.tar", "deep/two.tar"):
        entries = [(f"d{i}/{'ä' * (60 if i % 9 == 0 else 3)}{'x' * 120 if i % 7 == 0 else ''}{i}.bin", rng.randbytes(rng.choice([0, 1, 511, 512, 513, 3000]))) for i in range(60)]
        packed(tmp_path / a, [("d0", None), *entries])
        want |= {(a.rsplit("/", 1)[-1], n): c for n, c in entries}
    packed(tmp_path / "none.tar", [])
    (tmp_path / "other.txt").write_text("x")
    df = archives.tar_members(spark, str(tmp_path), partition_bytes=partition_bytes)
    got = {(r.archive.rsplit("/", 1)[-1], r.member): bytes(r.content) for r in df.collect()}
    assert got == want and df.count() == len(want)
    if partition_bytes == 4000:
        assert df.rdd.getNumPartitions() > 10  # an archive is many tasks
    names = archives.tar_members(spark, str(tmp_path), content=False, suffix="1.bin,2.bin", partition_bytes=partition_bytes)
    assert names.columns == ["archive", "member", "offset", "size"]
    assert {(r.archive.rsplit("/", 1)[-1], r.member, r.size) for r in names.collect()} == {(a, n, len(c)) for (a, n), c in want.items() if n.endswith(("1.bin", "2.bin"))}


def test_ranges_cut_at_members(tmp_path):
    packed(tmp_path / "a.tar", [(f"{i}", b"x" * 700) for i in range(10)])
    parts = archives.ranges(str(tmp_path / "a.tar"), 3000)
    assert [p[1] for p in parts[1:]] == [p[2] for p in parts[:-1]] and len(parts) == 5
    assert [n for p in parts for n, *_ in archives.members(*p)] == [str(i) for i in range(10)]


def test_no_archive_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="not-there"):
        archives.tar_members(spark, str(tmp_path / "not-there")).collect()
    (tmp_path / "bad.tar").write_bytes(b"no archive at all" * 100)
    with pytest.raises(Exception, match="ReadError"):
        archives.tar_members(spark, str(tmp_path)).collect()
    (tmp_path / "empty").mkdir()
    assert archives.tar_members(spark, str(tmp_path / "empty")).count() == 0


def test_tars_are_written_whole(spark, tmp_path):
    rows = [(f"s{i % 3}", f"m{i:03d}", bytes([i % 256]) * (i * 37)) for i in range(100)]
    out = archives.write_tars(spark.createDataFrame(rows, "archive string, member string, content binary").repartition(7), str(tmp_path / "out")).collect()
    assert {(r.path.rsplit("/", 1)[-1], r.members) for r in out} == {(f"s{k}.tar", len(range(k, 100, 3))) for k in range(3)}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["s0.tar", "s1.tar", "s2.tar"]
    got = archives.tar_members(spark, str(tmp_path / "out")).select(F.regexp_extract("archive", r"/(s.)\.tar", 1), "member", "content").collect()
    assert sorted((a, m, bytes(c)) for a, m, c in got) == sorted(rows)
    files = archives.write_files(spark.createDataFrame([("a", b"1"), ("b", b"")], "name string, content binary"), str(tmp_path / "files")).collect()
    assert sorted((r.path.rsplit("/", 1)[-1], r.size) for r in files) == [("a", 1), ("b", 0)] and (tmp_path / "files" / "a").read_bytes() == b"1"


def test_clip_archives(spark, tmp_path):
    turn = {"quaternion_wxyz": [0.5**0.5, 0.5**0.5, 0.0, 0.0], "translation_xyz": [1.0, 2.0, 3.0]}
    entries = {
        "000003.cameras.json": {"main": {"T_world_from_camera": turn}}, "000003.hands.json": {"left": {"umetrack_pose": {"T_world_from_wrist": turn}}, "right": {"umetrack_pose": None}},
        "000003.info.json": {"ref_timestamp_ns": 5, "image_timestamps_ns": {"main": 7, "other": 8}}, "000004.info.json": {"ref_timestamp_ns": 9}, "000005.hands.json": {}, "notes.json": {},
    }
    packed(tmp_path / "c1.tar", [*((n, json.dumps(v).encode()) for n, v in entries.items()), ("000003.main.jpg", b"\xff" * 2000)])
    got = {r.frame: r for r in R.read_clip_archives(spark, str(tmp_path), "main", partition_bytes=1024).collect()}
    want = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0, -1.0, 2.0, 0.0, 1.0, 0.0, 3.0, 0.0, 0.0, 0.0, 1.0]
    assert set(got) == {3, 4, 5} and got[3].clip == "c1" and got[3].camera_pose == pytest.approx(want) and got[3].left_pose == pytest.approx(want) and not got[3].right_valid
    assert [got[f].time_ns for f in (3, 4, 5)] == [7, 9, None] and not got[5].left_valid and got[4].camera_pose is None


def test_odometry_files(spark, tmp_path):
    steps = np.random.default_rng(1).normal(size=(9000, 4, 4))
    np.save(tmp_path / "c.npy", steps)
    got = R.read_odometry(spark, str(tmp_path)).orderBy("step").collect()
    assert [r.step for r in got] == list(range(9000)) and {r.clip for r in got} == {"c"} and np.array_equal(np.array([r.transform for r in got]).reshape(-1, 4, 4), steps)
    np.save(tmp_path / "bad.npy", np.zeros((3, 4)))
    with pytest.raises(Exception, match="n x 4 x 4"):
        R.read_odometry(spark, str(tmp_path)).collect()


def test_tasks_are_bounded(spark, tmp_path):
    """However many members an archive has, it is read by a bounded number of tasks; and all of its members come."""
    packed(tmp_path / "a.tar", [(f"{i}", b"x" * (i % 600)) for i in range(1100)])
    df = archives.tar_members(spark, str(tmp_path), partition_bytes=512)
    assert df.rdd.getNumPartitions() <= 1024
    assert archives.tar_members(spark, str(tmp_path), partition_bytes=1 << 16).agg(F.count_distinct("member"), F.sum("size")).first()[:] == (1100, sum(i % 600 for i in range(1100)))


def test_segments_in_many_batches(spark, tmp_path):
    """More points than are handed on at once, in files of several segments, some without points."""
    rng, want = np.random.default_rng(2), {}
    for i in range(30):
        points = [rng.normal(size=(n, 3)) for n in (1500, 0, i)]
        segments = [{"hand": h, "start": k, "end": k + len(p), "traj3d": p} for k, (h, p) in enumerate(zip(("left", "right", "left"), points, strict=True))]
        np.save(tmp_path / f"{i}.npy", np.array({"clip": f"c{i}", "segments": segments}, dtype=object), allow_pickle=True)
        want |= {(f"c{i}", k): (s["hand"], k, s["end"], s["traj3d"].tolist()) for k, s in enumerate(segments)}
    assert {(r.clip, r.segment): (r.hand, r.start, r.end, r.traj3d) for r in R.read_segments(spark, str(tmp_path)).collect()} == want


def test_clip_archives_take_little_disk(spark):
    """The query's archives hold every event's members in a tenth of the kilobyte each that a plain tar takes."""
    before = set(Path(shared_dir(spark)).glob("clips-*"))
    frames = __spark_entry__.queries()["s5_clip_archives"](spark, __spark_entry__.SMOKE).count()
    (folder,) = set(Path(shared_dir(spark)).glob("clips-*")) - before
    events = spark.read.parquet(f"{__spark_entry__.SMOKE}/events.parquet")
    members = archives.tar_members(spark, str(folder), content=False).count()
    assert frames == events.count() and members == 4 * frames - events.filter("event_type = 'error'").count()
    assert sum(p.stat().st_size for p in folder.iterdir()) < members * 1024 / 10


def test_compressed_archives(spark, tmp_path):
    """They are the plain ones compressed, and are read in ranges: members, offsets and contents agree."""
    rng = random.Random(5)
    rows = [(f"s{i % 2}", f"{'d' * (150 if i % 50 == 0 else 2)}/{i:04d}.bin", rng.randbytes(rng.choice([0, 511, 512, 513, 30000]))) for i in range(900)]
    df = spark.createDataFrame(rows, "archive string, member string, content binary").repartition(5)
    got = {}
    for compressed in (False, True):
        folder = str(tmp_path / f"{compressed}")
        assert {r.members for r in archives.write_tars(df, folder, compressed=compressed).collect()} == {450}
        name = F.regexp_extract("archive", r"/(s[01])\.", 1)
        got[compressed] = sorted((*r[:4], bytes(r.content)) for r in archives.tar_members(spark, folder, partition_bytes=1 << 16).select(name, "member", "offset", "size", "content").collect())
    assert got[True] == got[False] and [(a, m, c) for a, m, _, _, c in got[True]] == sorted(rows)
    at = str(tmp_path / "True" / "s0.tar.gz")
    assert gzip.decompress(Path(at).read_bytes()) == (tmp_path / "False" / "s0.tar").read_bytes()
    with tarfile.open(at) as tar:
        assert [m.name for m in tar] == sorted(m for a, m, _ in rows if a == "s0")
    parts = archives.ranges(at, 1 << 16)
    assert len(parts) == 3 and [n for p in parts for n, *_ in archives.members(*p)] == sorted(m for a, m, _ in rows if a == "s0")


def test_others_compressed_archives(spark, tmp_path):
    """Of one gzip member, or of many that are cut anywhere and padded; and what is cut off is an error."""
    entries = [(f"{'ä' * (60 if i % 9 == 0 else 3)}{i}.bin", random.Random(i).randbytes(i * 37)) for i in range(200)]
    packed(tmp_path / "plain", [("d0", None), *entries])
    plain = (tmp_path / "plain").read_bytes()
    (tmp_path / "one.tgz").write_bytes(gzip.compress(plain))
    (tmp_path / "many.tar.gz").write_bytes(b"".join(gzip.compress(plain[at : at + 7777]) + bytes(at % 5) for at in range(0, len(plain), 7777)))
    df = archives.tar_members(spark, str(tmp_path), partition_bytes=1000)
    for name in ("one.tgz", "many.tar.gz"):
        assert {(r.member, bytes(r.content)) for r in df.filter(F.col("archive").endswith(name)).collect()} == set(entries)
    assert [n for n, *_ in archives.members(str(tmp_path / "one.tgz"), suffixes=("7.bin",))] == [n for n, _ in entries if n.endswith("7.bin")]
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.tar.gz").write_bytes((tmp_path / "one.tgz").read_bytes()[:-5000])
    with pytest.raises(Exception, match="ReadError"):
        archives.tar_members(spark, str(tmp_path / "cut")).collect()
    (tmp_path / "cut" / "a.tar.gz").write_bytes(b"no archive at all" * 100)
    with pytest.raises(Exception, match="error"):
        archives.tar_members(spark, str(tmp_path / "cut")).collect()


def test_headers_are_tarfiles():
    for name, size in (("a/b.json", 0), ("x" * 100, 513), ("x" * 101, 7), ("ä" * 50, 1 << 20), ("ä" * 51, 1), ("big", 8**11 - 1), ("bigger", 8**11)):
        info = tarfile.TarInfo(name)
        info.size = size
        assert archives.header(name, size) == info.tobuf(tarfile.GNU_FORMAT)
        head = archives.header(name, size)[:512]
        assert archives.ordinary(head) == ((name, size) if len(name.encode()) <= 100 and size < 8**11 else None)
        assert archives.ordinary(head[:10] + b"!" + head[11:512]) is None
