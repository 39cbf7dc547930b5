"""Reading episodes, manifests, annotations, key lists and logs into tables."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.functions.poses import rigid
from kinetrace.plans.shared import shipped
from kinetrace.sources import schemas
from kinetrace.sources.archives import PARTITION_BYTES, located, tar_members

#: Points of segments handed on at once.
STEPS = 1 << 14


def read_episodes(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Tar shards of .npy members that hold one dict each, to episode rows, a range of a shard a task; after this all work is on Parquet.

    The members are pickles: read only shards you trust. An empty video name, or frame ids that are negative or don't rise, stop the job.
    """

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            rows = []
            for member, payload in zip(batch.column("member").to_pylist(), batch.column("content").to_pylist(), strict=True):
                episode = np.load(io.BytesIO(payload), allow_pickle=True).item()
                ids = [int(x) for x in episode["video_decode_frame"]]
                if not episode["video_name"] or any(x < 0 for x in ids) or any(b <= a for a, b in zip(ids, ids[1:], strict=False)):
                    raise ValueError(f"bad episode {member}")
                rows.append((member, member.split("/")[0], episode["video_name"], episode.get("anno_type"), ids, hashlib.sha256(payload).hexdigest()))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            types = [pa.string()] * 4 + [pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["member", "source", "video_name", "anno_type", "frame_ids", "payload_sha256"])

    return tar_members(spark, path, ".npy", partition_bytes=partition_bytes).select("member", "content").mapInArrow(load, schemas.EPISODE)


def scan_members(index: DataFrame, member: str, source: str) -> DataFrame:
    """Names alone; the payload column is never read."""
    return index.select(F.col(member).alias("member"), F.col(source).alias("source"))


def read_manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).option("mode", "FAILFAST").json(paths)


def audit_manifest(manifest: DataFrame, protocol: str, split: str) -> DataFrame:
    """(check, violations): empty, protocol, split, mixed datasets, lengths, duplicate ids."""
    bad = manifest.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("protocol").eqNullSafe(protocol)).alias("protocol"), F.count_if(~F.col("split").eqNullSafe(split)).alias("split"), F.count_distinct("dataset").alias("datasets"),
        F.count_if((F.size("history_indices") != F.col("history_steps")) | (F.size("future_indices") != F.col("future_steps")) | (F.size("history_time_seconds") != F.col("history_steps"))).alias("lengths"),
        (F.count("sample_id") - F.count_distinct("sample_id")).alias("duplicates"),
    )
    rows = {"empty": (F.col("n") == 0).cast("long"), "protocol": F.col("protocol"), "split": F.col("split"), "mixed datasets": F.greatest(F.col("datasets") - 1, F.lit(0)), "lengths": F.col("lengths"), "duplicate ids": F.col("duplicates")}
    return bad.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("violations")) for k, v in rows.items()])))


def read_action_csv(spark: SparkSession, path: str, view: str, anchor_gap: int = 30, least_anchor: int = 60, labelled: bool = False) -> DataFrame:
    """Action segments under either spelling of the headers; empty is null; one camera view; zero-length segments stay."""
    raw = spark.read.csv(path, header=True)
    have = {c.lower(): c for c in raw.columns}

    def first(*names: str) -> Column:
        found = [F.nullif(F.trim(F.col(f"`{have[n]}`")), F.lit("")) for n in names if n in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    rows = raw.select(
        first("id").cast("int").alias("id"), first("video").alias("video"), first("start_frame", "start").cast("int").alias("start"), first("end_frame", "end").cast("int").alias("end"),
        first("action_id", "action").cast("int").alias("action"), first("verb_id", "verb").cast("int").alias("verb"), first("noun_id", "noun", "object_id", "object").cast("int").alias("object"),
        first("toyid", "toy_id").alias("toy"), first("is_shared", "shared").cast("int").alias("shared"),
    )
    rows = rows.withColumn("anchor", F.col("start") - anchor_gap).filter(F.col("video").contains(view) & (F.col("anchor") >= least_anchor))
    return rows.filter("action IS NOT NULL AND verb IS NOT NULL AND object IS NOT NULL") if labelled else rows


def hand_poses(hands: Column) -> list[Column]:
    """Of a clip's hands JSON: position of each side's wrist, its pose in the world, and whether it is there; a missing hand or pose is invalid, not an error."""
    return _hand_poses(F.from_json(hands, schemas.CLIP_HANDS))


def _hand_poses(parsed: Column) -> list[Column]:
    out = []
    for side in ("left", "right"):
        held = F.try_element_at(parsed, F.lit(side))["umetrack_pose"]["T_world_from_wrist"]
        xyz = held["translation_xyz"]
        out += [xyz.alias(f"{side}_xyz"), rigid(held["quaternion_wxyz"], xyz).alias(f"{side}_pose"), xyz.isNotNull().alias(f"{side}_valid")]
    return out


def camera_pose(cameras: Column, name: str) -> Column:
    """Pose in the world of a clip's camera, from its cameras, parsed; null where it isn't there."""
    held = F.try_element_at(cameras, F.lit(name))["T_world_from_camera"]
    return rigid(held["quaternion_wxyz"], held["translation_xyz"])


def frame_time(info: Column, camera: str) -> Column:
    """Nanoseconds of a camera's image, from a frame's info, parsed: its own time, else the frame's."""
    return F.coalesce(F.try_element_at(info["image_timestamps_ns"], F.lit(camera)), info["ref_timestamp_ns"])


def clip_frames(files: DataFrame, path: str, text: str, clip: Column, camera: str) -> DataFrame:
    """A row a clip and frame of files <frame>.cameras.json, <frame>.hands.json and <frame>.info.json: the camera's and both wrists' poses and the image's time; a missing file leaves its part invalid."""
    name, base = r"^([0-9]+)\.(cameras|hands|info)\.json$", F.substring_index(path, "/", -1)
    rows = files.withColumns({"_part": F.regexp_extract(base, name, 2), "_clip": clip}).filter("_part <> ''")
    of = lambda k: F.max(F.when(F.col("_part") == k, F.col(text))).alias(k)
    wide = rows.groupBy(F.col("_clip").alias("clip"), F.regexp_extract(base, name, 1).cast("long").alias("frame")).agg(of("cameras"), of("hands"), of("info"))
    held = {"cameras": schemas.CLIP_CAMERA, "hands": schemas.CLIP_HANDS, "info": schemas.CLIP_INFO}
    parsed = wide.select("clip", "frame", *[F.from_json(k, schema).alias(k) for k, schema in held.items()])  # once, however often it is named below
    return parsed.select("clip", "frame", frame_time(F.col("info"), camera).alias("time_ns"), camera_pose(F.col("cameras"), camera).alias("camera_pose"), *_hand_poses(F.col("hands")))


def read_clip_json(spark: SparkSession, paths: str, camera: str) -> DataFrame:
    """`clip_frames` of folders, one a clip."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", "true").text(paths).select("value", F.col("_metadata.file_path").alias("_p"))
    return clip_frames(files, "_p", "value", F.regexp_extract("_p", r"([^/]+)/[^/]+$", 1), camera)


def read_clip_archives(spark: SparkSession, path: str, camera: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """`clip_frames` of tar archives, one a clip, named by its file; contents of other members, as images, are not read."""
    files = tar_members(spark, path, ".cameras.json,.hands.json,.info.json", partition_bytes=partition_bytes)
    return clip_frames(files.withColumn("_text", F.col("content").cast("string")), "member", "_text", F.regexp_extract(F.substring_index("archive", "/", -1), r"^([^/]+)\.(?:tar|tar\.gz|tgz)$", 1), camera)


def frame_keyed_json(rows: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """A JSON object frame -> name -> numbers to long rows: frame, name, value (array)."""
    outer = rows.select(*keep, F.explode(F.from_json(column, "MAP<STRING, MAP<STRING, ARRAY<DOUBLE>>>")).alias("_f", "_m"))
    return outer.select(*keep, F.col("_f").cast("long").alias("frame"), F.explode("_m").alias("name", "value"))


def read_key_list(spark: SparkSession, path: str) -> DataFrame:
    """Names, one a line, trimmed; blank lines left out."""
    return spark.read.text(path).select(F.trim("value").alias("key")).filter("key <> ''")


def read_flagged_keys(spark: SparkSession, path: str, flag: str) -> DataFrame:
    """First column of the tab-separated lines whose second is the flag, in any case."""
    return spark.read.csv(path, sep="\t", schema="key STRING, flag STRING").filter(F.lower(F.trim("flag")) == flag).select(F.trim("key").alias("key"))


def read_segments(spark: SparkSession, paths: str) -> DataFrame:
    """Files of trajectory segments (a .npy dict: clip, segments of hand, start, end, traj3d) to rows. The files are pickles: read only those you trust.

    A task opens one file after the other, and hands on rows whenever they hold `STEPS` points; so only a file has to fit into memory.
    """

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        rows, points = [], 0

        def batch() -> pa.RecordBatch:
            clip, hand, segment, start, end, paths = zip(*rows, strict=True)
            lists = [pa.array(clip, pa.string()), pa.array(hand, pa.string()), *[pa.array(c, pa.int32()) for c in (segment, start, end)], nested(paths)]
            return pa.RecordBatch.from_arrays(lists, ["clip", "hand", "segment", "start", "end", "traj3d"])

        def nested(paths: tuple) -> pa.ListArray:
            sizes = np.concatenate([np.full(len(p), p.shape[1] if p.ndim == 2 else 0) for p in paths])
            ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            inner = pa.ListArray.from_arrays(ends(sizes), pa.array(np.concatenate([p.reshape(-1) for p in paths])))
            return pa.ListArray.from_arrays(ends([len(p) for p in paths]), inner)

        for path in (p for b in batches for p in b.column("path").to_pylist()):
            system, at = located(path)
            with system.open_input_file(at) as file:
                held = np.load(io.BytesIO(file.read()), allow_pickle=True).item()
            for k, s in enumerate(held["segments"]):
                rows.append((str(held["clip"]), s["hand"], k, int(s["start"]), int(s["end"]), np.asarray(s["traj3d"], float)))
                points += len(rows[-1][-1])
                if points >= STEPS or len(rows) >= STEPS:
                    yield batch()
                    rows, points = [], 0
        if rows:
            yield batch()

    return shipped(spark.read.format("binaryFile").load(paths).select("path")).mapInArrow(load, schemas.SEGMENT)


def read_odometry(spark: SparkSession, paths: str) -> DataFrame:
    """Files of step transforms (a .npy array of n x 4 x 4 numbers, not a pickle), to rows: clip (the file's name), step, transform (16 numbers). Another shape stops the job."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                held = np.load(io.BytesIO(content), allow_pickle=False).astype(float)
                if held.shape[1:] != (4, 4):
                    raise ValueError(f"{path} holds {held.shape}, not n x 4 x 4")
                for at in range(0, len(held), 4096):
                    part = held[at : at + 4096]
                    yield pd.DataFrame({"clip": path.rsplit("/", 1)[-1].removesuffix(".npy"), "step": range(at, at + len(part)), "transform": list(part.reshape(-1, 16))})

    return shipped(spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(paths).select("path", "content")).mapInPandas(load, schemas.ODOMETRY)


def media_only(rows: DataFrame, path: str, suffixes: list[str]) -> DataFrame:
    """Rows whose path ends in one of the suffixes, in any case."""
    return rows.filter(F.lower(path).rlike("(" + "|".join(s.lower().replace(".", r"\.") for s in suffixes) + ")$"))


def list_media(spark: SparkSession, root: str, suffixes: list[str]) -> DataFrame:
    """path, length, modificationTime of media below root, by path; contents are not read. None at all is an error."""
    found = media_only(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime"), "path", suffixes)
    if found.isEmpty():
        raise FileNotFoundError(f"no media below {root}")
    return found.orderBy("path")


def training_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """Step, learning rate and loss from the JSON lines of a mixed text log; broken ones, and ones without lr or loss, are left out."""
    parsed = lines.filter(F.col(line).startswith('{"step":')).withColumn("_j", F.from_json(line, "step BIGINT, lr DOUBLE, loss DOUBLE"))
    return parsed.filter("_j.step IS NOT NULL AND _j.lr IS NOT NULL AND _j.loss IS NOT NULL").select(*[c for c in lines.columns if c != line], "_j.step", "_j.lr", "_j.loss")
