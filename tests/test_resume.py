"""Publication of shards that is broken off and taken up again."""

from __future__ import annotations

import shutil
from pathlib import Path

import pytest

from kinetrace.operators import resume


@pytest.fixture
def rows(spark):
    given = [(i * 7 % 101, f"s{i % 3}" if i % 5 else None, None if i % 11 == 0 else i / 4) for i in range(101)]
    return given, spark.createDataFrame(given, "id long, source string, x double")


def publish(df, path, run="a", **options):
    return {r.shard: (r.rows, r.state) for r in resume.publish_shards(df, ["id"], 10, path, run, shards_a_job=3, **options).collect()}


def test_a_later_run_keeps_the_prefix_and_writes_the_rest(spark, rows, tmp_path):
    given, df = rows
    path = str(tmp_path / "out")
    assert publish(df, path, most_jobs=1) == {k: (10, "written") for k in range(3)}
    (tmp_path / "out" / "_job=000000003-dead" / "shard=3").mkdir(parents=True)  # a job that died before its record
    spark.createDataFrame([(1, "s9", 0.0, 30)], "id long, source string, x double, index long").write.mode("overwrite").parquet(f"{path}/_job=000000003-dead/shard=3")
    before = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    told = publish(df, path)
    assert told == {k: (1 if k == 10 else 10, "kept" if k < 3 else "written") for k in range(11)}
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    held = resume.published_shards(spark, path, df.schema).collect()
    assert [tuple(r)[:3] for r in sorted(held, key=lambda r: r["index"])] == sorted(given, key=lambda r: r[0]) and all(r["shard"] == r["index"] // 10 for r in held)
    assert publish(df, path) == {k: (n, "kept") for k, (n, _) in told.items()}


def test_other_runs_inputs_and_damage_are_refused(spark, rows, tmp_path):
    _, df = rows
    path = str(tmp_path / "out")
    publish(df, path, most_jobs=2)
    with pytest.raises(ValueError, match="different run"):
        publish(df, path, run="b")
    with pytest.raises(ValueError, match="no longer gives"):
        publish(df.withColumn("x", df.x + 1), path)
    files = len(list(Path(path).rglob("*.parquet")))
    shutil.rmtree(next(Path(path).glob("_job=000000003-*")) / "shard=4")
    with pytest.raises(ValueError, match="differ from their records"):
        publish(df, path)
    assert len(list(Path(path).rglob("*.parquet"))) < files  # nothing was written


def test_complete_only_if_counts_by_source_agree(spark, rows, tmp_path):
    given, df = rows
    path = str(tmp_path / "out")
    expected = df.groupBy("source").count().withColumnRenamed("count", "expected")
    publish(df, path, most_jobs=3)
    assert resume.finish(spark, path, df.schema, "source", expected).count() > 0 and not resume.complete(spark, path)
    publish(df, path)
    assert resume.finish(spark, path, df.schema, "source", expected).isEmpty() and resume.complete(spark, path)


def test_an_empty_table_publishes_nothing(spark, rows, tmp_path):
    assert publish(rows[1].limit(0), str(tmp_path / "out")) == {}
