"""Plan helpers: the shared folder, cutting lineage, and running sums that no single task has to hold."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Only where that is unset and the master is local (tests), a new temporary one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return named or context.getCheckpointDir()


_sent_to: set[str] = set()


def shipped(df: DataFrame) -> DataFrame:
    """df, with this package sent to the executors (once an application): Python tasks import it there, installed or not."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _sent_to:
        package = Path(__file__).resolve().parent.parent
        folder = Path(tempfile.mkdtemp(prefix="spark-"))
        shutil.copytree(package, folder / "src" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(str(folder / package.name), "zip", folder / "src"))  # Spark hands it on from the driver
        _sent_to.add(context.applicationId)
    return df


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are computed once, and survive the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the shared folder and read back: as `cut`, with columns that later reads can leave out."""
    return _written(df, name)[0]


def bucketed(df: DataFrame, table: str, path: str, keys: list[str], buckets: int, by: str | None = None) -> None:
    """Write df as a table at path, bucketed and sorted by keys: one file a bucket (and value of `by`), as rows move to their bucket before they are written."""
    rows = df.repartition(buckets, *keys).sortWithinPartitions(*([by] if by else []), *keys)
    out = rows.write.option("compression", "zstd").option("path", path).format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    (out.partitionBy(by) if by else out).saveAsTable(table)


class Scratch:
    """Tables in the shared folder for the steps of one job, deleted when it is done. What it returns must be stored outside.

    A table stored under a name that is in use takes the place of the earlier one, so a loop holds one table a name.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths, self.tables = spark, {}, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for name in list(self.paths):
            self.drop(name)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        out, path = _written(df, name)
        self.drop(name)
        self.paths[name] = path
        return out

    def bucketed(self, df: DataFrame, name: str, keys: list[str], buckets: int, by: str | None = None) -> DataFrame:
        """As `stored`, bucketed and sorted by keys, so that joins and groups on them don't shuffle; `by` also parts it into folders."""
        table = f"{name}_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{table}"
        bucketed(df, table, path, keys, buckets, by)
        self.drop(name)
        self.paths[name], self.tables[name] = path, table
        return self.spark.table(table)

    def drop(self, name: str) -> None:
        if table := self.tables.pop(name, None):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        if name in self.paths:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that takes nulls in the keys as equal; the right side's keys are dropped."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def running_before(df: DataFrame, group: list[str], bucket: str, order: list[Column | str], value: Column, before: str, total: str | None = None) -> DataFrame:
    """Add the sum of `value` over the rows before this one in (bucket, order) inside its group.

    `bucket` must rise with the order. Each (group, bucket) is summed alone and gets the sum of the buckets before it
    from a table with one row for each bucket, so a group with a third of all rows is still spread over many tasks.
    """
    part = [*group, bucket]
    sums = df.groupBy(*part).agg(F.sum(value).alias("_sum"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*part, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"), *([F.sum("_sum").over(whole).alias(total)] if total else []))
    inner = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return same(rows, sums, part).withColumn(before, F.col("_base") + F.col("_inner")).drop("_base", "_inner")


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """df dealt into sorted ranges of the order, whose numbers, which rise with it, are in `_part`; stored, as the ranges are sampled anew if the plan runs again."""
    return cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def carried(df: DataFrame, group: list[str], order: list[str], value: Column, name: str, backward: bool = False) -> DataFrame:
    """Add the last value that isn't null at or before each row, in the order inside its group; backward: the first at or after it.

    df comes from `in_ranges`, by group and order. Each (group, range) is scanned alone, and what reaches into a range comes
    from a table with one row a range, over ranges without a value too; so a group with a third of all rows is spread over many tasks.
    """
    part, along = [*group, "_part"], [F.desc(c) if backward else F.asc(c) for c in order]
    own = F.last(value, ignorenulls=True).over(Window.partitionBy(*part).orderBy(*along).rowsBetween(Window.unboundedPreceding, 0))
    pick = F.min_by if backward else F.max_by
    ends = df.groupBy(*part).agg(pick(value, F.when(value.isNotNull(), F.struct(*order))).alias("_end"))
    earlier = Window.partitionBy(*group).orderBy(F.desc("_part") if backward else F.asc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*part, F.last("_end", ignorenulls=True).over(earlier).alias("_reaching"))
    return same(df.withColumn("_own", own), ends, part).withColumn(name, F.coalesce("_own", "_reaching")).drop("_own", "_reaching")


def spread(rows: int) -> int:
    """How many buckets to deal `rows` rows into: about the square root, so that buckets and rows in a bucket grow alike."""
    return max(1, round(rows**0.5))
