"""The incremental refresh: new export files merged into the stored interactions.

The table lies in buckets of (user, item). A micro-batch rewrites only the buckets its rows fall
into, under its own number, and then commits: one small table that says which version of
every bucket holds. Readers go by the last commit, so they see a whole table at any time; a
batch that failed before its commit leaves nothing that is read, and a batch that is repeated
after it does nothing. Versions that neither the new commit nor the one before names are
deleted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallrec.operators import export as E

BUCKETS = 256


def _folder(spark: SparkSession, path: str):
    """(file system, path) in the store that Spark itself reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Names of the finished tables in a folder of numbered ones."""
    system, where = _folder(spark, path)
    if not system.exists(where):
        return []
    done = [f.getPath() for f in system.listStatus(where) if f.getPath().getName().isdigit()]
    return sorted(int(p.getName()) for p in done if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def committed(spark: SparkSession, path: str, version: int | None = None) -> dict[int, int]:
    """The version of every bucket as of a commit, the last one unless given."""
    known = _numbers(spark, f"{path}/commits")
    if not known:
        return {}
    rows = spark.read.parquet(f"{path}/commits/{known[-1] if version is None else version}").collect()
    return {r["bucket"]: r["version"] for r in rows}


def _files(path: str, versions: dict[int, int], buckets: Sequence[int]) -> list[str]:
    return [f"{path}/data/{versions[b]}/_bucket={b}" for b in sorted(buckets)]


def stored(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of a commit; only the last two are kept."""
    versions = committed(spark, path, version)
    if not versions:
        raise ValueError(f"nothing committed in {path}")
    return spark.read.parquet(*_files(path, versions, list(versions)))


def bucket(user: str, item: str):
    return F.pmod(F.xxhash64(user, item), F.lit(BUCKETS)).cast("int")


def merge_batch(rows: DataFrame, number: int, path: str, user: str, item: str, features: Sequence[str]) -> None:
    """Merge one batch's interactions and commit it as ``number``."""
    spark = rows.sparkSession
    if number in _numbers(spark, f"{path}/commits"):
        return
    rows = rows.withColumn("_bucket", bucket(user, item)).persist()
    try:
        touched = [r["_bucket"] for r in rows.select("_bucket").distinct().collect()]  # at most BUCKETS
        versions = committed(spark, path)
        merged = rows.drop("_bucket")
        old = [b for b in touched if b in versions]
        if old:
            both = E.merged(spark.read.parquet(*_files(path, versions, old)), merged, user, item, features)
            # a sum widens decimals; all buckets keep the type of the rows
            merged = both.select(*[F.col(f.name).cast(f.dataType) for f in merged.schema.fields])
        merged = merged.withColumn("_bucket", bucket(user, item))
        merged.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/{number}")
    finally:
        rows.unpersist()
    now = {**versions, **dict.fromkeys(touched, number)}
    listed = spark.createDataFrame(sorted(now.items()), "bucket int, version int")
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{number}")
    _drop_unread(spark, path, versions, now)


def _drop_unread(spark: SparkSession, path: str, before: dict[int, int], now: dict[int, int]) -> None:
    system, data = _folder(spark, f"{path}/data")
    if not system.exists(data):
        return
    kept = set(before.items()) | set(now.items())
    for version in system.listStatus(data):
        for part in system.listStatus(version.getPath()):
            name = part.getPath().getName()
            if name.startswith("_bucket=") and (int(name.removeprefix("_bucket=")), int(version.getPath().getName())) not in kept:
                system.delete(part.getPath(), True)


def refresh(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    path: str,
    extract: Callable[[DataFrame], DataFrame],
    user: str,
    item: str,
    features: Sequence[str],
) -> int | None:
    """Read all export files that arrived since the last run and merge them.

    Returns the number of the last batch this run merged, None if nothing arrived.
    """
    written: list[int] = []

    def merge(batch: DataFrame, number: int) -> None:
        merge_batch(extract(batch), number, path, user, item, features)
        written.append(number)

    query = (
        spark.readStream.schema(schema)
        .json(source)
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return written[-1] if written else None
