"""Joins on a key that a large share of the rows may hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one in ``SHARES`` of the rows.
SHARES = 1024


def hot_keys(rows: DataFrame, key: str, shares: int) -> DataFrame:
    """(key, _salts) of the hot keys, of which there are fewer than ``shares``. A salt stands for at
    most one in ``shares`` of the rows, chance aside."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.agg(F.count("*")).scalar()
    return counts.filter(F.col(key).isNotNull() & (F.col("_n") * shares > total)).select(
        key, F.ceil(F.col("_n") * shares / total).cast("int").alias("_salts")
    )


def join(rows: DataFrame, other: DataFrame, key: str, spread: str, how: str = "inner", shares: int | None = None) -> DataFrame:
    """``rows`` joined (inner or left) to ``other`` on ``key``, hot keys dealt out.

    Rows of a hot key are dealt by the digest of their column ``spread`` to as many salts as
    the count asks for, and what ``other`` has for the key is there once per salt. The hot
    keys are few by their definition, so they are broadcast, whatever the tables hold.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"no {how} join on salted keys")
    shares = shares or SHARES
    hot = F.broadcast(hot_keys(rows, key, shares))
    dealt = F.pmod(F.xxhash64(spread), F.coalesce(F.col("_salts"), F.lit(shares)))
    # rows without a key match nothing and lie anywhere
    salt = F.when(F.col(key).isNull(), -1 - dealt).when(F.col("_salts").isNull(), 0).otherwise(dealt).cast("int")
    left = rows.join(hot, key, "left").withColumn("_salt", salt).drop("_salts")
    every = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    right = other.join(hot, key, "left").withColumn("_salt", F.explode(every)).drop("_salts")
    # both sides grow: neither goes through the driver, however small its files look
    return left.join(right.hint("merge"), [key, "_salt"], how).drop("_salt")
