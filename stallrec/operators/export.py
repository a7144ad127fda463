"""The route from raw event exports to interactions, and merging of periods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallrec import config as C
from stallrec.functions import columns as X
from stallrec.session import cut_lineage


def listed_events(raw: DataFrame, events: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Rows of the listed events with nested properties as plain columns.

    A feature is a path below ``properties``; its dots become underscores.
    """
    picked = [F.col(f"properties.{f}").alias(f.replace(".", "_")) for f in features]
    return raw.filter(F.col("event").isin(list(events))).select("event", *picked)


def within_limit(df: DataFrame, user: str, limit: int = 1000) -> DataFrame:
    """Drop users with more than ``limit`` rows.

    The counts are aggregated and joined back: a window would gather all rows of the
    heaviest user in one task only to drop them.
    """
    light = df.groupBy(user).agg(F.count("*").alias("count")).filter(F.col("count") <= limit)
    return df.join(light, user)


def summed(df: DataFrame, user: str, item: str, features: Sequence[str]) -> DataFrame:
    """Feedback sum and most frequent feature values per (user, item); among equally
    frequent values the least one."""
    return df.groupBy(user, item).agg(
        F.sum("feedback").cast(C.FEEDBACK_TYPE).alias("feedback"),
        *[F.mode(F.col(c).cast("string"), deterministic=True).alias(c) for c in features],
    )


def export_interactions(
    raw: DataFrame,
    user: str,
    item: str,
    features: Sequence[str],
    weights: Mapping[str, float] = C.EXPORT_EVENT_WEIGHTS,
    key: str | None = None,
    fraction: float = 0.8,
    seed: int = 1,
    limit: int = 1000,
) -> DataFrame:
    """Sample, pick events, weigh, cut heavy users, aggregate.

    With ``key``, a column that tells rows apart, the sample is the same in any layout.
    """
    sampled = raw.filter(X.in_fraction([F.col(key)], fraction, seed)) if key else raw.sample(False, fraction, seed)
    rows = listed_events(sampled, list(weights), [user, item, *features]).na.drop("any")
    flat = {c: c.replace(".", "_") for c in (user, item, *features)}
    # Written once: the limit reads the rows twice, and the raw text is slow to parse.
    weighed = cut_lineage(rows.withColumn("feedback", X.event_weight(F.col("event"), weights, unknown=None)))
    return summed(
        within_limit(weighed, flat[user], limit), flat[user], flat[item], [flat[f] for f in features]
    )


def merged(first: DataFrame, second: DataFrame, user: str, item: str, features: Sequence[str]) -> DataFrame:
    """Two periods' interactions as one. Sums add up; of two modes the least is taken."""
    return summed(first.unionByName(second), user, item, features)
