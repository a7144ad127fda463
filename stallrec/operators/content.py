"""Content strategies: similar items, prefiltered, family first, brand first, mix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallrec import config as C
from stallrec.operators import lists as L
from stallrec.operators import masks as M
from stallrec.operators import quality as Q
from stallrec.operators import skew
from stallrec.operators.similarity import lookup, nearest_alike, nearest_asked


CARRY = ("n", *M.MASK_COLUMNS)
OUT = ("request_id", "position", "item_id")


def _per_request():
    return W.partitionBy("request_id")


def similar_items(
    requests: DataFrame, neighbors: DataFrame, items: DataFrame, overfetch: int = 10, strict_mask: bool = False
) -> DataFrame:
    """Nearest ``overfetch * n + 1``, masked, first ``n``; if that leaves fewer than ``n``,
    the nearest ``n + 1`` without the mask (never with ``strict_mask``)."""
    n = F.col("n")
    near = lookup(requests, neighbors, overfetch * n + 1, carry=CARRY)
    passed = F.col("ok").cast("int")
    counted = (
        M.flagged(near, items)
        .withColumn("_all", F.sum(passed).over(_per_request()))
        .withColumn(
            "_place", F.sum(passed).over(_per_request().orderBy("position").rowsBetween(W.unboundedPreceding, 0))
        )
    )
    masked = F.col("ok") & (F.col("_place") <= n)
    if strict_mask:
        kept = counted.filter(masked).withColumn("position", F.col("_place"))
    else:
        full = F.col("_all") >= n
        kept = counted.filter((full & masked) | (~full & (F.col("position") <= n + 1))).withColumn(
            "position", F.when(full, F.col("_place")).otherwise(F.col("position"))
        )
    return kept.select(*OUT)


def request_neighbors(requests: DataFrame, items: DataFrame, active: DataFrame, overfetch: int = 10) -> DataFrame:
    """The stored neighbors that requests can use: of every item asked for the first
    ``overfetch * n + 1`` by position, for its greatest ``n``."""
    asked = requests.filter((F.col("n") > 0) & F.col("bike_id").isNotNull()).groupBy(F.col("bike_id").alias("id"))
    return nearest_asked(asked.agg((F.max("n").cast("bigint") * overfetch + 1).alias("k")), items, active)


def alike_neighbors(
    requests: DataFrame,
    items: DataFrame,
    active: DataFrame,
    features: Sequence[str] = C.PREFILTER_FEATURES,
    match: str = "any",
    overfetch: int = 10,
) -> DataFrame:
    """For every item asked for the nearest active items that share an attribute with it (or all
    of them), as many as its greatest request can use. Searched once per item, however many
    requests ask for it; ``n`` below one asks for nothing."""
    asked = requests.filter((F.col("n") > 0) & F.col("bike_id").isNotNull()).groupBy(F.col("bike_id").alias("id"))
    wanted = asked.agg((F.max("n").cast("bigint") * overfetch + 1).alias("k"))
    return nearest_alike(wanted, items, active, features, match == "all")


def prefiltered_items(
    requests: DataFrame,
    alike: DataFrame,
    items: DataFrame,
    ratio: float = 1.0,
    overfetch: int = 10,
) -> DataFrame:
    """Nearest items that share an attribute with the request's item, from ``alike_neighbors``.

    Empty when at most one item matches, the item itself counted.
    """
    n = F.floor(F.col("n") * F.lit(ratio)).cast("int")
    per_item = W.partitionBy("bike_id")
    matched = (
        alike.select(F.col("item_id").alias("bike_id"), F.col("neighbor_id").alias("item_id"), F.col("position").alias("_near"))
        .withColumn("_all", F.count("*").over(per_item))
        .filter((F.col("_all") > 1) & F.col("_near").isNotNull())
        .drop("_all")
    )
    asked = requests.select("request_id", "bike_id", n.alias("n"), *M.MASK_COLUMNS)
    fetched = skew.join(asked, matched, "bike_id", "request_id").filter(F.col("_near") <= overfetch * F.col("n"))
    return (
        M.flagged(fetched, items)
        .filter("ok")
        .withColumn("position", F.row_number().over(_per_request().orderBy("_near")))
        .filter(F.col("position") <= F.col("n"))
        .select(*OUT)
    )


def family_first(
    requests: DataFrame,
    neighbors: DataFrame,
    quality: DataFrame,
    items: DataFrame,
    overfetch: int = 3,
    family: str = "request",
) -> DataFrame:
    """Same-family items by quality, then near items, up to ``n``.

    ``family='request'`` takes the family the request names, ``'item'`` that of the
    request's item. Returns (request_id, position, item_id, source, family_count).
    """
    own = items.select(F.col("id").alias("bike_id"), F.col("family_id").alias("_family"))
    known = skew.join(requests, own, "bike_id", "request_id")
    if family == "item":
        known = known.withColumn("family_id", F.col("_family"))
    relatives = Q.best_per_list(
        known.withColumn("_m", F.col("n")),
        Q.listed_items(quality, items, ("family_id",), "quality_rank"),
        (),
        "ladder",
        [("family_id", "family_id")],
        exclude="bike_id",
    ).select("request_id", F.col("place").alias("position"), "item_id", F.col("_m").alias("n"), F.lit(0).alias("_from"))
    near = lookup(requests, neighbors, overfetch * F.col("n"), carry=CARRY)
    fill = M.flagged(near, items).filter("ok").select(*OUT, "n", F.lit(1).alias("_from"))
    # One shuffle by request serves all windows below.
    return (
        relatives.unionByName(fill)
        .repartition("request_id")
        .withColumn("family_count", F.sum(1 - F.col("_from")).over(_per_request()))
        .withColumn("_first", F.min("_from").over(W.partitionBy("request_id", "item_id")))
        .filter((F.col("_from") == 0) | ((F.col("family_count") < F.col("n")) & (F.col("_first") == 1)))
        .withColumn("position", F.row_number().over(_per_request().orderBy("_from", "position")))
        .filter(F.col("position") <= F.col("n"))
        .select(*OUT, F.when(F.col("_from") == 0, "family").otherwise("similar").alias("source"), "family_count")
    )


def brand_first(recommended: DataFrame, requests: DataFrame, quality: DataFrame) -> DataFrame:
    """Stable partition: items of the wanted brand first.

    The wanted brand is the request's, or that of the request's item if none is given.
    """
    brands = quality.select("id", F.col("brand").alias("_brand"))
    own = brands.select(F.col("id").alias("bike_id"), F.col("_brand").alias("_own"))
    given = F.when((F.col("brand") != "null") & (F.col("brand") != ""), F.col("brand"))
    wanted = skew.join(requests.select("request_id", "bike_id", "brand"), own, "bike_id", "request_id", "left").select(
        "request_id", F.coalesce(given, F.col("_own")).alias("_wanted")
    )
    other = ~F.coalesce(F.col("_brand") == F.col("_wanted"), F.lit(False))
    w = W.partitionBy("request_id").orderBy("_other", "position")
    names = recommended.columns
    return (
        recommended.join(wanted, "request_id")
        .join(brands.withColumnRenamed("id", "item_id"), "item_id", "left")
        .withColumn("_other", F.when(F.col("_wanted").isNotNull(), other).otherwise(F.lit(False)))
        .withColumn("position", F.row_number().over(w))
        .select(*names)
    )


def content_mixed(
    requests: DataFrame, neighbors: DataFrame, quality: DataFrame, items: DataFrame, family: str = "request"
) -> DataFrame:
    """Family first, then brand first. Requests for unknown items get nothing here."""
    return brand_first(family_first(requests, neighbors, quality, items, family=family), requests, quality)


def mixed(
    requests: DataFrame,
    neighbors: DataFrame,
    alike: DataFrame,
    quality: DataFrame,
    items: DataFrame,
    ratio: float = 0.75,
    interleave: bool = True,
    sample: int = 100,
    seed: int = 0,
) -> DataFrame:
    """Prefiltered and generic neighbors mixed, repeats dropped, first ``n``; relaxed
    quality picks for requests whose item is unknown."""
    known = requests.join(items.hint("merge"), requests.bike_id == items.id, "left_semi")
    unknown = requests.join(items.hint("merge"), requests.bike_id == items.id, "left_anti")
    special = prefiltered_items(known, alike, items, ratio)
    generic = similar_items(known, neighbors, items)
    joined = (L.interleaved if interleave else L.appended)(special, generic)
    merged = L.cut(L.first_seen(joined), known).select("request_id", "position", "item_id")
    return merged.unionByName(Q.sampled_quality(unknown, quality, items, sample, seed))
