"""Catalog preparation: listing query, cleaning, quality table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallrec import config as C
from stallrec.functions import columns as X
from stallrec.session import cut_lineage


def eligible(status: Column, updated_at: Column, template: Column, score: Column, as_of: dt.datetime) -> Column:
    """Active items, or recently touched visible ones with a fair score.

    The template and score tests bind to the second branch only.
    """
    recent = X.whole_weeks(updated_at, F.lit(as_of)) <= C.MAX_IDLE_WEEKS
    return (status == "active") | (
        ~status.isin(*C.HIDDEN_STATUSES)
        & recent
        & (template != C.EXCLUDED_TEMPLATE)
        & (score > C.MIN_SCORE)
    )


def listing_catalog(t: Mapping[str, DataFrame], as_of: dt.datetime) -> DataFrame:
    """The item catalog: five joins, the eligibility rule and renames.

    The rule reads listings and scores alone, so it runs right after that join.
    """
    b, q = t["listings"], t["scores"]
    eligible_items = b.join(q, b.id == q.bike_id).filter(
        eligible(b.status, b.updated_at, b.bike_template_id, q.score, as_of)
    )
    i, tp = t["infos"], t["templates"]
    co, br = t["countries"], t["brands"]
    return (
        eligible_items.join(i, b.id == i.bike_id)
        .join(tp, b.bike_template_id == tp.id, "left")
        .join(co, b.country_id == co.id, "left")
        .join(br, b.brand_id == br.id)
        .select(
            b.id.alias("id"),
            b.bike_template_id.alias("template_id"),
            q.score.alias("quality_score"),
            b.status,
            b.bike_type_id.alias("bike_type"),
            b.bike_category_id,
            b.motor,
            co.continent_id,
            i.frame_size.alias("frame_size_code"),
            b.price,
            b.brake_type_code,
            b.frame_material_code,
            b.shifting_code,
            b.year,
            b.bike_component_id,
            b.color,
            F.coalesce(tp.suspension, F.lit("NULL")).alias("suspension"),
            b.family_id,
            br.slug.alias("brand"),
        )
    )


def keep_last(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last in ``order``, further columns breaking ties.

    An aggregate over a struct, not a window: it combines before the shuffle, so a key
    that repeats in a third of the rows sends one row per task.
    """
    rest = [c for c in df.columns if c not in key and c not in order]
    packed = F.struct(*order, *rest)
    return (
        df.groupBy(*key)
        .agg(F.max(packed).alias("_last"))
        .select(*[F.col(c) if c in key else F.col("_last")[c].alias(c) for c in df.columns])
    )


def fill_with_median(df: DataFrame, column: str) -> DataFrame:
    """Nulls of one column become its exact median (computed as a scalar subquery)."""
    median = df.agg(F.median(column).alias("m")).scalar()
    return df.withColumn(column, F.coalesce(F.col(column).cast("double"), median))


def clean_items(catalog: DataFrame, letters_by_type: Mapping | None = None) -> DataFrame:
    """Last row per id, median motor, no nulls, numeric frame size."""
    one = keep_last(catalog, ["id"], ["quality_score"])
    filled = fill_with_median(one, "motor").na.drop("any")
    size = X.size_number(F.col("frame_size_code"), F.col("bike_type"), None, letters_by_type=letters_by_type)
    return filled.withColumn("frame_size_code", size).na.drop("any")


def status_masked(items: DataFrame, statuses: Sequence[str] = ("active",)) -> DataFrame:
    return items.filter(F.col("status").isin(list(statuses)))


def active_listings_by_quality(t: Mapping[str, DataFrame]) -> DataFrame:
    """Active items with the attributes of the quality filter, one row per group key.

    Score, flags and brand are outside the group key; the greatest score and flag and
    the least brand are taken.
    """
    b = t["listings"].filter(F.col("status") == "active")
    q, i, tp, br, ca = t["scores"], t["infos"], t["templates"], t["brands"], t["categories"]
    return (
        b.join(q, b.id == q.bike_id)
        .join(ca, b.bike_category_id == ca.id)
        .join(i, b.id == i.bike_id)
        .join(tp, b.bike_template_id == tp.bike_template_id)
        .join(br, b.brand_id == br.id)
        .groupBy(
            b.id.alias("id"),
            b.price.alias("price"),
            i.frame_size.alias("frame_size_code"),
            b.family_id.alias("family_id"),
            b.bike_type_id.alias("bike_type"),
            b.slug.alias("slug"),
            ca.slug.alias("category"),
            b.bike_category_id.alias("bike_category_id"),
            i.rider_height_min.alias("rider_height_min"),
            i.rider_height_max.alias("rider_height_max"),
        )
        .agg(
            F.max(q.score).alias("quality_score"),
            F.max(F.coalesce(tp.is_ebike, F.lit(0))).alias("is_ebike"),
            F.max(F.coalesce(tp.is_frameset, F.lit(0))).alias("is_frameset"),
            F.min(br.slug).alias("brand"),
        )
    )


#: Rows that one task puts in order.
RANKED = 1_000_000


def with_rank(df: DataFrame, score: str, key: str, name: str) -> DataFrame:
    """Dense position by ``score`` descending, ``key`` ascending, without one task that sees all.

    Rows are dealt into ranges of (score, key) by sampled quantiles, as many as the count asks
    for, so neither a far-off key nor a score that many rows share makes a large range. A
    row's place in its range is fixed by writing it; the ranges' sizes give the offsets.
    """
    rows = cut_lineage(df)
    parts = max(1, -(-rows.count() // RANKED))
    order = [F.col(score).desc(), F.col(key)]
    ranged = rows.repartitionByRange(parts, *order) if parts > 1 else rows.coalesce(1)
    placed = cut_lineage(ranged.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    # a row per range
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_part", (F.sum("_n").over(before) - F.col("_n")).alias("_offset"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(sizes, "_part").withColumn(name, (F.col("_offset") + place).cast("bigint")).drop("_at", "_part", "_offset")


def quality_table(t: Mapping[str, DataFrame], letters_by_type: Mapping | None = None) -> DataFrame:
    """The quality table with its explicit order, nulls dropped, heights as integers."""
    rows = keep_last(active_listings_by_quality(t), ["id"], ["quality_score"])
    size = X.size_number(F.col("frame_size_code"), F.col("bike_type"), None, letters_by_type=letters_by_type)
    clean = (
        rows.withColumn("frame_size_code", size)
        .na.drop("any")
        .withColumn("rider_height_min", F.col("rider_height_min").cast("bigint"))
        .withColumn("rider_height_max", F.col("rider_height_max").cast("bigint"))
    )
    return with_rank(clean, "quality_score", "id", "quality_rank")
