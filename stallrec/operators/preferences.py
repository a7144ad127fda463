"""Stated preferences: JSON answers and budget texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallrec import config as C
from stallrec.functions import columns as X

PREFERENCE_JSON = "max_price double, categories array<string>, frame_sizes array<string>"


def user_preferences(answers: DataFrame, categories: DataFrame) -> DataFrame:
    """One row per user, category and size; missing parts become 'any'."""
    p = F.col("p")
    rows = (
        answers.select("user_id", F.from_json("preferences", PREFERENCE_JSON).alias("p"))
        .select(
            "user_id",
            F.coalesce(F.round(p["max_price"]).cast("bigint"), F.lit(C.MAX_PRICE_DEFAULT).cast("bigint"))
            .alias("max_price"),
            p["frame_sizes"].alias("frame_sizes"),
            F.explode_outer(p["categories"]).alias("category"),
        )
        .select(
            "user_id",
            "max_price",
            F.coalesce("category", F.lit("none")).alias("category"),
            F.explode_outer("frame_sizes").alias("frame_size"),
        )
        .withColumn("frame_size", F.coalesce("frame_size", F.lit("none")))
    )
    names = categories.select(F.lower("name").alias("_name"), F.col("id").alias("_id"))
    return rows.join(names, F.lower("category") == F.col("_name"), "left").select(
        "user_id",
        "max_price",
        F.coalesce("_id", F.lit(0).cast("bigint")).alias("category_id"),
        "frame_size",
    )


def stated_budget(users: DataFrame, categories: DataFrame, clean_open_end: bool = False) -> DataFrame:
    """Budget bounds and the category named as rider style."""
    low, high = X.budget_bounds(F.col("budget"), clean_open_end)
    named = categories.select(F.col("id").alias("bike_category_id"), "name")
    return users.join(named, F.col("rider_style") == F.col("name"), "left").select(
        "user_id", "bike_category_id", low.alias("budget_min"), high.alias("budget_max")
    )
