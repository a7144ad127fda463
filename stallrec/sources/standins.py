"""The driver's tables in the shape of the marketplace's own tables.

Every frame is a plain projection or aggregation of the given parquet tables, so it
grows with them. ``stallrec.registry.sql`` states the same in SQL for the oracle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallrec import config as C

CATALOG_AS_OF = dt.datetime(2001, 11, 6)
EVENTS_AS_OF = dt.date(2024, 1, 31)
ORDERS_AS_OF = dt.date(2001, 11, 6)
EVENT_NAMES = tuple(C.EVENT_WEIGHTS)
LETTERS = ("XS", "S", "M", "L", "XL")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hex_id(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def frame_size_text(size: Column) -> Column:
    number = (F.lit(44) + size % 20).cast("string")
    return (
        F.when(size % 5 == 0, _pick(LETTERS, F.floor(size / 5) % 5))
        .when(size % 5 == 1, F.concat(number, F.lit(",5")))
        .otherwise(number)
    )


def family_of(name: Column) -> Column:
    return _hex_id(name, 4)


def category_of(kind: Column) -> Column:
    return _hex_id(kind, 3) + 1


def catalog_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Listings, infos, templates, countries, quality scores, brands and categories."""
    part = table(spark, sf_dir, "part")
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(
            F.count("*").alias("n_lines"),
            F.sum((F.col("l_linestatus") == "O").cast("int")).alias("n_open"),
            F.sum((F.col("l_returnflag") == "R").cast("int")).alias("n_back"),
            F.max("l_shipdate").alias("updated_at"),
            F.min("l_suppkey").alias("l_suppkey"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
        )
    )
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    size = F.col("p_size")
    key = F.col("p_partkey")
    listings = (
        part.join(lines, part.p_partkey == lines.l_partkey)
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
        .select(
            key.alias("id"),
            F.floor(key / 2).alias("bike_template_id"),
            F.when(2 * F.col("n_open") >= F.col("n_lines"), "active")
            .when(3 * F.col("n_back") >= F.col("n_lines"), "inactive")
            .otherwise("sold")
            .alias("status"),
            (1 + size % 3).cast("bigint").alias("bike_type_id"),
            category_of(F.col("p_type")).alias("bike_category_id"),
            F.when(size % 7 == 0, None)
            .when(size % 7 <= 2, 1)
            .otherwise(0)
            .cast("bigint")
            .alias("motor"),
            F.floor(F.col("p_retailprice") * size / 10).cast("double").alias("price"),
            F.concat(F.lit("brake"), (key % 3).cast("string")).alias("brake_type_code"),
            F.concat(F.lit("mat"), (key % 4).cast("string")).alias("frame_material_code"),
            F.concat(F.lit("shift"), (key % 2).cast("string")).alias("shifting_code"),
            (2005 + key % 20).alias("year"),
            (1 + key % 10).alias("bike_component_id"),
            F.split_part("p_name", F.lit(" "), F.lit(1)).alias("color"),
            family_of(F.col("p_name")).alias("family_id"),
            F.col("s_nationkey").alias("country_id"),
            F.substring("p_brand", 7, 10).cast("bigint").alias("brand_id"),
            F.concat(F.lit("listing-"), key.cast("string")).alias("slug"),
            "updated_at",
        )
    )
    height = 150 + 5 * (size % 6)
    infos = part.select(
        key.alias("bike_id"),
        frame_size_text(size).alias("frame_size"),
        F.when(size % 11 != 0, height).cast("double").alias("rider_height_min"),
        (height + 10 + size % 15).cast("double").alias("rider_height_max"),
    )
    t = F.col("bike_template_id")
    templates = (
        part.select(F.floor(key / 2).alias("bike_template_id"))
        .distinct()
        .select(
            (t + 5).alias("id"),
            "bike_template_id",
            F.when(t % 4 == 1, "full").when(t % 4 > 1, "front").alias("suspension"),
            F.when(t % 5 == 0, 1).when(t % 5 > 1, 0).cast("bigint").alias("is_ebike"),
            F.when(t % 6 == 0, 1).when(t % 6 > 1, 0).cast("bigint").alias("is_frameset"),
        )
    )
    countries = (
        table(spark, sf_dir, "nation")
        .filter("n_nationkey <> 24")
        .select(
            F.col("n_nationkey").alias("id"),
            F.expr("CASE n_regionkey WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 7 WHEN 3 THEN 2 ELSE 3 END")
            .cast("bigint")
            .alias("continent_id"),
        )
    )
    scores = lines.select(F.col("l_partkey").alias("bike_id"), (F.col("qty") % 101).alias("score"))
    brands = part.select(
        F.substring("p_brand", 7, 10).cast("bigint").alias("id"),
        F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("slug"),
    ).distinct()
    categories = part.select(
        category_of(F.col("p_type")).alias("id"),
        F.lower("p_type").alias("slug"),
        F.initcap("p_type").alias("name"),
    ).distinct()
    return {
        "listings": listings,
        "infos": infos,
        "templates": templates,
        "countries": countries,
        "scores": scores,
        "brands": brands,
        "categories": categories,
    }


def named_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` under marketplace event names; sign-ups carry a user id."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        _pick(EVENT_NAMES, F.col("event_id") % len(EVENT_NAMES)).alias("event_type"),
        F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("anonymous_id"),
        F.when(
            F.col("event_type") == "signup",
            F.concat(F.lit("u"), F.floor(F.col("user_id") / 2).cast("string")),
        ).alias("user_id"),
        F.from_json("props", "k bigint")["k"].alias("item_id"),
        "ts",
    )


def event_sources(spark: SparkSession, sf_dir: str) -> list[dict]:
    """The event feeds as they arrive: three spellings of the item id, one id list."""
    ev = named_events(spark, sf_dir)
    booking = ("payment_info_entered", "order_completed")
    recommended = ("recom_bike_view",)
    listed = ("show_recommendation",)
    k = F.col("item_id")
    ids = F.concat_ws(
        ",",
        k.cast("string"),
        ((k + 7) % 100).cast("string"),
        F.when(F.col("event_id") % 40 < 20, "n/a"),
    )
    return [
        {
            "events": ev.filter(~F.col("event_type").isin(*booking, *recommended, *listed))
            .withColumnRenamed("item_id", "bike_id"),
            "item": "bike_id",
        },
        {
            "events": ev.filter(F.col("event_type").isin(*booking))
            .withColumnRenamed("item_id", "booking_bike_id"),
            "item": "booking_bike_id",
        },
        {
            "events": ev.filter(F.col("event_type").isin(*recommended))
            .withColumnRenamed("item_id", "recommended_bike_id"),
            "item": "recommended_bike_id",
        },
        {
            "events": ev.filter(F.col("event_type").isin(*listed))
            .withColumn("recommendation_product_ids", ids),
            "id_list": "recommendation_product_ids",
        },
    ]


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as events: customers act on parts."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        _pick(EVENT_NAMES, (F.col("l_quantity").cast("bigint") + F.col("l_linenumber")) % len(EVENT_NAMES))
        .alias("event_type"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("anonymous_id"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("u"), F.col("o_custkey").cast("string")))
        .alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_shipdate").alias("ts"),
    )


def stated_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, preferences): one JSON text per customer, some keys missing or empty."""
    c = table(spark, sf_dir, "customer")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    k = F.col("c_custkey")
    joined = c.join(part, c.c_custkey == part.p_partkey)
    parts = F.concat_ws(
        ",",
        F.when(k % 3 != 0, F.concat(F.lit('"max_price":'), (300 + (k * 37) % 4000).cast("string"))),
        F.when(
            k % 4 != 0,
            F.concat(
                F.lit('"categories":["'),
                F.lower("p_type"),
                F.when(k % 4 == 1, F.lit('","PROMO')).otherwise(F.lit("")),
                F.lit('"]'),
            ),
        ),
        F.when(
            k % 5 != 0,
            F.concat(
                F.lit('"frame_sizes":['),
                F.when(
                    k % 5 == 1, F.concat(F.lit('"'), frame_size_text(F.col("p_size")), F.lit('","L"'))
                )
                .when(k % 5 == 2, F.lit(""))
                .otherwise(F.concat(F.lit('"'), frame_size_text(F.col("p_size")), F.lit('"'))),
                F.lit("]"),
            ),
        ),
    )
    return joined.filter(k % 2 == 1).select(
        k.alias("user_id"), F.concat(F.lit("{"), parts, F.lit("}")).alias("preferences")
    )


def stated_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, budget, rider_style) texts in the three shapes, and null."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("user_id"),
        F.when(k % 4 == 0, None)
        .when(k % 4 == 1, F.concat(F.lit("More than €"), (k % 9 + 1).cast("string"), F.lit("000")))
        .when(k % 4 == 2, F.concat(F.lit("More than €"), (k % 9 + 1).cast("string"), F.lit(".500")))
        .otherwise(
            F.concat(
                F.lit("€"), (k % 9 + 1).cast("string"), F.lit(".000-€"),
                (k % 9 + 3).cast("string"), F.lit(".500"),
            )
        )
        .alias("budget"),
        _pick(("Promo", "Small", "small", "Unknown", "Medium"), k % 5).alias("rider_style"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw request per customer, attributes taken from the part of the same key."""
    c = table(spark, sf_dir, "customer")
    part = table(spark, sf_dir, "part")
    nation = table(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    size = F.col("p_size")
    strategies = ("product_page", "braze", "homepage", "rerank", "FallbackContentMixed", "bot", "valentine")
    height = 150 + 5 * (size % 6) + 8
    return (
        c.join(part, k == F.col("p_partkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            k.alias("request_id"),
            F.when(k % 6 != 0, k.cast("string")).otherwise(F.lit("x1")).alias("user_id"),
            F.when(k % 12 != 0, F.concat(F.lit("d"), k.cast("string"))).alias("distinct_id"),
            F.expr("CASE n_regionkey WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 7 WHEN 3 THEN 2 ELSE 1 END")
            .alias("continent_id"),
            F.when(k % 35 != 0, k).alias("bike_id"),
            F.when(k % 7 == 3, F.array(k, k + 3, k + 1, k, k % 50, k % 20, F.lit(188941086120)))
            .alias("bike_rerank_id"),
            F.when(k % 5 != 0, 8 + 4 * (k % 4)).cast("int").alias("n"),
            F.when(k % 40 != 0, _pick(strategies, k % 7)).alias("strategy"),
            F.when(k % 9 != 0, (1 + size % 3).cast("string")).otherwise(F.lit("n/a")).alias("bike_type"),
            family_of(F.col("p_name")).cast("string").alias("family_id"),
            F.floor(F.col("p_retailprice") * size / 10).alias("price"),
            frame_size_text(size).alias("frame_size_code"),
            height.alias("rider_height"),
            F.lower("p_type").alias("category"),
            (k % 5 == 0).cast("int").alias("is_ebike"),
            (k % 6 == 0).cast("int").alias("is_frameset"),
            F.when(k % 3 == 0, F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))))
            .otherwise(F.lit("null"))
            .alias("brand"),
        )
    )
