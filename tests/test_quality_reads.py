"""How many (request, item) pairs the quality searches test."""

import pytest
from pyspark.sql import functions as F

from stallrec.operators import masks as M
from stallrec.operators import quality as Q


@pytest.fixture
def pairs_tested(monkeypatch):
    met = []
    plain = Q.B.meet

    def counting(queries, items):
        out = plain(queries, items)
        met.append(out.select((F.size("requests") * F.size("items")).alias("n")).agg(F.sum("n")).first()[0] or 0)
        return out

    monkeypatch.setattr(Q.B, "meet", counting)
    monkeypatch.setattr(Q, "WAVE", 25)
    monkeypatch.setattr(Q, "GROWTH", 2)
    return met


@pytest.fixture
def shop(spark):
    rows = spark.range(1, 401).select(
        "id", F.col("id").alias("quality_rank"), F.concat(F.lit("s"), "id").alias("slug"), F.lit("road").alias("category"),
        F.lit(200).alias("rider_height_max"), F.lit(150).alias("rider_height_min"), F.lit(1000.0).alias("price"), F.lit(0).alias("is_ebike"),
        F.lit(0).alias("is_frameset"), F.lit("b").alias("brand"), F.lit(1).alias("bike_type"),
        (F.col("id") % 20).cast("string").alias("frame_size_code"), (F.col("id") % 3).alias("family_id"),
    )
    items = rows.select(
        "id", F.lit(1).cast("bigint").alias("continent_id"), F.lit(0.0).alias("motor"), "price", F.lit(50.0).alias("frame_size_code"), F.lit(2).cast("bigint").alias("bike_category_id"),
    )
    asks = spark.range(20).select(
        F.col("id").alias("request_id"), F.lit(1).alias("continent_id"), F.lit(None).cast(M.PREFS_TYPE).alias("prefs"), F.lit(2).cast("bigint").alias("n"),
        F.lit("road").alias("category"), F.lit(180).alias("rider_height"), (F.col("id") + 990).alias("price"), F.lit(0).alias("is_ebike"), F.lit(0).alias("is_frameset"),
        F.lit("null").alias("brand"), F.lit(1).alias("bike_type"), F.col("id").cast("string").alias("frame_size_code"), (F.col("id") % 3).alias("family_id"),
    )
    return rows, items, asks


def test_buyer_lists_that_are_full_read_no_further(shop, pairs_tested):
    rows, items, asks = shop
    got = Q.progressive_quality(asks, rows, items, Q.BUYER_TESTS).groupBy("request_id").count().collect()
    assert len(got) == 20 and all(r["count"] == 2 for r in got)
    assert sum(pairs_tested) < 0.4 * 20 * 400


def test_relaxed_reads_the_size_asked_for(shop, pairs_tested):
    rows, items, asks = shop
    got = Q.relaxed_quality(asks, rows, items).collect()
    # within a size every third item is of the family
    want = {n: [i for i in range(1, 401) if i % 20 == n and i % 3 == n % 3][:2] for n in range(20)}
    assert {(r.request_id, r.position, r.item_id, r.rung) for r in got} == {(n, p, i, 4) for n, v in want.items() for p, i in enumerate(v, 1)}
    assert sum(pairs_tested) < 0.2 * 20 * 400


def test_relaxed_goes_down_the_rungs(shop, pairs_tested):
    rows, items, asks = shop
    for family, size, price, n, rung in ((9, "3", 1000, 4, 3), (9, "99", 1000, 4, 2), (1, "3", 10, 4, 1), (1, "3", 10, 401, None)):
        ask = asks.limit(1).withColumn("family_id", F.lit(family)).withColumn("frame_size_code", F.lit(size)).withColumn("price", F.lit(price)).withColumn("n", F.lit(n).cast("bigint"))
        got = Q.relaxed_quality(ask, rows, items).collect()
        assert {r.rung for r in got} == ({rung} if rung else {0}) and len(got) == min(n, 400)


def test_lists_with_a_rare_brand_read_only_its_shelf(shop, pairs_tested):
    rows, items, asks = shop
    rows = rows.withColumn("brand", F.concat(F.lit("b"), F.col("id") % 40)).withColumn("category", F.when(F.col("id") % 2 == 0, "road").otherwise("gravel"))
    asks = asks.withColumn("brand", F.when(F.col("request_id") < 10, F.concat(F.lit("b"), 2 * F.col("request_id"))).otherwise("null"))
    got = Q.progressive_quality(asks, rows, items, Q.BUYER_TESTS, fraction=1.0).collect()
    chosen = {}
    for r in got:
        chosen.setdefault(r.request_id, set()).add(r.item_id)
    # of the first four of the brand, or of the category where none is named
    for n in range(20):
        first = [i for i in range(1, 401) if i % 2 == 0 and (n >= 10 or i % 40 == 2 * n)][:4]
        assert len(chosen[n]) == 2 and chosen[n] <= set(first)
    assert sum(pairs_tested) < 0.25 * 20 * 400


@pytest.mark.parametrize("tests", [Q.BUYER_TESTS[1:4], (Q.BUYER_TESTS[6], Q.BUYER_TESTS[1]), Q.BUYER_TESTS[:1], (Q.BUYER_TESTS[6],)])
def test_lists_under_other_tests_stop_where_fewer_than_twice_n_are_left(shop, tests):
    rows, items, asks = shop
    rows = rows.withColumn("brand", F.concat(F.lit("b"), F.col("id") % 4)).withColumn("rider_height_max", F.when(F.col("id") > 390, 200).otherwise(170))
    asks = asks.withColumn("brand", F.when(F.col("request_id") < 10, "b1").otherwise("null"))
    got = Q.progressive_quality(asks, rows, items, tests, fraction=1.0).collect()
    for n in range(20):
        held = list(range(1, 401))
        for t in tests:
            hit = {"brand": lambda i: n >= 10 or i % 4 == 1, "rider_height_max": lambda i: i > 390}.get(t.item, lambda i: True)
            if sum(map(hit, held)) < 4:
                break
            held = [i for i in held if hit(i)]
        mine = {r.item_id for r in got if r.request_id == n}
        assert len(mine) == 2 and mine <= set(held[:4])
