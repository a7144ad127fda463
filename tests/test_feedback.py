import datetime as dt

from pyspark.sql import functions as F

from stallrec.operators import catalog as G
from stallrec.operators import export as E
from stallrec.operators import feedback as FB
from stallrec.operators import preferences as P

AS_OF = dt.date(2024, 1, 31)
NOW = dt.datetime(2024, 1, 20)


def events(spark, rows):
    return spark.createDataFrame(
        rows, "event_type string, anonymous_id string, user_id string, item_id bigint, ts timestamp"
    )


def test_feedback_of_exactly_one_is_dropped(spark):
    rows = [("product_viewed", "a", None, 1, NOW), ("product_added", "a", None, 2, NOW)]
    got = FB.actor_item_feedback(events(spark, rows), AS_OF).collect()
    assert [(r.item_id, float(r.feedback)) for r in got] == [(2, 2.0)]


def test_actor_limits(spark):
    df = spark.sql(
        """SELECT a AS anonymous_id, i AS item_id, 2.0 AS feedback FROM VALUES ('two', 2), ('three', 3), ('most', 4000),
           ('over', 4001) AS t(a, n) LATERAL VIEW explode(sequence(1, n)) AS i"""
    )
    got = {r[0]: r[1] for r in FB.active_actors(df).groupBy("anonymous_id").count().collect()}
    assert got == {"three": 3, "most": 4000}


def test_actor_of_two_users_counts_for_both(spark):
    rows = [("product_added", "a", None, i, NOW) for i in (1, 2, 3)] + [("product_added", "a", "u", 1, NOW)]
    listings = spark.createDataFrame(
        [(i, 450.0, 1, 1, 1) for i in (1, 2, 3)],
        "id bigint, price double, bike_type_id bigint, bike_category_id bigint, family_id bigint",
    )
    infos = spark.createDataFrame(
        [(i, 157.0, 189.0) for i in (1, 2, 3)], "bike_id bigint, rider_height_min double, rider_height_max double"
    )
    got = FB.interactions(events(spark, rows), {"listings": listings, "infos": infos}, AS_OF).collect()
    by = {(r.user_id, r.bike_id): r for r in got}
    assert set(by) == {(u, i) for u in ("a", "u") for i in (1, 2, 3)}
    assert float(by["a", 1].feedback) == float(by["u", 1].feedback) == 4.0
    assert (by["u", 1].price, by["u", 1].rider_height_min, by["u", 1].rider_height_max) == (400.0, 150.0, 180.0)


def test_id_lists_and_spellings(spark):
    one = spark.createDataFrame([("order_completed", "a", None, 5, NOW)], "event_type string, anonymous_id string, user_id string, booking_bike_id bigint, ts timestamp")
    many = spark.createDataFrame([("show_recommendation", "a", None, "1, 2,x,", NOW)], "event_type string, anonymous_id string, user_id string, ids string, ts timestamp")
    got = FB.union_feeds([{"events": one, "item": "booking_bike_id"}, {"events": many, "id_list": "ids"}])
    assert sorted(r.item_id for r in got.collect()) == [1, 2, 5]


def test_keep_last_and_median(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 4), (2, 1, None), (3, 1, 1), (4, 1, 2)], "id int, o int, motor int")
    kept = G.keep_last(df, ["id"], ["o"])
    got = {r.id: r.motor for r in G.fill_with_median(kept, "motor").collect()}
    assert got == {1: 4.0, 2: 2.0, 3: 1.0, 4: 2.0}


def test_eligibility_precedence(spark):
    now = dt.datetime(2024, 1, 31)
    rows = [
        ("active", dt.datetime(2000, 1, 1), 79204, 0, True),
        ("sold", now, 1, 31, True),
        ("sold", now, 1, 30, False),
        ("sold", now, 79204, 31, False),
        ("sold", dt.datetime(2024, 1, 10), 1, 31, False),
        ("deleted", now, 1, 99, False),
    ]
    df = spark.createDataFrame(rows, "s string, u timestamp, t bigint, q bigint, want boolean")
    got = df.withColumn("got", G.eligible(F.col("s"), F.col("u"), F.col("t"), F.col("q"), now)).collect()
    assert all(r.got == r.want for r in got)


def test_rank_with_one_score_for_all(spark):
    df = spark.range(5000).select((F.col("id") * 3).alias("id"), F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(50).alias("s"))
    got = [(r.id, r.rank) for r in G.with_rank(df, "s", "id", "rank").collect()]
    want = sorted(df.collect(), key=lambda r: (-r.s, r.id))
    assert [i for i, _ in sorted(got, key=lambda x: x[1])] == [r.id for r in want]
    assert sorted(k for _, k in got) == list(range(1, 5001))


def test_preferences_of_empty_json(spark):
    df = spark.createDataFrame([(1, "{}"), (2, '{"max_price":500,"categories":["ROAD","x"],"frame_sizes":["M"]}')], "user_id bigint, preferences string")
    cats = spark.createDataFrame([(7, "Road")], "id bigint, name string")
    got = sorted(tuple(r) for r in P.user_preferences(df, cats).collect())
    assert got == [(1, 20000, 0, "none"), (2, 500, 0, "M"), (2, 500, 7, "M")]


def test_two_modes_take_the_least(spark):
    df = spark.createDataFrame([("u", 1, 1.0, "b"), ("u", 1, 2.0, "a")], "u string, i int, feedback double, f string")
    r = E.summed(df, "u", "i", ["f"]).first()
    assert (float(r.feedback), r.f) == (3.0, "a")


def test_heavy_users_are_cut(spark):
    df = spark.range(30).select(F.when(F.col("id") < 20, "heavy").otherwise("light").alias("u"))
    assert {r[0] for r in E.within_limit(df, "u", 10).collect()} == {"light"}
