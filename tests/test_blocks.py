"""The grid in which blocks meet."""

from pyspark.sql import functions as F

from stallrec.operators import blocks as B
from stallrec.operators import masks as M


def test_cells_are_bounded_and_many(spark):
    rows = spark.range(2000).withColumn("shelf", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)))
    for shelf in (None, "shelf"):
        q = B.pack(rows, shelf, "id", 40, ["id"], "asked")
        i = B.pack(rows, shelf, "id", 30, ["id"], "offered")
        met = B.meet(q, i)
        keys = met.groupBy("_shelf", "_row", "_column").agg(
            F.count_distinct("_query_block").alias("q"), F.count_distinct("_item_block").alias("i")
        )
        got = keys.agg(F.count("*"), F.max("q"), F.max("i")).first()
        assert got[0] > 16 and got[1] <= B.CELL_QUERIES and got[2] <= B.CELL_ITEMS
        assert "CartesianProduct" not in met._jdf.queryExecution().toString()
        want = {(a["_shelf"], a["_bucket"], b["_bucket"]) for a in q.collect() for b in i.collect() if a["_shelf"] == b["_shelf"]}
        pairs = [(r["_shelf"], r["_query_block"], r["_item_block"]) for r in met.collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_anonymous_requests_have_no_mask(spark):
    items = spark.createDataFrame([(1, 1, 0.0, 100.0, 54.0, 7)], "id bigint, continent_id bigint, motor double, price double, frame_size_code double, bike_category_id bigint")
    stated = spark.createDataFrame([(0, 200, 7, "none"), (5, 200, 7, "none")], "user_id bigint, max_price bigint, category_id bigint, frame_size string")
    asks = spark.createDataFrame([(n, 5 if n == 0 else None if n == 1 else 0, "homepage") for n in range(30)], "request_id bigint, user_id bigint, strategy string")
    got = {r.request_id: r.prefs for r in M.attach_masks(asks, stated, items).collect()}
    assert len(got) == 30 and got[0] is not None and all(got[n] is None for n in range(1, 30))
