import numpy as np
import pytest
from pyspark.sql import functions as F

from stallrec import config as C
from stallrec.operators import content as K
from stallrec.operators import matches as X
from stallrec.operators import nearest as N
from stallrec.operators import similarity as S
from stallrec.session import cut_lineage


def catalog(spark, n=240, seed=3):
    """Few values of the heavy categories, so that most rows have many items one mismatch away;
    every fourth item is a twin of the one before it."""
    r = np.random.default_rng(seed)
    rows, many = [], {"family_id": 5, "bike_component_id": 3, "bike_category_id": 4, "bike_type": 2, "brand": 3}
    for i in range(n):
        if i % 4 == 3:
            rows.append((i, "active", *rows[-1][2:]))
            continue
        values = [f"{c}{r.integers(many.get(c, 2))}" for c in C.CATEGORICAL_FEATURES]
        numbers = float(r.integers(100, 900)), float(r.integers(44, 60)), int(r.integers(2005, 2025))
        rows.append((i, "active" if r.random() < 0.7 else "sold", *values, *numbers))
    # an item apart from all others, which the joins leave to the tree
    rows.append((n, "active", *["alone"] * len(C.CATEGORICAL_FEATURES), 500.0, 50.0, 2010))
    items = spark.createDataFrame(rows, ["id", "status", *C.CATEGORICAL_FEATURES, *C.NUMERICAL_FEATURES])
    items = cut_lineage(items.repartition(2))
    return items, items.filter("status = 'active'")


def collected(df):
    return sorted(tuple(x) for x in df.select("item_id", "neighbor_id", "distance", "rank", "position").collect())


def by_tree(monkeypatch, make):
    with monkeypatch.context() as m:
        m.setattr(X, "choices", lambda *a, **b: None)
        return collected(make())


@pytest.fixture(autouse=True)
def joins(monkeypatch):
    monkeypatch.setattr(X, "FEW", 0)


@pytest.mark.parametrize("metric, select", [("euclidean", "partition"), ("cosine", "heap")])
def test_joins_find_what_the_tree_finds(spark, monkeypatch, metric, select):
    monkeypatch.setattr(X, "STRIDE", 3)
    monkeypatch.setattr(X, "PAIRS", 100)
    monkeypatch.setattr(X, "ROWS", 20)
    items, active = catalog(spark)

    def make():
        return S.nearest_items(items, active, S.item_features(metric), k=9, select=select)

    assert collected(make()) == by_tree(monkeypatch, make)


@pytest.mark.parametrize("match", ["any", "all"])
def test_alike_by_joins(spark, monkeypatch, match):
    items, active = catalog(spark)
    asked = items.filter("id % 3 > 0").select("id", (1 + F.col("id") % 11).alias("k"))

    def make():
        return S.nearest_alike(asked, items, active, C.PREFILTER_FEATURES, match == "all")

    assert collected(make()) == by_tree(monkeypatch, make)


def test_no_pairs_of_blocks_where_matches_decide(spark, monkeypatch):
    """The tree met blocks of all items, as it cannot tell the few near ones of another family."""
    items, active = catalog(spark)
    left = []
    monkeypatch.setattr(N, "nearest", lambda rows, *a: left.append(rows.count()) or rows.sparkSession.createDataFrame([], N.FOUND))
    S.nearest_items(items, active, k=9).count()
    assert sum(left) <= 5


def test_requests_bring_only_the_neighbors_they_can_use(spark):
    items, active = catalog(spark)
    requests = spark.createDataFrame([(1, 3, 2), (2, 3, 1), (3, 8, 1), (4, 240, 2), (5, 7, 0), (6, None, 2), (7, 999, 2)], "request_id long, bike_id long, n int")
    some = cut_lineage(K.request_neighbors(requests, items, active, overfetch=3))
    limits = {3: 7, 8: 4, 240: 7}
    first = lambda df: sorted((x.item_id, x.position, x.neighbor_id, x.distance) for x in df.collect() if x.position is not None and x.position <= limits.get(x.item_id, 0))
    tenth = cut_lineage(S.nearest_items(items, active))
    assert some.count() < 40 < tenth.count()
    assert first(some) == first(tenth)


def test_shares_count_each_item_once():
    chosen = X.Choices((), tuple("abcde"), 2)
    assert [chosen.shares(m) for m in (0, 1, 2)] == [[1], [-4, 1], [6, -3, 1]]


def test_no_joins_where_light_categories_can_outweigh():
    assert X.choices(S.Features({"a": 2.0, "b": 1.9}, {"x": 1.0})) is None
    assert X.choices(S.Features({"a": 20.0, "b": 1.0}, {"x": 30.0})) is None


def test_nothing_that_grows_is_broadcast(spark, tmp_path):
    """Values that repeat make small files of many rows; their joins must not go through the driver."""
    from stallrec.operators import content as K
    from stallrec.operators import masks as M

    items = spark.range(300).select(
        "id", F.lit(1).cast("bigint").alias("continent_id"), F.lit(0.0).alias("motor"), F.lit(9.0).alias("price"),
        F.lit(50.0).alias("frame_size_code"), F.lit(2).cast("bigint").alias("bike_category_id"),
    )
    items.write.parquet(f"{tmp_path}/items")
    items = spark.read.parquet(f"{tmp_path}/items")
    asks = items.select(F.col("id").alias("request_id"), F.col("id").alias("bike_id"), F.lit(3).alias("n"), "continent_id", F.lit(None).cast(M.PREFS_TYPE).alias("prefs"))
    asks.write.parquet(f"{tmp_path}/asks")
    asks = spark.read.parquet(f"{tmp_path}/asks")
    alike = items.select(F.col("id").alias("item_id"), (F.col("id") + 1).alias("neighbor_id"), F.lit(1).alias("position"), F.lit(1.0).alias("distance"))
    alike = alike.unionByName(alike.withColumn("position", F.lit(None).cast("int")))
    got = K.prefiltered_items(asks, alike, items)
    assert got.count() == 299
    plan = got._jdf.queryExecution().sparkPlan().toString()
    # the hot keys alone, which are few by definition
    assert plan.count("BroadcastHashJoin") <= 2 and plan.count("SortMergeJoin") >= 2
