"""Salted joins, masks over many preferences, ranks with ties."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stallrec.operators import factors as CF
from stallrec.operators import masks as M
from stallrec.operators import similarity as S
from stallrec.operators import skew


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_gives_the_same_rows(spark, how):
    """A third of all rows hold one key; some hold none, some one that nothing answers."""
    rng = random.Random(1)
    rows = [(i, 7 if i % 3 == 0 else None if i % 10 == 1 else rng.randrange(40)) for i in range(900)]
    other = [(k, f"v{k}{j}") for k in range(30) for j in range(1 + k % 3)] + [(None, "none")]
    left = spark.createDataFrame(rows, "id bigint, k bigint")
    right = spark.createDataFrame(other, "k bigint, v string")
    got = skew.join(left, right, "k", "id", how, shares=16)
    want = left.join(right, "k", how)
    assert got.columns == want.columns
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    with pytest.raises(ValueError):
        skew.join(left, right, "k", "id", "full")


def test_no_salt_holds_many_rows(spark):
    rows = spark.range(30000).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")))
    hot = {r["k"]: r["_salts"] for r in skew.hot_keys(rows, "k", 64).collect()}
    assert hot == {5: 22}
    seen = rows.filter("k = 5").withColumn("s", F.pmod(F.xxhash64("id"), F.lit(22))).groupBy("s").count().collect()
    assert max(r["count"] for r in seen) < 1.3 * 30000 / 64


def test_a_popular_item_in_a_lookup(spark):
    """Requests for one item are dealt out: the fullest salt has less than twice the median."""
    near = spark.createDataFrame([(i, j, float(1 + (i * j) % 7), j) for i in range(30) for j in range(1, 5)], "item_id bigint, neighbor_id bigint, distance double, position int")
    asks = spark.range(6000).select(F.col("id").alias("request_id"), F.when(F.col("id") % 3 == 0, F.lit(3)).otherwise(F.col("id") % 30).alias("bike_id"))
    got = S.lookup(asks, near)
    assert got.count() == 24000
    hot = skew.hot_keys(asks, "bike_id", 64)
    keyed = asks.join(hot, "bike_id", "left").withColumn("s", F.pmod(F.xxhash64("request_id"), F.coalesce("_salts", F.lit(1))))
    sizes = sorted(r["count"] for r in keyed.groupBy("bike_id", "s").count().collect())
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_mask_matrix_against_plain_tests(monkeypatch):
    monkeypatch.setattr(M, "TILE", 7)
    rng = random.Random(2)
    kind = pa.list_(pa.struct([("max_price", pa.float64()), ("category_id", pa.int64()), ("size", pa.float64())]))
    prefs = [
        None if n % 4 == 0 else [] if n % 4 == 1 else [
            {"max_price": float(rng.choice([100, 500, 900])), "category_id": rng.choice([0, 1, 2]), "size": rng.choice([1.0, 50.0, 56.0])}
            for _ in range(rng.randint(1, 5))
        ]
        for n in range(40)
    ]
    req = {"continent_id": pa.array([rng.choice([1, 4, 7, 2]) for _ in prefs]), "prefs": pa.array(prefs, kind)}
    item = {
        "m_continent": [rng.choice([1, 4, 2]) for _ in range(30)],
        "m_motor": [float(rng.randint(0, 1)) for _ in range(30)],
        "m_price": [float(rng.randint(50, 1000)) for _ in range(30)],
        "m_size": [float(rng.randint(45, 60)) for _ in range(30)],
        "m_category": [rng.randint(0, 3) for _ in range(30)],
    }
    got = M.mask_matrix(req, {c: pa.array(v) for c, v in item.items()})
    for r, p in enumerate(prefs):
        wanted = req["continent_id"][r].as_py()
        for i in range(30):
            c, motor, price, size, cat = (item[k][i] for k in ("m_continent", "m_motor", "m_price", "m_size", "m_category"))
            seen = c == wanted or (wanted in (4, 7) and c == 1 and motor == 0)
            fits = p is None or any(
                price <= e["max_price"] and e["category_id"] in (0, cat) and (e["size"] == 1.0 or abs(size - e["size"]) <= 3) for e in p
            )
            assert got[r, i] == (seen and fits)


def test_ranks_with_ties_and_many_positives(spark, small_blocks, monkeypatch):
    monkeypatch.setattr(CF, "LOT", 5)
    monkeypatch.setattr(CF, "POSITIVES", 3)
    rng = np.random.default_rng(3)
    users, items = rng.integers(-1, 2, (6, 3)).astype(float), rng.integers(-1, 2, (50, 3)).astype(float)
    u = spark.createDataFrame([(f"u{n}", x.tolist()) for n, x in enumerate(users)], "user string, vector array<double>")
    f = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(items)], "item_id bigint, vector array<double>")
    wanted = [(f"u{n}", int(i)) for n in range(6) for i in rng.choice(50, 1 + 6 * n, replace=False)]
    got = CF.positive_ranks(spark.createDataFrame(wanted, "user string, item_id bigint"), u, f).collect()
    assert len(got) == len(wanted)
    for r in got:
        s = np.round(items @ users[int(r.user[1:])], 6)
        own = s[r.item_id]
        assert (r.above, r.equal, r.equal_before) == ((s > own).sum(), (s == own).sum(), (s[: r.item_id] == own).sum())


def test_scores_with_only_requests_for_nothing(spark, small_blocks):
    u = spark.createDataFrame([("a", [1.0])], "user string, vector array<double>")
    f = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "item_id bigint, vector array<double>")
    items = spark.createDataFrame([(n, 1, 0.0, 5.0, 50.0, 1) for n in (1, 2)], "id bigint, continent_id bigint, motor double, price double, frame_size_code double, bike_category_id bigint")
    asks = spark.createDataFrame([(1, "a", 1, None, 0), (2, "a", 1, None, -4)], f"request_id bigint, actor string, continent_id bigint, prefs {M.PREFS_TYPE}, n int")
    for widen in (1, 10):
        assert CF.collaborative(asks, u, f, items, items, widen).count() == 0
        some = asks.withColumn("n", F.col("request_id").cast("int"))
        assert CF.collaborative(some, u, f, items, items, widen).count() == 3
