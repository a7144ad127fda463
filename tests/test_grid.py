"""Copies of rows in the grid stay few, and the kernels that use it lose nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallrec.operators import blocks as B
from stallrec.operators import factors as CF


@pytest.mark.parametrize("grid", [None, 3])
def test_a_row_is_copied_a_bounded_number_of_times(spark, monkeypatch, grid):
    monkeypatch.setattr(B, "CELL_QUERIES", 1)
    monkeypatch.setattr(B, "CELL_ITEMS", 1)
    monkeypatch.setattr(B, "GRID", 5)
    rows = spark.range(300)
    q, i = B.pack(rows, None, "id", 5, ["id"], "asked"), B.pack(rows, None, "id", 10, ["id"], "offered")
    met = (B.meet(q, i) if grid is None else B.meet(q, i, grid)).cache()
    cells = met.select("_row", "_column").distinct().count()
    assert cells == (grid or 5) ** 2
    pairs = [tuple(r) for r in met.select("_query_block", "_item_block").collect()]
    assert len(pairs) == len(set(pairs)) == q.count() * i.count()


def _world(spark, rng):
    u = rng.normal(size=(40, 6)) * rng.exponential(size=(40, 1)) ** 2
    v = np.round(rng.normal(size=(300, 6)) * rng.exponential(size=(300, 1)) ** 2, 1)
    u[3], v[7] = 0, 0
    v[200:210] = v[0]
    users = spark.createDataFrame([(str(n), x.tolist()) for n, x in enumerate(u)], "user string, vector array<double>")
    factors = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(v)], "item_id bigint, vector array<double>")
    return users, factors, np.round(u @ v.T, 6) + 0.0


def test_best_items_over_many_blocks(spark, small_blocks, monkeypatch):
    monkeypatch.setattr(CF, "USER_BLOCK", 16)
    monkeypatch.setattr(CF, "SLICE", 4)
    monkeypatch.setattr(CF, "GRID", 2)
    users, factors, s = _world(spark, np.random.default_rng(5))
    items = factors.select(
        F.col("item_id").alias("id"), F.lit(1).cast("bigint").alias("continent_id"), F.lit(0.0).alias("motor"),
        F.col("item_id").cast("double").alias("price"), F.lit(50.0).alias("frame_size_code"), F.lit(2).cast("bigint").alias("bike_category_id"),
    )
    # every third may pay little, one of them less than any price
    top = [None if n % 3 else [(float(90 if n else -1), 0, -1.0)] for n in range(40)]
    asks = spark.createDataFrame(
        [(n, str(n), 1, 1 + n % 7, top[n]) for n in range(40)],
        "request_id bigint, actor string, continent_id int, n int, prefs array<struct<max_price:double,category_id:bigint,size:double>>",
    )
    from stallrec.operators import masks as M

    asks = asks.withColumn("prefs", F.transform("prefs", lambda p: F.struct(p["max_price"], p["category_id"], F.lit(float(M.ANY_SIZE)).alias("size"))))
    got = {}
    for r in CF.best_for_users(asks, users, factors, items, items, "n").collect():
        got.setdefault(r.request_id, []).append((r.place, r.item_id, r.score))
    for n in range(40):
        may = range(300) if top[n] is None else range(91) if n else ()
        want = sorted((-s[n, i], i) for i in may)[: 1 + n % 7]
        assert [(i, x) for _, i, x in sorted(got.get(n, []))] == [(i, -x) for x, i in want]


def test_ranks_of_few_and_many_wanted_items(spark, small_blocks, monkeypatch):
    monkeypatch.setattr(CF, "GRID", 2)
    users, factors, s = _world(spark, np.random.default_rng(6))
    wanted = [(str(n), i) for n in range(40) for i in range(0, 300, 5 if n % 2 else 97)]
    got = CF.positive_ranks(spark.createDataFrame(wanted, "user string, item_id bigint"), users, factors).collect()
    want = {
        (str(n), i): ((s[n] > s[n, i]).sum(), (s[n] == s[n, i]).sum(), (s[n, :i] == s[n, i]).sum())
        for n, i in ((int(u), i) for u, i in wanted)
    }
    assert {(r.user, r.item_id): (r.above, r.equal, r.equal_before) for r in got} == want


def test_rank_blocks_leave_a_task_as_one_row_per_wanted_item():
    import pyarrow as pa

    def batch(ids):
        user = [{"user": "a", "vector": [1.0], "wanted": [{"item_id": 1, "score": 2.0}, {"item_id": 9, "score": 5.0}]}]
        items = [{"item_id": n, "vector": [float(n)]} for n in ids]
        return pa.RecordBatch.from_pydict({"_run": ["0"], "users": [user], "items": [items]})

    run = B.carried_mapper("_run", CF._RankKernel(), CF._RankKernel().schema)
    out = [r for b in run(iter([batch(range(4)), batch(range(4, 8))])) for r in b.to_pylist()]
    assert [(r["item_id"], r["above"], r["equal"]) for r in out] == [(1, 5, 1), (9, 2, 1)]


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_vectors_meet_in_a_bounded_grid(spark, small_blocks, monkeypatch, metric):
    """With repeated ids, twins and a zero vector the grid gives what the plain search gives."""
    from stallrec.operators import nearest as N
    from stallrec.operators import similarity as S

    monkeypatch.setattr(N, "GRID", 3)
    monkeypatch.setattr(N, "LEAST", 1)
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(260, 4)), 1)
    v[5], v[100:112] = 0, v[99]
    rows = spark.createDataFrame([(n if n != 50 else 49, x.tolist()) for n, x in enumerate(v)], "id bigint, vector array<double>")
    rows, items = rows.cache(), rows.filter("id % 2 = 0 or id = 49").cache()
    wide, plain = [], N.B.dealt

    def counted(df, *keys):
        wide.append(df.count())
        return plain(df, *keys)

    monkeypatch.setattr(N.B, "dealt", counted)
    got = S.nearest_vectors(rows, items, metric, k=7)
    order = ["item_id", "distance", "neighbor_id", "rank", "position"]
    got = sorted(map(tuple, got.select(order).fillna(-1).collect()))
    # 33 blocks and more a side, each copied at most three times
    assert wide and max(wide) < 3 * 60
    monkeypatch.setattr(N, "FEW", 0)
    want = S.nearest_vectors(rows, items, metric, k=7).select(order).fillna(-1).collect()
    assert got == sorted(map(tuple, want))


def test_requests_meet_only_items_their_continent_may_show(spark):
    items = spark.createDataFrame(
        [(n, [1, 2, 7][n % 3], float(n % 2), 10.0, 50.0, 1) for n in range(60)],
        "id bigint, continent_id bigint, motor double, price double, frame_size_code double, bike_category_id bigint",
    )
    factors = items.select(F.col("id").alias("item_id"), F.array(F.lit(1.0)).alias("vector"))
    packed = CF._packed_factors(factors, items, items).select("_shelf", F.explode("items.item_id").alias("id")).collect()
    got = {}
    for r in packed:
        got.setdefault(r["_shelf"], []).append(r["id"])
    home = [n for n in range(0, 60, 3) if n % 2 == 0]
    assert {c: sorted(x) for c, x in got.items()} == {
        "1": list(range(0, 60, 3)), "2": list(range(1, 60, 3)), "4": home, "7": sorted([*home, *range(2, 60, 3)])
    }


def _top_batch(u, v, first, m=3):
    import pyarrow as pa

    prefs = pa.array([[None] * len(u)], pa.list_(pa.list_(pa.struct([("max_price", pa.float64()), ("category_id", pa.int64()), ("size", pa.float64())]))))
    n = len(u)
    users = pa.StructArray.from_arrays(
        [pa.array(range(n), pa.int64()), pa.array([1] * n, pa.int64()), prefs[0].values, pa.array([m] * n, pa.int64()), pa.array(u.tolist())],
        ["request_id", "continent_id", "prefs", "_m", "vector"],
    )
    items = [
        {"item_id": first + k, "vector": x.tolist(), "m_continent": 1, "m_motor": 0.0, "m_price": 1.0, "m_size": 50.0, "m_category": 1}
        for k, x in enumerate(v)
    ]
    listed = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), users)
    return pa.RecordBatch.from_arrays([listed, pa.array([items])], names=["users", "items"])


def test_full_lists_leave_short_and_tied_items_alone(monkeypatch):
    """Items too short to reach a list, and those that tie with its last one under a greater id, are not looked at."""
    from stallrec.operators import masks as M

    rng = np.random.default_rng(3)
    v = rng.normal(size=(2000, 5)) * np.where(np.arange(2000) < 100, 1, 1e-3)[:, None]
    u = rng.normal(size=(50, 5))
    u[:10] = rng.normal(size=(10, 5)) * 1e-9  # all scores round to zero: the least ids win
    seen, plain = [], M.Masks.matrix
    monkeypatch.setattr(M.Masks, "matrix", lambda self, *a: (seen.append(x := plain(self, *a)), x)[1])
    kernel, held, half = CF._TopKernel(), None, [np.arange(0, 2000, 2), np.arange(1, 2000, 2)]
    v = np.concatenate([v[at] for at in half])
    for n in range(2):
        held = kernel(_top_batch(u, v[1000 * n : 1000 * n + 1000], 1000 * n), 0, held)
    s = np.round(u @ v.T, 6) + 0.0
    got = {}
    for r, i, x in zip(held["request_id"], held["item_id"], held["score"]):
        got.setdefault(int(r), []).append((-float(x), int(i)))
    assert all(sorted(got[n]) == sorted((-s[n, i], i) for i in range(2000))[:3] for n in range(50))
    assert sum(x.size for x in seen) < 0.75 * s.size


def test_only_scores_around_a_wanted_one_are_rounded(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    u, v = rng.normal(size=(12, 8)), rng.normal(size=(3000, 8))
    v[1000:1010] = v[0]
    v[2000:2010] = v[1] + 2e-7
    s = np.round(u @ v.T, 6) + 0.0
    wanted = [[0, 1, 1003, *range(5, 5 + 40 * (n % 2), 2)] for n in range(12)]
    users = [{"user": str(n), "vector": u[n].tolist(), "wanted": [{"item_id": i, "score": float(s[n, i])} for i in w]} for n, w in enumerate(wanted)]
    items = [{"item_id": n, "vector": x.tolist()} for n, x in enumerate(v)]
    done, plain = [], CF._rounded
    monkeypatch.setattr(CF, "_rounded", lambda x: (done.append(x.size), plain(x))[1])
    out = CF._RankKernel()(pa.RecordBatch.from_pydict({"users": [users], "items": [items]}), 0, None)
    want = [((s[n] > s[n, i]).sum(), (s[n] == s[n, i]).sum(), (s[n, :i] == s[n, i]).sum()) for n, w in enumerate(wanted) for i in w]
    assert list(zip(out["above"], out["equal"], out["equal_before"])) == want
    assert sum(done) < s.size / 20
