"""The tree of block summaries: exact rows, few pairs of blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallrec.operators import nearest as N
from stallrec.operators import similarity as S
from tests.test_similarity import SPEC, brute, catalog, frame


def pairs_read(rows, items, space, k):
    """(pairs of blocks that are read, all pairs)."""
    left, right = N.blocks(rows, space, N.ROWS, "rows"), N.blocks(items, space, N.ITEMS, "items")
    high = N.height(left, right)
    near = N.near_pairs(N.levels(left, space, high), N.levels(right, space, high), space, k)
    return near.count(), left.count() * right.count()


def features(spark, rows, spec):
    return S.feature_frame(frame(spark, rows), spec).withColumnRenamed("id", "_id")


def test_pairs_grow_below_quadratically(spark, small_blocks):
    spec = S.Features(*SPEC)
    read = {}
    for n in (200, 400, 800):
        r = np.random.default_rng(n)
        rows = [(i, "active", f"f{r.integers(6)}", f"k{r.integers(2)}", "t0", float(r.integers(50, 500)), int(r.integers(2000, 2020))) for i in range(n)]
        feats = features(spark, rows, spec)
        read[n], every = pairs_read(feats, feats, S.feature_space(spec), 5)
        assert read[n] < 0.6 * every
    assert read[800] < 3 * read[400] and read[800] < 8 * read[200]


def test_a_third_of_equal_rows_meets_few_blocks(spark, small_blocks):
    spec = S.Features(*SPEC)
    read = {}
    for n in (300, 1200):
        rows = [(i, "active", "f0", "k0", "t0", 100.0, 2000) for i in range(n)]
        feats = features(spark, rows, spec)
        read[n], every = pairs_read(feats, feats, S.feature_space(spec), 5)
        assert read[n] <= every
    # every block meets the blocks of the least ids alone
    assert read[1200] <= 5 * read[300]


@pytest.mark.parametrize("n", [1, 9, 200])
def test_blocks_are_numbered_without_gaps(spark, small_blocks, n):
    spec = S.Features(*SPEC)
    feats = features(spark, catalog(n), spec)
    made = N.blocks(feats, S.feature_space(spec), 8, "rows")
    got = sorted((r["_node"], r["_n"], len(r["rows"])) for r in made.select("_node", "_n", "rows").collect())
    assert [g[0] for g in got] == list(range(len(got))) and sum(g[1] for g in got) == n
    assert all(a == b <= 8 for _, a, b in got)


@pytest.mark.parametrize("metric", ["cosine", "cityblock"])
def test_bounds_of_every_metric_hold(spark, small_blocks, metric):
    """No pair that is dropped holds one of the nearest: k from one to all."""
    rows = catalog(120, 3)
    df = frame(spark, rows)
    for k in (2, 40):
        got = S.nearest_items(df, df, S.Features(*SPEC, metric), k=k)
        by = {}
        for r in got.collect():
            by.setdefault(r.item_id, set()).add(r.neighbor_id)
        want = brute([(*x[:1], "active", *x[2:]) for x in rows], metric, k)
        assert by == {i: {n for _, n in v} for i, v in want.items()}


def alike(rows, own, every, k):
    far = [(float("inf") if d == 0 else d, j) for d, j in own]
    by = {x[0]: x for x in rows}

    def fits(i, j):
        same = [by[i][c] == by[j][c] for c in (2, 4)]
        return all(same) if every else any(same)

    return lambda i: sorted((d, j) for d, j in far if fits(i, j))[:k]


@pytest.mark.parametrize("every", [False, True])
def test_alike_items_at_any_k(spark, small_blocks, every):
    rows = catalog(160, 5)
    df = frame(spark, rows)
    asks = {0: 3, 1: 5, 7: 200, 30: 1, 60: 90, 159: 12}
    asked = spark.createDataFrame([*asks.items(), (999, 4)], "id bigint, k int")
    got = S.nearest_alike(asked, df, df.filter("status = 'active'"), ("fam", "tint"), every, S.Features(*SPEC)).collect()
    full = brute(rows, "euclidean", 10**6)
    assert {r.item_id for r in got} <= set(asks)
    for i, k in asks.items():
        want = alike(rows, full[i], every, k)(i)
        mine = sorted((r.rank, r.neighbor_id, r.distance, r.position) for r in got if r.item_id == i)
        assert [m[1] for m in mine] == [j for _, j in want]
        assert np.allclose([m[2] for m in mine], [d for d, _ in want], atol=2e-6)
        # positions count the others alone
        others = [m for m in mine if m[1] != i]
        assert [m[3] for m in others] == list(range(1, len(others) + 1)) and all(m[3] is None for m in mine if m[1] == i)


def clustered(n, dim=12, seed=0, scale=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim))
    return scale * (centres[r.integers(0, 12, n)] + 0.05 * r.normal(size=(n, dim)))


def vector_frame(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, vector array<double>")


@pytest.mark.parametrize("metric", S.METRICS)
def test_vectors_read_few_pairs(spark, small_blocks, metric):
    v = clustered(300)
    df = vector_frame(spark, v).withColumnRenamed("id", "_id")
    vectors = N.Vectors(metric).with_pivots(df, N.pivots(300))
    placed = vectors.placed(df)
    read, every = pairs_read(placed, placed, vectors.space(), 4)
    assert read < 0.4 * every
    got = S.nearest_vectors(vector_frame(spark, v), vector_frame(spark, v), metric, k=4).collect()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for i in (0, 150, 299):
        d = {
            "euclidean": lambda: np.linalg.norm(v - v[i], axis=1),
            "sqeuclidean": lambda: ((v - v[i]) ** 2).sum(1),
            "cityblock": lambda: np.abs(v - v[i]).sum(1),
            "cosine": lambda: 1 - unit @ unit[i],
        }[metric]()
        want = sorted((round(float(x), 6) + 0.0, j) for j, x in enumerate(d))[:4]
        assert [r.neighbor_id for r in sorted((x for x in got if x.item_id == i), key=lambda x: x.rank)] == [j for _, j in want]


def test_large_norms_keep_their_digits(spark, small_blocks):
    v = np.round(clustered(120, dim=3, scale=100.0) + 1e6, 3)
    got = S.nearest_vectors(vector_frame(spark, v), vector_frame(spark, v), k=3).collect()
    for i in range(0, 120, 17):
        d = np.sqrt(((v - v[i]) ** 2).sum(1))
        want = sorted((round(float(x), 6), j) for j, x in enumerate(d))[:3]
        mine = sorted((r.rank, r.neighbor_id, r.distance) for r in got if r.item_id == i)
        assert [m[1] for m in mine] == [j for _, j in want] and np.allclose([m[2] for m in mine], [x for x, _ in want], atol=1e-6)


def test_zero_vectors_under_cosine(spark, small_blocks):
    v = np.vstack([np.zeros((2, 3)), np.eye(3), -np.eye(3)])
    got = S.nearest_vectors(vector_frame(spark, v), vector_frame(spark, v), "cosine", k=8).collect()
    by = {(r.item_id, r.neighbor_id): r.distance for r in got}
    assert by[0, 1] == by[0, 0] == 0 and {by[0, j] for j in range(2, 8)} == {1.0} and by[2, 5] == 2.0 and len(by) == 64


def test_last_digits_do_not_depend_on_the_layout(spark, small_blocks):
    v = clustered(90, dim=7, scale=3.0)
    df = vector_frame(spark, v)
    outs = [sorted(tuple(r) for r in S.nearest_vectors(df.repartition(n), df.repartition(n), k=5).collect()) for n in (1, 3)]
    assert outs[0] == outs[1]


def test_empty_sides(spark, small_blocks):
    df = frame(spark, catalog(20))
    none = df.filter(F.lit(False))
    assert S.nearest_items(df, none, S.Features(*SPEC), k=3).count() == 0
    asked = spark.createDataFrame([], "id bigint, k int")
    assert S.nearest_alike(asked, df, df, ("fam",), False, S.Features(*SPEC)).count() == 0
    v = vector_frame(spark, clustered(10))
    assert S.nearest_vectors(v, v.filter(F.lit(False)), k=2).count() == 0


def test_city_block_distances_are_counted_in_steps_within_their_error():
    rng = np.random.default_rng(8)
    for x, y in (
        (rng.normal(size=(300, 64)), rng.normal(size=(90, 64)) * 3 + 1),
        (np.zeros((5, 3)), np.zeros((4, 3))),
        (rng.normal(size=(7, 5000)), rng.normal(size=(6, 5000))),
        (np.round(rng.normal(size=(20, 2)) * 1e6), np.round(rng.normal(size=(20, 2)) * 1e6)),
    ):
        want = np.abs(x[:, None, :] - y[None, :, :]).sum(axis=2)
        got, error = N.stepped(x, y)
        assert np.abs(got - want).max() <= error <= 0.05 * max(want.max(), 1e-9)
    x, y = rng.normal(size=(50, 16)), rng.normal(size=(4000, 16))
    vectors = N.Vectors("cityblock")
    best = N.Running(np.full(50, 9), False)
    for at in range(0, 4000, 1000):
        best.add(x, y[at : at + 1000], np.arange(at, at + 1000), N.Kernel(vectors.prepare, vectors.distance, vectors.exact))
    best.trim()
    d = np.round(np.abs(x[:, None, :] - y[None, :, :]).sum(axis=2), 6)
    assert best.held[0][2].reshape(50, 9).tolist() == [np.lexsort((np.arange(4000), line))[:9].tolist() for line in d]
