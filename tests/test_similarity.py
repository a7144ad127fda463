import numpy as np
import pytest
from pyspark.sql import functions as F

from stallrec.operators import similarity as S

SPEC = {"fam": 20.0, "kind": 20.0, "tint": 1.0}, {"price": 4.0, "year": 1.0}


def catalog(n=150, seed=0):
    """A third of all items are exact twins."""
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            rows.append((i, "active" if i % 2 else "sold", "f0", "k0", "t0", 100.0, 2000))
        else:
            rows.append((i, "active" if r.random() < 0.7 else "sold", f"f{r.integers(6)}", f"k{r.integers(3)}",
                         f"t{r.integers(4)}", float(r.integers(50, 500)), int(r.integers(2000, 2020))))
    return rows


def brute(rows, metric, k):
    lo = {j: min(x[j] for x in rows) for j in (5, 6)}
    hi = {j: max(x[j] for x in rows) for j in (5, 6)}
    hot = {c: sorted({x[c] for x in rows}) for c in (2, 3, 4)}
    vec = {}
    for x in rows:
        v = []
        for c, w in ((2, 20.0), (3, 20.0), (4, 1.0)):
            v += [w if x[c] == h else 0.0 for h in hot[c]]
        v += [4.0 * (x[5] - lo[5]) / (hi[5] - lo[5]), (x[6] - lo[6]) / (hi[6] - lo[6])]
        vec[x[0]] = np.array(v)
    out = {}
    for x in rows:
        near = []
        for y in rows:
            if y[1] != "active":
                continue
            a, b = vec[x[0]], vec[y[0]]
            d = {
                "euclidean": lambda: np.sqrt(((a - b) ** 2).sum()),
                "sqeuclidean": lambda: ((a - b) ** 2).sum(),
                "cityblock": lambda: np.abs(a - b).sum(),
                "cosine": lambda: 1 - a @ b / np.sqrt((a @ a) * (b @ b)),
            }[metric]()
            near.append((round(float(d), 6) + 0.0, y[0]))
        out[x[0]] = sorted(near)[:k]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, status string, fam string, kind string, tint string, price double, year bigint")


@pytest.mark.parametrize("metric,k,select", [("euclidean", 5, "partition"), ("euclidean", 60, "heap"), ("cityblock", 7, "partition"), ("cosine", 4, "partition"), ("sqeuclidean", 500, "partition")])
def test_blocks_match_brute_force(spark, small_blocks, metric, k, select):
    rows = catalog()
    df = frame(spark, rows)
    got = S.nearest_items(df, df.filter("status = 'active'"), S.Features(*SPEC, metric), k=k, select=select).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.item_id, r.rank)):
        by.setdefault(r.item_id, []).append((r.distance, r.neighbor_id))
    want = brute(rows, metric, k)
    assert {i: [n for _, n in v] for i, v in by.items()} == {i: [n for _, n in v] for i, v in want.items()}
    for i, v in want.items():
        assert np.allclose([d for d, _ in v], [d for d, _ in by[i]], atol=2e-6)


def test_positions_put_twins_last(spark, small_blocks):
    rows = [(1, "active", "a", "k", "t", 1.0, 1), (2, "active", "a", "k", "t", 1.0, 1), (3, "active", "a", "k", "t", 9.0, 2), (4, "sold", "b", "k", "t", 5.0, 3)]
    df = frame(spark, rows)
    near = S.nearest_items(df, df.filter("status = 'active'"), S.Features(*SPEC), k=10)
    asks = spark.createDataFrame([(10, 1), (11, 4), (12, 99)], "request_id bigint, bike_id bigint")
    got = sorted((r.request_id, r.position, r.item_id) for r in S.lookup(asks, near).collect())
    other = [(11, p, n) for p, (_, n) in enumerate(brute(rows, S.Features(*SPEC).metric, 10)[4], 1)]
    assert got == [(10, 1, 3), (10, 2, 2), *other] and len(other) == 3
    plain = sorted((r.position, r.item_id) for r in S.lookup(asks, near, zero_is_far=False).collect() if r.request_id == 10)
    assert plain == [(1, 2), (2, 3)]
    assert [(r.request_id, r.error) for r in S.unknown_items(asks, df).collect()] == [(12, "unknown item 99")]


@pytest.mark.parametrize("metric", S.METRICS)
def test_vectors(spark, small_blocks, metric):
    r = np.random.default_rng(1)
    v = r.normal(size=(90, 6))
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(90)], "id bigint, vector array<double>")
    got = S.nearest_vectors(df, df.filter("id % 2 = 0"), metric, k=4).collect()
    for i in (0, 7, 89):
        d = {
            "euclidean": np.linalg.norm(v - v[i], axis=1),
            "sqeuclidean": ((v - v[i]) ** 2).sum(1),
            "cityblock": np.abs(v - v[i]).sum(1),
            "cosine": 1 - v @ v[i] / (np.linalg.norm(v, axis=1) * np.linalg.norm(v[i])),
        }[metric]
        want = sorted((round(float(d[j]), 6) + 0.0, j) for j in range(0, 90, 2))[:4]
        mine = sorted((x.rank, x.neighbor_id) for x in got if x.item_id == i)
        assert [j for _, j in mine] == [j for _, j in want]


def test_layout_does_not_matter(spark, small_blocks):
    df = frame(spark, catalog(60))
    outs = []
    for n in (1, 2, 8):
        part = df.repartition(n)
        got = S.nearest_items(part, part.filter("status = 'active'"), S.Features(*SPEC), percentile=10)
        outs.append(sorted(tuple(r) for r in got.collect()))
    assert outs[0] == outs[1] == outs[2]
