"""Hard negatives beside plain scoring of all rows."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from stallrec.llm import hard_negatives as H
from stallrec.llm import registry

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, every=50):
    """Rows (vec_id, embedding, label); every score is made."""
    used = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        used.append((i, [math.floor(256 * float(x)) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for i, v, label in used:
        if i % every:
            continue
        scored = sorted(((sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in used), key=lambda s: (-s[0], s[1]))
        for p, j, _ in [s for s in scored if s[2] == label and s[1] != i][:5]:
            fit = [s for s in scored if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p]
            out += [(i, j, n + 1, k, p, s) for n, (s, k, _) in enumerate(fit[:3])]
    return sorted(out)


def mined(spark, rows, **sizes):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return sorted(tuple(r[c] for c in COLUMNS) for r in H.mine(frame, **sizes).collect())


def single(values):
    return [float(np.float32(x)) for x in values]


def clustered(n, seed, spread=0.3, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    at = rng.integers(0, 6, n)
    vectors = (centres[at] + spread * rng.normal(size=(n, dim))) * rng.choice([0.2, 1, 3], n)[:, None]
    return [(i, single(v), int(a) if i % 3 else int(rng.integers(0, 6))) for i, (v, a) in enumerate(zip(vectors, at))]


@pytest.mark.parametrize("block,anchors", [(4096, 4096), (16, 4)])
def test_against_plain_scores(spark, block, anchors):
    rows = clustered(700, 1)
    want = plain(rows, every=10)
    assert mined(spark, rows, every=10, block=block, anchors_in_block=anchors) == want and len(want) > 300


def test_a_third_of_rows_alike(spark):
    rng = random.Random(5)
    same = single([0.5, 0.25, -0.5, 0.1])
    rows = [(i, same if i % 3 == 0 else single(rng.gauss(0, 0.5) for _ in range(4)), rng.choice([1, 1, 2, 3])) for i in range(600)]
    assert mined(spark, rows, block=32, anchors_in_block=4) == plain(rows)


def test_odd_rows(spark):
    rows = clustered(300, 2, dim=4)
    rows += [
        (1000, None, 1),
        (1001, [0.1, None, 0.2, 0.3], 1),
        (1002, [0.1, float("nan"), 0.2, 0.3], 1),
        (1003, [0.1, float("inf"), 0.2, 0.3], 1),
        (1004, [0.5, 0.5, 0.5, 0.5], None),
        (None, [0.5, 0.5, 0.5, 0.5], 1),
        (1050, [], 1),
        (1100, [0.0, 0.0, 0.0, 0.0], 2),
        (1150, [0.7], 3),
        (-50, single([0.7, -0.1, 0.3, 0.4]), 3),
    ]
    want = plain(rows)
    assert mined(spark, rows, block=16) == want and {r[0] for r in want} >= {0, 50, 100}
    assert mined(spark, rows[:0]) == []
    assert mined(spark, [(50, [1.0], 1)]) == []


def test_repeated_rows_and_other_columns(spark):
    rows = clustered(120, 3)
    frame = spark.createDataFrame([(*r, "x", 1.0, 2) for r in rows + rows[:60]], "vec_id long, embedding array<float>, label int, score string, norm double, cell int")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in H.mine(frame).collect())
    assert set(got) <= {(a, p, k, n, ps, ns) for a, p, k, n, ps, ns in got} and {r[0] for r in got} <= {0, 50, 100}
    # an anchor that stands twice mines twice, and never takes itself
    assert all(a != p for a, p, *_ in got)
    by_anchor = {a: [r for r in got if r[0] == a] for a in (0, 50)}
    assert all(rows_of == sorted(rows_of) and len(rows_of) % 2 == 0 for rows_of in by_anchor.values())


def test_scores_beyond_53_bits(spark):
    rng = random.Random(8)
    rows = [(i, single(rng.gauss(0, 3e4) + 1 for _ in range(20)), rng.randrange(3)) for i in range(150)]
    assert mined(spark, rows) == plain(rows)


def side(vectors, directions):
    vectors = np.floor(256 * vectors)
    s = H.Side.__new__(H.Side)
    s.ids, s.vectors, s.norm = np.arange(len(vectors)), vectors, np.linalg.norm(vectors, axis=1)
    cosine = vectors @ directions.T / np.where(s.norm > 0, s.norm, 1)[:, None]
    s.angles = np.arccos(np.clip(cosine, -1, 1)).astype(np.float32).astype(float)
    return s


def test_bounds_hold_every_score_and_pass_over_rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 16))
    vectors = np.concatenate([c + 0.1 * rng.normal(size=(40, 16)) for c in centres] + [np.zeros((1, 16)), centres[:3], -centres[:3]])
    directions = centres / np.linalg.norm(centres, axis=1)[:, None]
    anchors, items = side(vectors[::9], directions), side(vectors, directions)
    scores = anchors.vectors @ items.vectors.T
    low, high = H.row_bounds(anchors, np.arange(len(anchors.ids)), items, slice(None))
    assert (low <= scores).all() and (scores <= high).all()
    least, greatest = H.block_bounds(anchors, items)
    assert (least <= scores.min(axis=1)).all() and (scores.max(axis=1) <= greatest).all()
    best = H.Best(np.full((len(anchors.ids), 1), H.LOWEST), np.full((len(anchors.ids), 1), H.HIGHEST), 5)
    made = sum(H.search(anchors, side(vectors[at : at + 40], directions), best, np.ones(len(anchors.ids), bool), False) for at in range(0, len(vectors), 40))
    assert made < 0.5 * scores.size
    assert sorted(best.score.tolist()) == sorted(np.sort(scores, axis=1)[:, -5:].astype(int).reshape(-1).tolist())


def test_integer_scores_agree():
    rng = np.random.default_rng(6)
    a, b = np.floor(rng.normal(size=(20, 5)) * 100), np.floor(rng.normal(size=(50, 7)) * 100)
    want = (np.pad(a, ((0, 0), (0, 2))) @ b.T).astype(np.int64)
    for share in (0.02, 0.9):
        r, c, s = H.integer_scores(a, b, rng.random((20, 50)) < share)
        assert (s == want[r, c]).all()
    r, c, s = H.integer_scores(a * 1e9, b * 1e9, np.ones((20, 50), bool))
    assert s.tolist() == [min(max(int(want[i, j]) * 10**18, H.LOWEST), H.HIGHEST) for i, j in zip(r, c)]


def test_query_against_sql(spark):
    path = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    want = con.sql(registry.ORACLES["op13_hard_negatives"]).select(", ".join(COLUMNS)).fetchall()
    got = registry.QUERIES["op13_hard_negatives"](spark, path)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == sorted(want) and want
    assert isinstance(H.matrix(pa.array([[1.0], [], [1.0, 2.0]])), np.ndarray)
