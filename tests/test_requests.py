import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallrec.operators import content as K
from stallrec.operators import factors as CF
from stallrec.operators import lists as L
from stallrec.operators import masks as M
from stallrec.operators import quality as Q
from stallrec.plans import batch as BT

ITEM = "id bigint, continent_id bigint, motor double, price double, frame_size_code double, bike_category_id bigint, family_id bigint, bike_type bigint, brand string, status string"


def make_items(n=200, seed=0):
    """A third of the items share type, family, category and price."""
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        rows.append((i, int(r.choice([1, 4, 7])), float(r.integers(0, 2)), 1000.0 if hot else float(r.integers(200, 3000)),
                     float(r.choice([50, 54, 56, 58.5])), 5 if hot else int(r.integers(5, 8)), 11 if hot else int(r.integers(11, 20)),
                     1 if hot else int(r.integers(1, 4)), f"b{r.integers(4)}", "active"))
    return rows


@pytest.fixture(scope="module")
def world(spark):
    rows = make_items()
    items = spark.createDataFrame(rows, ITEM)
    r = np.random.default_rng(5)
    ranks = r.permutation(len(rows)) + 1
    extra = [(i, int(ranks[i]), f"s{i}", "road" if i % 3 == 0 else "gravel", 150 + int(i % 4) * 10, 190 - int(i % 5) * 5, int(i % 2), int(i % 7 == 0)) for i in range(len(rows))]
    more = spark.createDataFrame(extra, "id bigint, quality_rank bigint, slug string, category string, rider_height_min bigint, rider_height_max bigint, is_ebike bigint, is_frameset bigint")
    quality = items.join(more, "id")
    return rows, items, quality, {x[0]: (x, e) for x, e in zip(rows, extra)}


REQ = ("request_id bigint, user_id bigint, continent_id bigint, strategy string, bike_id bigint, n bigint, bike_type bigint, family_id bigint, "
       "price bigint, frame_size_code double, rider_height bigint, category string, is_ebike bigint, is_frameset bigint, brand string")


def make_requests(spark, items, prefs=()):
    rows = []
    for i in range(60):
        rows.append((i, i % 5, [1, 4, 7, 2][i % 4], "product_page" if i % 2 else "bot", i, 4 + i % 9, 1 + i % 3, 11 + i % 6, 600 + 40 * i,
                     [50.0, 54.0, 56.0][i % 3], 165 + i % 20, "road" if i % 2 else "gravel", i % 2, 0, "null" if i % 3 else "b1"))
    stated = spark.createDataFrame(list(prefs) or [(1, 900, 0, "none"), (1, 2500, 6, "54"), (2, 10, 0, "none"), (3, 5000, 6, "none")],
                                   "user_id bigint, max_price bigint, category_id bigint, frame_size string")
    return M.attach_masks(spark.createDataFrame(rows, REQ), stated, items)


def visible(x, c):
    return x[1] == c or (c in (4, 7) and x[1] == 1 and x[2] == 0)


def user_ok(x, user, page):
    p = {1: [(900, 0, None), (2500, 6, 54.0)], 3: [(5000, 6, None)]}.get(user)
    if p is None:
        return True
    return any(x[3] <= m and (page or g == 0 or x[5] == g) and (s is None or s - 3 <= x[4] <= s + 3) for m, g, s in p)


def ok(r, x):
    return visible(x, r.continent_id) and user_ok(x, r.user_id, r.strategy == "product_page")


def listed(df, value="item_id"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.request_id, r.position)):
        out.setdefault(r.request_id, []).append(r[value])
    return out


def test_relaxed_matches_brute_force(spark, small_blocks, world):
    rows, items, quality, known = world
    req = make_requests(spark, items).cache()
    got = listed(Q.relaxed_quality(req, quality, items))
    ranked = sorted(known.values(), key=lambda v: v[1][1])
    for r in req.collect():
        tests = [lambda x: x[7] == r.bike_type, lambda x: 0.8 * r.price <= x[3] <= 1.2 * r.price,
                 lambda x: x[4] == r.frame_size_code, lambda x: x[6] == r.family_id]
        want = [x[0] for x, _ in ranked][: r.n]
        for depth in (4, 3, 2, 1):
            hit = [x[0] for x, _ in ranked if ok(r, x) and all(t(x) for t in tests[:depth])]
            if len(hit) >= r.n:
                want = hit[: r.n]
                break
        assert got[r.request_id] == want
    strict = listed(Q.relaxed_quality(req, quality, items, strict_mask=True))
    for r in req.collect():
        assert all(ok(r, known[i][0]) for i in strict.get(r.request_id, []))


def test_relaxed_below_one_has_no_rows(spark, small_blocks, world):
    rows, items, quality, known = world
    req = make_requests(spark, items)
    none = req.withColumn("n", F.when(F.col("request_id") % 2 == 0, F.lit(0)).otherwise(F.lit(-3)).cast(req.schema["n"].dataType))
    assert Q.relaxed_quality(none, quality, items).count() == 0


@pytest.mark.parametrize("order", ["quality", "random"])
def test_progressive_matches_brute_force(spark, small_blocks, world, order):
    rows, items, quality, known = world
    req = make_requests(spark, items).cache()
    picks = Q.progressive_quality(req, quality, items, Q.BUYER_TESTS, order=order)
    got = listed(picks)
    errors = {r.request_id for r in Q.short_requests(req, picks).collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    key = (lambda v: v[1][1]) if order == "quality" else (lambda v: int(md5(f"{v[0][0]}|1")[:15], 16))
    ranked = sorted(known.values(), key=key)
    for r in req.collect():
        tests = [lambda x, e: e[3] == r.category, lambda x, e: e[5] >= r.rider_height, lambda x, e: e[4] <= r.rider_height,
                 lambda x, e: 0.8 * r.price <= x[3] <= 1.2 * r.price, lambda x, e: e[6] == r.is_ebike,
                 lambda x, e: e[7] == r.is_frameset, lambda x, e: r.brand == "null" or x[8] == r.brand]
        masked = [v for v in ranked if ok(r, v[0])]
        pool = [v for v in masked if int(md5(f"{v[0][0]}|0")[:8], 16) < 2**31] if len(masked) >= r.n else ranked
        for t in tests:
            nxt = [v for v in pool if t(*v)]
            if len(nxt) < 2 * r.n:
                break
            pool = nxt
        top = sorted((v[0][0] for v in pool[: 2 * r.n]), key=lambda i: md5(f"{r.request_id}|{i}|0"))
        want = top[: r.n] if len(top) >= r.n else []
        assert got.get(r.request_id, []) == want
        assert (r.request_id in errors) == (not want)


def test_progressive_below_one_has_no_rows(spark, small_blocks, world):
    rows, items, quality, known = world
    req = make_requests(spark, items)
    some = req.withColumn("n", F.when(F.col("request_id") % 3 == 0, F.col("n")).otherwise(F.lit(-1)).cast("bigint"))
    got = listed(Q.progressive_quality(some, quality, items, Q.BUYER_TESTS))
    full = listed(Q.progressive_quality(req, quality, items, Q.BUYER_TESTS))
    assert got == {i: v for i, v in full.items() if i % 3 == 0}
    assert Q.progressive_quality(req.withColumn("n", F.lit(0).cast("bigint")), quality, items, Q.BUYER_TESTS).count() == 0


@pytest.fixture
def pairs_tested(monkeypatch):
    """(requests, items) of every search, counted as the pairs that meet on a shelf."""
    met = []
    plain = Q.B.meet

    def counting(queries, items):
        out = plain(queries, items)
        met.append(out.select((F.size("requests") * F.size("items")).alias("n")).agg(F.sum("n")).first()[0] or 0)
        return out

    monkeypatch.setattr(Q.B, "meet", counting)
    return met


def test_requests_read_few_items(spark, small_blocks, world, monkeypatch, pairs_tested):
    """Copies of a request cost nothing, and lists that are full read no further."""
    rows, items, quality, known = world
    monkeypatch.setattr(Q, "WAVE", 25)
    monkeypatch.setattr(Q, "GROWTH", 2)
    req = make_requests(spark, items)
    everything = 60 * len(rows)
    Q.relaxed_quality(req, quality, items).count()
    once = sum(pairs_tested)
    assert once < 0.8 * everything
    pairs_tested.clear()
    copies = req.withColumn("request_id", F.explode(F.array(*[F.col("request_id") + 100 * k for k in range(20)])))
    Q.relaxed_quality(copies, quality, items).count()
    assert sum(pairs_tested) == once
    pairs_tested.clear()
    few = req.withColumn("n", F.lit(1).cast("bigint")).withColumn("prefs", F.lit(None).cast(M.PREFS_TYPE))
    Q.progressive_quality(few, quality, items).count()
    assert sum(pairs_tested) < 0.5 * everything


def test_copies_of_a_request_draw_from_the_same_list(spark, small_blocks, world):
    rows, items, quality, known = world
    req = make_requests(spark, items)
    copies = req.unionByName(req.withColumn("request_id", F.col("request_id") + 1000))
    got, one = listed(Q.relaxed_quality(copies, quality, items)), listed(Q.relaxed_quality(req, quality, items))
    assert got == {**one, **{i + 1000: v for i, v in one.items()}}


def test_empty_user_mask_is_ignored(spark, world):
    _, items, _, _ = world
    req = {r.request_id: r.prefs for r in make_requests(spark, items).collect()}
    assert req[2] is None  # user 2 matches no item at all
    assert req[0] is None and req[4] is None
    assert {p.category_id for p in req[1]} == {0}  # product page: no category test
    assert {p.category_id for p in req[6]} == {0, 6}
    assert {p.category_id for p in req[8]} == {6}


def test_visible_items(spark, world):
    rows, items, _, _ = world
    got = {(r.continent_id, r.item_id) for r in M.visible_items(items).collect()}
    assert got == {(c, x[0]) for x in rows for c in (1, 4, 7) if visible(x, c)}


def near_frame(spark, rows, k=40):
    out = []
    for x in rows:
        others = sorted((abs(x[3] - y[3]) + abs(x[0] - y[0]) / 1000 + (0 if x[6] == y[6] else 500), y[0]) for y in rows if y[0] != x[0])
        out += [(x[0], j, float(d), p, p) for p, (d, j) in enumerate(others[:k], 1)]
    return spark.createDataFrame(out, "item_id bigint, neighbor_id bigint, distance double, rank int, position int")


def test_family_first_properties(spark, small_blocks, world):
    rows, items, quality, known = world
    req = make_requests(spark, items).cache()
    near = near_frame(spark, rows)
    out = K.content_mixed(req, near, quality, items).collect()
    asks = {r.request_id: r for r in req.collect()}
    by = {}
    for r in out:
        by.setdefault(r.request_id, []).append(r)
    for q, got in by.items():
        a = asks[q]
        ids = [r.item_id for r in sorted(got, key=lambda r: r.position)]
        assert len(ids) == len(set(ids)) <= a.n and a.bike_id not in ids
        assert all(ok(a, known[i][0]) for i in ids)
        family = [x[0] for x, e in sorted(known.values(), key=lambda v: v[1][1]) if x[6] == a.family_id and x[0] != a.bike_id and ok(a, x)][: a.n]
        assert {r.item_id for r in got if r.source == "family"} == set(family) and got[0].family_count == len(family)
        brand = a.brand if a.brand != "null" else known[a.bike_id][0][8]
        flags = [known[i][0][8] == brand for i in ids]
        assert flags == sorted(flags, reverse=True)


def test_similar_falls_back_without_mask(spark, world):
    rows, items, _, known = world
    req = make_requests(spark, items).cache()
    near = near_frame(spark, rows)
    got = listed(K.similar_items(req, near, items))
    strict = listed(K.similar_items(req, near, items, strict_mask=True))
    order = {}
    for r in sorted(near.collect(), key=lambda r: (r.item_id, r.position)):
        order.setdefault(r.item_id, []).append(r.neighbor_id)
    for r in req.collect():
        hit = [i for i in order[r.bike_id][: 10 * r.n + 1] if ok(r, known[i][0])][: r.n]
        assert got[r.request_id] == (hit if len(hit) == r.n else order[r.bike_id][: r.n + 1])
        assert strict.get(r.request_id, []) == hit


def test_lists(spark):
    make = lambda ids: spark.createDataFrame([(1, p, i) for p, i in enumerate(ids, 1)], "request_id bigint, position int, item_id bigint")
    a, b = make([1, 2, 3, 4]), make([9, 2])
    assert listed(L.interleaved(a, b))[1] == [1, 9, 2, 2, 3, 4]
    assert listed(L.first_seen(L.interleaved(a, b)))[1] == [1, 9, 2, 3, 4]
    assert listed(L.first_seen(L.appended(b, a)))[1] == [9, 2, 1, 3, 4]


def test_rerank_keeps_repeats_and_unknowns(spark):
    users = spark.createDataFrame([("u", [1.0, 0.0])], "user string, vector array<double>")
    factors = spark.createDataFrame([(1, [0.1, 0.0]), (2, [0.9, 0.0]), (3, [0.9, 1.0])], "item_id bigint, vector array<double>")
    req = spark.createDataFrame([(1, "u", [77, 1, 3, 2, 88, 2, 1, 77]), (2, "stranger", [5, 1, 2])], "request_id bigint, actor string, bike_rerank_id array<bigint>")
    got = listed(CF.reranked(req, users, factors))
    assert got == {1: [2, 2, 3, 1, 1, 77, 88, 77], 2: [5, 1, 2]}


def test_best_for_users_and_ranks(spark, small_blocks, world):
    rows, items, _, known = world
    r = np.random.default_rng(2)
    iv, uv = np.round(r.normal(size=(200, 4)), 2), np.round(r.normal(size=(5, 4)), 2)
    users = spark.createDataFrame([(str(u), uv[u].tolist()) for u in range(5)], "user string, vector array<double>")
    factors = spark.createDataFrame([(i, iv[i].tolist()) for i in range(200)], "item_id bigint, vector array<double>")
    req = make_requests(spark, items).withColumn("actor", F.col("user_id").cast("string")).withColumn("_m", F.col("n")).cache()
    active = items.filter("id % 4 <> 0")
    got = {}
    for x in CF.best_for_users(req, users, factors, items, active).collect():
        got.setdefault(x.request_id, []).append((x.place, x.item_id))
    score = np.round(uv @ iv.T, 6)
    for q in req.collect():
        want = sorted((i for i in range(200) if i % 4 and ok(q, known[i][0])), key=lambda i: (-score[q.user_id, i], i))[: q.n]
        assert [i for _, i in sorted(got.get(q.request_id, []))] == want
    pos = spark.createDataFrame([("0", 3), ("0", 9), ("4", 150)], "user string, item_id bigint")
    for x in CF.positive_ranks(pos, users, factors).collect():
        s = score[int(x.user)]
        assert (x.above, x.equal) == ((s > s[x.item_id]).sum(), (s == s[x.item_id]).sum())


def test_request_checks(spark):
    raw = spark.createDataFrame(
        [(1, "rerank", None, "5", "d", None), (2, "product_page", 0, "5", "d", None), (3, "homepage", 1, "0", "NA", None),
         (4, None, None, None, None, None), (5, "valentine", 7, "oops", None, [1])],
        "request_id bigint, strategy string, bike_id bigint, user_id string, distinct_id string, bike_rerank_id array<bigint>",
    )
    errors = {r.request_id: r.error for r in BT.checked(raw).collect()}
    assert [bool(errors[i]) for i in (1, 2, 3, 4, 5)] == [True, True, True, False, False]
    good = {r.request_id: r for r in BT.dispatched(BT.with_defaults(raw)).collect()}
    assert (good[4].strategy, good[4].n, good[4].actor, good[4].frame_size_code) == ("product_page", 12, "NA", 56.0)
    assert (good[5].user_id, good[5].branch, good[5].strategy_used) == (0, "content", "FallbackContentMixed")
