"""Item similarity: weighted features, exact nearest neighbors, lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallrec import config as C
from stallrec.operators import blocks as B
from stallrec.operators import matches as X
from stallrec.operators import nearest as N
from stallrec.operators import skew as K

METRICS = ("euclidean", "sqeuclidean", "cityblock", "cosine")


@dataclass(frozen=True)
class Features:
    """Which columns compare, and how much each weighs.

    A category stands for its one-hot columns, a number for its min-max scaled value.
    """

    categories: Mapping[str, float]
    numbers: Mapping[str, float]
    metric: str = "euclidean"


def item_features(metric: str = "euclidean") -> Features:
    return Features(
        {
            c: C.HEAVY_CATEGORY_FACTOR if c in C.HEAVY_CATEGORIES else 1.0
            for c in C.CATEGORICAL_FEATURES
        },
        {c: C.HEAVY_NUMBER_FACTOR if c in C.HEAVY_NUMBERS else 1.0 for c in C.NUMERICAL_FEATURES},
        metric,
    )


def feature_frame(items: DataFrame, spec: Features, key: str = "id", keep: Sequence[str] = ()) -> DataFrame:
    """Categories as text and weighted min-max numbers; the bounds are scalar subqueries."""
    bounds = items.agg(
        *[F.min(c).cast("double").alias(f"lo_{c}") for c in spec.numbers],
        *[F.max(c).cast("double").alias(f"hi_{c}") for c in spec.numbers],
    )

    def scaled(c: str, w: float):
        lo, hi = bounds.select(f"lo_{c}").scalar(), bounds.select(f"hi_{c}").scalar()
        span = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
        return (F.lit(w) * ((F.col(c).cast("double") - lo) / span)).alias(c)

    return items.select(
        key,
        *keep,
        *[F.col(c).cast("string").alias(c) for c in spec.categories],
        *[scaled(c, w) for c, w in spec.numbers.items()],
    )


# --------------------------------------------------------------------------- distance


def _coded(columns: Mapping, spec: Features) -> dict:
    """A block's categories as codes with their values, its numbers as arrays."""
    return {
        **{c: B.codes(columns[c]) for c in spec.categories},
        **{c: B.numbers(columns[c]) for c in spec.numbers},
        "n": len(columns["_id"]),
    }


def _matched(a: Mapping, b: Mapping, c: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a category on both sides, under the items' values."""
    (own, values), (code, known) = a[c], b[c]
    table = np.array([known.get(v, -1) for v in values] or [-1])
    return table[own].astype(np.int32), code.astype(np.int32)


TILE = (64, 1024)


def _tiles(n: int, m: int):
    for r in range(0, n, TILE[0]):
        for c in range(0, m, TILE[1]):
            yield slice(r, min(r + TILE[0], n)), slice(c, min(c + TILE[1], m))


def _feature_distance(a: Mapping, b: Mapping, spec: Features) -> np.ndarray:
    """Distances of two blocks from matches and scaled numbers, without one-hot columns.

    Worked off in tiles that stay in the processor's cache.
    """
    cats = [(*_matched(a, b, c), w) for c, w in spec.categories.items()]
    nums = [(a[c], b[c]) for c in spec.numbers]
    total = np.empty((a["n"], b["n"]))
    square = sum(w * w for w in spec.categories.values())
    norms = [square + sum(x[i] * x[i] for x in nums) for i in (0, 1)]
    for r, c in _tiles(*total.shape):
        part = np.zeros((r.stop - r.start, c.stop - c.start))
        if spec.metric == "cosine":
            for x, y, w in cats:
                part += (w * w) * (x[r, None] == y[None, c])
            for x, y in nums:
                part += x[r, None] * y[None, c]
            part = 1 - part / np.sqrt(norms[0][r, None] * norms[1][None, c])
        else:
            flat = spec.metric == "cityblock"
            for x, y, w in cats:
                part += (2 * w if flat else 2 * w * w) * (x[r, None] != y[None, c])
            for x, y in nums:
                gap = x[r, None] - y[None, c]
                part += np.abs(gap) if flat else gap * gap
            if spec.metric == "euclidean":
                np.sqrt(part, out=part)
        total[r, c] = part
    return total


def _alike_matrix(a: Mapping, b: Mapping, alike: Sequence[str], every: bool) -> np.ndarray:
    same = [np.equal.outer(*_matched(a, b, c)) for c in alike]
    return np.logical_and.reduce(same) if every else np.logical_or.reduce(same)


# --------------------------------------------------------------------------- bounds


def _heaviest(spec: Features) -> list[str]:
    """Categories, the heaviest first: rows that differ in them are far apart."""
    return sorted(spec.categories, key=lambda c: -spec.categories[c])


def _both(c: str) -> tuple[Column, Column]:
    return F.col(f"a_s_{c}"), F.col(f"b_s_{c}")


def _can_match(c: str) -> Column:
    x, y = _both(c)
    return F.coalesce(F.arrays_overlap(x, y), F.lit(True))


def _must_match(c: str) -> Column:
    x, y = _both(c)
    return F.coalesce((F.size(x) == 1) & (F.size(y) == 1) & (F.get(x, F.lit(0)) == F.get(y, F.lit(0))), F.lit(False))


def _feature_bounds(spec: Features):
    """Least and greatest distance of two nodes, from their summaries: per category whether
    rows of both can and whether they must match, per number the gap and the span."""
    zero = F.lit(0.0)

    def bound(pairs: DataFrame) -> DataFrame:
        low, high = zero, zero
        if spec.metric == "cosine":
            # numbers are scaled from zero up, so products and norms grow with them
            norm = {t: F.lit(float(sum(w * w for w in spec.categories.values()))) for t in ("a_lo", "a_hi", "b_lo", "b_hi")}
            least, most = zero, zero
            for c, w in spec.categories.items():
                least = least + F.when(_must_match(c), w * w).otherwise(0.0)
                most = most + F.when(_can_match(c), w * w).otherwise(0.0)
            for c in spec.numbers:
                least = least + F.col(f"a_lo_{c}") * F.col(f"b_lo_{c}")
                most = most + F.col(f"a_hi_{c}") * F.col(f"b_hi_{c}")
                norm = {t: v + F.col(f"{t}_{c}") * F.col(f"{t}_{c}") for t, v in norm.items()}
            low = F.greatest(1 - most / F.sqrt(norm["a_lo"] * norm["b_lo"]), zero)
            high = 1 - least / F.sqrt(norm["a_hi"] * norm["b_hi"])
            return pairs.withColumn("_low", low).withColumn("_high", high)
        flat = spec.metric == "cityblock"
        for c, w in spec.categories.items():
            cost = 2 * w if flat else 2 * w * w
            low = low + F.when(_can_match(c), 0.0).otherwise(cost)
            high = high + F.when(_must_match(c), 0.0).otherwise(cost)
        for c in spec.numbers:
            a_lo, a_hi, b_lo, b_hi = (F.col(f"{t}_{e}_{c}") for t in "ab" for e in ("lo", "hi"))
            gap = F.greatest(a_lo - b_hi, b_lo - a_hi, zero)
            span = F.greatest(a_hi - b_lo, b_hi - a_lo)
            low = low + (gap if flat else gap * gap)
            high = high + (span if flat else span * span)
        if spec.metric == "euclidean":
            low, high = F.sqrt(low), F.sqrt(high)
        return pairs.withColumn("_low", low).withColumn("_high", high)

    return bound


def feature_space(spec: Features, alike: Sequence[str] = (), every: bool = False) -> N.Space:
    """How the tree search sees weighted features. With ``alike``, only items count that share
    one of these categories with the row, or all of them with ``every``."""
    sets, low, high = ([f"{t}_{c}" for c in cols] for t, cols in (("s", spec.categories), ("lo", spec.numbers), ("hi", spec.numbers)))

    def short(column: Column) -> Column:
        return F.when(F.size(column) <= N.VALUES, column)

    def rollup():
        listed = [F.when(F.count(s) == F.count(F.lit(1)), F.array_distinct(F.flatten(F.collect_list(s)))) for s in sets]
        return [
            *[short(values) for values in listed],
            *[F.min(c) for c in low],
            *[F.max(c) for c in high],
        ]

    def joined(tests):
        return reduce((lambda x, y: x & y) if every else (lambda x, y: x | y), tests)

    return N.Space(
        _heaviest(spec) + list(spec.numbers),
        [
            *[F.collect_set(c).alias(s) for c, s in zip(spec.categories, sets)],
            *[F.min(c).alias(s) for c, s in zip(spec.numbers, low)],
            *[F.max(c).alias(s) for c, s in zip(spec.numbers, high)],
        ],
        lambda made: made.select(*[short(F.col(c)).alias(c) if c in sets else F.col(c) for c in made.columns]),
        [*sets, *low, *high],
        rollup,
        _feature_bounds(spec),
        N.Kernel(
            lambda columns: _coded(columns, spec),
            lambda a, b: (_feature_distance(a, b, spec), 0.0),
            mask=(lambda a, b: _alike_matrix(a, b, alike, every)) if alike else None,
        ),
        possible=(lambda: joined([_can_match(c) for c in alike])) if alike else None,
        sure=(lambda: joined([_must_match(c) for c in alike])) if alike else None,
    )


# --------------------------------------------------------------------------- search


def _wanted(percentile: float, k: int | None, n_rows: int, n_items: int) -> int:
    return max(min(max(int(n_rows * percentile / 100), 1) if k is None else k, n_items), 1)


def _checked(metric: str, select: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    if select not in ("partition", "heap"):
        raise ValueError(f"unknown selection {select}")


def _search(
    rows: DataFrame,
    chosen: DataFrame,
    spec: Features,
    n_items: int,
    k: int,
    heap: bool,
    alike: Sequence[str] = (),
    every: bool = False,
    zero_is_far: bool = False,
) -> DataFrame:
    """By joins on the heavy categories that match, where few items can be among the nearest; by
    the tree where these decide nothing or a row would meet too many."""
    space, heavy = feature_space(spec, alike, every), X.choices(spec, alike, every)
    if heavy is None or n_items <= X.FEW or (k > X.CANDIDATES and not every):
        return N.nearest(rows, chosen, space, k, heap, zero_is_far)
    found, left = X.nearest(rows, chosen, spec, heavy, heap, zero_is_far)
    return found if left.isEmpty() else found.unionByName(N.nearest(left, chosen, space, k, heap, zero_is_far))


def nearest_items(
    items: DataFrame,
    active: DataFrame,
    spec: Features | None = None,
    percentile: float = 10,
    k: int | None = None,
    select: str = "partition",
) -> DataFrame:
    """Each item's nearest active items, the item itself included if active.

    Exact, by joins on matching categories (``operators.matches``) and the tree of
    ``operators.nearest``. ``k`` is a share of all rows unless given,
    and never more than the number of active items. ``select='heap'`` lets only rows
    enter that beat the ``k``-th so far, instead of sorting each pair of blocks in part.
    """
    spec = spec or item_features()
    _checked(spec.metric, select)
    feats = feature_frame(items, spec).withColumnRenamed("id", "_id")
    chosen = feats.join(active.select(F.col("id").alias("_id")).hint("merge"), "_id", "left_semi")
    n_items = chosen.count()
    k = _wanted(percentile, k, feats.count(), n_items)
    rows = feats.withColumn("_k", F.lit(k).cast("bigint"))
    return _search(rows, chosen, spec, n_items, k, select == "heap")


def nearest_asked(
    asked: DataFrame, items: DataFrame, active: DataFrame, spec: Features | None = None, percentile: float = 10
) -> DataFrame:
    """The part of ``nearest_items`` that holds positions 1 to ``k`` of each item asked for: rows
    (id, k) of ``asked``. Exact twins rank first but stand last by position, so as many more are
    searched as there are items of the same categories; never more than ``nearest_items`` keeps."""
    spec = spec or item_features()
    _checked(spec.metric, "partition")
    feats = feature_frame(items, spec).withColumnRenamed("id", "_id")
    chosen = feats.join(active.select(F.col("id").alias("_id")).hint("merge"), "_id", "left_semi")
    n_items = chosen.count()
    stored = _wanted(percentile, None, feats.count(), n_items)
    twins = chosen.groupBy(*spec.categories).agg(F.count("*").alias("_twins"))
    wanted = F.least(F.lit(stored), F.col("k") + F.coalesce("_twins", F.lit(0))).cast("bigint")
    rows = feats.join(asked.select(F.col("id").alias("_id"), "k").hint("merge"), "_id").join(twins.hint("merge"), list(spec.categories), "left")
    rows = rows.withColumn("_k", wanted).drop("k", "_twins")
    return _search(rows, chosen, spec, n_items, int(rows.agg(F.max("_k")).first()[0] or 1), False)


def nearest_alike(
    asked: DataFrame,
    items: DataFrame,
    active: DataFrame,
    features: Sequence[str],
    every: bool = False,
    spec: Features | None = None,
) -> DataFrame:
    """The nearest active items that share one of ``features`` (``every``: all of them) with each
    item asked for: rows (id, k) of ``asked``, ``k`` counting the item itself. Exact for any
    ``k``, whatever the general table of neighbors keeps. Exact twins come last."""
    spec = spec or item_features()
    _checked(spec.metric, "heap")
    feats = feature_frame(items, spec).withColumnRenamed("id", "_id")
    chosen = feats.join(active.select(F.col("id").alias("_id")).hint("merge"), "_id", "left_semi")
    rows = feats.join(asked.select(F.col("id").alias("_id"), F.col("k").cast("bigint").alias("_k")).hint("merge"), "_id")
    most = asked.agg(F.max("k")).first()[0] or 1
    return _search(rows, chosen, spec, chosen.count(), int(most), True, features, every, True)


def nearest_vectors(
    rows: DataFrame,
    items: DataFrame,
    metric: str = "euclidean",
    percentile: float = 10,
    k: int | None = None,
    select: str = "partition",
) -> DataFrame:
    """The same over dense vectors of one length: frames of (id, vector). For cosine a zero
    vector is at distance 1 from all others and 0 from other zero vectors."""
    _checked(metric, select)
    cols = [F.col("id").alias("_id"), F.col("vector")]
    rows, items = rows.select(*cols), items.select(*cols)
    n_items = items.count()
    k = _wanted(percentile, k, rows.count(), n_items)
    vectors = N.Vectors(metric).with_pivots(items, N.pivots(n_items))
    left = vectors.placed(rows).withColumn("_k", F.lit(k).cast("bigint"))
    search = N.nearest_in_grid if k <= N.FEW else N.nearest
    return search(left, vectors.placed(items), vectors.space(), k, select == "heap")


# --------------------------------------------------------------------------- lookup


def lookup(
    requests: DataFrame,
    neighbors: DataFrame,
    limit: Column | None = None,
    zero_is_far: bool = True,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Neighbors of each request's item, nearest first, the item itself removed.

    A distance of zero, an exact twin, reads as infinitely far (unless ``zero_is_far`` is
    off); the stored ``position`` already counts that way. ``limit`` cuts by position
    inside the join, so an item asked for by many requests brings only the rows each of
    them can use, and requests for a hot item are dealt out. ``carry`` names request
    columns to keep.
    """
    d = F.col("distance")
    near = neighbors.filter(F.col("position").isNotNull()).select(
        F.col("item_id").alias("bike_id"),
        F.col("neighbor_id").alias("item_id"),
        (F.when(d == 0, F.lit(float("inf"))).otherwise(d) if zero_is_far else d).alias("distance"),
        "position",
    )
    if not zero_is_far:
        order = W.partitionBy("bike_id").orderBy("distance", "item_id")
        near = near.withColumn("position", F.row_number().over(order))
    found = K.join(requests.select("request_id", "bike_id", *carry), near, "bike_id", "request_id")
    if limit is not None:
        found = found.filter(F.col("position") <= limit)
    return found.select("request_id", "bike_id", "item_id", "distance", "position", *carry)


def unknown_items(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Requests whose item has no row in the catalog, with the error they get."""
    return requests.join(items, requests.bike_id == items.id, "left_anti").select(
        "request_id", F.concat(F.lit("unknown item "), F.col("bike_id").cast("string")).alias("error")
    )
