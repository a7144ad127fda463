"""Exact nearest rows where a few heavy categories decide, by joins on those that match.

Where one mismatch of a heavy category costs more than all light ones and the numbers
together, the items with fewer heavy mismatches are nearer, whatever else they hold. Counts per
combination of the heavy values tell at how many mismatches a row has met all items it wants;
it is then joined to the items that agree in all but so many heavy categories, once per choice
of these. A pair belongs to the first choice it fits, so none is met twice.

Counts and shares per combination grow with the tables and pack well as files, which makes them
look small, so no join here is left to a broadcast through the driver.

Rows that want more than ``MOST`` mismatches give, or that would meet more than ``CANDIDATES``
items, are handed back: the tree of ``operators.nearest`` finds theirs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallrec.operators import blocks as B
from stallrec.operators.nearest import DIGITS, FARTHEST
from stallrec.session import cut_lineage

#: With no more items than these the tree meets few blocks, and the joins save nothing.
FEW = 1 << 12
#: Mismatches looked at, and items a row may meet.
MOST = 2
CANDIDATES = 1 << 14
#: Rows of one key that go together, and rows of a bucket, about.
ROWS = 4096
BUCKET = 2048
#: Pairs at hand at once, and candidates of a row that a heap takes at a time.
PAIRS = 1 << 18
STRIDE = 1024
#: By so much at least must a mismatch outweigh the rest.
GAP = 1e-3

FOUND = "item_id bigint, neighbor_id bigint, distance double, _k bigint"


@dataclass(frozen=True)
class Choices:
    """Heavy categories that must match, those that may differ, and how many of them."""

    base: tuple[str, ...]
    free: tuple[str, ...]
    deepest: int

    @property
    def heavy(self) -> tuple[str, ...]:
        return self.base + self.free

    def at(self, level: int) -> list[tuple[str, ...]]:
        """The columns that match, for every choice of ``level`` that may differ."""
        return [self.base + kept for kept in combinations(self.free, len(self.free) - level)]

    def shares(self, level: int) -> list[int]:
        """Factors of the sums of counts per level: their total is the number of items with at
        most ``level`` mismatches, each counted once."""
        n, out = len(self.free), [0] * level + [1]
        for q in reversed(range(level)):
            out[q] = 1 - sum(out[i] * comb(n - q, i - q) for i in range(q + 1, level + 1))
        return out


def heavy_ones(spec) -> tuple[str, ...]:
    """The heaviest categories, if a mismatch in one outweighs everything light."""
    if not spec.categories:
        return ()
    w = max(spec.categories.values())
    heavy = tuple(c for c, v in spec.categories.items() if v == w)
    light = [v for v in spec.categories.values() if v != w]
    numbers = list(spec.numbers.values())
    squares = sum(v * v for v in numbers)
    if spec.metric == "cosine":
        whole, rest = sum(v * v for v in spec.categories.values()), sum(v * v for v in light) + squares
        gaps = [j * w * w / (whole + squares) - ((j - 1) * w * w + rest) / whole for j in range(1, len(heavy) + 1)]
    elif spec.metric == "cityblock":
        gaps = [2 * w - sum(2 * v for v in light) - sum(numbers)]
    else:
        gaps = [2 * w * w - sum(2 * v * v for v in light) - squares]
    return heavy if min(gaps) > GAP else ()


def choices(spec, alike: Sequence[str] = (), every: bool = False) -> Choices | None:
    """None where the categories do not decide. With ``alike`` only items count that share one of
    these, which all do that differ in fewer, or all of them."""
    heavy = heavy_ones(spec)
    if not heavy or not set(alike) <= set(heavy):
        return None
    base = tuple(c for c in heavy if every and c in alike)
    free = tuple(c for c in heavy if c not in base)
    most = min(MOST, len(free))
    return Choices(base, free, min(most, len(set(alike)) - 1) if alike and not every else most)


# --------------------------------------------------------------------------- kernel


def _distance(cats, nums, norms, spec, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of pairs, added up in the order of the block kernel, so that digits agree."""
    part = np.zeros(len(r))
    if spec.metric == "cosine":
        for (x, y), w in cats:
            part += (w * w) * (x[r] == y[c])
        for x, y in nums:
            part += x[r] * y[c]
        return 1 - part / np.sqrt(norms[0][r] * norms[1][c])
    flat = spec.metric == "cityblock"
    for (x, y), w in cats:
        part += (2 * w if flat else 2 * w * w) * (x[r] != y[c])
    for x, y in nums:
        gap = x[r] - y[c]
        part += np.abs(gap) if flat else gap * gap
    return np.sqrt(part) if spec.metric == "euclidean" else part


def _coded(a: pa.Table, b: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a column that both sides share."""
    both = pa.chunked_array([*a.column(column).chunks, *b.column(column).chunks], a.schema.field(column).type)
    codes = B.numbers(both.combine_chunks().dictionary_encode().indices)
    return codes[: a.num_rows], codes[a.num_rows :]


def kernel(spec, chosen: Choices, heap: bool, zero_is_far: bool):
    """Each row's best items of the same key, both sides of one bucket at hand."""
    listed = [(level, kept) for level in range(chosen.deepest + 1) for kept in chosen.at(level)]
    bit = {c: 1 << n for n, c in enumerate(chosen.heavy)}
    masks = [sum(bit[c] for c in kept) for _, kept in listed]
    # matching categories as bits -> the first choice of the level that they fit
    owner = np.full((chosen.deepest + 1, 1 << len(bit)), -1)
    for s in reversed(range(len(listed))):
        fits = [p for p in range(1 << len(bit)) if p & masks[s] == masks[s]]
        owner[listed[s][0], fits] = s
    level = np.array([at for at, _ in listed])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, other, k = (B.numbers(t.column(c).combine_chunks()) for t, c in ((a, "_id"), (b, "_id"), (a, "_k")))
        s = B.numbers(a.column("_s").combine_chunks())
        key, known = _coded(a, b, "_at")
        cats = {c: _coded(a, b, c) for c in spec.categories}
        weighed = [(cats[c], w) for c, w in spec.categories.items()]
        nums = [tuple(B.numbers(t.column(c).combine_chunks()) for t in (a, b)) for c in spec.numbers]
        square = sum(w * w for w in spec.categories.values())
        norms = [square + sum(x[i] * x[i] for x in nums) for i in (0, 1)]
        at = np.argsort(known, kind="stable")
        first, last = (np.searchsorted(known[at], key, side) for side in ("left", "right"))
        n = last - first
        out = []
        row = 0
        while row < len(ids):
            # as many rows as PAIRS allows, one at least
            end = row + max(int(np.searchsorted(np.cumsum(n[row:]), PAIRS, "right")), 1)
            most = int(n[row:end].max())
            step = STRIDE if heap else max(most, 1)
            held = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
            limit = np.full(end - row, np.inf)
            for start in range(0, most, step):
                width = np.clip(n[row:end] - start, 0, step)
                r = np.repeat(np.arange(row, end), width)
                c = at[first[r] + start + np.arange(len(r)) - np.repeat(np.cumsum(width) - width, width)]
                pattern = np.zeros(len(r), np.int64)
                for name, value in bit.items():
                    x, y = cats[name]
                    pattern |= np.where(x[r] == y[c], value, 0)
                own = owner[level[s[r]], pattern] == s[r]
                r, c = r[own], c[own]
                d = np.round(_distance(weighed, nums, norms, spec, r, c), DIGITS) + 0.0
                if zero_is_far:
                    d = np.where(d == 0, FARTHEST, d)
                near = d <= limit[r - row]
                held = tuple(np.concatenate(x) for x in zip(held, (r[near], d[near], other[c[near]])))
                best = B.best_rows(held[0], held[1:], k[held[0]])
                held = tuple(x[best] for x in held)
                if heap:
                    full = np.bincount(held[0] - row, minlength=end - row) >= k[row:end]
                    worst = np.full(end - row, -np.inf)
                    np.maximum.at(worst, held[0] - row, held[1])
                    limit = np.where(full, worst, np.inf)
            out.append(held)
            row = end
        r, d, near = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        return pa.table({"item_id": ids[r], "neighbor_id": near, "distance": d, "_k": k[r]})

    return run


# --------------------------------------------------------------------------- search


def _keys(chosen: Choices, levels: Sequence[int]):
    """(_s, _key) of every choice of these levels: its number and the values that match."""
    listed = [(level, kept) for level in range(chosen.deepest + 1) for kept in chosen.at(level)]
    return F.array(
        *[
            F.struct(F.lit(s).alias("_s"), F.to_json(F.array(F.lit(str(s)), *[F.col(c) for c in kept])).alias("_key"))
            for s, (level, kept) in enumerate(listed)
            if level in levels
        ]
    )


def placed(rows: DataFrame, items: DataFrame, spec, chosen: Choices, zero_is_far: bool) -> tuple[DataFrame, list[str]]:
    """The combinations of values that these joins serve, with _rows and _level, and their columns."""
    by = list(spec.categories) if zero_is_far else list(chosen.heavy)
    levels = range(chosen.deepest + 1)
    asked = cut_lineage(rows.groupBy(*by).agg(F.max("_k").alias("_k"), F.count("*").alias("_rows")))
    held = cut_lineage(items.groupBy(*by).agg(F.count("*").alias("_items")))
    total = held.select("_items", F.inline(_keys(chosen, levels))).groupBy("_key").agg(F.sum("_items").alias("_c"))
    seen = asked.select(*by, "_k", "_rows", F.inline(_keys(chosen, levels))).join(total.hint("merge"), "_key", "left")
    first = np.cumsum([0] + [len(chosen.at(level)) for level in levels])
    sums = seen.groupBy(*by, "_k", "_rows").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("_s").between(int(first[i]), int(first[i + 1]) - 1), F.col("_c"))), F.lit(0)).alias(f"_t{i}")
            for i in levels
        ]
    )
    wanted = F.col("_k")
    if zero_is_far:
        # equal rows come last, and are no more than the items of the same values
        sums = sums.join(held.hint("merge"), by, "left")
        wanted = wanted + F.coalesce("_items", F.lit(0))
    steps = []
    for i in levels:
        within = reduce(lambda x, y: x + y, [f * F.col(f"_t{j}") for j, f in enumerate(chosen.shares(i))])
        enough = (within >= wanted) if i < len(chosen.free) else F.lit(True)
        steps.append(F.when(enough, F.when(F.col(f"_t{i}") <= CANDIDATES, i).otherwise(-1)))
    return cut_lineage(sums.select(*by, "_rows", F.coalesce(*steps).alias("_level")).filter("_level >= 0")), by


def nearest(
    rows: DataFrame, items: DataFrame, spec, chosen: Choices, heap: bool = False, zero_is_far: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(item_id, neighbor_id, distance, rank, position as ``operators.nearest`` gives them, the
    rows that are left for it). ``rows`` has _id, _k and the features, ``items`` the same without _k."""
    served, by = placed(rows, items, spec, chosen, zero_is_far)
    levels = range(chosen.deepest + 1)
    keys = reduce(lambda x, i: x.when(F.col("_level") == i, _keys(chosen, [i])), levels, F.when(F.lit(False), F.array()))
    met = served.select(*by, "_rows", F.inline(keys))
    # rows of a key are dealt out by its number of rows, its items are there once per share
    shares = cut_lineage(met.groupBy("_s", "_key").agg(F.ceil(F.sum("_rows") / ROWS).cast("int").alias("_salts")))
    left = rows.join(met.drop("_rows").join(shares.hint("merge"), ["_s", "_key"]).hint("merge"), by).withColumn("_salt", F.pmod(F.xxhash64("_id"), F.col("_salts")))
    # what a combination of values meets is looked up once, not for each of its items
    asked = items.select(*chosen.heavy).distinct().select("*", F.inline(_keys(chosen, levels))).join(shares.hint("merge"), ["_s", "_key"])
    asked = asked.select(*[F.col(c).alias(f"_on_{c}") for c in chosen.heavy], "_key", "_salts")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in chosen.heavy])
    right = items.join(asked.hint("merge"), same)
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    buckets = max(rows.count() * len(chosen.at(chosen.deepest)) // BUCKET, 1)
    tasks = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def bucketed(side: DataFrame, *more: str) -> DataFrame:
        at = F.concat_ws("|", F.col("_salt").cast("string"), "_key").alias("_at")
        # under new names: both sides come from one table
        columns = [F.col(c).alias(c) for c in ("_id", *more, *spec.categories, *spec.numbers)]
        # few bytes that cause much work: a set number of tasks, which no planner merges
        return side.select(*columns, at, F.pmod(F.xxhash64("_key", F.col("_salt").cast("bigint")), F.lit(buckets)).alias("_bucket")).repartition(tasks, "_bucket")

    found = (
        bucketed(left, "_k", "_s").groupBy("_bucket").cogroup(bucketed(right).groupBy("_bucket"))
        .applyInArrow(kernel(spec, chosen, heap, zero_is_far), FOUND)
    )
    return ranked(found, zero_is_far), rows.join(served.select(*by).hint("merge"), by, "left_anti")


def ranked(found: DataFrame, zero_is_far: bool) -> DataFrame:
    """Rank by (distance, id), the first ``_k``, and position: equal rows last, the item itself nowhere."""
    item = W.partitionBy("item_id")
    d, own, rank = F.col("distance"), F.col("neighbor_id") == F.col("item_id"), F.col("rank")
    kept = found.withColumn("rank", F.row_number().over(item.orderBy("distance", "neighbor_id"))).filter(rank <= F.col("_k"))
    far = F.lit(FARTHEST) if zero_is_far else F.lit(0.0)
    counted = kept.withColumns(
        {
            "_n": F.count("*").over(item),
            "_zeros": F.sum(F.when(d == far, 1).otherwise(0)).over(item),
            "_own": F.max(own).over(item),
        }
    )
    before = F.when(F.col("_own") & (d == far) & (F.col("item_id") < F.col("neighbor_id")), 1).otherwise(0)
    if zero_is_far:
        place, shown = rank - before, F.when(d == FARTHEST, F.lit(float("inf"))).otherwise(d)
    else:
        place = F.when(d == 0, F.col("_n") - F.col("_zeros") + rank - before).otherwise(rank - F.col("_zeros"))
        shown = d
    return counted.select(
        "item_id", "neighbor_id", shown.alias("distance"), rank.cast("int").alias("rank"), F.when(~own, place).cast("int").alias("position")
    )
