"""Exact nearest rows, found by a tree of block summaries.

Rows are put in an order in which like stands by like and cut into blocks of a fixed size. A
block has a summary from which the least and greatest distance to any other block follow.
``FAN`` neighboring blocks make a node, ``FAN`` nodes a node of the next level, up to a level
of at most ``FAN`` nodes. The search goes down both trees at once, level by level: of the
pairs of nodes at hand it learns a distance that surely covers ``k`` items, drops every pair
that lies beyond it, and goes on with the children of the others. What is left at the
bottom are pairs of blocks. A task takes all partners of a block, nearest first, keeps the
best rows so far and stops as soon as no partner can improve them.

Rows at distance zero are ordered by id, and so are their blocks: a group of any number of
equal rows meets only the blocks with its ``k`` least ids, not all of itself.

A space can admit only some pairs (items alike in a category, say): nodes of which no pair
is admitted are dropped, and only nodes all of whose pairs are admitted cover anything. With
``zero_is_far`` equal rows count as the farthest instead of the nearest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallrec.operators import blocks as B
from stallrec.session import cut_lineage

FAN = 32
#: Groups of neighboring blocks on either side of a grid, blocks of a group at least, and the most
#: neighbors searched in a grid.
GRID = 8
LEAST = 4
FEW = 1024
#: Rows of a block on either side, and blocks that one task cuts.
ROWS = 512
ITEMS = 1024
BLOCKS_A_PART = 64
#: Distances are rounded to so many digits; a pair is dropped only if it is farther by more.
DIGITS = 6
MARGIN = 1e-5
#: Most pivots for vectors, and blocks for which there is one.
PIVOTS = 256
BLOCKS_A_PIVOT = 2
#: Values of a category that a summary lists; with more it says nothing.
VALUES = 64
#: Rows whose city block distances are added up together, and steps a component must have at least.
STRIPE = 128
LEVELS = 16
#: Stands for the distance of equal rows where they count as the farthest.
FARTHEST = float(np.finfo(np.float64).max)


@dataclass(frozen=True)
class Kernel:
    """Distances of two blocks; goes to the workers."""

    #: columns of a block -> what the functions below take
    prepare: Callable[[Mapping], object]
    #: (rows, items) -> (distances, error): the true distance is within the error
    distance: Callable[[object, object], tuple[np.ndarray, float]]
    #: exact distances of some pairs, or None where ``distance`` has no error
    exact: Callable[[object, object, np.ndarray, np.ndarray], np.ndarray] | None = None
    #: (rows, items) -> which pairs count
    mask: Callable[[object, object], np.ndarray] | None = None


@dataclass(frozen=True)
class Space:
    """What the tree must know about the rows."""

    #: columns that rows are ordered by
    order: Sequence[str]
    #: aggregates over the rows of a block, and what turns them into its summary
    aggregates: Sequence
    describe: Callable[[DataFrame], DataFrame]
    #: names of the summary columns, and aggregates, in this order, that make a node's from its children's
    names: Sequence[str]
    rollup: Callable[[], Sequence]
    #: adds _low and _high to pairs of nodes whose columns begin with a_ and b_
    bounds: Callable[[DataFrame], DataFrame]
    kernel: Kernel
    #: a whole number, first in order, that all rows of a block share
    split: str | None = None
    #: which pairs of nodes can and which surely do meet the condition of being alike
    possible: Callable | None = None
    sure: Callable | None = None


# --------------------------------------------------------------------------- tree


def blocks(df: DataFrame, space: Space, size: int, name: str) -> DataFrame:
    """Blocks of at most ``size`` rows in order: _node (0, 1, ...; with ``split`` some numbers are
    missing), _n, _first and _last id, summary, rows as ``name``. Written once, so that
    summaries and contents are those of one cut."""
    parts = max(1, -(-df.count() // (size * BLOCKS_A_PART)))
    order = [*space.order, "_id"]
    ranged = df.repartitionByRange(parts, *order) if parts > 1 else df.coalesce(1)
    placed = ranged.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    chunk = F.expr(f"(_at & {(1 << 33) - 1}) div {size}")
    if space.split is not None:
        chunk = chunk + F.col(space.split)
    cut = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_chunk", chunk)
    made = cut_lineage(
        space.describe(
            cut.groupBy("_part", "_chunk").agg(
                F.count("*").alias("_n"),
                F.min("_id").alias("_first"),
                F.max("_id").alias("_last"),
                F.collect_list(F.struct(*df.columns)).alias(name),
                *space.aggregates,
            )
        )
    )
    # a row per task of the cut
    sizes = made.groupBy("_part").agg((F.max("_chunk") + 1).alias("_c"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)
    sizes = sizes.withColumn("_from", F.sum("_c").over(before) - F.col("_c"))
    return made.join(sizes.select("_part", "_from"), "_part").withColumn("_node", F.col("_from") + F.col("_chunk"))


def levels(made: DataFrame, space: Space, height: int) -> list[DataFrame]:
    """Summaries of the blocks and of ``height - 1`` levels above them; _up is the parent."""
    level = made.select("_node", "_n", "_first", "_last", *space.names)
    out = []
    for _ in range(height):
        level = level.withColumn("_up", F.expr(f"_node div {FAN}"))
        out.append(level)
        made_up = [F.sum("_n"), F.min("_first"), F.max("_last"), *space.rollup()]
        level = level.groupBy("_up").agg(*[c.alias(f"_c{n}") for n, c in enumerate(made_up)])
        level = level.toDF("_node", "_n", "_first", "_last", *space.names)
    return out


def height(*sides: DataFrame) -> int:
    """Levels until at most ``FAN`` nodes are left on every side."""
    most, out = max((made.agg(F.max("_node")).first()[0] or 0) + 1 for made in sides), 1
    while most > FAN:
        most, out = -(-most // FAN), out + 1
    return out


def _named(level: DataFrame, prefix: str) -> DataFrame:
    return level.select(*[F.col(c).alias(f"{prefix}_{c}") for c in level.columns])


def near_pairs(rows: list[DataFrame], items: list[DataFrame], space: Space, k: int, zero_is_far: bool = False) -> DataFrame:
    """_left, _right, _low: pairs of blocks that can hold one of the ``k`` nearest."""
    equal = FARTHEST if zero_is_far else 0.0
    pairs = rows[0].sparkSession.range(1).select(F.col("id").alias("_left"), F.col("id").alias("_right"))
    for a, b in zip(reversed(rows), reversed(items)):
        met = pairs.join(_named(a, "a"), F.col("_left") == F.col("a__up")).join(
            _named(b, "b"), F.col("_right") == F.col("b__up")
        )
        if space.possible is not None:
            met = met.filter(space.possible())
        met = space.bounds(met.drop("_left", "_right"))
        if zero_is_far:
            low, high = F.col("_low"), F.col("_high")
            met = met.withColumns({"_low": F.when(high == 0, equal).otherwise(low), "_high": F.when(low <= MARGIN, equal).otherwise(high)})
        counted = F.col("b__n") if space.sure is None else F.when(space.sure(), F.col("b__n")).otherwise(0)
        node = W.partitionBy("a__node")
        nearest = node.orderBy("_high", "b__last", "b__node").rowsBetween(W.unboundedPreceding, W.currentRow)
        met = met.withColumn("_counts", counted.cast("bigint")).withColumn("_seen", F.sum("_counts").over(nearest))
        covers = F.when(F.col("_seen") >= k, F.struct(F.col("_high").alias("high"), F.col("b__last").alias("last")))
        met = met.withColumn("_bound", F.min(covers).over(node))
        reach = F.coalesce(F.col("_bound.high"), F.lit(float("inf")))
        # equal rows are taken by id: those after the k-th are not needed
        behind = (F.col("_low") == equal) & (F.col("_high") == equal) & (reach == equal) & (F.col("b__first") > F.col("_bound.last"))
        kept = (F.col("_low") <= reach + MARGIN) & ~F.coalesce(behind, F.lit(False))
        pairs = met.filter(kept).select(F.col("a__node").alias("_left"), F.col("b__node").alias("_right"), "_low")
    return pairs


# --------------------------------------------------------------------------- kernel


class Running:
    """The nearest rows so far of each row of a block, at most ``k`` of them by (distance, id)."""

    def __init__(self, k: np.ndarray, heap: bool, zero_is_far: bool = False):
        self.k, self.heap, self.zero_is_far = k, heap, zero_is_far
        self.limit = np.full(len(k), np.inf)
        none = np.zeros(0, np.int64)
        self.held = [(none, np.zeros(0), none)]
        self.pending = 0
        self.most = int(k.max(initial=0))
        # sorting is worth it once enough new rows came in; few wanted rows are sorted often
        self.patience = 3 * int(k.sum())

    def reach(self) -> float:
        """No row farther than this can still be among the nearest."""
        return float(self.limit.max(initial=-np.inf))

    def add(self, rows: object, items: object, ids: np.ndarray, kernel: Kernel) -> None:
        d, error = kernel.distance(rows, items)
        if kernel.mask is not None:
            d = np.where(kernel.mask(rows, items), d, np.inf)
        limit = self.limit + error
        if not self.heap and not self.zero_is_far and self.most <= d.shape[1] and self.most:
            limit = np.minimum(limit, np.partition(d, self.most - 1, axis=1)[:, self.most - 1] + 2 * error)
        r, c = np.nonzero((d <= limit[:, None] + MARGIN) & (d < np.inf))
        near = d[r, c] if kernel.exact is None else kernel.exact(rows, items, r, c)
        near = np.round(near, DIGITS) + 0.0
        if self.zero_is_far:
            near = np.where(near == 0, FARTHEST, near)
        fit = near <= self.limit[r]
        self.held.append((r[fit], near[fit], ids[c[fit]]))
        self.pending += int(fit.sum())
        if self.pending > self.patience:
            self.trim()

    def trim(self) -> None:
        if len(self.held) == 1:
            return
        row, d, ids = (np.concatenate(x) for x in zip(*self.held))
        at = B.best_rows(row, (d, ids), self.k[row])
        row, d, ids = row[at], d[at], ids[at]
        self.held, self.pending = [(row, d, ids)], 0
        full = np.bincount(row, minlength=len(self.k)) >= self.k
        worst = np.full(len(self.k), -np.inf)
        np.maximum.at(worst, row, d)
        self.limit = np.where(full, worst, np.inf)

    def ranked(self, ids: np.ndarray) -> dict[str, pa.Array]:
        """Rank by (distance, id), and position: zeros rank first but read as far, so nonzero
        rows move up by their number and exact twins follow them; the item itself has none."""
        self.trim()
        row, d, other = self.held[0]
        n = len(ids)
        count = np.bincount(row, minlength=n)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + 1
        zero, own = d == 0, other == ids[row]
        zeros = np.bincount(row[zero], minlength=n)[row]
        listed = np.bincount(row[own], minlength=n)[row] > 0
        twin = count[row] - zeros + rank - (listed & (ids[row] < other))
        place = np.where(zero, twin, rank - zeros)
        if self.zero_is_far:
            place, d = rank - (listed & (d == FARTHEST) & (ids[row] < other)), np.where(d == FARTHEST, np.inf, d)
        return {
            "item_id": pa.array(ids[row]),
            "neighbor_id": pa.array(other),
            "distance": pa.array(d),
            "rank": pa.array(rank, pa.int32()),
            "position": pa.array(place, pa.int32(), mask=own),
        }


    def partial(self, ids: np.ndarray, left: int) -> dict[str, pa.Array]:
        """The rows so far, each under its block and its place there, since ids may repeat."""
        self.trim()
        row, d, other = self.held[0]
        return {
            "_left": pa.array(np.full(len(row), left, np.int64)),
            "_row": pa.array(row),
            "_k": pa.array(self.k[row]),
            "item_id": pa.array(ids[row]),
            "neighbor_id": pa.array(other),
            "distance": pa.array(d),
        }


FOUND = "item_id bigint, neighbor_id bigint, distance double, rank int, position int"
PARTIAL = "_left bigint, _row bigint, _k bigint, item_id bigint, neighbor_id bigint, distance double"


def searcher(kernel: Kernel, heap: bool, zero_is_far: bool, whole: bool = True):
    """An Arrow mapper over pairs of blocks, those of one row block together, best nearest first.
    Without ``whole`` a task sees a part of a block's partners, and the lists are merged later."""

    def listed(best: Running, ids: np.ndarray, left: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(best.ranked(ids) if whole else best.partial(ids, left))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, ids, best, reach = None, None, None, None, np.inf
        for batch in batches:
            named = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for at in range(batch.num_rows):
                left, low = named["_left"][at].as_py(), named["_low"][at].as_py()
                if left != current:
                    if best is not None:
                        yield listed(best, ids, current)
                    columns = B.fields(batch, "rows", at)
                    ids, rows = B.numbers(columns["_id"]), kernel.prepare(columns)
                    current, best, reach = left, Running(B.numbers(columns["_k"]), heap, zero_is_far), np.inf
                if low > reach + MARGIN:
                    continue
                columns = B.fields(batch, "items", at)
                best.add(rows, kernel.prepare(columns), B.numbers(columns["_id"]), kernel)
                reach = best.reach()
        if best is not None:
            yield listed(best, ids, current)

    return run


def nearest(rows: DataFrame, items: DataFrame, space: Space, k: int, heap: bool = False, zero_is_far: bool = False) -> DataFrame:
    """item_id, neighbor_id, distance, rank, position of each row's nearest items.

    ``rows`` has _id, _k (items wanted, at most ``k``) and the columns of the space; ``items``
    the same without _k. ``position`` leaves the item itself out and puts equal rows last.
    """
    left, right = blocks(rows, space, ROWS, "rows"), blocks(items, space, ITEMS, "items")
    high = height(left, right)
    pairs = near_pairs(levels(left, space, high), levels(right, space, high), space, k, zero_is_far)
    # few heavy rows: small shares, so that no task has many of them
    shares = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = pairs.join(right.select(F.col("_node").alias("_right"), "items"), "_right").repartition(shares, "_left")
    met = met.join(left.select(F.col("_node").alias("_left"), "rows").repartition(shares, "_left"), "_left")
    ordered = met.select("_left", "_low", "_right", "rows", "items").sortWithinPartitions("_left", "_low", "_right")
    return ordered.mapInArrow(searcher(space.kernel, heap, zero_is_far), FOUND)


def nearest_in_grid(rows: DataFrame, items: DataFrame, space: Space, k: int, heap: bool = False) -> DataFrame:
    """The same as ``nearest`` for few neighbors of rows that are heavy, such as vectors.

    Neighboring blocks of either side form at most ``GRID`` groups. An item block goes once to
    each group of row blocks that needs it, not to each block, and a row block to each group of
    item blocks, so what is shuffled grows with the rows, not with the pairs of blocks. Nothing
    wide is sorted by distance; a window merges the lists that a row has from the groups.
    """
    left, right = blocks(rows, space, ROWS, "rows"), blocks(items, space, ITEMS, "items")
    high = height(left, right)
    pairs = near_pairs(levels(left, space, high), levels(right, space, high), space, k)
    wide = [max((made.agg(F.max("_node")).first()[0] or 0) // GRID + 1, LEAST) for made in (left, right)]
    cell = [F.expr(f"{c} div {n}").alias(name) for c, n, name in zip(("_left", "_right"), wide, ("_down", "_across"))]
    pairs = cut_lineage(pairs.select("_left", "_right", "_low", *cell))
    lows = F.map_from_entries(F.collect_list(F.struct("_right", "_low")))
    asked = pairs.groupBy("_down", "_across", "_left").agg(lows.alias("_lows"))
    asked = asked.join(left.select(F.col("_node").alias("_left"), "rows"), "_left")
    offered = pairs.select("_down", "_across", "_right").distinct()
    offered = offered.join(right.select(F.col("_node").alias("_right"), "items"), "_right")
    # merged, so that the partners of a row block come one after the other
    met = B.dealt(asked, "_down", "_across").hint("merge").join(B.dealt(offered, "_down", "_across"), ["_down", "_across"])
    met = met.withColumn("_low", F.try_element_at("_lows", F.col("_right"))).filter(F.col("_low").isNotNull())
    found = met.select("_left", "_low", "rows", "items").mapInArrow(searcher(space.kernel, heap, False, whole=False), PARTIAL)
    row = W.partitionBy("_left", "_row")
    best = found.withColumn("rank", F.row_number().over(row.orderBy("distance", "neighbor_id"))).filter(F.col("rank") <= F.col("_k"))
    zero, own = F.col("distance") == 0, F.col("neighbor_id") == F.col("item_id")
    counted = best.select(
        "*", F.count("*").over(row).alias("_n"), F.sum(zero.cast("int")).over(row).alias("_zeros"), F.max(own).over(row).alias("_listed")
    )
    # positions as in ``Running.ranked``
    twin = F.col("_n") - F.col("_zeros") + F.col("rank") - (F.col("_listed") & (F.col("item_id") < F.col("neighbor_id"))).cast("int")
    place = F.when(~own, F.when(zero, twin).otherwise(F.col("rank") - F.col("_zeros")))
    return counted.select("item_id", "neighbor_id", "distance", "rank", place.cast("int").alias("position"))


# --------------------------------------------------------------------------- vectors


def pivots(n_items: int) -> int:
    return max(1, min(PIVOTS, n_items // (ITEMS * BLOCKS_A_PIVOT)))


def matrix(array: pa.Array) -> np.ndarray:
    flat = B.numbers(array.flatten()).astype(np.float64)
    return flat.reshape(len(array), -1) if len(array) else flat.reshape(0, 0)


def directed(x: np.ndarray) -> np.ndarray:
    """Unit vectors with one more component, which is 1 for a zero vector: it stands at right
    angles to all others and equals itself."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    none = size == 0
    return np.hstack([x / np.where(none, 1, size), none.astype(float)])


def stepped(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """City block distances and their error, counted in steps of the components' range, as many as
    whole numbers of two bytes can add up over all components."""
    low = np.minimum(x.min(axis=0), y.min(axis=0))
    with np.errstate(all="ignore"):
        span = float(np.max(np.maximum(x.max(axis=0), y.max(axis=0)) - low, initial=0.0))
    levels = np.iinfo(np.int16).max // max(x.shape[1], 1)
    if levels < LEVELS or not 1e-100 < span < 1e100:
        total = np.zeros((len(x), len(y)))
        for j in range(x.shape[1]):
            total += np.abs(x[:, j, None] - y[None, :, j])
        return total, 1e-12 * float(total.max())
    step = span / levels
    left, right = (np.rint((side - low) / step).astype(np.int16) for side in (x, y))
    right = np.ascontiguousarray(right.T)
    total = np.empty((len(x), len(y)), np.float32)
    for start in range(0, len(x), STRIPE):
        rows = left[start : start + STRIPE]
        count, gap = np.zeros((len(rows), len(y)), np.int16), np.empty((len(rows), len(y)), np.int16)
        for j in range(x.shape[1]):
            np.subtract(rows[:, j, None], right[j], out=gap)
            np.absolute(gap, out=gap)
            np.add(count, gap, out=count)
        np.multiply(count, np.float32(step), out=total[start : start + STRIPE])
    # half a step either side of every component, and what single precision rounds off
    return total, x.shape[1] * step * (1 + 1e-6) + 1e-6 * float(total.max(initial=0))


@dataclass(frozen=True)
class Vectors:
    """Distances of vectors and bounds from centres and radii, by the triangle inequality.

    For cosine the inequality is that of unit vectors, whose squared distance is twice the
    cosine distance.
    """

    metric: str
    pivots: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def points(self, x: np.ndarray) -> np.ndarray:
        return directed(x) if self.metric == "cosine" else x

    def straight(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances, in the metric that the inequality holds for, of points row by row."""
        gap = x - y
        return np.abs(gap).sum(axis=1) if self.metric == "cityblock" else np.sqrt((gap * gap).sum(axis=1))

    def read(self, straight: np.ndarray) -> np.ndarray:
        """The metric's own distance."""
        return {"sqeuclidean": straight**2, "cosine": straight**2 / 2}.get(self.metric, straight)

    def prepare(self, columns: Mapping) -> np.ndarray:
        return self.points(matrix(columns["vector"]))

    def distance(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        if not len(x) or not len(y):
            return np.zeros((len(x), len(y))), 0.0
        if self.metric == "cityblock":
            return stepped(x, y)
        if self.metric == "cosine":
            return 1 - x @ y.T, 1e-12
        squares = (x * x).sum(axis=1), (y * y).sum(axis=1)
        # rounding grows with the norms, not with the distance
        error = 1e-13 * x.shape[1] * float(squares[0].max() + squares[1].max())
        square = np.maximum(squares[0][:, None] + squares[1][None, :] - 2 * (x @ y.T), 0)
        return (square, error) if self.metric == "sqeuclidean" else (np.sqrt(square), float(np.sqrt(error)))

    def exact(self, x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Component by component, so that the digits depend on the two vectors alone."""
        out = np.empty(len(r))
        for at in range(0, len(r), 1 << 15):
            part = slice(at, at + (1 << 15))
            a, b = x[r[part]], y[c[part]]
            if self.metric == "cosine":
                out[part] = 1 - (a * b).sum(axis=1)
            elif self.metric == "sqeuclidean":
                out[part] = ((a - b) ** 2).sum(axis=1)
            else:
                out[part] = self.straight(a, b)
        return out

    # ---- index

    def with_pivots(self, rows: DataFrame, count: int, sample: int = 4096) -> "Vectors":
        """Pivots that lie far apart, from a sample of at most ``sample`` rows, each followed by one
        that is near. They decide the order of rows and with it how much is skipped, never
        what is found."""
        some = rows.select("vector").orderBy(F.xxhash64("_id"), "_id").limit(sample).toArrow().column("vector").combine_chunks()
        points = self.points(matrix(some))
        chosen = [0] if len(points) else []
        away = np.full(len(points), np.inf)
        while chosen and len(chosen) < min(count, len(points)):
            away = np.minimum(away, self.straight(points, points[chosen[-1]]))
            chosen.append(int(away.argmax()))
        chain, left = chosen[:1], chosen[1:]
        while left:
            far = self.straight(points[left], points[chain[-1]])
            chain.append(left.pop(int(far.argmin())))
        return Vectors(self.metric, points[chain])

    def placed(self, rows: DataFrame) -> DataFrame:
        """Add _cell, the nearest pivot, and _away, the distance to it."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points = self.points(matrix(batch.column(batch.schema.get_field_index("vector"))))
                cell, away = np.zeros(len(points), np.int32), np.full(len(points), np.inf)
                for n, pivot in enumerate(self.pivots):
                    far = self.straight(points, pivot)
                    cell, away = np.where(far < away, n, cell).astype(np.int32), np.minimum(far, away)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell), pa.array(away)], names=[*batch.schema.names, "_cell", "_away"]
                )

        return rows.mapInArrow(run, f"{schema}, _cell int, _away double")

    def described(self, made: DataFrame) -> DataFrame:
        """Add centre and radius to blocks."""
        column = "rows" if "rows" in made.columns else "items"
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                centres, radii = [], []
                for at in range(batch.num_rows):
                    points = self.prepare(B.fields(batch, column, at))
                    centre = points.mean(axis=0)
                    far = self.straight(points, centre)
                    centres.append(centre)
                    radii.append(float(far.max()) * (1 + 1e-9) + 1e-12 * float(np.abs(points).max(initial=0)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(centres, pa.list_(pa.float64())), pa.array(radii, pa.float64())],
                    names=[*batch.schema.names, "centre", "radius"],
                )

        return made.mapInArrow(run, f"{schema}, centre array<double>, radius double")

    def gap(self, a, b):
        """Distance of two centres as a column."""
        parts = F.zip_with(a, b, lambda x, y: F.abs(x - y) if self.metric == "cityblock" else (x - y) * (x - y))
        total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
        return total if self.metric == "cityblock" else F.sqrt(total)

    def rollup(self) -> Sequence:
        """A node takes the centre of its first child and reaches as far as any child does."""
        children = F.sort_array(F.collect_list(F.struct("_node", F.col("centre").alias("c"), F.col("radius").alias("r"))))
        first = F.get(children, F.lit(0))["c"]
        reach = F.array_max(F.transform(children, lambda c: self.gap(c["c"], first) + c["r"]))
        return [first, reach * (1 + 1e-9)]

    def bounds(self, pairs: DataFrame) -> DataFrame:
        gap, reach = F.col("_gap"), F.col("a_radius") + F.col("b_radius")

        def read(straight):
            return {"sqeuclidean": straight * straight, "cosine": straight * straight / 2}.get(self.metric, straight)

        low = F.greatest(gap * (1 - 1e-9) - reach, F.lit(0.0))
        high = gap * (1 + 1e-9) + reach
        return (
            pairs.withColumn("_gap", self.gap(F.col("a_centre"), F.col("b_centre")))
            .withColumn("_low", read(low))
            .withColumn("_high", read(high))
            .drop("_gap", "a_centre", "b_centre")
        )

    def space(self) -> Space:
        return Space(
            ["_cell", "_away"],
            [],
            self.described,
            ["centre", "radius"],
            self.rollup,
            self.bounds,
            Kernel(self.prepare, self.distance, self.exact),
            split="_cell",
        )
