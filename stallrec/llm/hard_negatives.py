"""Hard negatives by angular triangle filtering.

A row's vector is its components as integers, floor(256 * x), and a score is an integer inner
product. For every row the angles to a few reference directions and the norm are stored. The
angle between an anchor and a row lies between the difference and the sum of their angles to
any reference, so the tightest of these give an interval of cosines; times both norms, widened
by more than all rounding, an interval of scores. Only rows whose interval overlaps a window
that is still open get an integer score.

1. Rows are packed into blocks of one label, near one reference, of bounded size. A label or a
   reference with a third of all rows has as many blocks as its count asks for.
2. Anchors meet the blocks of their own label: the window is everything from the fifth best
   score so far. The best five are the positives.
3. Anchors meet all blocks of other labels: per positive the window is [50 %, 95 %] of its
   score, narrowed from below by the third best negative so far.

Whole blocks are passed over first, by the least and greatest angles in them. Blocks meet in
the grid of ``operators.blocks``; anchors are few beside rows and travel in large blocks.

The references are rows of a sample of at most ``SAMPLE`` rows, each the farthest from those
before it. They decide what is skipped, never what is returned.

Defined cases: rows with a null label, a null vector, a null or non-finite component take no
part, nor do rows without vec_id, which could not be named. A zero or empty vector scores
zero with everything; a shorter vector counts as filled up with zeros. Repeated rows are rows
of their own, and repeated anchors anchors of their own, but a row with the anchor's vec_id is
none of its positives. Ties go to the smaller vec_id. Scores are exact up to 64 bits, beyond
which they stay at the limit. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallrec.llm.common import arrow_schema, ddl, map_rows
from stallrec.operators.blocks import best_rows, fields, meet, numbers, pack
from stallrec.session import cut_lineage

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
REFERENCES = 16
SAMPLE = 4096
#: Rows of an item block, anchors of an anchor block, and rows scored at once.
BLOCK = 4096
ANCHORS = 4096
TILE = 512
#: More than the rounding of an angle in 32 bits, in radians.
SLACK = 1e-6
#: Anchor blocks whose best rows a task keeps before it hands them on.
HELD = 8
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
ROW = ("vec_id", "embedding", "norm", "angles")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, embedding, label of the rows that take part; every seventh with the next label."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    kept = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", label.cast("long").alias("label"))


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists as rows, shorter ones filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def whole(lists: pa.Array) -> np.ndarray:
    """Integer components, held as floating-point numbers."""
    return np.floor(SCALE * matrix(lists))


def of_width(values: np.ndarray, width: int) -> np.ndarray:
    return values if values.shape[1] == width else np.pad(values, ((0, 0), (0, width - values.shape[1])))


def references(rows: DataFrame, count: int = REFERENCES, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors: rows of a bounded sample, each the farthest from those before it."""
    some = rows.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    if not some.num_rows:
        return np.zeros((0, 0))
    vectors = whole(some.column("embedding").combine_chunks())
    size = np.linalg.norm(vectors, axis=1)
    vectors = vectors[size > 0] / size[size > 0][:, None]
    chosen: list[int] = []
    nearest = np.full(len(vectors), -np.inf)
    while len(chosen) < min(count, len(vectors)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    return vectors[chosen]


def with_angles(rows: DataFrame, directions: np.ndarray) -> DataFrame:
    """Add norm, angles to the reference directions, and cell, the nearest of them."""

    def start():
        def make(columns):
            vectors = whole(columns["embedding"])
            norm = np.linalg.norm(vectors, axis=1)
            width = max(vectors.shape[1], directions.shape[1])
            cosine = of_width(vectors, width) @ of_width(directions, width).T / np.where(norm > 0, norm, 1)[:, None]
            angle = np.arccos(np.clip(cosine, -1, 1))
            ends = np.arange(len(norm) + 1, dtype=np.int32) * angle.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(angle.reshape(-1), pa.float32()))
            cell = angle.argmin(axis=1) if angle.shape[1] else np.zeros(len(norm), np.int64)
            return {"norm": norm, "angles": lists, "cell": cell.astype(np.int32)}

        return make

    return map_rows(rows, start, {"norm": "double", "angles": "array<float>", "cell": "int"})


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks (_shelf, _bucket, _blocks, items): rows of one label near one reference."""
    shelved = rows.withColumn("_shelf", F.col("label").cast("string"))
    parts = shelved.groupBy("_shelf", "cell").agg(F.ceil(F.count("*") / size).alias("_parts"))
    # a row per label and reference
    order = W.partitionBy("_shelf").orderBy("cell")
    parts = parts.withColumn("_from", F.sum("_parts").over(order) - F.col("_parts"))
    parts = parts.withColumn("_blocks", F.sum("_parts").over(W.partitionBy("_shelf")))
    dealt_out = shelved.join(parts, ["_shelf", "cell"]).withColumn("_bucket", F.col("_from") + F.pmod(F.xxhash64("vec_id"), "_parts"))
    return dealt_out.groupBy("_shelf", "_bucket").agg(
        F.max("_blocks").cast("bigint").alias("_blocks"), F.collect_list(F.struct(*ROW)).alias("items")
    )


class Side:
    """Vectors, norms and angles of one block."""

    def __init__(self, columns: dict[str, pa.Array]):
        self.ids = numbers(columns["vec_id"])
        self.vectors = whole(columns["embedding"])
        self.norm = numbers(columns["norm"])
        self.angles = matrix(columns["angles"])


def score_bounds(near: np.ndarray, far: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score for angles in [near, far] and products of norms in [least, most]."""
    top = np.cos(np.clip(near - 2 * SLACK, 0, np.pi))
    low = np.cos(np.clip(far + 2 * SLACK, 0, np.pi))
    slack = 1 + 1e-9 * most
    return np.where(low < 0, most, least) * low - slack, np.where(top < 0, least, most) * top + slack


def block_bounds(anchors: Side, items: Side) -> tuple[np.ndarray, np.ndarray]:
    """Score bounds of each anchor with any row of a block."""
    first, last = items.angles.min(axis=0), items.angles.max(axis=0)
    near = np.maximum(np.maximum(anchors.angles - last, first - anchors.angles), 0).max(axis=1, initial=0)
    far = np.minimum(anchors.angles + last, 2 * np.pi - anchors.angles - first).min(axis=1, initial=np.pi)
    return score_bounds(near, far, anchors.norm * items.norm.min(), anchors.norm * items.norm.max())


def row_bounds(anchors: Side, who: np.ndarray, items: Side, which: slice) -> tuple[np.ndarray, np.ndarray]:
    """Score bounds of some anchors with some rows."""
    shape = (len(who), len(items.ids[which]))
    near, far = np.zeros(shape), np.full(shape, np.pi)
    for a, b in zip(anchors.angles[who].T, items.angles[which].T):
        a = a[:, None]
        np.maximum(near, np.abs(a - b), out=near)
        total = a + b
        np.minimum(far, np.minimum(total, 2 * np.pi - total), out=far)
    product = anchors.norm[who][:, None] * items.norm[which]
    return score_bounds(near, far, product, product)


def integer_scores(a: np.ndarray, b: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, exact score) of the wanted pairs."""
    row, column = np.nonzero(wanted)
    if not len(row):
        return row, column, np.zeros(0, np.int64)
    width = max(a.shape[1], b.shape[1])
    a, b = of_width(a, width), of_width(b, width)
    if width * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) >= 2**53:  # beyond what sums of floating-point numbers hold
        left, right = [[int(x) for x in r] for r in a], [[int(x) for x in r] for r in b]
        exact = (sum(x * y for x, y in zip(left[r], right[c])) for r, c in zip(row.tolist(), column.tolist()))
        return row, column, np.array([min(max(s, LOWEST), HIGHEST) for s in exact], np.int64)
    if len(row) * 8 > wanted.size:
        return row, column, (a @ b.T)[row, column].astype(np.int64)
    scores = np.empty(len(row), np.int64)
    for at in range(0, len(row), 1 << 16):
        part = slice(at, at + (1 << 16))
        scores[part] = np.einsum("ij,ij->i", a[row[part]], b[column[part]]).astype(np.int64)
    return row, column, scores


class Best:
    """The best rows so far of every window of an anchor block."""

    def __init__(self, low: np.ndarray, high: np.ndarray, keep: int):
        self.low, self.high, self.keep = low.copy(), high, keep  # (anchors, windows)
        none = np.zeros(0, np.int64)
        self.slot, self.score, self.ids = none, none, none

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """New rows of windows, numbered anchor by anchor; a full window's low end rises."""
        slot, score, ids = (np.concatenate(p) for p in ((self.slot, slot), (self.score, score), (self.ids, ids)))
        at = best_rows(slot, (-score, ids), np.full(len(slot), self.keep))
        self.slot, self.score, self.ids = slot[at], score[at], ids[at]
        full = np.flatnonzero(np.bincount(self.slot, minlength=self.low.size) == self.keep)
        worst = np.full(self.low.size, HIGHEST)
        np.minimum.at(worst, self.slot, self.score)
        self.low.reshape(-1)[full] = worst[full]


def search(anchors: Side, items: Side, best: Best, allowed: np.ndarray, own: bool) -> int:
    """Meet a block: pass over it, then over rows, then score. Returns the number of scores made.

    ``allowed`` says which anchors may take rows of this block; with ``own`` rows that have
    the anchor's vec_id are left out.
    """
    least, greatest = block_bounds(anchors, items)
    windows = best.low.shape[1]
    scored = 0
    for start in range(0, len(items.ids), TILE):
        open_to = (best.low <= greatest[:, None]) & (best.high >= least[:, None]) & (best.low <= best.high)
        who = np.flatnonzero(allowed & open_to.any(axis=1))
        if not len(who):
            break
        which = slice(start, start + TILE)
        lower, upper = row_bounds(anchors, who, items, which)
        low, high = best.low[who], best.high[who]
        wanted = np.zeros(lower.shape, bool)
        for w in range(windows):
            wanted |= (upper >= low[:, w : w + 1]) & (lower <= high[:, w : w + 1]) & (low[:, w : w + 1] <= high[:, w : w + 1])
        if own:
            wanted &= anchors.ids[who][:, None] != items.ids[which]
        row, column, score = integer_scores(anchors.vectors[who], items.vectors[which], wanted)
        scored += len(score)
        ids = items.ids[which][column]
        for w in range(windows):
            hit = np.flatnonzero((score >= low[row, w]) & (score <= high[row, w]))
            # what cannot be among the best of this tile need not be sorted with the others
            hit = hit[best_rows(row[hit], (-score[hit], ids[hit]), np.full(len(hit), best.keep))]
            best.add(who[row[hit]] * windows + w, score[hit], ids[hit])
    return scored


POSITIVE = {"anchor": "long", "score": "long", "positive_id": "long"}
NEGATIVE = {"anchor": "long", "nth": "int", "negative_score": "long", "negative_id": "long"}


def searcher(kind: str):
    """An Arrow mapper over pairs of an anchor block and an item block."""
    fields_out = POSITIVE if kind == "positive" else NEGATIVE

    def opened(batch: pa.RecordBatch, row: int):
        columns = fields(batch, "anchors", row)
        side = Side(columns)
        side.key, side.label = numbers(columns["anchor"]), numbers(columns["label"])
        if kind == "positive":
            low = np.full((len(side.ids), 1), LOWEST)
            return side, Best(low, np.full_like(low, HIGHEST), POSITIVES)
        lists = columns["positive_scores"]
        width = np.diff(lists.offsets.to_numpy())
        low, high = np.full((len(width), POSITIVES), HIGHEST), np.full((len(width), POSITIVES), LOWEST)
        of = lists.flatten().to_numpy(zero_copy_only=False)
        there = np.arange(POSITIVES) < width[:, None]
        # 50 p <= 100 s and 100 s <= 95 p, without products that could pass 64 bits
        low[there], high[there] = -((-of) // 2), of + (-of) // 20
        return side, Best(low, high, NEGATIVES)

    def closed(side: Side, best: Best) -> pa.RecordBatch:
        anchor = side.key[best.slot // best.low.shape[1]]
        nth = best.slot % best.low.shape[1]
        values = [anchor, best.score, best.ids] if kind == "positive" else [anchor, nth, best.score, best.ids]
        schema = arrow_schema(fields_out)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Side, Best]] = {}
        for batch in batches:
            named = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            for row in range(batch.num_rows):
                key = (named["_shelf"][row].as_py(), named["_query_block"][row].as_py())
                if key not in held:
                    if len(held) >= HELD:
                        yield closed(*held.pop(next(iter(held))))
                    held[key] = opened(batch, row)
                side, best = held[key]
                label = named["block_label"][row].as_py()
                allowed = side.label == label if kind == "positive" else side.label != label
                search(side, Side(fields(batch, "items", row)), best, allowed, kind == "positive")
        for side, best in held.values():
            yield closed(side, best)

    return run, ddl(fields_out)


def anchor_blocks(anchors: DataFrame, shelf: str | None, size: int, columns: list[str]) -> DataFrame:
    return pack(anchors, shelf, "anchor", size, columns, "anchors")


def mine(rows: DataFrame, every: int = 50, block: int = BLOCK, anchors_in_block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``.
    """
    used = usable(rows)
    angled = with_angles(used, references(used))
    blocks = cut_lineage(packed(angled, block)).withColumn("block_label", F.col("_shelf").cast("long"))
    # the number of an anchor is fixed by being written
    anchors = angled.filter(F.col("vec_id") % every == 0)
    anchors = cut_lineage(anchors.withColumn("anchor", F.monotonically_increasing_id()))
    kept = ["anchor", "label", *ROW]

    run, schema = searcher("positive")
    met = meet(anchor_blocks(anchors.select(*kept), "label", anchors_in_block, kept), blocks)
    found = met.select("_shelf", "_query_block", "block_label", "anchors", "items").mapInArrow(run, schema)
    best = W.partitionBy("anchor").orderBy(F.desc("score"), "positive_id")
    positives = found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= POSITIVES)
    positives = cut_lineage(positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_id", "score"))).alias("positives")))

    armed = anchors.select(*kept).join(positives, "anchor").withColumn("positive_scores", F.col("positives.score"))
    everywhere = blocks.select(
        F.lit("all").alias("_shelf"),
        F.xxhash64("_shelf", "_bucket").alias("_bucket"),
        blocks.agg(F.count("*")).scalar().alias("_blocks"),
        "items",
        "block_label",
    )
    run, schema = searcher("negative")
    met = meet(anchor_blocks(armed, None, anchors_in_block, [*kept, "positive_scores"]), everywhere)
    found = met.select("_shelf", "_query_block", "block_label", "anchors", "items").mapInArrow(run, schema)
    best = W.partitionBy("anchor", "nth").orderBy(F.desc("negative_score"), "negative_id")
    negatives = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= NEGATIVES)
    return (
        negatives.join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
        .join(positives, "anchor")
        .select(
            "anchor_id",
            F.get("positives", F.col("nth"))["positive_id"].alias("positive_id"),
            F.col("rank").cast("int").alias("rank"),
            "negative_id",
            F.get("positives", F.col("nth"))["score"].alias("positive_score"),
            "negative_score",
        )
    )
