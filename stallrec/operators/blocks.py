"""Bounded blocks of rows for work that meets every query row with every item.

Distances, dot products and predicate ladders need many (row, item) evaluations but
few results. Rows are packed into blocks of bounded size, blocks are joined on an
equality key, and a numpy kernel turns each pair of blocks into its best ``k`` rows.
No (row, item) pair is ever a Spark row, no task holds more than two blocks plus its
running best rows, and nothing is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK = 512
ITEM_BLOCK = 8192
#: Blocks of either side that one cell of the grid holds at most, up to ``GRID`` cells a side.
CELL_QUERIES = 4
CELL_ITEMS = 4
#: Cells a side of a shelf's grid at most: how often a row is copied, whatever the shelf holds.
GRID = 20


def pack(df: DataFrame, shelf: str | None, key: str, size: int, columns: Sequence[str], name: str) -> DataFrame:
    """One row per (_shelf, _bucket) with about ``size`` rows as an array of structs.

    Buckets are digests of a unique key, as many as the shelf's row count asks for, so a
    block stays small on a hot shelf and is not split up on a rare one. Without a
    ``shelf`` column all rows share one. ``_blocks`` is the number of buckets of the shelf.
    """
    if shelf is None:
        parts = df.agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).alias("b")).scalar()
        dealt_out = df.select("*", F.lit("all").alias("_shelf"), parts.alias("_parts"), F.pmod(F.xxhash64(key), parts).alias("_bucket"))
    else:
        shelved = df.withColumn("_shelf", F.col(shelf).cast("string"))
        parts = shelved.groupBy("_shelf").agg(F.ceil(F.count("*") / size).alias("_parts"))
        dealt_out = shelved.join(parts, "_shelf").withColumn("_bucket", F.pmod(F.xxhash64(key), F.col("_parts")))
    return dealt_out.groupBy("_shelf", "_bucket").agg(
        F.max("_parts").cast("bigint").alias("_blocks"), F.collect_list(F.struct(*columns)).alias(name)
    )


def meet(queries: DataFrame, items: DataFrame, grid: int | None = None) -> DataFrame:
    """Join packed query blocks to packed item blocks of the same shelf.

    The pairs of blocks of a shelf are a grid, cut into cells of ``CELL_QUERIES`` x
    ``CELL_ITEMS`` blocks, larger ones where that would make more than ``grid`` cells a side.
    Query blocks repeat once per column of cells and item blocks once per row, so what is
    shuffled grows with the rows, not with the pairs of blocks.
    """
    grid = grid or GRID

    def cells(blocks, size: int):
        return F.least(F.ceil(blocks / size), F.lit(grid)).cast("bigint")

    rows = queries.groupBy("_shelf").agg(cells(F.max("_blocks"), CELL_QUERIES).alias("_rows"))
    columns = items.groupBy("_shelf").agg(cells(F.max("_blocks"), CELL_ITEMS).alias("_columns"))
    # one row per shelf
    q = queries.join(columns, "_shelf").select(
        *[F.col(c).alias("_query_block" if c == "_bucket" else c) for c in queries.columns if c != "_blocks"],
        F.pmod("_bucket", cells(F.col("_blocks"), CELL_QUERIES)).alias("_row"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_columns") - 1)).alias("_column"),
    )
    i = items.join(rows, "_shelf").select(
        *[F.col(c).alias("_item_block" if c == "_bucket" else c) for c in items.columns if c != "_blocks"],
        F.pmod("_bucket", cells(F.col("_blocks"), CELL_ITEMS)).alias("_column"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_rows") - 1)).alias("_row"),
    )
    cell = ("_shelf", "_row", "_column")
    # merged, so that the partners of a query block come one after the other and nothing is broadcast
    return dealt(q, *cell).hint("merge").join(dealt(i, *cell), list(cell))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Spread block rows over all tasks. They are few and small beside the work they
    cause, so without a set number of partitions the adaptive planner would merge them. Dealt by
    the very keys of the join that follows, which then needs no shuffle of its own."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def fields(batch: pa.RecordBatch, column: str, row: int) -> dict[str, pa.Array]:
    """The structs of one list cell as a column per field."""
    array = batch.column(batch.schema.get_field_index(column))[row].values
    return dict(zip([f.name for f in array.type], array.flatten()))


def numbers(array: pa.Array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False)


def codes(array: pa.Array) -> tuple[np.ndarray, dict]:
    """Integer codes of an array and the code of each value."""
    enc = array.dictionary_encode()
    return numbers(enc.indices), {v: n for n, v in enumerate(enc.dictionary.to_pylist())}


def recode(array: pa.Array, known: dict) -> np.ndarray:
    """Codes under another array's dictionary; unknown values become -1."""
    enc = array.dictionary_encode()
    table = np.array([known.get(v, -1) for v in enc.dictionary.to_pylist()] or [-1])
    return table[numbers(enc.indices)]


def best_rows(group: np.ndarray, order: Sequence[np.ndarray], limit: np.ndarray) -> np.ndarray:
    """Indices of the first ``limit`` rows of each group, ``order`` from major to minor."""
    at = np.lexsort((*reversed(list(order)), group))
    g = group[at]
    start = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(start, np.arange(len(g)), 0)) if len(g) else g
    return at[np.arange(len(g)) - first < limit[at]]


def first_hits(hit: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first ``limit`` hits of each row, left to right. Rows leave as
    soon as they are full, so a dense row costs a few columns."""
    rows = np.arange(len(hit))
    left = limit.astype(np.int64).copy()
    start, width, found = 0, 128, []
    while start < hit.shape[1] and len(rows):
        part = hit[rows, start : start + width]
        part &= np.cumsum(part, axis=1, dtype=np.int32) <= left[rows][:, None]
        r, c = np.nonzero(part)
        found.append((rows[r], c + start))
        left[rows] -= np.bincount(r, minlength=len(rows))
        rows = rows[left[rows] > 0]
        start, width = start + width, width * 4
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


Kernel = Callable[[pa.RecordBatch, int], dict[str, np.ndarray]]
Trim = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]


def carried_mapper(run_key: str, kernel, schema: pa.Schema):
    """Like ``block_mapper`` for a kernel that takes what the pairs of the same query block have
    given so far and returns that with its own rows, or None where it cannot add to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        current = None
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(run_key))
            for row in range(batch.num_rows):
                key = keys[row].as_py()
                out = kernel(batch, row, held) if held is not None and key == current else None
                if out is None:
                    if held is not None:
                        yield pa.RecordBatch.from_pydict(held, schema=schema)
                    out = kernel(batch, row, None)
                held, current = out, key
        if held is not None:
            yield pa.RecordBatch.from_pydict(held, schema=schema)

    return run


def block_mapper(run_key: str, kernel: Kernel, trim: Trim, schema: pa.Schema):
    """An Arrow mapper: kernel per block pair, ``trim`` over pairs of one query block.

    Pairs of one query block that follow each other are combined before they leave the
    task, as a map-side combine does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        current = None
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(run_key))
            for row in range(batch.num_rows):
                key = keys[row].as_py()
                out = kernel(batch, row)
                if held is not None and key == current:
                    out = {c: np.concatenate([held[c], out[c]]) for c in out}
                elif held is not None:
                    yield pa.RecordBatch.from_pydict(held, schema=schema)
                held, current = trim(out), key
        if held is not None:
            yield pa.RecordBatch.from_pydict(held, schema=schema)

    return run
