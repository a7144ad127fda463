"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints that differ in at most ``d`` bits agree wholly on some choice of ``m - d`` out
of ``m`` bit blocks, so equal values on one such choice bring every linked pair together;
``m`` follows from the number of distinct fingerprints, to keep such groups small at any
size. Inside a group, fingerprints are sorted by Gray rank and every 16 neighbors form a
node that holds the bits they share (mask and pattern), nodes form upper nodes likewise,
and a node's mask leaves out what its parent has compared. A search adds up the differences
along its path and drops a whole node as soon as they pass ``d``.

Copies have one fingerprint and are one row from the start. A group over ``CHUNK``
fingerprints is dealt into chunks, and every two chunks meet in a task of their own, so no
task holds more than two chunks. Groups emit a spanning forest, never their pairs.

Defined cases: null and empty texts and texts without a word have fingerprint zero, linked
like any other; a null doc_id keeps its row and never becomes a component id unless the
component has no other; repeated rows have equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallrec.llm.common import map_rows
from stallrec.llm.connected import components
from stallrec.session import cut_lineage

SHINGLE = 4
MAX_BITS = 4
SEED = 42
NODE = 16
CHUNK = 2048
GROUP = 256
QUERIES = 256
STRIDE = 1 << 15


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every ``size``-word shingle, repeats included; A-Z lower-cased first."""
    words = text.encode().lower().split() if text else []
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())],
        np.uint64,
    )


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """A bit is 1 if more than half the shingle hashes have it; as a signed 64-bit number."""
    hashes = shingle_hashes(text, size)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STRIDE):
        part = np.ascontiguousarray(hashes[at : at + STRIDE]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Add the column fp."""

    def start():
        return lambda columns: {"fp": [fingerprint(t, size) for t in columns["text"].to_pylist()]}

    return map_rows(docs, start, {"fp": "long"})


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence: every bit becomes the parity of those above."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def shared_bits(patterns: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, mask) of nodes over ``NODE`` children each: the bits all children have alike."""
    starts = np.arange(0, len(patterns), NODE)
    first = np.repeat(patterns[starts], np.diff(np.r_[starts, len(patterns)]))
    differ = np.bitwise_or.reduceat(patterns ^ first, starts)
    mask = np.bitwise_and.reduceat(masks, starts) & ~differ
    return patterns[starts] & mask, mask


class GrayIndex:
    """Hierarchy over fingerprints in Gray order; ``levels[0]`` are the fingerprints."""

    def __init__(self, fingerprints: np.ndarray):
        self.order = np.argsort(gray_rank(fingerprints), kind="stable")
        self.sorted = fingerprints[self.order]
        levels = [(self.sorted, np.full(len(self.sorted), ~np.uint64(0)))]
        while len(levels[-1][0]) > NODE:
            levels.append(shared_bits(*levels[-1]))
        # a node compares only what its parent has not
        self.levels = []
        for height, (pattern, mask) in enumerate(levels):
            rest = mask
            if height + 1 < len(levels):
                rest = mask & ~levels[height + 1][1][np.arange(len(mask)) // NODE]
            self.levels.append((pattern & rest, rest))

    def search(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(query position, sorted position) of all pairs at most ``most`` bits apart."""
        top = len(self.levels[-1][0])
        query = np.repeat(np.arange(len(queries)), top)
        node = np.tile(np.arange(top), len(queries))
        spent = np.zeros(len(query), np.uint8)
        for height in range(len(self.levels) - 1, -1, -1):
            pattern, mask = self.levels[height]
            spent = spent + np.bitwise_count((queries[query] & mask[node]) ^ pattern[node])
            near = spent <= most
            query, node, spent = query[near], node[near], spent[near]
            if height:
                children = np.minimum(NODE, len(self.levels[height - 1][0]) - node * NODE)
                query, spent = np.repeat(query, children), np.repeat(spent, children)
                first = np.repeat(np.cumsum(children) - children, children)
                node = np.repeat(node * NODE, children) + np.arange(len(query)) - first
        return query, node


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the classes of ``a[i]`` and ``b[i]``; the least label of a class wins."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        label = parent[label]


def spanning_links(fingerprints: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, representative) that join whatever pairs within ``most`` bits join."""
    index = GrayIndex(fingerprints)
    label = np.arange(len(fingerprints))
    for at in range(0, len(index.sorted), QUERIES):
        query, node = index.search(index.sorted[at : at + QUERIES], most)
        label = merge_labels(label, query + at, node)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return index.sorted[moved], index.sorted[label[moved]]


def block_masks(n: int, most: int = MAX_BITS, group: int = GROUP) -> list[int]:
    """Masks, as signed numbers, one of which any two linked fingerprints agree on wholly.

    With more fingerprints more blocks are cut, so that a mask keeps enough bits for groups
    of about ``group`` rows.
    """
    for blocks in range(most + 1, 2 * most + 1):
        keep = blocks - most
        if n >> (64 * keep // blocks) <= group:
            break
    cuts = [64 * b // blocks for b in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), keep):
        mask = sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def near_links(distinct: DataFrame, most: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """Columns a, b: links among the distinct fingerprints of column fp."""
    masks = block_masks(distinct.count(), most)
    keyed = distinct.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for n, m in enumerate(masks)])
        ).alias("k"),
    ).select("fp", "k.c", "k.v")
    sizes = keyed.groupBy("c", "v").agg(F.count("*").alias("n")).filter("n > 1")
    parts = sizes.select("c", "v", F.ceil(F.col("n") / chunk).alias("parts"))
    chunks = (
        keyed.join(parts, ["c", "v"])
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
        .groupBy("c", "v", "parts", "part")
        .agg(F.collect_list("fp").alias("fps"))
    )
    chunks = cut_lineage(chunks)
    single = chunks.filter("parts = 1").select("fps")
    met = (
        chunks.filter("parts > 1")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .groupBy("c", "v", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
        .agg(F.flatten(F.collect_list("fps")).alias("fps"))
        .select("fps")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                fps = np.unique(batch.column(0)[row].values.to_numpy().view(np.uint64))
                a, b = spanning_links(fps, most)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return single.unionByName(met).repartition(n, F.xxhash64("fps")).mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, size: int = SHINGLE, most: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs`` (doc_id, text)."""
    printed = cut_lineage(with_fingerprints(docs.select("doc_id", "text"), size).select("doc_id", "fp"))
    distinct = cut_lineage(printed.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(cut_lineage(near_links(distinct.select("fp"), most).distinct())).select(
        F.col("node").alias("fp"), "root"
    )
    rooted = cut_lineage(distinct.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return printed.join(classes, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, size: int = SHINGLE, most: int = MAX_BITS) -> DataFrame:
    """Of each component the document with the least doc_id, all its columns; repeated rows of
    it stay. Rows without doc_id cannot be told apart and stay."""
    gone = simhash_components(docs, size, most).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(cut_lineage(gone), "doc_id", "left_anti").select(*docs.columns)
