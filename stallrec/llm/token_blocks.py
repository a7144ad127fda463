"""Token ids in files of patched frame-of-reference blocks.

A shard holds the documents of one range of doc_id, in order, as one stream of ids. Its rows
are segments: whole documents up to ``SEGMENT`` ids (a longer document is one segment, as
its text is one row). A segment's ids are cut into blocks of 128. A block stores its least
id as base, packs ids minus base at the bits that the 90th percentile needs, and lists the
ids that do not fit (place in the block, full difference) as exceptions. ``starts`` is the
index of the blocks' first bytes, so any id is found without reading what lies before it.

Block layout, little-endian: base uint32, width uint8, exceptions uint8, 2 bytes of zeros,
then 2 * width uint64 words of packed differences, then the exceptions' places (uint8) and
differences (uint32). The last block of a segment is padded with its base.

Files are Parquet, one file per task and the table's own columns around the binary payload,
so that they are written and read on any store Spark reaches.

Defined cases: a null or empty text has no ids but the end id; null doc_id sorts first;
rows with one doc_id stay together in any order and each keeps its own entry; extra columns
are not stored; an empty table gives an empty file set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallrec.llm.bpe import encoder
from stallrec.llm.common import arrow_schema, ddl

BLOCK = 128
SEGMENT = 1 << 18
PERCENTILE = 90
END_ID = 0
FIELDS = {
    "shard": "int",
    "segment": "int",
    "first": "long",
    "doc_ids": "array<long>",
    "lengths": "array<long>",
    "n_ids": "long",
    "starts": "array<long>",
    "payload": "binary",
}


def bits_of(values: np.ndarray) -> np.ndarray:
    """Bits each value needs."""
    return np.where(values > 0, np.floor(np.log2(np.maximum(values, 1))).astype(np.int64) + 1, 0)


def pack(rows: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 128) values under 2**width as (blocks, 2 * width) 64-bit words."""
    words = np.zeros((len(rows), 2 * width), np.uint64)
    for n in range(BLOCK if width else 0):
        word, shift = divmod(n * width, 64)
        words[:, word] |= rows[:, n] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= rows[:, n] >> np.uint64(64 - shift)
    return words


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    rows = np.zeros((len(words), BLOCK), np.uint64)
    low = np.uint64((1 << width) - 1)
    for n in range(BLOCK if width else 0):
        word, shift = divmod(n * width, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value |= words[:, word + 1] << np.uint64(64 - shift)
        rows[:, n] = value & low
    return rows


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(first byte of each block, payload)."""
    if not len(ids):
        return np.zeros(0, np.int64), b""
    n = -(-len(ids) // BLOCK)
    base = np.minimum.reduceat(ids, np.arange(0, len(ids), BLOCK))
    rows = np.repeat(base[:, None], BLOCK, axis=1)
    rows.reshape(-1)[: len(ids)] = ids
    rows = (rows - base[:, None]).astype(np.uint64)
    place = -(-BLOCK * PERCENTILE // 100) - 1
    widths = bits_of(np.partition(rows, place, axis=1)[:, place].astype(np.int64))
    over = (rows >> widths.astype(np.uint64)[:, None]) > 0
    extra = over.sum(axis=1)
    sizes = 8 + 16 * widths + 5 * extra
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    heads = np.zeros((n, 8), np.uint8)
    heads[:, :4] = base.astype("<u4").view(np.uint8).reshape(n, 4)
    heads[:, 4], heads[:, 5] = widths, extra
    out[starts[:, None] + np.arange(8)] = heads
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        fit = rows[at] & np.uint64((1 << int(width)) - 1)
        packed = pack(fit, int(width)).astype("<u8").view(np.uint8).reshape(len(at), -1)
        out[(starts[at] + 8)[:, None] + np.arange(packed.shape[1])] = packed
    block, slot = np.nonzero(over)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(extra) - extra, extra)
    tail = starts[block] + 8 + 16 * widths[block]
    out[tail + nth] = slot
    values = rows[block, slot].astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(tail + extra[block] + 4 * nth)[:, None] + np.arange(4)] = values
    return starts, out.tobytes()


def decode_blocks(starts: np.ndarray, payload: bytes, n_ids: int) -> np.ndarray:
    if not n_ids:
        return np.zeros(0, np.int64)
    data = np.frombuffer(payload, np.uint8)
    heads = data[starts[:, None] + np.arange(8)]
    base = np.ascontiguousarray(heads[:, :4]).view("<u4").astype(np.uint64).reshape(-1)
    widths, extra = heads[:, 4].astype(np.int64), heads[:, 5].astype(np.int64)
    rows = np.zeros((len(starts), BLOCK), np.uint64)
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        words = np.ascontiguousarray(data[(starts[at] + 8)[:, None] + np.arange(16 * int(width))]).view("<u8")
        rows[at] = unpack(words.reshape(len(at), -1), int(width))
    block = np.repeat(np.arange(len(starts)), extra)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(extra) - extra, extra)
    tail = starts[block] + 8 + 16 * widths[block]
    values = np.ascontiguousarray(data[(tail + extra[block] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    rows[block, data[tail + nth]] = values
    return (rows + base[:, None]).reshape(-1)[:n_ids].astype(np.int64)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write the ids of ``docs`` (doc_id, text), in doc_id order, as block files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        shard, segment, first = None, 0, 0
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal segment, first, held, size
            lengths = [len(ids) for _, ids in held]
            flat = np.concatenate([ids for _, ids in held])
            starts, payload = encode_blocks(flat)
            row = [[shard], [segment], [first], [[d for d, _ in held]], [lengths], [len(flat)], [starts], [payload]]
            segment, first, held, size = segment + 1, first + len(flat), [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array(v, type=t) for v, t in zip(row, arrow_schema(FIELDS).types)], schema=arrow_schema(FIELDS)
            )

        for batch in batches:
            if batch.num_rows:
                shard = batch.column(2)[0].as_py()
            # a few texts at a time: ids of a batch would be larger than its texts
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                flat, sizes = coder.ids(part.column(1).to_pylist())
                ends = np.cumsum(sizes)
                with_end = np.insert(flat.astype(np.int64), ends, end_id)
                for doc_id, ids in zip(part.column(0).to_pylist(), np.split(with_end, (ends + np.arange(1, len(ends) + 1))[:-1])):
                    if held and size + len(ids) > SEGMENT:
                        yield flush()
                    held.append((doc_id, ids))
                    size += len(ids)
        if held:
            yield flush()

    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ranged.withColumn("shard", F.spark_partition_id()).mapInArrow(run, ddl(FIELDS)).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids per document, from the files."""
    fields = {"doc_id": "long", "shard": "int", "in_shard": "long", "n_tokens": "long", "ids": "array<long>"}
    return _read(spark, path, fields, lambda ids, ends: [ids[a:b] for a, b in zip(np.r_[0, ends[:-1]], ends)])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, from the files."""
    fields = {"doc_id": "long", "shard": "int", "in_shard": "long", "n_tokens": "long", "ids_crc32": "long"}

    def digests(ids, ends):
        data = ids.astype("<u4").tobytes()
        return [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(np.r_[0, ends[:-1]], ends)]

    return _read(spark, path, fields, digests)


def _read(spark: SparkSession, path: str, fields: dict[str, str], digest) -> DataFrame:
    files = spark.read.schema(ddl(FIELDS)).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = {n: batch.column(k)[row] for k, n in enumerate(FIELDS)}
                n_ids = at["n_ids"].as_py()
                ids = decode_blocks(at["starts"].values.to_numpy(), at["payload"].as_py(), n_ids)
                lengths = at["lengths"].values.to_numpy()
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        at["doc_ids"].values,
                        pa.array(np.full(len(ends), at["shard"].as_py(), np.int32)),
                        pa.array(at["first"].as_py() + ends - lengths),
                        pa.array(lengths),
                        pa.array(digest(ids, ends), type=arrow_schema(fields).types[4]),
                    ],
                    schema=arrow_schema(fields),
                )

    # one row per shard, as many as the write had tasks
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.alias("a").join(totals.alias("b"), F.col("b.shard") < F.col("a.shard"), "left")
    offsets = before.groupBy("a.shard").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("offset"))
    last = list(fields)[4]
    return (
        files.mapInArrow(run, ddl(fields))
        .join(F.broadcast(offsets), "shard")
        .select("doc_id", (F.col("offset") + F.col("in_shard")).alias("start"), "n_tokens", last)
    )
