"""Substring dedup: every word covered by a 13-word window that also starts in an earlier document goes.

1. Anchors. Of the five-word runs in a window the one with the least hash is its anchor.
   Equal windows have equal anchors, and neighboring windows mostly share one, so about a
   fifth of all positions become rows. Anchors seen in two documents are kept.
2. Passages. Around every kept anchor the words of the windows it stands for (13 to 21) are
   a passage. Equal passages become one row with their least and greatest doc_id, so copies
   shrink before anything else is done.
3. Phrases. A window found in passages of two documents is a confirmed phrase, owned by the
   least doc_id. Shards of phrases, grouped by anchor and of bounded size, are compiled into
   Aho-Corasick automata over word numbers, and all passages of the shard's anchors are
   streamed through to locate every phrase in them. Neighboring windows with one owner are
   one phrase; words are characters there.
4. Passages hand their hits back to the documents they stand in, which drop the covered words.

An anchor in more than ``HOT`` different passages (a line common to many documents) is too
large for one shard: its windows are confirmed by a grouped sum, its phrases and its passages
are dealt into bounded parts and every part of one meets every part of the other.

Defined cases: null and empty texts have no words and keep none (the digest of the empty
text); texts under 13 words have no window and stay whole; rows without doc_id are compared
with nothing and stay whole; rows that share a doc_id count as one document and never remove
each other's words; other columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallrec.llm.common import ddl, int_lists, map_rows, split_words
from stallrec.session import cut_lineage

WINDOW = 13
GRAM = 5
HOT = 2000
SHARD = 4000
BUNDLE = 4000
#: Documents whose words are hashed together.
TOGETHER = 64
MIX = np.uint64(0x9E3779B97F4A7C15)


def release(df: DataFrame) -> None:
    """Let Spark remove the shuffle files of jobs whose results are written."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def anchors(
    docs: list[list[bytes]], window: int = WINDOW, gram: int = GRAM
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, anchor hash, first window, last window) of every run of windows with one anchor, over
    the words of several documents at once."""
    words = list(chain.from_iterable(docs))
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none, none, none
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    begins = np.cumsum(lengths) - lengths
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    runs = len(h) - gram + 1
    g = np.zeros(runs, np.uint64)
    for n in range(gram):
        g = g * MIX + h[n : n + runs]
    g ^= g >> np.uint64(29)
    g *= MIX
    g ^= g >> np.uint64(32)
    place = least_places(g, window - gram + 1)
    # windows that lie in one document; those of two documents have different places
    whole = np.flatnonzero(np.arange(len(place)) + window <= np.repeat(begins + lengths, lengths)[: len(place)])
    if not len(whole):
        return none, none, none, none
    place = place[whole]
    change = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    first, last = whole[change], whole[np.r_[change[1:], len(place)] - 1]
    doc = np.searchsorted(begins, first, "right") - 1
    return doc, g[place[change]].view(np.int64), first - begins[doc], last - begins[doc]


def least_places(g: np.ndarray, width: int) -> np.ndarray:
    """The leftmost place of the least value in every run of ``width`` values, by doubling."""
    place, covers = np.arange(len(g)), 1
    while covers < width:
        step = min(covers, width - covers)
        a, b = place[:-step], place[step:]
        place = np.where(g[b] < g[a], b, a)
        covers += step
    return place


def digest_words(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, whole_sha256, anchors (distinct) of every row."""

    def distinct(docs):
        doc, hashes, _, _ = anchors(docs)
        order = np.lexsort((hashes, doc))
        doc, hashes = doc[order], hashes[order]
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])][: len(doc)])
        return hashes[new], np.bincount(doc[new], minlength=len(docs))

    def start():
        def make(columns):
            ids, texts = columns["doc_id"].to_pylist(), columns["text"].to_pylist()
            counts, shas, found, sizes = [], [], [], []
            for at in range(0, len(ids), TOGETHER):
                docs = [split_words(t) for t in texts[at : at + TOGETHER]]
                counts += map(len, docs)
                shas += map(digest_words, docs)
                hashes, each = distinct([d if i is not None else [] for d, i in zip(docs, ids[at : at + TOGETHER])])
                found.append(hashes)
                sizes.append(each)
            none = [np.zeros(0, np.int64)]
            lists = int_lists(np.concatenate(found or none), np.concatenate(sizes or none))
            return {"n_words": counts, "whole_sha256": shas, "anchors": lists}

        return make

    added = {"n_words": "long", "whole_sha256": "string", "anchors": "array<long>"}
    return map_rows(docs.select("doc_id", "text"), start, added).drop("text")


PASSAGE = {"doc_id": "long", "start": "int", "anchor": "long", "passage": "string"}


def passage_id():
    """Stands for the text of a passage; made where it is read, since it does not pack."""
    return F.xxhash64("passage").alias("passage_id")


def passages(touched: DataFrame) -> DataFrame:
    """A row per passage around a kept anchor, from rows (doc_id, text, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                docs = [split_words(text) for text in part.column(1).to_pylist()]
                doc, hashes, first, last = anchors(docs)
                # an anchor that one document keeps is kept by all that have it
                met = np.flatnonzero(np.isin(hashes, part.column(2).flatten().to_numpy()))
                if not len(met):
                    continue
                doc, hashes, first, last = doc[met], hashes[met], first[met], last[met]
                words = list(chain.from_iterable(docs))
                joined = b" ".join(words)
                begins = np.cumsum(np.r_[0, np.fromiter(map(len, words), np.int64, len(words)) + 1])
                lengths = np.fromiter(map(len, docs), np.int64, len(docs))
                before = (np.cumsum(lengths) - lengths)[doc]
                mine = [joined[a:b] for a, b in zip(begins[before + first].tolist(), (begins[before + last + WINDOW] - 1).tolist())]
                columns = [
                    part.column(0).take(pa.array(doc)),
                    pa.array(first.astype(np.int32)),
                    pa.array(hashes),
                    pa.array(mine, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=list(PASSAGE))

    return touched.select("doc_id", "text", "kept").mapInArrow(run, ddl(PASSAGE))


#: Stands between passages, in no phrase.
GAP = "\0"


def lettered(texts: list[str]) -> list[str]:
    """Words joined by spaces as one character each, the same for equal words. The gap and surrogates are left out."""
    words = pc.split_pattern(pa.array(texts, pa.string()), " ")
    code = words.flatten().dictionary_encode().indices.to_numpy().astype("<u4") + 1
    code[code >= 0xD800] += 0x800
    letters, ends = code.tobytes().decode("utf-32-le"), words.offsets.to_pylist()
    return [letters[a:b] for a, b in zip(ends, ends[1:])]


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    """Finds phrases (texts of a character per word) and says which it is."""
    built = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for number, phrase in enumerate(phrases):
        built.add_word(phrase, number)
    built.make_automaton()
    return built


def locate(phrases: dict[str, int], streams: list[str]) -> tuple[np.ndarray, ...]:
    """(stream, first window, windows, owner) of every phrase in the streams, in their order."""
    met = automaton(list(phrases)).iter(GAP.join(streams)) if phrases else ()
    ends, which = np.fromiter(chain.from_iterable(met), np.int64).reshape(-1, 2).T
    lengths = np.fromiter(map(len, phrases), np.int64, len(phrases))[which]
    owners = np.fromiter(phrases.values(), np.int64, len(phrases))[which]
    sizes = np.fromiter(map(len, streams), np.int64, len(streams)) + 1
    begins = np.cumsum(sizes) - sizes
    stream = np.searchsorted(begins, ends, "right") - 1
    return stream, ends - lengths + 1 - begins[stream], lengths - (WINDOW - 1), owners


HITS = "anchor long, passage_id long, offsets array<int>, counts array<int>, owners array<long>"


def _hits_batch(rows: list[tuple], hits: tuple[np.ndarray, ...]) -> pa.RecordBatch | None:
    """The hits of rows (anchor, passage_id, ...), one row per passage that has any."""
    stream, offsets, counts, owners = hits
    each = np.bincount(stream, minlength=len(rows))
    met = np.flatnonzero(each)
    if not len(met):
        return None
    keys = [pa.array([rows[n][c] for n in met.tolist()], pa.int64()) for c in (0, 1)]
    lists = [int_lists(v, each[met]) for v in (offsets.astype(np.int32), counts.astype(np.int32), owners)]
    return pa.RecordBatch.from_arrays([*keys, *lists], names=["anchor", "passage_id", "offsets", "counts", "owners"])


def confirmed_runs(streams: list[str], seen: dict[str, tuple[int, int]]) -> dict[str, int]:
    """Owners of the confirmed phrases. Neighboring windows of a stream that have one owner are one
    phrase; ``seen`` knows the least and greatest doc_id of every window."""
    phrases: dict[str, int] = {}
    for stream in streams:
        begin, owner = 0, None
        for at in range(len(stream) - WINDOW + 1):
            low, high = seen[stream[at : at + WINDOW]]
            now = low if low < high else None
            if now != owner:
                if owner is not None:
                    phrases[stream[begin : at + WINDOW - 1]] = owner
                begin, owner = at, now
        if owner is not None:
            phrases[stream[begin:]] = owner
    return phrases


def _shard_hits(shard: list[tuple]) -> pa.RecordBatch | None:
    """Confirm phrases among whole anchors' passages (anchor, passage_id, passage, least, greatest) and locate them."""
    streams = lettered([row[2] for row in shard])
    seen: dict[str, tuple[int, int]] = {}
    for row, stream in zip(shard, streams):
        own = low, high = row[3], row[4]
        for at in range(len(stream) - WINDOW + 1):
            phrase = stream[at : at + WINDOW]
            known = seen.setdefault(phrase, own)
            if known is not own and (low < known[0] or high > known[1]):
                seen[phrase] = (min(known[0], low), max(known[1], high))
    return _hits_batch(shard, locate(confirmed_runs(streams, seen), streams))


def _columns(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*[c.to_pylist() for c in batch.columns]))


def cold_hits(distinct: DataFrame) -> DataFrame:
    """Hits of anchors whose passages fit into one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple] = []
        for batch in batches:
            for row in _columns(batch):
                if len(shard) >= SHARD and row[0] != shard[-1][0]:
                    out = _shard_hits(shard)
                    if out is not None:
                        yield out
                    shard = []
                shard.append(row)
        out = _shard_hits(shard) if shard else None
        if out is not None:
            yield out

    ordered = distinct.select("anchor", "passage", "least", "greatest").repartition("anchor").sortWithinPartitions("anchor")
    return ordered.select("anchor", passage_id(), "passage", "least", "greatest").mapInArrow(run, HITS)


def hot_hits(distinct: DataFrame) -> DataFrame:
    """Hits of anchors with too many passages for a shard."""
    distinct = distinct.withColumn("passage_id", passage_id())
    words = F.split("passage", " ")
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    phrases = distinct.select(
        "anchor",
        F.explode(F.transform(starts, lambda n: F.array_join(F.slice(words, n, F.lit(WINDOW)), " "))).alias("phrase"),
        "least",
        "greatest",
    )
    confirmed = (
        phrases.groupBy("anchor", "phrase")
        .agg(F.min("least").alias("owner"), F.max("greatest").alias("other"))
        .filter("owner < other")
        .select("anchor", F.struct("phrase", "owner").alias("p"))
    )
    confirmed = cut_lineage(confirmed)

    def dealt(rows: DataFrame, value: str, size: int, part: str) -> DataFrame:
        parts = rows.groupBy("anchor").agg(F.ceil(F.count("*") / size).alias("_parts"))
        numbered = rows.join(parts, "anchor").withColumn(part, F.pmod(F.xxhash64(value), F.col("_parts")))
        return numbered.groupBy("anchor", part).agg(F.collect_list(value).alias(value + "s"))

    streams = dealt(distinct.select("anchor", F.struct("passage_id", "passage").alias("s")), "s", BUNDLE, "_stream")
    shards = dealt(confirmed, "p", SHARD, "_shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                anchor = batch.column(0)[row].as_py()
                owned, met = (batch.column(n)[row].as_py() for n in (1, 2))
                texts = lettered([p["phrase"] for p in owned] + [s["passage"] for s in met])
                known = dict(zip(texts, (p["owner"] for p in owned)))
                out = _hits_batch([(anchor, s["passage_id"]) for s in met], locate(known, texts[len(owned) :]))
                if out is not None:
                    yield out

    pairs = shards.join(streams, "anchor").select("anchor", "ps", "ss", "_shard", "_stream")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(n, F.xxhash64("anchor", "_shard", "_stream")).select("anchor", "ps", "ss").mapInArrow(run, HITS)


REMOVED = {"n_removed": "long", "kept_sha256": "string", "kept_text": "string"}


def covered(n_words: int, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window of the runs of ``counts`` windows that start at ``starts``."""
    change = np.zeros(n_words + 1, np.int64)
    counts = np.minimum(counts, n_words - (WINDOW - 1) - starts)
    starts, counts = starts[counts > 0], counts[counts > 0]
    np.add.at(change, starts, 1)
    np.add.at(change, starts + counts + (WINDOW - 1), -1)
    return np.cumsum(change)[:-1] > 0


def with_removed(touched: DataFrame) -> DataFrame:
    """Add n_removed, kept_sha256 and kept_text (kept words joined by one space) to rows with text and runs of windows."""

    def one(text, runs):
        words = split_words(text)
        gone = covered(len(words), *divmod(runs.values.to_numpy(), WINDOW))
        left = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
        return int(gone.sum()), hashlib.sha256(left).hexdigest(), left.decode()

    def start():
        def make(columns):
            rows = [one(t, s) for t, s in zip(columns["text"].to_pylist(), columns["runs"])]
            return {n: [r[k] for r in rows] for k, n in enumerate(REMOVED)}

        return make

    return map_rows(touched, start, REMOVED)


def find_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all rows: doc_id, n_words, whole_sha256; changed documents: doc_id, text, runs of removed windows)."""
    marked = cut_lineage(marks(docs))
    pairs = marked.select("doc_id", F.explode("anchors").alias("anchor"))
    shared = pairs.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor")
    shared = cut_lineage(shared)
    release(docs)
    kept = pairs.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("kept"))
    kept = cut_lineage(kept)
    release(docs)
    # in the order of the documents, where neighboring passages overlap and are packed well
    found = cut_lineage(passages(docs.select("doc_id", "text").join(kept, "doc_id")), "zstd")
    release(docs)
    distinct = found.groupBy("anchor", "passage").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest")
    )
    distinct = cut_lineage(distinct, "zstd")
    release(docs)
    hot = distinct.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("anchor")
    hot = cut_lineage(hot)
    hits = cut_lineage(
        cold_hits(distinct.join(hot, "anchor", "left_anti")).unionByName(hot_hits(distinct.join(hot, "anchor", "left_semi"))),
        "zstd",
    )
    release(docs)
    # the first window and how many follow, under WINDOW, as one number
    run = (F.col("start") + F.col("h.offsets")).cast("long") * WINDOW + F.col("h.counts")
    runs = (
        found.select("doc_id", "start", "anchor", passage_id())
        .join(hits, ["anchor", "passage_id"])
        .select("doc_id", "start", F.explode(F.arrays_zip("offsets", "counts", "owners")).alias("h"))
        .filter("h.owners < doc_id")
        .groupBy("doc_id")
        .agg(F.collect_set(run).alias("runs"))
    )
    runs = cut_lineage(runs)
    release(docs)
    return marked, docs.select("doc_id", "text").join(runs, "doc_id")


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    marked, changed = find_repeats(docs)
    removed = cut_lineage(with_removed(changed).select("doc_id", "n_removed", "kept_sha256").distinct())
    return marked.join(removed, "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the text of changed documents replaced by their kept words joined by one space."""
    _, changed = find_repeats(docs)
    new = cut_lineage(with_removed(changed).select("doc_id", F.col("kept_text").alias("_kept")).distinct())
    met = docs.join(new, "doc_id", "left")
    return met.select(*[F.coalesce("_kept", "text").alias("text") if c == "text" else F.col(c) for c in docs.columns])
