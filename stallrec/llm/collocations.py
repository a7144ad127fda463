"""Collocations by prefix-free parsing: phrases are counted in distinct chunks, not in the texts.

1. Parse. A text is its words with a border sign between pieces and two border signs at its
   end. A chunk begins at the text's start and wherever the hash of two neighboring words says
   so, and ends with the two words that begin the next chunk (or with the end signs). Equal
   passages are cut alike, whatever stands around them, so copies and repeated passages give
   equal chunks.
2. Dictionary. Chunks are counted in the tasks, then over all of them: a row per distinct
   chunk and language with its parse frequency.
3. Count. In every distinct chunk the phrases of one to three words are counted, each as often
   as the chunk occurs. Chunks overlap by two words; a phrase belongs to the chunk in which it
   begins before the overlap, where all of it lies, so it is counted once. Most phrases are
   rare and need no exact count: words and pairs are first counted by a hash, which never
   counts too few, and only those whose hash is frequent enough, and triples of two such pairs,
   are counted as what they are. The frequent hashes travel as bits, at most ``BITS`` of
   them; with more frequent phrases than that some rare ones are counted too, and dropped.
4. Score. Both parts of every cut of a candidate are looked up. A part that makes up at least
   one in ``SHARE`` of all words can belong to any number of candidates, but there are at
   most ``SHARE`` such words and as many such pairs: these are broadcast. Any other part has
   few candidates, since each takes ten of its occurrences, and is joined by shuffle.

Scores are decimals of 38 digits, exact for counts below 10**16.

Defined cases: null and empty texts have no words; a null language is ``und``, together with
rows that say so; repeated rows count each; whole texts are read however long; ties are in
byte order of the phrase; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallrec.llm.common import arrow_schema, ddl
from stallrec.session import cut_lineage

LONGEST = 3
LEAST = 10
FIRST = 2000
SHARE = 4096
#: Every so many pairs of words one begins a chunk, on average.
SPACING = 32
#: No text has this byte; it stands between pieces, and twice at the end of a text.
BORDER = b"\xff"
OVERLAP = LONGEST - 1
#: Runs of what ends a piece, with blanks among them.
ENDS = re.compile(rb"[.,;:!?\n-\r][ \t.,;:!?\n-\r]*")
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Chunks, and their bytes, that a task counts before it hands them on.
HELD = 200_000
HELD_BYTES = 1 << 25
#: Bytes of distinct chunks in which phrases are counted at once.
COUNTED = 1 << 23
#: Bits of the frequent hashes, per hash, at least and at most, and in one row.
SPREAD = 16
FEWEST = 1 << 16
BITS = 1 << 28
PIECE = 1 << 16
#: Shares of a language that are ranked alone before its best are.
SHARES = 64


def marked_words(text: str) -> list[bytes]:
    """Words in lower case (A-Z only) with border signs; no word holds a blank."""
    words = ENDS.sub(b" " + BORDER + b" ", text.encode().lower()).split()
    return [*words, BORDER, BORDER] if words else words


def chunk_starts(hashes: np.ndarray, spacing: int) -> np.ndarray:
    """Whether each place but the last has two words that begin a chunk."""
    pair = (hashes[:-1] * MIX) ^ hashes[1:]
    pair *= MIX
    return (pair >> np.uint64(32)) % np.uint64(spacing) == 0


class Hashes(dict):
    """Hash of every word met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def chunks(words: list[bytes], hashes: Hashes, spacing: int = SPACING) -> list[bytes]:
    """The parse of one text."""
    if not words:
        return []
    digests = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    last = len(words) - OVERLAP
    begin = np.flatnonzero(chunk_starts(digests, spacing))
    begin = begin[(begin > 0) & (begin < last)].tolist()
    return [b" ".join(words[a : b + OVERLAP]) for a, b in zip([0, *begin], [*begin, last])]


PARSE = {"lang": "string", "chunk": "binary", "n": "long"}


def parse(docs: DataFrame, spacing: int = SPACING) -> DataFrame:
    """lang, chunk, n: chunks as the tasks counted them."""

    def out(counts: dict[tuple[str, bytes], int]) -> Iterator[pa.RecordBatch]:
        keys = list(counts)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            columns = [[k[0] for k in part], [k[1] for k in part], [counts[k] for k in part]]
            schema = arrow_schema(PARSE)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, bytes], int] = {}
        hashes, size = Hashes(), 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                for chunk in chunks(marked_words(text), hashes, spacing):
                    key = (lang, chunk)
                    seen = counts.get(key)
                    if seen is None:
                        counts[key] = 1
                        size += len(chunk)
                    else:
                        counts[key] = seen + 1
                if len(counts) > HELD or size > HELD_BYTES:
                    yield from out(counts)
                    counts, size = {}, 0
                if len(hashes) > HELD:
                    hashes = Hashes()
        yield from out(counts)

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    return docs.select(lang, "text").mapInArrow(run, ddl(PARSE))


def dictionary(parsed: DataFrame) -> DataFrame:
    """lang, chunk, n: distinct chunks with their parse frequency."""
    return parsed.groupBy("lang", "chunk").agg(F.sum("n").alias("n"))


def sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place of every distinct key, its total weight, the number of each key)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(keys) else np.zeros(0, bool)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    totals = np.add.reduceat(weights[order], at) if len(at) else np.zeros(0, np.int64)
    return order[at], totals, number


class Words:
    """The words of distinct chunks as codes, and where their phrases begin."""

    def __init__(self, chunked: pa.Table):
        lang = chunked["lang"].combine_chunks().dictionary_encode()
        lists = pc.split_pattern(chunked["chunk"].combine_chunks().cast(pa.large_binary()), b" ")
        coded = lists.values.dictionary_encode()
        sizes = np.diff(lists.offsets.to_numpy())
        self.dictionary, self.langs = coded.dictionary, lang.dictionary
        self.word = coded.indices.to_numpy()
        self.lang = np.repeat(lang.indices.to_numpy(), sizes)
        self.weight = np.repeat(chunked["n"].to_numpy(), sizes)
        words = self.dictionary.to_pylist()
        self.border = words.index(BORDER) if words else 0
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))[self.word]
        of_lang = [xxhash.xxh64_intdigest(x.encode(), 1) for x in self.langs.to_pylist()]
        spoken = np.array(of_lang, np.uint64)[self.lang]
        #: hash of the word, and of the pair of words, that begins at each place
        self.one = mixed(hashes ^ spoken)
        self.two = mixed(self.one * MIX + np.append(hashes[1:], np.uint64(0)))
        ends = np.repeat(np.cumsum(sizes), sizes)
        places = np.arange(len(self.word))
        # only what begins before the overlap with the next chunk
        self.begin = places[(places < ends - OVERLAP) & (self.word != self.border)]

    def going_on(self, at: np.ndarray, size: int) -> np.ndarray:
        """Of the places, whether a phrase of ``size`` words begins there if one of a word less does."""
        return self.word[at + size - 1] != self.border

    def phrases(self, at: np.ndarray, size: int) -> pa.Array:
        parts = [self.dictionary.take(pa.array(self.word[at + n])) for n in range(size)]
        return pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string()).cast(pa.string())


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def held_chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Words]:
    """Rows (lang, chunk, n) gathered until the chunks have so many bytes."""
    held, total = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            held.append(batch.slice(at, 2000))
            total += pc.sum(pc.binary_length(held[-1].column(1))).as_py() or 0
            if total >= size:
                yield Words(pa.Table.from_batches(held))
                held, total = [], 0
    if total:
        yield Words(pa.Table.from_batches(held))


def hash_counts(chunked: DataFrame) -> DataFrame:
    """h, n: occurrences of all words and pairs of words by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in held_chunks(batches, COUNTED):
            pairs = met.begin[met.going_on(met.begin, 2)]
            keys = np.concatenate([met.one[met.begin], met.two[pairs]]).view(np.int64)
            at, totals, _ = sums(keys, np.concatenate([met.weight[met.begin], met.weight[pairs]]))
            for start in range(0, len(at), 100_000):
                part = slice(start, start + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[at[part]]), pa.array(totals[part])], names=["h", "n"])

    return chunked.select("lang", "chunk", "n").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def frequent_bits(chunked: DataFrame, least: int) -> np.ndarray:
    """One bit per slot of hashes: whether a word or pair of that slot may occur ``least`` times."""
    frequent = cut_lineage(hash_counts(chunked).filter(F.col("n") >= least).select("h"))
    size = FEWEST
    while size < BITS and size < SPREAD * frequent.count():
        size *= 2
    slot = F.col("h").bitwiseAND(F.lit(size - 1))
    pieces = frequent.select(slot.alias("slot")).groupBy(F.expr(f"slot div {PIECE}").alias("piece")).agg(F.collect_set("slot").alias("slots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for slots in batch.column(1):
                piece = np.zeros(PIECE, bool)
                piece[slots.values.to_numpy() % PIECE] = True
                bits.append(np.packbits(piece, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["piece", "bits"])

    out = np.zeros(size // 8, np.uint8)
    made = pieces.mapInArrow(run, "piece long, bits binary").toArrow()
    for piece, bits in zip(made["piece"].to_pylist(), made["bits"].to_pylist()):
        out[piece * PIECE // 8 : (piece + 1) * PIECE // 8] = np.frombuffer(bits, np.uint8)
    return out


def in_bits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


GRAM = {"lang": "string", "words": "int", "phrase": "string", "n": "long"}


def count_phrases(met: Words, bits: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """lang, words, phrase, n in distinct chunks; zero words: all words of the language.

    With ``bits``, words and pairs whose hash is rare are left out, and triples of which a
    pair is.
    """
    schema = arrow_schema(GRAM)

    def out(lang: np.ndarray, size: int, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        names = met.langs.take(pa.array(lang))
        return pa.RecordBatch.from_arrays([names, pa.array(np.full(len(n), size, np.int32)), phrase, pa.array(n)], schema=schema)

    total = np.zeros(len(met.langs), np.int64)
    np.add.at(total, met.lang[met.begin], met.weight[met.begin])
    yield out(np.arange(len(total)), 0, pa.array([""] * len(total)), total)
    if bits is None:
        one = two = np.ones(len(met.word), bool)
    else:
        one, two = in_bits(bits, met.one), in_bits(bits, met.two)
    at = met.begin[one[met.begin]]
    number = met.lang[at].astype(np.int64)
    for size in range(1, LONGEST + 1):
        if size > 1:
            inside = met.going_on(at, size) & two[at + size - 2]
            at, number = at[inside], number[inside]
        where, totals, number = sums(number * len(met.dictionary) + met.word[at + size - 1], met.weight[at])
        first = at[where]
        for start in range(0, len(first), 100_000):
            some = first[start : start + 100_000]
            yield out(met.lang[some], size, met.phrases(some, size), totals[start : start + 100_000])


def phrases(chunked: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, words, phrase, f over the whole dictionary; words 0 is the language's number of
    words. Phrases that occur less than ``least`` times are missing or have f below it."""
    bits = chunked.sparkSession.sparkContext.broadcast(frequent_bits(chunked, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in held_chunks(batches, COUNTED):
            yield from count_phrases(met, bits.value)

    counted = chunked.select("lang", "chunk", "n").mapInArrow(run, ddl(GRAM))
    return counted.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f"))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), exact."""
    big = [c.cast("decimal(19,0)") for c in (a, left, right)]
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * (big[0] * big[0]), big[1] * big[2])


def cuts(words: Column) -> Column:
    """(cut, side, part) of every cut of two or three words."""

    def part(first: int, size: int) -> Column:
        return F.array_join(F.slice(words, first, size), " ")

    def at(cut: int, side: str, text: Column) -> Column:
        return F.struct(F.lit(cut).alias("cut"), F.lit(side).alias("side"), text.alias("part"))

    two = F.array(at(1, "l", part(1, 1)), at(1, "r", part(2, 1)))
    three = F.array(at(1, "l", part(1, 1)), at(1, "r", part(2, 2)), at(2, "l", part(1, 2)), at(2, "r", part(3, 1)))
    return F.when(F.size(words) == 2, two).otherwise(three)


def scored(grams: DataFrame) -> DataFrame:
    """lang, words, phrase, a, l, r, score of all candidates, from phrases found ``LEAST`` times or more."""
    candidates = grams.filter("words >= 2").select("lang", "words", "phrase", F.col("f").alias("a"))
    wanted = candidates.select("lang", "phrase", "a", "words", F.explode(cuts(F.split("phrase", " "))).alias("c"))
    wanted = wanted.select("lang", "phrase", "a", "words", "c.cut", "c.side", "c.part")
    parts = grams.filter("words in (1, 2)").select("lang", F.col("phrase").alias("part"), "f")
    total = grams.filter("words = 0").agg(F.sum("f")).scalar()
    # at most SHARE words and SHARE pairs of words
    hot = F.broadcast(parts.filter(F.col("f") * SHARE >= total))
    found = wanted.join(hot, ["lang", "part"]).unionByName(
        wanted.join(hot.drop("f"), ["lang", "part"], "left_anti").join(parts.filter(F.col("f") * SHARE < total), ["lang", "part"])
    )

    def side(cut: int, which: str) -> Column:
        return F.max(F.when((F.col("cut") == cut) & (F.col("side") == which), F.col("f")))

    sides = {f"{s}{c}": side(c, s) for c in (1, 2) for s in "lr"}
    met = found.groupBy("lang", "words", "phrase", "a").agg(*[c.alias(n) for n, c in sides.items()])

    def one(cut: int) -> Column:
        left, right = F.col(f"l{cut}"), F.col(f"r{cut}")
        made = F.struct(score(F.col("a"), left, right).alias("score"), F.lit(cut).alias("cut"), left.alias("l"), right.alias("r"))
        return F.when(left.isNotNull(), made)

    least = met.withColumn("best", F.array_min(F.array(one(1), one(2))))
    return least.select("lang", "words", "phrase", "a", "best.l", "best.r", "best.score")


def maximal(candidates: DataFrame) -> DataFrame:
    """Without the pairs of words that stand inside a triple at least half as frequent."""
    words = F.split("phrase", " ")
    inside = F.array(F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 2, 2), " "))
    longer = candidates.filter("words = 3").select("lang", F.explode(inside).alias("phrase"), F.col("a").alias("f"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    met = candidates.join(longer, ["lang", "phrase"], "left")
    return met.filter((F.col("words") == LONGEST) | F.col("longer").isNull() | (100 * F.col("longer") < 50 * F.col("a"))).drop("longer")


def first_of_language(rows: DataFrame, first: int) -> DataFrame:
    """The best of each language, taken from the best of shares of it, so no task ranks a whole language."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    shared = rows.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    shared = shared.withColumn("rank", F.row_number().over(W.partitionBy("lang", "_share").orderBy(*order)))
    shared = shared.filter(F.col("rank") <= first).drop("_share", "rank")
    return shared.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= first)


def collocations(docs: DataFrame, first: int = FIRST, spacing: int = SPACING) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    counted = phrases(cut_lineage(dictionary(parse(docs, spacing))))
    grams = cut_lineage(counted.filter((F.col("f") >= LEAST) | (F.col("words") == 0)))
    best = first_of_language(maximal(scored(grams)), first)
    # a row per language
    sizes = grams.filter("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
