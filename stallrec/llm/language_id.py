"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram (n = 3, words apart by a gap
sign) binds its letters' vectors, the first permuted twice and the second once, by their
product. A text bundles its n-grams into their sum, a language bundles its texts, and a text
gets the language whose prototype has the greatest cosine with it. ``score`` is
(1 + cosine) / 2.

Letter vectors follow from the code point and a seed alone, so tasks agree without sharing
anything. A text's distinct n-grams are bound once each and weighted by their counts; a task
holds one text's n-grams at a time, in steps of a fixed size.

Prototypes are learnt from a bounded sample: up to ``SAMPLE`` documents per language of those
given, chosen by a digest of the id. Prediction reads every text and nothing but the text.

Defined cases: null text and text without letters is ``und`` with score 0, as is every text
where nothing could be learnt; equal cosines go to the least language name; documents
without a language, or whose text has no letters, teach nothing; repeated rows are predicted
alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallrec.llm.common import map_rows
from stallrec.session import cut_lineage

DIM = 1024
SEED = 7
SAMPLE = 5000
SLOTS = 512
STEP = 4096
LETTERS = re.compile(r"[^\W\d_]")
#: Fixed value: what a text that cannot be judged gets.
UNKNOWN = "und"


def letter_tables(dim: int = DIM, seed: int = SEED) -> list[np.ndarray]:
    """Letter vectors in their three places of an n-gram: permuted twice, once, not at all.

    Code points share ``SLOTS`` vectors beyond the first 384, which cover the Latin blocks;
    slot 0 is the gap between words.
    """
    base = np.random.default_rng(seed).integers(0, 2, (SLOTS, dim), dtype=np.int8) * 2 - 1
    return [np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base]


def _is_letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x3000)])


_ALPHA = _is_letter_table()


def slots(text: str | None) -> np.ndarray:
    """Slots of a text's letters, lower-cased, every run of other characters as one gap, with a gap at both ends."""
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    low = np.minimum(points, len(_ALPHA) - 1)
    letter = _ALPHA[low]
    far = points >= len(_ALPHA)
    if far.any():
        letter[far] = [chr(c).isalpha() for c in points[far]]
    if not letter.any():
        return np.zeros(0, np.int64)
    slot = np.where(points < 384, points, 384 + points % (SLOTS - 384))
    slot[~letter] = 0
    slot = np.r_[0, slot, 0]
    return slot[np.r_[True, (slot[1:] != 0) | (slot[:-1] != 0)]]


def bundle(text: str | None, tables: list[np.ndarray]) -> np.ndarray | None:
    """Sum of the text's bound n-grams; None without letters."""
    s = slots(text)
    if len(s) < 3:
        return None
    grams, n = np.unique((s[:-2] * SLOTS + s[1:-1]) * SLOTS + s[2:], return_counts=True)
    total = np.zeros(tables[0].shape[1], np.float32)
    for at in range(0, len(grams), STEP):
        g = grams[at : at + STEP]
        bound = tables[0][g // (SLOTS * SLOTS)] * tables[1][g // SLOTS % SLOTS]
        bound *= tables[2][g % SLOTS]
        total += n[at : at + STEP].astype(np.float32) @ bound.astype(np.float32)
    return total


def learners(docs: DataFrame, allowed: Column, sample: int = SAMPLE) -> DataFrame:
    """lang, text of the sample: per language the ids whose digest is below a share that
    lets through about ``sample`` of them."""
    rows = docs.filter(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    # written, so that the planner knows its size and broadcasts it only if that is small
    sizes = cut_lineage(rows.groupBy("lang").agg(F.count("*").alias("_n")))
    kept = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).cast("double") * F.col("_n") < float(sample << 30)
    return rows.join(sizes, "lang").filter(kept).select("lang", "text")


def prototypes(taught: DataFrame, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages and their bundles of unit length, from rows (lang, text).

    Each task sums its texts per language; sums of sums are a grouped sum per element.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, sums = letter_tables(dim), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                vector = bundle(text, tables)
                if vector is not None:
                    sums[lang] = sums.get(lang, 0) + vector.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "sums"]
            )

    parts = taught.mapInArrow(run, "lang string, sums array<double>").select("lang", F.posexplode("sums").alias("at", "x"))
    rows = parts.groupBy("lang", "at").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v"))
    found = sorted((r["lang"], [e["x"] for e in r["v"]]) for r in rows.collect())  # a row per language
    matrix = np.array([v for _, v in found], np.float64).reshape(len(found), dim)
    return [lang for lang, _ in found], matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, dim: int = DIM) -> DataFrame:
    """Add lang_pred and score, from the column text alone."""
    held = docs.sparkSession.sparkContext.broadcast(matrix)

    def start():
        tables, known = letter_tables(dim), held.value

        def one(text):
            vector = bundle(text, tables)
            length = 0.0 if vector is None else float(np.linalg.norm(vector))
            if not length or not langs:
                return UNKNOWN, 0.0
            cosines = known @ vector.astype(np.float64) / length
            best = int(np.argmax(cosines))
            return langs[best], float(min(1.0, max(0.0, (1 + cosines[best]) / 2)))

        def make(columns):
            rows = [one(t) for t in columns["text"].to_pylist()]
            return {"lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows]}

        return make

    return map_rows(docs, start, {"lang_pred": "string", "score": "double"})


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; a null doc_id is not held out."""
    held = F.coalesce(held_out(), F.lit(False))
    langs, matrix = prototypes(learners(docs.select("doc_id", "lang", "text"), ~held))
    return predict(docs.select("doc_id", "text"), langs, matrix).select("doc_id", held.alias("held_out"), "lang_pred", "score")
