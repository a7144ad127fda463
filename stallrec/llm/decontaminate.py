"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Documents and test items are sets of five-word shingles. An item is found in a document that
holds at least ``CONTAINMENT`` of its shingles. Items are partitioned by the power of two
above their size, and a partition's items get a MinHash sketch of their ``k`` least hashes,
``k = u - ceil(t * u) + 1`` for its largest size ``u``. A document that holds the share ``t``
of an item misses at most ``k - 1`` of its shingles, so it holds a hash of the sketch: no
match is lost, however long the document is (a sketch of the document would lose short
items in long documents). A document's hashes above the largest sketch value and documents
with too few shingles for a partition cannot match and leave before the join. Candidates are
then verified on the shingles themselves.

Only DataFrame functions are used. Shingles are made inside a document's row; what is
shuffled is at most one row per document and sketch hash, and neither side is broadcast
unless the planner knows that it is small.

Defined cases: null and empty texts and items have no shingles and match nothing; a text or
item of fewer than five words is one shingle of all its words; repeated documents match
alike, repeated rows of an item are one item; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallrec.llm.common import let, words_column
from stallrec.session import cut_lineage

SHINGLE = 5
CONTAINMENT = 0.8


def windows(n: Column, size: int) -> Column:
    """Starts of all windows of ``size`` among ``n`` words; one start if there are fewer words."""
    return F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)))


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Distinct shingle texts."""

    def made(w: Column) -> Column:
        all_of = F.transform(windows(F.size(w), size), lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " "))
        return F.when(F.size(w) > 0, F.array_distinct(all_of)).otherwise(F.array().cast("array<string>"))

    return let(words_column(text), made)


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of all shingles, repeats included. A text of fewer words hashes those it has."""

    def made(h: Column) -> Column:
        all_of = F.transform(windows(F.size(h), size), lambda i: F.xxhash64(*[F.get(h, i + n) for n in range(size)]))
        return F.when(F.size(h) > 0, all_of).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words_column(text), lambda w: F.xxhash64(w)), made)


def sketches(items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """item_id, needed, h: a row per hash of each item's sketch."""
    sized = items.withColumn("_q", F.size("_set")).filter("_q > 0")
    upper = F.pow(F.lit(2), F.ceil(F.log2("_q"))).cast("int")
    ranked = sized.withColumn("_u", upper).withColumn("_hs", F.array_sort("_set"))
    k = F.col("_u") - F.ceil(F.col("_u") * containment) + 1
    return ranked.select(
        "item_id",
        F.ceil(F.col("_q") * containment).alias("needed"),
        F.explode(F.slice("_hs", F.lit(1), F.least(k.cast("int"), F.col("_q")))).alias("h"),
    )


def benchmark_items(items: DataFrame) -> DataFrame:
    """item_id, shingles, _set (hashes) of the distinct rows of items (item_id, text)."""
    distinct = items.select("item_id", "text").distinct()
    return distinct.select(
        "item_id", shingles(F.col("text")).alias("shingles"), F.array_distinct(shingle_hashes(F.col("text"))).alias("_set")
    )


def candidates(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """Distinct doc_id, item_id that share a sketch hash and allow the share by size."""
    sketch = cut_lineage(sketches(items, containment))
    top = sketch.agg(F.coalesce(F.max("h"), F.lit(-(1 << 63))).alias("top"), F.coalesce(F.min("needed"), F.lit(1)).alias("least"))
    row = top.first()
    # the number of all shingles, repeats included, is at least that of the distinct ones
    low = let(
        shingle_hashes(F.col("text")),
        lambda hs: F.struct(F.size(hs).alias("x"), F.filter(hs, lambda h: h <= row["top"]).alias("hs")),
    )
    hashed = docs.select("doc_id", low.alias("low"))
    spread = hashed.select("doc_id", F.col("low.x").alias("_x"), F.explode("low.hs").alias("h")).filter(F.col("_x") >= row["least"])
    return spread.join(sketch, "h").filter("_x >= needed").select("doc_id", "item_id").distinct()


def contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment of every item found in a document.

    Of rows that share a doc_id the one that holds most of the item counts.
    """
    known = cut_lineage(benchmark_items(items))
    pairs = cut_lineage(candidates(docs, known, containment))
    texts = docs.select("doc_id", "text").join(pairs, "doc_id").join(known.select("item_id", "shingles"), "item_id")
    checked = texts.select(
        "doc_id",
        "item_id",
        F.size("shingles").cast("long").alias("n_item"),
        F.size(F.array_intersect("shingles", shingles(F.col("text")))).cast("long").alias("n_shared"),
    )
    return (
        checked.filter(F.col("n_shared") >= F.ceil(F.col("n_item") * containment))
        .groupBy("doc_id", "item_id", "n_item")
        .agg(F.max("n_shared").alias("n_shared"))
        .withColumn("containment", F.col("n_shared") / F.col("n_item"))
    )


def keep_clean(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """Documents in which no item is found, all their columns; without doc_id they are told by nothing and stay."""
    found = cut_lineage(contaminated(docs, items, containment).select("doc_id").distinct())
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")
