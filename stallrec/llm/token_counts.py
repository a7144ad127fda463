"""Exact length histogram: what every context limit keeps, from one pass over the texts.

Documents are counted by encoded length; everything else is read off the histogram. For
every occurring length L: how many documents are as long or longer, all tokens, tokens left
when each text is cut at L, documents cut, and the share of documents no longer than L (so
quantile q is the least L whose share reaches q). The suffix sums run in two levels, inside
buckets of lengths and over bucket totals, so no task needs the whole histogram.

Defined cases: null and empty texts have length 0; ties and repeated rows are counted each;
an empty table gives an empty histogram; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallrec.llm.bpe import encoder
from stallrec.llm.common import map_rows
from stallrec.session import cut_lineage

BUCKET = 1024


def with_length(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Add n_tokens."""

    def start():
        coder = encoder(tokenizer)
        return lambda columns: {"n_tokens": coder.counts(columns["text"].to_pylist())}

    return map_rows(docs, start, {"n_tokens": "long"})


def histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """length, n_docs."""
    return with_length(docs.select("text"), tokenizer).groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))


def context_table(lengths: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row per occurring length, taken as a context limit.

    length, n_docs, docs_at_least, tokens_at_least, total_docs, total_tokens, docs_cut,
    tokens_kept (each text cut at ``length``), share_within.
    """
    counted = lengths.withColumn("b", F.floor(F.col("length") / bucket)).withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    sums = counted.groupBy("b").agg(F.sum("n_docs").alias("bd"), F.sum("n_tokens").alias("bt"))
    later = sums.alias("x").join(sums.alias("y"), F.col("y.b") > F.col("x.b"), "left")
    later = later.groupBy("x.b").agg(F.coalesce(F.sum("y.bd"), F.lit(0)).alias("ld"), F.coalesce(F.sum("y.bt"), F.lit(0)).alias("lt"))
    total = sums.agg(F.sum("bd").alias("total_docs"), F.sum("bt").alias("total_tokens"))
    inside = W.partitionBy("b").orderBy(F.desc("length"))
    return (
        counted.withColumn("docs_in", F.sum("n_docs").over(inside))
        .withColumn("tokens_in", F.sum("n_tokens").over(inside))
        .join(later, "b")
        .crossJoin(F.broadcast(total))
        .select(
            "length",
            "n_docs",
            (F.col("docs_in") + F.col("ld")).alias("docs_at_least"),
            (F.col("tokens_in") + F.col("lt")).alias("tokens_at_least"),
            "total_docs",
            "total_tokens",
        )
        .withColumn("docs_cut", F.col("docs_at_least") - F.col("n_docs"))
        .withColumn("tokens_kept", F.col("total_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least"))
        .withColumn("share_within", 1 - F.col("docs_cut") / F.col("total_docs"))
    )


def at_limits(lengths: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_cut, tokens_kept for any context limits, occurring or not."""
    wanted = lengths.sparkSession.createDataFrame([(n,) for n in limits], "limit long")
    met = wanted.join(F.broadcast(lengths.agg(F.sum("n_docs").alias("d"))))
    cut = lengths.join(F.broadcast(wanted), F.lit(True)).groupBy("limit").agg(
        F.sum(F.when(F.col("length") > F.col("limit"), F.col("n_docs")).otherwise(0)).alias("docs_cut"),
        F.sum(F.least("length", "limit") * F.col("n_docs")).alias("tokens_kept"),
    )
    return met.join(cut, "limit", "left").select(
        "limit", F.coalesce("docs_cut", F.lit(0)).alias("docs_cut"), F.coalesce("tokens_kept", F.lit(0)).alias("tokens_kept")
    )


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """share, length: the least occurring length that at least this share of documents keeps within."""
    wanted = table.sparkSession.createDataFrame([(s,) for s in shares], "share double")
    return (
        table.join(F.broadcast(wanted), F.col("share_within") >= F.col("share")).groupBy("share").agg(F.min("length").alias("length"))
    )


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    return context_table(cut_lineage(histogram(docs, tokenizer)))
