"""Secret scan: candidate strings, and a random forest that removes false positives.

A candidate is a run of ``[A-Za-z0-9+/_=-]`` of at least ``MIN_LENGTH`` characters in a word; a
word can hold several, as the parts of a dotted token are. Its features are its length, shares of character kinds, transitions between kinds
(runs of digits, lower, upper; vowel to consonant), the share of its letters that dictionary
words cover, how it looks like a path, and its neighbors: an assignment sign or a word for
secrets before it, quotes around it.

The dictionary is made of the corpus: lower-case letter runs of 4 to 20 letters seen at
least ``MIN_SEEN`` times. The forest is Spark's own, trained from labelled findings
(features and label). Where none are given, findings assigned to a secret word are positive
and findings whose word has no digit or is an address or path are negative; at most
``SAMPLE`` of either kind train, chosen by a digest.

Only DataFrame functions run here; words are looked at inside their document's row, and only
candidates become rows.

Defined cases: null and empty texts have no candidates; without labelled findings of both
kinds nothing can be learnt and the rule that makes positive labels decides alone; repeated
documents have equal findings; whole texts are read however long; a null doc_id is kept with its
findings; an empty table has none; other columns are not read, and none can clash with those
of the findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallrec.llm.common import SPACES, let
from stallrec.operators import skew
from stallrec.session import cut_lineage

MIN_LENGTH = 16
MIN_SEEN = 5
SAMPLE = 20_000
THRESHOLD = 0.5
TREES = 20
DEPTH = 6
#: Words that announce a secret.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "access_key", "auth", "credential", "bearer")
RUN = f"[A-Za-z0-9+/_=\\-]{{{MIN_LENGTH},}}"
MASK = "[SECRET]"
FEATURES = [
    "length",
    "digit_share",
    "upper_share",
    "vowel_share",
    "hex_share",
    "kind_runs",
    "vowel_runs",
    "distinct_share",
    "covered",
    "path_marks",
    "is_path",
    "assigned",
    "announced",
    "quoted",
]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, position (of the word), nth (in the word), word, value, before1, before2, after1."""
    def found(w: Column) -> Column:
        places = F.filter(
            F.sequence(F.lit(0), F.size(w) - 1), lambda i: (F.length(F.get(w, i)) >= MIN_LENGTH) & F.get(w, i).rlike(RUN)
        )
        near = {"word": 0, "before1": -1, "before2": -2, "after1": 1}
        return F.transform(
            places,
            # text that begins with a blank has an empty first piece, which is no word
            lambda i: F.struct((i - (F.get(w, F.lit(0)) == "").cast("int")).alias("position"), *[F.coalesce(F.get(w, i + n), F.lit("")).alias(c) for c, n in near.items()]),
        )

    rows = docs.select("doc_id", F.explode(let(F.split(F.coalesce("text", F.lit("")), SPACES), found)).alias("f"))
    return rows.select("doc_id", "f.*", F.posexplode(F.regexp_extract_all("f.word", F.lit(RUN), 0)).alias("nth", "value"))


def dictionary(docs: DataFrame, seen: int = MIN_SEEN) -> DataFrame:
    """run: letter runs that the corpus uses as words."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), SPACES)).alias("w"))
    runs = words.filter("length(w) between 4 and 24").select(F.regexp_extract("w", "^[^a-z0-9]*([a-z]{4,20})[^a-z0-9]*$", 1).alias("run"))
    return runs.filter("run <> ''").groupBy("run").agg(F.count("*").alias("n")).filter(F.col("n") >= seen).select("run")


def _left(value: str, drop: str) -> Column:
    """Characters that stay when the class ``drop`` goes."""
    return F.length(F.regexp_replace(value, drop, ""))


def with_shape(found: DataFrame) -> DataFrame:
    """Add the features of a finding that need nothing but its row."""
    n = F.length("value")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[0-9]+", "0"), "[a-z]+", "1"), "[A-Z]+", "2")
    turns = F.regexp_replace(F.regexp_replace(F.lower("value"), "[aeiou]+", "0"), "[b-df-hj-np-tv-z]+", "1")
    announce = F.concat_ws(" ", "before2", "before1", "word")
    spoken = "(?i)(" + "|".join(SECRET_WORDS) + ")"
    return (
        found.withColumn("length", n.cast("double"))
        .withColumn("digit_share", _left("value", "[^0-9]") / n)
        .withColumn("upper_share", _left("value", "[^A-Z]") / n)
        .withColumn("vowel_share", _left("value", "[^AEIOUaeiou]") / n)
        .withColumn("hex_share", _left("value", "[^0-9a-fA-F]") / n)
        .withColumn("kind_runs", F.length(kinds) / n)
        .withColumn("vowel_runs", F.length(turns) / n)
        .withColumn("distinct_share", F.size(F.array_distinct(F.split("value", ""))) / n)
        .withColumn("path_marks", _left("value", "[^/]").cast("double"))
        .withColumn("is_path", F.col("word").rlike("(://|^/|[a-z]/[a-z]|@)").cast("double"))
        .withColumn("assigned", (F.col("before1").rlike("[=:]$") | F.col("word").rlike("[=:][\"']?[A-Za-z0-9]")).cast("double"))
        .withColumn("announced", announce.rlike(spoken).cast("double"))
        .withColumn("quoted", F.col("word").rlike("^[^A-Za-z0-9]*[\"']").cast("double"))
    )


def with_coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """Add covered: the share of the value that letter runs of the dictionary cover.

    Distinct values are looked up, so a value copied into a third of all documents is one row,
    and its findings are dealt out when they get it back.
    """
    values = found.select("value").distinct()
    runs = values.select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("([a-z]{4,})"), 1)).alias("run"))
    hit = runs.join(words, "run").groupBy("value").agg(F.sum(F.length("run")).alias("_hit"))
    return skew.join(found, hit, "value", "doc_id", "left").withColumn("covered", F.coalesce(F.col("_hit") / F.length("value"), F.lit(0.0))).drop("_hit")


def rule_label() -> Column:
    """1 for findings assigned to a secret word, 0 for plain words, addresses and paths, else null."""
    plain = ~F.col("value").rlike("[0-9]") | (F.col("is_path") == 1)
    return F.when((F.col("assigned") == 1) & (F.col("announced") == 1) & ~plain, 1.0).when(plain & (F.col("assigned") == 0), 0.0)


def labelled_findings(found: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The features and label of a bounded sample of findings that the rule can label."""
    known = found.withColumn("label", rule_label()).filter("label IS NOT NULL")
    sizes = known.groupBy("label").agg(F.count("*").alias("_n"))
    kept = F.pmod(F.xxhash64("doc_id", "position", "nth", "value"), F.lit(1 << 30)).cast("double") * F.col("_n") < float(sample << 30)
    # at most two rows
    return known.join(F.broadcast(sizes), "label").filter(kept).select(*FEATURES, "label")


def secret_findings(
    docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD, seen: int = MIN_SEEN
) -> DataFrame:
    """doc_id, position, nth, value, score of the findings that the forest leaves.

    ``labelled`` has FEATURES and label (1.0 is a secret).
    """
    found = cut_lineage(with_shape(candidates(docs.select("doc_id", "text"))))
    found = cut_lineage(with_coverage(found, dictionary(docs.select("text"), seen)))
    train = cut_lineage(labelled if labelled is not None else labelled_findings(found))
    if train.agg(F.count_distinct("label")).first()[0] < 2:
        scored = found.withColumn("score", F.coalesce(rule_label(), F.lit(0.0)))
    else:
        # the forest draws its samples by partition: the bounded training rows are put in one order
        assemble = VectorAssembler(inputCols=FEATURES, outputCol="_features")
        forest = RandomForestClassifier(
            featuresCol="_features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy="sqrt"
        ).fit(assemble.transform(train.orderBy(*FEATURES, "label").coalesce(1)))
        scored = forest.transform(assemble.transform(found)).withColumn("score", vector_to_array("probability")[1])
    return scored.filter(F.col("score") >= threshold).select("doc_id", "position", "nth", "value", "score")


def mask_secrets(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """``docs`` with every secret found in a text replaced by ``mask`` and n_chars adjusted.

    No document goes; texts without findings are untouched. Rows without doc_id are not
    told apart and stay as they are.
    """
    found = secret_findings(docs).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_set("value").alias("_secrets"))
    met = docs.join(cut_lineage(found), "doc_id", "left")
    # longer values first, so that one inside another leaves no rest
    ordered = F.array_sort(F.col("_secrets"), lambda a, b: F.length(b) - F.length(a))
    masked = F.aggregate(ordered, F.col("text"), lambda text, s: F.replace(text, s, F.lit(mask)))
    hit = F.col("_secrets").isNotNull()
    out = met.withColumn("_masked", F.when(hit, masked).otherwise(F.col("text")))
    columns = {"text": F.col("_masked"), "n_chars": F.when(hit, F.char_length("_masked").cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*[columns.get(c, F.col(c)).alias(c) for c in docs.columns])
