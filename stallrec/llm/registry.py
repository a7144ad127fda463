"""The operators as queries over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallrec.llm import (
    collocations,
    common,
    decontaminate,
    hard_negatives,
    language_id,
    quality_rules,
    repeats,
    secret_scan,
    simhash,
    speculate,
    token_blocks,
    token_counts,
    url_filter,
    viterbi,
)
from stallrec.session import shared_folder

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def query(run: Run) -> Run:
    QUERIES[run.__name__] = run
    return run


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@query
def op1_quality_rules(spark, d):
    judged = quality_rules.quality_rules(common.documents(spark, d), labels(spark, d))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op2_simhash_near_dedup(spark, d):
    found = simhash.simhash_components(common.documents(spark, d))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


@query
def op3_token_id_blocks(spark, d):
    path = f"{shared_folder(spark)}/stallrec/ids-{uuid.uuid4().hex}"
    token_blocks.write_ids(common.documents(spark, d), path, BYTE_BPE)
    return token_blocks.read_digests(spark, path)


@query
def op4_token_counts(spark, d):
    return token_counts.token_counts(common.documents(spark, d), BYTE_BPE)


@query
def op5_substring_dedup(spark, d):
    return repeats.repeat_digests(common.documents(spark, d))


@query
def op6_url_filter(spark, d):
    return url_filter.url_filter(url_filter.pages(spark, d))


@query
def op7_secret_scan(spark, d):
    found = secret_scan.secret_findings(common.documents(spark, d))
    return found.select("doc_id", "position", "nth", F.sha2("value", 256).alias("value_sha256"), "score")


@query
def op8_benchmark_decontamination(spark, d):
    return decontaminate.contaminated(common.documents(spark, d), decontaminate.benchmark(spark, d))


@query
def op9_sentencepiece(spark, d):
    return viterbi.coded_digests(common.documents(spark, d), PIECE_BPE)


@query
def op10_language_id(spark, d):
    return language_id.language_id(common.documents(spark, d))


@query
def op11_bpe_speculate(spark, d):
    return speculate.round_trips(common.documents(spark, d), BYTE_BPE)


@query
def op12_collocations(spark, d):
    return collocations.collocations(common.documents(spark, d))


ORACLES["op12_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sized AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM sized GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS j FROM c),
parts AS (
  SELECT cut.*, x.f AS l, y.f AS r, (1000000 * a::HUGEINT * a::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score FROM cut
  JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.w[1:j], ' ')
  JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.w[j + 1:cut.k], ' ')),
least AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a AS longer FROM c WHERE k = 3),
most AS (SELECT lang, phrase, max(longer) AS longer FROM inside GROUP BY ALL)
SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM least LEFT JOIN most USING (lang, phrase) JOIN n USING (lang)
WHERE k = 3 OR longer IS NULL OR 100 * longer < 50 * a
WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER o <= 2000
"""


@query
def op13_hard_negatives(spark, d):
    return hard_negatives.mine(hard_negatives.embeddings(spark, d))


ORACLES["op13_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 3
"""
