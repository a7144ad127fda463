"""Every operator has one query, and the entry hands out both halves of the library."""

import re

import __spark_entry__ as entry
import corpus_pipeline
from stallrec.llm import registry
from stallrec.registry.queries import ORACLES, QUERIES


def test_one_query_per_operator():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in registry.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_entry_holds_both():
    assert set(entry.queries()) == {*QUERIES, *registry.QUERIES, "pipeline"}
    assert set(entry.oracle_sql()) == {*ORACLES, *registry.ORACLES}
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
