"""Speculative BPE beside the tokenizers library."""

import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stallrec.llm import registry, speculate
from tests.llm.conftest import EDGE_TEXTS, SMALL

LIBRARY = Tokenizer.from_file(registry.BYTE_BPE)
CODER = speculate.coder(registry.BYTE_BPE)
ODD = [
    "it's we'll I'd 'S 've",
    "a<|endoftext|>b <|endoftext|>  <|endoftext|>",
    "foo  <|endoftext|>  x <|endof",
    "\x1c\x1d a\x1f b\x85c\xa0d e",
    "aaaaaaaaaaaaa" * 50,
    "\r\n\r\n x\n y 　",
    "1234567890 ½²Ⅷ",
    "=-" * 5000,
    "x" * 50000,
    "ͅ ᷺\U0001e900 ꟊ \U00016d40 Ᲊ",
]


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD + [t or "" for t in EDGE_TEXTS])
def test_odd_texts(text):
    flat, sizes = CODER.ids([text])
    assert flat.tolist() == library(text) and sizes.tolist() == [len(flat)]
    assert CODER.decode(flat.tolist()) == LIBRARY.decode(library(text), skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("ab c.'\n\t\x1c 　éß漢1²<|>_", max_size=80))
def test_any_text(text):
    assert CODER.ids([text])[0].tolist() == library(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=20))
def test_decoding_any_ids(ids):
    assert CODER.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_pairs_against_merging():
    """A pair is compatible just when merging the bytes of both gives the two tokens."""
    merges, rng = CODER.merges, random.Random(3)
    a = np.array([rng.randrange(rng.choice([300, 3000, 50256])) for _ in range(20000)])
    b = np.array([rng.randrange(rng.choice([300, 3000, 50256])) for _ in range(20000)])
    b[:2000] = a[:2000]
    want = [merges.merge(merges.raw[x] + merges.raw[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert merges.compatible(a, b).tolist() == want and 0 < sum(want) < len(want)


def test_only_failing_words_are_merged(monkeypatch):
    texts = [d["text"] for d in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()]
    words = sorted({w for t in texts for w in CODER.words(t)})
    merged = []
    plain = speculate.Merges.merge
    monkeypatch.setattr(speculate.Merges, "merge", lambda self, w: merged.append(w) or plain(self, w))
    failing = CODER.merges.code([w.encode() for w in words])[2]
    assert failing == len(merged) and 0 < failing < len(words)
    for word in words:
        assert word.encode() in merged or CODER.merges.propose(word.encode()) == plain(CODER.merges, word.encode())


def test_forgetting_changes_nothing():
    texts = [d["text"] for d in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()]
    small = speculate.Coder(CODER.merges, held=50)
    for group in speculate.groups(texts):
        assert small.ids(group)[0].tolist() == CODER.ids(group)[0].tolist()


def test_special_tokens_among_words():
    flat, sizes = CODER.code(["<|endoftext|>", " hello", "<|endoftext|>", " zyx"])
    want = [library(w) for w in ("<|endoftext|>", " hello", "<|endoftext|>", " zyx")]
    assert flat.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


def test_query(spark):
    docs = {d["doc_id"]: d["text"] for d in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}
    got = registry.QUERIES["op11_bpe_speculate"](spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_edge_table(spark, edge, empty):
    coded = speculate.decode(speculate.encode(edge, registry.BYTE_BPE), registry.BYTE_BPE)
    rows = coded.collect()
    assert len(rows) == edge.count() and set(edge.columns) < set(coded.columns)
    assert all(r["token_ids"] == library(r["text"]) and r["decoded"] == (r["text"] or "") for r in rows)
    again = speculate.decode(speculate.encode(coded, registry.BYTE_BPE), registry.BYTE_BPE)
    assert sorted(again.columns) == sorted(coded.columns)
    assert speculate.encode(empty, registry.BYTE_BPE).count() == speculate.round_trips(empty, registry.BYTE_BPE).count() == 0
    none = hashlib.sha256(b"").hexdigest()
    for r in speculate.round_trips(edge, registry.BYTE_BPE).filter("doc_id in (0, 1)").collect():
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (0, none, none)
