"""Collocations beside plain counting of every text."""

import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from stallrec.llm import collocations as C
from stallrec.llm import registry
from tests.llm.conftest import EDGE_TEXTS

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def plain_counts(texts):
    f = Counter()
    for t in texts:
        for w in pieces(t):
            for k in (1, 2, 3):
                f.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f


def plain(rows, first=2000):
    """Rows (lang, text)."""
    out = []
    for lang in {r[0] or "und" for r in rows}:
        f = plain_counts([t for x, t in rows if (x or "und") == lang])
        n = sum(v for p, v in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= 10}
        best = []
        for p, a in found.items():
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in found.items()):
                continue
            s, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            best.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def mined(spark, rows, **options):
    frame = spark.createDataFrame(rows, "lang string, text string")
    return sorted(tuple(r[c] for c in COLUMNS) for r in C.collocations(frame, **options).collect())


def texts(n, seed, vocabulary=30):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)] + ["The", "É", "漢", "a\x1cb", "x|y"]
    common = " ".join(rng.choices(words, k=40))
    out = []
    for _ in range(n):
        body = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", " ; ;"]) for _ in range(rng.randint(0, 120)))
        out.append((rng.choice(["en", "de", None, "und"]), body + (common if rng.random() < 0.5 else "")))
    return out


@pytest.mark.parametrize("spacing", [1, 2, 16, 1000])
def test_against_plain_counts(spark, spacing):
    rows = texts(150, 1)
    want = plain(rows)
    assert mined(spark, rows, spacing=spacing) == want and len(want) > 100


def test_copies_hot_words_and_small_lists(spark, monkeypatch):
    rows = texts(60, 2) + [("en", "one very common passage that stands in every text, over and over")] * 400 + [("en", "la " * 5000)]
    want = plain(rows, first=25)
    assert mined(spark, rows, first=25) == want
    # parts found by broadcast and by shuffle, tasks that hand on often
    for name, value in (("SHARE", 3), ("HELD", 10), ("COUNTED", 300), ("BITS", 1 << 6), ("FEWEST", 1 << 6), ("PIECE", 1 << 4)):
        monkeypatch.setattr(C, name, value)
    assert mined(spark, rows, first=25) == want


def test_every_phrase_is_in_one_chunk():
    rng = random.Random(3)
    for _ in range(200):
        text = " ".join(rng.choices(["a", "b", "c", "d.", "e,"], k=rng.randint(0, 60)))
        found = C.chunks(C.marked_words(text), C.Hashes(), rng.choice([1, 2, 5, 50]))
        counted = Counter()
        table = pa.table({"lang": ["x"] * len(found), "chunk": pa.array(found, pa.binary()), "n": [1] * len(found)})
        for row in [r for b in C.count_phrases(C.Words(table)) for r in b.to_pylist()] if found else []:
            if row["words"]:
                counted[tuple(row["phrase"].split(" "))] += row["n"]
        assert counted == plain_counts([text])


def test_equal_passages_are_cut_alike():
    rng = random.Random(4)
    passage = " ".join(f"p{n}" for n in range(400))
    cut = [set(C.chunks(C.marked_words(f"{' '.join(rng.choices('abc', k=30))} {passage} {' '.join(rng.choices('abc', k=30))}"), C.Hashes())) for _ in range(2)]
    inner = [{c for c in s if set(c.split()) <= {f"p{n}".encode() for n in range(400)}} for s in cut]
    assert inner[0] == inner[1] and sum(map(len, inner[0])) > 0.8 * len(passage)


def test_scores_beyond_64_bits(spark):
    rows = [(10**15, 10**15 + 7, 2 * 10**15 + 1), (3 * 10**9 + 1, 4 * 10**9, 7 * 10**9 + 3)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select(C.score(*[C.F.col(c) for c in "alr"])).collect()
    assert [g[0] for g in got] == [10**6 * a * a // (x * y) for a, x, y in rows]


def test_edge_table(spark, edge, empty):
    rows = [(r["lang"], r["text"]) for r in edge.collect()]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in C.collocations(edge).collect())
    assert got == plain(rows) and {r[2] for r in got} == {"la la la"}
    assert C.collocations(empty).count() == 0
    assert mined(spark, [(None, None), ("en", ""), ("en", " .\n ")]) == []


@pytest.mark.parametrize("path", ["/root/testdata/sf0.001"])
def test_query_against_sql(spark, path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = con.sql(registry.ORACLES["op12_collocations"]).select(", ".join(COLUMNS)).fetchall()
    got = registry.QUERIES["op12_collocations"](spark, path).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == sorted(want) and len(want) > 100
