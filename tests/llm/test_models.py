"""Operators with learnt models or searches beside plain versions and held-out labels."""

import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from stallrec.llm import decontaminate, language_id, registry, secret_scan, url_filter, viterbi
from tests.llm.conftest import EDGE_TEXTS, SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_containment(docs, items):
    out = {}
    for d in docs:
        have = shingles(d["text"])
        for i in items:
            want = shingles(i["text"])
            if want and len(want & have) * 5 >= 4 * len(want):
                out[(d["doc_id"], i["item_id"])] = (len(want), len(want & have))
    return out


def test_decontamination_over_a_table(spark):
    docs, items = pq.read_table(f"{SF}/documents.parquet").to_pylist(), pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    got = registry.QUERIES["op8_benchmark_decontamination"](spark, SF).collect()
    assert {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_shared"]) for r in got} == plain_containment(docs, items)


def test_decontamination_of_partial_items_in_long_texts(spark):
    rng = random.Random(2)
    items = [{"item_id": n, "text": " ".join(f"i{n}_{k}" for k in range(rng.randint(2, 60)))} for n in range(40)]
    docs = []
    for n in range(200):
        w = rng.choice(items)["text"].split()
        drop = rng.randint(0, max(1, len(w) // 3))
        docs.append({"doc_id": n, "text": " ".join(f"d{rng.random()}" for _ in range(rng.choice([0, 3000]))) + " " + " ".join(w[drop:])})
    frame = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i["item_id"], i["text"]) for i in items], "item_id long, text string")
    want = plain_containment(docs, items)
    got = decontaminate.contaminated(frame, bench).collect()
    assert {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_shared"]) for r in got} == want and len(want) > 50
    assert decontaminate.keep_clean(frame, bench).count() == len(docs) - len({d for d, _ in want})


def plain_url(url):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None
    rest = url[at + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda f: len(f[0])) if fits else None


def test_url_rules(spark):
    pages = pq.read_table(f"{SMALL}/pages.parquet").to_pylist()
    odd = [None, "", "no scheme", "http://COM/x", "http://x.Example.COM/en/a?b://c", "https://net/es/", "http://xnet/es/", "http://a.net?q", "a://b://c/d#e", "http://www.example.com/en/\n"]
    rows = [(p["page_id"], p["url"], "h") for p in pages] + [(10**6 + n, u, "h") for n, u in enumerate(odd)] + [(None, None, None)]
    got = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string, host string"))
    by_id = {r["page_id"]: r for r in got.collect()}
    assert got.count() == len(rows)
    for i, u, _ in rows:
        host, path, hit = plain_url(u)
        r = by_id[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, hit[0] if hit else None), u
        assert r["verdict"] == hit[1] if hit else r["verdict"] in ("allow", "block")


def test_markov_model_against_plain_smoothing():
    rng = random.Random(4)
    urls = ["http://" + "".join(rng.choices("abc/.", k=12)) for _ in range(50)]
    full = np.zeros(url_filter.A**4)
    contexts = {}
    for u in urls:
        s = url_filter.signs(u).tolist()
        for at in range(3, len(s)):
            full[((s[at - 3] * 40 + s[at - 2]) * 40 + s[at - 1]) * 40 + s[at]] += 1
            for k in range(4):
                seen = contexts.setdefault(tuple(s[at - k : at]), {})
                seen[s[at]] = seen.get(s[at], 0) + 1
    model = url_filter.log_model(full)

    def plain(context, sign):
        back = plain(context[1:], sign) if context else 1 / 40
        seen = contexts.get(tuple(context))
        return (seen.get(sign, 0) + len(seen) * back) / (sum(seen.values()) + len(seen)) if seen else back

    for _ in range(300):
        c = [rng.randrange(40) for _ in range(4)] if rng.random() < 0.5 else url_filter.signs(rng.choice(urls))[-4:].tolist()
        assert np.exp(model[tuple(c)]) == pytest.approx(plain(c[:3], c[3]), rel=1e-4)


def test_url_ratio_on_unseen_urls(spark):
    rng = random.Random(6)
    rows = []
    for n in range(1500):
        good = n % 2
        name = "".join(rng.choices(["news", "blog", "wiki"] if good else ["xx0", "win9", "casino"], k=2))
        host = rng.choice(["example.com", "other.net", "thing.org"])
        rows.append((n, f"http://{name}.{host}/{'en' if host != 'other.net' or good else 'fr'}/{name}{rng.randint(1, 999)}", good))
    rows = [(n, u.replace(".example.com/en", ".site.com/en") if g else u, g) for n, u, g in rows]
    got = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string, good int")).collect()
    free = [(r["verdict"] == "allow") == bool(rows[r["page_id"]][2]) for r in got if r["rule"] is None]
    assert len(free) > 300 and sum(free) > 0.9 * len(free)


LIBRARY = sentencepiece.SentencePieceProcessor(model_file=registry.PIECE_BPE)


def test_words_get_the_ids_of_the_library():
    """Every distinct word of the documents, in the sorted order in which prefixes are shared."""
    vocab = viterbi.vocabulary(registry.PIECE_BPE)
    texts = [d["text"] for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    words = sorted({w for t in texts if t for w in viterbi.marked_words(t)})
    for word, ids in zip(words, viterbi.segment_sorted(words, vocab)):
        assert ids == LIBRARY.encode(word[1:].replace("▁", " ")), word
    assert len(words) > 50000


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab c\n\té漢e the<|>_ing😀", max_size=80))
def test_any_text_and_back(text):
    ids = np.frombuffer(viterbi.encoder(registry.PIECE_BPE).coded([text])[0], np.int32).tolist()
    assert viterbi.decode_ids(ids, viterbi.vocabulary(registry.PIECE_BPE)) == text
    if "▁" not in text:
        assert ids == LIBRARY.encode(text)


def test_prefixes_are_searched_once(monkeypatch):
    vocab = viterbi.vocabulary(registry.PIECE_BPE)
    words = sorted({"▁" + w for w in ("sentence", "sentences", "sent", "sentencepiece", "other", "others")})
    alone = [viterbi.segment_sorted([w], vocab)[0] for w in words]
    assert viterbi.segment_sorted(words, vocab) == alone
    met = []

    class Counted(dict):
        def get(self, part):
            met.append(part)
            return dict.get(self, part)

    monkeypatch.setattr(vocab, "endings", Counted(vocab.endings))
    viterbi.segment_sorted(words, vocab)
    shared = len(met)
    for w in words:
        viterbi.segment_sorted([w], vocab)
    assert shared < 0.6 * (len(met) - shared)


def test_viterbi(spark):
    texts = [d["text"] for d in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()[:40]] + EDGE_TEXTS[:10] + ["  two  spaces ", "a\n b", "▁mark ▁▁ x▁y"]
    frame = spark.createDataFrame([(n, t, "x") for n, t in enumerate(texts)], "doc_id long, text string, decoded string")
    coded = viterbi.encode(frame, registry.PIECE_BPE)
    rows = viterbi.decode(viterbi.encode(coded, registry.PIECE_BPE), registry.PIECE_BPE).collect()
    assert sorted(rows[0].asDict()) == ["decoded", "doc_id", "ids", "text"] and all(r["decoded"] == r["text"] for r in rows)
    assert all(r["ids"] == LIBRARY.encode(r["text"]) for r in rows if r["text"] is not None and "▁" not in r["text"])


def test_forgetting_pieces_changes_nothing():
    texts = [d["text"] for d in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()]
    small = viterbi.Encoder(viterbi.vocabulary(registry.PIECE_BPE), held=10)
    assert small.coded(texts) == viterbi.encoder(registry.PIECE_BPE).coded(texts)


def test_pieces_query(spark):
    docs = {d["doc_id"]: d["text"] for d in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}
    got = registry.QUERIES["op9_sentencepiece"](spark, SMALL).collect()
    assert len(got) == 200 and all(r["same"] for r in got)
    for r in got:
        ids = LIBRARY.encode(docs[r["doc_id"]])
        assert (r["n_ids"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_language_on_held_out(spark):
    got = registry.QUERIES["op10_language_id"](spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    rows = got.join(truth, "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    held = duckdb.sql(f"select count(*) from '{SF}/documents.parquet'").fetchall()[0][0]
    assert got.count() == held and all(0 <= r["score"] <= 1 for r in rows)


def test_secrets(spark):
    found = secret_scan.secret_findings(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    want = {(r[0], m) for r in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall() for m in re.findall(r'token = "([0-9a-f]{40})"', r[1])}
    got = {(r["doc_id"], r["value"]) for r in found}
    assert want <= got and len(got - want) <= 0.1 * len(want)
    plan = secret_scan.secret_findings(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_every_run_of_a_word_is_a_candidate(spark):
    parts = ["eyJhbGciOiJIUzI1NiJ9abc", "eyJzdWIiOiIxMjM0NTY3ODkwIn0", "dozjgNryP4J3jVmNHl0w5N_XgL0"]
    texts = ['x a="AAAAAAAAAAAAAAAAAAA1";b="BBBBBBBBBBBBBBBBBBB2" y', " leading " + ".".join(parts), "short a.b", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.position, r.nth, r.value) for r in secret_scan.candidates(docs).collect())
    assert got == [(0, 1, 0, "AAAAAAAAAAAAAAAAAAA1"), (0, 1, 1, "BBBBBBBBBBBBBBBBBBB2")] + [(1, 1, n, p) for n, p in enumerate(parts)]


def test_all_parts_of_a_secret_are_masked(spark):
    rng = random.Random(7)
    made = lambda k: "".join(rng.choices("abcdef0123456789", k=k)) + "7"
    texts = [f'text before token = "{made(39)}" and {" ".join(rng.choices(["some", "plain", "words", "internationalization/of/paths"], k=8))}' for _ in range(300)]
    dotted = [".".join(made(39) for _ in range(3)) for _ in range(20)]
    pairs = [(made(39), made(39)) for _ in range(20)]
    texts += [f'the token = "{t}" end' for t in dotted] + [f'a secret_a="{a}";secret_b="{b}" end' for a, b in pairs]
    docs = spark.createDataFrame([(n, t, len(t)) for n, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    masked = {r.doc_id: r.text for r in secret_scan.mask_secrets(docs).collect()}
    for n, parts in enumerate([d.split(".") for d in dotted] + pairs, 300):
        assert not any(p in masked[n] for p in parts), masked[n]
    # the same rows in another layout give the same scores
    one, other = (sorted(map(tuple, secret_scan.secret_findings(d).collect())) for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == other


def test_edge_cases(spark, edge, empty):
    n = edge.count()
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (3, "one"), (4, EDGE_TEXTS[6])], "item_id long, text string")
    hits = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(edge, bench).collect()}
    assert hits == {(3, 3), (6, 4), (7, 4)}
    clean = decontaminate.keep_clean(edge, bench)
    assert clean.columns == edge.columns and clean.count() == n - 5
    masked = secret_scan.mask_secrets(edge)
    assert masked.columns == edge.columns and masked.count() == n
    assert masked.filter("doc_id = 6").first()["text"] == EDGE_TEXTS[6]
    coded = viterbi.coded_digests(edge, registry.PIECE_BPE)
    assert coded.count() == n and coded.filter("not same").count() == 0
    langs = language_id.language_id(edge)
    assert langs.count() == n
    assert {r["lang_pred"] for r in langs.filter("doc_id in (0, 1, 2, 9)").collect()} == {"und"}
    for result in (
        decontaminate.contaminated(empty, bench),
        decontaminate.contaminated(edge, bench.limit(0)),
        secret_scan.mask_secrets(empty),
        viterbi.coded_digests(empty, registry.PIECE_BPE),
        language_id.language_id(empty),
        url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")),
    ):
        assert result.count() == 0


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4]
    assert P.run(spark, SMALL).count() == counts[-1]
