"""Operators over documents beside plain versions of the same rules."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash

from stallrec.llm import quality_rules, registry, repeats, simhash, token_blocks, token_counts
from tests.llm.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()


def rows(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_quality_counts(spark):
    got = rows(registry.QUERIES["op1_quality_rules"](spark, SMALL))
    assert len(got) == len(DOCS)
    for d in DOCS:
        t, g = d["text"], got[d["doc_id"]]
        w = WORD.findall(t)
        spans = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if spans[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert g["n_words"] == len(w) and g["word_chars"] == sum(map(len, w))
        assert g["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))
        assert g["n_dup_lines"] == len(lines) - len(set(lines))
        assert g["n_repeat_words"] == len(hit)
        assert g["base_failed"] == (len(w) < 20 or 100 * len(hit) > 30 * len(w))
        assert not (g["base_failed"] and g["kept"])


def test_binomial_and_walk():
    def plain(k, n, p):
        from math import comb

        return sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))

    for k, n, p in [(0, 300, 0.01), (3, 900, 0.01), (1, 50, 0.1), (7, 4000, 0.004)]:
        assert quality_rules.binomial_cdf(k, n, p) == pytest.approx(plain(k, n, p), rel=1e-9)
    above = np.array([500] * 10 + [1] * 40 + [0] * 51)
    assert quality_rules.certified(above, 2000, 0.01, 1e-3) == 10
    assert quality_rules.certified(above, 20, 0.01, 1e-3) == quality_rules.OFF


def test_quality_cutoffs_hold_their_risk(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for n in range(6000):
        bad = n % 5 == 0
        words = ["".join(rng.choices("abcdef", k=5)) + ("$$$" if bad else "") for _ in range(25)]
        docs.append((n, " ".join(words), "en"))
        labels.append((n, 0 if bad else 1))
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = rows(quality_rules.quality_rules(d, lab))
    assert all(got[n]["kept"] == bool(q) for n, q in labels)
    kept = quality_rules.keep_good(d, lab)
    assert kept.columns == d.columns and kept.count() == 4800


def plain_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, most=4):
    parent = {i: i for i in fps}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= most:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {i: top(i) for i in fps}


def test_simhash(spark):
    got = rows(registry.QUERIES["op2_simhash_near_dedup"](spark, SMALL))
    fps = {d["doc_id"]: plain_fingerprint(d["text"]) for d in DOCS}
    want = plain_components(fps)
    assert {i: (g["fingerprint"], g["component_id"]) for i, g in got.items()} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_gray_index_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64) * np.uint64(2)
    flips = [int(b) ^ sum(1 << x for x in set(rng.integers(0, 64, rng.integers(0, 7)).tolist())) for b in base for _ in range(20)]
    fps = np.unique(np.array(flips, np.uint64))
    index = simhash.GrayIndex(fps)
    q, n = index.search(index.sorted, 4)
    want = {(a, b) for a in range(len(fps)) for b in range(len(fps)) if int(index.sorted[a] ^ index.sorted[b]).bit_count() <= 4}
    assert set(zip(q.tolist(), n.tolist())) == want
    # small chunks: hot groups meet chunk by chunk
    frame = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    links = simhash.near_links(frame, chunk=16).collect()
    ids = {n: int(f) for n, f in enumerate(fps)}
    by_fp = {f: n for n, f in ids.items()}
    parent = plain_components(ids)
    groups = {}
    for n, root in parent.items():
        groups.setdefault(root, set()).add(n)
    label = {n: n for n in ids}
    for r in links:
        a, b = by_fp[r["a"] % (1 << 64)], by_fp[r["b"] % (1 << 64)]
        old, new = label[a], label[b]
        label = {n: new if x == old else x for n, x in label.items()}
    found = {}
    for n, x in label.items():
        found.setdefault(x, set()).add(n)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))


def test_masks_cover_every_choice():
    for n in (10, 10**7, 10**10, 10**14):
        masks = [m % (1 << 64) for m in simhash.block_masks(n)]
        rng = random.Random(n)
        for _ in range(200):
            diff = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not diff & m for m in masks)


def test_token_blocks(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows(registry.QUERIES["op3_token_id_blocks"](spark, SMALL))
    start = 0
    for d in sorted(DOCS, key=lambda d: d["doc_id"]):
        ids = tok.encode(d["text"], add_special_tokens=False).ids + [0]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert got[d["doc_id"]] == {"doc_id": d["doc_id"], "start": start, "n_tokens": len(ids), "ids_crc32": crc}
        start += len(ids)


def test_pieces_encode_as_whole_texts():
    from tokenizers import Tokenizer

    from stallrec.llm.bpe import Encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(5)
    texts = ["".join(rng.choices(["a", "Be", " ", "  ", "\n", " \n", "\t", ".", "'s", "1", "é", " ", "\x1c", "<|endoftext|>", "\r"], k=14)) for _ in range(1500)]
    enc, tok = Encoder(path, held=50), Tokenizer.from_file(path)
    flat, sizes = enc.ids(texts)
    for text, ids in zip(texts, np.split(flat, np.cumsum(sizes)[:-1])):
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_go_straight_to_the_model(tmp_path):
    from tokenizers import Tokenizer, normalizers

    from stallrec.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["One, two  é漢 <|endoftext|>it's\x1c 12\n", "", None, "One \u0085x\u00a0"]
    plain = Tokenizer.from_file(path)
    lower = Tokenizer.from_file(path)
    lower.normalizer = normalizers.Lowercase()
    lower.save(str(tmp_path / "lower.json"))
    assert bpe.cuts_only(plain) and not bpe.cuts_only(lower)
    cut = plain.pre_tokenizer.pre_tokenize_str("One é漢\n")
    assert bpe.in_signs(["One", " é漢", "\n"]) == [signs for signs, _ in cut]
    for tok, file in ((plain, path), (lower, str(tmp_path / "lower.json"))):
        flat, sizes = bpe.Encoder(file).ids(texts)
        for text, ids in zip(texts, np.split(flat, np.cumsum(sizes)[:-1])):
            assert ids.tolist() == tok.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for top in (1, 2, 300, 50000, 2**32 - 1):
        ids = rng.integers(0, top, n) if top > 1 else np.zeros(n, np.int64)
        ids[rng.random(n) < 0.05] = top
        starts, payload = token_blocks.encode_blocks(ids)
        assert (token_blocks.decode_blocks(starts, payload, n) == ids).all()


def test_token_counts(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = sorted(len(tok.encode(d["text"], add_special_tokens=False).ids) for d in DOCS)
    table = registry.QUERIES["op4_token_counts"](spark, SMALL)
    got = rows(table, "length")
    assert sorted(got) == sorted(set(lengths))
    for n, g in got.items():
        assert g["docs_at_least"] == sum(x >= n for x in lengths)
        assert g["tokens_kept"] == sum(min(x, n) for x in lengths)
        assert g["docs_cut"] == sum(x > n for x in lengths)
        assert g["share_within"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    hist = table.select("length", "n_docs")
    limits = rows(token_counts.at_limits(hist, [1, 700, 10**6]), "limit")
    assert limits[700]["tokens_kept"] == sum(min(x, 700) for x in lengths)
    half = token_counts.quantiles(table, [0.5]).first()["length"]
    assert half == lengths[(len(lengths) + 1) // 2 - 1]


def plain_repeats(docs):
    first = {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        w = WORD.findall(d["text"] or "")
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d["doc_id"])
    out = {}
    for d in docs:
        w = WORD.findall(d["text"] or "")
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d["doc_id"] for j in range(i, i + 13)}
        left = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[d["doc_id"]] = (len(w), len(gone), hashlib.sha256(left.encode()).hexdigest())
    return out


def digests(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


def test_repeats(spark):
    assert digests(registry.QUERIES["op5_substring_dedup"](spark, SMALL)) == plain_repeats(DOCS)


def test_repeats_with_hot_anchors(spark, monkeypatch):
    rng = random.Random(9)
    line = " ".join(f"common{n}" for n in range(16))
    docs = [
        {"doc_id": n, "text": " ".join(rng.choices(["x", "y", "z", "q"], k=20)) + " " + line + " " + " ".join(rng.choices(["u", "v"], k=15))}
        for n in range(60)
    ]
    monkeypatch.setattr(repeats, "HOT", 5)
    monkeypatch.setattr(repeats, "SHARD", 3)
    monkeypatch.setattr(repeats, "BUNDLE", 7)
    frame = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string")
    assert digests(repeats.repeat_digests(frame)) == plain_repeats(docs)


def test_repeats_locate_runs_of_windows(monkeypatch):
    built, plain = [], repeats.automaton
    monkeypatch.setattr(repeats, "automaton", lambda phrases: built.extend(phrases) or plain(phrases))
    shared = [f"w{n}" for n in range(21)]
    shard = [(7, 1, " ".join(shared), 1, 9), (7, 2, " ".join([*shared[:15], "x", "y"]), 4, 4), (7, 3, " ".join(["z", *shared[2:16]]), 0, 0)]
    hits = {r["passage_id"]: r for r in repeats._shard_hits(shard).to_pylist()}
    windows = {
        i: {(at, owner) for first, n, owner in zip(r["offsets"], r["counts"], r["owners"]) for at in range(first, first + n)}
        for i, r in hits.items()
    }
    # the third passage stands in document 0 and owns the two windows it shares
    owners = [1, 1, 0, 0, 1, 1, 1, 1, 1]
    assert windows == {1: set(enumerate(owners)), 2: set(enumerate(owners[:3])), 3: {(1, 0), (2, 0)}}
    assert len(built) < len(owners)


def test_anchors_of_documents_together():
    docs = [[], [b"a", b"b"] * 9, [b"c"] * 12, [str(n % 17).encode() for n in range(60)], [b"d"] * 13]
    doc, hashes, first, last = (v.tolist() for v in repeats.anchors(docs))
    alone = [(n, *row) for n, words in enumerate(docs) for row in zip(*[v.tolist() for v in repeats.anchors([words])[1:]])]
    assert list(zip(doc, hashes, first, last)) == alone and {1, 3, 4} == set(doc)


def test_repeats_make_passages_once(spark, monkeypatch):
    made, plain = [], repeats.passages
    monkeypatch.setattr(repeats, "passages", lambda rows: made.append(rows.columns) or plain(rows))
    words = " ".join(f"é{n}" for n in range(40))
    docs = [{"doc_id": n, "text": f"a{n}  b\n{words if n % 2 else words[3 * n :]}\tz{n}"} for n in range(12)]
    frame = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string")
    assert digests(repeats.repeat_digests(frame)) == plain_repeats(docs)
    assert len(made) == 1


def test_edge_cases(spark, edge, empty):
    n = edge.count()
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None)], "doc_id long, quality int")
    judged = quality_rules.quality_rules(edge.select("doc_id", "lang", "text"), labels)
    assert judged.count() == n and not rows(judged)[0]["kept"]
    assert quality_rules.keep_good(edge, labels).columns == edge.columns
    found = simhash.simhash_components(edge)
    assert found.count() == n
    by_id = rows(found.filter("doc_id is not null"))
    assert by_id[0]["fp"] == 0 == by_id[1]["fp"] and by_id[1]["component_id"] == 0 and by_id[7]["component_id"] == 6
    stay = simhash.keep_one(edge)
    assert stay.columns == edge.columns and stay.filter("doc_id = 6").count() == 3 and stay.filter("doc_id = 7").count() == 0
    fixed = [d | {"doc_id": i} for i, d in enumerate([r.asDict() for r in edge.filter("doc_id is not null").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()])]
    out = repeats.repeat_digests(edge)
    assert out.count() == n
    assert digests(out.filter("doc_id is not null")) == plain_repeats(fixed)
    assert repeats.without_repeats(edge).columns == edge.columns
    counts = token_counts.token_counts(edge, registry.BYTE_BPE)
    assert counts.filter("length = 0").first()["n_docs"] == 3
    path = f"{spark.conf.get('spark.checkpoint.dir')}/edge-ids"
    token_blocks.write_ids(edge, path, registry.BYTE_BPE)
    assert token_blocks.read_ids(spark, path).count() == n
    for result in (
        quality_rules.quality_rules(empty.select("doc_id", "lang", "text"), labels),
        simhash.simhash_components(empty),
        simhash.keep_one(empty),
        repeats.repeat_digests(empty),
        token_counts.token_counts(empty, registry.BYTE_BPE),
    ):
        assert result.count() == 0
    token_blocks.write_ids(empty, path + "0", registry.BYTE_BPE)
    assert token_blocks.read_digests(spark, path + "0").count() == 0
