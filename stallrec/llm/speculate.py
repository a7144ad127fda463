"""Byte-level BPE by speculation: propose with greedy longest matches, verify, merge only what fails.

A text is cut into words as the tokenizer cuts it (special tokens first, then its pattern).
For every distinct word

1. greedy longest-match over the vocabulary proposes tokens;
2. every adjacent pair of proposed tokens is tested, all pairs of a batch at once in numpy: a
   pair is compatible if merging the bytes of both never joins across the border. Tokens that
   come out of their own bytes and are compatible with their neighbors are what merging gives;
3. words with an incompatible pair, and only they, are merged by rank.

The pair test runs the merges backwards. Of the two tokens at the border the one made last is
taken apart, so the walk meets every pair that ever stood side by side there. Such a pair would
have joined if its merge comes before the merge that took either of the two away; among
equal merges the left one goes first.

Decoding joins the bytes of the ids; bytes that are no UTF-8 become U+FFFD.

Defined cases: null and empty texts have no ids and decode to an empty text; whole texts are
coded however long; repeated rows have equal results; an empty table gives an empty table;
extra columns stay, but one that has the name of an added column is replaced. A null list of
ids decodes to null; an id outside the vocabulary raises an error.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from stallrec.llm.bpe import Words, byte_signs
from stallrec.llm.common import int_lists, map_rows

#: Texts coded together, and the characters after which a group of texts ends.
TOGETHER = 256
CHARACTERS = 1 << 22
NEVER = np.iinfo(np.int64).max


class Merges:
    """Tokens, merges by rank and the pair test of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        signs, model = byte_signs(), content["model"]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        by_sign = {t: n for t, n in model["vocab"].items() if t not in self.special}
        self.size = 1 + max([*by_sign.values(), *self.special.values()])
        self.raw: list[bytes | None] = [None] * self.size
        for token, number in by_sign.items():
            self.raw[number] = bytes([signs[c] for c in token])
        for token, number in self.special.items():
            self.raw[number] = token.encode()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        pairs = np.array([(by_sign[a], by_sign[b]) for a, b in merges], np.int64).reshape(-1, 2)
        made = np.array([by_sign[a + b] for a, b in merges], np.int64)
        #: (left, right) -> (rank, token) for merging a single word
        self.table = {(a, b): (rank, t) for rank, (a, b, t) in enumerate(zip(*pairs.T.tolist(), made.tolist()))}
        # of merges that make one token the first is how it comes about
        self.left, self.right = np.full(self.size, -1), np.full(self.size, -1)
        self.rank = np.full(self.size, -1, np.int64)
        self.left[made[::-1]], self.right[made[::-1]] = pairs[::-1].T
        self.rank[made[::-1]] = np.arange(len(made))[::-1]
        key = pairs[:, 0] * self.size + pairs[:, 1]
        self.rank_of = np.argsort(key, kind="stable")
        self.keys = key[self.rank_of]
        self.byte = {self.raw[n][0]: n for n in by_sign.values() if len(self.raw[n]) == 1}
        whole = self.whole()
        self.known = {self.raw[n]: n for n in by_sign.values() if whole[n]}
        self.longest = max(map(len, self.known), default=1)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, ``NEVER`` where there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether merging, up to the rank ``until``, never joins across the border of ``a`` and ``b``."""
        apart = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b = a.copy(), b.copy()
        ends_a = np.full(len(a), NEVER) if until is None else until.copy()
        ends_b = ends_a.copy() if until is None else until - 1
        while len(at):
            rank = self.ranks(a, b)
            joins = (rank < ends_a) & (rank <= ends_b) & (rank < NEVER)
            apart[at[joins]] = False
            made_a, made_b = self.rank[a], self.rank[b]
            goes_on = ~joins & (np.maximum(made_a, made_b) >= 0)
            at, a, b, ends_a, ends_b, made_a, made_b = (v[goes_on] for v in (at, a, b, ends_a, ends_b, made_a, made_b))
            of_a = made_a > made_b
            ends_a, ends_b = np.where(of_a, made_a, ends_a), np.where(of_a, ends_b, made_b)
            a, b = np.where(of_a, self.right[a], a), np.where(of_a, b, self.left[b])
        return apart

    def whole(self) -> np.ndarray:
        """Whether merging a token's own bytes gives that token: both parts do, and nothing
        joins across them before the merge that makes it."""
        whole = np.array([r is not None and len(r) == 1 for r in self.raw])
        made = np.flatnonzero(self.rank >= 0)
        made = made[np.argsort(self.rank[made])]
        fits = self.compatible(self.left[made], self.right[made], self.rank[made])
        for token, a, b, fit in zip(made.tolist(), self.left[made].tolist(), self.right[made].tolist(), fits.tolist()):
            whole[token] = fit and whole[a] and whole[b]
        return whole

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        get, longest = self.known.get, self.longest
        found, at, size = [], 0, len(word)
        while at < size:
            end = min(size, at + longest)
            token = get(word[at:end])
            while token is None:
                end -= 1
                token = get(word[at:end])
            found.append(token)
            at = end
        return found

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, least rank first and the leftmost of equals, with a queue of pairs."""
        table, none = self.table, (-1, -1)
        tokens = [self.byte[b] for b in word]
        size = len(tokens)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        queue = []
        for at in range(size - 1):
            rank, token = table.get((tokens[at], tokens[at + 1]), none)
            if rank >= 0:
                queue.append((rank, at, token, tokens[at], tokens[at + 1]))
        heapq.heapify(queue)
        while queue:
            _, at, token, a, b = heapq.heappop(queue)
            other = after[at]
            if tokens[at] != a or other >= size or tokens[other] != b:
                continue
            tokens[at], tokens[other] = token, -1
            after[at] = end = after[other]
            if end < size:
                before[end] = at
                rank, made = table.get((token, tokens[end]), none)
                if rank >= 0:
                    heapq.heappush(queue, (rank, at, made, token, tokens[end]))
            start = before[at]
            if start >= 0:
                rank, made = table.get((tokens[start], token), none)
                if rank >= 0:
                    heapq.heappush(queue, (rank, start, made, tokens[start], token))
        return [t for t in tokens if t >= 0]

    def code(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids of all words, ids per word, words that were merged) of distinct words."""
        found = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((t for f in found for t in f), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(words)), sizes)
        inside = np.flatnonzero(word[:-1] == word[1:])
        pairs, which = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        apart = self.compatible(pairs // self.size, pairs % self.size)
        failing = np.unique(word[inside[~apart[which]]]).tolist()
        if failing:
            for n in failing:
                found[n] = self.merge(words[n])
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((t for f in found for t in f), np.int64, int(sizes.sum()))
        return flat, sizes, len(failing)


class Coder(Words):
    """Ids of many texts and back."""

    def __init__(self, merges: Merges, held: int = 600_000):
        self.merges = merges
        self.decimals = [str(n).encode() for n in range(merges.size)]

        def code(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            named = [n for n, w in enumerate(words) if w in merges.special]
            flat, sizes, _ = merges.code([w.encode() for w in words if w not in merges.special])
            # a special token among the words is one id of its own
            places = np.array(named, np.int64) - np.arange(len(named))
            starts = np.r_[0, np.cumsum(sizes)][places]
            return np.insert(flat, starts, [merges.special[words[n]] for n in named]), np.insert(sizes, places, 1)

        super().__init__(code, merges.special, held)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.merges.raw.__getitem__, ids)).decode("utf-8", "replace")


@cache
def coder(path: str) -> Coder:
    """One per worker process, so that workers used again know the words of earlier tasks."""
    return Coder(Merges(path))


def groups(texts: list[str | None]) -> Iterable[list[str | None]]:
    """A batch in groups of bounded size; a longer text is a group of its own."""
    group: list[str | None] = []
    size = 0
    for text in texts:
        if group and (len(group) == TOGETHER or size + len(text or "") > CHARACTERS):
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text or "")
    if group:
        yield group


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Add token_ids, the ids of ``text``."""

    def start():
        code = coder(tokenizer)

        def make(columns):
            done = [code.ids(g) for g in groups(columns["text"].to_pylist())]
            flat = np.concatenate([f for f, _ in done] or [np.zeros(0, np.int32)])
            return {"token_ids": int_lists(flat.astype(np.int32), np.concatenate([s for _, s in done] or [np.zeros(0, np.int64)]))}

        return make

    return map_rows(docs.drop("token_ids"), start, {"token_ids": "array<int>"})


def decode(coded: DataFrame, tokenizer: str) -> DataFrame:
    """Add decoded, the text that ``token_ids`` stands for."""

    def start():
        code = coder(tokenizer)
        return lambda columns: {"decoded": [None if i is None else code.decode(i) for i in columns["token_ids"].to_pylist()]}

    return map_rows(coded.drop("decoded"), start, {"decoded": "string"})


def round_trips(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 of every row.

    Both directions run in one task, a group of texts at a time, so ids never leave it.
    """

    def start():
        code = coder(tokenizer)

        def make(columns):
            counts, of_ids, of_text = [], [], []
            for group in groups(columns["text"].to_pylist()):
                flat, sizes = code.ids(group)
                ends = np.cumsum(sizes).tolist()
                for size, end in zip(sizes.tolist(), ends):
                    ids = flat[end - size : end].tolist()
                    counts.append(size)
                    of_ids.append(hashlib.sha256(b",".join(map(code.decimals.__getitem__, ids))).hexdigest())
                    of_text.append(hashlib.sha256(code.decode(ids).encode()).hexdigest())
            return {"n_tokens": counts, "ids_sha256": of_ids, "decoded_sha256": of_text}

        return make

    added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return map_rows(docs.select("doc_id", "text"), start, added).drop("text")
