"""SentencePiece encoding and decoding by a shared-prefix Viterbi search, for merge models.

A text is marked (a mark before it and for every space) and cut into marked words: runs of
marks with what follows them. No piece of the vocabulary crosses such a cut, so words are
segmented alone. The distinct words of a batch are sorted, which is the depth-first order of
their trie, and the forward state of the characters a word shares with the one before it is
kept, so every trie node is searched once.

The scores of a merge model are the ranks of its merges, and a sum of ranks says nothing. So
a path costs nothing where two neighboring pieces can stand side by side after merging, and
is ruled out where they cannot: two pieces can if merging the characters of both gives the
two again. Merging decides the pieces of a prefix without looking at what follows, so at
every place exactly one piece can end, and the forward state is that piece. The ids are those
of the library. Whether two pieces can stand side by side is found by merging them, once per
pair in the life of a worker process.

A character in no piece becomes its UTF-8 bytes as byte pieces; so does a mark that stands in
the text itself, which the library would take for a space. With that, decoding gives back
every text exactly.

Defined cases: null text has null ids and decodes to null; an empty text has no ids and
decodes to an empty text; a text is never cut short; repeated rows have equal results; an
empty table gives an empty table; other columns stay, but one that has the name of an added
column is replaced.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from stallrec.llm.common import map_rows

MARK = "▁"
#: Stands for a mark of the text itself while words are cut; no text holds a lone surrogate.
OWN_MARK = "\ud800"
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words whose ids a worker keeps, and the longest that it keeps.
HELD = 200_000
LONG = 64
#: Texts, and characters, that are searched together.
TOGETHER = 256
CHARACTERS = 1 << 22
#: Pairs of pieces a worker remembers.
PAIRS = 400_000


class Vocabulary:
    """Pieces, merges and byte pieces of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.piece = [model.id_to_piece(n) for n in range(model.get_piece_size())]
        self.byte = {int(self.piece[n][3:5], 16): n for n in range(len(self.piece)) if model.is_byte(n)}
        special = {n for n in range(len(self.piece)) if model.is_byte(n) or model.is_control(n) or model.is_unknown(n)}
        self.score = {p: model.get_score(n) for n, p in enumerate(self.piece) if n not in special and p}
        ids = {p: n for n, p in enumerate(self.piece) if n not in special and p}
        # a piece that its own characters do not merge into is never a result
        self.known = {p: n for p, n in ids.items() if self.merged(p) == [p]}
        # what ends some piece, with its id or -1, so that a search backwards stops where no piece goes on
        self.endings = {p[n:]: -1 for p in self.known for n in range(len(p))} | self.known
        self.raw = [self.piece[n].replace(MARK, " ").encode() for n in range(len(self.piece))]
        for value, n in self.byte.items():
            self.raw[n] = bytes([value])
        for n in special.difference(self.byte.values()):
            self.raw[n] = b""
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Best score first, the leftmost of equals."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for n in range(len(parts) - 1):
                found = score.get(parts[n] + parts[n + 1])
                if found is not None and (best is None or found > best):
                    best, at = found, n
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether merging the characters of two pieces gives the two."""
        key = left * len(self.piece) + right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            a, b = self.piece[left], self.piece[right]
            found = self.pairs[key] = self.merged(a + b) == [a, b]
        return found

    def bytes_of(self, sign: str) -> list[int]:
        return [self.byte[b] for b in (MARK if sign == OWN_MARK else sign).encode()]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def segment_sorted(words: list[str], vocab: Vocabulary) -> list[list[int]]:
    """Ids of words in sorted order. The stack holds, per character of the current path, where
    the piece that ends there begins and its id, -1 for a character in no piece."""
    ending, fits, remembered, base = vocab.endings.get, vocab.side_by_side, vocab.pairs.get, len(vocab.piece)
    begin, ident = [0], [-1]
    before, out = "", []
    for word in words:
        same = 0
        for a, b in zip(before, word):
            if a != b:
                break
            same += 1
        del begin[same + 1 :], ident[same + 1 :]
        for end in range(same + 1, len(word) + 1):
            start, at, who = end - 1, end - 1, -1
            while start >= 0:
                piece = ending(word[start:end])
                if piece is None:
                    break
                if piece >= 0:
                    last = ident[start]
                    fit = True if last < 0 else remembered(last * base + piece)
                    if fit if fit is not None else fits(last, piece):
                        at, who = start, piece
                        break
                start -= 1
            begin.append(at)
            ident.append(who)
        ids, end = [], len(word)
        while end:
            if ident[end] >= 0:
                ids.append(ident[end])
            else:
                ids.extend(reversed(vocab.bytes_of(word[end - 1])))
            end = begin[end]
        out.append(ids[::-1])
        before = word
    return out


def marked_words(text: str) -> list[str]:
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, OWN_MARK)
    if "  " in text or text[0] == " " or text[-1] == " ":
        return WORDS.findall(MARK + text.replace(" ", MARK))
    return [MARK + w for w in text.split(" ")]


class Encoder:
    """Ids of many texts, as bytes of 32-bit numbers; segmented words are held up to a bound."""

    def __init__(self, vocab: Vocabulary, held: int = HELD):
        self.vocab, self.held = vocab, held
        self.done: dict[str, bytes] = {}

    def coded(self, texts: list[str | None]) -> list[bytes | None]:
        out: list[bytes | None] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and end - at < TOGETHER and (end == at or size + len(texts[end] or "") <= CHARACTERS):
                size += len(texts[end] or "")
                end += 1
            cut = [None if t is None else marked_words(t) for t in texts[at:end]]
            if len(self.done) > self.held:
                self.done = {}
            done = self.done
            fresh = sorted({w for words in cut if words for w in words}.difference(done))
            found = {w: array("i", ids).tobytes() for w, ids in zip(fresh, segment_sorted(fresh, self.vocab))}
            done.update(found)
            out += [None if words is None else b"".join(map(done.__getitem__, words)) for words in cut]
            for word in found:
                if len(word) > LONG:
                    del done[word]
            at = end
        return out


@cache
def encoder(path: str) -> Encoder:
    """One per worker process, so that workers used again know the words of earlier tasks."""
    return Encoder(vocabulary(path))


def decode_ids(ids: list[int] | None, vocab: Vocabulary) -> str | None:
    if ids is None:
        return None
    return b"".join(map(vocab.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """Add ids, an array of piece ids, to ``docs``."""

    def start():
        code = encoder(model)
        return lambda columns: {
            "ids": [None if c is None else np.frombuffer(c, np.int32) for c in code.coded(columns["text"].to_pylist())]
        }

    return map_rows(docs.drop("ids"), start, {"ids": "array<int>"})


def decode(coded: DataFrame, model: str) -> DataFrame:
    """Add decoded, the text that the column ids stands for."""

    def start():
        vocab = vocabulary(model)
        return lambda columns: {"decoded": [decode_ids(i, vocab) for i in columns["ids"].to_pylist()]}

    return map_rows(coded.drop("decoded"), start, {"decoded": "string"})


def coded_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian 32-bit ids), same (decoding gives the text back).

    Both directions run in one task, a few texts at a time, so ids never leave it.
    """

    def start():
        code = encoder(model)

        def make(columns):
            counts, digests, same = [], [], []
            texts = columns["text"].to_pylist()
            for at in range(0, len(texts), TOGETHER):
                part = texts[at : at + TOGETHER]
                for text, coded in zip(part, code.coded(part)):
                    ids = None if coded is None else np.frombuffer(coded, np.int32)
                    counts.append(None if ids is None else len(ids))
                    digests.append(None if ids is None else zlib.crc32(ids.astype("<u4").tobytes()))
                    same.append(decode_ids(None if ids is None else ids.tolist(), code.vocab) == text)
            return {"n_ids": counts, "ids_crc32": digests, "same": same}

        return make

    return map_rows(docs.select("doc_id", "text"), start, {"n_ids": "long", "ids_crc32": "long", "same": "boolean"}).drop("text")
