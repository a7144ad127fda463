"""Token ids of whole texts with a byte-level BPE of the tokenizers library, each distinct word once.

The library cuts a text into words before it merges, special tokens first and then by a
pattern. A text is cut in the same way here; a word not met before is given to the library,
and all others are looked up. A worker process keeps what it has met. Where nothing but this
cutting stands before the library's merges, words go straight to its model.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable
from functools import cache
from itertools import chain

import numpy as np
import regex

#: Fixed value: how byte-level tokenizers of this kind cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII characters alone.
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Words held by a worker; when over, it starts anew.
HELD = 1_200_000
BATCH = 4096


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Seen(dict):
    """A number for every key met; ``fresh`` lists the new ones."""

    def __init__(self):
        self.fresh: list = []

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        self.fresh.append(key)
        return number


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.room, self.size = np.zeros(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.room):
            self.room = np.concatenate([self.room[: self.size], np.zeros(2 * need - self.size, self.room.dtype)])
        self.room[self.size : need] = values
        self.size = need

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.size]


Code = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class Words:
    """Ids of many texts from ``code``, which gives (ids of all, ids per word) of distinct words
    and of the ``special`` tokens. What was met before is looked up."""

    def __init__(self, code: Code, special: Iterable[str], held: int = HELD):
        self.code, self.held = code, held
        self.any_words = regex.compile(WORDS).findall
        self.ascii_words = re.compile(ASCII_WORDS, re.ASCII).findall
        names = sorted(special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.clear()

    def clear(self) -> None:
        self.seen = Seen()
        self.flat, self.sizes, self.starts = Grown(np.int32), Grown(np.int64), Grown(np.int64)

    def words(self, text: str) -> list[str]:
        return self.ascii_words(text) if text.isascii() else self.any_words(text)

    def split(self, text: str) -> list[str]:
        """Words and special tokens of a text."""
        if self.special is None or not self.special.search(text):
            return self.words(text)
        out: list[str] = []
        for n, part in enumerate(self.special.split(text)):
            out += [part] if n % 2 else self.words(part)
        return out

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all words, words per text); a null or empty text has none."""
        if len(self.seen) > self.held:
            self.clear()
        number, numbers, counts = self.seen.__getitem__, array("q"), []
        for text in texts:
            words = self.split(text) if text else ()
            numbers.extend(map(number, words))
            counts.append(len(words))
        if self.seen.fresh:
            flat, sizes = self.code(self.seen.fresh)
            self.seen.fresh = []
            self.starts.add(self.flat.size + np.cumsum(sizes) - sizes)
            self.sizes.add(sizes)
            self.flat.add(flat)
        return np.array(numbers, np.int64), np.array(counts, np.int64)

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text)."""
        numbers, counts = self.numbers(texts)
        sizes = self.sizes.values[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat.values[np.repeat(self.starts.values[numbers] - (ends - sizes), sizes) + np.arange(total)]
        return flat, np.diff(np.r_[0, ends][np.r_[0, np.cumsum(counts)]])

    def counts(self, texts: list[str | None]) -> list[int]:
        numbers, counts = self.numbers(texts)
        ends = np.r_[0, np.cumsum(self.sizes.values[numbers])][np.r_[0, np.cumsum(counts)]]
        return np.diff(ends).tolist()


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in a vocabulary file: visible Latin-1 signs
    stand for themselves, the other bytes, in order, for the signs from U+0100 on."""
    visible = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


#: Signs of all bytes but 255, which UTF-8 never uses and which parts words here.
SIGNS = {b: sign for sign, b in byte_signs().items()} | {255: "\n"}


def in_signs(words: list[str]) -> list[str]:
    """Words as a byte-level vocabulary writes them."""
    return b"\xff".join(map(str.encode, words)).decode("latin-1").translate(SIGNS).split("\n") if words else []


def cuts_only(tokenizer) -> bool:
    """Whether words go to the model as their bytes, with no step before it but the cutting."""
    steps = json.loads(tokenizer.to_str())
    before = steps["pre_tokenizer"] or {}
    kind = (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True))
    others = (steps["normalizer"], steps["truncation"], steps["padding"])
    return others == (None, None, None) and kind == ("ByteLevel", False, True)


class Encoder(Words):
    """Ids as the library gives them."""

    def __init__(self, path: str, held: int = HELD):
        tokenizer = load(path)
        special = {t.content: n for n, t in tokenizer.get_added_tokens_decoder().items()}
        tokenize = tokenizer.model.tokenize

        def whole(words: list[str]) -> Iterable[list[int]]:
            for at in range(0, len(words), BATCH):
                yield from (c.ids for c in tokenizer.encode_batch_fast(words[at : at + BATCH], add_special_tokens=False))

        def straight(words: list[str]) -> Iterable[list[int]]:
            for at in range(0, len(words), BATCH):
                part = words[at : at + BATCH]
                for word, signs in zip(part, in_signs(part)):
                    yield [special[word]] if word in special else [t.id for t in tokenize(signs)]

        ids_of = straight if cuts_only(tokenizer) else whole

        def code(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            coded = list(ids_of(words))
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            return np.fromiter(chain.from_iterable(coded), np.int32, int(sizes.sum())), sizes

        super().__init__(code, special, held)


@cache
def encoder(path: str) -> Encoder:
    """One per worker process, so that workers used again know the words of earlier tasks."""
    return Encoder(path)
