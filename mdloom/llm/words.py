"""Batches of texts as words of a byte-level BPE tokenizer, each distinct word looked up once."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

import numpy as np

from mdloom.llm.common import spread
from mdloom.llm.transducer import END, Counter, Splitter, byte_letters

MAX_KNOWN = 300_000


class Growing:
    """An array that takes more values at its end; data: at least the first size of them."""

    def __init__(self, kind, values=()) -> None:
        self.data, self.size = np.empty(1024, kind), 0
        self.add(np.asarray(values, kind))

    def add(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.data):
            data = np.empty(max(end, len(self.data) * 3 // 2), self.data.dtype)
            data[: self.size] = self.data[: self.size]
            self.data = data
        self.data[self.size : end] = values
        self.size = end

    def last(self):
        return self.data[self.size - 1]


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two (sorted hashes, index) as one."""
    at = np.searchsorted(a[0], b[0])
    return np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1])


class WordBook:
    """Ids or counts of words, from a function that is asked about new words only.

    Words are found by a 64-bit hash and then compared character by character, so a shared hash can't change a result.
    The book starts afresh when it holds MAX_KNOWN words. New words first go to a small sorted index, which joins
    the large one when it has grown to an eighth of it.
    """

    def __init__(self, tokenizer, ask: Callable[[list[bytes]], tuple[Sequence[int], Sequence[int]]], special: str, special_ids: Sequence[int], end_ids: Sequence[int]) -> None:
        """ask: of UTF-8 words, the ids of all and how many each has."""
        self.splitter, self.ask, self.special = Splitter(tokenizer.pre_tokenizer), ask, special
        self.fixed = [np.asarray(x, np.uint32) for x in ((), special_ids, end_ids)]
        rng = np.random.default_rng(7)
        self.salt = rng.integers(1, 2**63, 0x110000, dtype=np.uint64)
        self.base, self.inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
        self.power = self.unpower = np.ones(1, np.uint64)
        self.reset()

    def reset(self) -> None:
        self.large = self.small = (np.empty(0, np.uint64), np.empty(0, np.uint32))
        self.chars, self.char_at = Growing(np.uint32), Growing(np.int64, [0])
        self.ids, self.id_at = Growing(np.uint32, np.concatenate(self.fixed)), Growing(np.int64, np.cumsum([0, *map(len, self.fixed)]))

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.power) < n:
            make = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))
            self.power, self.unpower = make(self.base), make(self.inverse)
        return self.power[:n], self.unpower[:n]

    def learn(self, hashes: np.ndarray, first: np.ndarray, last: np.ndarray, points: np.ndarray) -> None:
        """Ask about new words (points[first:last]), given in the order of their hashes."""
        n = self.char_at.size - 1
        size = last - first
        self.add(points[spread(first, last - first)], size)
        index = np.arange(n, n + len(first), dtype=np.uint32)
        self.small = merged(self.small, (hashes, index))
        if len(self.small[0]) * 8 > len(self.large[0]):
            self.large, self.small = merged(self.large, self.small), (np.empty(0, np.uint64), np.empty(0, np.uint32))

    def add(self, chars: np.ndarray, sizes: np.ndarray) -> None:
        text = chars.tobytes().decode("utf-32-le")
        raw = text.encode()
        ends = np.cumsum(sizes)
        at = np.concatenate([[0], np.cumsum(1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF))])
        begin, end = at[ends - sizes].tolist(), at[ends].tolist()
        ids, counts = self.ask([raw[a:b] for a, b in zip(begin, end, strict=True)])
        self.char_at.add(self.char_at.last() + ends)
        self.chars.add(chars)
        self.id_at.add(self.id_at.last() + np.cumsum(counts))
        self.ids.add(ids)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The index of each word in the book, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        for known, index in (self.large, self.small):
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                out = np.where(known[at] == hashes, index[at], out)
        return out

    def look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index into id_at of each word, with an END entry after each segment; words of each text)."""
        if self.char_at.size > MAX_KNOWN:
            self.reset()
        parts, closing = [], []
        for text in texts:
            cut = text.split(self.special) if self.special in text else (text,)
            parts.extend(cut)
            closing.extend([1] * (len(cut) - 1) + [2])
        points = np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        classes = self.splitter.classes[points]
        classes[ends] = END
        begins = self.splitter.starts(classes)
        begins[ends] = True
        at = np.flatnonzero(begins)
        is_end = classes[at] == END
        until = np.concatenate([at[1:], [len(points)]])
        power, unpower = self.powers(len(points) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.salt[points] * power[:-1])])
        out = np.empty(len(at), np.int64)
        out[is_end] = closing
        word = ~is_end
        a, b = at[word], until[word]
        hashed = (total[b] - total[a]) * unpower[a]
        unique, where, which = np.unique(hashed, return_index=True, return_inverse=True)
        new = np.flatnonzero(self.numbers(unique) < 0)
        if len(new):
            self.learn(unique[new], a[where[new]], b[where[new]], points)
        number = self.numbers(unique)[which]
        length = b - a
        chars, char_at = self.chars.data, self.char_at.data
        same = char_at[number + 1] - char_at[number] == length
        if same.any():
            own = length[same]
            same[same] = np.logical_and.reduceat(chars[spread(char_at[number[same]], own)] == points[spread(a[same], own)], np.cumsum(own) - own)
        for i in np.flatnonzero(~same):  # two words with one hash: the later one gets an entry of its own
            number[i] = self.char_at.size - 1
            self.add(points[a[i] : b[i]], length[i : i + 1])
        number += len(self.fixed)
        out[word] = number
        closed = np.cumsum(np.bincount(np.searchsorted(at, ends), minlength=len(at)))  # segments closed up to each word
        last = np.flatnonzero(np.asarray(closing) == 2)
        word_ends = np.searchsorted(closed, last + 1) + 1
        return out, np.diff(np.concatenate([[0], word_ends]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each text)."""
        index, words = self.look_up(texts)
        id_at = self.id_at.data
        sizes = id_at[index + 1] - id_at[index]
        ends = np.cumsum(sizes)
        per_text = np.diff(np.concatenate([[0], ends[np.cumsum(words) - 1]]))
        return self.ids.data[spread(id_at[index], sizes)], per_text

    def sums(self, texts: list[str]) -> np.ndarray:
        """The sum of the ids of each text: its count, if the book holds counts."""
        ids, sizes = self.encode(texts)
        total = np.concatenate([[0], np.cumsum(ids, dtype=np.int64)])
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]


SPECIAL = "<|endoftext|>"


def opened(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def id_book(path: str, end_id: int | None) -> WordBook:
    """A book of token ids, from the tokenizers library, with end_id after each text."""
    tokenizer, letters = opened(path), byte_letters()
    tokenize = tokenizer.model.tokenize

    def ask(words: list[bytes]) -> tuple[np.ndarray, list[int]]:
        found = [tokenize(w.decode("latin-1").translate(letters)) for w in words]
        return np.fromiter((t.id for x in found for t in x), np.uint32), [len(x) for x in found]

    return WordBook(tokenizer, ask, SPECIAL, [tokenizer.token_to_id(SPECIAL)], [] if end_id is None else [end_id])


def count_book(path: str) -> WordBook:
    """A book of token counts, from the counting transducer."""
    counter = Counter(path)
    return WordBook(opened(path), lambda words: (np.array([counter.count(w) for w in words], np.uint32), np.ones(len(words), np.int64)), SPECIAL, [1], [])
