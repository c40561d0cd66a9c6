"""Finite-state machines for byte-level BPE: one cuts text into words, one counts a word's tokens.

The splitter is a deterministic transducer over character classes for the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Its look-ahead becomes delayed output: a transition may announce a word start at this character, at the one before, or
both. A text is cut into chunks; each chunk yields a map from entry state to exit state, the maps are composed by a
parallel prefix scan, and a second pass from the now known entry states writes the starts.

The counter is a deterministic transducer over bytes whose transitions carry the change in the number of emitted tokens.
It rests on a property of BPE: the encoding of a prefix ends in the one token t for which (last token of the encoding
without t, t) is a pair that BPE leaves as it is. A state is the longest tail that may still grow into a token, with the last
token and the relative count at each of its positions, so there are finitely many; they are compiled when first met.
"""

from __future__ import annotations

import json

import numpy as np
import regex

OTHER, LETTER, NUMBER, APOSTROPHE, SPACE, BLANK, STMD, RV, E, ELL, END = range(11)
START, IN_L, IN_N, IN_O, ONE_SPACE, TO_SPACE, ONE_BLANK, TO_BLANK, QUOTE, QUOTE_RV, QUOTE_L = range(11)
N_CLASSES, N_STATES = 11, 11
HERE, BEFORE = 1, 2


def character_classes(pre_tokenizer) -> np.ndarray:
    """The class of each code point, as pre_tokenizer (of the tokenizers library) has it.

    Two libraries may know different versions of Unicode: a letter or digit of this one must also stay in one word
    between two plain ones there, else it is OTHER.
    """
    every = "".join("!" if 0xD800 <= c < 0xE000 else chr(c) for c in range(0x110000))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    for plain, kind in (("a", LETTER), ("1", NUMBER)):
        points = np.flatnonzero(out == kind)
        for at in range(0, len(points), 4096):  # the library's answer takes far more than the question
            some = points[at : at + 4096]
            whole = {a for a, b in (x for _, x in pre_tokenizer.pre_tokenize_str("\n".join(f"{plain}{chr(c)}{plain}" for c in some))) if b - a == 3}
            out[some[[4 * i not in whole for i in range(len(some))]]] = OTHER
    for text, kind in (("'", APOSTROPHE), (" ", SPACE), ("stmd", STMD), ("rv", RV), ("e", E), ("l", ELL)):
        for c in text:
            out[ord(c)] = kind
    return out


def splitter_table() -> np.ndarray:
    """[state, class] -> state << 2 | output."""

    def fresh(c: int) -> tuple[int, int]:
        if c == END:
            return START, 0
        to = {NUMBER: IN_N, OTHER: IN_O, APOSTROPHE: QUOTE, SPACE: ONE_SPACE, BLANK: ONE_BLANK}.get(c, IN_L)
        return to, HERE

    def step(s: int, c: int) -> tuple[int, int]:
        letter, blank = c in (LETTER, STMD, RV, E, ELL), c in (SPACE, BLANK)
        kind = IN_L if letter else IN_N if c == NUMBER else IN_O if c in (OTHER, APOSTROPHE) else None
        if s in (QUOTE_RV, QUOTE_L):
            if c == (E if s == QUOTE_RV else ELL):
                return START, 0
            to, out = (IN_L, 0) if letter else fresh(c)
            return to, out | BEFORE
        if s == QUOTE:
            if c in (STMD, RV, ELL):
                return {STMD: START, RV: QUOTE_RV, ELL: QUOTE_L}[c], 0
            return (IN_O, 0) if kind == IN_O else fresh(c)
        if s in (ONE_SPACE, TO_SPACE, ONE_BLANK, TO_BLANK):
            if blank:
                return (TO_SPACE if c == SPACE else TO_BLANK), 0
            if c == END:
                return START, 0
            if s == ONE_SPACE:
                return kind, 0
            if s == TO_SPACE:
                return kind, BEFORE
            to, out = fresh(c)
            return to, out | (BEFORE if s == TO_BLANK else 0)
        return (s, 0) if s in (IN_L, IN_N, IN_O) and kind == s else fresh(c)

    return np.array([[step(s, c)[0] << 2 | step(s, c)[1] for c in range(N_CLASSES)] for s in range(N_STATES)], np.uint8)


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps [chunk, state] by doubling: row i becomes the map of chunks 0 to i."""
    maps, d = maps.copy(), 1
    while d < len(maps):
        maps[d:] = np.take_along_axis(maps[d:], maps[:-d].astype(np.intp), 1)
        d *= 2
    return maps


class Splitter:
    def __init__(self, pre_tokenizer) -> None:
        self.classes = character_classes(pre_tokenizer)
        self.table = splitter_table().ravel()

    def starts(self, classes: np.ndarray, chunk: int = 256) -> np.ndarray:
        """For the classes of a text that ends in END: whether a word starts at each position."""
        n = len(classes)
        rows = -(-n // chunk)
        grid = np.full(rows * chunk, END, np.uint8)
        grid[:n] = classes
        grid = np.ascontiguousarray(grid.reshape(rows, chunk).T).astype(np.intp)
        state = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], rows, 1)
        for j in range(chunk):
            if j % 8 == 0 and len(state) > 1 and (state == state[0]).all():
                state = state[:1]  # the entry state no longer matters in any chunk
            state = self.table[state * np.intp(N_CLASSES) + grid[j]] >> 2
        maps = compose(np.broadcast_to(state.T, (rows, N_STATES)))
        state = np.concatenate([np.array([START], np.uint8), maps[:-1, START]])
        out = np.empty((chunk, rows), np.uint8)
        for j in range(chunk):
            to = self.table[state * np.intp(N_CLASSES) + grid[j]]
            out[j] = to & 3
            state = to >> 2
        out = out.T.ravel()[:n]
        found = (out & HERE).astype(bool)
        found[:-1] |= (out[1:] & BEFORE).astype(bool)
        return found


def byte_letters() -> dict[int, str]:
    """The printable stand-in that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Counter:
    """Tokens of a word of bytes, by a transducer compiled state by state from the merges of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of = {c: b for b, c in byte_letters().items()}
        raw = lambda s: bytes(of[c] for c in s)
        self.tokens = {raw(t) for t in model["vocab"] if all(c in of for c in t)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.prefixes = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.agrees: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.content = [(b"", ((b"", 0),))]
        self.number = {self.content[0]: 0}
        self.moves: dict[int, int] = {}

    def merged(self, word: bytes) -> list[bytes]:
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def fits(self, last: bytes, token: bytes) -> bool:
        key = (last, token)
        if (known := self.agrees.get(key)) is None:
            if len(self.agrees) > 200_000:
                self.agrees.clear()
            known = self.agrees[key] = self.merged(last + token) == ([last, token] if last else [token])
        return known

    def compiled(self, state: int, byte: int) -> int:
        tail, at = self.content[state]
        tail = tail + bytes((byte,))
        for k in range(len(tail), 0, -1):
            last, count = at[-k]
            if tail[-k:] in self.tokens and self.fits(last, tail[-k:]):
                token, emitted = tail[-k:], count + 1
                break
        else:
            raise ValueError(f"no token ends at byte {byte}")
        while tail and tail not in self.prefixes:
            tail = tail[1:]
        kept = (*at, (token, emitted))[-len(tail) - 1 :]
        content = (tail, tuple((t, c - emitted) for t, c in kept))
        if (to := self.number.get(content)) is None:
            to = self.number[content] = len(self.content)
            self.content.append(content)
        move = self.moves[state << 8 | byte] = to << 8 | emitted + 128
        return move

    def count(self, word: bytes) -> int:
        if len(self.content) > 150_000:
            self.reset()
        moves, state, total = self.moves, 0, 0
        for byte in word:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self.compiled(state, byte)
            state, total = move >> 8, total + (move & 255) - 128
        return total
