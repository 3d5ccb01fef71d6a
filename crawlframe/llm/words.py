"""Vectorised byte-level pre-tokenisation shared by the two byte-level BPE operators.

The pattern is the usual byte-level one: contractions, letters, digits or other signs with one space
before them, and white space. numpy finds the boundaries of a whole batch at once; a 64-bit
polynomial hash names each word, so Python touches only words it has not met. Callers compare the
decoded bytes with the text, so a hash collision can never pass unseen.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd

from crawlframe.llm.common import slices

L, N, O, S, END = 0, 1, 2, 3, 4
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1
CHUNK = 1 << 18


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point; one more entry stands for the end of a text."""
    import regex

    out = np.full(0x110001, O, np.uint8)
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for pattern, kind in ((r"\p{L}+", L), (r"\p{N}+", N)):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = O
    out[_SPACES] = S
    out[0x110000] = END
    return out


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.ones(1, np.uint64)
        while len(p) < 2 * CHUNK:
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
        out.append(p)
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def pieces(text: str, limit: int = CHUNK // 2) -> list[str]:
    """Cut a long text where a word surely begins: at a space with no white space on either side.

    Where no such place exists the piece stays as long as it must; :func:`split` then
    works on longer arrays.
    """
    if len(text) <= limit:
        return [text]
    out, at = [], 0
    while len(text) - at > limit:
        cut = at + limit
        while (cut := text.find(" ", cut)) != -1:
            if cut + 1 < len(text) and not text[cut - 1].isspace() and not text[cut + 1].isspace():
                break
            cut += 1
        if cut == -1:
            break
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out


def split(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts: (joined text, starts, ends, hashes, index of the text of each word).

    An empty text has no words.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    whole = "\x00".join(texts) + "\x00"
    cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends_at = np.cumsum(sizes + 1) - 1
    cp[ends_at] = 0x110000
    kind = classes()[cp]
    space = kind == S
    n = len(cp)
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    last = space.copy()  # the last space of a run, if a text goes on after it
    last[:-1] &= ~space[1:] & (kind[1:] != END)
    last[-1] = False
    start |= last
    joined = np.zeros(n, bool)  # what follows a last " " belongs to its word
    joined[1:] = last[:-1] & (cp[:-1] == 32)
    start &= ~joined
    apostrophes = np.flatnonzero((cp == 39) & start)
    if len(apostrophes):
        _contractions(cp, kind, start, apostrophes, n)
    start |= kind == END
    begins = np.flatnonzero(start)
    stops = np.append(begins[1:], n)
    real = kind[begins] != END
    begins, stops = begins[real], stops[real]
    up, down = _powers()
    if n > len(up):
        up, down = _longer(n)
    terms = mixed((cp + 1).astype(np.uint64)) * up[:n]
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(terms, out=total[1:])
    hashes = mixed((total[stops] - total[begins]) * down[begins] + (stops - begins).astype(np.uint64))
    return whole, begins, stops, hashes, np.searchsorted(ends_at, begins)


def _longer(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.ones(1, np.uint64)
        while len(p) < n:
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
        out.append(p[:n])
    return out[0], out[1]


def _contractions(cp, kind, start, at, n) -> None:
    """'s 't 'm 'd 're 've 'll where a word begins at the sign."""
    one = cp[np.minimum(at + 1, n - 1)]
    two = cp[np.minimum(at + 2, n - 1)]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
    for mask, size in ((short, 2), (long, 3)):
        p = at[mask]
        start[p + 1] = False
        start[np.minimum(p + size, n - 1)] = True


_SIGNS = mixed(np.arange(1, 257, dtype=np.uint64))


def byte_word_hashes(texts: list[bytes], inside: np.ndarray, between: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, number of words of each text), A-Z in lower case.

    ``inside`` tells which bytes are part of words; ``between`` is one that is not.
    """
    raw = np.frombuffer((between.join(texts) + between).lower(), np.uint8)
    member = inside[raw]
    edge = np.diff(member.astype(np.int8), prepend=np.int8(0))
    begins, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(raw)
    up, down = _powers()
    if n > len(up):
        up, down = _longer(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_SIGNS[raw] * up[:n], out=total[1:])
    hashes = mixed((total[stops] - total[begins]) * down[begins] + (stops - begins).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    return hashes, np.diff(np.searchsorted(begins, ends), prepend=0)


def gather(offsets: np.ndarray, store: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate ``store[offsets[i]:offsets[i + 1]]`` for each i of ``index``: (values, lengths)."""
    begins = offsets[index]
    lengths = offsets[1:][index] - begins
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return store[:0], lengths
    where = np.arange(ends[-1])
    where += np.repeat(begins - (ends - lengths), lengths)
    return store[where], lengths


class WordTable:
    """Ids of each word met so far, kept up to ``limit`` words; then it starts anew."""

    def __init__(self, encode, limit: int = 2_000_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted
        self.rows = np.zeros(0, np.int32)  # the row of each hash
        self.offsets = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _add(self, hashes: np.ndarray, words: list[str]) -> None:
        rows = self.encode(words)
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(rows), np.uint32, int(lengths.sum()))])
        known, order = len(self.hashes), np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.rows = np.insert(self.rows, at, (known + order).astype(np.int32))

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text ends)."""
        if len(self.hashes) > self.limit:
            self.clear()
        parts = [pieces(t) for t in texts]
        flat = [p for ps in parts for p in ps]
        wholes, spans, hashes, counts = [], [], [], []
        for a, b in slices([len(p) + 1 for p in flat], CHUNK):
            whole, begins, stops, named, owner = split(flat[a:b])
            wholes.append(whole)
            spans.append((begins.astype(np.int32), stops.astype(np.int32)))
            hashes.append(named)
            counts.append(np.bincount(owner, minlength=b - a))
        if not hashes:
            return self.ids[:0], np.zeros(0, np.int64)
        codes, distinct = pd.factorize(np.concatenate(hashes))
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero(self.hashes[at] != distinct) if len(self.hashes) else np.arange(len(distinct))
        if len(new):
            first = np.empty(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            first = first[new]
            bounds = np.cumsum([0, *map(len, hashes)])
            words, order = [], np.argsort(first)
            for k, whole in enumerate(wholes):
                own = first[order[slice(*np.searchsorted(first[order], bounds[k : k + 2]))]] - bounds[k]
                words += [whole[i:j] for i, j in zip(spans[k][0][own].tolist(), spans[k][1][own].tolist())]
            self._add(distinct[new][order], words)
            at = np.searchsorted(self.hashes, distinct)
        ids, lengths = gather(self.offsets, self.ids, self.rows[at][codes])
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(np.concatenate(counts))]
        return ids, ends[np.cumsum([len(ps) for ps in parts]) - 1]


class ByteTable:
    """Bytes of each id, for vectorised decoding."""

    def __init__(self, tokens: list[bytes]):
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.store = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.offsets, self.store, ids)[0].tobytes()


def encode_checked(table: WordTable, tokens: ByteTable, texts: list[str], exact, apart=()) -> list[np.ndarray]:
    """Ids of each text; ``exact`` does a text whose ids don't decode to it, or that holds a string of ``apart``."""
    ids, ends = table.tokens(texts)
    rows = np.split(ids, ends[:-1]) if len(ends) else []
    whole = "".join(texts)
    sound = tokens.decode(ids) == whole.encode()
    if not sound or any(s in whole for s in apart):
        for i, text in enumerate(texts):
            if any(s in text for s in apart) or not sound and tokens.decode(rows[i]) != text.encode():
                rows[i] = exact(text)
    return rows
