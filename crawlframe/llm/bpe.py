"""Byte-level BPE encoding and decoding by corpus-level merge replay (operator 9).

All words of a task's share of the corpus that were not met before form one array of byte tokens
with links to their neighbours. An inverted index from rank (that is, from token pair) to positions
drives the replay: ranks are taken in order, each is applied at all its positions at once, and
only pairs that touch a merged place are looked up again. Words are independent of each other, so
a share can be replayed alone: no word is shuffled, and a lost task is simply run again.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from crawlframe.llm.common import only, slices
from crawlframe.llm.words import ByteTable, WordTable, encode_checked, split

#: Characters of text that are encoded together; bounds a worker's memory.
GROUP = 8 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of lines ``base64-token rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class MergeReplay:
    """Encodes words by replaying the merges that ``ranks`` stands for."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.width = max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.of_key = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], -1)
        self.none = self.width

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.of_key[at], self.none)

    def one(self, word: bytes) -> list[int]:
        """A single word, pair by pair: the definition that the replay has to agree with."""
        if word in self.ranks:
            return [self.ranks[word]]
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], self.none), i) for i in range(len(parts) - 1))
            if best == self.none:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def encode(self, words: list[bytes]) -> list:
        """Ids of each word. An empty word has none."""
        out: list = [None] * len(words)
        open_ = []
        for i, w in enumerate(words):
            known = self.ranks.get(w)
            if known is not None:
                out[i] = (known,)
            elif not w:
                out[i] = ()
            else:
                open_.append(i)
        sizes = [len(words[i]) for i in open_]
        for a, b in slices(sizes, 4 << 20):
            self._replay([words[i] for i in open_[a:b]], open_[a:b], out)
        return out

    def _replay(self, words: list[bytes], where: list[int], out: list) -> None:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        n = int(ends[-1])
        tok = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - lengths] = -1
        alive = np.ones(n, bool)
        rank = np.full(n, self.none)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self._rank(tok[inner], tok[after[inner]])
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def put(positions: np.ndarray) -> None:
            r = rank[positions]
            keep = r < self.none
            positions, r = positions[keep], r[keep]
            if not len(positions):
                return
            order = np.argsort(r, kind="stable")
            positions, r = positions[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for value, group in zip(r[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts)):
                if value in index:
                    index[value].append(group)
                else:
                    index[value] = [group]
                    heapq.heappush(queue, value)

        put(inner)
        odd: set[int] = set()
        while queue:
            r = heapq.heappop(queue)
            groups = index.pop(r)
            p = groups[0] if len(groups) == 1 else np.unique(np.concatenate(groups))
            p = p[alive[p] & (rank[p] == r)]
            if not len(p):
                continue
            if len(p) > 1:  # of overlapping pairs, every second one: the leftmost goes first
                chained = np.append(False, after[p[:-1]] == p[1:])
                if chained.any():
                    k = np.arange(len(p))
                    p = p[(k - np.maximum.accumulate(np.where(chained, 0, k))) % 2 == 0]
            gone = after[p]
            right = after[gone]
            alive[gone] = False
            tok[p] = r
            after[p] = right
            has = right >= 0
            before[right[has]] = p[has]
            rank[p] = self.none
            q = p[has]
            rank[q] = self._rank(tok[q], tok[right[has]])
            left = before[p]
            left = left[left >= 0]
            rank[left] = self._rank(tok[left], tok[after[left]])
            touched = np.concatenate([q, left[~np.isin(left, q)]]) if len(left) and len(q) else np.concatenate([q, left])
            early = touched[rank[touched] < r]
            if len(early):  # an earlier rank has become possible: such words are done pair by pair
                odd.update(np.searchsorted(ends, early, side="right").tolist())
            put(touched)
        final = tok[alive]
        counts = np.add.reduceat(alive.astype(np.int64), ends - lengths)
        cuts = np.concatenate([[0], np.cumsum(counts)]).tolist()
        final = final.tolist()
        for k, i in enumerate(where):
            out[i] = final[cuts[k] : cuts[k + 1]]
        for k in odd:
            out[where[k]] = self.one(words[k])


class ByteBpe:
    """Whole texts to ids and back."""

    def __init__(self, path: str):
        self.replay = MergeReplay(read_ranks(path))
        self.table = WordTable(lambda words: self.replay.encode([w.encode() for w in words]))
        tokens = [b""] * self.replay.width
        for token, rank in self.replay.ranks.items():
            tokens[rank] = token
        self.bytes = ByteTable(tokens)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; what does not decode to its text (a clash of word hashes) is done word by word."""
        return encode_checked(self.table, self.bytes, texts, self.exact)

    def exact(self, text: str) -> np.ndarray:
        whole, begins, stops, _, _ = split([text])
        ids = [x for a, b in zip(begins, stops) for x in self.replay.one(whole[a:b].encode())]
        return np.array(ids, np.uint32)


@lru_cache(2)
def codec(path: str) -> ByteBpe:
    return ByteBpe(path)


def _groups(pdf):
    texts = pdf["text"].tolist()
    texts = ["" if t is None else t for t in texts]
    for a, b in slices([len(t) for t in texts], GROUP):
        yield pdf.iloc[a:b], texts[a:b]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids binary): ids of each whole text as little-endian unsigned 32-bit integers.

    A null text counts as empty and has no ids; repeated rows give repeated results; other columns
    are left out; an empty table gives an empty result.
    """
    def run(batches):
        coder = codec(path)
        for pdf in batches:
            for part, texts in _groups(pdf):
                yield part[["doc_id"]].assign(ids=[r.astype("<u4").tobytes() for r in coder.encode(texts)])

    rows = only(docs, "doc_id", "text")
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text): the inverse of :func:`encode`. Null ids give a null text."""
    def run(batches):
        coder = codec(path)
        for pdf in batches:
            texts = [None if x is None else coder.bytes.decode(np.frombuffer(x, "<u4")).decode("utf-8", "replace") for x in pdf["ids"]]
            yield pdf[["doc_id"]].assign(text=texts)

    rows = only(encoded, "doc_id", "ids")
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document, encoded and decoded in one pass.

    Cases as in :func:`encode`: a null text has the digests of nothing.
    """
    def run(batches):
        coder = codec(path)
        for pdf in batches:
            for part, texts in _groups(pdf):
                rows = coder.encode(texts)
                yield part[["doc_id"]].assign(
                    n_tokens=[len(r) for r in rows],
                    ids_sha256=[hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows],
                    decoded_sha256=[hashlib.sha256(coder.bytes.decode(r)).hexdigest() for r in rows],
                )

    rows = only(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
