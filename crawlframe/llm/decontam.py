"""Benchmark decontamination by suffix arrays of the training text (operator 7).

Each task takes its documents in shards and builds a suffix array of a shard: word positions in the order of what follows
them. Every test suffix, cut to a window of ten words (or to its whole short item), is binary-searched in
every shard; the range that it finds holds all its verbatim places. Matches that go on from window to window give
the longest match of a document. Only suffixes whose first words all occur in the tests can match,
so only those are sorted.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.llm.common import Workspace, only, slices
from crawlframe.llm.words import byte_word_hashes

WINDOW = 10
SHARD = 2 << 20
#: Text of the tests that is broadcast at once; larger tests are searched block by block.
BLOCK_BYTES = 16 << 20
#: Pairs of a hit and an item that owns its window which are chained at once, by whole documents (one may hold more).
OWNERS = 4 << 20

_IN_WORD = np.ones(256, bool)
_IN_WORD[0x00:0x30] = _IN_WORD[0x3A:0x61] = _IN_WORD[0x7B:0x80] = False


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text)."""
    return byte_word_hashes(texts, _IN_WORD, b"\x00")


@dataclass
class Tests:
    """Different windows of a block of test items, as rows of word numbers, and the items of each."""

    words: np.ndarray  # sorted hashes of all words
    rows: np.ndarray  # windows x WINDOW, 0 after a short one
    sizes: np.ndarray
    owners: np.ndarray  # items of each window, one after the other
    offsets: np.ndarray
    places: np.ndarray  # where in its item the window stands, beside owners
    items: list

    @classmethod
    def of(cls, items: list[tuple[object, str]], window: int = WINDOW) -> Tests | None:
        texts = [(t or "").encode() for _, t in items]
        parts = [word_hashes(texts[a:b]) for a, b in slices([len(t) + 1 for t in texts], SHARD)]
        hashes, counts = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
        if not len(hashes):
            return None
        words = np.unique(hashes)
        numbers = np.searchsorted(words, hashes).astype(np.int32) + 1
        windows = np.where(counts > 0, np.maximum(1, counts - window + 1), 0)
        item = np.repeat(np.arange(len(items), dtype=np.int32), windows)
        place = (np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)).astype(np.int32)
        begin, sizes = (np.cumsum(counts) - counts)[item] + place, np.minimum(counts[item], window)
        padded = np.concatenate([numbers, np.zeros(window, np.int32)])
        rows = np.stack([np.where(sizes > j, padded[begin + j], 0).astype(np.int32) for j in range(window)], axis=1)
        order = np.lexsort(rows.T[::-1])
        rows = rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(1)
        offsets, rows = np.append(np.flatnonzero(new), len(rows)), rows[new]
        names = [None if name is None else str(name) for name, _ in items]
        return cls(words, rows, (rows > 0).sum(1), item[order], offsets, place[order], names)


def suffix_array(numbers: np.ndarray, reach: np.ndarray, least: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in suffix order, their next ``window`` words), of suffixes that begin with ``least`` known words."""
    at = np.flatnonzero(reach >= least)
    padded = np.concatenate([numbers, np.zeros(window, np.int32)])
    rows = padded[at[:, None] + np.arange(window)]
    rows[np.arange(window) >= reach[at][:, None]] = 0
    order = np.lexsort(rows.T[::-1])
    return at[order], rows[order]


def search(rows: np.ndarray, wanted: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last row that begins with each wanted prefix, by binary search of all at once."""
    mask = np.arange(wanted.shape[1]) < sizes[:, None]
    out = []
    for strict in (False, True):
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(rows))
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            gap = np.where(mask[open_], rows[mid].astype(np.int64) - wanted[open_], 0)
            first = (gap != 0).argmax(1)
            sign = np.sign(gap[np.arange(len(gap)), first])
            below = sign <= 0 if strict else sign < 0
            low[open_[below]] = mid[below] + 1
            high[open_[~below]] = mid[~below]
        out.append(low)
    return out[0], out[1]


def match(texts: list[bytes], tests: Tests) -> tuple[np.ndarray, list[tuple[int, np.ndarray, list[int], int]]]:
    """(words of each text, for each text with hits: index, hit word positions, items, words of its longest match)."""
    hashes, counts = word_hashes(texts)
    if not len(hashes):
        return counts, []
    at = np.minimum(np.searchsorted(tests.words, hashes), len(tests.words) - 1)
    numbers = np.where(tests.words[at] == hashes, at + 1, 0).astype(np.int32)
    ends = np.cumsum(counts)
    stop = np.zeros(len(numbers) + 1, bool)  # where a run of known words is over
    stop[:-1] = numbers == 0
    stop[ends] = True
    places = np.flatnonzero(stop)
    stops = places[np.searchsorted(places, np.arange(len(numbers)) + 1)]
    reach = np.where(numbers > 0, stops - np.arange(len(numbers)), 0)
    array, rows = suffix_array(numbers, reach, int(tests.sizes.min()), tests.rows.shape[1])
    low, high = search(rows, tests.rows, tests.sizes)
    hits = high - low
    if not hits.any():
        return counts, []
    window = np.repeat(np.arange(len(hits)), hits)
    begin = np.cumsum(hits) - hits
    position = array[np.arange(len(window)) - np.repeat(begin, hits) + np.repeat(low, hits)]
    size = tests.sizes[window]
    cover = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(cover, position, 1)
    np.add.at(cover, position + size, -1)
    hit = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
    doc = np.searchsorted(ends, position, side="right")
    order = np.argsort(doc, kind="stable")
    doc, window, position = doc[order], window[order], position[order]
    owned = np.bincount(doc, (tests.offsets[window + 1] - tests.offsets[window]).astype(float), len(counts)).astype(np.int64)
    hit_doc = np.searchsorted(ends, hit, side="right")
    out = []
    for first, past in slices(owned.tolist(), OWNERS):
        mine = slice(*np.searchsorted(doc, [first, past]))
        for k, items, longest in _longest(tests, doc[mine], window[mine], position[mine]):
            out.append((k, hit[slice(*np.searchsorted(hit_doc, [k, k + 1]))] - (ends[k] - counts[k]), items, longest))
    return counts, out


def _longest(tests: Tests, doc: np.ndarray, window: np.ndarray, position: np.ndarray):
    """(document, items, words of its longest match with one item) for each document of the hits, of windows at positions."""
    if not len(doc):
        return
    owners = tests.offsets[window + 1] - tests.offsets[window]
    pick = np.arange(owners.sum()) - np.repeat(np.cumsum(owners) - owners - tests.offsets[window], owners)
    item, diagonal = tests.owners[pick], np.repeat(position, owners) - tests.places[pick]
    doc, position, size = (np.repeat(x, owners) for x in (doc, position, tests.sizes[window]))
    order = np.lexsort((position, diagonal, item, doc))
    doc, item, diagonal, position, size = (x[order] for x in (doc, item, diagonal, position, size))
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(diagonal) != 0) | (np.diff(position) != 1)
    starts = np.flatnonzero(new)
    lasts = np.append(starts[1:], len(doc)) - 1
    lengths = position[lasts] + size[lasts] - position[starts]
    for k in np.unique(doc):
        mine = slice(*np.searchsorted(doc, [k, k + 1]))
        yield int(k), np.unique(item[mine]).tolist(), int(lengths[slice(*np.searchsorted(doc[starts], [k, k + 1]))].max())


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES):
    """The test items (item_id, text), in blocks whose text is at most about ``limit`` bytes."""
    rows = only(benchmark, "item_id", "text").filter(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // limit)
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in part.toLocalIterator()]


def _search_block(rows: DataFrame, items: list, window: int) -> DataFrame:
    """``rows`` with the hits of one more block in its columns n_words, hits, items and longest."""
    tests = Tests.of(items, window)
    handle = rows.sparkSession.sparkContext.broadcast(tests)

    def run(batches):
        for pdf in batches:
            texts = [(t or "").encode() for t in pdf["text"]]
            n_words = np.zeros(len(pdf), np.int64)
            hits = [np.asarray(x, np.int64) for x in pdf["hits"]]
            found = [list(x) for x in pdf["items"]]
            longest = pdf["longest"].to_numpy().copy()
            for a, b in slices([len(t) + 1 for t in texts], SHARD):
                if handle.value is None:
                    n_words[a:b] = word_hashes(texts[a:b])[1]
                    continue
                n_words[a:b], matches = match(texts[a:b], handle.value)
                for k, words, own, size in matches:
                    hits[a + k] = np.union1d(hits[a + k], words)
                    found[a + k] += [handle.value.items[i] for i in own if handle.value.items[i] is not None]
                    longest[a + k] = max(longest[a + k], size)
            yield pdf.assign(n_words=n_words, hits=hits, items=[sorted(set(x)) for x in found], longest=longest)

    return rows.mapInPandas(run, rows.schema)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, hits, longest) of each document.

    ``hits`` are positions of hit words, ``items`` the ids of items found, ``longest`` the words of the longest
    verbatim match with one item. A null text has no words. Items without words never match; an item whose id is
    null hits words but is not listed; repeated items count once. Repeated documents get repeated rows. With an
    empty benchmark nothing is hit. A benchmark beyond :data:`BLOCK_BYTES` is searched in blocks, between which
    the table is written, so that no more than one block is held.
    """
    start = only(docs, "doc_id", "text").select("*", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<long>)").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"), F.lit(0).cast("long").alias("longest"))
    found, work, done = start, None, 0
    for block in blocks(benchmark):
        if done:
            work = work or Workspace(docs.sparkSession, "decontamination")
            found = work.save(found, f"block{done}")
        found = _search_block(found, block, window)
        done += 1
    if not done:
        found = _search_block(found, [], window)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        "items",
        "hits",
        "longest",
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of the benchmark."""
    def untouched(handle):
        def good(texts: pd.Series) -> pd.Series:
            raw = [(t or "").encode() for t in texts]
            out = np.ones(len(raw), bool)
            for a, b in slices([len(t) + 1 for t in raw], SHARD):
                if handle.value is not None:
                    for k, *_ in match(raw[a:b], handle.value)[1]:
                        out[a + k] = False
            return pd.Series(out)

        return F.pandas_udf(good, "boolean")

    kept = docs
    for items in blocks(benchmark):
        kept = kept.filter(untouched(docs.sparkSession.sparkContext.broadcast(Tests.of(items, window)))(F.col("text")))
    return kept


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns of :func:`find`."""
    return find(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE = r"""
with words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), items as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null
), windows as (
  select distinct item_id, least(len(w), 10) as size, array_to_string(w[i:i + 9], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0)
), sizes as (select distinct size from windows),
spots as (
  select doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') as win
  from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from words), sizes
  where p + size - 1 <= len(w)
), hits as (
  select doc_id, p, s.size, item_id from spots s join windows v on s.size = v.size and s.win = v.win
), hit_words as (
  select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + size)) as q from hits) group by doc_id
), hit_items as (
  select doc_id, count(*) as n_items, sha256(string_agg(i, ',' order by i)) as items_sha256
  from (select distinct doc_id, cast(item_id as varchar) as i from hits) group by doc_id
)
select d.doc_id, cast(coalesce(len(d.w), 0) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, coalesce(items_sha256, sha256('')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from words d left join hit_words h on d.doc_id = h.doc_id left join hit_items i on d.doc_id = i.doc_id
"""
