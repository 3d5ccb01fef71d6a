"""Token counts by finite-state tokenizer compilation (operator 8).

For a BPE vocabulary the last token of every prefix of a text is determined: it is the token whose
predecessor it is compatible with (BPE of the two together leaves both as they are). A state holds, for every
suffix of the input that may still grow into a token, the token before it and how many tokens have been
counted since. That is all the future depends on, so reading a character is a transition to
another such state, annotated with the change of the token count. States and transitions are made when they
are first met and kept in a hash table that numpy searches for thousands of chunks at a time.

A chunk stands for a map from entry state to exit state and count. Maps are tabled on the entries that can occur: the start,
and every exit of the chunk before, until the tables are closed. All chunks are evaluated side by side, and an entry
only until its trace meets that of the start, which takes a few characters in most texts. A parallel prefix scan
then composes the maps in a logarithmic number of steps, which gives each chunk its true entry and the count before it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from crawlframe.llm.common import only, slices

SPACE = "▁"
GROUP = 4 << 20
LANES = 8192
#: Slots for transitions; with half of them filled the next texts start the compilation anew. Within a group of texts it doubles.
SLOTS = 1 << 22


class Vocabulary:
    """Pieces, scores and compatibility of a BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in normal}
        self.ids = {p: k for k, p in enumerate(self.scores)}
        self.pieces = list(self.scores)
        self.inside = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.trie: list[dict[str, int]] = [{}]
        self.token = [-1]
        self.first = [""]
        for k, piece in enumerate(self.pieces):
            node = 0
            for c in piece:
                nxt = self.trie[node].get(c)
                if nxt is None:
                    nxt = self.trie[node][c] = len(self.trie)
                    self.trie.append({})
                    self.token.append(-1)
                    self.first.append(piece[0])
                node = nxt
            self.token[node] = k
        self._fits: dict[tuple[int, int], bool] = {}

    def bpe(self, text: str) -> list[str]:
        """Merge the best-scored adjacent pair, the leftmost of equals, while there is one."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, u: int, t: int) -> bool:
        """Whether tokens u and t stay apart; -1 stands for a place that nothing merges across."""
        if u < 0:
            return True
        known = self._fits.get((u, t))
        if known is None:
            a, b = self.pieces[u], self.pieces[t]
            known = a[-1] + b[0] not in self.inside or self.bpe(a + b) == [a, b]
            self._fits[u, t] = known
        return known


class CountingTransducer:
    """The compiled machine; symbols are characters of the vocabulary, four kinds of unknown ones, and the end of a text."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        known = sorted({c for p in vocabulary.pieces for c in p})
        self.chars = [*known, "", "", "", ""]
        self.width = len(self.chars) + 1
        self.end = self.width - 1
        self.symbol = np.empty(0x110000, np.int32)
        for size, (a, b) in enumerate(((0, 0x80), (0x80, 0x800), (0x800, 0x10000), (0x10000, 0x110000))):
            self.symbol[a:b] = len(known) + size
        for k, c in enumerate(known):
            self.symbol[ord(c)] = k
        self.symbol[32] = self.symbol[ord(SPACE)]
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, int] = {}
        self.defs: list[tuple] = []
        self._table(SLOTS)
        self.start = self._state(((0, -1, 0),))

    def _table(self, slots: int) -> None:
        self.keys = np.full(slots, -1, np.int64)
        self.next = np.zeros(slots, np.int32)
        self.emit = np.zeros(slots, np.int16)
        self.filled = 0

    def _state(self, definition: tuple) -> int:
        k = self.states.get(definition)
        if k is None:
            k = self.states[definition] = len(self.defs)
            self.defs.append(definition)
        return k

    def _transition(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, change of the count), from the definition of BPE."""
        if symbol == self.end:
            return self.start, 0
        c = self.chars[symbol]
        if not c:  # unknown: one byte token for each of its UTF-8 bytes
            return self.start, symbol - self.end + 5
        v = self.v
        token, emitted, grown = -2, 0, []
        for node, u, since in self.defs[state]:
            child = v.trie[node].get(c)
            if child is None:
                continue
            if node == 0 and u >= 0 and v.pieces[u][-1] + c not in v.inside:
                u = -1
            t = v.token[child]
            if t >= 0 and token == -2 and v.fits(u, t):
                token, emitted = t, 1 - since
            if v.trie[child]:
                grown.append((child, u, since))
        if token == -2:
            raise ValueError(f"no token of the vocabulary ends with {c!r}")
        return self._state((*((n, u, since + emitted) for n, u, since in grown), (0, token, 0))), emitted

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; transitions that are missing are made."""
        at, room = self._slots(keys), len(self.keys)
        open_ = np.flatnonzero(self.keys[at] != keys)
        while len(open_):
            missing = self.keys[at[open_]] == -1
            if missing.any():
                for key in np.unique(keys[open_[missing]]).tolist():
                    self._insert(key, *self._transition(*divmod(key, self.width)))
                if len(self.keys) != room:
                    return self._find(keys)
                at[open_] = self._slots(keys[open_])
            else:
                at[open_] = (at[open_] + 1) % room
            open_ = open_[self.keys[at[open_]] != keys[open_]]
        return at

    def _insert(self, key: int, following: int, emitted: int) -> None:
        if 2 * self.filled >= len(self.keys):
            old = [x[self.keys != -1].tolist() for x in (self.keys, self.next, self.emit)]
            self._table(2 * len(self.keys))
            for entry in zip(*old):
                self._insert(*entry)
        slot = int(self._slots(np.array([key]))[0])
        while self.keys[slot] != -1:
            slot = (slot + 1) % len(self.keys)
        self.keys[slot], self.next[slot], self.emit[slot] = key, following, emitted
        self.filled += 1

    def _step(self, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = self._find(state.astype(np.int64) * self.width + symbols)
        return self.next[slot], self.emit[slot]

    def _run(self, symbols: np.ndarray) -> np.ndarray:
        """Count up to and with each symbol."""
        lanes = min(LANES, max(1, len(symbols) // 64))
        size = -(-len(symbols) // lanes)
        padded = np.full(lanes * size, self.end, np.int64)
        padded[: len(symbols)] = symbols
        grid = np.ascontiguousarray(padded.reshape(lanes, size).T)
        trace = np.empty((size + 1, lanes), np.int32)
        emitted = np.empty((size, lanes), np.int16)
        trace[0] = self.start
        for k in range(size):
            trace[k + 1], emitted[k] = self._step(trace[k], grid[k])
        entries, exits, counts = self._maps(grid, trace, emitted)
        index, before = self._scan(entries, exits, counts)
        true = entries[np.arange(lanes), index]
        lane = np.flatnonzero(true != self.start)
        state = true[lane]
        for k in range(size):
            if not len(lane):
                break
            state, emitted[k, lane] = self._step(state, grid[k, lane])
            apart = state != trace[k + 1, lane]
            lane, state = lane[apart], state[apart]
        return (np.cumsum(emitted, axis=0, dtype=np.int64) + before).T.reshape(-1)[: len(symbols)]

    def _maps(self, grid: np.ndarray, trace: np.ndarray, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entries, exits, counts), a row for each lane: its map on the start and on every exit of the lane before."""
        size, lanes = grid.shape
        before = np.zeros((size + 1, lanes), np.int32)
        np.cumsum(emitted, axis=0, out=before[1:])
        entries, exits, counts = trace[0][:, None].copy(), trace[size][:, None].copy(), before[size][:, None].copy()
        filled = np.ones(lanes, np.int64)
        while True:
            lane, state = [], []
            for j in range(entries.shape[1]):
                wanted = exits[:-1, j]
                lacking = np.flatnonzero((j < filled[:-1]) & ~(entries[1:] == wanted[:, None]).any(1))
                lane, state = [*lane, lacking + 1], [*state, wanted[lacking]]
            lane, first = np.unique(np.concatenate(lane), return_index=True)  # one for each lane at a time
            if not len(lane):
                return entries, exits, counts
            state = np.concatenate(state)[first]
            if filled[lane].max() == entries.shape[1]:
                entries, exits, counts = (np.concatenate([x, np.full((lanes, 1), -1, x.dtype)], axis=1) for x in (entries, exits, counts))
            column = filled[lane]
            entries[lane, column] = state
            filled[lane] += 1
            total = np.zeros(len(lane), np.int32)
            left = np.arange(len(lane))
            for k in range(size):
                state[left], change = self._step(state[left], grid[k, lane[left]])
                total[left] += change
                met = state[left] == trace[k + 1, lane[left]]
                done = left[met]
                total[done] += before[size, lane[done]] - before[k + 1, lane[done]]
                state[done] = trace[size, lane[done]]
                left = left[~met]
                if not len(left):
                    break
            exits[lane, column], counts[lane, column] = state, total

    def _scan(self, entries: np.ndarray, exits: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(column of each lane's true entry, count before each lane), by composing all prefixes of the maps.

        After each step a map stands for twice as many lanes, so the steps are the binary logarithm of the lanes.
        """
        lanes, self.steps = len(entries), 0
        maps = np.zeros(entries.shape, np.int64)
        for j in range(entries.shape[1]):
            maps[:-1, j] = (entries[1:] == exits[:-1, j : j + 1]).argmax(1)
        totals, span = counts.astype(np.int64), 1
        while span < lanes:
            earlier = maps[:-span]
            totals[span:] = totals[:-span] + np.take_along_axis(totals[span:], earlier, 1)
            maps[span:] = np.take_along_axis(maps[span:], earlier, 1)
            span, self.steps = 2 * span, self.steps + 1
        return np.append(0, maps[:-1, 0]), np.append(0, totals[:-1, 0])

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; an empty one has none."""
        if self.filled > SLOTS // 2 or len(self.defs) > 2_000_000:
            self.clear()
        out = np.zeros(len(texts), np.int64)
        full = [i for i, t in enumerate(texts) if t]
        for a, b in slices([len(texts[i]) + 2 for i in full], GROUP):
            own = full[a:b]
            stream = "".join(f"{SPACE}{texts[i]}\n" for i in own)
            symbols = self.symbol[np.frombuffer(stream.encode("utf-32-le", "surrogatepass"), np.uint32)]
            ends = np.cumsum([len(texts[i]) + 2 for i in own])
            symbols[ends - 1] = self.end
            total = self._run(symbols)[ends - 1]
            out[own] = np.diff(total, prepend=0)
        return out


@lru_cache(2)
def transducer(path: str) -> CountingTransducer:
    return CountingTransducer(Vocabulary(path))


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each whole text.

    A null text counts as empty: no bytes, no tokens. Repeated rows get repeated results; other columns
    are left out; an empty table gives an empty result.
    """
    def run(batches):
        machine = transducer(path)
        for pdf in batches:
            texts = ["" if t is None else t for t in pdf["text"].tolist()]
            n = machine.count(texts)
            yield pdf[["doc_id"]].assign(n_bytes=[len(t.encode()) for t in texts], n_tokens=n, over_limit=n > limit)

    rows = only(docs, "doc_id", "text")
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
