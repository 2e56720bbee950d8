"""What the grammar finds in a text, remembered by the worker: many manuscripts cite the same works in the same words.

A text is remembered once it is seen again, so that texts of their own do not
push others out. Results are held as bytes, of bounded size in all.
"""

from __future__ import annotations

import marshal
from collections.abc import Callable, Hashable, Sequence

import numpy as np
import pyarrow as pa

from reflume.functions import grammar

#: Bytes that one memory may hold: two halves, of which the older goes when the newer is full.
MOST_BYTES = 64 * 1024 * 1024
#: Places in the filter of texts seen once, and how many may be taken before it is emptied.
_PLACES = 1 << 22
_TAKEN = _PLACES // 8


class Memory:
    """work(text), computed once for texts that come again. Results are of plain types and equal, not the same, each time."""

    def __init__(self, work: Callable[[str], object]):
        self.work = work
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size, self.taken, self.seen = 0, 0, bytearray(_PLACES // 8)

    def _put(self, text: str, data: bytes) -> None:
        self.new[text] = data
        self.size += 2 * len(text) + len(data) + 200
        if self.size > MOST_BYTES // 2:
            self.old, self.new, self.size = self.new, {}, 0

    def __call__(self, text: str):
        data = self.new.get(text)
        if data is None and (data := self.old.get(text)) is not None:
            self._put(text, data)
        if data is not None:
            return marshal.loads(data)
        out = self.work(text)
        place = hash(text) % _PLACES
        at, bit = place >> 3, 1 << (place & 7)
        if self.seen[at] & bit:
            data = marshal.dumps(out)
            if len(data) < MOST_BYTES // 64:
                self._put(text, data)
        else:
            self.seen[at] |= bit
            self.taken += 1
            if self.taken > _TAKEN:
                self.seen, self.taken = bytearray(_PLACES // 8), 0
        return out


def found(text: str, fields: list[str] | None = None) -> list[dict]:
    """Citations with their keys, then invalid brackets, of a text: each with kind and nth."""
    cited, invalid = grammar.citations(text, fields)
    out = [c | {"kind": "citation", "nth": n, "keys": [grammar.item_keys(i) for i in c["items"]]} for n, c in enumerate(cited)]
    return out + [c | {"kind": "invalid", "nth": n} for n, c in enumerate(invalid)]


citations, entry = Memory(found), Memory(grammar.entry)


class Rows:
    """The rows that work(text) gives, held as Arrow columns: those of a text that comes again are taken by their numbers.

    A text is held once it is seen again. Chunks are merged as they grow, so
    that they stay few; the number of a row never changes. Beyond MOST_HELD
    bytes everything goes, and what is still in use comes back.
    """

    def __init__(self, work: Callable[[str], Sequence], schema: pa.Schema, pack: Callable[[list, pa.Schema], pa.RecordBatch] = pa.RecordBatch.from_pylist):
        self.work, self.schema, self.pack = work, schema, pack
        self.taken, self.seen = 0, bytearray(_PLACES // 8)
        self._empty()

    def _empty(self) -> None:
        self.numbers: dict[str, int] = {}
        self.bounds, self.texts = np.zeros(1024, np.int64), 0  # rows of the k-th text: from bounds[k] up to bounds[k + 1]
        self.chunks: list[pa.RecordBatch] = []
        self.size = 0

    def _again(self, text: str) -> bool:
        place = hash(text) % _PLACES
        at, bit = place >> 3, 1 << (place & 7)
        if self.seen[at] & bit:
            return True
        self.seen[at] |= bit
        self.taken += 1
        if self.taken > _TAKEN:
            self.seen, self.taken = bytearray(_PLACES // 8), 0
        return False

    def _hold(self, texts: list[str], rows: pa.RecordBatch, counts: np.ndarray) -> None:
        if self.size > MOST_HELD:
            self._empty()
        n = self.texts + len(texts)
        while len(self.bounds) < n + 1:
            self.bounds = np.concatenate([self.bounds, np.zeros(len(self.bounds), np.int64)])
        self.bounds[self.texts + 1 : n + 1] = self.bounds[self.texts] + np.cumsum(counts)
        self.numbers |= zip(texts, range(self.texts, n), strict=True)
        self.texts = n
        self.size += rows.nbytes + sum(map(len, texts)) + 170 * len(texts)
        self.chunks.append(rows)
        while len(self.chunks) > 1 and 2 * self.chunks[-1].num_rows >= self.chunks[-2].num_rows:
            self.chunks[-2:] = [pa.concat_batches(self.chunks[-2:])]

    def __call__(self, texts: Sequence[str]) -> tuple[np.ndarray, pa.RecordBatch]:
        """(which text each row is of, rows) of all texts, in no order of texts; the rows of one text are in theirs."""
        known = np.fromiter((self.numbers.get(t, -1) for t in texts), np.int64, len(texts))
        at, parts = [], []
        hit = np.flatnonzero(known >= 0)
        if len(hit):
            begin, end = self.bounds[known[hit]], self.bounds[known[hit] + 1]
            places, rows = _spread(hit, begin, end)
            first = 0
            for chunk in self.chunks:
                here = (rows >= first) & (rows < first + chunk.num_rows)
                if here.any():
                    at.append(places[here])
                    parts.append(chunk.take(pa.array(rows[here] - first)))
                first += chunk.num_rows
        miss = np.flatnonzero(known < 0)
        if len(miss):
            fresh: dict[str, int] = {}
            which = np.array([fresh.setdefault(texts[k], len(fresh)) for k in miss], np.int64)
            made = [self.work(t) for t in fresh]
            counts = np.fromiter(map(len, made), np.int64, len(made))
            ends = np.cumsum(counts)
            new = self.pack([r for rows in made for r in rows], self.schema)
            places, rows = _spread(miss, (ends - counts)[which], ends[which])
            at.append(places)
            parts.append(new if len(fresh) == len(miss) else new.take(pa.array(rows)))
            again = [k for k, t in enumerate(fresh) if self._again(t)]
            if again:
                names = list(fresh)
                keep = np.array(again, np.int64)
                _, rows = _spread(keep, (ends - counts)[keep], ends[keep])
                self._hold([names[k] for k in again], new.take(pa.array(rows)), counts[keep])
        if not parts:
            return np.zeros(0, np.int64), self.pack([], self.schema)
        return np.concatenate(at), parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def _spread(of: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from begin to end of each range in turn, and what each range is of."""
    counts = end - begin
    ends = np.cumsum(counts)
    return np.repeat(of, counts), np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - counts), counts)


#: Bytes that a store of rows may hold, and stores of one worker.
MOST_HELD = 128 * 1024 * 1024
_MOST_STORES = 3
_STORES: dict[Hashable, Rows] = {}


def rows(name: Hashable, work: Callable[[str], Sequence], schema: pa.Schema, pack: Callable[[list, pa.Schema], pa.RecordBatch] = pa.RecordBatch.from_pylist) -> Rows:
    """The worker's store of that name, made where there is none; the one that is longest unused goes. pack: makes columns of what work gives."""
    store = _STORES.pop(name, None) or Rows(work, schema, pack)
    _STORES[name] = store
    while len(_STORES) > _MOST_STORES:
        del _STORES[next(iter(_STORES))]
    return store
