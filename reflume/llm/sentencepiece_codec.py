"""SentencePiece encoding and decoding by a batched Viterbi in numpy.

A text becomes words: a run of word marks (the piece for a space) and what
follows up to the next mark or line end. No piece reaches across such an edge,
which is checked when a model is read. Each distinct word of a batch is encoded
once. Words of equal length advance together: the hashes of their substrings
probe the sorted keys of pieces and of what pieces begin with, longer ones only
where the shorter one begins a piece; then at every end position vectorised
maxima over the pieces that end there leave backpointers.

A very long word is cut into blocks of equal length that advance together, each
from some way before its first character. What a search finds at a position
depends on the last few positions only, so a block counts where it agrees with
the end of the block before; one that does not is searched again from there.

Unigram models: the path of the greatest sum of scores, ties to the longer last
piece, as the library has it. BPE models: merging in order of score is not a
sum, but it has the optimal-substructure a Viterbi needs: a piece may follow the
best path to its start if merging would never cross the edge between it and the
path's last piece, and exactly one piece qualifies at each end. That test
undoes the merges of both pieces, latest first, and looks for a merge across
the edge that would have come earlier.

User-defined pieces come first in BPE models, from the left and the longest,
and cost next to nothing in unigram models. Unknown characters become the
pieces of their bytes, or one unknown piece a run where a model has none. Ids
equal the library's.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from reflume.llm.common import bound_batches, tidy

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_MULT = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.int64(2**62)
#: Characters of words that advance together.
CELLS = 160_000
#: Words whose pieces a worker remembers, and their characters.
KNOWN_WORDS, KNOWN_CHARS = 300_000, 4_000_000
#: A longer word is searched in blocks, each with so many characters of lead-in.
BLOCK, LEAD = 1024, 256
#: Slots of the memory of which pieces merging keeps apart.
SLOTS = 1 << 20


def _code_hash(codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (codes.astype(np.uint64) + np.uint64(0x51ED270B)) * np.uint64(0xD1342543DE82EF95)
        return x ^ (x >> np.uint64(29))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _hashes(text: str) -> list[int]:
    """Hashes of all beginnings of a text, the whole last."""
    out, h = [], 0
    for c in _code_hash(_codes(text)).tolist():
        h = (h * int(_MULT) + c) % 2**64
        out.append(h)
    return out


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = number() if tag & 7 == 2 else 4 if tag & 7 == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class Pieces:
    """A model: pieces and their scores, how a text is prepared, and the tables of the search."""

    texts: list[str]
    scores: np.ndarray
    kinds: np.ndarray  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
    bpe: bool
    prefix: bool = True  # a mark before the text
    keys: np.ndarray = field(init=False)
    ids: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        kinds = (1,) if self.bpe else (1, 4)  # of pieces that the search may use
        usable = [k for k, kind in enumerate(self.kinds) if kind in kinds]
        own = [self.texts[k] for k, kind in enumerate(self.kinds) if kind == 4]
        bad = [t for t in [self.texts[k] for k in usable] + own if MARK in t.lstrip(MARK) or "\n" in t]
        if bad:
            raise ValueError(f"pieces reach across words: {bad[:3]}")
        self.values = self.scores.astype(float)  # what the search adds up
        if not self.bpe and own:
            top = max((self.scores[k] for k, kind in enumerate(self.kinds) if kind == 1), default=0.0)
            top = max(top, 0.0)  # as the library has it
            for k in np.flatnonzero(self.kinds == 4):
                self.values[k] = len(self.texts[k].encode()) * top - 0.1
        self.first = {self.texts[k]: int(k) for k in np.flatnonzero(self.kinds == 4)} if self.bpe else {}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.first, key=len, reverse=True))) + ")") if self.first else None
        table: dict[int, int] = {}
        self.longest = max((len(self.texts[k]) for k in usable), default=1)
        self.piece_hash = np.zeros(len(self.texts), np.uint64)
        for k in usable:
            begins = _hashes(self.texts[k])
            for h in begins[:-1]:
                table.setdefault(h, -1)
            if table.get(begins[-1], -1) >= 0:
                raise ValueError("two pieces share a key")
            table[begins[-1]] = k
            self.piece_hash[k] = begins[-1]
        keys = np.array(list(table), np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(table.values()), np.int64)[order]
        self.maybe = np.zeros(1 << 21, bool)  # which low ends of keys occur at all
        self.maybe[(self.keys & np.uint64(len(self.maybe) - 1)).astype(np.int64)] = True
        self.lost = float(min((self.scores[k] for k in usable), default=0.0)) - 10.0
        self.unknown = int(np.flatnonzero(self.kinds == 2)[0])
        self.byte = np.full(256, -1, np.int64)
        for k in np.flatnonzero(self.kinds == 6):
            self.byte[int(self.texts[k][1:-1], 16)] = k
        self.piece_len = np.array([len(t) for t in self.texts], np.int64)
        self.powers = np.ones(self.longest + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.longest):
                self.powers[k + 1] = self.powers[k] * _MULT
        if self.bpe:
            self._derive(usable)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[:1] != "_"}

    def _derive(self, usable: list[int]) -> None:
        """How each piece comes about by merging: rank, left and right part; alone: merging its text gives the piece."""
        n = len(self.texts)
        at = {self.texts[k]: int(k) for k in usable}
        self.rank = np.full(n + 1, -1, np.int64)  # single characters, and the unknown at n
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        self.alone = np.zeros(n + 1, bool)
        self.alone[n] = True
        for k in usable:
            text = self.texts[k]
            if len(text) == 1:
                self.alone[k] = True
                continue
            self.rank[k] = -int(self.scores[k])
            parts = list(text)
            last = None
            while len(parts) > 1:
                best = max(((self.scores[m], -i) for i in range(len(parts) - 1) if (m := at.get(parts[i] + parts[i + 1])) is not None), default=None)
                if best is None:
                    break
                i = -best[1]
                last = (parts[i], parts[i + 1])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 1 and last[0] in at and last[1] in at:
                self.alone[k], self.left[k], self.right[k] = True, at[last[0]], at[last[1]]

    def _probe(self, keys: np.ndarray) -> np.ndarray:
        """Where the sorted keys hold these, -1 for nowhere."""
        out = np.full(len(keys), -1, np.int64)
        rows = np.flatnonzero(self.maybe[(keys & np.uint64(len(self.maybe) - 1)).view(np.int64)])
        some = keys[rows]
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        hit = self.keys[at] == some
        out[rows[hit]] = at[hit]
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves an edge between the pieces a and b."""
        if not hasattr(self, "_slot_key"):
            self._slot_key, self._slot = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        n = len(self.texts)
        code = a * (n + 1) + b
        with np.errstate(over="ignore"):
            slot = ((code.view(np.uint64) * _MULT) >> np.uint64(64 - SLOTS.bit_length() + 1)).view(np.int64)
        out = self._slot[slot]
        new = np.flatnonzero(self._slot_key[slot] != code)
        if len(new):
            some, first, back = np.unique(code[new], return_index=True, return_inverse=True)
            told = self._apart(some // (n + 1), some % (n + 1))
            out[new] = told[back]
            at = slot[new][first]
            self._slot_key[at], self._slot[at] = some, told
            shared = np.flatnonzero(self._slot_key[at] != some)  # of codes in one slot the last stays, with its answer
            if len(shared):
                stays = np.searchsorted(some, self._slot_key[at[shared]])
                self._slot[at[shared]] = told[stays]
        return out

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = len(self.texts)
        out = np.ones(len(a), bool)
        live = np.flatnonzero((a < n) & (b < n))
        a, b = a[live], b[live]
        limit = np.full(len(live), _NEVER)
        while len(live):
            size = self.piece_len[b]
            with np.errstate(over="ignore"):
                place = self._probe(self.piece_hash[a] * self.powers[np.minimum(size, self.longest)] + self.piece_hash[b])
            joined = np.where(place >= 0, self.ids[place], -1)
            fits = (joined >= 0) & (self.piece_len[a] + size <= self.longest)
            across = np.where(fits, -self.scores[np.maximum(joined, 0)].astype(np.int64), _NEVER)
            out[live[across < limit]] = False
            go = (across >= limit) & ((self.rank[a] >= 0) | (self.rank[b] >= 0))
            live, a, b, limit = live[go], a[go], b[go], limit[go]
            first = self.rank[a] > self.rank[b]
            limit = np.where(first, self.rank[a], self.rank[b] + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def _occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, piece) of all pieces in words of one length, by end, word and start; starts in the flat (n, length + 1) places.

        A character that is no piece is the piece len(texts).
        """
        n, length = codes.shape
        values = _code_hash(codes)
        h = np.zeros((n, length + 1), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(length):
                h[:, k + 1] = h[:, k] * _MULT + values[:, k]
        h = h.ravel()
        at = np.arange(n * (length + 1))
        room = length - at % (length + 1)
        at, room = at[room > 0], room[room > 0]
        found = []
        for size in range(1, min(self.longest, length) + 1):
            with np.errstate(over="ignore"):
                place = self._probe(h[at + size] - h[at] * self.powers[size])
            piece = np.where(place >= 0, self.ids[place], -1)
            if size == 1:
                piece = np.where(piece < 0, len(self.texts), piece)
            keep = piece >= 0
            if self.bpe:
                keep &= self.alone[piece]
            found.append((at[keep], np.full(int(keep.sum()), size), piece[keep]))
            go = (place >= 0) & (room > size)
            at, room = at[go], room[go]
        start, size, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        end = start % (length + 1) + size
        order = np.argsort(end * (n * (length + 1)) + start, kind="stable")
        return start[order], size[order], piece[order]

    def _search(self, codes: np.ndarray, lead: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words of one length: codes (n, length) -> best sum, last piece and its size at each of the (n, length + 1) places.

        lead: sums and last pieces at the first places, where they are known; else a word begins at the first.
        """
        n, length = codes.shape
        wide = length + 1
        start, size, piece = self._occurrences(codes)
        best = np.full(n * wide, -np.inf)
        back = np.zeros(n * wide, np.int64)
        last = np.full(n * wide, -1, np.int64)
        first = np.arange(n) * wide
        best[first] = 0
        known = 0
        if lead is not None:
            known = len(lead[0]) - 1
            places = (first[:, None] + np.arange(known + 1)).ravel()
            best[places], last[places] = np.tile(lead[0], n), np.tile(lead[1], n)
        values = np.append(self.values, self.lost)
        bounds = np.searchsorted(start % wide + size, np.arange(wide + 1))
        for end in range(known + 1, wide):
            here = slice(bounds[end], bounds[end + 1])
            a, p, k = start[here], piece[here], size[here]
            if self.bpe:
                before = last[a]
                ok = best[a] == 0
                inner = np.flatnonzero(ok & (before >= 0))
                ok[inner] = self.apart(before[inner], p[inner])
                a, p, k = a[ok][::-1], p[ok][::-1], k[ok][::-1]
                to = a + k
                best[to] = 0
            else:
                value = best[a] + values[p]
                row = a // wide
                heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                top = np.maximum.reduceat(value, heads)
                equal = np.flatnonzero(value == np.repeat(top, np.diff(np.append(heads, len(row)))))
                take = equal[np.searchsorted(equal, heads)]  # of equal sums the longest last piece
                a, p, k = a[take], p[take], k[take]
                to = a + k
                best[to] = value[take]
            last[to], back[to] = p, k
        return best.reshape(n, wide), last.reshape(n, wide), back.reshape(n, wide)

    def words(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words of one length: codes (n, length) -> (ids, counts); unknown characters have the id len(texts) + 1 + code."""
        n, length = codes.shape
        best, last, back = self._search(codes)
        if not np.isfinite(best[:, length]).all():
            raise ValueError("a word has no path")
        size = len(self.texts)
        taken = np.zeros((n, length), np.int64) - 1
        at = np.full(n, length)
        rows = np.arange(n)
        while len(rows):
            here = at[rows]
            start = here - back[rows, here]
            taken[rows, start] = np.where(last[rows, here] == size, size + 1 + codes[rows, start], last[rows, here])
            at[rows] = start
            rows = rows[start > 0]
        used = taken >= 0
        return taken[used], used.sum(1)

    def long_word(self, codes: np.ndarray) -> np.ndarray:
        """Pieces of one word of any length: codes (length) -> ids as words() has them."""
        n, window = len(codes), self.longest
        lead = max(LEAD, 2 * window)
        best, last, back = np.zeros(n + 1), np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64)
        ends = [*range(BLOCK, n, BLOCK), n]
        spans = [(max(0, e - lead), e, f) for e, f in zip([0, *ends], ends, strict=False)]
        seen: dict[bytes, tuple] = {}
        tried: list[tuple] = []
        for k, (_, begin, end) in enumerate(spans):
            if k >= len(tried):  # the next blocks of one length together
                width = end - spans[k][0]
                more = [s for s in itertools.takewhile(lambda s: s[2] - s[0] == width, spans[k : k + max(1, CELLS // width)])]
                tried += list(zip(*self._search(np.stack([codes[s[0] : s[2]] for s in more])), strict=True))
            value, piece, size = tried[k]
            tried[k] = ()
            at = begin - spans[k][0]
            if begin:
                w = min(window, begin)
                shift = value[at] - best[begin]
                same = np.array_equal(piece[at - w : at + 1], last[begin - w : begin + 1])
                if not same or np.abs(value[at - w : at + 1] - best[begin - w : begin + 1] - shift).max() > 1e-9:
                    known = (best[begin - w : begin + 1] - best[begin], last[begin - w : begin + 1].copy())
                    key = known[0].tobytes() + known[1].tobytes() + codes[begin - w : end].tobytes()
                    if key not in seen:
                        seen[key] = tuple(x[0] for x in self._search(codes[None, begin - w : end], known))
                    value, piece, size = seen[key]
                    at, shift = w, -best[begin]
                value = value - shift
            best[begin + 1 : end + 1], last[begin + 1 : end + 1], back[begin + 1 : end + 1] = value[at + 1 :], piece[at + 1 :], size[at + 1 :]
        out, at, lost = [], n, len(self.texts)
        while at:
            start = at - int(back[at])
            out.append(lost + 1 + int(codes[start]) if last[at] == lost else int(last[at]))
            at = start
        return np.array(out[::-1], np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (int32), and how many each has. Null and empty texts have none."""
        found = [self._split((MARK if self.prefix and t else "") + (t or "").replace(" ", MARK)) for t in texts]
        flat = [w for words in found for w in words]
        if not flat:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        if not hasattr(self, "_known") or len(self._known) > KNOWN_WORDS or self._chars > KNOWN_CHARS:
            self._known: dict[str, int] = {}
            self._chars = 0
            self._pool, self._begin, self._count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = self._known
        before = len(known)
        which = np.array([known.setdefault(w, len(known)) for w in flat], np.int64)
        if len(known) > before:
            words = list(itertools.islice(known, before, None))
            self._chars += sum(map(len, words))
            ids, counts = self._new_words(words)
            self._begin = np.concatenate([self._begin, len(self._pool) + np.cumsum(counts) - counts])
            self._count = np.concatenate([self._count, counts])
            self._pool = np.concatenate([self._pool, ids])
        n = self._count[which]
        total = np.cumsum(n)
        out = self._pool[np.repeat(self._begin[which] - (total - n), n) + np.arange(total[-1])]
        ends = np.concatenate([[0], total])[np.cumsum([len(w) for w in found])]
        counts = np.diff(ends, prepend=0)
        if self.byte[0] >= 0:
            return out, counts
        again = np.zeros(len(out), bool)  # one unknown piece a run
        again[1:] = (out[1:] == self.unknown) & (out[:-1] == self.unknown)
        heads = (ends - counts)[counts > 0]
        again[heads] = False
        before = np.concatenate([[0], np.cumsum(again)])
        return out[~again], counts - (before[ends] - before[ends - counts])

    def _split(self, text: str) -> list[str]:
        """Words; user-defined pieces of a BPE model are words of their own."""
        if self.cut is None:
            return _WORD.findall(text)
        return [w for k, part in enumerate(self.cut.split(text)) for w in ([part] if k % 2 else _WORD.findall(part))]

    def _new_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words in their order, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        sorted_sizes = sizes[order]
        pieces: list[np.ndarray] = []
        counts = np.zeros(len(words), np.int64)
        at = 0
        while at < len(order):
            size = int(sorted_sizes[at])
            if size > 2 * BLOCK or words[order[at]] in self.first:
                word = words[order[at]]
                ids = np.array([self.first[word]]) if word in self.first else self.long_word(_codes(word))
                ids, n = self._bytes(ids, np.array([len(ids)]))
                pieces.append(ids)
                counts[order[at]] = n[0]
                at += 1
                continue
            end = min(int(np.searchsorted(sorted_sizes, size, "right")), at + max(1, CELLS // size))
            group = order[at:end]
            if self.first:  # what follows up to the next user-defined piece
                end = at + next((k for k, w in enumerate(group) if words[w] in self.first), len(group))
                group = order[at:end]
            ids, n = self._bytes(*self.words(_codes("".join([words[k] for k in group])).reshape(-1, size)))
            pieces.append(ids)
            counts[group] = n
            at = end
        begin = np.zeros(len(words), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        total = np.cumsum(counts)
        return np.concatenate(pieces)[np.repeat(begin - (total - counts), counts) + np.arange(total[-1])].astype(np.int32), counts

    def _bytes(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters as the pieces of their bytes, or as the unknown piece where the model has none."""
        lost = np.flatnonzero(ids > len(self.texts))
        if not len(lost):
            return ids, counts
        owner = np.repeat(np.arange(len(counts)), counts)
        spelled = [self.byte[np.frombuffer(chr(int(c) - len(self.texts) - 1).encode("utf-8", "replace"), np.uint8)] if self.byte[0] >= 0 else np.array([self.unknown]) for c in ids[lost]]
        width = np.ones(len(ids), np.int64)
        width[lost] = [len(s) for s in spelled]
        out = np.repeat(ids, width)
        first = np.cumsum(width) - width
        for k, s in zip(lost, spelled, strict=True):
            out[first[k] : first[k] + len(s)] = s
        return out, np.bincount(owner, weights=width, minlength=len(counts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of runs of ids; bytes that are not UTF-8 become replacement characters, control pieces nothing."""
        if not hasattr(self, "_spell"):
            spell = [bytes([int(t[1:-1], 16)]) if k == 6 else b"" if k == 3 else t.replace(MARK, " ").encode() for t, k in zip(self.texts, self.kinds, strict=True)]
            self._spell = np.frombuffer(b"".join(spell), np.uint8)
            self._size = np.array([len(s) for s in spell], np.int64)
            self._from = np.cumsum(self._size) - self._size
        n = self._size[ids]
        ends = np.cumsum(n)
        data = self._spell[np.repeat(self._from[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        out = [data[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return [t[1:] if self.prefix and t[:1] == " " else t for t in out]


def read_model(data: bytes | str) -> Pieces:
    """A model from a .model file's path or bytes. Only models without text normalisation are taken."""
    if isinstance(data, str):
        with open(data, "rb") as f:
            data = f.read()
    texts, scores, kinds, bpe, prefix = [], [], [], False, True
    for tag, value in _fields(data):
        if tag == 1:
            piece = dict(_fields(value))
            texts.append(piece[1].decode())
            scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
            kinds.append(piece.get(3, 1))
        elif tag == 2:
            bpe = dict(_fields(value)).get(3, 1) == 2
        elif tag == 3:
            spec = dict(_fields(value))
            if spec.get(2) or spec.get(4, 1):
                raise ValueError("the model normalises texts")
            prefix = bool(spec.get(3, 1))
    return Pieces(texts, np.array(scores), np.array(kinds), bpe, prefix)


def encode(docs: DataFrame, pieces: Pieces, ids: str = "piece_ids") -> DataFrame:
    """docs with a column of piece ids (array<int>; empty for null and empty texts). A column of that name is replaced."""
    bound_batches(docs.sparkSession)
    docs = docs.drop(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                flat, counts = pieces.encode(part.column(part.schema.get_field_index("text")).to_pylist())
                column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, ids])

    from pyspark.sql import types as T

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(coded: DataFrame, pieces: Pieces, ids: str = "piece_ids", text: str = "text") -> DataFrame:
    """coded with the decoded texts. Null id lists give null; ids outside the model are an error."""
    bound_batches(coded.sparkSession)
    coded = coded.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            counts = np.array([0 if v is None else v for v in pc.list_value_length(column).to_pylist()], np.int64)
            texts = pieces.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t if ok else None for t, ok in zip(texts, column.is_valid().to_pylist(), strict=True)], pa.string())], [*batch.schema.names, text])

    from pyspark.sql import types as T

    return coded.mapInArrow(tidy(run), T.StructType([*coded.schema.fields, T.StructField(text, T.StringType())]))


def parts(batch: pa.RecordBatch, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about `most` bytes."""
    sizes = np.cumsum(np.array([v or 0 for v in pc.binary_length(batch.column(batch.schema.get_field_index("text"))).to_pylist()], np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def digests(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_md5 (of the ids as little-endian int32) and round_trip (decoding gives the text) of every row."""
    import hashlib

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_byte = pieces.kinds == 6
        for batch in batches:
            for part in parts(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                flat, counts = pieces.encode(texts)
                ends = np.cumsum(counts)
                again = pieces.decode(flat, counts)
                spelled = np.concatenate([[0], np.cumsum(is_byte[flat])])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts), pa.array(spelled[ends] - spelled[ends - counts]), pa.array([hashlib.md5(flat[e - c : e].tobytes()).hexdigest() for e, c in zip(ends, counts, strict=True)], pa.string()),
                     pa.array([a == b for a, b in zip(again, texts, strict=True)])], ["doc_id", "n_pieces", "n_byte_pieces", "ids_md5", "round_trip"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n_pieces long, n_byte_pieces long, ids_md5 string, round_trip boolean")
