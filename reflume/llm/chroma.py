"""Chroma audio fingerprints and their alignment.

A recording's samples become frames, frames become energies of the twelve pitch
classes, and smoothed pitch-class frames an integral image over time and pitch.
Sixteen rectangle filters slide along it; each compares two areas and gives two
bits (Gray code), so every position has one packed 32-bit integer, a print.

Recordings are aligned with a catalogue: equal prints vote for (item, offset) in
a histogram, and the best offset of each item is accepted by its share of wrong
bits over the whole overlap. Catalogue items are printed at every phase of the
hop, so where a recording holds a copy the prints of one phase are equal.

The catalogue travels to every task; CATALOGUE_PRINTS bounds it. A larger one is
taken in slices of different items, one after the other, each within the bound
(an item longer than it is a slice by itself); the recordings are numbered and
written before, each slice's answers after it, and the best of all slices counts.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reflume.llm.common import Scratch, bound_batches, tidy
from reflume.llm.words import cuts

CATALOGUE_PRINTS = 2_000_000
CUT_BYTES = 1_000_000
#: Bins of the histogram that sets the filters' levels, and how far they are moved, so that no level is a round number.
LEVEL_BINS, BIN_SHIFT = 1 << 16, 1e-5
HITS_AT_ONCE = 2_000_000


@dataclass(frozen=True)
class Settings:
    """Samples a second, samples of a frame and from frame to frame, frames of the widest filter, and when an alignment counts."""

    rate: int = 11025
    frame: int = 4096
    hop: int = 1365
    width: int = 16
    least_votes: int = 3
    most_error: float = 0.15
    sure_overlap: int = 16  # prints; a shorter overlap is accepted of shorter items alone, with fewer errors
    points: int = 0  # of the transform, zeros after the frame; 0: as many as the frame has

    levels: tuple[tuple[float, float, float], ...] = ((-0.1, 0.0, 0.1),) * 16  # of each filter: where its two bits change

    @property
    def reach(self) -> int:
        """Frames under one print: the widest filter and one more at either side for smoothing."""
        return self.width + 2

    @property
    def transform(self) -> int:
        return max(self.points, self.frame)

    @property
    def least(self) -> int:
        """Samples under one print."""
        return (self.reach - 1) * self.hop + self.frame


#: For unsigned 8-bit samples of short clips, such as the tables' texts read as samples.
#: A print takes 60 bytes, so a text of 63 bytes has one at every phase and one of 71 bytes has three.
#: 64 points give bins in all twelve pitch classes, where 32 leave four of them empty.
SHORT = Settings(rate=8000, frame=32, hop=4, width=6, sure_overlap=64, points=64)


def filters(width: int) -> list[tuple[int, int, int, int]]:
    """(kind, lowest class, height, frames) of the sixteen filters, by rule: kinds in turn, heights and widths spread."""
    out = []
    for k in range(16):
        height = 2 + (5 * k) % 9
        out.append((k % 5, (7 * k) % (13 - height), height, max(2, width * (1 + k % 4) // 4)))
    return out


def _pitch_map(settings: Settings) -> np.ndarray:
    """(bins, 12): which pitch class the energy of each frequency bin belongs to; none below 28 Hz."""
    hertz = np.arange(settings.transform // 2 + 1) * settings.rate / settings.transform
    out = np.zeros((len(hertz), 12), np.float32)
    ok = np.flatnonzero(hertz >= 28)
    out[ok, np.round(12 * np.log2(hertz[ok] / 440)).astype(int) % 12] = 1
    return out


def prints(samples: np.ndarray, offsets: np.ndarray, settings: Settings, raw: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Prints (uint32) of all recordings one after another, and how many each has. samples: unsigned 8-bit or signed 16-bit. raw: gets what the filters give instead."""
    s = settings
    sizes = np.diff(offsets)
    n_frames = np.where(sizes >= s.frame, (sizes - s.frame) // s.hop + 1, 0)
    n_prints = np.maximum(n_frames - s.reach + 1, 0)
    n_frames = np.where(n_prints > 0, n_frames, 0)
    total = int(n_frames.sum())
    if not total:
        return np.zeros(0, np.uint32), n_prints
    first = np.cumsum(n_frames) - n_frames
    start = np.repeat(offsets[:-1] - first * s.hop, n_frames) + np.arange(total) * s.hop
    wave = samples.astype(np.float32)
    wave = (wave - 128) / 128 if samples.dtype == np.uint8 else wave / 32768
    window, pitch = np.hanning(s.frame).astype(np.float32), _pitch_map(s)
    views = np.lib.stride_tricks.sliding_window_view(wave, s.frame)
    chroma = np.empty((total, 12), np.float32)
    step = max(1, 2_000_000 // s.transform)
    for at in range(0, total, step):
        spectrum = np.fft.rfft(views[start[at : at + step]] * window, s.transform)
        chroma[at : at + step] = (spectrum.real**2 + spectrum.imag**2) @ pitch
    chroma /= chroma.sum(1, keepdims=True) + 1e-9
    smooth = (chroma[:-2] + 2 * chroma[1:-1] + chroma[2:]) / 4
    image = np.zeros((13, len(smooth) + 1))
    np.cumsum(np.cumsum(smooth.T, axis=1, dtype=np.float64), axis=0, out=image[1:, 1:])
    n = len(smooth) - s.width + 1
    out = np.zeros(n, np.uint32)
    own = np.repeat(first, n_prints) + np.arange(n_prints.sum()) - np.repeat(np.cumsum(n_prints) - n_prints, n_prints)

    def area(x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        return image[y1, x1 : x1 + n] - image[y0, x1 : x1 + n] - image[y1, x0 : x0 + n] + image[y0, x0 : x0 + n]

    for k, (kind, y, h, w) in enumerate(filters(s.width)):
        whole = area(0, w, y, y + h)
        if kind == 0:
            part, fair = area(0, w, y, y + h // 2), (h // 2) / h
        elif kind == 1:
            part, fair = area(0, w // 2, y, y + h), (w // 2) / w
        elif kind == 2:
            part, fair = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h), ((w // 2) * (h // 2) + (w - w // 2) * (h - h // 2)) / (w * h)
        elif kind == 3:
            a, b = h // 3, h - h // 3
            part, fair = (area(0, w, y + a, y + b), (b - a) / h)
        else:
            a, b = w // 3, w - w // 3
            part, fair = (area(a, b, y, y + h), (b - a) / w)
        level = part / (whole + 1e-12) - fair
        if raw is not None:
            raw.append(level[own])
            continue
        low, middle, high = s.levels[k]
        bits = (level > low).astype(np.uint32) + (level > middle) + (level > high)
        out |= (bits ^ (bits >> 1)) << np.uint32(2 * k)
    return out[own], n_prints


def calibrate(items: DataFrame, settings: Settings) -> Settings:
    """Settings whose levels are the quartiles of each filter over all items (pcm), so that all bits are worth the same.

    They are read from a histogram of LEVEL_BINS bins between -1 and 1, so a level is off by a bin at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in cuts(batch.column(0), CUT_BYTES):
                raw: list[np.ndarray] = []
                prints(data, offsets, settings, raw)
                for k, x in enumerate(raw):
                    bins, n = np.unique(np.floor((x + 1 + BIN_SHIFT) * (LEVEL_BINS / 2)).astype(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k)), pa.array(bins), pa.array(n)], ["filter", "bin", "n"])

    counts = items.select("pcm").mapInArrow(tidy(run), "filter long, bin long, n long").groupBy("filter", "bin").agg(F.sum("n").alias("n"))
    one = Window.partitionBy("filter")
    below, total = F.sum("n").over(one.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), F.sum("n").over(one)
    found = counts.select("filter", "bin", below.alias("below"), total.alias("total")).groupBy("filter").agg(
        *(F.min(F.when(F.col("below") >= q * F.col("total"), F.col("bin"))).alias(f"q{k}") for k, q in enumerate((0.25, 0.5, 0.75)))
    ).orderBy("filter").collect()
    if not found:
        return settings
    return replace(settings, levels=tuple(tuple((r[f"q{k}"] + 1) * 2 / LEVEL_BINS - 1 - BIN_SHIFT for k in range(3)) for r in found))


@dataclass
class Catalogue:
    """Prints of all items at all phases: sorted prints with where they are, and the runs themselves."""

    settings: Settings
    items: np.ndarray
    times: np.ndarray  # how many rows each item stands for
    data: list[bytes]
    run_item: np.ndarray
    run_phase: np.ndarray
    run_first: np.ndarray
    run_size: np.ndarray
    flat: np.ndarray
    sorted: np.ndarray
    order: np.ndarray
    run_of: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, bytes, int]], settings: Settings) -> Catalogue:
        rows = sorted(rows)
        item, phase, size, flats = [], [], [], []
        for k, (_, data, _) in enumerate(rows):
            samples = np.frombuffer(data, np.uint8)
            for shift in range(settings.hop):
                flat, n = prints(samples[shift:], np.array([0, max(0, len(samples) - shift)]), settings)
                if n[0]:
                    item.append(k)
                    phase.append(shift)
                    size.append(n[0])
                    flats.append(flat)
        flat = np.concatenate(flats) if flats else np.zeros(0, np.uint32)
        size = np.array(size, np.int64)
        order = np.argsort(flat, kind="stable")
        return cls(settings, np.array([r[0] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), [r[1] for r in rows], np.array(item, np.int64), np.array(phase, np.int64), np.cumsum(size) - size, size, flat, flat[order], order, np.repeat(np.arange(len(size)), size))

    def _apart(self, k: int, at: int, samples: np.ndarray) -> float:
        """Mean difference of item k's samples and those at `at`."""
        item = np.frombuffer(self.data[k], np.uint8)
        a, b = max(0, at), min(len(samples), at + len(item))
        return float(np.abs(samples[a:b].astype(np.int16) - item[a - at : b - at]).mean())

    def align(self, own: np.ndarray, samples: np.ndarray) -> list[tuple[int, int, int, float, int]]:
        """(item number, votes, offset in samples, share of wrong bits, prints that overlap) of the items that a recording's prints hold. Its samples decide between places of equal prints."""
        low, high = np.searchsorted(self.sorted, own, "left"), np.searchsorted(self.sorted, own, "right")
        many = high - low
        where = np.flatnonzero(many)
        if not len(where):
            return []
        keys, votes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        span = 1 << 32
        ends = np.cumsum(many[where])
        at = 0
        while at < len(where):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HITS_AT_ONCE, "right")))
            part = where[at:stop]
            n = many[part]
            place = np.repeat(low[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            entry = self.order[place]
            run = self.run_of[entry]
            offset = np.repeat(part, n) - (entry - self.run_first[run])
            some, counts = np.unique(run * span + offset + (1 << 31), return_counts=True)
            keys, back = np.unique(np.concatenate([keys, some]), return_inverse=True)
            votes = np.bincount(back, weights=np.concatenate([votes, counts]), minlength=len(keys)).astype(np.int64)
            at = stop
        keep = votes >= np.minimum(self.settings.least_votes, self.run_size[keys // span])
        keys, votes = keys[keep], votes[keep]
        run, offset = keys // span, keys % span - (1 << 31)
        best: dict[int, tuple] = {}
        for r, o, v in sorted(zip(run.tolist(), offset.tolist(), votes.tolist(), strict=True), key=lambda x: (-x[2], x[0], x[1])):
            k, size = int(self.run_item[r]), int(self.run_size[r])
            if k in best and v < best[k][1]:
                continue
            a, b = max(0, o), min(len(own), o + size)
            if b - a < min(size, self.settings.sure_overlap):
                continue
            theirs = self.flat[self.run_first[r] + a - o : self.run_first[r] + b - o]
            wrong = float(np.bitwise_count(own[a:b] ^ theirs).sum() / (32 * (b - a)))
            # a run of fewer prints than the least votes counts when all its bits are equal
            most = self.settings.most_error * min(1.0, (b - a) / self.settings.sure_overlap) if size >= self.settings.least_votes else 0.0
            at = o * self.settings.hop - int(self.run_phase[r])
            if wrong <= most and (k not in best or wrong < best[k][3] or (wrong == best[k][3] and self._apart(k, at, samples) < self._apart(k, best[k][2], samples))):
                best[k] = (k, v, at, wrong, b - a)
        return list(best.values())


_ALIGNED = "n_prints long, prints_md5 string, n_items long, item_id long, votes long, item_at long, bit_error double"


def fingerprint(recordings: DataFrame, settings: Settings = Settings(), pcm: str = "pcm", prints_column: str = "prints") -> DataFrame:
    """recordings with their prints (array<long>). pcm: binary, unsigned 8-bit samples; null and short ones have no prints."""
    from pyspark.sql import types as T

    bound_batches(recordings.sparkSession)
    recordings = recordings.drop(prints_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(batch.schema.get_field_index(pcm)):
                samples = np.frombuffer(data.as_buffer(), np.uint8) if data.is_valid else np.zeros(0, np.uint8)
                rows.append(prints(samples, np.array([0, len(samples)]), settings)[0].astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.int64()))], [*batch.schema.names, prints_column])

    return recordings.mapInArrow(tidy(run), T.StructType([*recordings.schema.fields, T.StructField(prints_column, T.ArrayType(T.LongType()))]))


def _with(recordings: DataFrame, catalogue: Catalogue) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in cuts(batch.column(1), CUT_BYTES):
                flat, counts = prints(data, offsets, catalogue.settings)
                ends = np.cumsum(counts)
                rows = []
                for e, c, a, b in zip(ends, counts, offsets[:-1], offsets[1:], strict=True):
                    own = flat[e - c : e]
                    found = catalogue.align(own, data[a:b]) if c else []
                    # most votes; then the smaller item, fewer wrong bits, the earlier place
                    top = min(found, key=lambda x: (-x[1], catalogue.items[x[0]], round(x[3], 6), x[2]), default=None)
                    rows.append((int(c), hashlib.md5(own.tobytes()).hexdigest(), sum(int(catalogue.times[x[0]]) for x in found), *((int(catalogue.items[top[0]]), top[1], top[2], round(top[3], 6)) if top else (None,) * 4)))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(counts)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", *(x.split(" ")[0] for x in _ALIGNED.split(", "))])

    return recordings.mapInArrow(tidy(run), f"doc_id long, {_ALIGNED}")


def _slices(items: DataFrame, bound: int) -> list[DataFrame]:
    """items (item_id, pcm, n; no two rows alike) in slices of `bound` bytes at most, cut by a running sum over buckets of a hash.

    A row longer than the bound is a slice of its own; none is left out.
    """
    size, key = F.octet_length("pcm").cast("long"), F.xxhash64("item_id", "pcm")
    total = items.agg(F.sum(size)).first()[0] or 0
    if total <= bound:
        return [items]
    buckets = 1 << (4 * total // bound).bit_length()
    while True:
        bucket = F.pmod(key, F.lit(buckets))
        found = items.groupBy(bucket.alias("b")).agg(F.count("*").alias("rows"), F.sum(size).alias("bytes")).orderBy("b").collect()
        if all(r.bytes <= bound or r.rows == 1 for r in found):
            break
        buckets *= 2
    firsts, held = [], bound
    for r in found:
        if held + r.bytes > bound:
            firsts.append(r.b)
            held = 0
        held += r.bytes
    ends = [*firsts[1:], buckets]
    return [items.where((bucket >= a) & (bucket < b)) for a, b in zip(firsts, ends, strict=True)]


def align(recordings: DataFrame, catalogue: DataFrame, settings: Settings = SHORT) -> DataFrame:
    """doc_id, n_prints, prints_md5, n_items, item_id, votes, item_at, bit_error of every row of recordings.

    recordings (doc_id, text) and catalogue (item_id, text): texts as UTF-8
    bytes are the samples. n_items counts the items found, item_id is the one of
    most votes (then the smallest), item_at the sample where it begins. Null and
    short texts have no prints. The filters' levels are set by all items. Items of equal id are items of their own; those
    without an id or samples are left out.
    """
    bound_batches(recordings.sparkSession)
    rows = recordings.select(F.col("doc_id").cast("long"), "text")
    items = catalogue.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("pcm"))
    settings = calibrate(items, settings)
    # every sample begins one print at most, over all phases; shorter items have none
    whole = items.where(F.octet_length("pcm") >= settings.least).groupBy("item_id", "pcm").agg(F.count("*").alias("n"))
    slices = _slices(whole, CATALOGUE_PRINTS)
    found = lambda df, part: _with(df, Catalogue.of([(r.item_id, bytes(r.pcm), r.n) for r in part.collect()], settings))
    if len(slices) == 1:
        return found(rows, slices[0])
    scratch = Scratch(recordings.sparkSession, "chroma")
    numbered = scratch.write(rows.withColumn("row", F.monotonically_increasing_id()), "recordings")
    told = [scratch.write(found(numbered.select("row", "text"), part), "slice").withColumnRenamed("doc_id", "row") for part in slices]
    both = functools.reduce(DataFrame.unionByName, told)
    best = F.struct("votes", (-F.col("item_id")).alias("less"), (-F.col("bit_error")).alias("right"), (-F.col("item_at")).alias("early"), "item_id", "item_at", "bit_error")
    best = both.groupBy("row", "n_prints", "prints_md5").agg(F.sum("n_items").alias("n_items"), F.max(F.when(F.col("votes").isNotNull(), best)).alias("b"))
    return best.join(numbered.select("row", "doc_id"), "row").select("doc_id", "n_prints", "prints_md5", "n_items", "b.item_id", "b.votes", "b.item_at", "b.bit_error")
