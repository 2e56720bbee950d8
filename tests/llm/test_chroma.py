import hashlib
import random

import numpy as np

from reflume.llm import chroma
from reflume.llm.chroma import SHORT, Settings, align, filters, fingerprint, prints


def text(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def plain_prints(samples, s):
    """The definition, frame by frame and filter by filter."""
    wave = (samples.astype(np.float32) - 128) / 128
    frames = []
    for at in range(0, len(wave) - s.frame + 1, s.hop):
        points = max(s.points, s.frame)
        power = np.abs(np.fft.rfft(wave[at : at + s.frame] * np.hanning(s.frame), points)) ** 2
        c = np.zeros(12)
        for k in range(len(power)):
            hertz = k * s.rate / points
            if hertz >= 28:
                c[round(12 * np.log2(hertz / 440)) % 12] += power[k]
        frames.append(c / (c.sum() + 1e-9))
    f = np.array(frames)
    f = (f[:-2] + 2 * f[1:-1] + f[2:]) / 4
    out = []
    for x in range(len(f) - s.width + 1):
        value = 0
        for k, (kind, y, h, w) in enumerate(filters(s.width)):
            box = f[x : x + w, y : y + h]
            mark = np.zeros((w, h), bool)
            if kind == 0:
                mark[:, : h // 2] = True
            elif kind == 1:
                mark[: w // 2] = True
            elif kind == 2:
                mark[: w // 2, : h // 2] = True
                mark[w // 2 :, h // 2 :] = True
            elif kind == 3:
                mark[:, h // 3 : h - h // 3] = True
            else:
                mark[w // 3 : w - w // 3] = True
            level = box[mark].sum() / (box.sum() + 1e-12) - mark.mean()
            bits = int(level > -0.1) + int(level > 0) + int(level > 0.1)
            value |= (bits ^ bits >> 1) << 2 * k
        out.append(value)
    return np.array(out, np.uint32)


def test_prints_equal_the_definition():
    rng = np.random.default_rng(3)
    for s in (SHORT, Settings(rate=8000, frame=256, hop=100, width=16)):
        samples = rng.integers(60, 160, 4000).astype(np.uint8)
        got, n = prints(samples, np.array([0, 1500, 1510, 4000]), s)
        want = [plain_prints(samples[a:b], s) for a, b in ((0, 1500), (1510, 4000))]
        assert n.tolist() == [len(want[0]), 0, len(want[1])]
        assert np.bitwise_count(got ^ np.concatenate(want)).sum() <= 4  # rounding at a threshold


def test_short_frames_reach_all_pitch_classes():
    assert (chroma._pitch_map(SHORT).sum(0) > 0).all()


def test_items_are_found_where_they_are(spark, monkeypatch):
    rng = random.Random(6)
    items = [(k, text(rng, 40)) for k in range(12)]
    rows, want = [], {}
    for k in range(60):
        t = text(rng, rng.randint(0, 200))
        if k % 3 == 0:
            item = rng.randrange(12)
            cut = rng.randint(0, len(t))
            want[k] = (item, cut + 1)
            t = t[:cut] + " " + items[item][1] + " " + t[cut:]
        rows.append((k, t))
    rows += [(100, None), (101, ""), (102, "short"), (103, items[2][1]), (103, items[2][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as votes").repartition(3)
    cat = spark.createDataFrame([*items, (None, "x"), (50, None)], "item_id long, text string")
    got = align(df, cat).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in want:
            assert (r.item_id, r.item_at) == want[r.doc_id] and r.bit_error < 0.05
        elif r.doc_id < 100:
            assert r.item_id is None and r.n_items == 0
        elif r.doc_id == 103:
            assert (r.item_id, r.item_at, r.bit_error) == (2, 0, 0.0)
        else:
            assert r.n_prints == 0 and r.prints_md5 == hashlib.md5(b"").hexdigest()
    monkeypatch.setattr(chroma, "CATALOGUE_PRINTS", 1500)  # the same through several slices
    assert sorted(map(str, align(df, cat).collect())) == sorted(map(str, got))
    assert align(df.limit(0), cat).collect() == [] and all(r.item_id is None for r in align(df, cat.limit(0)).collect())


def test_tones_and_pcm_columns(spark):
    t = np.arange(11025 * 6) / 11025
    tone = lambda f: bytes((128 + 100 * np.sin(2 * np.pi * f * t)).astype(np.uint8))
    df = spark.createDataFrame([(1, tone(440)), (2, tone(440)), (3, tone(523.25)), (4, None)], "id long, pcm binary")
    got = {r.id: r.prints for r in fingerprint(df).collect()}
    assert got[1] == got[2] != got[3] and len(got[1]) > 20 and got[4] == []


def test_short_items_at_every_offset(spark):
    rng = random.Random(11)
    sizes = (63, 66, 67, 71, 81, 100, 143, 150, 175, 190)
    items = [(k, text(rng, 80)[:n]) for k, n in enumerate(sizes)]
    rows, want = [], {}
    for item, t in items:
        for shift in range(16):
            before = text(rng, 40)[: 100 + shift]
            want[len(rows)] = (item, len(before), 0.0)
            rows.append((len(rows), before + t + text(rng, 40)))
    rows += [(1000 + k, text(rng, 100)) for k in range(50)]
    got = {r.doc_id: r for r in align(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {k: (got[k].item_id, got[k].item_at, got[k].bit_error) for k in want} == want
    assert all(r.n_items == (1 if k in want else 0) for k, r in got.items())


def test_slices_leave_no_item_out(spark, monkeypatch):
    rng = random.Random(12)
    items = [(7, "x") for _ in range(900)] + [(7, text(rng, 30)) for _ in range(12)] + [(k, "") for k in range(8, 400)]
    items += [items[905]] * 3
    kept = [t for _, t in items[900:912]]
    rows = [(k, text(rng, 20) + " " + t + " " + text(rng, 20)) for k, t in enumerate(kept)]
    df, cat = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, align(df, cat).collect()))
    assert [(r[3], r[4]) for r in got] == [(4 if k == 5 else 1, 7) for k in range(12)]
    monkeypatch.setattr(chroma, "CATALOGUE_PRINTS", 400)  # less than the rows of one id
    sizes = []
    of = chroma.Catalogue.of
    monkeypatch.setattr(chroma.Catalogue, "of", lambda rows, settings: sizes.append([len(r[1]) for r in rows]) or of(rows, settings))
    assert sorted(map(tuple, align(df, cat).collect())) == got
    assert len(sizes) > 3 and all(sum(s) <= 400 or len(s) == 1 for s in sizes)


def test_levels_are_quartiles_of_all_items(spark, monkeypatch):
    rng = random.Random(13)
    rows = [(k, text(rng, 20) if k % 4 else "".join(chr(rng.randint(33, 126)) for _ in range(150))) for k in range(1500)]
    used = []
    of = chroma.Catalogue.of
    monkeypatch.setattr(chroma.Catalogue, "of", lambda items, settings: used.append(settings) or of(items[:1], settings))
    align(spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string"))
    data, raw = [t.encode() for _, t in rows], []
    prints(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), SHORT, raw)
    want = np.array([np.quantile(x, [0.25, 0.5, 0.75]) for x in raw])
    assert np.abs(np.array(used[0].levels) - want).max() < 1e-4
