import random
import struct

import numpy as np
import pytest

from reflume.llm.sentencepiece_codec import MARK, decode, digests, encode, read_model

spm = pytest.importorskip("sentencepiece")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def message(*fields):
    out = b""
    for tag, value in fields:
        if isinstance(value, int):
            out += (bytes([tag << 3]) if tag < 16 else bytes([tag << 3 & 127 | 128, tag >> 4])) + bytes([value])
        elif isinstance(value, float):
            out += bytes([tag << 3 | 5]) + struct.pack("<f", value)
        else:
            n, size = len(value), b""
            while n > 127:
                size, n = size + bytes([n & 127 | 128]), n >> 7
            out += bytes([tag << 3 | 2]) + size + bytes([n]) + value
    return out


def unigram_model(seed, fallback=True, own=()):
    """A small unigram model with whole-number scores, made by hand. own: user-defined pieces."""
    rng = random.Random(seed)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256) if fallback), *((t, 0.0, 4) for t in own)]
    seen = {"", *own}
    for _ in range(300):
        text = rng.choice(["", MARK]) + "".join(rng.choice("abcé") for _ in range(rng.randint(0, 5)))
        if text not in seen:
            seen.add(text)
            pieces.append((text, -float(rng.randint(1, 40)), 1))
    pieces += [(c, -50.0, 1) for c in "abc" + MARK if c not in seen]
    return message(*((1, message((1, t.encode()), (2, s), (3, k))) for t, s, k in pieces), (2, message((3, 1), (35, int(fallback)))), (3, message((1, b"identity"), (3, 1), (4, 0), (5, 1))))


def bpe_model(own=()):
    """A small BPE model without byte pieces: merges of a, b and c in an order of their own."""
    rng = random.Random(5)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((t, 0.0, 4) for t in own)]
    parts = ["a", "b", "c", MARK]
    merges = []
    while len(merges) < 60:
        x, y = rng.choice(parts), rng.choice(parts)
        if MARK not in y and x + y not in parts:
            merges.append(x + y)
            parts.append(x + y)
    pieces += [(t, -float(k), 1) for k, t in enumerate(merges)]
    pieces += [(t, -float(len(merges) + k), 1) for k, t in enumerate(["a", "b", "c", MARK])]
    return message(*((1, message((1, t.encode()), (2, s), (3, k))) for t, s, k in pieces), (2, message((3, 2), (35, 0))), (3, message((1, b"identity"), (3, 1), (4, 0), (5, 1))))


TEXTS = [
    "", " ", "a", "  two  spaces ", "Internationalization of unbelievable misunderstandings", "line\n\nbreaks\tand tabs\r\n", "日本語テキスト😀 größer naïve", " " * 40 + "x" + " " * 20,
    "def f(x):\n        return x+1  # comment", "a" * 3000, "\x00\x01", "ﬁ é ∑", f"has {MARK} mark",
]


def check(model_bytes, texts):
    pieces, theirs = read_model(model_bytes), spm.SentencePieceProcessor(model_proto=model_bytes)
    ids, counts = pieces.encode(texts)
    ends = np.cumsum(counts)
    for k, text in enumerate(texts):
        assert list(ids[ends[k] - counts[k] : ends[k]]) == theirs.encode(text), text
    back = pieces.decode(ids, counts)
    assert [b for b, t in zip(back, texts, strict=True) if MARK not in t] == [t for t in texts if MARK not in t]


def test_bpe_ids_equal_the_library():
    rng = random.Random(1)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve qu ßb öl".split()
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 7))) for _ in range(4000)]
    with open(MODEL, "rb") as f:
        check(f.read(), [*TEXTS, " ".join(words), "".join(words[:50]), " ".join(w.title() for w in words[:500])])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_unigram_ids_equal_the_library(seed):
    rng = random.Random(seed)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 12))) for _ in range(20)) for _ in range(50)]
    check(unigram_model(seed), [*[t for t in TEXTS if len(t) < 2000], *texts])


def ids_equal(model_bytes, texts):
    pieces, theirs = read_model(model_bytes), spm.SentencePieceProcessor(model_proto=model_bytes)
    ids, counts = pieces.encode(texts)
    ends = np.cumsum(counts)
    for k, text in enumerate(texts):
        assert list(ids[ends[k] - counts[k] : ends[k]]) == theirs.encode(text), text


@pytest.mark.parametrize("own", [(), ("<x>", "ab<", "bb")])
def test_models_without_byte_pieces_and_with_user_defined_ones(own):
    rng = random.Random(7)
    texts = ["", "xyz", "xy az", "é", "a  é é b", "<x>", "a<x>b ab<x>", "ab<<x>>", "bbb bb", *("".join(rng.choice("abcxé <>") for _ in range(rng.randint(1, 40))) for _ in range(200))]
    ids_equal(unigram_model(4, False, own), texts)
    ids_equal(bpe_model(own), texts)


@pytest.mark.parametrize("text", [
    "ab" * 3000, "a" * 7001, "日本語" * 2500, "x" * 1023 + "é" * 4000, "".join(random.Random(3).choice("abcdefghijklmnop") for _ in range(9000)), "abc=" * 2000 + "a" * 1500 + "zq" * 700,
])
def test_long_words(text):
    with open(MODEL, "rb") as f:
        ids_equal(f.read(), [text, "one " + text, text[:2049]])
    ids_equal(unigram_model(2), [text])
    ids_equal(bpe_model(), [text])


def test_a_word_of_a_million_characters():
    import time

    rng = random.Random(9)
    text = "".join(rng.choice(["the", "ing", "qu", "er", "z", "x1", "日本"]) for _ in range(420_000))[:1_000_000]
    start = time.time()
    ids, counts = read_model(MODEL).encode([text])
    assert time.time() - start < 60
    assert list(ids) == spm.SentencePieceProcessor(model_file=MODEL).encode(text)


def test_operators_round_trip(spark):
    pieces = read_model(MODEL)
    rows = [(k, t, 1, "z") for k, t in enumerate([*[t for t in TEXTS if MARK not in t], None, "same", "same"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece_ids int, n_pieces string").repartition(2)
    coded = encode(df, pieces)
    assert dict(coded.dtypes)["piece_ids"] == "array<int>"
    back = {r.doc_id: r.text for r in decode(coded, pieces).collect()}
    assert back == {k: t or "" for k, t, _, _ in rows}
    told = digests(df, pieces).collect()
    assert len(told) == len(rows) and all(r.round_trip for r in told)
    assert encode(df.limit(0), pieces).collect() == [] and digests(df.limit(0), pieces).collect() == []
