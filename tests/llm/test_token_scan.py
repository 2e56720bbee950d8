import random
import struct

from reflume.llm import token_scan
from reflume.llm.token_scan import count_documents, document_tokens, read_token_files

EOD = 9


def brute(tokens):
    out, start = [], 0
    for k, t in enumerate(tokens):
        if t == EOD:
            out.append((len(out), start, k - start, True))
            start = k + 1
    if start < len(tokens):
        out.append((len(out), start, len(tokens) - start, False))
    return out


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(token_scan, "GROUP_BLOCKS", 3)
    rng = random.Random(4)
    rows, want = [], []
    for file in range(6):
        tokens = [rng.choice([1, 2, 3, EOD] if file % 2 else [1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, 5, 6, 7, 8, EOD]) for _ in range(rng.choice([0, 1, 7, 200]))]
        if file == 4:
            tokens = [1] * 90 + [EOD] + [2] * 30
        want += [(file, *d) for d in brute(tokens)]
        at = block = 0
        while at < len(tokens):
            n = rng.choice([1, 2, 5, 0])
            rows.append((file, block, struct.pack(f"<{len(tokens[at : at + n])}H", *tokens[at : at + n]), "extra"))
            at, block = at + n, block + 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "file long, block long, payload binary, size string").repartition(3)
    got = sorted((r.file, r.ordinal, r.start, r.n_tokens, r.closed) for r in count_documents(df, EOD).collect())
    assert got == sorted(want)
    assert count_documents(df.limit(0), EOD).collect() == []


def test_files_on_disk(spark, tmp_path):
    tokens = [5, 5, EOD, EOD, 70000, 1, 2, EOD, 3]
    (tmp_path / "a.bin").write_bytes(struct.pack(f"<{len(tokens)}I", *tokens))
    (tmp_path / "b.bin").write_bytes(b"")
    blocks = read_token_files(spark, str(tmp_path), width=4, block_tokens=2)
    assert blocks.count() == 5
    assert sorted((r.ordinal, r.start, r.n_tokens, r.closed) for r in count_documents(blocks, EOD, width=4).collect()) == brute(tokens)


def test_documents_through_token_files(spark, monkeypatch):
    import base64

    import tiktoken

    ranks, pattern = "/opt/tokenizers/byte_bpe_50k.tiktoken", r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    coder = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}, special_tokens={})
    rows = [(k, t) for k, t in enumerate(["one two", "", None, "<|endoftext|> as text", "x " * 400_000, "é😀", "one two", "one two"])]
    got = document_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), ranks, pattern, 50256).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(k, len(coder.encode_ordinary(t or ""))) for k, t in rows]
    assert document_tokens(spark.createDataFrame([], "doc_id long, text string"), ranks, pattern, 50256).collect() == []
