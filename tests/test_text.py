import hashlib

from reflume import queries
from reflume.functions import grammar
from reflume.functions import text as tx


def decode(raw):
    """The reference's scan: at each & the body up to the next semicolon."""
    out, i = "", 0
    while i < len(raw):
        end = raw.find(";", i + 1) if raw[i] == "&" else -1
        body = raw[i + 1 : end] if end > 0 else ""
        got = tx.ENTITIES.get(body)
        if body[:1] == "#":
            base, digits = (16, body[2:]) if body[1:2] in ("x", "X") else (10, body[1:])
            if digits and all(c in "0123456789abcdefABCDEF"[: 22 if base == 16 else 10] for c in digits):
                code = int(digits, base)
                got = chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else None
        out += raw[i] if got is None else got
        i = i + 1 if got is None else end + 1
    return out


ENTITIES = {
    "&copy;&middot;&nbsp;&Eacute;&eacute;&szlig;&euro;&hellip;": "©·\xa0Éé\xdf€…", "&#169;&#xA9;&#Xa9;&#128512;&#x1F600;&#0065;": "©©©😀😀A", "&amp;lt; &amp;#169; &amp;amp;": "&lt; &#169; &amp;",
    "&EACUTE; &Copy; &alpha; &; &#; &#x; &#1j; &#xG; &# 65;": None, "&#xD800; &#xDFFF; &#1114112; &#x110000; &#99999999999999999999;": None, "&#x10FFFF;&#00000000000065;": "\U0010ffffA",
    "& & &copy; &copy": "& & © &copy", "&unknown &lt;": "&unknown <", "&lt;p&gt;&quot;&apos;&#39;": "<p>\"''", "": "", "plain; text": None,
}


def test_entities(spark):
    df = spark.createDataFrame([(k,) for k in ENTITIES] + [(None,)], "raw string")
    got = {r.raw: r.out for r in df.select("raw", tx.decode_entities(df.raw).alias("out")).collect()}
    assert got == {k: k if v is None else v for k, v in ENTITIES.items()} | {None: None}
    assert all(decode(k) == got[k] for k in ENTITIES) and len(tx.ENTITIES) == 83


def test_entity_decode_query(spark, tmp_path):
    pages = [(1, "<p>&copy; &middot; &#8212; a &amp;lt; b</p>"), (2, None), (3, "&frac12;")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.decoded for r in queries.entity_decode(spark, str(tmp_path)).collect()}
    assert got == {k: hashlib.md5(decode(t or "").encode()).hexdigest() for k, t in pages}


def test_scalar_queries_take_whole_texts(spark, tmp_path):
    texts = {1: "Nguyễn, V. A.", 2: "First line\nĐỗ, Q. (ed.)\n\n\u00c9mile  O'Neil-Smith\u3000end", 3: "\nsecond " + "x" * 80, 4: None, 5: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ask = lambda name: {r.doc_id: r.k for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    plain = {k: t or "" for k, t in texts.items()}
    assert ask("name_exact_key") == {k: grammar.name_key(t)[0] for k, t in plain.items()}
    assert ask("strip_diacritics") == {k: grammar.plain(t) for k, t in plain.items()}
    assert ask("initials_key") == {k: grammar.name_key(t)[2] for k, t in plain.items()}
    assert ask("label_truncate") == {k: t if len(t) <= 72 else t[:69] + "..." for k, t in plain.items()}
