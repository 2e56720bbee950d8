"""Text functions as columns: folds, name keys, markup scalars, labels."""

from __future__ import annotations

import re
from functools import lru_cache
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from reflume.functions.grammar import VIETNAMESE_FAMILIES, WS, exact_key, plain


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Precomposed letters of the basic plane and what is left without their marks."""
    pairs = []
    for k in range(0xC0, 0x2000):
        c = chr(k)
        bare = plain(c)
        if len(bare) == 1 and bare != c:
            pairs.append((c, bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    return trim(F.regexp_replace(c, f"{WS}+", " "))


def strip_diacritics(c: Column) -> Column:
    """Without combining marks, for text in composed form; Đ and đ stay."""
    return F.regexp_replace(F.translate(c, *_accents()), r"\p{M}+", "")


def fold(c: Column) -> Column:
    return collapse(F.lower(strip_diacritics(c)))


def name_exact_key(c: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(c), r"\p{P}+", ""))


def initials_key(c: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(strip_diacritics(name_exact_key(c)), " "), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), "")


def name_key(c: Column) -> Column:
    exact = name_exact_key(c)
    return F.struct(exact.alias("exact"), strip_diacritics(exact).alias("bare"), initials_key(c).alias("initials"))


def is_vietnamese_family(c: Column) -> Column:
    return strip_diacritics(name_exact_key(c)).isin(*sorted({plain(exact_key(n)) for n in VIETNAMESE_FAMILIES}))


def truncate(c: Column, most: int = 72) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 3), F.lit("...")))


def tags(c: Column) -> Column:
    """Inner texts of the open and close tags of markup, quotes respected."""
    return F.regexp_extract_all(c, F.lit(r"""<((?:"[^"]*"|'[^']*'|[^>"'])*)>"""), F.lit(1))


def tag_name(inner: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(inner, "^/", ""), r"^([^ \t\n\r/]*)", 1)


def attribute(inner: Column, name: str) -> Column:
    """The value of an attribute; null where it is missing."""
    pattern = rf"""(?:^|\s){re.escape(name)}=(?:"([^"]*)"|'([^']*)')"""
    found = F.regexp_extract(inner, pattern, 0)
    return F.when(found != "", F.concat(F.regexp_extract(inner, pattern, 1), F.regexp_extract(inner, pattern, 2)))


def local_name(name: Column) -> Column:
    """The part after the colon; names with several colons stay as they are."""
    colons = F.length(name) - F.length(F.replace(name, F.lit(":"), F.lit("")))
    return F.when(colons == 1, F.substring_index(name, ":", -1)).otherwise(name)


#: Names of the reference's table; each stands for the character that HTML gives it.
ENTITIES = {name: html5[name + ";"] for name in """
    amp lt gt quot apos nbsp iexcl not shy ndash mdash hellip lsquo rsquo ldquo rdquo laquo raquo bull middot copy reg trade deg plusmn times divide micro
    sect para euro pound yen cent Aacute aacute Agrave agrave Acirc acirc Atilde atilde Auml auml Eacute eacute Egrave egrave Ecirc ecirc Euml euml Iacute
    iacute Igrave igrave Icirc icirc Iuml iuml Oacute oacute Ograve ograve Ocirc ocirc Otilde otilde Ouml ouml Uacute uacute Ugrave ugrave Ucirc ucirc
    Uuml uuml Ntilde ntilde Ccedil ccedil szlig
""".split()}
_ENTITY = re.compile(f"&(?:#([0-9]+)|#[xX]([0-9a-fA-F]+)|({'|'.join(ENTITIES)}));")


def _entity(m: re.Match) -> str:
    decimal, hexadecimal, name = m.groups()
    if name:
        return ENTITIES[name]
    digits = (decimal or hexadecimal).lstrip("0") or "0"
    code = int(digits, 10 if decimal else 16) if len(digits) <= 7 else 0x110000
    return m[0] if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code)


def decode_text(raw: str) -> str:
    """decode_entities for one text."""
    return _ENTITY.sub(_entity, raw) if "&" in raw else raw


def decode_entities(c: Column) -> Column:
    """Named, decimal and hex references decoded in one pass from the left; what is none of them, and code points that are no characters, stay."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([x if x is None else decode_text(x) for x in texts.to_pylist()], pa.string())

    return run(c)


def escape_html(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def interpolate(template: Column, params: dict[str, Column]) -> Column:
    """{name} replaced by its value; names that are not given stay."""
    for name, value in params.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def placeholders(template: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1)))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, as report offsets count."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


