"""Reading .docx packages: bounded unzip, and blocks from the parts' XML.

Nothing in a package is run or followed: macros and outside targets are noted.
A package that cannot be read gives a row with an error, never an exception;
broken markup keeps what stands before the break and is noted.
"""

from __future__ import annotations

import io
import re
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reflume.functions import markup
from reflume.functions.text import decode_text

#: Limits of a package.
ENTRY_BYTES, TOTAL_BYTES, XML_CHARS, ENTRIES, SECONDS = 50 * 2**20, 200 * 2**20, 64 * 2**20, 2000, 1.5
REQUIRED = ("[Content_Types].xml", "word/document.xml")
NOTE_KINDS, NOTE_IDS = {"separator", "continuationSeparator", "continuationNotice"}, {"-1", "0"}
MACRO = re.compile(r"(^|/)(vba|macro)|\.bin$", re.I)
OUTSIDE = re.compile(r"[a-z][a-z0-9+.-]*://|\\\\", re.I)
_STEP = 8192

PARSED = (
    "doc_id string, error struct<name: string, detail: string>, blocks array<struct<block_ord: int, block_id: string, type: string, text: string, style: string, paragraph_index: int, fields: array<string>>>, "
    "metadata struct<title: string, author: string, created: string, modified: string>, macros boolean, remote_targets array<string>, parse_issues array<struct<part: string, code: string, message: string>>"
)
#: A row for every run of text: where it lies in its block's text.
RUNS = "doc_id string, block_id string, paragraph_index int, run_index int, start int, end int"


class PackageError(Exception):
    """Why a package is not read; name is one of a fixed few."""

    def __init__(self, name: str, detail: str):
        super().__init__(detail)
        self.name, self.detail = name, detail


def unzip(data: bytes, seconds: float = SECONDS) -> dict[str, bytes]:
    """All parts of a package, within the limits. Checksums are not compared."""
    late = time.monotonic() + seconds
    if len(data) < 22 or data[:2] != b"PK":
        raise PackageError("NotADocxError", "not a zip archive")
    try:
        box = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError, OSError, struct.error) as e:
        raise PackageError("NotADocxError", str(e)) from None
    infos = [i for i in box.infolist() if not i.is_dir()]
    if len(infos) > ENTRIES:
        raise PackageError("ZipBombError", f"more than {ENTRIES} entries")
    if any(i.file_size > ENTRY_BYTES for i in infos) or sum(i.file_size for i in infos) > TOTAL_BYTES:
        raise PackageError("ZipBombError", "declared size is above the limit")
    out = {info.filename: _inflate(data, info, late) for info in infos}
    lacks = [r for r in REQUIRED if r not in out]
    if lacks:
        raise PackageError("NotADocxError", f"no {lacks[0]}")
    return out


def _inflate(data: bytes, info: zipfile.ZipInfo, late: float) -> bytes:
    """One part, inflated step by step: never more than its declared size, and not beyond the time `late`."""
    if info.flag_bits & 1:
        raise PackageError("UnsupportedFormatError", f"{info.filename}: encrypted")
    if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise PackageError("UnsupportedFormatError", f"{info.filename}: compression {info.compress_type}")
    head = data[info.header_offset : info.header_offset + 30]
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise PackageError("NotADocxError", f"{info.filename}: no header")
    at = info.header_offset + 30 + sum(struct.unpack("<HH", head[26:30]))
    raw = memoryview(data)[at : at + info.compress_size]
    beyond = PackageError("ZipBombError", f"{info.filename}: inflates beyond its size")
    if info.compress_type == zipfile.ZIP_STORED:
        if len(raw) > info.file_size:
            raise beyond
        return bytes(raw)
    got, step = bytearray(), zlib.decompressobj(-15)
    try:
        for k in range(0, len(raw), _STEP):
            feed = raw[k : k + _STEP]
            while len(feed) and not step.eof:
                if time.monotonic() > late:
                    raise PackageError("ZipBombError", f"{info.filename}: takes too long")
                got += step.decompress(feed, info.file_size - len(got) + 1)
                if len(got) > info.file_size:
                    raise beyond
                feed = step.unconsumed_tail
    except zlib.error as e:
        raise PackageError("NotADocxError", f"{info.filename}: {e}") from None
    if not step.eof:
        raise PackageError("NotADocxError", f"{info.filename}: ends early")
    return bytes(got)


def _part(parts: dict[str, bytes], name: str) -> str | None:
    if name not in parts:
        return None
    text = parts[name].decode("utf-8-sig", "replace")
    if len(text) > XML_CHARS:
        raise PackageError("ZipBombError", f"{name}: too long")
    return text


def heading_styles(styles: str) -> dict[str, int | None]:
    """Styles that make a heading, with their level: by outline level, or by a name or id that begins so."""
    found: dict[str, dict] = {}
    now: dict = {}
    for e in markup.events(styles):
        if e.kind == "open" and e.local == "style":
            now = {"kind": markup.attribute(e.inner, "w:type"), "name": "", "level": None}
            found[markup.attribute(e.inner, "w:styleId") or ""] = now
        elif e.kind == "close" and e.local == "style":
            now = {}
        elif now and e.kind in ("open", "empty") and e.local in ("name", "outlineLvl"):
            value = markup.attribute(e.inner, "w:val")
            if e.local == "name":
                now["name"] = value or ""
            elif markup.whole(value) is not None:
                now["level"] = markup.whole(value)
    found.pop("", None)
    out: dict[str, int | None] = {}
    for key, s in found.items():
        name, low = s["name"].lower(), key.lower()
        if s["level"] is not None:
            out[key] = s["level"]
        elif s["kind"] not in ("character", "table", "numbering") and (name.startswith(("heading", "outline")) or low.startswith(("heading", "outline"))):
            m = re.search(r"(?:heading|outline)\s*([0-9]+)", name) or re.fullmatch(r"(?:heading|outline)\s*([0-9]+)", low)
            level = int(m[1][:9]) - 1 if m else -1
            out[key] = level if level >= 0 else None
    return out


def _body(xml: str, heads: dict[str, int | None], issues: list[dict]) -> list[dict]:
    """Paragraphs and outermost tables of the document, in the order in which they begin."""
    span = markup.events(xml)
    placed: list[tuple[int, dict | None]] = []
    inside: list[tuple[int, int]] = []
    bad_paragraphs = bad_tables = 0
    tables = list(markup.elements(span, "tbl"))
    if tables and tables[-1][2] and span[-1].kind == "cut":
        tables.append(tables[-1])  # a table that a cut tag ends counts twice
    for n, (a, b, broken) in enumerate(tables):
        stop = len(xml) if broken else span[b - 1].end
        found = list(markup.paragraphs(xml, span[a:b], stop))
        text = "\n".join(p.text for p in found)
        bad_tables += broken or any(p.broken for p in found)
        inside.append((span[a].start, stop))
        placed.append((span[a].start, {"block_id": f"doc-t{n}", "type": "table", "text": text, "style": None, "paragraph_index": None, "fields": [], "runs": [(0, len(text))]}))
    t = 0
    for p in markup.paragraphs(xml, span, len(xml)):
        while t < len(inside) and inside[t][1] <= p.at:
            t += 1
        if t < len(inside) and inside[t][0] <= p.at:
            continue
        bad_paragraphs += p.broken
        kind = "heading" if p.style in heads or p.outline is not None else "list" if p.is_list else "paragraph"
        if p.text.strip() or kind == "heading":
            block = {"block_id": f"doc-p{p.ordinal}", "type": kind, "text": p.text, "style": p.style, "paragraph_index": p.ordinal, "fields": p.fields, "runs": p.runs}
            placed.append((p.at, block))
    if "<" not in xml:
        issues.append({"part": "word/document.xml", "code": "not-xml", "message": "no markup; the document is empty"})
    if bad_paragraphs or bad_tables:
        issues.append({"part": "word/document.xml", "code": "malformed-content", "message": f"{bad_paragraphs} broken paragraphs, {bad_tables} broken tables"})
    placed.sort(key=lambda x: (x[0], x[1]["type"] == "table"))
    return [block for _, block in placed]


def _notes(xml: str, part: str, tag: str, short: str, issues: list[dict]) -> list[dict]:
    """Notes with words; separators and the like are none. A note has no fields and no paragraph.

    A note that a cut tag ends is taken once, so that ids stay unique.
    """
    span = markup.events(xml)
    out: list[dict] = []
    bad = 0
    for a, b, broken in markup.elements(span, tag):
        get = lambda name: markup.attribute(span[a].inner, name)  # noqa: B023, E731
        if get("w:type") in NOTE_KINDS or get("w:id") in NOTE_IDS:
            continue
        found = list(markup.paragraphs(xml, span[a:b], len(xml) if broken else span[b - 1].end))
        text = "\n".join(p.text for p in found)
        if text.strip():
            bad += broken or any(p.broken for p in found)
            out.append({"block_id": f"{short}-fn{len(out)}", "type": tag, "text": text, "style": None, "paragraph_index": None, "fields": [], "runs": [(0, len(text))]})
    if bad:
        issues.append({"part": part, "code": "malformed-content", "message": f"{bad} broken notes"})
    return out


def blocks_of(parts: dict[str, bytes]) -> tuple[list[dict], list[dict]]:
    """Blocks in order (body, footnotes, endnotes) and what was broken."""
    issues: list[dict] = []
    styles = _part(parts, "word/styles.xml")
    out = _body(_part(parts, "word/document.xml") or "", heading_styles(styles) if styles else {}, issues)
    for part, tag, short in (("word/footnotes.xml", "footnote", "fn"), ("word/endnotes.xml", "endnote", "en")):
        xml = _part(parts, part)
        if xml is not None:
            out += _notes(xml, part, tag, short, issues)
    return [b | {"block_ord": k} for k, b in enumerate(out)], issues


def metadata_of(parts: dict[str, bytes]) -> dict:
    """Core properties by local name; an empty one is missing, of several the last counts."""
    keep = {"title": "title", "creator": "author", "created": "created", "modified": "modified"}
    out = dict.fromkeys(keep.values())
    xml = _part(parts, "docProps/core.xml") or ""
    key, since = None, 0

    def take(until: int) -> None:
        if key and (value := decode_text(xml[since:until]).strip()):
            out[key] = value

    for e in markup.events(xml):
        if e.kind == "cut":
            break
        if e.kind == "close":
            take(e.start)
            key = None
        elif e.local in keep:
            key, since = (keep[e.local], e.end) if e.kind == "open" else (None, 0)
    take(len(xml))
    return out


def remote_targets(parts: dict[str, bytes]) -> list[str]:
    """Targets outside the package, each once: marked so, with a scheme, or on a share."""
    out: dict[str, None] = {}
    for name in sorted(parts):
        if name.endswith(".rels"):
            for e in markup.events(_part(parts, name)):
                target = markup.attribute(e.inner, "Target") if e.local == "Relationship" and e.kind != "close" else None
                if target is not None and (markup.attribute(e.inner, "TargetMode") == "External" or OUTSIDE.match(target)):
                    out[decode_text(target)] = None
    return list(out)


def parse(doc_id: str, data: bytes | None) -> dict:
    """One package as a row of PARSED, its blocks with the runs of their texts."""
    row = {"doc_id": doc_id, "error": None, "blocks": [], "metadata": None, "macros": False, "remote_targets": [], "parse_issues": []}
    try:
        parts = unzip(data or b"")
        row["blocks"], row["parse_issues"] = blocks_of(parts)
        row |= {"metadata": metadata_of(parts), "macros": any(MACRO.search(p) for p in parts), "remote_targets": remote_targets(parts)}
    except PackageError as e:
        row["blocks"], row["error"] = [], {"name": e.name, "detail": e.detail}
    return row


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """A row of PARSED for every file that path names; doc_id is the file's path."""
    return parse_packages(spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), "content"))


def parse_packages(packages: DataFrame) -> DataFrame:
    """packages (doc_id, content) -> rows of PARSED."""
    from reflume.operators.bibliography import _arrow

    kind = _arrow(packages.sparkSession, PARSED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist([parse(batch.column(0)[k].as_py(), batch.column(1)[k].as_py())], schema=kind)

    return packages.select("doc_id", "content").mapInArrow(run, PARSED)


def source_map(packages: DataFrame) -> DataFrame:
    """packages (doc_id, content) -> rows of RUNS, each run a slice of its block's text; tables and notes are one run."""
    from reflume.operators.bibliography import _arrow

    kind = _arrow(packages.sparkSession, RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = parse(batch.column(0)[k].as_py(), batch.column(1)[k].as_py())
                rows = [
                    {"doc_id": row["doc_id"], "block_id": b["block_id"], "paragraph_index": b["paragraph_index"], "run_index": n, "start": start, "end": end}
                    for b in row["blocks"]
                    for n, (start, end) in enumerate(b["runs"])
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return packages.select("doc_id", "content").mapInArrow(run, RUNS)


def blocks(parsed: DataFrame) -> DataFrame:
    """The block rows of parsed packages."""
    return parsed.select("doc_id", F.inline("blocks")).select("doc_id", "block_ord", "block_id", "type", "text", "style", "paragraph_index", "fields")
