"""Markup read leniently: a flat list of tags, of which every element is a slice.

Nothing is expanded, followed or refused. Comments, instructions and
declarations are passed over; a tag without an end is the last event ("cut").
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

from reflume.functions.text import decode_text

_QUOTED = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_TAG = re.compile(
    rf"<(?:(?P<skip>\?.*?(?:\?>|\Z)|!-(?=-).*?(?:-->|\Z)|!(?!\[CDATA\[)(?:{_QUOTED}>|.*\Z))"
    rf"|(?P<cdata>!\[CDATA\[.*?(?:\]\]>|\Z))|/(?P<close>[^>]*+)(?:>|\Z)|(?P<open>{_QUOTED})>|(?P<cut>))",
    re.DOTALL,
)
_NAME = re.compile(r"[^ \t\n\r/]*")


class Event(NamedTuple):
    kind: str  # open, empty, close, cdata or cut
    name: str
    local: str
    inner: str
    start: int
    end: int


def local(name: str) -> str:
    """The part after the colon; names with several colons stay as they are."""
    return name.partition(":")[2] if name.count(":") == 1 else name


def events(xml: str) -> list[Event]:
    out = []
    for m in _TAG.finditer(xml):
        kind = m.lastgroup
        if kind == "skip":
            continue
        inner = m[kind] or ""
        name = ""
        if kind == "close":
            name = inner.strip()
        elif kind == "open":
            name = _NAME.match(inner)[0]
            kind = "empty" if inner.rstrip().endswith("/") else "open"
        out.append(Event(kind, name, local(name), inner, m.start(), m.end()))
        if kind == "cut":
            break
    return out


@lru_cache(maxsize=256)
def _attribute(name: str) -> re.Pattern:
    return re.compile(rf"""(?:^|\s){re.escape(name)}=(?:"([^"]*)"|'([^']*)')""")


def attribute(inner: str, name: str) -> str | None:
    """The raw value of an attribute; None where it is missing."""
    m = _attribute(name).search(inner)
    return (m[1] if m[1] is not None else m[2]) if m else None


def whole(value: str | None) -> int | None:
    """The whole number that a value begins with."""
    m = re.match(r"\s*([+-]?[0-9]+)", value or "")
    return int(m[1]) if m and len(m[1]) < 10 else None


class Paragraph(NamedTuple):
    ordinal: int
    at: int  # where its tag begins
    text: str
    runs: list[tuple[int, int]]  # half-open, in text
    style: str | None
    is_list: bool
    outline: int | None
    fields: list[str]
    broken: bool


class _Reader:
    """Text, runs, properties and fields of one paragraph, event by event."""

    def __init__(self, xml: str, stop: int):
        self.xml, self.stop = xml, stop
        self.text: list[str] = []
        self.length = 0
        self.runs: list[tuple[int, int]] = []
        self.fields: list[str] = []
        self.props: dict[str, str | None] = {}
        self.in_props = self.numbered = False
        self.text_from: int | None = None
        self.code_from: int | None = None
        self.code: list[str] | None = None  # of the open field

    def add(self, piece: str) -> None:
        self.text.append(piece)
        self.length += len(piece)

    def end_text(self, at: int) -> None:
        if self.text_from is not None:
            start = self.length
            self.add(decode_text(self.xml[self.text_from : at]))
            self.runs.append((start, self.length))
            self.text_from = None

    def end_code(self, at: int) -> None:
        if self.code_from is not None:
            raw = self.xml[self.code_from : at]
            if self.code is None:
                self.fields.append(decode_text(raw))
            else:
                self.code.append(raw)
            self.code_from = None

    def end_field(self) -> None:
        if self.code is not None:
            self.fields.append(decode_text("".join(self.code)))
            self.code = None

    def close(self, e: Event) -> None:
        if e.local == "instrText":
            self.end_code(e.start)
        elif e.local == "fldChar":
            self.end_field()
        elif e.local == "pPr":
            self.in_props = False

    def open(self, e: Event) -> None:
        holds = e.kind == "open"
        match e.local:
            case "pPr" if holds:
                self.in_props = True
            case "pStyle" | "numId" | "outlineLvl" if self.in_props:
                value = attribute(e.inner, "w:val")
                if e.local != "outlineLvl" or whole(value) is not None:
                    self.props[e.local] = value
            case "numPr" if self.in_props and holds:
                self.numbered = True
            case "t" if holds:
                self.text_from = e.end
            case "t":
                self.runs.append((self.length, self.length))
            case "fldChar":
                mark = attribute(e.inner, "w:fldCharType")
                if mark == "begin" and self.code is None:
                    self.code = []
                elif mark in ("separate", "end"):
                    self.end_field()
            case "instrText" if holds:
                self.code_from = e.end
            case "fldSimple":
                if (code := attribute(e.inner, "w:instr")) is not None:
                    self.fields.append(decode_text(code))
            case "br" | "cr" if not self.in_props:
                self.add("\n")
            case "tab" if not self.in_props:
                self.add("\t")

    def read(self, span: list[Event], ordinal: int, at: int, broken: bool) -> Paragraph:
        for e in span:
            if e.kind == "cut":
                broken = True
                break
            if e.name != "t" or e.kind == "close":
                self.end_text(e.start)
            if e.kind == "cdata":
                self.end_code(e.start)
            elif e.kind == "close":
                if e.local == "p":
                    break
                self.close(e)
            else:
                self.open(e)
        self.end_text(self.stop)
        self.end_code(self.stop)
        self.end_field()
        get = self.props.get
        return Paragraph(ordinal, at, "".join(self.text), self.runs, get("pStyle"), self.numbered and get("numId") != "0", whole(get("outlineLvl")), self.fields, broken)


def paragraphs(xml: str, span: list[Event], stop: int) -> Iterator[Paragraph]:
    """Paragraphs of a slice that ends before character `stop`.

    An inner paragraph (a text box) takes the place of the one around it, whose
    end still counts: ordinals have gaps there. A slice without the end of any
    paragraph is one itself, and broken.
    """
    first, n = None, 0
    for k, e in enumerate(span):
        if e.name != "w:p":
            continue
        if e.kind == "open":
            first = k
            continue
        if e.kind == "empty":
            first = k
        if first is not None:
            yield _Reader(xml, e.end).read(span[first : k + 1], n, span[first].start, False)
        first, n = None, n + 1
    if first is not None:
        yield _Reader(xml, stop).read(span[first:], n, span[first].start, True)
    elif n == 0:
        yield _Reader(xml, stop).read(span, 0, 0, True)


def elements(span: list[Event], name: str) -> Iterator[tuple[int, int, bool]]:
    """(first, one past the last, broken) of the outermost elements of a local name; one without an end goes on to the last event."""
    depth, first = 0, 0
    for k, e in enumerate(span):
        if e.local != name or e.kind == "empty":
            continue
        if e.kind == "open":
            first = first if depth else k
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                yield first, k + 1, False
    if depth:
        yield first, len(span), True
