import io
import zipfile

import pytest

from reflume.sources import docx

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


STYLES = f'<w:styles {W}><w:style w:type="paragraph" w:styleId="Heading1"><w:name w:val="heading 1"/></w:style></w:styles>'


def package(body, extra=None, compression=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", compression) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        for name, text in (extra or {}).items():
            z.writestr(name, text)
    return out.getvalue()


def p(text, style=None):
    props = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{props}<w:r><w:t>{text}</w:t></w:r></w:p>"


def test_blocks_notes_tables_and_fields():
    body = p("Introduction", "Heading1") + "<w:p><w:r><w:t>Fragmented </w:t></w:r><w:r><w:t>run text &amp; </w:t><w:tab/><w:t>here.</w:t></w:r></w:p>" + p(" ") + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    body += '<w:p><w:fldSimple w:instr=" CITATION Smi08 "><w:r><w:t>(Smith, 2008)</w:t></w:r></w:fldSimple></w:p>'
    notes = f'<w:footnotes {W}><w:footnote w:type="separator" w:id="-1">{p("x")}</w:footnote><w:footnote w:id="2">{p("Smith (2020).")}</w:footnote></w:footnotes>'
    rels = '<Relationships><Relationship TargetMode="External" Target="http://x/"/></Relationships>'
    row = docx.parse("d", package(body, {"word/footnotes.xml": notes, "word/vbaProject.bin": "m", "word/_rels/document.xml.rels": rels, "docProps/core.xml": "<c><creator> A </creator><title/></c>", "word/styles.xml": STYLES}))
    assert row["error"] is None and row["macros"] and row["remote_targets"] == ["http://x/"] and row["metadata"]["author"] == "A" and row["metadata"]["title"] is None
    assert [(b["block_id"], b["type"], b["text"]) for b in row["blocks"]] == [
        ("doc-p0", "heading", "Introduction"), ("doc-p1", "paragraph", "Fragmented run text & \there."), ("doc-t0", "table", "a\nb"), ("doc-p5", "paragraph", "(Smith, 2008)"), ("fn-fn0", "footnote", "Smith (2020)."),
    ]
    assert row["blocks"][3]["fields"] == [" CITATION Smi08 "] and row["blocks"][4]["paragraph_index"] is None


def test_bad_packages():
    name = lambda data: (docx.parse("d", data)["error"] or {}).get("name")
    good = package(p("x"))
    assert name(good) is None and name(None) == name(b"junk" * 20) == name(good[: len(good) // 2]) == "NotADocxError"
    empty = io.BytesIO()
    zipfile.ZipFile(empty, "w").close()
    assert name(empty.getvalue()) == "NotADocxError"
    assert name(package(p("x"), {"word/media/a": b"\0" * (docx.ENTRY_BYTES + 1)})) == "ZipBombError"
    assert name(package(p("x"), compression=zipfile.ZIP_BZIP2)) == "UnsupportedFormatError"
    assert docx.parse("d", package("<broken 'x"))["parse_issues"] == [{"part": "word/document.xml", "code": "malformed-content", "message": "1 broken paragraphs, 0 broken tables"}]


def test_checksums_sizes_and_time():
    good = package(p("x"))
    crc = zipfile.ZipFile(io.BytesIO(good)).getinfo("word/document.xml").CRC.to_bytes(4, "little")
    assert [b["text"] for b in docx.parse("d", good.replace(crc, b"\1\2\3\4"))["blocks"]] == ["x"]
    size = zipfile.ZipFile(io.BytesIO(good)).getinfo("word/document.xml").file_size
    small = good.replace(size.to_bytes(4, "little"), (size - 1).to_bytes(4, "little"))
    assert docx.parse("d", small)["error"]["name"] == "ZipBombError"
    large = good.replace(size.to_bytes(4, "little"), (size + 9).to_bytes(4, "little"))
    assert [b["text"] for b in docx.parse("d", large)["blocks"]] == ["x"]
    with pytest.raises(docx.PackageError, match="too long"):
        docx.unzip(good, seconds=-1)


def blocks(xml, **parts):
    rows, issues = docx.blocks_of({"word/document.xml": xml.encode(), **{f"word/{k}.xml": v.encode() for k, v in parts.items()}})
    return [(b["block_id"], b["text"]) for b in rows], [i["code"] for i in issues]


def test_broken_markup_keeps_what_stands_before():
    assert blocks(p("a") + p("b") + "<w:p><w:t>c</w:t><w:r 'x") == ([("doc-p0", "a"), ("doc-p1", "b"), ("doc-p2", "c")], ["malformed-content"])
    assert blocks(p("a") + "<w:p><w:t>tail &amp; more") == ([("doc-p0", "a"), ("doc-p1", "tail & more")], ["malformed-content"])
    assert blocks("words") == ([("doc-p0", "")][:0], ["not-xml", "malformed-content"])
    assert blocks(f"<w:tbl>{p('x')}{p('y')}") == ([("doc-t0", "x\ny")], ["malformed-content"])
    assert blocks(f"<w:tbl>{p('x')}<w:tr 'y") == ([("doc-t0", "x"), ("doc-t1", "x")], ["malformed-content"])
    assert blocks("<w:p><w:t>no &unknown; end&lt;</w:t></w:p>") == ([("doc-p0", "no &unknown; end<")], [])


def test_text_boxes_deletions_and_cdata():
    box = f"<w:p><w:t>outer</w:t><w:txbxContent>{p('inner')}</w:txbxContent><w:t>lost</w:t></w:p>"
    assert blocks(box + p("next")) == ([("doc-p0", "inner"), ("doc-p2", "next")], [])
    assert blocks("<w:p><w:del><w:r><w:t>kept</w:t><w:delText>gone</w:delText></w:r></w:del></w:p>")[0] == [("doc-p0", "kept")]
    assert blocks("<w:p><w:t>a<![CDATA[b]]>c</w:t><!-- <w:t>no</w:t> --><w:t>d</w:t></w:p>")[0] == [("doc-p0", "ad")]
    assert blocks('<w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr><w:t>a</w:t><w:br/><w:t>b</w:t><w:tab/></w:p><w:p x="a>b"><w:t>c</w:t></w:p>')[0] == [("doc-p0", "a\nb\t"), ("doc-p1", "c")]
    nested = f"<w:tbl>{p('a')}<w:tbl>{p('b')}</w:tbl></w:tbl>"
    assert blocks(p("0") + nested + p("z"))[0] == [("doc-p0", "0"), ("doc-t0", "a\nb"), ("doc-p3", "z")]


def test_classes_styles_and_fields():
    props = lambda inner: f"<w:p><w:pPr>{inner}</w:pPr><w:r><w:t>x</w:t></w:r></w:p>"
    numbered = '<w:numPr><w:numId w:val="%d"/></w:numPr>'
    rows, _ = docx.blocks_of({"word/document.xml": (props(numbered % 3) + props(numbered % 0) + props('<w:outlineLvl w:val="0"/>') + p("x", "Heading1")).encode()})
    assert [b["type"] for b in rows] == ["list", "paragraph", "heading", "paragraph"]  # a style that is not declared makes no heading
    style = lambda key, name, kind="paragraph", more="": f'<w:style w:type="{kind}" w:styleId="{key}"><w:name w:val="{name}"/>{more}</w:style>'
    declared = style("A", "Heading 3") + style("outline2", "x") + style("C", "heading 1", "character") + style("D", "x", "table", '<w:outlineLvl w:val="4"/>') + style("E", "Heading zero") + style("F", "x") + "<w:style w:styleId='Heading9'><w:name 'cut"
    assert docx.heading_styles(declared) == {"A": 2, "outline2": 1, "D": 4, "E": None, "Heading9": 8}
    code = lambda *texts: "".join(f"<w:instrText>{t}</w:instrText>" for t in texts)
    mark = lambda kind: f'<w:fldChar w:fldCharType="{kind}"/>'
    rows, _ = docx.blocks_of({"word/document.xml": f"<w:p>{mark('begin')}{code('a ', '&quot;b')}{mark('separate')}<w:t>t</w:t>{mark('end')}{code('bare')}</w:p>".encode()})
    assert rows[0]["fields"] == ['a "b', "bare"] and rows[0]["text"] == "t"


def test_source_map(spark):
    body = "<w:p><w:r><w:t>ab</w:t></w:r><w:tab/><w:r><w:t/></w:r><w:r><w:t>c&amp;d</w:t></w:r></w:p>" + f"<w:tbl>{p('x')}{p('y')}</w:tbl>"
    rows = docx.source_map(spark.createDataFrame([("d", package(body)), ("bad", b"no")], "doc_id string, content binary")).collect()
    assert sorted((r.block_id, r.run_index, r.start, r.end) for r in rows) == [("doc-p0", 0, 0, 2), ("doc-p0", 1, 3, 3), ("doc-p0", 2, 3, 6), ("doc-t0", 0, 0, 3)]
    assert all(r.doc_id == "d" for r in rows)


def test_reader(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(package(p("References", "Heading1") + p("Smith (2020) said."), {"word/styles.xml": STYLES}))
    (tmp_path / "b.docx").write_bytes(b"no")
    parsed = docx.read_docx(spark, str(tmp_path))
    assert sorted((r.doc_id[-6:], r.error.name if r.error else None) for r in parsed.collect()) == [("a.docx", None), ("b.docx", "NotADocxError")]
    assert [r.type for r in docx.blocks(parsed).orderBy("block_ord").collect()] == ["heading", "paragraph"]
