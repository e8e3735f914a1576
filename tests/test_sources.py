import json
import zipfile

import pytest

from folioframe.sources import archive as ar
from folioframe.sources import tables as tb
from folioframe.streaming import flows

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"


def _zip(path, **parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def test_archive_scan_and_extract(spark, tmp_path):
    root = tmp_path / "архив +1"
    root.mkdir()
    (root / "a.txt").write_bytes("Привет, архив".encode("cp1251"))
    (root / "b.rtf").write_text(r"{\rtf1\ansi Hello  {\b world} of documents}")
    _zip(root / "c.docx", **{"word/document.xml": f'<w:d xmlns:w="{W}"><w:t>Акт приёмки выполненных работ номер 12</w:t></w:d>'})
    _zip(root / "d.xlsx", **{"xl/sharedStrings.xml": f'<s xmlns="{S}"><si><t>Owner</t></si><si><t>Due</t></si></s>'})
    _zip(root / "e.pptx", **{"ppt/slides/slide1.xml": f'<p xmlns:a="{A}"><a:t>Slide</a:t><a:t>one</a:t></p>'})
    _zip(root / "f.zip", **{"in.txt": "inner text", "skip.bin": "x"})
    (root / "g.pdf").write_bytes(b"%PDF-1.7")
    (root / "h.docx").write_bytes(b"broken")
    (root / "i.tmp").write_bytes(b"x")
    listing = {r["relative_path"]: r for r in ar.scan_archive(spark, str(root), compute_hash=True).collect()}
    assert set(listing) == {"a.txt", "b.rtf", "c.docx", "d.xlsx", "e.pptx", "f.zip", "g.pdf", "h.docx", "i.tmp"}
    assert listing["i.tmp"]["import_action"] == "skip" and listing["i.tmp"]["content_hash"] is None
    assert listing["a.txt"]["content_hash"].startswith("sha256:")

    files = spark.read.format("binaryFile").load(str(root)).selectExpr("element_at(split(path, '/'), -1) AS relative_path", "content")
    got = {r["relative_path"]: (r["text"], r["method"], r["confidence"]) for r in ar.extract_text(files).collect()}
    assert got["a.txt"] == ("Привет, архив", "plain_text", 0.98)
    assert got["b.rtf"] == ("Hello world of documents", "rtf_strip", 0.9)
    assert got["c.docx"] == ("Акт приёмки выполненных работ номер 12", "docx_xml", 0.95)
    assert got["d.xlsx"] == ("Owner\nDue", "xlsx_strings", 0.3)
    assert got["e.pptx"] == ("Slide one", "pptx_xml", 0.3)
    assert got["f.zip"] == ("[in.txt]\ninner text", "zip_inner", 0.25)
    assert got["g.pdf"] == ("", "unsupported", 0.0)
    assert got["h.docx"] == ("", "docx_xml", 0.0)


def test_readers_of_formats(spark, tmp_path):
    """Sheets by row and cell, slides in order with notes, escapes of rich text, many and damaged entries."""
    R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda r, t, v: f'<c r="{r}" t="{t}"><v>{v}</v></c>'
    sheet = f'<w xmlns="{S}"><sheetData><row>{cell("A1", "s", 1)}{cell("B1", "n", 42)}</row><row><c t="inlineStr"><is><t>x</t></is></c></row></sheetData></w>'
    _zip(tmp_path / "a.xlsx", **{"xl/sharedStrings.xml": f'<s xmlns="{S}"><si><t>Owner</t></si><si><t>Due</t></si></s>', "xl/worksheets/sheet1.xml": sheet})
    slide = lambda t: f'<p xmlns:a="{A}"><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p>'
    rel = lambda *ts: "<r>" + "".join(f'<x Id="r{i}" Target="{t}"/>' for i, t in enumerate(ts)) + "</r>"
    _zip(tmp_path / "b.pptx", **{
        "ppt/slides/slide1.xml": slide("second"), "ppt/slides/slide2.xml": slide("first"), "ppt/notesSlides/n.xml": slide("note"),
        "ppt/presentation.xml": f'<p xmlns:r="{R}"><sldId r:id="r1"/><sldId r:id="r0"/></p>',
        "ppt/_rels/presentation.xml.rels": rel("slides/slide1.xml", "/ppt/slides/slide2.xml"),
        "ppt/slides/_rels/slide2.xml.rels": rel("../notesSlides/n.xml"),
    })
    (tmp_path / "c.rtf").write_bytes(rb"{\rtf1\ansi\ansicpg1251{\fonttbl{\f0 Arial;}}\uc1 \'cf\'f0\'e8 \u1074?\u1077? a\par b{\*\x hidden}}")
    _zip(tmp_path / "d.zip", **{f"f{i}.txt": f"text {i}" for i in range(30)})
    (tmp_path / "e.xls").write_bytes(b"\x00\x01Hello there\x02abc\x03HELLO THERE\x04" + "Журнал".encode("cp1251") + b"\x00")
    (tmp_path / "f.sdr").write_bytes("Смета".encode("cp1251"))
    (tmp_path / "g.md").write_text("# head")
    locked = bytearray((tmp_path / "d.zip").read_bytes())
    locked[6] |= 1
    at = bytes(locked).index(b"PK\x01\x02")
    locked[at + 8] |= 1
    (tmp_path / "h.zip").write_bytes(bytes(locked))
    (tmp_path / "i.zip").write_bytes(b"PK\x03\x04 damaged")
    (tmp_path / "j.docx").write_bytes((tmp_path / "a.xlsx").read_bytes())
    files = spark.read.format("binaryFile").load(str(tmp_path)).selectExpr("element_at(split(path, '/'), -1) AS relative_path", "content")
    got = {r["relative_path"]: r for r in ar.extract_text(files).collect()}
    assert {k: got[k]["text"] for k in got if k[0] in "abcefg"} == {
        "a.xlsx": "Due\t42\nx", "b.pptx": "first\nnote\nsecond", "c.rtf": "При ве a b", "e.xls": "Hello there\nЖурнал", "f.sdr": "Смета", "g.md": "# head",
    }
    assert got["d.zip"]["text"].count("text") == 30 and got["d.zip"]["error"] is None
    assert got["h.zip"]["text"].count("text") == 29 and got["h.zip"]["error"].startswith("f0.txt: RuntimeError")
    assert got["i.zip"]["text"] == "" and "BadZipFile" in got["i.zip"]["error"]
    assert got["j.docx"]["error"].startswith("KeyError")


def test_sheet_with_many_columns_and_line_breaks(spark, tmp_path):
    (tmp_path / "wide.csv").write_text(",".join(f"c{i}" for i in range(70)) + '\n\n"two\nlines",b\n')
    rows = tb.read_sheet_cells(spark, str(tmp_path / "wide.csv")).orderBy("ordinal").collect()
    assert [len(r["values"]) for r in rows] == [70, 2] and rows[1]["values"][0] == "two\nlines"


def test_chunk_files(spark, tmp_path):
    rows = [{"chunk_id": "c1", "doc_id": "d", "page": 1, "content_preview": "x"}]
    (tmp_path / "v1.json").write_text(json.dumps({"chunks": rows}))
    (tmp_path / "v2.json").write_text(json.dumps(rows * 2))
    (tmp_path / "bad.json").write_text('"text"')
    p = lambda n: str(tmp_path / n)
    assert tb.read_chunks(spark, p("v1.json")).count() == 1
    assert tb.read_chunks_variant(spark, p("v1.json"), p("v2.json")).count() == 2
    assert tb.read_chunks_variant(spark, p("v1.json"), p("none.json")).count() == 1
    with pytest.raises(FileNotFoundError):
        tb.read_chunks_variant(spark, p("v1.json"), p("none.json"), "v2")
    with pytest.raises(Exception, match="neither a list"):
        tb.read_chunks(spark, p("bad.json")).collect()


def test_org_snapshot(spark, tmp_path):
    path = tmp_path / "org.json"
    path.write_text(json.dumps({"companies": [{"company_id": "c"}], "employees": [{"employee_id": "e", "status": "active"}]}))
    org = tb.read_org_snapshot(spark, str(path))
    assert len(org) == 7
    assert org["companies"].first()["company_id"] == "c" and org["employees"].count() == 1


def test_sheet_cells(spark, tmp_path):
    from folioframe.operators import tasks as tk

    (tmp_path / "plan.csv").write_text('Title,,\nDue Date,Task,Owner\n2025-01-02,"Pour, concrete",Ann\n,,\n2025-01-03,Task name x,Bob\n2025-01-04,No owner,\n')
    rows = tk.tasks_from_sheet(tb.read_sheet_cells(spark, str(tmp_path / "plan.csv"))).collect()
    assert [(r["task"], r["owner"], r["due"]) for r in rows] == [("Pour, concrete", "Ann", "2025-01-02")]


def test_stream_ingest_replaces_changed_documents(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    doc = "doc_id string, text string, updated_at timestamp"
    first = spark.sql("select 'a' doc_id, 'old text' text, timestamp'2024-01-01' updated_at union all select 'b', 'kept', timestamp'2024-01-01'")
    first.write.json(src)
    flows.stream_ingest(spark, src, out, state).awaitTermination()
    spark.sql("select 'a' doc_id, 'new text' text, timestamp'2024-01-02' updated_at").write.mode("append").json(src)
    flows.stream_ingest(spark, src, out, state).awaitTermination()
    rows = {r["doc_id"]: r["content"] for r in flows.read_current(spark, out).collect()}
    assert rows == {"a": "new text", "b": "kept"} and doc


def test_scan_archive_writes_its_files_on_all_cores(spark, tmp_path):
    from folioframe.plans import source_queries as sq

    rows = [(i, "en" if i % 2 else "de", f"text {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert len({r["folder"] for r in sq.scan_archive(spark, str(tmp_path)).collect()}) == 40
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = store.stageList(None, False, False, none, None)
    writes = [stages.apply(i) for i in range(stages.size()) if stages.apply(i).outputRecords() == 40]
    assert writes and max(s.numTasks() for s in writes) == spark.sparkContext.defaultParallelism


def test_archive_files_lie_where_the_text_writer_puts_them(spark, tmp_path):
    odd = ["en", None, "", "a/b=c", "50%", "é ю", "x:y?*#\"'{[]^\\", "tab\there", "\x7f", "+"]
    rows = [(lang, i, None if i == 3 else f"text {i}\nя") for i, lang in enumerate(odd)]
    docs = spark.createDataFrame(rows, "lang string, doc_id long, value string")
    ar.write_archive(docs, f"file:{tmp_path}/own", ["lang", "doc_id"])
    docs.write.partitionBy("lang", "doc_id").text(f"{tmp_path}/spark")
    files = lambda root: {str(p.parent.relative_to(root)): p.read_bytes() for p in root.rglob("*.txt")}
    assert files(tmp_path / "own") == files(tmp_path / "spark") and len(files(tmp_path / "own")) == len(odd)


def test_documents_with_one_key_are_files_of_their_own(spark, tmp_path):
    from folioframe.plans import source_queries as sq

    docs = spark.createDataFrame([(1, "en", "one"), (1, "en", "two"), (2, "en", "three")], "doc_id long, lang string, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = sq.scan_archive(spark, str(tmp_path)).collect()
    assert sorted((r["folder"], r["size_bytes"]) for r in rows) == [("lang=en/doc_id=1", 4), ("lang=en/doc_id=1", 4), ("lang=en/doc_id=2", 6)]
    assert len({r["content_hash"] for r in rows}) == 3
