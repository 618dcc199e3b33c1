import io
import tracemalloc
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievemark.sources import files, parsers
from sievemark.streaming.ingest import detect_stream, passages_stream


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
DOCX = zipped(word__document_xml=f"<w:document {W}><w:body><w:p><w:r><w:t>Hello </w:t><w:t>Ann</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
XLSX = zipped(xl__workbook_xml=f'<workbook {S}><sheets><sheet name="One"/></sheets></workbook>', xl__sharedStrings_xml=f"<sst {S}><si><t>Name</t></si><si><t>SSN</t></si><si><t>Ann</t></si></sst>",
              xl__worksheets__sheet1_xml=f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>123456789</v></c></row><row><c r="A3"/></row></sheetData></worksheet>')
EML = b"From: a@x.org\nTo: b@x.org\nSubject: s\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain\n\nbody\n--B\nContent-Type: text/plain\nContent-Disposition: attachment; filename=note.txt\n\ninner SSN 123-45-6789\n--B--\n"
CASES = [
    ("empty.txt", b"", "txt", "zero_byte"), ("locked.pdf", b"%PDF-1.4 /Encrypt 3 0 R %%EOF", "pdf_digital", "password_protected"), ("torn.pdf", b"%PDF-1.4 no end", "pdf_digital", "corrupt"),
    ("sheet.pdf", XLSX, "xlsx", None), ("junk.docx", b"just text", "docx", "wrong_extension"), ("blob.bin", b"\x00\x01\x02\xff", "unknown", "unsupported"), ("old.msg", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1xx", "msg", "unsupported"),
    ("m.eml", EML, "eml", None), ("a.csv", b"name,ssn\nAnn,1\n", "csv", None), ("torn.docx", DOCX[:60], "docx", "corrupt"), ("d.docx", DOCX, "docx", None), ("p.html", b"<html><head><title>t</title></head><body><p>Hi&amp;<br>there</p><script>x</script></body></html>", "html", None),
]


@pytest.fixture
def routed(spark, tmp_path):
    for name, data, _, _ in CASES:
        (tmp_path / name).write_bytes(data)
    (tmp_path / ".hidden").write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "again.csv").write_bytes(b"name,ssn\nAnn,1\n")
    return files.route(files.inventory(spark, str(tmp_path)))


def test_routing(routed):
    got = {r.name: (r.file_class, r.reason) for r in routed.collect()}
    assert got.pop("again.csv") == ("csv", None)
    assert got == {name: (kind, reason) for name, _, kind, reason in CASES}
    assert routed.where("name = 'sheet.pdf'").first().note == "reclassified-from=pdf_digital"
    good, bad = files.split_quarantine(routed)
    assert good.count() + bad.count() == routed.count()


def test_dedup_in_a_run(routed):
    kept = files.dedup_within_run(routed.withColumn("run_id", F.lit(1)))
    assert kept.count() == routed.count() - 1 and kept.where("copies = 1").first().name == "a.csv"


def test_parsing_and_attachments(routed):
    rows = parsers.parse_with_attachments(files.dedup_within_run(routed.withColumn("run_id", F.lit(1)))).orderBy("path", "seq").collect()
    by = {}
    for r in rows:
        by.setdefault(r.path.rsplit("/", 1)[-1], []).append(r)
    assert [r.text for r in by["d.docx"]] == ["Hello Ann", "a | b"]
    assert by["sheet.pdf"][0].text == "Name | SSN\nAnn | 123456789" and by["sheet.pdf"][0].header == ["Name", "SSN"]
    assert [r.part for r in by["m.eml"]] == ["headers", "body"] and by["m.eml!note.txt"][0].text.startswith("inner SSN")
    assert by["p.html"][0].text == "\nHi&\nthere" or by["p.html"][0].text == "Hi&\nthere"
    assert by["a.csv"][0].text == "name,ssn\nAnn,1"


def test_header_types(spark):
    df = spark.createDataFrame([("SSN",), (" Social_Security-Number ",), ("Notes",), (None,)], "h string")
    assert [r[0] for r in df.select(parsers.header_type(F.col("h"))).collect()] == ["ssn", "ssn", None, None]


def test_detection_over_a_stream(spark, tmp_path):
    rows = [(1, "SSN 123-45-6789"), (1, "SSN 123-45-6789"), (2, "nothing")]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000)))
    df.write.parquet(str(tmp_path / "in"))
    stream = detect_stream(passages_stream(spark, str(tmp_path / "in"), df.schema), "at", ["id"])
    q = stream.writeStream.format("memory").queryName("found").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.id, r.element_type) for r in spark.table("found").collect()] == [(1, "ssn")]


def test_sheets_are_found_by_their_relationship():
    sheet = lambda v: f'<worksheet {S}><sheetData><row><c><v>h</v></c></row><row><c><v>{v}</v></c></row></sheetData></worksheet>'
    book = f'<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Second" r:id="b"/><sheet name="Chart" r:id="c"/><sheet name="First" r:id="a"/><sheet name="Lost" r:id="x"/></sheets></workbook>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", book)
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/other.xml"/><Relationship Id="c" Target="chartsheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet("one"))
        z.writestr("xl/worksheets/other.xml", sheet("two"))
        z.writestr("xl/chartsheets/sheet1.xml", sheet("none"))
    assert [(p["sheet"], p["text"]) for p in parsers._xlsx(out.getvalue())] == [("Second", "h\ntwo"), ("First", "h\none")]


def test_markup_of_a_batch_is_held_a_few_pages_at_a_time():
    pages = pa.array(["<p>" + "word " * 2_000 + "</p>", None, ""] * 1_000)
    tracemalloc.start()
    try:
        got = parsers.html_to_text.func(pages)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4_000_000  # all strings of the batch are 20 MB
    assert got.to_pylist() == [("word " * 2_000).strip(), None, ""] * 1_000
    assert parsers.html_to_text.func(pa.array([], pa.string())).to_pylist() == []
