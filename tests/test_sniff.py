from pyspark.sql import functions as F

from sievemark.sources.files import SNIFFED, describe, route


def test_types_by_the_first_bytes(spark):
    long = "é" * (SNIFFED // 2 + 5)
    rows = [
        ("a.txt", long.encode(), "text/plain"), ("b.txt", b"x" + long.encode(), "text/plain"), ("c.txt", "x".encode() * (SNIFFED - 1) + "\U0001f600".encode() * 3, "text/plain"),
        ("d.txt", b"x" * SNIFFED + b"\xff\xfe\x00", "text/plain"), ("e.bin", b"ab\xff\xfe", "application/octet-stream"), ("f.bin", b"ab\x00c", "application/octet-stream"),
        ("g.txt", b"", "inode/x-empty"), ("h.html", b" <!DOCTYPE html><p>", "text/html"), ("i.eml", b"From: a@b.c\n", "message/rfc822"), ("j.txt", b"ab\xc3", "application/octet-stream"),
    ]
    files = spark.createDataFrame([(n, n, bytearray(c)) for n, c, _ in rows], "path string, name string, content binary")
    assert {r.name: r.sniffed_mime for r in describe(files).collect()} == {n: m for n, _, m in rows}


def test_pdf_probe_by_bytes(spark):
    pad = b"\x00\xff" * 3000
    rows = [("ok.pdf", b"%PDF-1.4" + pad + b"%%EOF\n"), ("locked.pdf", b"%PDF-1.4 /Encrypt 5 0 R" + pad + b"%%EOF"), ("cut.pdf", b"%PDF-1.4 %%EOF" + pad), ("short.pdf", b"%PDF%%EOF")]
    files = spark.createDataFrame([(n, n, bytearray(c)) for n, c in rows], "path string, name string, content binary")
    assert {r.name: r.reason for r in route(describe(files)).select("name", F.col("reason")).collect()} == {"ok.pdf": None, "locked.pdf": "password_protected", "cut.pdf": "corrupt", "short.pdf": None}
