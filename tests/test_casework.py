import io
import json
import zipfile
from xml.etree import ElementTree

from pyspark.sql import functions as F

from sievemark.operators import accuracy, extract, manifest, positions, resolve
from sievemark.sources import parsers, sinks


def test_fuzzy_scores_are_clamped_and_ties_go_by_id(spark):
    truth = spark.createDataFrame([("u1", "Ann Lee", "1990-01-02"), ("u2", "Ann Lee", "1990-01-02"), ("u3", "Zoe Quill", None)], "uid string, name string, dob string")
    predicted = spark.createDataFrame([("p2", "Ann Lee", "1990-01-02"), ("p1", "Lee Ann", "1990-01-02"), ("p3", "Zoe Quil", "1980-01-01")], "person_id string, name string, dob string")
    found = accuracy.fuzzy_candidates(truth, predicted)
    scores = {(r.uid, r.person_id): r.score for r in found.collect()}
    assert max(scores.values()) == 1.0 and scores["u1", "p2"] == scores["u2", "p1"] == 1.0
    assert {(r.uid, r.person_id) for r in accuracy.greedy_match(found).collect()} == {("u1", "p1"), ("u2", "p2"), ("u3", "p3")}
    assert accuracy.greedy_match(found.limit(0)).isEmpty()


def test_fuzzy_blocks_find_names_without_a_common_token(spark):
    names = ["John Smith", "Maria Garcia", "Peter Olsen", "Katherine Novak"]
    typos = ["Jon Smyth", "Mria Garca", "Petr Olsn", "Katherin Novk"]
    truth = spark.createDataFrame([(str(k), n, None) for k, n in enumerate(names)], "uid string, name string, dob string")
    predicted = spark.createDataFrame([(str(k), n, None) for k, n in enumerate(typos)], "person_id string, name string, dob string")
    found = {(r.uid, r.person_id) for r in accuracy.fuzzy_candidates(truth, predicted).collect()}
    whole = truth.withColumnRenamed("name", "a").crossJoin(predicted.withColumnRenamed("name", "b")).where(accuracy.token_sort("a", "b") >= 0.72)
    assert found == {(r.uid, r.person_id) for r in whole.collect()} and ("0", "0") in found


def test_rows_stay_where_they_lie(spark, tmp_path):
    rows = [(k % 5 if k % 7 else None, f"t{k}", k) for k in range(300)]
    spark.createDataFrame(rows, "id long, doc string, n long").repartition(6).write.parquet(str(tmp_path / "t"))
    placed = positions.with_position(spark.read.parquet(str(tmp_path / "t")))
    counts = placed.select("_position", (F.col("n") % 3).alias("n"))
    want = sorted((str(r), c) for r in rows for c in range(r[2] % 3))
    for most in (1 << 20, 120, 10):  # sent at once, in waves, and by a shuffle
        got = positions.repeat_rows(placed, counts, sent_rows=most)
        assert got.columns == ["id", "doc", "n"]
        assert sorted(str(tuple(r)) for r in got.collect()) == [x for x, _ in want]
    assert positions.repeat_rows(placed.limit(0), counts.limit(0)).isEmpty()


def test_positions_move_no_text(spark, tmp_path):
    spark.range(100).select("id", F.lit("x").alias("text")).write.parquet(str(tmp_path / "p"))
    placed = positions.with_position(spark.read.parquet(str(tmp_path / "p")))
    plan = positions.repeat_rows(placed, placed.select("_position", F.lit(1).alias("n")))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_manifest(spark, tmp_path):
    doc = {"identities": [{"person_uid": "u1", "canonical_name": "Ann Lee", "dob": "1990-01-02", "elements": {"email": " Ann@X.org ", "address": "1 Main"}, "name_variants": [{"value": "A. Lee"}]}],
           "documents": [{"filename": "a.txt", "plantings": [{"person_uid": "u1", "element_type": "ssn", "value": "219-09-9999"}, {"person_uid": None, "element_type": "ssn", "value": "123-45-6789"}, {"person_uid": "u1", "element_type": "name", "value": "Ann"}]}]}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
    m = manifest.read_manifest(spark, str(tmp_path))
    planted = manifest.plantings(m)
    assert [tuple(r) for r in manifest.expected_categories(planted).collect()] == [("u1", "ssn")]
    assert [tuple(r) for r in manifest.true_identifiers(m).collect()] == [("u1", "email", "ann@x.org")]
    assert manifest.identities(m).first().names == ["A. Lee", "Ann Lee"]
    assert {"123456789", "123-45-6789"} <= {r.value for r in manifest.trap_values(planted).collect()}
    images = manifest.all_images(planted, spark.createDataFrame([("a.txt", True)], "doc string, is_image_based boolean"))
    assert [tuple(r) for r in images.collect()] == [("u1", True)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b", c', None, True), (2, "<&>", 0.5, False)], "id long, name string, score double, ok boolean")
    sinks.write_csv(rows.coalesce(1), str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).orderBy("id").collect()
    assert [r.name for r in back] == ['a "b", c', "<&>"]
    books = sinks.workbooks(rows.coalesce(1), per_book=1).collect()
    assert [b.rows for b in books] == [1, 1]
    sheet = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(books[1].content)).read("xl/worksheets/sheet1.xml"))
    assert [t.text for t in sheet.iter("{http://schemas.openxmlformats.org/spreadsheetml/2006/main}t")] == ["id", "name", "score", "ok", "<&>"]
    assert sinks.workbooks(rows.limit(0)).isEmpty()


def test_html_and_empty_texts(spark):
    text = parsers.html_text("<title>no</title><p>a &amp; b</p><script>x<y</script><!-- c --><div>c<br>d  e</div><img alt='x>y'>f")
    assert text == "a & b\n\nc\nd e\nf" and parsers.html_text("<p></p>") == ""
    files = spark.createDataFrame([("a", "txt", bytearray(b"")), ("b", "html", bytearray(b"<p></p>"))], "path string, file_class string, content binary")
    assert [(r.path, r.text, r.error) for r in parsers.parse(files).orderBy("path").collect()] == [("a", "", None), ("b", "", None)]


def test_ocr_gate_and_sheet_sample(spark):
    p = spark.createDataFrame([(1, 0, "����ab", True, True), (2, 0, "plain words", True, True), (3, 0, "��", True, False)], "document_id long, seq int, text string, ocr boolean, is_image_based boolean")
    assert [(r.document_id, r.reason) for r in parsers.ocr_garbage(p).collect()] == [(1, "ocr_garbage")]
    s = spark.createDataFrame([(1, ["SSN", "Note", ""], ["ssn", None, None], [["1", "x", "y"]] * 8), (2, ["SSN"], ["ssn"], [["1"]])], "sheet_id long, header array<string>, types array<string>, cells array<array<string>>")
    got = extract.sheet_sample(s).collect()
    assert [(r.sheet_id, r.columns, r.sample) for r in got] == [(1, ["Note"], [["x"]] * 5)]


def test_gray_items_and_skipped_blocks(spark):
    b = spark.createDataFrame([(1, 2, 1, 2, 0.625, "gray"), (3, 4, 3, 3, 0.9, "auto")], "left_id long, right_id long, left_cluster long, right_cluster long, score double, band string")
    assert [(r.left_id, r.priority) for r in resolve.gray_items(b).collect()] == [(1, 62)]
    k = spark.createDataFrame([(m, "name:x", False) for m in range(5)] + [(m, "strong:y", True) for m in range(9)], "mention_id long, key string, strong boolean")
    assert [(r.key, r.mentions) for r in resolve.skipped_blocks(k, most=4).collect()] == [("name:x", 5)]
