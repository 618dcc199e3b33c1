import re

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    base = [f"w{k}" for k in range(120)]
    rows, labels = [], []
    for k in range(200):
        words = [f"{c}{(k * 7 + j) % 173}{chr(97 + k % 26)}" for j, c in enumerate("abcdefghijklmnopqrst")]
        if k % 4 == 0:
            words[3:3] = ["idiots", "scummy", "trashy"]
        rows.append((k, " ".join(words), "en", f"src{k % 3}", 0))
        labels.append((k, 1, int(k % 4 == 0)))
    rows += [(200 + k, " ".join(base[: 119] + [f"x{k}"]), "en", "src0", 0) for k in range(10)]
    rows += [(300, "write to ann@example.org or call +1 (212) 555-0147 today please", "en", "src1", 0), (301, None, None, None, None), (302, "", "en", "src1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen[name] = docs.collect()
        assert name == "pack" or docs.columns == columns
    clean = {r.doc_id for r in seen["toxicity"]}
    assert not any(k % 4 == 0 for k in clean if k < 200) and len([k for k in clean if k < 200]) == 150 and {200, 300, 301, 302} <= clean
    single = {r.doc_id for r in seen["ngram_jaccard_join"]}
    assert 200 in single and not single & set(range(201, 210)) and {300, 301, 302} <= single
    note = next(r for r in seen["pii"] if r.doc_id == 300)
    assert note.text == "write to [EMAIL] or call [PHONE] today please" and note.n_chars == len(note.text)
    size = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in seen["pii"])
    mixed = sum(len(r.text.split()) for r in seen["mix"])
    assert abs(mixed - 1.5 * size) <= 130 and max(sum(1 for r in seen["mix"] if r.doc_id == k) for k in single) <= 2
    assert {r.doc_id for r in seen["pack"]} == {r.doc_id for r in seen["mix"]}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["pack"])


def test_repeated_and_null_ids_are_rows_of_their_own(spark, tmp_path):
    rows = [(None, "a b c"), (None, "d e"), (5, "f g h i"), (5, "f g h i"), (5, "k l m n o"), (6, "j"), (7, None), (8, "")]
    spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    single = corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in single), key=str) == sorted(set(rows), key=str)
    spent = corpus_pipeline.mix(docs).selectExpr("sum(size * copies) AS begun", "sum(taken) AS taken", "sum(size) AS size").first()
    out = corpus_pipeline.mix_sources(spark, docs, "").collect()
    assert sum(len((r.text or "").split()) for r in out) == spent.begun and spent.taken == int(1.5 * spent.size)
    assert max(sum(1 for r in out if r.text == t) for _, t in rows) <= 4 and not any(r.doc_id in (7, 8) for r in out)


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).isEmpty()
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()
