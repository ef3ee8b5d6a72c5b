import pytest
from pyspark.sql import functions as F

from terrier.operators import catalog, words
from terrier.operators.extract import certificates, first_by_explode, first_in_lines
from terrier.sources import uploads
from terrier.streaming import ingest


def certificate(spark, text, lang="en", **kw):
    df = spark.createDataFrame([(1, text)], "id int, raw_text string")
    return certificates(df, "id", lang=F.lit(lang), **kw).first().certificate


@pytest.mark.parametrize(
    "line, lang, field, value",
    [
        ("Survey No: 104/2B", "en", "survey_number", "104/2B"),
        ("Plot No 44/B", "en", "survey_number", "44"),
        ("দাগ নং ১২৩/৪", "bn", "survey_number", "123/4"),
        ("দাগের তথ্য", "bn", "survey_number", None),
        ("Khata No 7-8A", "en", "khata_number", "7-8"),
        ("Executed on 11/03/2010", "en", "registration_date", "2010-03-11"),
        ("Issued On : 1.2.2003 | x", "en", "issue_date", "2003-02-01"),
        ("survey no: ; later", "en", "survey_number", None),
    ],
)
def test_fields(spark, line, lang, field, value):
    got = certificate(spark, line, lang)[field]
    assert (got and got.value) == value


def test_owners_and_villages(spark):
    got = certificate(spark, "Owner Name: Ram Das S/O Hari Das")
    assert got.owners[0][:3] == ("Ram Das", "Pattadar / Khatedar", "Hari Das")
    got = certificate(spark, "Village Name: Rampur")
    assert got.location.village == "Rampur" and got.owners[0].name == "Rampur"
    assert certificate(spark, "name: X owner name: Y").owners[0].name == "Y"


def test_areas_of_lines(spark):
    assert certificate(spark, "৫ একর জমি", "bn").area_extent is None
    got = certificate(spark, "৫ একর", "bn").area_extent
    assert (got.value, got.unit, got.confidence) == (5.0, "acre", 0.64)
    assert certificate(spark, "Total Area: 3 acre").area_extent.confidence == 0.68


def test_confidences_and_verification(spark):
    got = certificate(spark, "Survey No: 1\nKhata No: 2\nOwner Name: A\nDated: 1/1/2001\nIssue date: 2/2/2002")
    assert [x.confidence for x in (got.survey_number, got.khata_number, got.owners[0], got.registration_date, got.issue_date)] == [0.70, 0.70, 0.70, 0.72, 0.70]
    assert got.overall_confidence == 0.7 and got.verification_status == "VERIFIED"
    low = certificate(spark, "Survey No: 1", ocr_confidence=F.lit(50.0))
    assert (low.overall_confidence, low.verification_status) == (0.44, "NEEDS_REVIEW")


def test_empty_and_blank_texts(spark):
    for t in ("", None):
        got = certificate(spark, t, "bn", document_type=F.lit("patta"), state=F.lit("Goa"))
        assert (got.document_type, got.detected_language, got.detected_script, got.location, got.overall_confidence, got.owners) == ("patta", "en", "Latin", None, 0.0, [])
    assert certificate(spark, "  ", "bn", state=F.lit("Goa")).location.state == "Goa"


def test_entities_fill_what_lines_leave(spark):
    ents = "array(named_struct('text', 'Asha', 'label', 'PER', 'confidence', 0.9D), named_struct('text', 'Pune', 'label', 'LOC', 'confidence', 0.8D))"
    df = spark.createDataFrame([(1, "plain words"), (2, "Owner Name: B\nMouza: C")], "id int, raw_text string").withColumn("ents", F.expr(ents))
    got = {r.id: r.certificate for r in certificates(df, "id", entities="ents").collect()}
    assert (got[1].owners[0].name, got[1].owners[0].confidence, got[1].location.village) == ("Asha", 0.72, "Pune")
    assert (got[2].owners[0].name, got[2].location.village) == ("B", "C")


def test_fold_in_the_row_and_by_explode_agree(spark):
    texts = ["Survey No: 1\nname: x\nvillage: v", "no\nplot no ; \nsurvey no 9/2c\nDated: 1/2/2003\n5 acre", "তারিখ ৫/৬/২০০৭ | x\nমৌজা : ক"]
    df = spark.createDataFrame([(i, ["en", "en", "bn"][i], t.split("\n")) for i, t in enumerate(texts)], "id int, lang string, lines array<string>").withColumn("state", F.lit("Karnataka"))
    a = first_in_lines(df, F.col("state"))
    b = first_by_explode(df, "id", "state")
    assert sorted(map(tuple, a.select(*b.columns).collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def register(spark):
    rows = [(i, f"T{i}", "100% a_b\\c" if i == 3 else None, ["patta", "other"][i % 2], "PENDING", None) for i in range(6)]
    return spark.createDataFrame(rows, "id long, title string, district string, document_type string, status string, raw_text string").withColumn("created_at", F.timestamp_seconds(F.col("id") % 3))


def test_search_and_pages(spark):
    docs = register(spark)
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(catalog.search(docs, "PATTA", "pending")) == [0, 2, 4]
    assert ids(catalog.search(docs, "ALL", "ALL", " 0% A_B ")) == [3]
    assert ids(catalog.search(docs, text="b\\c")) == [3] and ids(catalog.search(docs, text="x\\")) == []
    assert ids(catalog.search(docs, text="  ")) == list(range(6)) and ids(catalog.search(docs, text="")) == list(range(6))
    assert [r.id for r in catalog.page(docs, 1, 3).collect()] == [2, 4, 1]
    for skip, limit in ((-1, 5), (0, 0), (0, 201)):
        with pytest.raises(ValueError):
            catalog.page(docs, skip, limit)


def test_page_is_a_bounded_sort(spark):
    plan = catalog.page(register(spark), 5, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "SinglePartition" not in plan


def test_changes(spark):
    docs = register(spark)
    patch = spark.createDataFrame([(1, ["title", "district"], "new", None, "DIGITIZED"), (9, ["title"], "x", None, None)], "id long, set_fields array<string>, title string, district string, status string")
    got = {r.id: r for r in catalog.patched(docs, patch).collect()}
    assert len(got) == 6 and (got[1].title, got[1].status, got[2].title) == ("new", "PENDING", "T2")
    assert sorted(r.id for r in catalog.deleted(docs, spark.range(0, 4).withColumnRenamed("id", "id")).collect()) == [4, 5]
    result = spark.createDataFrame([(0, "text", None), (1, "", None), (2, "text", "broke")], "id long, raw_text string, error string")
    status = {r.id: (r.status, r.raw_text) for r in catalog.written_back(docs, result).collect()}
    assert [status[i] for i in range(4)] == [("DIGITIZED", "text"), ("FAILED", ""), ("FAILED", None), ("PENDING", None)]


def test_words(spark):
    rows = [(0, "a", 90.0), (1, "b", 80.0), (2, "", -1.0), (3, "c", 0.0), (4, "d", 70.0)]
    w = spark.createDataFrame([(1, "single", p, o, *r) for o, p in enumerate((4, 6)) for r in rows], "doc_id int, section string, psm int, psm_ord int, i int, text string, conf double")
    made = words.passes(w)
    assert {(r.psm, r.text, r.confidence) for r in made.collect()} == {(4, "a b\nd", 80.0), (6, "a b\nd", 80.0)}
    assert words.documents(words.best_passes(made)).collect()[0][1:] == ("a b\nd", 80.0)


def test_uploads(spark, tmp_path):
    for name, data in (("deed.PDF", b"x"), ("scan.tif", b"yy"), ("virus.exe", b"z")):
        (tmp_path / name).write_bytes(data)
    good, bad = uploads.read_uploads(spark, f"file://{tmp_path}")
    assert {(r.original_filename, r.mime_type, r.file_name[-5:]) for r in good.collect()} == {("deed.PDF", "application/pdf", good.filter("mime_type = 'application/pdf'").first().file_name[-5:]), ("scan.tif", "image/tiff", good.filter("mime_type = 'image/tiff'").first().file_name[-5:])}
    assert [r.reason for r in bad.collect()] == ["unsupported type"]


def test_stream(spark, tmp_path):
    rows = [(1, "Survey No: 5/1\nDated: 1/2/2003", None, None, "patta", 90.0), (2, "", None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, raw_text string, state string, district string, document_type string, ocr_confidence double").withColumn("arrived", F.current_timestamp())
    df.write.parquet(f"file://{tmp_path}/in")
    ingest.start(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    got = {r.id: (r.status, r.certificate.survey_number and r.certificate.survey_number.value) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {1: ("DIGITIZED", "5/1"), 2: ("FAILED", None)}


def test_arrivals(spark):
    rows = [(1, "DIGITIZED", "2024-01-01 01:00:00"), (2, "DIGITIZED", "2024-01-01 23:00:00"), (3, "FAILED", "2024-01-02 01:00:00")]
    df = spark.createDataFrame(rows, "id long, status string, at string").withColumn("arrived", F.to_timestamp("at"))
    got = {(str(r.window.start.date()), r.status): r.n for r in ingest.arrivals(df).collect()}
    assert got == {("2024-01-01", "DIGITIZED"): 2, ("2024-01-02", "FAILED"): 1}


def test_inserts_strip_all_white_space_and_starts_take_keys(spark):
    docs = register(spark)
    up = spark.createDataFrame([(10, "\t\n", "a.pdf", "PATTA", "\u3000", "", None), (11, "\tP1\n", "b.pdf", "Lease", None, "\tX\r", "S")], "id long, title string, original_filename string, document_type string, parcel_identifier string, district string, state string")
    got = {r.id: r for r in catalog.inserted(docs, up).collect()}
    assert (got[10].title, got[10].parcel_identifier, got[10].district, got[10].status) == ("a.pdf", "", None, "PENDING")
    assert (got[11].title, got[11].district, got[11].document_type) == ("P1", "X", "lease")
    keys = spark.createDataFrame([(1,), (1,), (None,), (77,)], "id long")
    assert {r.id: r.status for r in catalog.started(docs, keys).collect()} == {i: "PROCESSING" if i == 1 else "PENDING" for i in range(6)}
    assert catalog.started(docs, keys, auto_process=False) is docs


def test_of_several_changes_the_last_counts(spark):
    docs = register(spark)
    patch = spark.createDataFrame([(1, ["title"], "late", 5), (1, ["title"], "early", 1), (2, ["title"], "a", 3), (2, ["title"], "b", 3)], "id long, set_fields array<string>, title string, at int")
    got = {r.id: r.title for r in catalog.patched(docs, patch).collect()}
    assert len(got) == 6 and catalog.patched(docs, patch).count() == 6 and (got[1], got[2]) == ("late", "b")
    result = spark.createDataFrame([(0, "x", None, 1), (0, "", None, 2), (3, "t", None, 9), (3, "t", "broke", 1)], "id long, raw_text string, error string, at int")
    back = catalog.written_back(docs, result)
    assert back.count() == 6 and {r.id: r.status for r in back.collect() if r.id in (0, 3)} == {0: "FAILED", 3: "DIGITIZED"}


def test_rows_have_the_columns_of_the_table(spark):
    d = catalog.rows(register(spark))
    assert d.columns == uploads.table_schema().names and len(d.columns) == 20
    made = certificates(spark.createDataFrame([(1, "Survey No: 5")], "id long, raw_text string"), "id").select("certificate").schema[0].dataType
    assert made.simpleString() == uploads.table_schema()["extracted_data"].dataType.simpleString()


def test_table_is_made_and_dropped(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS t_deeds LOCATION 'file://{tmp_path}/db'")
    uploads.create_table(spark, "t_deeds.documents")
    uploads.create_table(spark, "t_deeds.documents")
    assert spark.table("t_deeds.documents").columns == uploads.table_schema().names
    uploads.drop_table(spark, "t_deeds.documents")
    assert not spark.catalog.tableExists("t_deeds.documents")
    spark.sql("DROP DATABASE t_deeds")


def test_blank_words_are_any_white_space(spark):
    w = spark.createDataFrame([(1, "single", 4, 0, i, t, 90.0) for i, t in enumerate(["a", "\t", " b\n", "\u3000", None, "c"])], "doc_id int, section string, psm int, psm_ord int, i int, text string, conf double")
    assert words.passes(w).first().text == "a\nb\nc"


def test_pages_take_their_own_sections_and_modes(spark):
    rows = [(1, "left", 4, 0, "short", 50.0), (1, "left", 6, 0, "longer text", 60.0), (1, "left", 11, 0, "a mode that left has not, though longer", 99.0), (1, "right", 11, 0, "right text", 80.0), (1, "single", 4, 0, "not asked for at all", 10.0), (2, "single", 4, 0, "one", 70.0), (2, "left", 4, 0, "no", 70.0)]
    w = spark.createDataFrame(rows, "doc_id long, section string, psm int, i int, text string, conf double")
    pages = spark.createDataFrame([(1, 2, None), (2, 1, "Kerala"), (3, 2, "")], "doc_id long, columns int, state string")
    got = {r.doc_id: tuple(r)[1:] for r in words.recognised(w, pages).collect()}
    left, right = words.SECTIONS.values()
    assert got[1] == (f"{left}\nlonger text\n\n{right}\nright text", 70.0, "en", "Latin", "English")
    assert got[2] == ("one", 70.0, "en", "Latin", "English (Malayalam Jurisdiction)") and got[3] == ("", 0.0, "en", "Latin", "English")


def test_entities_of_an_empty_text_are_left_out(spark):
    ents = "array(named_struct('text', 'Asha', 'label', 'PER', 'confidence', 0.9D))"
    df = spark.createDataFrame([(1, ""), (2, None)], "id int, raw_text string").withColumn("ents", F.expr(ents))
    assert all(r.certificate.owners == [] for r in certificates(df, "id", entities="ents").collect())


def test_areas_are_shown_as_a_browser_shows_them(spark):
    values = [2.0, 12345678.0, 2.5, 0.125, 1e-4, 1e-6, 1.5e-7, 1e21, 123456789012345680.0, -3.0, 0.0, None, float("nan"), 0.1, 1e20]
    units = ["acre", None, "", *["bigha"] * 12]
    rows = [(i, v, u) for i, (v, u) in enumerate(zip(values, units, strict=True))]
    got = [r.x for r in spark.createDataFrame(rows, "i int, v double, u string").orderBy("i").select(catalog.area_label(F.col("v"), F.col("u")).alias("x")).collect()]
    want = ["2 acre", "12345678 sq. units", "2.5 sq. units", "0.125 bigha", "0.0001 bigha", "0.000001 bigha", "1.5e-7 bigha", "1e+21 bigha", "123456789012345680 bigha", "-3 bigha", "—", "—", "—", "0.1 bigha", "100000000000000000000 bigha"]
    assert got == want


def test_every_change_is_dated(spark):
    docs = spark.createDataFrame([(i, "PENDING", "old") for i in range(3)], "id long, status string, raw_text string").withColumn("updated_at", F.lit("2020-01-01").cast("timestamp"))
    result = spark.createDataFrame([(1, "text", None, 1), (2, "", None, 1)], "id long, raw_text string, error string, at int")
    dated = lambda d: {r.id for r in d.filter("updated_at > '2020-01-02'").collect()}
    assert dated(catalog.written_back(docs, result)) == {1, 2}
    assert dated(catalog.started(docs)) == {0, 1, 2}
    assert dated(catalog.started(docs, docs.filter("id = 1"))) == {1}


def test_words_of_a_large_table_are_not_shuffled(spark, tmp_path):
    """a table of more splits than cores was not dealt by document, so each grouping shuffled its words."""
    from terrier.plans import scans

    spark.createDataFrame([(i, "a b\nc") for i in range(64)], "doc_id long, text string").repartition(9).write.parquet(f"{tmp_path}/documents.parquet")
    conf = {"spark.sql.files.openCostInBytes": "134217728", "spark.sql.files.maxPartitionBytes": "134217728"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = scans.ocr_documents(spark, str(tmp_path))
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert got.count() == 64
    finally:
        for k in conf:
            spark.conf.unset(k)
