"""The register of documents, made from the given tables: search, pages, changes and labels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terrier.functions.text import chunks, decompose, lines, megabytes, title_from_filename, type_label
from terrier.operators import catalog, postings
from terrier.operators.components import shared_folder
from terrier.plans.registry import query, table
from terrier.sources import changes
from terrier.sources.uploads import accepted_type, stored_name, table_schema

TYPES = ["sale_deed", "patta", "mutation", "encumbrance", "gift_deed", "lease", "survey_map", "other"]
STATUSES = ["PENDING", "PROCESSING", "DIGITIZED", "FAILED"]


def register(spark, sf_dir):
    """Documents as rows of the register; what they lack follows from doc_id."""
    i = F.col("doc_id")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(i, F.lit(len(xs))) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        i.alias("id"),
        F.concat(F.lit("Doc "), i).alias("title"),
        F.concat("source", F.lit("_"), i, F.lit(".pdf")).alias("original_filename"),
        F.concat(F.lit("/up/"), i).alias("file_path"),
        F.when(i % 3 != 0, F.concat(F.lit("P-"), i)).alias("parcel_identifier"),
        F.col("lang").alias("district"),
        F.when(i % 5 != 0, F.lit("Goa")).alias("state"),
        pick(TYPES).alias("document_type"),
        pick(STATUSES).alias("status"),
        F.col("text").alias("raw_text"),
        (F.pmod(i * 7, F.lit(101))).cast("double").alias("ocr_confidence"),
        F.when(i % 4 == 2, F.concat(F.lit("/done/"), i)).alias("processed_file_path"),
        F.timestamp_seconds(F.lit(1704067200) + F.pmod(i, F.lit(1000)) * 3600).alias("created_at"),
    )


REGISTER = f"""r AS (SELECT doc_id AS id, 'Doc ' || doc_id AS title, source || '_' || doc_id || '.pdf' AS original_filename, '/up/' || doc_id AS file_path, CASE WHEN doc_id % 3 <> 0 THEN 'P-' || doc_id END AS parcel_identifier, lang AS district,
CASE WHEN doc_id % 5 <> 0 THEN 'Goa' END AS state, ({TYPES!r})[doc_id % 8 + 1] AS document_type, ({STATUSES!r})[doc_id % 4 + 1] AS status, text AS raw_text, CAST((doc_id * 7) % 101 AS DOUBLE) AS ocr_confidence,
CASE WHEN doc_id % 4 = 2 THEN '/done/' || doc_id END AS processed_file_path, (doc_id % 1000) AS hour FROM documents)"""


@query(f"WITH {REGISTER} SELECT id, title, district FROM r WHERE title ILIKE '%under the%license%' OR original_filename ILIKE '%under the%license%' OR parcel_identifier ILIKE '%under the%license%' OR district ILIKE '%under the%license%' OR raw_text ILIKE '%under the%license%'")
def doc_search_ilike(spark, sf_dir):
    return catalog.search(register(spark, sf_dir), text="  Under the%License ").select("id", "title", "district")


@query(f"WITH {REGISTER} SELECT id, title, district FROM r WHERE title ILIKE '%under the%license%' OR original_filename ILIKE '%under the%license%' OR parcel_identifier ILIKE '%under the%license%' OR district ILIKE '%under the%license%' OR raw_text ILIKE '%under the%license%'")
def doc_search_indexed(spark, sf_dir):
    """The same search by an index, which is written first."""
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    postings.write_index(register(spark, sf_dir), folder)
    return postings.search_index(spark, folder, "  Under the%License ").select("id", "title", "district")


@query(f"WITH {REGISTER} SELECT id, document_type, status FROM r WHERE document_type = 'patta' AND status = 'PROCESSING'")
def doc_filter_type_status(spark, sf_dir):
    return catalog.search(register(spark, sf_dir), document_type="PATTA", status="processing").select("id", "document_type", "status")


@query(f"WITH {REGISTER} SELECT id, title, status FROM r ORDER BY hour DESC, id DESC LIMIT 100 OFFSET 20")
def doc_page(spark, sf_dir):
    return catalog.page(register(spark, sf_dir), 20, 100).select("id", "title", "status")


@query(f"WITH {REGISTER} SELECT id, title, original_filename, ocr_confidence FROM r WHERE id = 42")
def doc_point_lookup(spark, sf_dir):
    return catalog.one(register(spark, sf_dir), 42).select("id", "title", "original_filename", "ocr_confidence")


def _labelled(spark, sf_dir):
    """Labels as changes, two of each: a first one, and a later one that must win."""
    p = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return p.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("at"))


@query(f"""WITH {REGISTER}, p AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)
SELECT id, title, CASE WHEN toxic IS NULL THEN status WHEN toxic = 1 THEN 'FAILED' ELSE status END AS status, CASE WHEN toxic IS NULL THEN district ELSE NULL END AS district, CASE WHEN quality IS NULL THEN state WHEN toxic = 1 THEN 'Q' || quality ELSE state END AS state, toxic IS NOT NULL AS touched FROM r LEFT JOIN p ON id = doc_id""")
def doc_patch(spark, sf_dir):
    fields = F.when(F.col("at") == 1, F.array(F.lit("title"), F.lit("status"))).when(F.col("toxic") == 1, F.array(F.lit("status"), F.lit("district"), F.lit("state"))).otherwise(F.array(F.lit("district")))
    p = _labelled(spark, sf_dir).select("id", "at", fields.alias("set_fields"), F.when(F.col("at") == 2, "FAILED").otherwise("first").alias("status"), F.lit(None).cast("string").alias("district"), F.concat(F.lit("Q"), F.col("quality")).alias("state"), F.lit("unset").alias("title"))
    r = register(spark, sf_dir).withColumn("updated_at", F.col("created_at"))
    return catalog.patched(r, p).select("id", "title", "status", "district", "state", (F.col("updated_at") > F.col("created_at")).alias("touched"))


@query(f"WITH {REGISTER} SELECT id, CASE WHEN id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'PROCESSING' ELSE status END AS status, id IN (SELECT doc_id FROM labels WHERE quality = 1) AS touched FROM r UNION ALL SELECT -id - 1, 'PROCESSING', true FROM r")
def doc_start(spark, sf_dir):
    """Some rows started, and, under negative ids, all of them."""
    r, told = register(spark, sf_dir).withColumn("updated_at", F.col("created_at")), (F.col("updated_at") > F.col("created_at")).alias("touched")
    some = catalog.started(r, table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))).select("id", "status", told)
    return some.union(catalog.started(r).select(-F.col("id") - 1, "status", told))


@query(f"WITH {REGISTER} SELECT id, title FROM r WHERE coalesce(title, original_filename, parcel_identifier, district, raw_text) IS NOT NULL")
def doc_search_blank(spark, sf_dir):
    return catalog.search(register(spark, sf_dir), "ALL", "ALL", " \t ").select("id", "title")


@query(f"""WITH {REGISTER} SELECT id, title, original_filename, CAST(NULL AS VARCHAR) AS file_name, file_path, CAST(NULL AS BIGINT) AS file_size, CAST(NULL AS VARCHAR) AS mime_type, document_type, parcel_identifier, district, state, status, processed_file_path,
CAST(NULL AS VARCHAR) AS detected_language, CAST(NULL AS VARCHAR) AS detected_script, raw_text, ocr_confidence, CAST('7/' || id AS VARCHAR) AS survey, strftime(TIMESTAMP '2024-01-01' + to_hours(hour), '%Y-%m-%d %H') AS created, true AS never_updated, CAST(20 AS BIGINT) AS n_columns FROM r""")
def doc_rows(spark, sf_dir):
    """Rows as a list answers with them; of the certificate, the survey number."""
    survey = F.struct(F.concat(F.lit("7/"), F.col("id")).alias("value"))
    r = register(spark, sf_dir)
    made = F.from_json(F.to_json(F.struct(survey.alias("survey_number"))), table_schema()["extracted_data"].dataType)
    d = catalog.rows(r.withColumn("extracted_data", made))
    n = len(d.columns)
    return d.select(*[c for c in d.columns if c not in ("extracted_data", "created_at", "updated_at")], F.col("extracted_data.survey_number.value").alias("survey"), F.date_format("created_at", "yyyy-MM-dd HH").alias("created"), F.col("updated_at").isNull().alias("never_updated"), F.lit(n).cast("long").alias("n_columns"))


@query(f"""WITH {REGISTER} SELECT id, CASE WHEN id % 3 = 0 THEN 'V' || id ELSE '—' END AS village, CASE WHEN id % 2 = 0 THEN 'D' || id WHEN coalesce(district, '') <> '' THEN district ELSE '—' END AS district, CASE WHEN id % 5 <> 0 THEN 'Goa' ELSE '—' END AS state FROM r""")
def preview_location(spark, sf_dir):
    i, none = F.col("id"), F.lit(None).cast("string")
    r = register(spark, sf_dir)
    return r.select("id", catalog.location_label(F.when(i % 3 == 0, F.concat(F.lit("V"), i))).alias("village"), catalog.location_label(F.when(i % 2 == 0, F.concat(F.lit("D"), i)).otherwise(""), F.col("district")).alias("district"), catalog.location_label(none, F.col("state")).alias("state"))


@query(f"WITH {REGISTER} SELECT id, title FROM r WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)")
def doc_delete(spark, sf_dir):
    return catalog.deleted(register(spark, sf_dir), table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))).select("id", "title")


@query(f"""WITH {REGISTER}, p AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)
SELECT id, CASE WHEN quality IS NULL THEN status WHEN toxic = 1 OR quality = 0 THEN 'FAILED' ELSE 'DIGITIZED' END AS status, CASE WHEN toxic = 0 AND quality = 0 THEN 0 WHEN toxic = 0 THEN 4 ELSE length(raw_text) END AS n, quality IS NOT NULL AS touched FROM r LEFT JOIN p ON id = doc_id""")
def doc_write_back(spark, sf_dir):
    first = F.col("at") == 1
    p = _labelled(spark, sf_dir).select("id", "at", F.when(first | (F.col("toxic") == 1), "no text").alias("error"), F.when(first, "too early").when(F.col("quality") == 1, "read").otherwise("").alias("raw_text"))
    r = register(spark, sf_dir).withColumn("updated_at", F.col("created_at"))
    return catalog.written_back(r, p).select("id", "status", F.length("raw_text").cast("long").alias("n"), (F.col("updated_at") > F.col("created_at")).alias("touched"))


@query(f"WITH {REGISTER} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'DIGITIZED') AS digitized, count(*) FILTER (WHERE status = 'PENDING') AS pending FROM r")
def dashboard_counts(spark, sf_dir):
    return catalog.dashboard(register(spark, sf_dir))


@query(f"WITH {REGISTER}, p AS (SELECT * FROM r ORDER BY hour DESC, id DESC LIMIT 100) SELECT count(*) AS total, count(*) FILTER (WHERE status = 'DIGITIZED') AS digitized, count(*) FILTER (WHERE status = 'PENDING') AS pending FROM p")
def dashboard_counts_page(spark, sf_dir):
    return catalog.dashboard(catalog.page(register(spark, sf_dir)))


@query(f"WITH {REGISTER} SELECT id, CASE WHEN floor(ocr_confidence + 0.5) >= 80 OR ocr_confidence = 1 THEN 'success' WHEN floor(ocr_confidence + 0.5) >= 50 THEN 'warning' ELSE 'destructive' END AS bucket FROM r")
def confidence_bucket(spark, sf_dir):
    return register(spark, sf_dir).select("id", catalog.confidence_bucket(F.col("ocr_confidence")).alias("bucket"))


@query(f"""WITH {REGISTER} SELECT id, coalesce(parcel_identifier, CASE WHEN id % 2 = 0 THEN '7/' || id END, '—') AS list_parcel, coalesce(CASE WHEN id % 2 = 0 THEN '7/' || id END, parcel_identifier, '—') AS shown_parcel,
CASE WHEN district IS NULL OR district = '' THEN '—' WHEN state IS NULL THEN district ELSE district || ', ' || state END AS place, upper(replace(document_type, '_', ' ')) AS type_label, CASE WHEN status = 'DIGITIZED' THEN 'VERIFIED' ELSE 'PENDING REVIEW' END AS verification,
CASE id % 6 WHEN 0 THEN '—' WHEN 1 THEN id || ' acre' WHEN 2 THEN id * 12345678 || ' sq. units' WHEN 3 THEN CAST(id + 0.5::DOUBLE AS VARCHAR) || ' sq. units' WHEN 4 THEN CAST(id + 0.125::DOUBLE AS VARCHAR) || ' bigha' ELSE '0.00001' || lpad(CAST(id % 100 AS VARCHAR), 2, '0') || '5 acre' END AS area, CASE WHEN processed_file_path IS NOT NULL THEN processed_file_path ELSE file_path END AS path, strftime(TIMESTAMP '2024-01-01' + to_hours(hour), '%Y-%m-%d') AS issued, printf('%.2f', length(raw_text) * 1000 / 1048576.0::DOUBLE) AS size FROM r""")
def row_labels(spark, sf_dir):
    r, survey = register(spark, sf_dir), F.when(F.col("id") % 2 == 0, F.concat(F.lit("7/"), F.col("id"))).otherwise("")
    i = F.col("id").cast("double")
    extent = F.when(F.col("id") % 6 == 1, i).when(F.col("id") % 6 == 2, i * 12345678).when(F.col("id") % 6 == 3, i + 0.5).when(F.col("id") % 6 == 4, i + 0.125).when(F.col("id") % 12 == 0, 0.0).when(F.col("id") % 6 == 5, F.concat(F.lit("0.00001"), F.lpad((F.col("id") % 100).cast("string"), 2, "0"), F.lit("5")).cast("double"))
    unit = F.when(F.col("id") % 6 == 2, "").when(F.col("id") % 6 == 4, "bigha").when(F.col("id") % 6 != 3, "acre")
    return r.select(
        "id",
        catalog.parcel_label(F.col("parcel_identifier"), survey).alias("list_parcel"),
        catalog.parcel_label(F.col("parcel_identifier"), survey, True).alias("shown_parcel"),
        catalog.place_label(F.col("district"), F.col("state")).alias("place"),
        type_label(F.col("document_type")).alias("type_label"),
        catalog.verification_label(F.lit(None).cast("string"), F.col("status")).alias("verification"),
        catalog.area_label(extent, unit).alias("area"),
        catalog.served_path(F.lit(True)).alias("path"),
        catalog.issue_label(F.lit(""), F.col("created_at")).alias("issued"),
        megabytes(F.length("raw_text") * 1000).alias("size"),
    )


@query("SELECT o_custkey, string_agg(o_orderpriority, ', ' ORDER BY o_orderkey) AS owner_label, true AS has_extracted FROM orders GROUP BY o_custkey")
def owner_label(spark, sf_dir):
    owners = F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderpriority").alias("name"))))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(owners.alias("owners"))
    certificate = F.struct("owners", F.lit(None).cast("string").alias("survey_number"))
    return o.select("o_custkey", catalog.owner_label(F.col("owners")).alias("owner_label"), catalog.has_extracted(certificate).alias("has_extracted"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/tiff' WHEN 3 THEN NULL WHEN 4 THEN 'application/pdf' ELSE NULL END AS accepted, regexp_replace(translate(event_type || '_scan-' || event_id, '_-', '  '), '\\.[^.]*$', '') AS title FROM events""")
def upload_validate(spark, sf_dir):
    k = F.col("event_id") % 6
    end = F.element_at(F.array(*map(F.lit, [".bin", ".JPEG", ".tif", ".exe", "", ""])), (k + 1).cast("int"))
    name = F.concat("event_type", F.lit("_scan-"), F.col("event_id"), end)
    mime = F.when(k == 0, "image/PNG").when(k == 4, "application/pdf").when(k == 2, "text/plain")
    return table(spark, sf_dir, "events").select("event_id", accepted_type(mime, name).alias("accepted"), title_from_filename(name).alias("title"))


@query("""WITH u AS (SELECT p_partkey, p_name, p_size FROM part) SELECT 1000000 + p_partkey AS id, CASE p_size % 4 WHEN 0 THEN p_name WHEN 2 THEN p_name || chr(9) || 'x' ELSE p_name || '.pdf' END AS title, 'patta' AS document_type, 'PENDING' AS status, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Pune' END AS district FROM u
UNION ALL SELECT doc_id, 'Doc ' || doc_id, (['sale_deed', 'patta', 'mutation', 'encumbrance', 'gift_deed', 'lease', 'survey_map', 'other'])[doc_id % 8 + 1], (['PENDING', 'PROCESSING', 'DIGITIZED', 'FAILED'])[doc_id % 4 + 1], lang FROM documents""")
def doc_insert(spark, sf_dir):
    size, none = F.col("p_size"), F.lit(None).cast("string")
    title = F.when(size % 4 == 0, F.concat(F.lit("  "), F.col("p_name"), F.lit("\n"))).when(size % 4 == 2, F.concat(F.lit("\t\u3000"), F.col("p_name"), F.lit("\tx\r\n"))).when(size % 4 == 1, "\t\n ").otherwise("")
    new = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1000000).alias("id"), title.alias("title"), F.concat("p_name", F.lit(".pdf")).alias("original_filename"), F.lit("PATTA").alias("document_type"), none.alias("parcel_identifier"), F.when(size % 3 == 0, "").when(size % 3 == 1, " \n\t ").otherwise("\tPune \n").alias("district"), none.alias("state"))
    return catalog.inserted(register(spark, sf_dir), new).select("id", "title", "document_type", "status", "district")


@query("""SELECT event_id, sha256(event_type || event_id) || CASE event_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.png' ELSE '' END AS file_name FROM events""")
def upload_stored_name(spark, sf_dir):
    k = F.col("event_id") % 4
    content = F.concat("event_type", F.col("event_id")).cast("binary")
    mime, name = F.when(k == 0, "application/pdf").when(k == 2, "image/png").otherwise("text/plain"), F.when(k == 1, "scan.v2.JPEG").otherwise("scan")
    return table(spark, sf_dir, "events").select("event_id", stored_name(F.sha2(content, 256), mime, name).alias("file_name"))


@query("""SELECT c_custkey, 'a' || chr(2479) || chr(2492) || c_name || chr(2465) || chr(2492) || chr(2325) || chr(2364) || 'é' AS text FROM customer""")
def nukta_decompose(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", decompose(F.concat(F.lit("a\u09df"), F.col("c_name"), F.lit("\u09dc\u0958é"))).alias("text"))


@query("""WITH c AS (SELECT doc_id, text, unnest(range(0, length(text), 500)) AS i FROM documents) SELECT doc_id, CAST(i // 500 AS INT) AS n, substring(text, i + 1, 500) AS chunk FROM c""")
def text_chunks_500(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks(F.col("text"))).alias("n", "chunk"))


@query(r"""WITH c AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents) SELECT doc_id, len(ls) AS n_lines, ls[1] AS first_line, array_to_string(ls, '|') AS all_lines FROM c""")
def text_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", lines(F.col("text")).alias("ls"))
    return d.select("doc_id", F.size("ls").cast("long").alias("n_lines"), F.get("ls", 0).alias("first_line"), F.array_join("ls", "|").alias("all_lines"))


@query(f"""WITH {REGISTER}, p AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)
SELECT id, CASE WHEN toxic = 1 THEN 'again' WHEN quality = 1 THEN 'T' || id ELSE title END AS title, CASE WHEN toxic = 1 THEN 'PENDING' WHEN quality = 0 THEN 'DIGITIZED' ELSE status END AS status, CASE WHEN toxic = 1 THEN NULL WHEN quality = 1 THEN 'D' || id ELSE district END AS district,
CASE WHEN toxic = 1 OR quality = 1 THEN NULL ELSE state END AS state, CASE WHEN toxic = 1 THEN NULL WHEN quality = 0 THEN 4 ELSE length(raw_text) END AS n,
CASE WHEN toxic = 1 THEN '2025-03-01' WHEN quality = 1 THEN '2025-01-01' WHEN quality = 0 THEN '2025-01-02' ELSE strftime(TIMESTAMP '2024-01-01' + to_hours(hour), '%Y-%m-%d') END AS updated
FROM r LEFT JOIN p ON id = doc_id WHERE NOT coalesce(toxic = 1 AND quality = 0, false)""")
def doc_change_log(spark, sf_dir):
    """Documents inserted and compacted; then patched (one patch comes late), read, deleted and inserted again, some of it twice, with a compaction between."""
    log = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    p = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good, bad, toxic = p.filter("quality = 1"), p.filter("quality = 0"), p.filter("toxic = 1")
    when = lambda d, t, n: d.withColumns({"at": F.lit(t).cast("timestamp"), "number": F.lit(n)})
    fields = lambda *names: F.array(*map(F.lit, names))
    add = lambda c: changes.append(log, c, 8)
    add(changes.change(register(spark, sf_dir).withColumns({"at": F.col("created_at"), "number": F.lit(0)}), "insert"))
    changes.compact(spark, log)
    told = when(good, "2025-01-01", 1).select("id", "at", "number", fields("title", "state").alias("set_fields"), F.concat(F.lit("T"), "id").alias("title"))
    read = when(bad, "2025-01-02", 2).select("id", "at", "number", F.lit("read").alias("raw_text"))
    for _ in range(2):
        add(changes.change(told, "patch").unionByName(changes.change(read, "result")))
    add(changes.change(when(toxic, "2025-02-01", 3), "delete"))
    changes.compact(spark, log)
    late = when(good, "2024-12-01", 9).select("id", "at", "number", fields("title", "district").alias("set_fields"), F.lit("late").alias("title"), F.concat(F.lit("D"), "id").alias("district"))
    again = when(toxic.filter("quality = 1"), "2025-03-01", 4).select("id", "at", "number", F.lit("again").alias("title"))
    add(changes.change(late, "patch").unionByName(changes.change(again, "insert")))
    return changes.replayed(spark, log).select("id", "title", "status", "district", "state", F.length("raw_text").alias("n"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))
