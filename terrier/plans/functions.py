"""Queries written in SQL with the rules as SQL functions."""

from __future__ import annotations

from terrier.functions import sql
from terrier.plans.deeds import BENGALI, _script_sql
from terrier.plans.registry import query, spread, table


def _asked(spark, text: str, **tables):
    sql.register(spark)
    return spark.sql(text, **tables)


@query("SELECT l_orderkey, l_linenumber, 'দাগ ' || l_orderkey AS plot, strftime(l_shipdate, '%Y-%m-%d') AS shipped, CAST(CAST(l_quantity AS INT) AS DOUBLE) AS area, round(CAST(l_quantity AS INT) * CAST(1333.33 AS DOUBLE), 2) AS sq_meters FROM lineitem")
def sql_numerals_dates_areas(spark, sf_dir):
    items = spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")
    return _asked(
        spark,
        f"""SELECT l_orderkey, l_linenumber, fold_numerals(concat('দাগ ', translate(cast(l_orderkey AS STRING), '0123456789', '{BENGALI}'))) AS plot,
        parse_date(date_format(l_shipdate, 'd MMMM, yyyy')).iso AS shipped, area.value AS area, area.sq_meters AS sq_meters
        FROM (SELECT *, parse_area(concat(cast(l_quantity AS INT), ' বিঘা'), 'West Bengal') AS area FROM {{items}})""",
        items=items,
    )


@query(f"WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {_script_sql('t')} SELECT script, lang AS told_lang, count(*) AS n, min(script_confidence) AS least FROM told GROUP BY script, lang")
def sql_script_counts(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return _asked(spark, "SELECT s.script, s.lang AS told_lang, count(*) AS n, min(s.confidence) AS least FROM (SELECT script_of(text) AS s FROM {docs}) GROUP BY ALL", docs=docs)


@query(r"""WITH ls AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents)
SELECT doc_id, CAST(unnest(range(len(ls))) AS INT) AS pos, unnest(ls) AS line FROM ls""")
def sql_deed_lines(spark, sf_dir):
    """The table function, joined laterally to every document."""
    return _asked(spark, "SELECT doc_id, pos, line FROM {docs}, LATERAL deed_lines(text, lang)", docs=table(spark, sf_dir, "documents"))


@query("""SELECT o_orderkey, o_orderkey || '/' || o_custkey AS survey, 'Clerk ' || o_custkey AS owner, o_orderpriority AS guardian, CASE WHEN o_custkey > 0 THEN o_custkey * 10000.0::DOUBLE END AS sq_meters, strftime(o_orderdate, '%Y-%m-%d') AS registered, NULL::VARCHAR AS issued, 'Town ' || o_custkey AS village FROM orders""")
def sql_deed_fields(spark, sf_dir):
    """Deeds of orders, every field by one function."""
    orders = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    return _asked(
        spark,
        r"""SELECT o_orderkey, f.survey.value AS survey, f.owner.name AS owner, f.owner.guardian AS guardian, f.area.area.sq_meters AS sq_meters, f.registered.iso AS registered, f.issued.iso AS issued, f.village AS village
        FROM (SELECT o_orderkey, deed_fields(concat('Plot No: ', o_orderkey, '/', o_custkey, '\nOwner Name: Clerk ', o_custkey, ' S/O ', o_orderpriority, '\nExtent: ', o_custkey, ' hectares\nMouza: Town ', o_custkey, '\nRegistered on ', date_format(o_orderdate, 'dd.MM.yyyy')), 'en', NULL) AS f FROM {orders})""",
        orders=orders,
    )
