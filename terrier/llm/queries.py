"""The registered queries of the training-data operations, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrier.llm import decontaminate, language, mixing, periods, pii, quality, secrets, sharding, simhash, substrings, toxicity, trie, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filtered(_table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substrings.without_repeats(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.periodic(periods.with_planted_runs(_table(spark, sf_dir, "documents"))))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(_table(spark, sf_dir, "conversations"))).drop("node")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_secrets": op2_secrets,
    "op3_decontaminate": op3_decontaminate,
    "op4_urls": op4_urls,
    "op5_pii": op5_pii,
    "op6_simhash": op6_simhash,
    "op7_mixing": op7_mixing,
    "op8_sharding": op8_sharding,
    "op9_language": op9_language,
    "op10_quality": op10_quality,
    "op11_substrings": op11_substrings,
    "op12_periods": op12_periods,
    "op13_trie": op13_trie,
}

_WORDS_OF = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

#: Windows by list slices; runs of windows on a diagonal, as gaps and islands, are the longest matches.
ORACLES: dict[str, str] = {
    "op3_decontaminate": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS_OF} AS w FROM documents),
b AS (SELECT row_number() OVER () AS ir, CAST(item_id AS VARCHAR) AS item, {_WORDS_OF} AS w FROM benchmark),
starts AS (SELECT ir, item, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS j FROM b WHERE len(w) > 0),
windows AS MATERIALIZED (SELECT ir, item, k, j, array_to_string(w[j:j + k - 1], ' ') AS g FROM starts),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= k),
found AS MATERIALIZED (SELECT p.r, p.i, p.k, s.ir, s.item, s.j FROM (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM places) p JOIN windows s ON p.k = s.k AND p.g = s.g),
hit AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS spot FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "C") AS listed FROM (SELECT DISTINCT r, item FROM found) GROUP BY r),
islands AS (SELECT r, ir, item, i, j, k, i - row_number() OVER (PARTITION BY r, ir, k, i - j ORDER BY i) AS island FROM found),
runs AS (SELECT r, item, min(i) AS i, min(j) AS j, count(*) + k - 1 AS n FROM islands GROUP BY r, ir, item, k, i - j, island),
longest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY n DESC, i, item IS NULL, item COLLATE "C", j) = 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n, 0) AS BIGINT) AS match_words, CAST(i - 1 AS BIGINT) AS match_word, item AS match_item, CAST(j - 1 AS BIGINT) AS match_item_word
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r) LEFT JOIN longest USING (r)
""",
}


def _quality_sql() -> str:
    """The quality rules in DuckDB: the same counts from lists, the same sums and distances."""
    q = quality
    lists = " ".join(f"WHEN {k!r} THEN {ws!r}" for k, ws in q.COMMON_WORDS.items())
    left = ["array_to_string(w, '')"]
    for c in q.CLASSES:
        left.append(f"regexp_replace({left[-1]}, '{c}', '', 'g')")
    classes = [f"length({a}) - length({b})" for a, b in zip(left, left[1:], strict=False)] + [f"length({left[-1]})"]

    def distance(p: str, r: str, n: int) -> str:
        terms = []
        for i in range(1, n + 1):
            a, b = f"{p}[{i}] / greatest(list_sum({p}), 1.0)", f"{r}[{i}] / greatest(list_sum({r}), 1.0)"
            terms += [f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({a} + {b}) / 2)) ELSE 0.0 END" for x in (f"({a})", f"({b})")]
        return f"sqrt(greatest(({' + '.join(terms)}) / 2, 0.0))"

    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
lined AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
spots AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d),
grams AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS n FROM spots),
repeats AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE n > 1) GROUP BY r),
words AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(w) AS word FROM d WHERE coalesce(lang NOT IN ({', '.join(repr(k) for k in q.COMMON_WORDS)}), true)) GROUP BY ALL),
learned AS (SELECT lang AS own, list(word ORDER BY i) AS learned FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS i FROM words) WHERE i < {q.N_WORDS} GROUP BY lang),
listed AS (SELECT r, doc_id, lang, w, CASE lang {lists} ELSE coalesce(learned, CAST([] AS VARCHAR[])) END AS k FROM d LEFT JOIN learned ON lang IS NOT DISTINCT FROM own),
counted AS (SELECT r, doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, [{', '.join(f'CAST({c} AS DOUBLE)' for c in classes)}] AS c,
  list_transform(k, lambda x: CAST(len(list_filter(w, lambda y: y = x)) AS DOUBLE)) AS o FROM listed),
commons AS (SELECT *, list_append(list_resize(o, {q.N_WORDS - 1}, 0.0), n_words - coalesce(list_sum(o), 0)) AS m FROM counted),
based AS (SELECT commons.*, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, n_words < {q.MIN_WORDS} OR 100 * coalesce(repeats.n, 0) > {q.MOST_REPEATED} * n_words AS base_failed
  FROM commons JOIN lined USING (r) LEFT JOIN repeats USING (r)),
refs AS (SELECT lang AS ref_lang, [{', '.join(f'sum(c[{i}])' for i in range(1, q.N_CLASSES + 1))}] AS rc, [{', '.join(f'sum(m[{i}])' for i in range(1, q.N_WORDS + 1))}] AS rm FROM based WHERE NOT base_failed GROUP BY lang),
failed AS (SELECT doc_id, n_words, word_chars, CAST(c[{q.SYMBOLS_AT + 1}] AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN rc IS NULL THEN 0.0 ELSE {distance('c', 'rc', q.N_CLASSES)} END AS cd, CASE WHEN rm IS NULL THEN 0.0 ELSE {distance('m', 'rm', q.N_WORDS)} END AS wd
  FROM based LEFT JOIN refs ON lang IS NOT DISTINCT FROM ref_lang)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= {q.LEAST_WORDS_FOR_CLASSES} AND cd > {q.MOST_CLASS_DISTANCE}) AND NOT (n_words >= {q.LEAST_WORDS_FOR_WORDS} AND wd > {q.MOST_WORD_DISTANCE}) AS kept,
  round(cd, 4) AS class_distance, round(wd, 4) AS word_distance
FROM failed
"""


ORACLES["op10_quality"] = _quality_sql()


def _urls_sql() -> str:
    """The URL filters in DuckDB: the same edges, ``rounds`` rounds unrolled. The given pages' links are all relative, so ranks are settled after the first."""
    u, rounds_unrolled = urls, 12
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def parts(url: str) -> tuple[str, str]:
        rest = f"substring({url}, instr({url}, '://') + 3)"
        has = f"coalesce(instr({url}, '://'), 0) > 0"
        return f"CASE WHEN {has} THEN {lower.format(f"regexp_extract({rest}, '^[^/?#]*')")} ELSE '' END", f"CASE WHEN {has} THEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END"

    host, path = parts("url")
    link_host, _ = parts("(':' || link)")
    rules = sorted(u.RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for h, p, _ in rules]
    rule = "CASE " + " ".join(f"{f} '{h + p}'" for f, (h, p, _) in zip(fits, rules, strict=True)) + " END"
    verdict = "CASE " + " ".join(f"{f} '{v}'" for f, (_, _, v) in zip(fits, rules, strict=True)) + " END"
    rounds = "".join(
        f""", r{i} AS MATERIALIZED (SELECT s.kind, s.host, {u.DAMPING} * coalesce(g.got, 0) + {round(1 - u.DAMPING, 10)} * s.start AS rank FROM s LEFT JOIN
        (SELECT r.kind, w.dst AS host, sum(r.rank * w.share) AS got FROM {f'r{i - 1}' if i > 1 else '(SELECT kind, host, start AS rank FROM s)'} r JOIN w ON r.kind = w.kind AND r.host = w.src GROUP BY ALL) g ON s.kind = g.kind AND s.host = g.host)"""
        for i in range(1, rounds_unrolled + 1)
    )
    return rf"""
WITH p AS MATERIALIZED (SELECT page_id, {host} AS host, {path} AS path, html FROM pages),
d AS MATERIALIZED (SELECT page_id, host, path, {rule} AS rule, {verdict} AS ruled FROM p),
found AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?(?:[a-z]+:)?(//[^\s"''<>]+)', 1)) AS link FROM p),
linked AS (SELECT src, {link_host} AS dst FROM found),
hosts AS (SELECT DISTINCT host FROM p WHERE host <> ''),
e AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM linked WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL),
nodes AS (SELECT host FROM hosts UNION SELECT src FROM e UNION SELECT dst FROM e),
seeds AS (SELECT 'trust' AS kind, host, (SELECT count(*) FROM d WHERE d.host = nodes.host AND ruled = 'allow') AS seed FROM nodes UNION ALL SELECT 'distrust', host, (SELECT count(*) FROM d WHERE d.host = nodes.host AND ruled = 'block') FROM nodes),
s AS MATERIALIZED (SELECT kind, host, CAST(seed AS DOUBLE) / greatest(sum(seed) OVER (PARTITION BY kind), 1) AS start FROM seeds),
ways AS (SELECT 'trust' AS kind, src, dst, n FROM e UNION ALL SELECT 'distrust', dst, src, n FROM e),
w AS MATERIALIZED (SELECT kind, src, dst, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY kind, src) AS share FROM ways){rounds},
scaled AS (SELECT kind, host, rank / CASE WHEN sum(rank) OVER (PARTITION BY kind) = 0 THEN 1.0 ELSE sum(rank) OVER (PARTITION BY kind) END * (SELECT count(*) FROM nodes) AS rank FROM r{rounds_unrolled}),
scores AS (SELECT host, round(sum(rank) FILTER (WHERE kind = 'trust'), 6) AS trust, round(sum(rank) FILTER (WHERE kind = 'distrust'), 6) AS distrust FROM scaled GROUP BY host)
SELECT page_id, d.host, path, rule, coalesce(ruled, CASE WHEN distrust > trust AND distrust > {u.LEAST_DISTRUST} THEN 'block' ELSE 'allow' END) AS verdict, coalesce(trust, 0.0) AS trust, coalesce(distrust, 0.0) AS distrust
FROM d LEFT JOIN scores ON d.host = scores.host
"""


#: CRC-32 byte by byte from its table, which DuckDB builds from the polynomial.
_CRC_TABLE = """RECURSIVE steps AS (SELECT i AS b, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8)"""
_SHARDS_SQL = f"""
WITH {_CRC_TABLE},
body AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS x FROM documents),
hexes AS (SELECT r, doc_id, octet_length(x) + 1 AS size, list_transform(regexp_extract_all(hex(x), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bs FROM body),
sums AS (SELECT doc_id, size, xor(list_reduce(bs, lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1]), 4294967295), 4294967295) AS text_crc32 FROM hexes, crc),
laid AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) AS i FROM sums),
cut AS (SELECT *, CAST((2 * start + size) * {sharding.SHARDS} // (2 * total) AS INT) AS shard FROM laid)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, CAST(i - min(i) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM cut
"""

ORACLES |= {"op4_urls": _urls_sql(), "op8_sharding": _SHARDS_SQL}


def _crc_sql(value: str) -> str:
    """The checksum of a number in decimal, beside the table ``crc``."""
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(CAST({value} AS VARCHAR))), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295)"


#: On each diagonal the islands of equal 5-grams are the stretches that agree; of the periods of one stretch the smallest counts.
_PERIODS_SQL = f"""
WITH {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_crc_sql('doc_id')}, 1) AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS o FROM documents, crc),
laid AS (SELECT *, len(o) AS n, h // 10 AS g, CASE WHEN len(o) > 0 THEN (h // 10) % len(o) END AS a FROM d),
dealt AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM laid),
t AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: o[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE o END AS w FROM dealt),
grams AS (SELECT r, n, i, array_to_string(w[i + 1:i + 5], ' ') AS x FROM (SELECT r, n, w, unnest(range(0, n - 4)) AS i FROM t WHERE n >= 6)),
pairs AS (SELECT a.r, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.r = b.r AND a.x = b.x AND b.i > a.i AND b.i - a.i <= a.n // 4),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT r, q, min(i) AS s, count(*) + 4 + q AS n FROM islands GROUP BY r, q, island),
runs AS MATERIALIZED (SELECT r, s, n, min(q) AS q FROM stretches WHERE n >= greatest(6, 4 * q) GROUP BY r, s, n),
told AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY n / q::DOUBLE DESC, s, q) = 1),
gone AS (SELECT r, list(DISTINCT i) AS i FROM (SELECT r, unnest(range(s + q, s + n)) AS i FROM runs) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(s AS BIGINT) AS start, CAST(best.n AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period, CAST(1000 * best.n // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN gone.i IS NULL THEN w ELSE list_transform(list_filter(range(0, t.n), lambda k: NOT list_contains(gone.i, k)), lambda k: w[k + 1]) END, ' ')) AS collapsed_sha256
FROM t LEFT JOIN told USING (r) LEFT JOIN best USING (r) LEFT JOIN gone USING (r)
"""

#: The smallest id of every window, then the places that windows of a smaller one cover. A null id ranks last.
_SUBSTRINGS_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS MATERIALIZED (SELECT r, id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT r, id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
firsts AS (SELECT g, min(id) AS least FROM windows GROUP BY g),
gone AS (SELECT r, list(DISTINCT k) AS ks FROM (SELECT r, unnest(range(i, i + 50)) AS k FROM windows JOIN firsts USING (g) WHERE least < id) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ks IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(ks, k)), lambda k: w[k]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""

#: A node is the string of its turns' digests; each node is put under all its prefixes for what subtrees hold.
_TRIE_SQL = f"""
WITH {_CRC_TABLE},
said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT conv_id, turn, sha256(length(role) || ':' || role || text) AS id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM said),
words AS (SELECT id, any_value(words) AS words FROM turns GROUP BY id),
own AS (SELECT conv_id, list(id ORDER BY turn NULLS FIRST, id) AS ids FROM turns GROUP BY conv_id),
dealt AS (SELECT own.*, {_crc_sql('conv_id')} % 4 AS h FROM own, crc),
rebuilt AS MATERIALIZED (SELECT d.conv_id, coalesce(list_slice(b.ids, 1, CAST(h AS INT)), CAST([] AS VARCHAR[])) || list_slice(d.ids, CAST(h AS INT) + 1, len(d.ids)) AS ids FROM dealt d LEFT JOIN own b ON b.conv_id = d.conv_id - d.conv_id % 20),
prefixes AS (SELECT conv_id, d AS depth, array_to_string(list_slice(ids, 1, d), '') AS key, CASE WHEN d > 0 THEN array_to_string(list_slice(ids, 1, d - 1), '') END AS parent, CASE WHEN d > 0 THEN ids[d] END AS last FROM (SELECT conv_id, ids, unnest(range(0, len(ids) + 1)) AS d FROM rebuilt)),
nodes AS MATERIALIZED (SELECT key, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(last) AS last FROM prefixes GROUP BY key),
below AS (SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
each AS (SELECT nodes.*, coalesce(below.n, 0) AS n_children, (n_convs - 1) * coalesce(words, 0) AS saved FROM nodes LEFT JOIN below ON below.parent = nodes.key LEFT JOIN words ON words.id = last),
sums AS (SELECT left(key, 64 * d) AS key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM each) GROUP BY ALL),
ends AS (SELECT array_to_string(ids, '') AS key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS listed FROM rebuilt GROUP BY ALL)
SELECT each.conv_id, each.depth, up.conv_id AS parent_conv_id, each.n_convs, n_children, n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(coalesce(listed, '')) AS ends_sha256
FROM each JOIN sums USING (key) LEFT JOIN nodes up ON up.key = each.parent LEFT JOIN ends ON ends.key = each.key
"""

ORACLES |= {"op13_trie": _TRIE_SQL, "op11_substrings": _SUBSTRINGS_SQL, "op12_periods": _PERIODS_SQL}
