"""Pages made of the texts of documents: a character is a pixel wide and as dark as its code point says, a line of text a band of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from terrier.operators import pages
from terrier.operators.images import MOST_SIDE
from terrier.plans.registry import dealt, query, table

#: Columns of text, rows of pixels that are inked of each line of text, and from one line to the next; the gap between two columns of odd documents.
FINE, LINES, COLUMNS, SPACED = (96, 1, 2, 0), (96, 12, 20, 0), (180, 2, 3, 14), (96, 3, 14, 0)
#: What is told of ink, beside its document: the page, and the colour of its first line.
INK = ("sheet", "hue", "sat", "val")


#: Bytes of text that are drawn at a time.
DRAWN = 1 << 20


def _inked(texts: list[str], columns: int):
    """Of some texts' lines, cut to ``columns`` letters: (text, line in it, first letter) of each, and (line, start, end, grey) of each run of ink."""
    cp = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32).astype(np.int32)
    at, feed = np.arange(len(cp), dtype=np.int32), cp == 10
    c = (at - np.maximum.accumulate(np.where(feed, at + 1, 0))) % columns
    fresh = ~feed & (c == 0)
    grey = np.where((cp <= 32) | (cp == 160), pages.PAPER, 24 + cp // 16 % 16 * 12)
    ink = grey != pages.PAPER
    starts = ink & (fresh | (c == columns // 2) | (grey != np.concatenate([[-1], grey[:-1]])))
    ends = ink & np.append(~ink[1:] | starts[1:], True)[: len(cp)]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    lines = np.flatnonzero(fresh)
    text = np.searchsorted(begins, lines, side="right") - 1
    return text, np.arange(len(lines)) - np.searchsorted(lines, begins)[text], cp[lines], np.cumsum(fresh)[starts] - 1, c[starts], c[ends] + 1, grey[starts]


def drawn(spark, sf_dir, columns, band, pitch, gap, coloured=False):
    """(rectangles, sizes) of the pages, rectangles as numbers: an array of a page's, with its width and height, or (``coloured``) of a line's with its colour; a text that is longer than a page goes on on the next. A line's colour is that of its first letter, red to violet for one in three.

    The texts of a document meet in one row before they are drawn, so no shuffle carries ink and a page comes as one row.
    """
    per, half = MOST_SIDE // pitch, columns // 2
    d = dealt(table(spark, sf_dir, "documents").select("doc_id", "text").filter("text is not null"), "doc_id").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))

    def rectangles(batches):
        for batch in batches:
            ids, texts, ends = batch.column(0), batch.column(1).flatten(), batch.column(1).value_lengths().to_numpy().cumsum()
            of, size, at = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), pc.binary_length(texts).to_numpy().cumsum(), 0
            while at < len(ends):
                start = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(size[ends - 1], (size[start - 1] if at else 0) + DRAWN)))
                text, r, first, line, a, b, grey = _inked(texts.slice(start, ends[to - 1] - start).to_pylist(), columns)
                doc, at = of[start:][text], to
                # texts of one document share its pages
                page = np.stack([doc[line], line if coloured else r[line] // per])
                order = np.lexsort(page[::-1])
                page, line, a, b, grey = page[:, order], line[order], a[order], b[order], grey[order]
                odd, starts = np.fmod(ids.fill_null(0).to_numpy()[doc], 2)[line] == 1, np.flatnonzero((np.diff(page, prepend=-1) != 0).any(axis=0))
                if not len(starts):
                    continue
                over, y0 = np.where(odd & (a >= half), gap, 0), r[line].astype(np.int64) % per * pitch
                number = sum(v << n for v, (_, n) in zip((y0, y0 + band, a + over, b + over, grey), pages.BITS, strict=True))
                of_page = line[starts]
                made = (r[of_page] // per, first[of_page] * 7 % 180, np.where(first[of_page] % 3 == 0, 200, 20), np.full(len(starts), 200), np.full(len(starts), columns + gap), np.maximum.reduceat(y0, starts) + band)
                rects = pa.ListArray.from_arrays(pa.array(np.append(starts, len(number)).astype(np.int32)), pa.array(number))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[of_page])), *(pa.array(m.astype(np.int32)) for m in made), rects], ["doc_id", *INK, "width", "height", "rects"])

    ink = d.mapInArrow(rectangles, "doc_id long, " + ", ".join(f"{c} int" for c in (*INK, "width", "height")) + ", rects array<long>")
    if coloured:
        return ink.drop("width", "height"), ink.groupBy("doc_id", "sheet").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    return ink, ink.select("doc_id", "sheet", "width", "height")


def _greys():
    """The greys of a row of pixels as one text; written as JSON, which takes half the time of joining texts."""
    return F.btrim(F.to_json("v"), F.lit("[]")).alias("greys")


def _drawn_sql(columns, band, pitch, gap):
    """The pages pixel by pixel: ``ink``, and ``page`` with its size."""
    per, half = MOST_SIDE // pitch, columns // 2
    return f"""texts AS (SELECT doc_id, regexp_extract_all(text, '[^\\n]{{1,{columns}}}') AS ls FROM documents),
lines AS (SELECT doc_id, ls[r + 1] AS line, r FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS r FROM texts)),
letters AS (SELECT doc_id, r, unicode(line) AS first, c, unicode(substring(line, CAST(c AS INT) + 1, 1)) AS cp FROM (SELECT *, unnest(range(0, length(line))) AS c FROM lines)),
ink AS MATERIALIZED (SELECT doc_id, CAST(r // {per} AS INT) AS sheet, CAST(r % {per} * {pitch} + k AS INT) AS y, CAST(c + CASE WHEN doc_id % 2 = 1 AND c >= {half} THEN {gap} ELSE 0 END AS INT) AS x, 24 + cp // 16 % 16 * 12 AS v, first * 7 % 180 AS hue, CASE WHEN first % 3 = 0 THEN 200 ELSE 20 END AS sat
  FROM letters, range({band}) b(k) WHERE cp > 32 AND cp <> 160),
page AS MATERIALIZED (SELECT doc_id, sheet, max(y) + 1 AS height, {columns + gap} AS width FROM ink GROUP BY ALL)"""


#: Every pixel of every page, paper too.
_DENSE = "dense AS (SELECT g.doc_id, g.sheet, g.y, g.x, coalesce(v, 255) AS v FROM (SELECT doc_id, sheet, y, unnest(range(0, width)) AS x FROM (SELECT *, unnest(range(0, height)) AS y FROM page)) g LEFT JOIN ink i ON g.doc_id = i.doc_id AND g.sheet = i.sheet AND g.y = i.y AND g.x = i.x)"
_OTSU = """bins AS (SELECT doc_id, sheet, v, count(*) AS n FROM {of} GROUP BY ALL),
sums AS (SELECT doc_id, sheet, v, sum(n) OVER upto AS n1, sum(n * v) OVER upto AS s1, sum(n) OVER page AS n, sum(n * v) OVER page AS s FROM bins WINDOW page AS (PARTITION BY doc_id, sheet), upto AS (PARTITION BY doc_id, sheet ORDER BY v ROWS UNBOUNDED PRECEDING)),
apart AS (SELECT doc_id, sheet, v, CASE WHEN n > n1 THEN (n::DOUBLE * s1 - n1::DOUBLE * s) * ((n::DOUBLE * s1 - n1::DOUBLE * s) / (n1::DOUBLE * (n - n1))) ELSE 0 END AS a FROM sums),
cut AS (SELECT doc_id, sheet, v AS threshold FROM apart QUALIFY row_number() OVER (PARTITION BY doc_id, sheet ORDER BY a DESC, v) = 1)"""
_RUNS = "SELECT doc_id, sheet, y, min(x) AS x0, max(x) + 1 AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY doc_id, sheet, y ORDER BY x) AS island FROM {of}) GROUP BY doc_id, sheet, y, island"
#: Regions of the runs in ``runs``, by the smallest run that each is connected with.
_REGIONS = """nodes AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id, sheet, y, x0) AS run FROM runs),
touch AS MATERIALIZED (SELECT a.run AS a, b.run AS b FROM nodes a JOIN nodes b ON a.doc_id = b.doc_id AND a.sheet = b.sheet AND a.y + 1 = b.y AND a.x0 <= b.x1 AND b.x0 <= a.x1),
ways AS MATERIALIZED (SELECT a, b FROM touch UNION ALL SELECT b, a FROM touch),
named(run, label) USING KEY (run) AS (SELECT run, run FROM nodes UNION SELECT w.a, min(n.label) FROM named n JOIN ways w ON n.run = w.b JOIN recurring.named r ON r.run = w.a WHERE n.label < r.label GROUP BY w.a),
regions AS (SELECT doc_id, sheet, label, min(x0) AS x, min(y) AS y, max(x1) - min(x0) AS w, max(y) + 1 - min(y) AS h, sum(x1 - x0) AS pixels FROM nodes JOIN named USING (run) GROUP BY ALL)"""


@query(f"""WITH {_drawn_sql(*FINE)}, {_DENSE},
across AS (SELECT doc_id, sheet, y, x, coalesce(lag(v) OVER w, lead(v) OVER w, v) + 2 * v + coalesce(lead(v) OVER w, lag(v) OVER w, v) AS v FROM dense WINDOW w AS (PARTITION BY doc_id, sheet, y ORDER BY x)),
smooth AS MATERIALIZED (SELECT doc_id, sheet, y, x, (coalesce(lag(v) OVER w, lead(v) OVER w, v) + 2 * v + coalesce(lead(v) OVER w, lag(v) OVER w, v) + 8) // 16 AS v FROM across WINDOW w AS (PARTITION BY doc_id, sheet, x ORDER BY y)),
{_OTSU.format(of='smooth')}, black AS (SELECT doc_id, sheet, y, x FROM smooth JOIN cut USING (doc_id, sheet) WHERE v <= threshold), runs AS ({_RUNS.format(of='black')})
SELECT doc_id, sheet, y, x0, x1, threshold FROM runs JOIN cut USING (doc_id, sheet)""")
def page_black_runs(spark, sf_dir):
    return pages.binarised(*drawn(spark, sf_dir, *FINE))


@query(f"""WITH {_drawn_sql(*FINE)}, {_DENSE},
a AS (SELECT *, max(v) OVER (PARTITION BY doc_id, sheet, y ORDER BY x ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS b FROM dense),
b AS (SELECT * REPLACE (max(b) OVER (PARTITION BY doc_id, sheet, x ORDER BY y ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS b) FROM a),
c AS (SELECT * REPLACE (min(b) OVER (PARTITION BY doc_id, sheet, x ORDER BY y ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS b) FROM b),
d AS (SELECT * REPLACE (min(b) OVER (PARTITION BY doc_id, sheet, y ORDER BY x ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS b) FROM c)
SELECT doc_id, sheet, y, string_agg(CAST(CAST(least(round_even(v * 255 / greatest(b, 1)::DOUBLE, 0), 255) AS INT) AS VARCHAR), ',' ORDER BY x) AS greys FROM d GROUP BY doc_id, sheet, y""")
def page_illumination(spark, sf_dir):
    """Rows of pixels after the background is divided out; a row's greys as one text."""
    return pages.illuminated(*drawn(spark, sf_dir, *FINE)).select("doc_id", "sheet", "y", _greys())


@query(f"""WITH RECURSIVE {_drawn_sql(*FINE)},
mask AS (SELECT DISTINCT doc_id, sheet, y, x FROM ink WHERE sat >= 50 AND (hue BETWEEN 0 AND 15 OR hue BETWEEN 165 AND 180) OR sat >= 40 AND (hue BETWEEN 130 AND 165 OR hue BETWEEN 90 AND 130 OR hue BETWEEN 35 AND 85)),
wide AS (SELECT DISTINCT doc_id, sheet, y, x + d AS x FROM mask, range(-3, 4) t(d)),
grown AS MATERIALIZED (SELECT DISTINCT w.doc_id, w.sheet, w.y + d AS y, x, height, width FROM wide w JOIN page USING (doc_id, sheet), range(-3, 4) t(d) WHERE w.y + d BETWEEN 0 AND height - 1 AND x BETWEEN 0 AND width - 1),
beside AS (SELECT doc_id, sheet, y, x, height FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, sheet, y ORDER BY x RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM grown) WHERE n = least(x + 3, width - 1) - greatest(x - 3, 0) + 1),
closed AS (SELECT doc_id, sheet, y, x FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, sheet, x ORDER BY y RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM beside) WHERE n = least(y + 3, height - 1) - greatest(y - 3, 0) + 1),
runs AS ({_RUNS.format(of='closed')}), {_REGIONS}
SELECT doc_id, sheet, count(label) AS stamps FROM page LEFT JOIN (SELECT * FROM regions WHERE pixels > 300) r USING (doc_id, sheet) GROUP BY doc_id, sheet""")
def page_stamps(spark, sf_dir):
    return pages.stamps(*drawn(spark, sf_dir, *FINE, coloured=True))


#: Bands stay apart after they are widened, so in SQL a line is an island along its band.
@query(f"""WITH {_drawn_sql(*LINES)}, areas AS (SELECT doc_id, sheet, v FROM ink UNION ALL SELECT doc_id, sheet, 255 FROM (SELECT doc_id, sheet, unnest(range(0, width * height - n)) FROM page JOIN (SELECT doc_id, sheet, count(*) AS n FROM ink GROUP BY ALL) USING (doc_id, sheet))),
{_OTSU.format(of='areas')},
black AS (SELECT DISTINCT doc_id, sheet, y // 20 * 20 AS y, x FROM ink JOIN cut USING (doc_id, sheet) WHERE v <= threshold),
wide AS (SELECT DISTINCT doc_id, sheet, y, x + d AS x FROM black JOIN page USING (doc_id, sheet), range(-2, 5) t(d) WHERE x + d BETWEEN 0 AND width - 1),
islands AS ({_RUNS.format(of='wide')}),
regions AS (SELECT doc_id, sheet, x0 AS x, greatest(y - 2, 0) AS y, x1 - x0 AS w, least(y + 14, height) - greatest(y - 2, 0) AS h FROM islands JOIN page USING (doc_id, sheet)),
boxes AS (SELECT doc_id, sheet, row_number() OVER (PARTITION BY doc_id, sheet ORDER BY r.y, r.x) AS line, greatest(r.x - 5, 0) AS x, greatest(r.y - 5, 0) AS y, w, h, p.width, p.height FROM regions r JOIN page p USING (doc_id, sheet) WHERE w > p.width * 0.15 AND h > 15)
SELECT doc_id, sheet, CAST(line AS INT) AS line, x, y, least(width - x, w + 10) AS width, least(height - y, h + 10) AS height FROM boxes""")
def page_lines(spark, sf_dir):
    return pages.text_lines(*drawn(spark, sf_dir, *LINES))


def _layout_sql():
    taps = [f"{2.718281828459045 ** (-0.5 * (k / 10) ** 2)!r}" for k in range(-15, 16)]
    total = repr(sum(2.718281828459045 ** (-0.5 * (k / 10) ** 2) for k in range(-15, 16)))
    terms = " + ".join(f"p[CASE WHEN i + {k - 15} < 0 THEN -(i + {k - 15}) WHEN i + {k - 15} > len(p) - 1 THEN 2 * (len(p) - 1) - (i + {k - 15}) ELSE i + {k - 15} END + 1] * ({t}::DOUBLE / {total}::DOUBLE)" for k, t in enumerate(taps))
    return f"""WITH {_drawn_sql(*COLUMNS)},
bands AS (SELECT doc_id, sheet, width, height, CAST(floor(height * 0.15) AS INT) AS a, CAST(floor(height * 0.35) AS INT) AS b FROM page),
rows_ AS (SELECT doc_id, sheet, unnest(CASE WHEN b > a THEN range(a, b) ELSE [a] END) AS y FROM bands),
across AS (SELECT doc_id, sheet, y, sum(255 - v) AS ink FROM ink GROUP BY ALL),
tops AS (SELECT doc_id, sheet, y AS top FROM rows_ LEFT JOIN across USING (doc_id, sheet, y) QUALIFY row_number() OVER (PARTITION BY doc_id, sheet ORDER BY coalesce(ink, 0), y) = 1),
down AS (SELECT doc_id, sheet, x, sum(255 - v) AS ink FROM ink JOIN tops USING (doc_id, sheet) WHERE y >= top GROUP BY doc_id, sheet, x),
mid AS (SELECT doc_id, sheet, CAST(floor(width * 0.35) AS INT) AS a, unnest(range(CAST(floor(width * 0.35) AS INT), CAST(floor(width * 0.65) AS INT))) AS x FROM page),
profile AS (SELECT doc_id, sheet, a, list(CAST(coalesce(ink, 0) AS DOUBLE) ORDER BY x) AS p FROM mid LEFT JOIN down USING (doc_id, sheet, x) GROUP BY ALL),
smooth AS (SELECT doc_id, sheet, a, list_transform(range(0, len(p)), lambda i: {terms}) AS s FROM profile),
cut AS (SELECT doc_id, sheet, CASE WHEN list_min(s) < 0.65 * (list_reduce(s, lambda t, x: t + x) / len(s)) THEN a + list_position(s, list_min(s)) - 1 END AS gutter FROM smooth),
all_ AS (SELECT * FROM page JOIN tops USING (doc_id, sheet) LEFT JOIN cut USING (doc_id, sheet))
SELECT doc_id, sheet, 'header' AS region_type, 0 AS ord, 0 AS x, 0 AS y, width, top AS height FROM all_
UNION ALL SELECT doc_id, sheet, 'column', 1, 0, top, coalesce(gutter, width), height - top FROM all_
UNION ALL SELECT doc_id, sheet, 'column', 2, gutter, top, width - gutter, height - top FROM all_ WHERE gutter IS NOT NULL"""


@query(_layout_sql())
def page_layout(spark, sf_dir):
    return pages.layout(*drawn(spark, sf_dir, *COLUMNS))


@query(f"""WITH {_drawn_sql(*FINE)}, {_DENSE},
whole AS (SELECT *, CASE WHEN even THEN width ELSE width + 8 - width % 8 END AS w2, CASE WHEN even THEN height ELSE height + 8 - height % 8 END AS h2 FROM (SELECT *, width % 8 = 0 AND height % 8 = 0 AS even FROM page)),
tiled AS (SELECT *, w2 // 8 AS tw, h2 // 8 AS th, 2 * width - 2 AS pw, greatest(2 * height - 2, 1) AS ph FROM whole),
grid AS (SELECT doc_id, sheet, y, width, height, tw, th, pw, ph, unnest(range(0, w2)) AS x FROM (SELECT *, unnest(range(0, h2)) AS y FROM tiled)),
cells AS (SELECT g.doc_id, g.sheet, g.y // th AS ty, g.x // tw AS tx, v FROM grid g JOIN dense d ON g.doc_id = d.doc_id AND g.sheet = d.sheet AND d.y = CASE WHEN g.y % ph < height THEN g.y % ph ELSE ph - g.y % ph END AND d.x = CASE WHEN g.x % pw < width THEN g.x % pw ELSE pw - g.x % pw END),
bins AS MATERIALIZED (SELECT doc_id, sheet, ty, tx, v, count(*) AS n FROM cells GROUP BY ALL),
greys AS (SELECT DISTINCT doc_id, sheet, v AS g FROM bins),
limits AS (SELECT *, tw * th AS total, greatest(tw * th * 2 // 256, 1) AS most FROM tiled),
over AS (SELECT doc_id, sheet, ty, tx, any_value(total) AS total, sum(greatest(n - most, 0)) AS excess FROM bins JOIN limits USING (doc_id, sheet) GROUP BY ALL),
upto AS (SELECT o.doc_id, o.sheet, o.ty, o.tx, g, any_value(total) AS total, any_value(excess) AS excess, sum(CASE WHEN b.v <= g THEN least(b.n, most) ELSE 0 END) AS c FROM over o JOIN greys USING (doc_id, sheet) JOIN bins b ON b.doc_id = o.doc_id AND b.sheet = o.sheet AND b.ty = o.ty AND b.tx = o.tx JOIN (SELECT doc_id, sheet, most FROM limits) m ON m.doc_id = o.doc_id AND m.sheet = o.sheet GROUP BY ALL),
becomes AS MATERIALIZED (SELECT doc_id, sheet, ty, tx, g, least(round_even((c + excess // 256 * (g + 1) + CASE WHEN excess % 256 > 0 THEN least(excess % 256, g // greatest(256 // (excess % 256), 1) + 1) ELSE 0 END) * 255 / total::DOUBLE, 0), 255) AS t FROM upto),
placed AS (SELECT d.doc_id, d.sheet, d.y, d.x, d.v, d.y / th::DOUBLE - 0.5 AS fy, d.x / tw::DOUBLE - 0.5 AS fx FROM dense d JOIN tiled USING (doc_id, sheet)),
round_ AS (SELECT *, CAST(greatest(floor(fy), 0) AS INT) AS y1, CAST(least(floor(fy) + 1, 7) AS INT) AS y2, CAST(greatest(floor(fx), 0) AS INT) AS x1, CAST(least(floor(fx) + 1, 7) AS INT) AS x2, fy - floor(fy) AS b, fx - floor(fx) AS a FROM placed),
blended AS (SELECT p.doc_id, p.sheet, p.y, p.x, round_even((t11.t * (1 - a) + t12.t * a) * (1 - b) + (t21.t * (1 - a) + t22.t * a) * b, 0) AS v FROM round_ p
  JOIN becomes t11 ON t11.doc_id = p.doc_id AND t11.sheet = p.sheet AND t11.ty = y1 AND t11.tx = x1 AND t11.g = p.v JOIN becomes t12 ON t12.doc_id = p.doc_id AND t12.sheet = p.sheet AND t12.ty = y1 AND t12.tx = x2 AND t12.g = p.v
  JOIN becomes t21 ON t21.doc_id = p.doc_id AND t21.sheet = p.sheet AND t21.ty = y2 AND t21.tx = x1 AND t21.g = p.v JOIN becomes t22 ON t22.doc_id = p.doc_id AND t22.sheet = p.sheet AND t22.ty = y2 AND t22.tx = x2 AND t22.g = p.v)
SELECT doc_id, sheet, y, string_agg(CAST(CAST(v AS INT) AS VARCHAR), ',' ORDER BY x) AS greys FROM blended GROUP BY doc_id, sheet, y""")
def page_contrast(spark, sf_dir):
    """Rows of pixels after local equalisation; a row's greys as one text."""
    return pages.contrasted(*drawn(spark, sf_dir, *FINE)).select("doc_id", "sheet", "y", _greys())


def _skew_sql():
    chain = lambda of, sign: f"list_reduce({of}, lambda s, r: list_concat(list_transform(list_filter(range(1, len(s) + 1), lambda i: i = 1 OR {sign} * ((s[i].x - s[i - 1].x) * (r[1].y - s[i - 1].y) - (s[i].y - s[i - 1].y) * (r[1].x - s[i - 1].x)) < 0), lambda i: s[i]), r))"
    return f"""WITH RECURSIVE {_drawn_sql(*SPACED)}, areas AS (SELECT doc_id, sheet, v FROM ink UNION ALL SELECT doc_id, sheet, 255 FROM (SELECT doc_id, sheet, unnest(range(0, width * height - n)) FROM page JOIN (SELECT doc_id, sheet, count(*) AS n FROM ink GROUP BY ALL) USING (doc_id, sheet))),
{_OTSU.format(of='areas')},
black AS (SELECT DISTINCT doc_id, sheet, y, x FROM ink JOIN cut USING (doc_id, sheet) WHERE v <= threshold),
narrow AS ({_RUNS.format(of='black')}),
grown AS (SELECT doc_id, sheet, greatest(x0 - 34, 0) AS x0, least(x1 + 34, width) AS x1, unnest(range(greatest(y - 2, 0), least(y + 3, height))) AS y FROM narrow JOIN page USING (doc_id, sheet)),
marked AS (SELECT *, CASE WHEN x0 > max(x1) OVER (PARTITION BY doc_id, sheet, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM grown),
runs AS (SELECT doc_id, sheet, y, min(x0) AS x0, max(x1) AS x1 FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, sheet, y ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS island FROM marked) GROUP BY doc_id, sheet, y, island), {_REGIONS},
edges AS (SELECT doc_id, sheet, label, y, min(x0) AS a, max(x1) - 1 AS b, sum(x1 - x0) AS n FROM nodes JOIN named USING (run) GROUP BY ALL),
sides AS (SELECT doc_id, sheet, label, sum(n) AS pixels, list([{{'x': a, 'y': y}}] ORDER BY y) AS ls, list([{{'x': b, 'y': y}}] ORDER BY y) AS rs FROM edges GROUP BY ALL),
shapes AS (SELECT doc_id, sheet, label, list_concat({chain('ls', 1)}, list_reverse({chain('rs', -1)})) AS hull FROM sides WHERE pixels > 200),
dirs AS (SELECT DISTINCT doc_id, sheet, label, hull, hull[i % len(hull) + 1].x - hull[i].x AS x, hull[i % len(hull) + 1].y - hull[i].y AS y FROM (SELECT *, unnest(range(1, len(hull) + 1)) AS i FROM shapes)),
turned AS (SELECT doc_id, sheet, label, hull, CASE WHEN x >= 0 AND y > 0 THEN x WHEN y <= 0 AND x > 0 THEN -y WHEN x <= 0 AND y < 0 THEN -x ELSE y END AS dx, CASE WHEN x >= 0 AND y > 0 THEN y WHEN y <= 0 AND x > 0 THEN x WHEN x <= 0 AND y < 0 THEN -y ELSE -x END AS dy FROM dirs WHERE x <> 0 OR y <> 0),
boxes AS (SELECT *, list_max(list_transform(hull, lambda p: p.x * dx + p.y * dy)) - list_min(list_transform(hull, lambda p: p.x * dx + p.y * dy)) AS w, list_max(list_transform(hull, lambda p: p.y * dx - p.x * dy)) - list_min(list_transform(hull, lambda p: p.y * dx - p.x * dy)) AS h FROM turned),
best AS (SELECT *, degrees(atan2(dy, dx)) + CASE WHEN w < h THEN 90 ELSE 0 END AS angle FROM boxes QUALIFY row_number() OVER (PARTITION BY doc_id, sheet, label ORDER BY w::DOUBLE * h / (dx * dx + dy * dy), atan2(dy, dx)) = 1),
middle AS (SELECT doc_id, sheet, median(CASE WHEN angle > 45 THEN angle - 180 ELSE angle END) AS angle FROM best GROUP BY doc_id, sheet)
SELECT doc_id, sheet, round(CASE WHEN abs(angle) >= 0.2 THEN angle ELSE 0 END, 6) AS angle FROM page LEFT JOIN middle USING (doc_id, sheet)"""


@query(_skew_sql())
def page_skew(spark, sf_dir):
    return pages.skew_angles(*drawn(spark, sf_dir, *SPACED)).withColumn("angle", F.round("angle", 6))
