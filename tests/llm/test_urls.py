import re

import pytest

from terrier.llm import urls

DIR = "/root/testdata/sf0.001"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return low, re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path):
    fit = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def plain_rank(hosts, edges, seed):
    total = sum(seed.values()) or 1
    start = {h: seed.get(h, 0) / total for h in hosts}
    out = {}
    for (a, _), n in edges.items():
        out[a] = out.get(a, 0) + n
    rank = dict(start)
    for _ in range(200):
        got = dict.fromkeys(hosts, 0.0)
        for (a, b), n in edges.items():
            got[b] += rank[a] * n / out[a]
        rank = {h: 0.85 * got[h] + 0.15 * start[h] for h in hosts}
    scale = sum(rank.values()) or 1
    return {h: r / scale for h, r in rank.items()}


def plain(pages):
    parts = [(*p[:1], *plain_parts(p[1]), p[2] or "") for p in pages]
    edges, own = {}, {p[1] for p in parts if p[1]}
    for _, host, _, html in parts:
        for link in re.findall(r"""(?i)href\s*=\s*["']?(?:[a-z]+:)?(//[^\s"'<>]+)""", html):
            to = plain_parts(":" + link)[0]
            if host and to and to != host:
                edges[host, to] = edges.get((host, to), 0) + 1
    hosts = own | {b for _, b in edges}
    good, bad = {}, {}
    for _, host, path, _ in parts:
        if host and (v := plain_rule(host, path)[1]):
            d = good if v == "allow" else bad
            d[host] = d.get(host, 0) + 1
    t = plain_rank(hosts, edges, good)
    d = plain_rank(hosts, {(b, a): n for (a, b), n in edges.items()}, bad)
    out = []
    for page, host, path, _ in parts:
        rule, v = plain_rule(host, path)
        x, y = t.get(host, 0) * len(hosts), d.get(host, 0) * len(hosts)
        out.append((page, host, path, rule, v or ("block" if y > x and y > urls.LEAST_DISTRUST else "allow"), pytest.approx(x, abs=2e-5), pytest.approx(y, abs=2e-5)))
    return out


def held(spark, pages, frame):
    got = sorted(map(tuple, urls.filtered(frame).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = sorted(plain(pages), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert got == want


def test_links_and_odd_urls(spark):
    pages = [
        (1, "http://A.Example.COM/en/7x?q=1#f", '<a href="https://b.org/es/1">x</a> <a href="//c.net/">y</a>'),
        (2, "https://b.org/es/9", "<a HREF='http://a.example.com/en/1'>z</a>"),
        (3, "https://spam.com/en/", '<a href="/local">l</a><a href="http://b.org">l</a>'),
        (4, "https://farm.io/x", '<a href="http://spam.com/en/2">1</a><a href=http://spam.com/en/3>2</a>'),
        (5, "https://c.net/de/1", '<a href="http://friend.io/">f</a>'),
        (6, "http://friend.io", None),
        (7, None, "<a href='http://b.org/'>n</a>"),
        (8, "no scheme /en/", ""),
        (9, "http://example.net/de/8/a://b", ""),
        (9, "http://example.net/de/8/a://b", ""),
        (None, "://?x#y", ""),
        (11, "http://badexample.com/en/7", ""),
        (12, "ftp://www.x.example.net#de/", ""),
        (13, "http://com/en/7", ""),
        (14, "http://m.friend.io/de/\nline", ""),
    ]
    held(spark, pages, spark.createDataFrame([(*p, "h", 1.0) for p in pages], "page_id long, url string, html string, host string, rank double"))
    got = {r.page_id: r.verdict for r in urls.filtered(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[4] == "block" and got[6] == "allow"


def test_given_pages(spark):
    frame = spark.read.parquet(f"{DIR}/pages.parquet")
    held(spark, [tuple(r) for r in frame.select("page_id", "url", "html").collect()], frame)


def test_no_pages_and_no_seeds(spark):
    schema = "page_id long, url string, html string"
    assert urls.filtered(spark.createDataFrame([], schema)).count() == 0
    got = urls.filtered(spark.createDataFrame([(1, "http://x.io/", "<a href='http://y.io'>")], schema)).collect()
    assert [(r.verdict, r.trust, r.distrust) for r in got] == [("allow", 0.0, 0.0)]


def test_distrust_goes_further_than_any_fixed_number_of_rounds(spark):
    n = 40
    pages = [(i, f"http://h{i}.io/", f"<a href='http://h{i + 1}.io/'>") for i in range(n)] + [(n, f"http://h{n}.io/", "<a href='http://spam.com/en/1'>"), (n + 1, "http://spam.com/en/1", "")]
    pages += [(1000 + i, f"http://calm{i}.io/", "") for i in range(3000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    held(spark, pages, frame)
    got = {r.page_id: r for r in urls.filtered(frame).collect()}
    assert all(got[i].distrust > 0 for i in range(n)) and got[n - 12].verdict == "block" and got[1000].verdict == "allow"


def test_a_very_long_page(spark):
    html = "x " * 200_000 + "".join(f"<a href='http://t{i % 50}.org/{i}'>" for i in range(5000))
    pages = [(1, "http://example.com/en/7", html), (2, "http://t3.org/", None)]
    held(spark, pages, spark.createDataFrame(pages, "page_id long, url string, html string"))
