import hashlib
import random
import re
import time

import pytest

from terrier.llm import pii
from tests.llm import lookalikes

DIR = "/root/testdata/sf0.001"


def plain_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_base(t):
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and plain_luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_spans_on_random_texts():
    rng = random.Random(4)
    for alphabet in ("a@.-1", "1. 2", "0123456789 -", "+1 2()-.", "a1@.+ é%", "4111 1-"):
        for _ in range(1500):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(t) == plain_base(t), t
    fixed = "x 4111 1111 1111 1111 y, a@b.co@c.de, +49 (30) 1234-567 1.2.3.4.5.6.7.8 999.1.1.1"
    assert pii.base_spans(fixed) == plain_base(fixed)


def test_rows(spark):
    rows = [(1, None, "n"), (2, "", "n"), (3, "é mail a.b@c.org or 10.0.0.255", "n"), (4, "card 4111-1111-1111-1111 call +1 (017) 555-7713", "n"), (4, "same id", "n"), (None, "+49 30 123456789", "n"), (7, "no data " * 9000 + "z@y.eu", "n"), (8, "a" * 300_000 + " " + "1" * 100_000, "n")]
    got = sorted(map(tuple, pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()), key=str)
    want = []
    for i, t, _ in rows:
        b = pii.base_spans(t or "")
        want.append((i, *[sum(k == j for _, k, _ in b) for j in range(4)], hashlib.sha256(pii.listed(b).encode()).hexdigest()))
    assert [r[:6] for r in got] == sorted(want, key=str)
    for r in got:
        assert r[6] or r[1:5] == (0, 0, 0, 0)
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_given_documents_keep_base_spans(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.personal_data(docs).collect():
        base = plain_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert set(filter(None, pii.listed(base).split(","))) <= set(r.spans.split(","))


def test_em_learns_whom_to_trust_and_the_classifier_adds_spans(spark):
    rng = random.Random(1)
    counts = {}
    for _ in range(4000):
        true = rng.random() < 0.4
        vote = lambda right: "+" if (rng.random() < right) == true else "-"
        v = vote(0.95) + vote(0.9) + vote(0.5) + "0" + vote(0.8) + "0"
        counts[v] = counts.get(v, 0) + 1
    got = pii.expectation_maximisation([(2, v, n) for v, n in counts.items()])
    assert got[2, "++-0+0"] > 0.95 and got[2, "--+0-0"] < 0.05
    assert abs(got[2, "+++0+0"] - got[2, "++-0+0"]) < 0.1
    spelled = [(i, f"write to me by mail joe{i} (at) host{i} (dot) org today", "x") for i in range(3)]
    plain = [(10 + i, f"contact phone +1 (0{i % 90 + 10}) 555-{1000 + i} or mail j{i}@mail.com ok", "x") for i in range(60)]
    found = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(spelled + plain, "doc_id long, text string, kind string")).collect()}
    assert all(found[10 + i].count("email") == 1 and found[10 + i].count("phone") == 1 for i in range(60))
    for i, text, _ in spelled:
        assert found[i] == f"email:{text.index('joe')}:{text.index(' today')}"


def planted(rng, text):
    """``text`` with something put between two of its words, what kind it is (None: harmless), and its place."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = "".join(rng.choice("abcdefghij") for _ in range(6))
    sort = rng.randrange(8)
    if sort < 2:
        lead, body, kind = rng.choice(["mail ", "contact ", "write "]), f"{name}{d(2)} (at) {name} (dot) {rng.choice(['com', 'org', 'de'])}", "email"
    elif sort < 4:
        lead, body, kind = rng.choice(["call ", "phone ", "tel: ", "mobile "]), f"{'23456789'[rng.randrange(8)]}{d(2)}-{d(3)}-{d(4)}", "phone"
    else:
        lead, body, kind = rng.choice(["order ", "invoice ", "serial ", "total "]), rng.choice([d(8), d(10), f"9{d(15)}", f"{d(4)}.{d(4)}"]), None
    words = text.split(" ")
    at = rng.randrange(len(words) + 1)
    before = " ".join([*words[:at], ""]) + lead if at else lead
    return before + body + " " + " ".join(words[at:]), kind, len(before), len(before) + len(body)


def test_planted_spans_that_no_base_pattern_finds(spark):
    rng = random.Random(12)
    texts = [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect() if r.text]
    made = [planted(rng, t) for t in texts for _ in range(3)]
    docs = spark.createDataFrame([(i, m[0]) for i, m in enumerate(made)], "doc_id long, text string")
    found = {r.doc_id: set(filter(None, r.spans.split(","))) for r in pii.personal_data(docs).collect()}
    right = {"email": [0, 0], "phone": [0, 0]}
    wrong = 0
    for i, (text, kind, a, b) in enumerate(made):
        base = set(filter(None, pii.listed(pii.base_spans(text)).split(",")))
        added = found[i] - base
        assert base <= found[i]
        if kind:
            right[kind][0] += f"{kind}:{a}:{b}" in found[i]
            right[kind][1] += 1
        wrong += len(added - ({f"{kind}:{a}:{b}"} if kind else set()))
    assert all(hit / n >= 0.9 for hit, n in right.values()), right
    assert wrong <= 0.05 * sum(hit for hit, _ in right.values()), wrong


def test_a_text_of_very_many_candidates():
    t = " ".join(f"u{i}@h{i}.com call 555-{i % 900 + 100}-{i % 9000 + 1000} ip 10.0.{i % 256}.7 and" for i in range(34_000))
    began = time.time()
    base = pii.base_spans(t)
    found = pii.candidates(t, base)
    strict = set(base)
    assert len(found) >= 100_000 and len({pii.described(t, s, strict)[0][0] for s in found}) == 2
    assert time.time() - began < 20


MIXES = [dict.fromkeys([*lookalikes.PERSONAL, *lookalikes.HARMLESS], 40), dict.fromkeys(lookalikes.PERSONAL, 10) | dict.fromkeys(lookalikes.HARMLESS, 150), dict.fromkeys(lookalikes.PERSONAL, 300) | dict.fromkeys(lookalikes.HARMLESS, 50), dict.fromkeys(lookalikes.PERSONAL, 30)]
MIXES += [dict.fromkeys(lookalikes.HARMLESS, 60), *({"phone": 40, "mail": 40, k: 250} for k in ("date", "years", "count", "failed card"))]


@pytest.mark.parametrize("mix", MIXES, ids=range(len(MIXES)))
def test_lookalikes_are_left_alone_in_any_mix(spark, mix):
    rng = random.Random(len(mix) + sum(mix.values()))
    texts = [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect() if r.text]
    kinds = [k for k, n in mix.items() for _ in range(n)]
    made = [(i, k, *lookalikes.planted(rng, texts[i % len(texts)], k)) for i, k in enumerate(kinds)]
    found = {r.doc_id: set(filter(None, r.spans.split(","))) for r in pii.personal_data(spark.createDataFrame([(i, t) for i, _, t, _ in made], "doc_id long, text string")).collect()}
    told = dict.fromkeys(mix, 0)
    for i, kind, text, span in made:
        added = found[i] - set(pii.listed(pii.base_spans(text)).split(","))
        told[kind] += (f"{'email' if kind == 'mail' else 'phone'}:{span[0]}:{span[1]}" in added) if span else bool(added)
    for kind, n in mix.items():
        assert told[kind] >= 0.9 * n if kind in lookalikes.PERSONAL else told[kind] <= 0.02 * n, told


def test_shapes_that_are_nobodys():
    for s in ("2017-11-19", "19.11.2017", "20171119", "1904-1994", "687 476 812", "12.345.678", "10.30 - 11.45", "2017-11-19 10.30", "48.85341 2.34880", "3.14159265", "1999 2001 2010", "(1 234 567)"):
        assert pii.harmless(s), s
    for s in ("735-843-1203", "(735) 843-1203", "735.843.1203", "06 12 34 56 78", "020 7946 0958", "555-1203", "4111 1111 1111 1111"):
        assert not pii.harmless(s), s
