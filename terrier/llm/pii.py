"""Personal data by weak supervision: labelers vote on spans, EM weighs the labelers, a classifier is trained on the outcome.

The base patterns find spans of four kinds. Looser patterns propose more candidates: spelled-out addresses, numbers grouped like
phones and cards. Seven labelers (strict pattern, checksum, gazetteer, context words, grouping, surroundings, shape: a number that
reads as a date, a time, years, a count or a decimal) vote for, against or not at all on every candidate of every document. Votes are counted by kind and pattern of votes over the whole corpus, which is
small whatever the corpus, and expectation-maximisation estimates from the counts how far each labeler is to be trusted; a labeler
that doesn't vote says nothing. A logistic span classifier is trained on a bounded sample of candidates of each sort with the
posteriors as labels; what it accepts is added to the base spans, unless it overlaps one, if context or gazetteer vouch for it and
neither checksum nor shape say no.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrier.llm.shared import blobs, flat, in_batches, runs_of_rows, stored

KINDS = ("email", "ip", "card", "phone")
#: Candidates of each kind, strict or loose, that the classifier is trained on at most; a hash of place and document decides which.
SAMPLE = 1_000
ACCEPT = 0.5
#: Shares between which the priors of EM are kept, so that votes decide in any mix, also where few of very many candidates are true.
PRIORS = (0.1, 0.9)
RUN_BYTES = 8 << 20

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# a match takes whole runs of digits, so none starts within one
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE_NUMBER = re.compile(r"(?<![0-9(])[(]?[0-9][0-9() .-]{5,30}[0-9]")
_LOOSE_MAIL = re.compile(r"(?i)(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}(?: ?\[at\] ?| ?\(at\) ?| at )[A-Za-z0-9-]{1,63}(?: ?\[dot\] ?| ?\(dot\) ?| dot )[A-Za-z]{2,24}\b")

# what a number can be that is nobody's: dates, times and years, each alone or as parts of a list or a range; numbers with thousands grouped or a decimal point
_DAY, _MONTH, _YEAR = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])", "(?:1[0-9]|20|21)[0-9]{2}"
_MOMENT = re.compile(rf"{_YEAR}([ .-]){_MONTH}\1{_DAY}|{_DAY}([ .-]){_MONTH}\2{_YEAR}|{_MONTH}([ .-]){_DAY}\3{_YEAR}|{_YEAR}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])|(?:[01]?[0-9]|2[0-3])\.[0-5][0-9]|{_YEAR}")
_BETWEEN = re.compile(r" *- *| +")
_COUNT = re.compile(r"[1-9][0-9]{0,2}(?:[ .][0-9]{3})+|[0-9]+\.[0-9]+(?:(?: *- *| +)[0-9]+\.[0-9]+)*")

# Top-level domains, calling codes, issuer prefixes and context words.
DOMAINS = frozenset("com org net edu gov info io co uk de fr es it nl eu us ca au ch at be".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38")
CONTEXT_FOR = re.compile(r"(?i)\b(e-?mail|mail|contact|call|phone|tel|fax|mobile|card|visa|mastercard|credit|iban|ip|host|address|courriel|téléphone|carte|telefon|karte|correo|teléfono|tarjeta)\b")
CONTEXT_AGAINST = re.compile(r"(?i)\b(version|section|isbn|issn|order|invoice|total|page|chapter|figure|ratio|price|serial|doi)\b")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _mails(t: str) -> Iterator[tuple[int, int]]:
    end, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(t, start - 1):
            start -= 1
        m = _DOMAIN.match(t, at) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = t.find("@", max(at + 1, end))


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost non-overlapping for each kind, sorted."""
    out = [(a, 0, b) for a, b in _mails(t)] if "@" in t else []
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(t) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(t) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in t:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(t) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def candidates(t: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The base spans, and looser spans that overlap none."""
    found = list(base)
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    for pattern, kind in ((_LOOSE_MAIL, 0), (_LOOSE_NUMBER, None)):
        if kind == 0 and "dot" not in t.lower():
            continue
        for m in pattern.finditer(t):
            n = len(_digits(m[0]))
            own = kind if kind is not None else (1 if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", m[0]) else 2 if 12 <= n <= 19 else 3)
            if own in (2, 3) and not 7 <= n <= 19:
                continue
            before = bisect_left(starts, m.end())  # base spans that start before the end; the furthest of them may reach in
            if not before or reach[before - 1] <= m.start():
                found.append((m.start(), own, m.end()))
    return sorted(found)


def harmless(s: str) -> bool:
    """Whether a number reads as dates, times, years, a grouped count or decimal numbers."""
    s = s.strip("() ")
    if _COUNT.fullmatch(s) or _MOMENT.fullmatch(s):
        return True
    ends = {0}  # of the parts that have been read: a moment, then what stands between two
    for at in range(len(s)):
        if at in ends:
            for m in (_MOMENT.fullmatch(s, at, to) for to in range(at + 4, min(len(s), at + 10) + 1)):
                if m and m.end() == len(s):
                    return True
                if m and (gap := _BETWEEN.match(s, m.end())) and gap.end() > m.end():
                    ends.add(gap.end())
    return False


def described(t: str, span: tuple[int, int, int], base: set) -> tuple[list[int], list[float]]:
    """The labelers' votes (1, 0 or -1) and the classifier's features of a candidate."""
    a, kind, b = span
    s, d = t[a:b], _digits(t[a:b])
    before, after = t[max(0, a - 40) : a], t[b : b + 20]
    strict = span in base
    check = 0 if kind in (0, 3) else 1 if (luhn(d) if kind == 2 else all(int(x) <= 255 for x in s.split("."))) else -1
    if kind == 0:
        listed = 1 if re.split(r"\W+", s.lower())[-1] in DOMAINS else 0
    elif kind == 1:
        listed = -1 if d[:1] == "0" or s.startswith(("127.", "255.")) else 0
    elif kind == 2:
        listed = 1 if d.startswith(ISSUERS) else -1
    else:
        listed = 1 if s.startswith("+") and d.startswith(CALLING_CODES) else 0
    pro, con = len(CONTEXT_FOR.findall(before)), len(CONTEXT_AGAINST.findall(before))
    context = (pro > con) - (con > pro)
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    if kind == 2:
        grouped = 1 if groups == [4] * len(groups) and len(groups) > 1 else 0
    elif kind == 3:
        grouped = 1 if groups[-2:] == [3, 4] else -1 if len(groups) == 1 and not s.startswith("+") else 0
    else:
        grouped = 0
    glued = (before[-1:].isalnum() or before[-1:] in "._-/" and bool(before)) or after[:1].isalnum()
    shape = 0 if kind < 2 else -1 if not strict and harmless(s) else 1
    votes = [1 if strict else 0, check, listed, context, grouped, -1 if glued else 1, shape]
    seps = sum(not c.isalnum() for c in s)
    said = [float(v == sign) for v in votes[1:5] for sign in (1, -1)]
    features = [*(float(kind == k and strict is sort) for k in range(4) for sort in (False, True)), len(d) / 20, (b - a) / 40, seps / 10, len(groups) / 5, float("+" in s), float("(" in s), *said, float(glued), float(shape < 0), len(set(d)) / 10]
    return votes, features


N_LABELERS, N_FEATURES = 7, 25


def vouched(votes: str) -> bool:
    """Whether a loose candidate may be added at all: context or gazetteer vouch for it, and neither the checksum nor its shape says no.

    Votes without this are left to nobody: a classifier that has seen few candidates of a kind would go by what they happen to share.
    """
    return "+" in (votes[2], votes[3]) and "-" not in (votes[1], votes[6])


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def found_in(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, base (spans as text), counts, and the candidates with votes and features, of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = blobs(batch.column(1)), []
            for lo, hi in runs_of_rows(texts, RUN_BYTES):
                run = texts.slice(lo, hi - lo)
                data, offsets = flat(run)
                may = np.concatenate(([0], np.cumsum(((data >= 48) & (data < 58)) | (data == 64))))[offsets]
                spell = np.diff(may) > 0
                for i in range(hi - lo):
                    body = run[i].as_py()
                    if not spell[i] and b"dot" not in body.lower():
                        rows.append((0, 0, 0, 0, [], []))
                        continue
                    t = body.decode(errors="replace")
                    base = base_spans(t)
                    strict, own = set(base), []
                    for span in candidates(t, base):
                        votes, features = described(t, span, strict)
                        own.append({"start": span[0], "kind": span[1], "end": span[2], "votes": "".join("-0+"[v + 1] for v in votes), "features": features})
                    n = [sum(k == j for _, k, _ in base) for j in range(4)]
                    rows.append((*n, [{"start": a, "kind": k, "end": b} for a, k, b in base], own))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64()] * 4 + [pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])), pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("votes", pa.string()), ("features", pa.list_(pa.float64()))]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]], names=["doc_id", *[f"n_{k}" for k in KINDS], "base", "candidates"])

    kept = docs.select("doc_id", F.col(text).alias("text"))
    return in_batches(kept).mapInArrow(work, f"doc_id {kept.dtypes[0][1]}, n_email long, n_ip long, n_card long, n_phone long, base array<struct<start:long,kind:int,end:long>>, candidates array<struct<start:long,kind:int,end:long,votes:string,features:array<double>>>")


def expectation_maximisation(counts: list[tuple[int, str, int]], rounds: int = 60) -> dict[tuple[int, str], float]:
    """From (kind, votes, how many) the probability of each (kind, votes) to be personal data.

    For each kind a prior for strict candidates and one for loose ones, and for each labeler its chance to say yes, if it votes, of what is
    personal data and of what isn't; labelers are taken as independent given the truth, and one that doesn't vote is left out.
    Starts from the majority; of the two classes the one that the labelers rather say yes to is the true one.
    """
    out = {}
    for kind in {k for k, _, _ in counts}:
        patterns = sorted((v, n) for k, v, n in counts if k == kind)
        votes = np.array([["-0+".index(c) - 1 for c in v] for v, _ in patterns])
        n = np.array([c for _, c in patterns], float)
        up, down, strict = votes == 1, votes == -1, votes[:, 0] == 1
        p = 1 / (1 + np.exp(-votes.sum(axis=1).astype(float)))
        for _ in range(rounds):
            prior = np.where(strict, (n @ (p * strict) + 1) / (n @ strict + 2), (n @ (p * ~strict) + 1) / (n @ ~strict + 2)).clip(*PRIORS)
            rates = []
            for weight in (n * p, n * (1 - p)):
                rates.append((weight @ up + 0.5) / (weight @ (up | down) + 1))
            yes, no = rates
            score = np.log(prior / (1 - prior)) + up @ np.log(yes / no) + down @ np.log((1 - yes) / (1 - no))
            p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if (up | down).sum(axis=0) @ (yes - no) < 0:
            p = 1 - p
        out |= {(kind, v): float(x) for (v, _), x in zip(patterns, p, strict=True)}
    return out


def fitted(x: np.ndarray, p: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights (the intercept last) of a logistic regression on soft labels, by Newton's method; true ones weigh as much on the whole as false ones, if they are fewer."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    yes, no = p * max(1.0, (1 - p).sum() / max(p.sum(), 1.0)), 1 - p
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * ((yes + no) * q * (1 - q))[:, None]).T @ x + penalty * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ ((yes + no) * q - yes) + penalty * w)
    return w


def trained(each: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The classifier's weights for candidates (doc_id, start, kind, end, votes, features) of a written table; all 0, and nothing accepted, without any.

    How many there are of each sort says below which hash twice the sample is to be expected, so few more than are wanted are ranked.
    """
    counts = [tuple(r) for r in each.groupBy("kind", "votes").count().collect()]  # 4 x 3^7 rows at most
    truth = expectation_maximisation(counts)
    h, sort, share = F.pmod(F.xxhash64("doc_id", "start", "kind"), F.lit(1 << 32)), F.struct("kind", F.startswith("votes", F.lit("+"))), F.lit(1.0)
    for kind in range(len(KINDS)):
        for strict in (False, True):
            n = sum(c for k, v, c in counts if k == kind and (v[0] == "+") is strict)
            share = F.when((F.col("kind") == kind) & (F.startswith("votes", F.lit("+")) == strict), min(1.0, (2 * sample + 100) / max(n, 1))).otherwise(share)
    likely = each.filter(h < share * float(1 << 32)).withColumns({"_h": h, "_sort": sort})
    ranked = likely.withColumn("_n", F.row_number().over(Window.partitionBy("_sort").orderBy("_h", "doc_id", "start", "end", "votes")))
    taken = ranked.filter(F.col("_n") <= sample).select("kind", "votes", "features").toArrow().to_pydict()
    if not taken["kind"]:
        return np.zeros(N_FEATURES + 1)
    x, p = np.array(taken["features"]), np.array([truth[k] for k in zip(taken["kind"], taken["votes"], strict=True)])
    order = np.lexsort((p, *x.T))  # rows come in any order
    return fitted(x[order], p[order])


def personal_data(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added (spans that the classifier added) of every row of ``docs``.

    Spans are kind:start:end in code points, end exclusive, by start, then kind. Null and empty texts have none. Where a text
    has no candidate nothing is added; without any candidate in the table there is no classifier. Repeated rows are
    judged alike and vote each; an empty table gives no row; other columns are ignored.
    """
    rows = stored(found_in(docs, text), "found")
    weights = trained(rows.select("doc_id", F.explode("candidates").alias("c")).select("doc_id", "c.*"), sample)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, spans, added = [], [], []
            for base, own in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                stay = [(s["start"], s["kind"], s["end"]) for s in base]
                held, more = set(stay), []
                for c in own:
                    span = (c["start"], c["kind"], c["end"])
                    if span not in held and vouched(c["votes"]) and 1 / (1 + np.exp(-(weights[:-1] @ c["features"] + weights[-1]))) > ACCEPT:
                        more.append(span)
                digests.append(hashlib.sha256(listed(stay).encode()).hexdigest())
                spans.append(listed(sorted(stay + more)))
                added.append(len(more))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], names=[*batch.schema.names[:5], "base_sha256", "spans", "n_added"])

    return in_batches(rows).mapInArrow(judge, f"doc_id {rows.dtypes[0][1]}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
