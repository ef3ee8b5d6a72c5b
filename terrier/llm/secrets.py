"""Secret scans: a character convolutional network over every candidate and what surrounds it.

Base patterns find assignments, access keys and hexadecimal runs. Candidates are these and every long token that isn't all within
one of them. The network reads windows of bytes: 24 before the candidate, then 40 from it, and for a longer one more windows that
cover all of it; a candidate's score is that of its likeliest window. It is trained in numpy on labelled findings. The tables label
none, so findings are labelled by planting: into passages of a bounded sample of the documents go keys drawn at random (secrets) and
look-alikes made of the documents' own words, numbers and dates (harmless), each in the ways people write them; what the scan
finds of them has a label that owes nothing to the patterns. A quarter is held out; on it scores are calibrated, and each kind of
candidate gets the largest threshold that still recalls ``RECALL`` of its secrets. What the network accepts is added to the base spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrier.llm.shared import blobs, flat, in_batches, runs_of_rows, stored

KINDS = ("assign", "access", "hex")
#: Name of the spans that the network adds.
FOUND = "network"
#: Passages into which a secret and a look-alike are planted; a hash of the document decides which documents give one.
SAMPLE = 2_000
RECALL = 0.98
RUN_BYTES = 4 << 20
BEFORE, INSIDE = 24, 40
WINDOW = BEFORE + INSIDE
SEED = 7

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
_KEYWORD = re.compile(rb"(?i)passw|secret|token|api_?key")


def _class(spec: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[b for b in range(128) if re.match(spec, chr(b))]] = True
    return out


_TOKEN, _HEX, _UPPER = _class("[A-Za-z0-9+/_.=-]"), _class("[0-9a-f]"), _class("[A-Z0-9]")


def _runs(inside: np.ndarray, cuts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True of at least ``least``; no run goes over a cut."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[:-1] = inside
    edge[1:] ^= inside
    marks = np.flatnonzero(edge)
    starts, ends = marks[::2], marks[1::2]
    split = cuts[(cuts > 0) & (cuts < len(inside))]
    split = np.unique(split[inside[split] & inside[split - 1]])
    starts, ends = np.sort(np.append(starts, split)), np.sort(np.append(ends, split))
    long = ends - starts >= least
    return starts[long], ends[long]


def _windows(data: np.ndarray, lo: int, hi: int, start: int, end: int) -> bytes:
    """Windows of the candidate at start to end of the row at lo to hi; each is led by how many of its bytes belong to the candidate."""
    out = bytearray()
    for at in range(start, max(start + 1, end - INSIDE // 2) if end - start > INSIDE else start + 1, INSIDE // 2):
        before = data[max(lo, at - BEFORE) : at].tobytes().rjust(BEFORE, b"\0")
        out.append(min(INSIDE, end - at))
        out += before + data[at : min(hi, at + INSIDE)].tobytes().ljust(INSIDE, b"\0")
    return bytes(out)


def scanned(column: pa.LargeBinaryArray) -> list[list[tuple[int, int, int, bytes]]]:
    """For each row its findings (start, kind, end, windows), sorted: kind 0 to 2 base, 3 another candidate. Places are code points."""
    data, offsets = flat(column)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    cuts, found = offsets[1:-1], [[] for _ in range(len(column))]

    def note(row, start, kind, end, inner):
        found[row].append((int(start), int(end), kind, _windows(data, int(offsets[row]), int(offsets[row + 1]), *inner)))

    def rows_of(starts):
        return np.searchsorted(offsets, starts, side="right") - 1

    starts, ends = _runs(_HEX[data], cuts, 16)
    for row, a, b in zip(rows_of(starts), starts.tolist(), ends.tolist(), strict=True):
        note(row, a, 2, b, (a, b))
    starts, ends = _runs(_UPPER[data], cuts, 18)
    for row, a, b in zip(rows_of(starts), starts.tolist(), ends.tolist(), strict=True):
        k = data[a:b].tobytes().find(b"AKIA")
        if k >= 0 and b - a - k >= 18:
            note(row, a + k, 1, b, (a + k, b))
    sign = np.concatenate(([0], np.cumsum((data == 58) | (data == 61))))[offsets]
    for row in np.flatnonzero(np.diff(sign)):
        body = column[int(row)].as_py()
        if _KEYWORD.search(body):
            # ASCII bytes are matched alike in bytes and text, so places in Latin-1 are places of bytes
            for m in _ASSIGN.finditer(body.decode("latin-1")):
                if m.end(2) - m.start(2) >= 12:
                    o = int(offsets[row])
                    note(row, o + m.start(), 0, o + m.end(), (o + m.start(2), o + m.end(2)))
    starts, ends = _runs(_TOKEN[data], cuts, 16)
    base = [sorted((s, e) for s, e, *_ in own) for own in found]
    reach = [np.maximum.accumulate([e for _, e in own]) if own else () for own in base]
    for row, a, b in zip(rows_of(starts), starts.tolist(), ends.tolist(), strict=True):
        within = bisect_right(base[row], (a, len(data))) - 1
        if within < 0 or reach[row][within] < b:
            note(row, a, 3, b, (a, b))
    out = []
    for row, own in enumerate(found):
        zero = points[offsets[row]]
        out.append(sorted((int(points[s] - zero), k, int(points[e] - zero), w) for s, e, k, w in own))
    return out


def found_in(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the findings of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("windows", pa.binary())]))
        for batch in batches:
            texts, rows = blobs(batch.column(1)), []
            for lo, hi in runs_of_rows(texts, RUN_BYTES):
                rows += scanned(texts.slice(lo, hi - lo))
            found = [[dict(zip(("start", "kind", "end", "windows"), f, strict=True)) for f in own] for own in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "findings"])

    kept = docs.select("doc_id", F.col(text).alias("text"))
    return in_batches(kept).mapInArrow(work, f"doc_id {kept.dtypes[0][1]}, findings array<struct<start:long,kind:int,end:long,windows:binary>>")


class Network:
    """Bytes to classes to vectors, a convolution of width 5, the largest answers inside and around the candidate, a sigmoid."""

    CLASSES, VECTOR, FILTERS, WIDTH = 16, 8, 24, 5

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        # NUL, a-f, g-z, A-F, G-Z, each of space, quotes, '=', ':', '_-', '/+', '.', digit, other ASCII, beyond ASCII
        self.of = np.full(256, 14, np.int64)
        for i, spec in enumerate(("[a-f]", "[g-z]", "[A-F]", "[G-Z]", r"\s", "[\"']", "=", ":", "[_-]", "[/+]", r"\.", "[0-9]"), 1):
            self.of[_class(spec)] = i
        self.of[0], self.of[128:] = 0, 15
        k, v, f, w = self.CLASSES, self.VECTOR + 1, self.FILTERS, self.WIDTH
        self.p = {"e": rng.normal(0, 0.5, (k, v - 1)), "k": rng.normal(0, np.sqrt(2 / (v * w)), (v * w, f)), "kb": np.zeros(f), "o": rng.normal(0, 0.3, 2 * f), "ob": np.zeros(1)}
        self.slope, self.shift, self.thresholds, self.report = 1.0, 0.0, np.full(len(KINDS) + 1, np.inf), {}

    def _forward(self, x: np.ndarray, n: np.ndarray):
        at = np.arange(WINDOW)
        inside = (at >= BEFORE) & (at < BEFORE + n[:, None])
        classes = self.of[x]
        v = np.concatenate((self.p["e"][classes], inside[:, :, None]), axis=2)
        half = self.WIDTH // 2
        padded = np.pad(v, ((0, 0), (half, half), (0, 0)))
        cols = np.concatenate([padded[:, i : i + WINDOW] for i in range(self.WIDTH)], axis=2)
        h = np.maximum(cols @ self.p["k"] + self.p["kb"], 0)
        own, around = np.where(inside[:, :, None], h, -1).argmax(axis=1), np.where(inside[:, :, None], -1, h).argmax(axis=1)
        rows, f = np.arange(len(x))[:, None], np.arange(self.FILTERS)
        pooled = np.concatenate((h[rows, own, f], h[rows, around, f]), axis=1)
        return classes, cols, h, own, around, pooled, pooled @ self.p["o"] + self.p["ob"]

    def raw(self, windows: np.ndarray) -> np.ndarray:
        """The uncalibrated score of each row of windows (its first byte: bytes inside)."""
        return np.concatenate([self._forward(windows[i : i + 512, 1:], windows[i : i + 512, 0].astype(np.int64))[-1] for i in range(0, len(windows), 512)] or [np.zeros(0)])

    def fit(self, windows: np.ndarray, y: np.ndarray, rounds: int = 12, rate: float = 0.01, seed: int = SEED) -> None:
        rng, m = np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        step = 0
        for _ in range(rounds):
            order = rng.permutation(len(y))
            for at in range(0, len(y), 64):
                b = order[at : at + 64]
                x, n = windows[b, 1:].copy(), windows[b, 0].astype(np.int64)
                x[rng.random(len(b)) < 0.5, :BEFORE] = 0  # half the time without what stands before: shapes must do
                classes, cols, h, own, around, pooled, z = self._forward(x, n)
                dz = (1 / (1 + np.exp(-z)) - y[b]) * weight[b] / len(b)
                g = {"o": pooled.T @ dz, "ob": dz.sum(keepdims=True)}
                dp, dh = dz[:, None] * self.p["o"], np.zeros_like(h)
                rows, f = np.arange(len(b))[:, None], np.arange(self.FILTERS)
                np.add.at(dh, (rows, own, f), dp[:, : self.FILTERS])
                np.add.at(dh, (rows, around, f), dp[:, self.FILTERS :])
                dh *= h > 0
                g["k"], g["kb"] = np.einsum("nlc,nlf->cf", cols, dh, optimize=True), dh.sum(axis=(0, 1))
                dcols = dh @ self.p["k"].T
                v, half = self.VECTOR + 1, self.WIDTH // 2
                dpad = np.zeros((len(b), WINDOW + 2 * half, v))
                for i in range(self.WIDTH):
                    dpad[:, i : i + WINDOW] += dcols[:, :, i * v : (i + 1) * v]
                g["e"] = np.zeros_like(self.p["e"])
                np.add.at(g["e"], classes, dpad[:, half:-half, :-1])
                step += 1
                for k, grad in g.items():
                    a, s = m[k]
                    a += 0.1 * (grad - a)
                    s += 0.01 * (grad**2 - s)
                    self.p[k] = self.p[k] - rate * (a / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)

    def scores(self, windows: list[bytes]) -> np.ndarray:
        """The uncalibrated score of each finding: that of its likeliest window."""
        z = self.raw(np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW + 1))
        first = np.cumsum([0, *(len(w) // (WINDOW + 1) for w in windows)])[:-1]
        return np.maximum.reduceat(z, first) if windows else z

    def calibrate(self, z: np.ndarray, y: np.ndarray, kind: np.ndarray, recall: float = RECALL) -> None:
        """Platt's sigmoid on held-out scores; for each kind the threshold is the largest that recalls ``recall`` of its secrets. A kind without any accepts nothing."""
        soft = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        a, b = 0.0, 0.0  # from here Newton's steps don't overshoot
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w, e = p * (1 - p), p - soft
            hessian = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            a, b = (a, b) - np.linalg.solve(hessian, [(e * z).sum(), e.sum()])
        self.slope, self.shift = float(a), float(b)
        for k in np.unique(kind[y == 1]):
            held = np.sort(self.chance(z[(y == 1) & (kind == k)]))
            self.thresholds[k] = held[int(np.floor((1 - recall) * len(held)))]
            said = self.accepts(z[kind == k], kind[kind == k])
            true = y[kind == k] == 1
            self.report[(*KINDS, FOUND)[k]] = {"recall": float(said[true].mean()), "precision": float(true[said].mean()), "secrets": int(true.sum()), "harmless": int((~true).sum())}

    def accepts(self, z: np.ndarray, kind: np.ndarray) -> np.ndarray:
        return self.chance(z) >= self.thresholds[kind]

    def chance(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))


_BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_LETTERS, _LOWERS, _DIGITS, _HEXES = _BASE62[:52], _BASE62[26:52], _BASE62[52:], "0123456789abcdef"


def _from(rng: np.random.Generator, letters: str, least: int, most: int) -> str:
    return "".join(letters[i] for i in rng.integers(0, len(letters), int(rng.integers(least, most + 1))))


#: How keys look; each draws one.
SECRETS: tuple[Callable, ...] = (
    lambda r, w: _from(r, _BASE62, 16, 48),
    lambda r, w: _from(r, _BASE62 + "+/", 22, 60) + "=" * int(r.integers(0, 3)),
    lambda r, w: _from(r, _BASE62 + "-_", 20, 44),
    lambda r, w: _from(r, _LOWERS + _DIGITS, 18, 40),
    lambda r, w: _from(r, _LETTERS, 16, 32),
    lambda r, w: _from(r, _HEXES, int(n := r.choice([32, 40, 64])), int(n)),
    lambda r, w: "AKIA" + _from(r, _BASE62[:26] + _DIGITS, 16, 16),
    lambda r, w: ".".join("eyJ"[: 3 * (i < 2)] + _from(r, _BASE62 + "-_", 20, 40) for i in range(3)),
    lambda r, w: w(0)[:3] + "_" + _from(r, _BASE62, 20, 40),
)
#: How harmless long tokens look; w(i) is a word of the passage's document, in lower case.
LOOK_ALIKES: tuple[Callable, ...] = (
    lambda r, w: r.choice(["-", "_", ".", "/"]).join(w(i) for i in range(int(r.integers(3, 6)))),
    lambda r, w: "/" + "/".join(w(i) for i in range(3)) + r.choice([".html", ".txt", ".py", ""]),
    lambda r, w: w(0) + "".join(w(i).capitalize() for i in range(1, int(r.integers(3, 6)))),
    lambda r, w: "".join(w(i).capitalize() for i in range(int(r.integers(3, 6)))),
    lambda r, w: "_".join(w(i).upper() for i in range(int(r.integers(3, 5)))),
    lambda r, w: "".join(w(i) for i in range(int(r.integers(3, 6)))),
    lambda r, w: r.choice(["mail", "www", "host"]) + _from(r, _DIGITS, 0, 2) + "." + w(0) + w(1) + r.choice([".com", ".org", ".de", ".example.net"]),
    lambda r, w: f"20{r.integers(10, 40)}-{r.integers(10, 13)}-{r.integers(10, 31)}-{_from(r, _DIGITS, 6, 10)}",
    lambda r, w: f"v{r.integers(1, 20)}.{r.integers(0, 30)}.{r.integers(0, 90)}-{w(0)}.{r.integers(1, 9)}-{w(1)}",
    lambda r, w: f"{w(0)}-{r.integers(1, 99)}-{w(1)}-{r.integers(1, 9999)}",
    lambda r, w: f"{w(0)}_{w(1)}_{_from(r, _DIGITS, 3, 8)}{r.choice(['.jpeg', '.csv', '.pdf', ''])}",
    lambda r, w: str(r.choice(list("=-_.ax0"))) * int(r.integers(16, 50)),
    lambda r, w: _from(r, _DIGITS, 16, 20),
    lambda r, w: "-".join(_from(r, _DIGITS, 4, 4) for _ in range(4)),
)
LEADS = ('password: {}', 'token = "{}"', "api_key={}", "secret: '{}'", 'Passwd={}', '"apikey": "{}"')


def planted(passages: list[tuple[bytes, list[str]]], seed: int = SEED) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Windows, label, kind and passage of the findings that what is planted into each passage (bytes before, words) gives; half of it after a keyword."""
    texts, labels, inside, rng = [], [], [], np.random.default_rng(seed)
    for i, (before, ws) in enumerate(passages):
        own = [w.lower() for w in ws] or ["word"]
        word = lambda k, own=own: own[k % len(own)]
        for label, ways in ((1, SECRETS), (0, LOOK_ALIKES)):
            token = ways[int(rng.integers(len(ways)))](rng, word)
            while len(token) < 16:
                token += "-" + own[len(token) % len(own)]
            lead = LEADS[int(rng.integers(len(LEADS)))] if rng.random() < 0.4 else "{}" if rng.random() < 0.8 else "@{}"
            head = before + b" " + lead.partition("{}")[0].encode()
            texts.append(head + token.encode() + lead.partition("{}")[2].encode() + b" " + own[0].encode())
            labels.append((label, i))
            start = len(head.decode(errors="replace"))
            inside.append((start, start + len(token)))
    out: tuple[list, list, list, list] = ([], [], [], [])
    for found, (label, i), (a, b) in zip(scanned(pa.array(texts, pa.large_binary())), labels, inside, strict=True):
        for start, kind, end, windows in found:
            if start < b and a < end:
                for column, value in zip(out, (windows, label, kind, i), strict=True):
                    column.append(value)
    return out[0], np.array(out[1]), np.array(out[2]), np.array(out[3])


def passages_of(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> list[tuple[bytes, list[str]]]:
    """Up to ``sample`` passages (bytes before a word, and words of the document): of the documents of smallest hash, from a place that the hash decides."""
    known = docs.filter(F.length(F.col(text)) > 0)
    h = F.pmod(F.xxhash64("doc_id", text), F.lit(1 << 32))
    # about twice as many as are wanted pass the hash; the rest is never cut into words
    likely = known.select(F.col(text).alias("text"), h.alias("h")).filter(F.col("h") < min(1.0, (2 * sample + 100) / max(known.count(), 1)) * float(1 << 32))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, words = [], []
            for body, key in zip(blobs(batch.column(0)).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spots = [m.start() for m in re.finditer(rb"[A-Za-z]{3,12}(?![A-Za-z])", body)]
                at = key % len(spots) if spots else 0
                here = spots[at] if spots else 0
                before.append(body[max(0, here - 2 * BEFORE) : here].decode(errors="ignore").encode())
                words.append([re.match(rb"[A-Za-z]{3,12}", body[s : s + 12])[0].decode() for s in (spots * 2)[at : at + 8]])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(before, pa.binary()), pa.array(words, pa.list_(pa.string()))], names=["h", "before", "words"])

    rows = in_batches(likely).mapInArrow(cut, "h long, before binary, words array<string>").orderBy("h", "before", "words").limit(sample).collect()
    return [(bytes(r.before), list(r.words)) for r in rows]


def trained(passages: list[tuple[bytes, list[str]]]) -> Network:
    """The network for what is planted into the passages; every fourth is held out to calibrate it. Without passages it accepts nothing."""
    net = Network()
    windows, y, kind, passage = planted(passages)
    held = passage % 4 == 0
    if min((y[part] == label).sum() for part in (held, ~held) for label in (0, 1)) == 0 if len(y) else True:
        return net
    own = [np.frombuffer(w, np.uint8).reshape(-1, WINDOW + 1) for w, h in zip(windows, held, strict=True) if not h]
    net.fit(np.concatenate(own), np.repeat(y[~held], [len(w) for w in own]))
    net.calibrate(net.scores([w for w, h in zip(windows, held, strict=True) if h]), y[held], kind[held])
    return net


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{(*KINDS, FOUND)[k]}:{a}:{b}" for a, k, b in spans)


def secrets(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_confirmed (base spans the network accepts) of every row of ``docs``.

    Spans are kind:start:end in code points, end exclusive, by start, then kind; those the network adds are last by kind.
    Null and empty texts have no span; repeated rows are judged alike; an empty table gives no row; other columns are ignored.
    A text of very many candidates has all of them scored.
    """
    net = trained(passages_of(docs, text, sample))
    rows = stored(found_in(docs, text), "found")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1).to_pylist()
            every = [f for fs in own for f in fs]
            accepted = net.accepts(net.scores([f["windows"] for f in every]), np.array([f["kind"] for f in every], np.int64)).tolist() if every else []
            out, at = [], 0
            for fs in own:
                yes = accepted[at : at + len(fs)]
                at += len(fs)
                base = [(f["start"], f["kind"], f["end"]) for f in fs if f["kind"] < 3]
                added = [(f["start"], 3, f["end"]) for f, ok in zip(fs, yes, strict=True) if f["kind"] == 3 and ok]
                n = [sum(k == j for _, k, _ in base) for j in range(3)]
                out.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(base + added)), sum(ok for f, ok in zip(fs, yes, strict=True) if f["kind"] < 3)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    return in_batches(rows).mapInArrow(judge, f"doc_id {rows.dtypes[0][1]}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")
