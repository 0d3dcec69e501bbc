"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions for what they miss.

The network is trained in numpy from labelled spans: those the patterns find in a bounded sample of texts, and rewritten forms of them (an
address with "at" and "dot", a number without its plus sign, a card with other separators). It reads overlapping windows; where windows overlap, their scores are
averaged by how central a character is, and one Viterbi pass over the whole region decides, so no span is cut at a window's edge. Spans it adds must not touch
one of the patterns' and must hold the digits or signs of their kind. Every kind needs a digit or an at sign nearby, so only surroundings of those are read: all of them, in whole texts.
"""

from __future__ import annotations

import hashlib
import re
import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sample_by_hash, table
from .texts import map_texts, with_labels

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ["email", "ip", "card", "phone"]
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]  # O, B-email, I-email, ...
SAMPLE_DOCS = 600  # bound of the texts the network is trained on
SAMPLE_WINDOWS = 3_000
WINDOW, STRIDE, MARGIN = 64, 32, 24
HIDDEN = 20
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_TRIGGER = re.compile(r"[0-9@]|(?<=[\[( ])at(?=[\]) ])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind number, start, end)`` of the fixed patterns: leftmost, non-overlapping per kind, those that fail their check dropped. Linear in the text."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    done = 0
    runs = list(_DIGITS.finditer(text))
    if not runs:
        return out
    for run in runs:
        if run.start() >= done and (m := _IP.match(text, run.start())):
            done = m.end()
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# --- network -------------------------------------------------------------------------------------

_SIGNS = "\n @.-_+%():/=\"',[]"
SYMBOLS = 26 + len(_SIGNS) + 5  # letters, signs, digit, other ASCII, other letters, everything else, padding
PAD = SYMBOLS - 1


def _symbol_table() -> np.ndarray:
    out = np.full(256, SYMBOLS - 2, dtype=np.int64)
    for b in range(128):
        c = chr(b)
        low = c.lower()
        if "a" <= low <= "z":
            out[b] = ord(low) - 97
        elif c in _SIGNS:
            out[b] = 26 + _SIGNS.index(c)
        else:
            out[b] = SYMBOLS - 5 if c.isdigit() else SYMBOLS - 4
    out[192:] = SYMBOLS - 3
    return out


_SYMBOL = _symbol_table()


def symbols(text: str) -> np.ndarray:
    """One symbol per code point; letters beyond Latin-1 look like its letters."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    return _SYMBOL[np.minimum(points, 255)]


@dataclass
class Tagger:
    """Parameters by name: input tables and recurrent weights of both directions, output weights, CRF transitions and start scores."""

    p: dict[str, np.ndarray]

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Tag scores of windows, windows x places x tags."""
        h = np.concatenate([_lstm(ids, self.p["xf"], self.p["hf"])[0], _lstm(ids[:, ::-1], self.p["xb"], self.p["hb"])[0][:, ::-1]], 2)
        return h @ self.p["out"] + self.p["bias"]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _lstm(ids: np.ndarray, wx: np.ndarray, wh: np.ndarray, trace: bool = False):
    n, t = ids.shape
    size = wh.shape[0]
    h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    out, kept = np.empty((n, t, size), np.float32), []
    for k in range(t):
        z = wx[ids[:, k]] + h @ wh
        s, g = _sigmoid(z[:, : 3 * size]), np.tanh(z[:, 3 * size :])
        i, f, o = s[:, :size], s[:, size : 2 * size], s[:, 2 * size :]
        before = c
        c = f * c + i * g
        tc = np.tanh(c)
        if trace:
            kept.append((h, before, i, f, o, g, tc))
        h = o * tc
        out[:, k] = h
    return out, kept


def _lstm_back(ids, wx, wh, kept, dout):
    """Gradients of the input table and the recurrent weights."""
    size = wh.shape[0]
    dx, dw = np.zeros_like(wx), np.zeros_like(wh)
    dh, dc = np.zeros_like(kept[0][0]), np.zeros_like(kept[0][0])
    for k in range(len(kept) - 1, -1, -1):
        before_h, before_c, i, f, o, g, tc = kept[k]
        dh = dh + dout[:, k]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        np.add.at(dx, ids[:, k], dz)
        dw += before_h.T @ dz
        dh, dc = dz @ wh.T, dc * f
    return dx, dw


def _crf(scores, tags, trans, start):
    """Mean negative log likelihood of tag rows and its gradients by scores, transitions and starts."""
    n, t, k = scores.shape
    alpha, beta = np.empty((n, t, k)), np.zeros((n, t, k))
    total = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    alpha[:, 0] = start + scores[:, 0]
    for j in range(1, t):
        alpha[:, j] = total(alpha[:, j - 1][:, :, None] + trans, 1) + scores[:, j]
    for j in range(t - 2, -1, -1):
        beta[:, j] = total(trans + (scores[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
    z = total(alpha[:, -1], 1)
    d_scores = np.exp(alpha + beta - z[:, None, None])
    pair = np.exp(alpha[:, :-1, :, None] + trans + (scores[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
    d_trans, d_start = pair.sum((0, 1)), d_scores[:, 0].sum(0)
    rows, places = np.arange(n)[:, None], np.arange(t)
    gold = scores[rows, places, tags].sum() + start[tags[:, 0]].sum() + trans[tags[:, :-1], tags[:, 1:]].sum()
    d_scores[rows, places, tags] -= 1
    np.add.at(d_trans, (tags[:, :-1], tags[:, 1:]), -1)
    np.add.at(d_start, tags[:, 0], -1)
    return (z.sum() - gold) / n, d_scores / n, d_trans / n, d_start / n


def fit_tagger(ids: np.ndarray, tags: np.ndarray, epochs: int = 6, batch: int = 96, rate: float = 0.015, seed: int = 7) -> Tagger:
    """Network trained on windows of symbols and tag numbers by Adam."""
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 0.15, shape).astype(np.float32)
    p = {"xf": small(SYMBOLS, 4 * HIDDEN), "hf": small(HIDDEN, 4 * HIDDEN), "xb": small(SYMBOLS, 4 * HIDDEN), "hb": small(HIDDEN, 4 * HIDDEN)}
    for x in ("xf", "xb"):
        p[x][:, HIDDEN : 2 * HIDDEN] += 1  # remember at first
    p |= {"out": small(2 * HIDDEN, len(TAGS)), "bias": small(len(TAGS)), "trans": small(len(TAGS), len(TAGS)), "start": small(len(TAGS))}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x, back = ids[pick], ids[pick][:, ::-1]
            hf, kf = _lstm(x, p["xf"], p["hf"], True)
            hb, kb = _lstm(back, p["xb"], p["hb"], True)
            h = np.concatenate([hf, hb[:, ::-1]], 2)
            _, ds, dt, d0 = _crf(h @ p["out"] + p["bias"], tags[pick], p["trans"], p["start"])
            ds = ds.astype(np.float32)
            dh = ds @ p["out"].T
            g = {"out": np.einsum("nth,ntk->hk", h, ds), "bias": ds.sum((0, 1)), "trans": dt, "start": d0}
            g["xf"], g["hf"] = _lstm_back(x, p["xf"], p["hf"], kf, dh[:, :, :HIDDEN])
            g["xb"], g["hb"] = _lstm_back(back, p["xb"], p["hb"], kb, dh[:, ::-1, HIDDEN:])
            step += 1
            for k in p:
                d = np.clip(g[k], -1, 1).astype(np.float32)
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.99 * v[k] + 0.01 * d * d
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Tagger(p)


# --- windows -------------------------------------------------------------------------------------


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around all digits and at signs, with ``MARGIN`` characters on either side; those that touch are one."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        lo, hi = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _starts(length: int) -> list[int]:
    """Window starts that cover a region with overlaps of at least half a window."""
    return [0, *range(STRIDE, length - STRIDE, STRIDE)] if length > WINDOW else [0]


_CENTRAL = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)


def region_tags(tagger: Tagger, coded: list[np.ndarray]) -> list[np.ndarray]:
    """Best tag path of each region: averaged window scores, then Viterbi over regions of similar length at a time."""
    where = [(r, s) for r, x in enumerate(coded) for s in _starts(len(x))]
    sums = [np.zeros((len(x), len(TAGS)), np.float32) for x in coded]
    weight = [np.zeros(len(x), np.float32) for x in coded]
    for at in range(0, len(where), 1024):
        part = where[at : at + 1024]
        ids = np.full((len(part), WINDOW), PAD, dtype=np.int64)
        for k, (r, s) in enumerate(part):
            x = coded[r][s : s + WINDOW]
            ids[k, : len(x)] = x
        scores = tagger.scores(ids)
        for k, (r, s) in enumerate(part):
            n = min(WINDOW, len(coded[r]) - s)
            sums[r][s : s + n] += scores[k, :n] * _CENTRAL[:n, None]
            weight[r][s : s + n] += _CENTRAL[:n]
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(coded)
    buckets: dict[int, list[int]] = {}
    for r, x in enumerate(coded):
        buckets.setdefault(len(x).bit_length(), []).append(r)
    for rows in buckets.values():
        longest = max(len(coded[r]) for r in rows)
        scores = np.zeros((len(rows), longest, len(TAGS)), np.float32)
        scores[:, :, 1:] = -50  # beyond a region's end: outside any span
        for k, r in enumerate(rows):
            scores[k, : len(coded[r])] = sums[r] / weight[r][:, None]
        best = tagger.p["start"] + scores[:, 0]
        came = np.zeros((len(rows), longest, len(TAGS)), np.int8)
        for j in range(1, longest):
            step = best[:, :, None] + tagger.p["trans"]
            came[:, j] = step.argmax(1)
            best = step.max(1) + scores[:, j]
        path = np.empty((len(rows), longest), np.int64)
        path[:, -1] = best.argmax(1)
        for j in range(longest - 1, 0, -1):
            path[:, j - 1] = came[np.arange(len(rows)), j, path[:, j]]
        for k, r in enumerate(rows):
            out[r] = path[k, : len(coded[r])]
    return out


def _spans_of(tags: np.ndarray, lo: int) -> list[tuple[int, int, int]]:
    out, open_at, kind = [], -1, -1
    for j, t in enumerate([*tags.tolist(), 0]):
        inside = t > 0 and t % 2 == 0 and (t - 1) // 2 == kind
        if open_at >= 0 and not inside:
            out.append((kind, lo + open_at, lo + j))
            open_at, kind = -1, -1
        if t > 0 and open_at < 0:
            open_at, kind = j, (t - 1) // 2
    return out


_NUMBER_PARTS = re.compile(r"[0-9]+")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]+\s?(?:@|[\[(]\s?at\s?[\])]|\sat\s)\s?[A-Za-z0-9-]+(?:\s?(?:\.|[\[(]\s?dot\s?[\])]|\sdot\s)\s?[A-Za-z0-9-]+)+")


def plausible(kind: int, found: str) -> bool:
    """Whether an added span holds what its kind must."""
    digits = "".join(c for c in found if "0" <= c <= "9")
    if kind == 0:
        return bool(_SPELLED.fullmatch(found))
    if kind == 1:
        parts = _NUMBER_PARTS.findall(found)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not any(c.isalpha() for c in found)
    if any(c.isalpha() for c in found) or not digits:
        return False
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and len(_NUMBER_PARTS.findall(found)) >= 3


def all_spans(texts: list[str], tagger: Tagger | None) -> tuple[list[list[tuple]], list[list[tuple]]]:
    """Base and added spans of each text."""
    base = [sorted(base_spans(t)) for t in texts]
    added: list[list[tuple]] = [[] for _ in texts]
    if tagger is None:
        return base, added
    where = [(i, lo, hi) for i, t in enumerate(texts) for lo, hi in regions(t)]
    coded = [symbols(texts[i][lo:hi]) for i, lo, hi in where]
    for (i, lo, _), tags in zip(where, region_tags(tagger, coded)):
        if tags.any():
            for kind, a, b in _spans_of(tags, lo):
                while b > a and texts[i][b - 1] in " \n.,;:":
                    b -= 1
                while a < b and texts[i][a] in " \n.,;:":
                    a += 1
                if a < b and not any(a < e and s < b for _, s, e in base[i]) and plausible(kind, texts[i][a:b]):
                    added[i].append((kind, a, b))
    return base, added


# --- training spans ------------------------------------------------------------------------------


def _variant(kind: int, rng: np.random.Generator) -> str:
    """A span of a kind in one of the written forms, the patterns' own among them."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    pick = lambda *x: x[rng.integers(len(x))]
    if kind == 0:
        at, dot = pick(("@", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("@", "."))
        return word() + pick("", "." + d(2), "_" + word()) + at + word() + dot + pick("", word() + dot) + pick("com", "org", "net", "io")
    if kind == 1:
        return pick(".", ".", "[.]", " . ", "-").join(str(x) for x in rng.integers(1, 256, 4))
    if kind == 2:
        sep = pick("", " ", "-", ".", "/")
        return sep.join(d(4) for _ in range(4)) if sep or rng.random() < 0.8 else d(15)
    a, b, c = d(3), d(3), d(4)
    return pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{d(2)} {a} {b} {c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}")


def _decoy(rng: np.random.Generator) -> str:
    """Digits that are no personal data."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    forms = (lambda: d(4), lambda: d(1) + "." + d(1), lambda: f"20{d(2)}-{d(2)}-{d(2)}", lambda: "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, 40)),
             lambda: d(2) + ":" + d(2), lambda: "v" + d(1) + "." + d(1) + "." + d(1), lambda: d(2) + "%", lambda: d(3) + "," + d(3), lambda: d(10))
    return forms[rng.integers(len(forms))]()


def training_windows(texts: list[str], count: int = SAMPLE_WINDOWS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows of symbols and tags: regions with the patterns' spans as they stand, and the same with spans rewritten or replaced by decoys."""
    rng = np.random.default_rng(seed)
    found = [(t, [s for s in base_spans(t)], r) for t in texts for r in regions(t)]
    ids, tags = np.full((count, WINDOW), PAD, dtype=np.int64), np.zeros((count, WINDOW), dtype=np.int64)
    if not found:
        return ids[:0], tags[:0]
    for k in range(count):
        text, spans, (lo, hi) = found[rng.integers(len(found))]
        inside = [s for s in spans if lo <= s[1] and s[2] <= hi]
        if k % 4:
            at = inside[rng.integers(len(inside))] if inside else (0, (lo + hi) // 2, (lo + hi) // 2)
            kind = int(rng.integers(-1, 4))
            put = _decoy(rng) if kind < 0 else _variant(kind, rng)
            before, after = text[max(0, at[1] - 40) : at[1]], text[at[2] : at[2] + 40]
            if at[1] == at[2]:
                before, after = before.rstrip() + " ", " " + after.lstrip()
            piece = before + put + after
            marked = [(kind, len(before), len(before) + len(put))] if kind >= 0 else []
            marked += base_spans_apart(before, 0) + base_spans_apart(after, len(before) + len(put))
        else:
            piece, marked = text[lo:hi], [(s[0], s[1] - lo, s[2] - lo) for s in inside]
        shift = int(rng.integers(0, max(1, len(piece) - WINDOW + 1)))
        x = symbols(piece)[shift : shift + WINDOW]
        ids[k, : len(x)] = x
        for kind, a, b in marked:
            a, b = a - shift, b - shift
            tags[k, max(0, a) : max(0, b)] = 2 + 2 * kind
            if 0 <= a < WINDOW:
                tags[k, a] = 1 + 2 * kind
    return ids, tags


def base_spans_apart(text: str, shift: int) -> list[tuple[int, int, int]]:
    return [(k, a + shift, b + shift) for k, a, b in base_spans(text)]


def fit_private(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Tagger | None:
    """Network from at most ``sample_docs`` whole texts with a digit or an at sign, those whose ids hash lowest; None where there is no such text."""
    some = docs.filter(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]"))
    ids = sample_by_hash(some.select("doc_id").distinct(), sample_docs)
    texts = sorted(r["text"] for r in with_labels(some, ids, ("doc_id", "text")).select("text").toLocalIterator())
    ids, tags = training_windows(texts)
    return fit_tagger(ids, tags) if len(ids) else None


def find_private(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """Per row the spans of the patterns and the added ones: ``base`` and ``added`` are arrays of (kind, start, end) in code points, end exclusive; NULL texts have none."""

    def found(texts: list[str]) -> dict:
        base, added = all_spans(texts, tagger)
        shape = lambda spans: [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in s] for s in spans]
        joined = lambda s: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(s))
        return {
            "base": shape(base),
            "added": shape(added),
            "base_sha256": [hashlib.sha256(joined(s).encode()).hexdigest() for s in base],
            "spans": [joined([*a, *b]) for a, b in zip(base, added)],
        }

    span = 'array<struct<kind: string, start: bigint, `end`: bigint>>'
    return map_texts(docs, found, f"base {span}, added {span}, base_sha256 string, spans string")


def op2_private_data(spark, sf_dir: str) -> DataFrame:
    """Counts and digest of the patterns' spans and all spans of every document."""
    docs = table(spark, sf_dir, "documents")
    found = find_private(docs, fit_private(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], "base_sha256", "spans", F.size("added").cast("long").alias("n_added"))
