"""Plain Python versions of what the text operators compute, for small tables."""

import math
import re
import zlib
from collections import Counter

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACES.split(text or "") if w]


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def line_fails(line, phrases):
    w = words(line)
    n = len(w)
    if not n:
        return False
    return (
        len(re.findall(r"[|»›]", line)) >= 3
        or len(re.findall(r"[#*$%&|<>]", line)) > 0.05 * max(1, sum(map(len, w)))
        or len(re.findall(r"[!?]{2,}(?=[\x20\x09-\x0D]|$)", line)) > 0.5 * n
        or (n >= 10 and len(set(w)) < 0.3 * n)
        or (n <= 20 and any(p in line.lower() for p in phrases))
        or (n <= 4 and not re.search(r"[.!?…:;\"'”’»)\]][\x20\x09-\x0D]*$", line))
    )


def keep_clean(docs, phrases):
    out = []
    for i, text in docs:
        kept = [x for x in (text or "").split("\n") if not line_fails(x, phrases)]
        total = sum(map(len, words(text)))
        if not counts(text)[5] and total - sum(len(w) for x in kept for w in words(x)) <= 0.5 * total:
            out.append((i, "\n".join(kept)))
    return out


def dedup_lines(docs, similarity=0.85, least=1):
    earlier, out = [], []
    for i, text in sorted(docs):
        kept = []
        for line in text.split("\n"):
            s = set(words(line.lower()))
            if len(s) >= least:
                hit = any(len(s & o) >= similarity * len(s | o) - 1e-9 for o in earlier)
                earlier.append(s)
                if hit:
                    continue
            kept.append(line)
        out.append((i, "\n".join(kept)))
    return out


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            n = len(a & b)
            if a and b and 100 * n >= 75 * (len(a) + len(b) - n):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in docs}


def test_words(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


test_words.__test__ = False


def overlap(doc, item, least=10):
    """Best score of a stretch on a diagonal that a mask hits."""
    d, t = test_words(doc), test_words(item)
    masks = [(0, 1, 2, 4, 7), (0, 1, 3, 5, 6), (0, 2, 3, 4, 6)]
    seeds = {(m, tuple(t[i + o] for o in mask)): i for m, mask in enumerate(masks) for i in range(len(t) - 7)}
    best = 0
    for m, mask in enumerate(masks):
        for i in range(len(d) - 7):
            j = seeds.get((m, tuple(d[i + o] for o in mask)))
            if j is not None:
                now = 0
                for p in range(len(t)):
                    equal = 0 <= p + i - j < len(d) and d[p + i - j] == t[p]
                    now = max(0, now + (1 if equal else -2))
                    best = max(best, now)
    return best if best >= min(least, math.ceil(len(t) * 0.6)) else 0


def pieces(docs, tokenizer, capacity=2048):
    out = set()
    for i, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.add((i, k, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    return out
