"""Plain versions of the corpus operators, for small inputs."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

BLANK = re.compile("[^\x20\x09-\x0d]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, width):
    w = BLANK.findall(lower(t))
    return [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []


def contained(docs, items, threshold=0.8):
    out = Counter()
    for d, t in docs:
        for i, s in items:
            want = set(shingles(s, 5))
            if not want:
                continue
            n = len(next(iter(want)).split(" "))
            share = len(want & set(shingles(t, min(5, n)))) / len(want)
            if share >= threshold - 1e-12:
                out[(d, i)] += 1
    return out


def quality(t):
    t = t or ""
    w = BLANK.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if BLANK.search(line):
            dup += line in seen
            seen.add(line)
    threes = Counter(zip(w, w[1:], w[2:]))
    hit = {k for i in range(len(w) - 2) if threes[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)


def secrets(t):
    found = sorted((m.start(), k, name, m.end()) for k, (name, p, g, least) in enumerate(KINDS) for m in re.finditer(p, t or "") if len(m[g]) >= least)
    text = ",".join(f"{n}:{a}:{b}" for a, _, n, b in found)
    c = Counter(n for _, _, n, _ in found)
    return c["assign"], c["access"], c["hex"], hashlib.sha256(text.encode()).hexdigest(), text


def repeats(docs, length=100):
    seen, out = set(), []
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0], x[1] or "")):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(b[p : p + length])
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        out.append((d, len(b), int(gone.sum()), int(starts.sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def simhash(t):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(t, 3)]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def classes(docs, budget=2):
    fps = [(d, simhash(t)) for d, t in docs]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= budget:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, f"{f:016x}", least.get(find(i))) for i, (d, f) in enumerate(fps))


def licenses(t, templates, threshold):
    low = lower(t)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall(low)
    starts, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    every, best = set(labels), 0.0
    for line in low.split("\n"):
        for label, text in templates:
            own = set(text.split())
            share = len(own & set(word.findall(line))) / len(own)
            if share >= threshold - 1e-12:
                every.add(label)
                best = max(best, share)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), 1.0 if starts else best
