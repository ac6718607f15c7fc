"""Plain versions of what the operators have to return, over small inputs."""

import hashlib
import re
from collections import Counter

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


def removed_words(rows, width=20):
    """rows: (doc_id, text), ids distinct. The places of the words that go."""
    first = {}
    words = {d: words_of(t) for d, t in rows}
    for d in sorted(words):
        for s in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][s : s + width]), (d, s))
    out = {}
    for d, w in words.items():
        gone = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] != (d, s):
                gone.update(range(s, s + width))
        out[d] = gone
    return out


def substring_dedup(rows, width=20):
    out = {}
    texts = dict(rows)
    for d, gone in removed_words(rows, width).items():
        w = words_of(texts[d])
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def base_counts(text):
    text = text or ""
    w = words_of(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def near_classes(rows, width=5):
    """Class of each id: equal words, or m / (n1 + n2 - m) >= 0.8 for m shingles aligned in order."""
    words = {d: tuple(words_of(t)) for d, t in rows}
    parent = {d: d for d in words}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    def link(x, y):
        x, y = sorted((root(x), root(y)))
        parent[y] = x

    first = {}
    for d in sorted(words):
        if words[d]:
            link(first.setdefault(words[d], d), d)
    grams = {d: [w[i : i + width] for i in range(len(w) - width + 1)] for w, d in first.items() if len(w) >= width}
    bags = {d: Counter(g) for d, g in grams.items()}
    ids = sorted(grams)
    for i, x in enumerate(ids):
        for y in ids[i + 1 :]:
            n = len(grams[x]) + len(grams[y])
            if 9 * min(len(grams[x]), len(grams[y])) >= 4 * n and bags[x].keys() & bags[y].keys() and 9 * (bags[x] & bags[y]).total() >= 4 * n:
                if 9 * common_subsequence(grams[x], grams[y]) >= 4 * n:
                    link(x, y)
    return {d: root(d) for d in words}


def chunk_verdict(raw, bands, pack):
    """Full chunks, those outside their band, and whether few enough bytes are in such chunks or in a rest after
    them that is outside the band of its length; a short rest is judged with the bytes before it."""
    ratio = lambda part: len(part) / len(pack.compress(part))
    full = len(raw) // bands.chunk
    bad = sum(not bands.chunks[0] <= ratio(raw[i * bands.chunk : (i + 1) * bands.chunk]) <= bands.chunks[1] for i in range(full))
    rest = raw[full * bands.chunk :]
    outside = bad * bands.chunk
    if full and rest:
        if len(rest) > bands.whole[0][0]:
            low, high = next((lo, hi) for most, lo, hi in bands.whole if len(rest) <= most)
            fits = low <= ratio(rest) <= high
        else:
            fits = bands.chunks[0] <= ratio(raw[-bands.chunk :]) <= bands.chunks[1]
        outside += 0 if fits else len(rest)
    return full, bad, outside <= bands.bad_share * len(raw)
