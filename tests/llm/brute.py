"""The operators' results, worked out the plain way."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from fractions import Fraction
from html.parser import HTMLParser

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def components(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def least_ids(ids, roots):
    best = {}
    for i, r in zip(ids, roots, strict=True):
        if i is not None:
            best[r] = min(best.get(r, i), i)
    return [best.get(r, i) for i, r in zip(ids, roots, strict=True)]


def exact_groups(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[folded(t)].append(i)
    out = []
    for i, t in docs:
        group = groups[folded(t)]
        keep = max((x for x in group if x is not None), default=None)
        out.append((i, keep, len(group), i == keep, sha(folded(t))))
    return out


def substring(docs, window=50):
    words = [WORD.findall(t or "") for _, t in docs]
    first = {}
    for (i, _), w in zip(docs, words, strict=True):
        for s in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[s:s + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        covered = [False] * len(w)
        for s in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[s:s + window])] < i:
                covered[s:s + window] = [True] * window
        kept = [x for x, c in zip(w, covered, strict=True) if not c]
        out.append((i, len(w), len(w) - len(kept), sha(" ".join(kept))))
    return out


def shingles(text, k):
    w = WORD.findall(folded(text))
    return {tuple(w[s:s + k]) for s in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard(docs, k=3, similarity=Fraction(9, 10)):
    sets = [shingles(t, k) for _, t in docs]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    ids = [i for i, _ in docs]
    return [(i, len(s), c) for i, s, c in zip(ids, sets, least_ids(ids, components(len(sets), links)), strict=True)]


def usable(vector, label):
    return label is not None and bool(vector) and all(x is not None and np.isfinite(x) for x in vector) and any(vector)


def embeddings(rows, threshold=0.98):
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if usable(v, label) else None for _, v, label in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2]
             and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    count = [0] * len(rows)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    ids = [r[0] for r in rows]
    return [(i, n, c, i == c) for i, n, c in zip(ids, count, least_ids(ids, components(len(rows), links)), strict=True)]


def maximal(turns):
    talks = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            talks[conv].append(((turn is not None, turn or 0), role or "unknown", text or ""))
    whole = {c: [(r, t) for _, r, t in sorted(x)] for c, x in talks.items()}
    out = []
    for c, x in whole.items():
        equal = [d for d, y in whole.items() if y == x]
        if c == min(equal) and not any(len(y) > len(x) and y[:len(x)] == x for y in whole.values()):
            out.append((c, len(x), len(equal), "".join(f"<|im_start|>{r}\n{t.replace('<|', '< |')}<|im_end|>\n" for r, t in x)))
    return out


def hash32(*terms):
    return sum(terms) % (1 << 32)


def bucket(x):
    x = (x ^ x >> 15) * 2246822519 % (1 << 32)
    return x >> 15


def quality(text, table, bias):
    """The mean of the numbers of all words, of their n-grams with a border at both ends, and of each two words in a row."""
    f = [2654435761, 2246822519, 3266489917, 668265263]
    words, found = [], []
    for word in re.findall("[^\0- ]+", text):
        padded = [1, *map(ord, word), 1]
        for n in (2, 3, 4):
            for at in range(len(padded) - n + 1):
                found.append(bucket(hash32(*(c * k for c, k in zip(padded[at:at + n], f)), {2: 0, 3: 3, 4: 7}[n])))
        terms = [(ord(c) * f[2] + at) * f[0] % (1 << 32) for at, c in enumerate(word)]
        words.append(hash32(*((x ^ x >> 13) * f[1] for x in terms)))
    found += [bucket(w) for w in words] + [bucket(hash32(a ^ b, f[3])) for a, b in zip(words, words[1:])]
    return 1 / (1 + np.exp(-(sum(table[x] for x in found) / max(1, len(found)) + bias)))


def repeats(docs, weights, seed=1, epochs=1.0):
    """How often each of (doc_id, text, source) is repeated: a Poisson distribution, inverted at a number made of hashes."""
    weights = {**weights, "*": 1.0}
    group = lambda s: s if s in weights and s != "*" else "*"
    size = defaultdict(int)
    for _, t, s in docs:
        size[group(s)] += len(t or "") + 1
    out = []
    for i, t, s in docs:
        rate = epochs * sum(size.values()) * weights[group(s)] / sum(weights[g] for g in size) / size[group(s)]
        parts = int(np.ceil(max(rate / 16, 1)))
        mean, n = rate / parts, 0
        key = hashlib.md5(f"{seed}/{'' if i is None else i}/{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
        for j in range(1, parts + 1):
            u = int(hashlib.md5(f"{key}/{j}".encode()).hexdigest()[:12], 16) / (1 << 48)
            p = total = np.exp(-mean)
            for k in range(1, 97):
                n += u >= total
                p *= mean / k
                total += p
        out.append(n)
    return out


class _Page(HTMLParser):
    HIDDEN = {"script", "style", "template", "noscript"}
    BREAKS = set("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html body li main nav ol p pre section table td th title tr ul".split())

    def __init__(self):
        super().__init__()
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        self.out += ["\n"] * (tag in self.BREAKS)

    def handle_startendtag(self, tag, attrs):
        self.out += ["\n"] * (tag in self.BREAKS)

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN
        self.out += ["\n"] * (tag in self.BREAKS)

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data.replace("\n", " "))


def page_text(page):
    reader = _Page()
    reader.feed(page)
    reader.close()
    lines = [" ".join(x.split()) for x in "".join(reader.out).split("\n")]
    return "\n".join(x for x in lines if x)


def warc_records(data):
    """(headers, block) of each record, read by their lengths."""
    at = 0
    while at < len(data):
        head, _, rest = data[at:].partition(b"\r\n\r\n")
        headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        size = int(headers["Content-Length"])
        assert rest[size:size + 4] == b"\r\n\r\n"
        yield headers, rest[:size]
        at += len(head) + 8 + size
