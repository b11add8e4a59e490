"""Plain Python versions of the operators, for small tables."""

import collections
import hashlib
import math
import re

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def lower_ascii(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def grams(text, n):
    w = words(lower_ascii(text))
    if len(w) >= n:
        return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def components(texts, n, num, den):
    """texts: list -> list of component roots (indices); empty sets alone."""
    sets, root = [grams(t, n) for t in texts], list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for j, y in enumerate(sets):
        for i in range(j):
            x = sets[i]
            if x and y and den * len(x & y) >= num * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], sets


def substring(texts, window=35):
    """texts -> (words, removed, kept text) each."""
    all_words, seen = [words(t) for t in texts], collections.Counter()
    for w in all_words:
        seen.update(tuple(w[i:i + window]) for i in range(len(w) - window + 1))
    out = []
    for w in all_words:
        gone = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = b"\1" * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def suffix(rows, length=50):
    """(doc_id, text) -> (bytes, removed, spans, kept) each."""
    key = lambda d: (d is None, d or 0)
    data, first = [(d, (t or "").encode()) for d, t in rows], {}
    for d, b in data:
        for i in range(len(b) - length + 1):
            s = b[i:i + length]
            if s not in first or key(d) < first[s]:
                first[s] = key(d)
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] < key(d):
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")),
                  "card": lambda d=digits: 12 <= len(d) <= 19 and luhn(d),
                  "phone": lambda d=digits: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append((m.start(), k, m.end()))
    out.sort()
    return out, ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in out)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def quality(text):
    w, places, gone = words(text), collections.defaultdict(list), set()
    for i in range(len(w) - 4):
        places[tuple(w[i:i + 5])].append(i)
    for p in places.values():
        if len(p) > 1:
            gone.update(x for i in p for x in range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(gone))


def targets(sizes, weights=(5, 2, 1), most=3):
    """source -> size to source -> target."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    left = float(total)
    while open_:
        scale = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if scale * weight[s] > most * sizes[s]}
        if not full:
            target |= {s: scale * weight[s] for s in open_}
            break
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= full
    return target


def bm25(docs, query_terms, k, k1=1.2, b=0.75):
    """docs: list of texts; query_terms: {word: weight} -> [(score, index)]."""
    split = [(t or "").encode().lower().split() for t in docs]
    mean = sum(map(len, split)) / len(split)
    out = []
    for i, w in enumerate(split):
        tf = collections.Counter(w)
        hit = [t for t in query_terms if tf[t]]
        if hit:
            out.append((sum(query_terms[t] * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(w) / mean)) for t in hit), i))
    return sorted(out, key=lambda x: -x[0])[:k]


def idf(n, df):
    return math.log1p((n - df + 0.5) / (df + 0.5))
