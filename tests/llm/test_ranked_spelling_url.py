"""Ranked lexical search, spelling variants and URL rules against plain
versions, on edge tables, random tables and crafted cases."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from raretab.llm import queries, spelling, treap, urlrules
from raretab.llm.sql import ORACLES
from tests.llm.conftest import EDGE
from tests.oracle_check import canon, duck

LOWER = {i: i + 32 for i in range(65, 91)}


# -------------------------------------------------------------- ranked search

def plain_search(docs, items, k):
    """docs, items: (id, text) -> {item: [(rank, doc, score)]}"""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    split = [(i, collections.Counter(term.findall((t or "").translate(LOWER)))) for i, t in docs]
    n_docs = sum(1 for _, c in split if c)
    total = sum(sum(c.values()) for _, c in split)
    df = collections.Counter(w for _, c in split for w in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(term.findall((t or "").translate(LOWER)))
    out = {}
    for item, words in asked.items():
        hits = []
        for doc, c in split:
            m = 10 + (90 * sum(c.values()) * n_docs) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10 ** 9 * c[w] // (1000 * c[w] + 8 * m))
                    for w in words if w in c)
            if s > 0:
                hits.append((-s, doc is None, doc or 0))
        if hits:
            out[item] = [(r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(hits)[:k])]
    return out


def as_lists(df):
    got = collections.defaultdict(list)
    for r in df.collect():
        got[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    return {i: sorted(x, key=lambda t: t[0]) for i, x in got.items()}


def test_search_on_edge_table(spark, edge, empty):
    docs = [(i, t) for i, t, *_ in EDGE]
    texts = [(1, EDGE[0][1]), (2, "one ONE changed 34 é"), (2, "harbour"), (3, None), (4, "!?"), (None, "la ß x"),
             (5, EDGE[10][1]), (6, "nowhere"), (1, EDGE[0][1])]
    items = spark.createDataFrame(texts, "item_id long, text string")
    want = plain_search(docs, texts, 10)
    assert as_lists(treap.search(edge, items, shard_bytes=3000)) == want
    assert as_lists(treap.search(edge, items, shard_bytes=1 << 20, item_bytes=300)) == want
    assert as_lists(treap.search(edge, items, k=2)) == plain_search(docs, texts, 2)
    assert treap.search(empty, items).count() == 0
    assert treap.search(edge, items.limit(0)).count() == 0


def test_index_written_and_read(spark, edge, tmp_path):
    items = spark.createDataFrame([(7, "lantern boats by heart"), (8, "one"), (9, "mail example 34")], "item_id long, text string")
    treap.index(edge, shard_bytes=20_000).write.parquet(str(tmp_path / "index"))
    table = spark.read.parquet(str(tmp_path / "index"))
    assert table.count() > 1
    got = as_lists(treap.search_index(table, items))
    assert got == as_lists(treap.search(edge, items)) and len(got) == 3


def test_treap_packing_is_exact_and_prunes():
    """Random grids: packing restores every array; the best documents and
    their ties equal an exhaustive sum."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        n, vocabulary = int(rng.integers(1, 900)), int(rng.integers(1, 60))
        skew = rng.dirichlet(np.full(vocabulary, 0.3))
        texts = pa.array([" ".join(f"w{i}" for i in rng.choice(vocabulary, rng.integers(0, 25), p=skew)) for _ in range(n)])
        ids = pa.array(rng.integers(0, n, n))
        t = treap.shard_treap(ids, texts, n, 12 * n)
        again = treap.Treap.unpack(t.pack(), t.doc)
        for name in ("terms", "row", "quarters", "first", "most", "df"):
            assert np.array_equal(getattr(t, name), getattr(again, name))
        asked = np.unique(treap.term_hashes(pa.array([" ".join(f"w{i}" for i in rng.choice(vocabulary, min(vocabulary, 6)))]))[0])
        weights = rng.integers(1, 5, len(asked))
        term, row, length = treap.term_hashes(texts)
        score = np.zeros(n, np.int64)
        for a, w in zip(asked, weights, strict=True):
            tf = np.bincount(row[term == a], minlength=n)
            score += w * treap.impacts(tf, length, n, 12 * n) * (tf > 0)
        order = sorted(range(n), key=lambda i: (-score[i], ids[i].as_py(), i))
        want = [(score[i], ids[i].as_py()) for i in order if score[i] > 0][:7]
        cols, scores = t.best(asked, weights, 7)
        assert [(s, ids[int(t.doc[c])].as_py()) for c, s in zip(cols, scores, strict=True)] == want


def test_one_planted_match_leaves_most_cells_unread(monkeypatch):
    """A document that holds a whole item lifts the floor: few of the ranges are split."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"c{i}" for i in rng.integers(0, 400, 60)) for _ in range(4096)]
    item = "rare1 rare2 rare3 c1 c2"
    texts[1234] += " " + item
    t = treap.shard_treap(pa.array(np.arange(4096)), pa.array(texts), 4096, 60 * 4096)
    asked = np.unique(treap.term_hashes(pa.array([item]))[0])
    seen = []
    child = treap.Treap.child
    monkeypatch.setattr(treap.Treap, "child", lambda self, c, q: seen.append(len(c)) or child(self, c, q))
    weights = np.array([7000 if len(np.flatnonzero(t.terms == a)) and t.df[np.flatnonzero(t.terms == a)[0]] == 1 else 1800 for a in asked])
    cols, _ = t.best(asked, weights, 1)
    assert cols.tolist() == [1234]
    assert sum(seen) < 3 * t.df[t.rows_of(asked)[0]].sum() + 4000


# ----------------------------------------------------------- spelling variants

def plain_variants(docs, min_length=5, min_count=3):
    count = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= min_length:
                count[run] += 1
    count = {w: n for w, n in count.items() if n >= min_count}
    near = {w: {x for x in count if x != w and one_edit(w, x)} for w in count}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 2 * count[w] else None
    out = set()
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, count[w], len(near[w]), count.get(form[w])))
    return out


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i + 1:] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1:]


def test_variants_equal_brute_force(spark):
    """Words over few letters (bigrams repeat inside a word, long chains of
    forms, many ties) and words with accents."""
    rng = random.Random(2)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(5, 9))) for _ in range(150)}
    words |= {"".join(rng.choice("abcéß") for _ in range(rng.randint(5, 7))) for _ in range(150)}
    words |= {"lantern", "lanternn", "lantem", "Lantern", "lanter", "antern", "harbour", "harbor", "hârbour", "aaaaa", "aaaaaa", "aaaaaaa"}
    docs = [(rng.choice([i, i, None]), " ".join(rng.choices(sorted(words), k=60))) for i in range(120)]
    docs += [(5, "lantern " * 400 + "lanter " * 90 + "antern " * 30 + "anter " * 10), (6, None), (7, ""), (8, "x" * 5000 + " " + "y" * 4), docs[0]]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_variants(docs)


def test_variants_on_edge_table(spark, edge, empty):
    got = {tuple(r) for r in spelling.variants(edge).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_variants([(i, t) for i, t, *_ in EDGE])
    assert spelling.variants(empty).count() == 0


def test_every_pair_shares_a_key():
    """All words at one edit from a word: pivots of one meet the other's prefix."""
    rng = random.Random(4)
    for _ in range(200):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(5, 11)))
        i, c = rng.randrange(len(word) + 1), rng.choice("abcde")
        other = rng.choice([word[:i] + c + word[i:], word[:i] + word[i + 1:], word[:i] + c + word[i + 1:]])
        if other == word or len(other) < 5:
            continue
        noise = ["".join(rng.choice("abcde") for _ in range(6)) for _ in range(30)]
        counts = collections.Counter(g for w in [word, other, *noise] for g in {w[i:i + 2] for i in range(len(w) - 1)})
        rank = {g: i for i, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}
        signed = {}
        for w in (word, other):
            last, prefix = spelling.prefix_of(w, rank)
            pivots = spelling.pivots_of(w, prefix, counts)
            assert abs(pivots[0] - pivots[1]) >= 2 and set(pivots) <= set(prefix)
            signed[w] = last, set(spelling.word_keys(w, pivots, True)), set(spelling.word_keys(w, prefix, False))
        assert any(signed[a][1] & signed[b][2] for a, b in ((word, other), (other, word)) if signed[b][0] >= signed[a][0])


# ------------------------------------------------------------------ URL rules

def plain_judge(url, rules, globs, default):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(\?[^#]*)?", url or "")
    host, path, query = (m[1].translate(LOWER), m[2], m[3] or "") if m else ("", "", "")
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = min(fits, key=lambda r: (-len(r.name), r.action != "block"))
        return host, path, best.name, None, best.action
    for action, glob in globs:
        if re.fullmatch(regex(glob), host + path + query, re.S):
            return host, path, None, glob, action
    return host, path, None, None, default


def regex(glob):
    special = {"**": ".*", "*": "[^/?]*", "?": "."}
    return "".join(special.get(t) or re.escape(t[1]) for t in urlrules.tokens(glob))


URLS = ["http://example.com/en/1", "https://www.EXAMPLE.com/en/", "http://notexample.com/en/", "http://a.net/es/x?y#z", "http://net/fr/",
        "http://a.net/ES/x", "x.net/es/", "://net/es/", "http://evil.org/x.net/es/", "http://b?u=.net/es/", "http://ads.org/a", None, "",
        "http://h/a.exe", "http://h/a.exe?x", "http://h/p?sessionid=1", "http://h/sessionid=", "http://a.com", "http://a.com/",
        "http://h/login\nnext", "http://é.net/fr/ß", "a://b://c.net/fr/", "http://h/" + "y" * 30_000 + ".zip", "http://a.net/es/x?y#z"]


def test_rules_on_edge_urls(spark):
    schema = "page_id long, url string, host string, path string, rule string, verdict string, _canonical string, _query string"
    rows = [(i if i % 5 else None, u, *["mine"] * 6) for i, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, schema).repartition(3)
    got = sorted(map(tuple, urlrules.judge(pages, queries.HOST_RULES).collect()), key=repr)
    want = [(r[0], *plain_judge(r[1], queries.HOST_RULES, urlrules.PLAIN_GLOBS, "allow")) for r in rows]
    assert got == sorted(want, key=repr)
    assert urlrules.judge(pages.limit(0), queries.HOST_RULES).count() == 0
    assert {r["verdict"] for r in urlrules.judge(pages, [], [], default="block").collect()} == {"block"}


def test_automaton_equals_regex():
    """Random patterns that fill several mask words and cross their borders."""
    rng = random.Random(9)
    for _ in range(40):
        globs = ["".join(rng.choice(["a", "b", "/", "?", "*", "**", "\\*", "\\?", "é"]) for _ in range(rng.randint(0, 12)))
                 for _ in range(rng.randint(1, 60))]
        texts = ["".join(rng.choice("ab/?*é") for _ in range(rng.randint(0, 9))) for _ in range(80)]
        machine = urlrules.Automaton(globs)
        want = np.array([[bool(re.fullmatch(regex(g), t, re.S)) for g in globs] for t in texts])
        assert np.array_equal(machine.match(texts), want)
    assert machine.match([]).shape == (0, len(globs))


# --------------------------------------------------------- registered queries

@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_spelling_variants", "op13_url_filter"])
def test_query_equals_sql(spark, name):
    from tests.conftest import SF_SMALL
    df = queries.REGISTRY[name](spark, SF_SMALL)
    want = duck(SF_SMALL).sql(ORACLES[name])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(want.columns, want.fetchall())
