"""Every operator against its plain version on a table of edge cases, and on
an empty table."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from raretab.llm import jaccard, langid, mix, pack, pii, quality, search, shard, substring, suffix
from raretab.llm.queries import op1_bm25_search, tokenizer_files
from tests.llm import brute
from tests.llm.conftest import CLASHING, EDGE

NULL_LAST = lambda r: tuple((x is None, x if x is not None else 0) for x in r)


def same(got, want):
    assert sorted(map(tuple, got), key=NULL_LAST) == sorted(map(tuple, want), key=NULL_LAST)


# 1 ------------------------------------------------------------------- search

@pytest.mark.parametrize("query_terms", [None, 5])
def test_search_equals_brute_force(edge, query_terms):
    queries = edge.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    got = collections.defaultdict(list)
    for r in search.search(edge, queries, k=5, query_terms=query_terms, shard_bytes=3000).collect():
        got[r["query_id"]].append((r["rank"], round(r["score"], 8), r["doc_id"]))
    texts = [t for _, t, *_ in EDGE]
    split = [(t or "").encode().lower().split() for t in texts]
    df = collections.Counter(w for s in split for w in set(s))
    for q, text, *_ in EDGE:
        if q is None or q % 20:
            continue
        tf = collections.Counter((text or "").encode().lower().split())
        weight = {w: c * brute.idf(len(texts), df[w]) for w, c in tf.items() if query_terms is None or df[w] > 1}
        if query_terms is not None:
            code = {w: int(search.shard_terms(pa.array([w.decode()]))[0].astype(np.int64)[0]) for w in weight}
            keep = sorted(weight, key=lambda w: (df[w], -tf[w], code[w]))[:query_terms]
            weight = {w: weight[w] for w in keep}
        want = [round(s, 8) for s, _ in brute.bm25(texts, weight, 5)]
        assert [s for _, s, _ in sorted(got[q])] == want
        assert [r for r, _, _ in sorted(got[q])] == list(range(1, len(want) + 1))


def test_registered_search_asks_with_all_terms(spark, tmp_path):
    """A text of unique words finds itself, and documents that share only the
    frequent words of a long query are scored."""
    common = [f"common{i}" for i in range(30)]
    texts = [" ".join(f"only{i}" for i in range(12)), *(" ".join(common[k % 7:k % 7 + 9]) for k in range(1, 20)),
             " ".join(common + [f"rare{i}" for i in range(12)]), " ".join(f"rare{i}" for i in range(12))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = collections.defaultdict(list)
    for r in op1_bm25_search(spark, str(tmp_path)).collect():
        got[r["query_id"]].append((r["rank"], round(r["score"], 8), r["doc_id"]))
    split = [t.encode().split() for t in texts]
    df = collections.Counter(w for s in split for w in set(s))
    assert set(got) == {0, 20}
    for q, hits in got.items():
        weight = {w: c * brute.idf(len(texts), df[w]) for w, c in collections.Counter(split[q]).items()}
        assert [s for _, s, _ in sorted(hits)] == [round(s, 8) for s, _ in brute.bm25(texts, weight, 10)]
    assert got[0][0][2] == 0 and len(got[20]) == 10


def test_block_max_equals_exhaustive():
    """Random texts of few words: lists of many lengths, many ties."""
    rng = np.random.default_rng(3)
    for _ in range(25):
        n, vocabulary = int(rng.integers(1, 700)), int(rng.integers(2, 40))
        skew = rng.dirichlet(np.full(vocabulary, 0.3))
        texts = [" ".join(f"w{i}" for i in rng.choice(vocabulary, rng.integers(0, 30), p=skew)) for _ in range(n)]
        words = [f"w{i}" for i in rng.choice(vocabulary, min(vocabulary, 6), replace=False)]
        weight = rng.integers(1, 9, len(words)) / 4
        mean = sum(len(t.split()) for t in texts) / n
        index = search.Index(pa.array(texts), mean)
        code = search.shard_terms(pa.array([" ".join(words)]))[0]
        _, docs, scores = index.answer(np.zeros(len(words), np.int64), code, weight, 7, np.arange(n), np.zeros(1))
        want = brute.bm25(texts, {w.encode(): x for w, x in zip(words, weight, strict=True)}, n) if mean else []
        want = sorted(((round(s, 9), d) for s, d in want), key=lambda x: (-x[0], x[1]))[:7]
        got = sorted(((round(s, 9), d) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)),
                     key=lambda x: (-x[0], x[1]))[:7]
        assert [s for s, _ in got] == [s for s, _ in want]
        if len(want) < 7 or want[-1][0] < want[-2][0]:
            assert got == want


def test_search_crosses_chunks_and_shards(spark, monkeypatch):
    """Queries of many chunks against many shards, lists above and below the
    dense share, one text in many copies: no shuffle carries queries to shards."""
    monkeypatch.setattr(search, "CHUNK_TERMS", 300)
    rng = np.random.default_rng(8)
    skew = rng.dirichlet(np.full(60, 0.4))
    texts = [" ".join(f"w{i}" for i in rng.choice(60, rng.integers(0, 40), p=skew)) for _ in range(500)]
    texts += ["w1 w2 w3 w59 copy"] * 30 + [None, " "]
    ids = rng.permutation(len(texts)).tolist()
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    hits = search.search(docs, docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text"),
                         shard_bytes=4000)
    plan = hits._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan
    got = collections.defaultdict(list)
    for r in hits.collect():
        got[r["query_id"]].append((r["rank"], r["score"], r["doc_id"]))
    split = [(t or "").encode().split() for t in texts]
    df = collections.Counter(w for s in split for w in set(s))
    for q, words in zip(ids, split, strict=True):
        if q % 20 == 0:
            weight = {w: c * brute.idf(len(texts), df[w]) for w, c in collections.Counter(words).items()}
            all_scores = {ids[d]: s for s, d in brute.bm25(texts, weight, len(texts))}
            want = sorted(all_scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:10]
            assert [r for r, _, _ in sorted(got[q])] == list(range(1, len(want) + 1))
            assert [round(s, 9) for _, s, _ in sorted(got[q])] == [round(s, 9) for _, s in want]
            assert all(round(all_scores[d], 9) == round(s, 9) for _, s, d in got[q])
            copies = [d for _, _, d in sorted(got[q]) if texts[ids.index(d)].endswith("copy")]
            everywhere = sorted(d for d, t in zip(ids, texts, strict=True) if (t or "").endswith("copy"))
            assert copies == everywhere[:len(copies)]


def test_search_tasks_do_not_grow_with_the_square(spark, monkeypatch):
    """Shards and chunks share tasks: 6 GB has 1,230 shards and 92 chunks, a
    task for each pair of them would be 113,160."""
    for shards, chunks in ((1, 1), (21, 2), (103, 8), (1230, 92), (6150, 460), (400_000, 30_000)):
        left, right = search.cross_tasks(shards, chunks)
        assert 1 <= left <= shards and 1 <= right <= chunks and left * right <= search.TASKS
    assert search.cross_tasks(103, 8) == (103, 4)
    monkeypatch.setattr(search, "CHUNK_TERMS", 100)
    monkeypatch.setattr(search, "TASKS", 6)
    texts = [" ".join(f"w{(i * k) % 23}" for k in range(1, 12)) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), "text")
    before = spark.conf.getAll
    hits = search.search(docs, queries, shard_bytes=1500)
    left, right = (int(n) for n in re.findall(r"Coalesce (\d+)", hits._jdf.queryExecution().executedPlan().toString())[-2:])
    assert left * right <= 6
    assert spark.conf.getAll == before and hits.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"
    got = list(map(tuple, hits.collect()))
    monkeypatch.undo()
    assert len(got) == 300
    same(got, search.search(docs, queries).collect())


def test_search_scores_few_documents_exactly(monkeypatch):
    """Whole documents as queries, with a floor: block bounds and float32 sums
    leave few documents to be scored."""
    rng = np.random.default_rng(9)
    skew = 1 / np.arange(1, 3001)
    texts = [" ".join(f"w{i}" for i in rng.choice(3000, 80, p=skew / skew.sum())) for _ in range(1500)]
    index, scored = search.Index(pa.array(texts), 80.0), []
    whole = search.Index.scores
    monkeypatch.setattr(search.Index, "scores", lambda self, q, *x: scored.append(len(q)) or whole(self, q, *x))
    terms = [np.unique(search.shard_terms(pa.array([t]))[0]) for t in texts[:40]]
    query = np.repeat(np.arange(40), [len(t) for t in terms])
    code = np.concatenate(terms)
    q, doc, score = index.answer(query, code, np.ones(len(code)), 5, np.arange(1500), np.zeros(40))
    assert np.bincount(q).tolist() == [5] * 40 and sum(scored) < 40 * 10
    first = np.zeros(40)
    first[q[::5]] = score[::5] * search.ALMOST
    scored.clear()
    again = index.answer(query, code, np.ones(len(code)), 5, np.arange(1500), first)
    assert again[1].tolist() == doc[::5].tolist() and sum(scored) < 50


# 2 ------------------------------------------------------------------ packing

def test_packing_is_exact(edge):
    from tokenizers import Tokenizer
    paths = tokenizer_files()
    tok = Tokenizer.from_file(paths[0])
    tok.encode_special_tokens = True
    got = pack.pack(edge, *paths).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and r["length"] > 0
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], bytes(r["ids"])))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    want = collections.defaultdict(list)
    for d, t, *_ in EDGE:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want[d, len(ids)].append(np.array(ids, "<u4").tobytes())
    assert set(pieces) == set(want)
    for key, parts in pieces.items():
        copies = want[key]
        if len(copies) == 1:
            assert b"".join(x for _, x in sorted(parts)) == copies[0]
        assert sum(len(x) for _, x in parts) == sum(map(len, copies))


def test_cuts_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        pos = np.cumsum(rng.integers(1, 8, n))
        cost = rng.integers(0, 9, n)
        length = 12
        p, c = [0, *pos.tolist()], [0, *cost.tolist()]
        f = [0] + [10**9] * n
        for j in range(1, n + 1):
            f[j] = min(f[i] + length - (p[j] - p[i]) + c[j] for i in range(j) if p[j] - p[i] <= length)
        cuts = pack.best_cuts(pos, cost, length)
        place, paid = 0, 0
        for cut in cuts:
            assert cut - place <= length
            paid += length - (cut - place) + c[p.index(cut)]
            place = cut
        assert place == p[-1] and paid == f[-1]


def test_both_encoders_agree(small):
    by_file, _ = pack.encoder(tokenizer_files()[0], None)
    fast, _ = pack.encoder(*tokenizer_files())
    odd = ["", "<|endoftext|>", "a​中文  \u0085x", "  \n\n\t x", "ŠŽɏ é", "don't we'LL 12ab"]
    for t in [r["text"] or "" for r in small.limit(60).collect()] + odd:
        assert fast(t).tolist() == by_file(t).tolist()


# 3 ----------------------------------------------------------------- source mix

def test_mix_meets_targets(edge):
    got = mix.taken_words(mix.mix(edge)).collect()
    size, total = collections.Counter(), 0
    for _, t, _, s in EDGE:
        size[s] += len(brute.words(t))
        total += len(brute.words(t))
    want = brute.targets(dict(size))
    same([(r["doc_id"], r["size"]) for r in got], [(d, len(brute.words(t))) for d, t, *_ in EDGE])
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by_target = {(r["source_size"], round(r["target"], 6)) for r in got}
    assert by_target == {(size[s], round(x, 6)) for s, x in want.items()}
    assert sum(r["taken"] for r in got) == sum(min(round(x), 3 * size[s]) for s, x in want.items())
    again = mix.taken_words(mix.mix(edge)).collect()
    same([(r["doc_id"], r["size"], r["taken"]) for r in got], [(r["doc_id"], r["size"], r["taken"]) for r in again])


def test_mixed_documents_keep_columns(edge):
    got = mix.mixed_documents(edge)
    assert got.columns == edge.columns
    texts = {(d, t) for d, t, *_ in EDGE}
    seen = collections.Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert set(seen) <= texts
    assert {k for k in texts if not brute.words(k[1])} <= set(seen)     # nothing to take, kept once


def test_mixed_documents_stand_in_scheduled_order(spark):
    """Copies stand where the slot of their first word stands, by a plain
    golden-ratio schedule; copies of a document are not side by side."""
    rows = [(i, " ".join(f"w{j}" for j in range(5 + i % 9)), "abc"[min(i % 10, 2)]) for i in range(300)]
    rows += [(None, "one two three", "a"), (None, "one two four", "b"), (None, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    m = mix.mix(docs)
    total = sum(len(t.split()) for _, t, _ in rows)
    source = {r["_k"]: r for r in m.sources.collect()}
    block = mix.BLOCK_WORDS
    nth, slot_of = collections.Counter(), {}
    for slot in range(-(-total // block)):
        point = slot * mix.GOLDEN % mix.TWO32 / mix.TWO32
        k = next(k for k, r in source.items() if r["_lo"] <= point < r["_hi"])
        slot_of[k, nth[k]] = slot
        nth[k] += 1
    want = []
    for r in m.documents.where("size > 0").collect():
        for epoch in range(3):
            at = epoch * r["source_size"] + r["_start"]
            if at < r["_want"]:
                want.append((slot_of.get((r["_k"], at // block), -(-total // block) + at // block), r["_k"], at, r["doc_id"], r["source"]))
    out = mix.mixed_documents(docs).collect()
    assert [(r["doc_id"], r["source"]) for r in out] == [w[3:] for w in sorted(want, key=lambda w: w[:3])] + [(None, "a")]
    ids = [r["doc_id"] for r in out]
    assert max(collections.Counter(ids[:-1]).values()) > 1 and not any(a == b for a, b in zip(ids, ids[1:]) if a is not None)


def test_blocks_have_one_size(spark, small):
    tiny = spark.createDataFrame([(i, "word " * 100, "ab"[i % 2]) for i in range(6)], "doc_id long, text string, source string")
    assert {mix.mix(d).pieces.agg(F.max("length")).first()[0] for d in (tiny, small)} == {mix.BLOCK_WORDS}


def test_schedule_is_spread(small):
    m = mix.mix(small)
    first = m.pieces.where("position < 2000").groupBy("_k").count().collect()
    share = {r["_k"]: r["_hi"] - r["_lo"] for r in m.sources.collect()}
    slots = m.pieces.where("position < 2000").select("position").distinct().count()
    assert slots > 1500 and len(first) == len([s for s in share.values() if s > 0])


# 4 --------------------------------------------------------------- quality rules

def test_quality_equals_brute_force(edge):
    got = quality.quality(edge)
    assert [c for c in edge.columns if c not in ("kept", "n_words")] == got.columns[:len(edge.columns) - 2]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = got.collect()
    same([(r["doc_id"], *[r[n] for n in names]) for r in out], [(d, *brute.quality(t)) for d, t, *_ in EDGE])
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (r["failed_rule"] is None) and not (r["kept"] and r["base_failed"])


def test_rule_order_does_not_change_verdicts(small):
    stats = quality.text_statistics(small)
    one = {r["doc_id"]: r["kept"] for r in quality.cascade(stats, quality.DEFAULT_RULES).collect()}
    two = {r["doc_id"]: r["kept"] for r in quality.cascade(stats, quality.DEFAULT_RULES[::-1]).collect()}
    assert one == two and len(set(one.values())) == 2


def test_rules_are_ordered_by_rejections_per_cost(small):
    got = quality.order_rules(small)
    gain = [share / seconds for _, share, seconds in got]
    assert gain == sorted(gain, reverse=True) and {r.name for r, _, _ in got} == {r.name for r in quality.DEFAULT_RULES}


# 5 -------------------------------------------------------------------- shards

def test_shards_are_balanced_and_whole(edge):
    got = shard.shard(edge, n_shards=7, bucket_bytes=4000)
    assert set(got.columns) == set(edge.columns)        # its own shard and slot replace the input's
    out = got.collect()
    same([(r["doc_id"], r["text"]) for r in out], [(d, t) for d, t, *_ in EDGE])
    slots = collections.defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r["nested"] == {"a": 1} for r in out)


def test_shards_mix_the_input(small, tmp_path, spark):
    got = shard.shard(small, n_shards=4, bucket_bytes=1 << 16)
    ids = [r["doc_id"] for r in got.orderBy("shard", "slot").select("doc_id").collect()]
    assert ids != sorted(ids) and sorted(ids) == list(range(len(ids)))
    shard.write_shards(got, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ids) and back.select("shard").distinct().count() == 4


def test_equal_rows_spread_over_buckets(spark):
    """Copies without an id do not fall into one bucket, so they do not stand together."""
    rows = [(None, "the same text in every copy")] * 1000 + [(i, f"text number {i} of its own ...") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = shard.shard(docs, n_shards=4, bucket_bytes=4000).collect()
    same([(r["doc_id"], r["text"]) for r in out], rows)
    copies = collections.Counter(r["shard"] for r in out if r["doc_id"] is None)
    assert all(150 <= copies[s] <= 350 for s in range(4))


# 6 ---------------------------------------------------------------- language ID

def test_language_edge_cases(edge):
    model = langid.fit(edge)
    got = langid.predict(edge, model)
    assert set(got.columns) == {*edge.columns, "lang_pred"}
    for r in got.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert 0 <= r["score"] <= 1 and (letters or r["score"] == 0)
        assert r["lang_pred"] in ("und", "en", "fr", "de")


def test_language_held_out_accuracy(spark):
    from tests.conftest import SF_MID
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    got = langid.predict(docs, langid.fit(docs, train=~held)).where(held).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)


def test_language_without_labels(edge):
    model = langid.fit(edge.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.predict(edge, model).collect()} == {"und"}


# 7 ---------------------------------------------------------------- personal data

def test_personal_data_equals_brute_force(edge):
    got = pii.find(edge).select("doc_id", pii.span_string(F.col("base")).alias("s"), pii.span_string(F.col("spans")).alias("x")).collect()
    same([(r["doc_id"], r["s"]) for r in got], [(d, brute.personal(t)[1]) for d, t, *_ in EDGE])
    assert all(set(filter(None, r["s"].split(","))) <= set(r["x"].split(",")) for r in got)


def test_patterns_on_random_text(spark):
    import random
    random.seed(9)
    texts = ["".join(random.choice("ab@.1234567890+-()  %_éßA\n255") for _ in range(random.randrange(70))) for _ in range(1500)]
    texts += ["1" * 30_000, "a" * 30_000 + "@b.c", "1 2-" * 9000, "a@b.c%d@e.f.@g.h 1.2.3.4.5.6.7.8 004.1.255.256"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(docs).select("doc_id", pii.span_string(F.col("base")).alias("s")).collect():
        assert r["s"] == brute.personal(texts[r["doc_id"]])[1]


def test_revealing_terms(spark):
    rows = [(i, f"text {brute.sha(str(i))[:6]} about Zanzibarian who writes from zed@mail.example.org since always {i}") for i in range(6)]
    rows += [(100 + i, f"since always this text has nothing {i} about anything") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["x"] for r in pii.find(docs).select("doc_id", pii.span_string(F.col("spans")).alias("x")).collect()}
    for i, text in rows[:6]:
        at = text.index("Zanzibarian")
        assert f"term:{at}:{at + 11}" in got[i].split(",") and "email:" in got[i]
        assert f"term:{text.index('always')}" not in got[i]      # common elsewhere
    assert all(got[i] == "" for i, _ in rows[6:])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "[TERM]" in clean[0] and "[EMAIL]" in clean[0] and "Zanzibar" not in clean[0] and clean[100] == rows[6][1]


def spans_and_clean(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["x"].split(",") for r in pii.find(docs).select("doc_id", pii.span_string(F.col("spans")).alias("x")).collect()}
    return got, {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}


def test_revealing_terms_far_from_the_entity(spark):
    """A name in the heading, the email in the footer: counted and masked over
    the whole text, every mention."""
    far = "since always this text goes on and on " * 8
    rows = [(i, f"Report of Zanzibarian {far} by zanzibarian, {far}{i} zed@mail.example.org") for i in range(6)]
    rows += [(100 + i, f"{far} nothing {i} report of by mail example org") for i in range(60)]
    got, clean = spans_and_clean(spark, rows)
    for i, text in rows[:6]:
        for at in (text.index("Zanzibarian"), text.index("zanzibarian")):
            assert f"term:{at}:{at + 11}" in got[i]
        assert sum(x.startswith("term:") for x in got[i]) == 2
        assert "anzibar" not in clean[i] and "since always" in clean[i]
    assert all(got[i] == [""] and clean[i] == text for i, text in rows[6:])


@pytest.mark.parametrize("name", ["Kim", "李明", "zed1987", "7", "004217"])
def test_short_names_and_numbers_reveal(spark, name):
    rows = [(i, f"so as to {name} of it {brute.sha(str(i))} from someone.else@mail.example.org") for i in range(6)]
    rows += [(100 + i, f"so as to it of from no one {name}x") for i in range(60)]
    got, clean = spans_and_clean(spark, rows)
    for i, text in rows[:6]:
        at = text.index(f" {name} ") + 1
        assert [x for x in got[i] if x.startswith("term:")] == [f"term:{at}:{at + len(name)}"]
        assert clean[i].startswith("so as to [TERM] of it ")
    assert all(got[i] == [""] and clean[i] == text for i, text in rows[6:])


def plain_disclosure(rows, alpha=0.85, z=1.28):
    """doc_id -> revealing terms, by the rule in plain Python."""
    import math
    import re
    words = {d: {w.lower() for w in re.findall(r"[^\W_]+", t)} for d, t in rows}
    groups = {}
    for d, t in rows:
        for m in re.findall(r"[a-z.]+@[a-z.]+", t):
            for g in (m, "@" + m.split("@")[1], "email"):
                groups.setdefault(g, set()).add(d)
    text, n = dict(rows), len(rows)
    holding = {w: {d for d in words if w in words[d]} for w in set().union(*words.values())}

    def low(both, of):
        hits, misses = len({text[d] for d in both}) - 1, len(of - both)
        if hits <= 0:
            return 0.0
        k = hits + misses
        p = hits / k
        return (p + z * z / 2 / k - z * math.sqrt(p * (1 - p) / k + z * z / 4 / k / k)) / (1 + z * z / k)

    out = {d: set() for d in words}
    for e, docs in groups.items():
        if "@" not in e[1:]:
            continue
        for w, of in holding.items():
            if len(docs & of) < len(of) * (len(docs) / n) ** (1 - alpha):
                continue
            related = [groups[g] for g in (e, "@" + e.split("@")[1], "email")]
            if any(low(g & of, of) >= (len(g) / n) ** (1 - alpha) for g in related):
                for d in docs & of:
                    out[d].add(w)
    return out


def test_disclosure_equals_brute_force(spark):
    """Names beside one or several addresses, of one domain or of several, words
    of one text, common words, copies."""
    import random
    random.seed(4)
    common = [f"w{i}" for i in range(40)]
    rows, n = [], 0
    for _ in range(700):
        body = [random.choice(common) for _ in range(12)]
        if random.random() < 0.2:
            person = random.randrange(25)
            body += [f"{random.choice('abc')}.p{'abcdefghijklmnopqrstuvwxyz'[person]}@dom{'xyz'[person % 3]}.example.org"]
            body += [f"Name{person}"] if random.random() < 0.8 else []
        if random.random() < 0.05:
            body += [f"Name{random.randrange(25)}"]
        if random.random() < 0.2:
            body += [f"once{n}"]
        random.shuffle(body)
        rows.append((n, " ".join(body)))
        n += 1
    rows += [(n + i, rows[i][1]) for i in range(60)]
    want = plain_disclosure(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    got = {r["doc_id"]: {text[r["doc_id"]][s["start"]:s["end"]].lower() for s in r["spans"] if s["k"] == 4}
           for r in pii.find(docs).select("doc_id", "spans").collect()}
    apart = {d: {w for w in ws if f" {w} " in f" {text[d].lower()} "} for d, ws in want.items()}
    assert got == apart
    assert any(w.startswith("name") for ws in got.values() for w in ws)
    assert not any(w.startswith(("once", "w")) for ws in got.values() for w in ws)


def test_terms_of_a_single_text_stay(spark):
    """Nothing is known of a word seen in one text, however often it is copied."""
    rows = [(i, "so Solo wrote to only.one@mail.example.org about it") for i in range(5)]
    rows += [(50 + i, f"so about it to nothing {i % 7} wrote") for i in range(300)]
    got, _ = spans_and_clean(spark, rows)
    assert all(len(got[i]) == 1 and got[i][0].startswith("email:") for i in range(5))


def test_page_of_many_entities(spark):
    """A directory page: entities of equal document sets are counted as one."""
    page = " ".join(f"person{i} p{i}@mail.example.org" for i in range(1500))
    rows = [(0, page), (1, page + " again")] + [(10 + i, f"nothing here {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: len(r["base"]) for r in pii.find(docs).collect()}
    assert got[0] == got[1] == 1500 and got[10] == 0


def test_sanitise_keeps_columns(edge):
    got = pii.sanitise(edge)
    assert got.columns == edge.columns
    out = {(r["doc_id"], r["text"]) for r in got.collect()}
    assert any(d == 40 and "[EMAIL]" in t and "[PHONE]" in t and "[IP]" in t and "[CARD]" in t for d, t in out if t)
    assert (3, None) in out and (None, None) in out and got.count() == len(EDGE)


# 8, 9 --------------------------------------------------------------- repeats

@pytest.mark.parametrize("window,gram", [(35, 8), (12, 5), (9, 9)])
def test_substring_equals_brute_force(edge, window, gram):
    got = substring.remove_repeats(edge, window=window, gram=gram).collect()
    want = brute.substring([t for _, t, *_ in EDGE], window)
    same([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got],
         [(e[0], *w) for e, w in zip(EDGE, want, strict=True)])


@pytest.mark.parametrize("length,gram", [(50, 16), (20, 6)])
def test_suffix_equals_brute_force(edge, length, gram):
    got = suffix.remove_seen(edge, length=length, gram=gram, bucket_bytes=20_000).collect()
    want = brute.suffix([(d, t) for d, t, *_ in EDGE], length)
    same([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got],
         [(e[0], *w) for e, w in zip(EDGE, want, strict=True)])


def test_packed_runs_keep_whole_block_hashes():
    rng = np.random.default_rng(6)
    seed = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    block = np.arange(50, dtype=np.uint64) + (np.uint64(7) << np.uint64(50))     # differ in their low bytes only
    begin, n, row = np.arange(50, dtype=np.int32), np.full(50, 9), rng.integers(0, 8, 50)
    doc, key = np.arange(100, 108), np.arange(-4, 4)
    got = suffix._unpack(suffix._pack(seed, block, begin, n, row, doc, key))
    assert (got[0] >> np.uint64(16) == seed >> np.uint64(16)).all() and (got[1] == block).all()
    for x, want in zip(got[2:], (begin, n, doc[row], key[row])):
        assert (x == want).all()


def test_column_construction_on_random_segments():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n, gram, length = int(rng.integers(2, 30)), 3, 8
        blocks, place = [], []
        for _ in range(n):
            p = int(rng.integers(0, length - gram + 1))
            q = int(rng.integers(length - gram - p, length - gram + 1))
            blocks.append(bytes(rng.integers(97, 99, p).astype(np.uint8)) + b"xyz" + bytes(rng.integers(97, 99, q).astype(np.uint8)))
            place.append(p)
        doc, group = rng.integers(0, 6, n), rng.integers(0, 2, n)
        got = set()
        for hit, at in suffix.equal_windows(group, doc, np.array(place), blocks, length, gram):
            got |= set(zip(hit.tolist(), at.tolist(), strict=True))
        want, first = set(), {}
        places = [(i, s) for i in range(n) for s in range(len(blocks[i]) - length + 1) if s <= place[i] and s + length >= place[i] + gram]
        for i, s in places:
            key = (int(group[i]), blocks[i][s:s + length])
            first[key] = min(first.get(key, 99), int(doc[i]))
        for i, s in places:
            if first[int(group[i]), blocks[i][s:s + length]] < doc[i]:
                want.add((i, s))
        assert got == want


# 10 ----------------------------------------------------------------- Jaccard

@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 80, 100), (1, 50, 100)])
def test_jaccard_equals_brute_force(edge, n, num, den):
    check_jaccard(edge, [(d, t) for d, t, *_ in EDGE], n, num, den)


def check_jaccard(docs, rows, n, num, den):
    root, sets = brute.components([t for _, t in rows], n, num, den)
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    got = jaccard.near_duplicates(docs, n=n, num=num, den=den).collect()
    same([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got],
         [(d, len(s), least.get(r)) for (d, _), s, r in zip(rows, sets, root, strict=True)])


def test_jaccard_many_near_copies(spark):
    """A cluster of edited copies of several sizes around the boundary."""
    rng = np.random.default_rng(2)
    rows = []
    for size in (3, 5, 7, 9, 12, 14, 18, 25, 60, 130):
        base = [f"w{size}_{i}" for i in range(size)]
        for _ in range(14):
            w = list(base)
            for _ in range(int(rng.integers(0, 1 + max(1, size // 12)))):
                w[int(rng.integers(0, size))] = f"e{int(rng.integers(0, 4))}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n, num, den in ((1, 85, 100), (2, 80, 100)):
        check_jaccard(docs, rows, n, num, den)


def test_keep_one(edge):
    got = jaccard.keep_one(edge, n=4, num=85, den=100)
    assert got.columns == edge.columns
    root, sets = brute.components([t for _, t, *_ in EDGE], 4, 85, 100)
    want = {}
    for (d, t, *_), r, s in zip(EDGE, root, sets, strict=True):
        key = ("c", r) if s else ("e", d, t)
        want[key] = min(want.get(key, (True, 0, t)), (d is None, d or 0, t), key=lambda x: x[:2])
    same([(r["doc_id"], r["text"] or "") for r in got.collect()], [(None if z else d, t or "") for z, d, t in want.values()])


# all ------------------------------------------------------------------ empty

@pytest.mark.parametrize("run", [
    lambda d: search.search(d, d.select(F.col("doc_id").alias("query_id"), "text")),
    lambda d: pack.pack(d, *tokenizer_files()),
    lambda d: mix.taken_words(mix.mix(d)),
    lambda d: mix.mixed_documents(d),
    lambda d: quality.quality(d),
    lambda d: shard.shard(d),
    lambda d: langid.predict(d, langid.fit(d)),
    lambda d: pii.find(d),
    lambda d: pii.sanitise(d),
    lambda d: substring.remove_repeats(d),
    lambda d: suffix.remove_seen(d),
    lambda d: jaccard.near_duplicates(d),
    lambda d: jaccard.keep_one(d),
], ids=["search", "pack", "mix", "mixed_documents", "quality", "shard", "langid", "pii", "sanitise", "substring",
        "suffix", "jaccard", "keep_one"])
def test_empty_table(empty, run):
    assert run(empty).collect() == []


def test_clashing_names_are_in_the_fixture(edge):
    assert set(CLASHING) <= set(edge.columns)


def test_large_group_of_near_copies_meets_in_rounds(spark, monkeypatch):
    """A round has at most sets times hubs pairs where several hundred texts
    differ from one another by a few words, and no link is lost."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(240):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 4)):
            words[at] = f"x{rng.integers(0, 40)}"
        texts.append(" ".join(words))
    counts = []
    close = jaccard._close
    monkeypatch.setattr(jaccard, "_close", lambda pairs, sets, t: counts.append(pairs.count()) or close(pairs, sets, t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    want, sets = brute.components(texts, 4, 85, 100)
    assert [got[i] for i in range(len(texts))] == want
    classes = len(set(sets))
    assert len(counts) == jaccard.ROUNDS + 1
    assert all(c <= classes * jaccard.HUBS for c in counts[:-1])


def test_keep_one_leaves_clashing_columns_alone(spark):
    rows = [(1, "a b c d e f", "mine", "his", 7), (2, "a b c d e f", "x", "y", 8), (3, None, "p", "q", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _text_key string, _no_id long")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


# names --------------------------------------------------------------------

@pytest.mark.parametrize("run", [
    lambda d: quality.quality(d), lambda d: pii.sanitise(d), lambda d: jaccard.keep_one(d),
    lambda d: langid.predict(d, langid.fit(d)), lambda d: mix.mixed_documents(d),
], ids=["quality", "sanitise", "keep_one", "langid", "mixed_documents"])
def test_columns_of_scratch_names_pass_through(edge, run):
    own = [c for c in CLASHING if c.startswith("_")]
    got = run(edge)
    assert {*own} <= {*got.columns}
    assert [tuple(r) for r in got.select(*own).distinct().collect()] == [("mine",) * len(own)]


# contract queries against their SQL -----------------------------------------

@pytest.mark.parametrize("name", ["op1_bm25_search", "op4_quality_rules", "op8_substring_dedup", "op9_suffix_dedup",
                                  "op10_jaccard_join"])
def test_queries_equal_their_sql(spark, name):
    from raretab.llm.queries import ORACLES, REGISTRY
    from tests.conftest import SF_SMALL
    from tests.oracle_check import compare, duck
    ok, message = compare(spark, duck(SF_SMALL), name, REGISTRY[name], ORACLES[name], SF_SMALL)
    assert ok, message


def test_mix_exchanges_texts_twice(spark):
    """Texts meet their places in one exchange and are put in order by another
    (before, numbering and joining took one each)."""
    docs = spark.createDataFrame([(i, f"w{i} v{i} u{i}", f"s{i % 3}") for i in range(40)] * 2, "doc_id long, text string, source string")
    plan = mix.mixed_documents(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("_nth" in line for line in joins)


def test_open_pairs_share_several_elements(spark):
    """A pair that shares one rare element only is no candidate; linked pairs stay."""
    base = [f"a{i}" for i in range(60)]
    other = [f"b{i}" for i in range(59)] + ["a0"]
    near = base[:57] + ["x", "y", "z"]
    rows = [(1, 1, " ".join(base)), (2, 2, " ".join(near)), (3, 3, " ".join(other)), (4, 4, " ".join(other[:57] + ["p", "q", "a0"]))]
    texts = spark.createDataFrame(rows, "set_id long, root long, text string")
    got = {tuple(r) for r in jaccard._open_pairs(texts, 1, jaccard.Threshold(80, 100)).collect()}
    assert got == {(1, 2), (3, 4)}


def test_links_within_a_component_are_not_followed_again(spark, monkeypatch):
    """Later links join components; those between sets of one component are gone before the steps."""
    from raretab.llm import _components
    followed, whole = [], _components.components
    root = whole(spark.createDataFrame([(1, i) for i in range(2, 9)] + [(20, 21), (31, 30)], "a long, b long"))
    monkeypatch.setattr(_components, "components", lambda links, tag="cc": followed.append(links.where("a <> b").distinct().count()) or whole(links, tag))
    more = [(a, b) for a in range(2, 9) for b in range(2, 9) if a != b] + [(21, 8), (21, 7), (40, 31), (50, 51)]
    got = {tuple(r) for r in _components.merged(root, spark.createDataFrame(more, "a long, b long")).collect()}
    assert got == {(i, 1) for i in [*range(1, 9), 20, 21]} | {(30, 30), (31, 30), (40, 30), (50, 50), (51, 50)}
    assert followed == [3]


def _open_sets(spark, copies):
    """Texts of one word list with own words: many share rare words, few are linked."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(copies):
        words = [f"w{j}" for j in range(80)]
        for at in rng.integers(0, 80, 12 if i % 10 else 2):
            words[at] = f"own{rng.integers(0, 400)}"
        rows.append((i, i // 2 if i % 3 else i, " ".join(words)))
    rows.append((copies, copies, " ".join(f"w{j}" for j in range(70))))
    return rows, spark.createDataFrame(rows, "set_id long, root long, text string")


@pytest.mark.parametrize("block,cells", [(1 << 11, 1 << 18), (16, 50)])
def test_open_pairs_hold_all_links(spark, monkeypatch, block, cells):
    monkeypatch.setattr(jaccard, "LIST_BLOCK", block)
    monkeypatch.setattr(jaccard, "CELLS", cells)
    rows, texts = _open_sets(spark, 150)
    got = [tuple(r) for r in jaccard._open_pairs(texts, 1, jaccard.Threshold(80, 100)).collect()]
    sets = [(i, r, set(t.split())) for i, r, t in rows]
    linked = {(a, b) for a, ra, u in sets for b, rb, v in sets if a < b and ra != rb and 100 * len(u & v) >= 80 * len(u | v)}
    roots = {i: r for i, r, _ in rows}
    assert len(got) == len(set(got)) and linked and linked <= set(got)
    assert all(a < b and roots[a] != roots[b] for a, b in got)


def test_open_pairs_are_compared_inside_tasks(spark):
    """No join makes the pairs of a list: each joins rows with one row a key."""
    plan = jaccard._open_pairs(_open_sets(spark, 20)[1], 1, jaccard.Threshold(80, 100))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and not any("<" in line or "root" in line for line in joins)
