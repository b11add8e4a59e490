"""The pipeline, stage by stage, against plain versions on the smallest table,
and the registered digests on it."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from raretab.llm import queries
from raretab.llm._common import stage
from tests.conftest import SF_SMALL
from tests.llm import brute


@pytest.fixture(scope="module")
def kept(spark, small):
    """Output of every stage."""
    out, docs = {}, small
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF_SMALL), f"test-{name}")
        out[name] = docs
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.orderBy("doc_id").collect()]


def test_all_but_the_last_keep_the_columns(small, kept):
    for name in list(kept)[:-1]:
        assert kept[name].columns == small.columns


def test_language_keeps_documents_with_letters(small, kept):
    want = {d for d, t in texts(small) if any(c.isalpha() for c in t or "")}
    got = {d for d, _ in texts(kept["language"])}
    assert got <= want and len(got) >= 0.98 * len(want)


def test_one_document_of_each_group_stays(kept):
    rows = texts(kept["language"])
    root, sets = brute.components([t for _, t in rows], 5, 80, 100)
    want = {d for (i, (d, _)), r, s in zip(enumerate(rows), root, sets, strict=True) if r == i or not s}
    assert {d for d, _ in texts(kept["near_duplicates"])} == want


def test_personal_data_is_gone(kept):
    before, after = dict(texts(kept["near_duplicates"])), dict(texts(kept["personal_data"]))
    assert set(before) == set(after)
    for d, t in before.items():
        spans, _ = brute.personal(t)
        if not spans:
            assert after[d] == t        # clean documents are left alone
        else:
            assert not any(k in (0, 1) for _, k, _ in brute.personal(after[d])[0]) and "[" in after[d]


def test_mix_takes_whole_documents_near_the_targets(kept):
    source = {r["doc_id"]: r["source"] for r in kept["personal_data"].collect()}
    before = dict(texts(kept["personal_data"]))
    size, took, longest = collections.Counter(), collections.Counter(), collections.Counter()
    for d, t in before.items():
        n = len(brute.words(t))
        size[source[d]] += n
        longest[source[d]] = max(longest[source[d]], n)
    got = collections.Counter()
    for d, t in texts(kept["source_mix"]):
        assert before[d] == t
        got[d] += 1
        took[source[d]] += len(brute.words(t))
    assert max(got.values()) <= 3
    for s, x in brute.targets(dict(size)).items():
        assert x - 1 <= took[s] <= x + longest[s] + 1


def test_packing_holds_every_token(kept):
    docs = collections.Counter(d for d, _ in texts(kept["source_mix"]))
    got, full = collections.Counter(), {}
    for r in kept["packing"].collect():
        got[r["doc_id"]] += r["length"]
        full[r["doc_id"]] = r["doc_tokens"]
    assert got == {d: n * full[d] for d, n in docs.items()}


def test_digests_on_the_smallest_table(spark, small):
    """The thin queries derive what the contract names."""
    rows = texts(small)
    got = {r["doc_id"]: r for r in queries.op8_substring_dedup(spark, SF_SMALL).collect()}
    for (d, _), (n, gone, kept_text) in zip(rows, brute.substring([t for _, t in rows]), strict=True):
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept_sha256"]) == (n, gone, brute.sha(kept_text))
    got = {r["doc_id"]: r for r in queries.op7_personal_data(spark, SF_SMALL).collect()}
    for d, t in rows:
        spans, text = brute.personal(t)
        assert got[d]["base_sha256"] == brute.sha(text)
        assert [got[d][f"n_{k}"] for k, _ in brute.PATTERNS] == [sum(1 for s in spans if s[1] == k) for k in range(4)]
    got = {r["doc_id"]: r for r in queries.op5_shards(spark, SF_SMALL).collect()}
    for d, t in rows:
        assert (got[d]["size"], got[d]["text_crc32"]) == (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
        assert got[d]["law"] == "rows" and got[d]["grown_shard"] is None and 0 <= got[d]["shard"] < 40
    held = {r["doc_id"]: r["held_out"] for r in queries.op6_language_id(spark, SF_SMALL).collect()}
    assert held == {d: zlib.crc32(str(d).encode()) % 3 == 1 for d, _ in rows}
    got = queries.op2_packing(spark, SF_SMALL).agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert got[0] > 0.97 * 2048 * (got[1] - 4) and np.isfinite(got[0])


def test_registry():
    import __spark_entry__ as entry
    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
