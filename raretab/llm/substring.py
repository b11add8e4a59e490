"""Substring dedup by seed and extend.

Seeds: every ``window`` of words picks the least hash of the word ``gram``s in
it (winnowing), so equal windows pick equal seeds.  Consecutive windows that
pick one and the same place form a run; a run with all the words its windows
cover is a block, the seed extended as far as that seed reaches to both sides.
Documents are joined on seeds that occur twice or more.  Blocks that are equal
as a whole are repeats at once; where blocks of one seed differ, the extension
stops inside them, and their windows are compared one by one, one block of each
kind standing for its copies.  Equal blocks met in one batch leave the task as
one row with its further places.  Covered words of all repeated windows merge into
maximal repeats.

Joins are on (seed, block) or (seed, window) keys against grouped counts; no
group is expanded into pairs and a hot seed is pre-aggregated or split by the
join.  Texts move once, keyed by document.

Rows are told apart by a 64-bit hash of id and text; equal rows share their
result, each counting as an occurrence.

Edge cases: null or blank text has no words and an empty result; texts shorter
than the window are never touched; repeated rows repeat each other's windows;
an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raretab.llm._common import (
    Powers,
    mix64,
    range_hashes,
    sliding_min,
    stage,
    text_blocks,
    word_hashes,
    word_spans,
)

GRAM = 8                    # words of a seed
LETTERS, WORDS = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def seed_runs(h: np.ndarray, first: np.ndarray, window: int, gram: int,
              words: Powers) -> tuple[np.ndarray, ...]:
    """Runs of windows with one seed place, over a block of rows whose word
    hashes are ``h``: seed, block hash, row, first window (from the row's
    start), number of windows."""
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if len(h) < window:
        return none
    at = np.arange(len(h) - gram + 1)
    grams = range_hashes(h, at, at + gram, words)
    least = sliding_min(grams, window - gram + 1)
    count = np.maximum(np.diff(first) - window + 1, 0)
    rows = np.flatnonzero(count)
    if not len(rows):
        return none
    n = count[rows]
    start = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(n, out=start[1:])
    valid = np.arange(start[-1]) + np.repeat(first[rows] - start[:-1], n)   # window -> its first word
    m = least[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (m[1:] != m[:-1]) | (grams[valid[1:] - 1] == m[1:])
    new[start[:-1]] = True
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(valid)))
    row = rows[np.searchsorted(start, begin, side="right") - 1]
    word = valid[begin]
    return m[begin], range_hashes(h, word, word + size + window - 1, words), row, word - first[row], size


def _emit_runs(window: int, gram: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, words = Powers(LETTERS), Powers(WORDS)
        for batch in batches:
            keys = batch.column("row_key").to_numpy()
            for lo, _, data, off in text_blocks(batch.column("text")):
                h, _, _, first = word_hashes(data, off, letters)
                seed, block, row, begin, size = seed_runs(h, first, window, gram, words)
                kind, at, weight = np.unique(block, return_inverse=True, return_counts=True)
                order = np.argsort(at, kind="stable")               # equal blocks side by side
                head = np.concatenate([[0], np.cumsum(weight)])
                one = order[head[:-1]]
                more = np.delete(order, head[:-1])
                key, begin = keys[lo + row], begin.astype(np.int32)
                others = pa.ListArray.from_arrays(
                    pa.array((head - np.arange(len(head))).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(key[more]), pa.array(begin[more])], ["row_key", "begin"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mix64(seed[one]).view(np.int64)), pa.array(kind.view(np.int64)), pa.array(key[one]),
                     pa.array(begin[one]), pa.array(size[one].astype(np.int32)), pa.array(weight.astype(np.int64)), others],
                    ["seed", "block", "row_key", "begin", "n", "weight", "others"])
    return runs


def _emit_windows(window: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, words = Powers(LETTERS), Powers(WORDS)
        for batch in batches:
            keys, spans = batch.column("row_key").to_numpy(), batch.column("runs")
            for lo, hi, data, off in text_blocks(batch.column("text")):
                h, _, _, first = word_hashes(data, off, letters)
                mine = spans[lo:hi]
                run = mine.flatten()
                row = np.repeat(np.arange(hi - lo), mine.value_lengths().to_numpy(zero_copy_only=False))
                begin, n, seed, weight = (run.field(k).to_numpy() for k in ("begin", "n", "seed", "weight"))
                which = np.repeat(np.arange(len(row)), n)
                step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                at = begin[which] + step
                word = first[row[which]] + at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed[which]), pa.array(range_hashes(h, word, word + window, words).view(np.int64)),
                     pa.array(keys[lo + row[which]]), pa.array(at.astype(np.int32)), pa.array(weight[which])],
                    ["seed", "window", "row_key", "begin", "weight"])
    return windows


def _remove(window: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            words, removed, kept = [], [], []
            for lo, hi, data, off in text_blocks(batch.column("text")):
                begin, _, first = word_spans(data, off)
                mine = spans[lo:hi].fill_null([])
                run = mine.flatten()
                row = np.repeat(np.arange(hi - lo), mine.value_lengths().to_numpy(zero_copy_only=False))
                change = np.zeros(len(begin) + 1, np.int64)
                at = first[row] + run.field("begin").to_numpy()
                np.add.at(change, at, 1)
                np.add.at(change, at + run.field("n").to_numpy() + window - 1, -1)
                stay = np.cumsum(change[:-1]) == 0
                raw = data.tobytes()
                for a, b, x, y in zip(off[:-1], off[1:], first[:-1], first[1:], strict=True):
                    w, keep = raw[a:b].split(), stay[x:y]
                    words.append(len(w))
                    gone = len(w) - int(np.count_nonzero(keep))
                    removed.append(gone)
                    kept.append(b" ".join([v for v, k in zip(w, keep.tolist(), strict=True) if k] if gone else w))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])
    return remove


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = 35,
                   gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (words in no
    repeated window, joined by one space)."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                        F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit(""))).alias("row_key"))
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def runs() -> DataFrame:
        return texts.select("row_key", "text").mapInArrow(
            _emit_runs(window, gram), "seed long, block long, row_key long, begin int, n int, weight long, "
            "others array<struct<row_key: long, begin: int>>")

    again = runs().groupBy("seed").agg(F.sum("weight").alias("_c")).where("_c > 1").select("seed")
    shared = stage(runs().join(again, "seed"), "substring-runs")
    blocks = shared.groupBy("seed", "block").agg(F.sum("weight").alias("weight"), F.min(F.struct("row_key", "begin", "n")).alias("r"))
    twice = shared.join(blocks.where("weight > 1").select("seed", "block"), ["seed", "block"])
    whole = twice.select("row_key", "begin", "n").union(
        twice.select("n", F.explode("others").alias("o")).select("o.row_key", "o.begin", "n"))

    several = blocks.groupBy("seed").agg(F.count("*").alias("_c")).where("_c > 1").select("seed")
    open_runs = (blocks.join(several, "seed").select("r.row_key", F.struct("r.begin", "r.n", "seed", "weight").alias("run"))
                 .groupBy("row_key").agg(F.collect_list("run").alias("runs")))
    open_windows = (texts.join(open_runs, "row_key").select("doc_id", "text", "row_key", "runs")
                    .dropDuplicates(["row_key"])
                    .mapInArrow(_emit_windows(window), "seed long, window long, row_key long, begin int, weight long"))
    open_windows = stage(open_windows, "substring-windows")
    found = open_windows.groupBy("seed", "window").agg(F.sum("weight").alias("_c")).where("_c > 1").select("seed", "window")
    single = open_windows.join(found, ["seed", "window"]).select("row_key", "begin", F.lit(1).alias("n"))

    spans = (whole.union(single).groupBy("row_key")
             .agg(F.collect_set(F.struct("begin", "n")).alias("spans")))
    return (texts.join(spans, "row_key", "left").select("doc_id", "text", "spans")
            .mapInArrow(_remove(window), f"doc_id {id_type}, n_words long, n_removed long, kept_text string"))
