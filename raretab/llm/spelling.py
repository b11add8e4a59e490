"""Spelling variants: words at edit distance 1, found by pivotal grams.

Bigrams of the vocabulary are ordered by how many words hold them (a table
bounded by the alphabet squared).  A word's prefix is its three rarest bigrams
(one edit breaks at most two), with every bigram as rare as the third; its
pivots are the two disjoint prefix bigrams of least total frequency, chosen by
dynamic programming over positions.  One edit breaks at most one of two disjoint
bigrams, so of two near words the one whose prefix ends rarer has an unbroken
pivot that is in the other's prefix.  Pivots are therefore joined with prefix
bigrams, both ways in one join.

Position limits: the edit lies wholly before or wholly behind an unbroken pivot,
so the pivot keeps its distance from the start, with all text up to its end, or
from the end, with all text from its start.  The part that holds the edit is
halved, and one half is unbroken too.  The join key is the length of the pivot's
word, the position and that unbroken text (about three quarters of a word), so
lists stay short where bigrams are frequent.  Every candidate is verified by its
edit distance.

Words and their counts come from all documents; a form (the near word of largest
count) has at least twice the count, so chains of forms have at most log2(count)
links and are followed by pointer doubling.

Edge cases: null texts have no words; a null id counts as an empty one in the
seed of deletions; repeated rows count again; a word over and over is one word;
equal counts are told apart by code-point order; no words give no rows; only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raretab.llm._common import stage

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_GRAMS = 1 << 17         # bigrams kept on the driver and in every task
PREFIX = 3                  # bigrams broken by one edit, plus one
BATCH = 2000                # words signed at once inside a task


def noisy(run: Column, doc_id: Column, every: int) -> Column:
    """The run, without one code point where ``every`` divides its seed."""
    seed = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (seed % F.length(run)).cast("int")
    return F.when(seed % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def vocabulary(docs: DataFrame, min_length: int = 5, min_count: int = 3, every: int = 97,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): all words of at least ``min_length`` code points and ``min_count`` occurrences."""
    text = F.translate(F.col(text_col), UPPER, LOWER)
    runs = docs.select(F.col(id_col).alias("_id"), F.explode(F.regexp_extract_all(text, F.lit(f"({RUN})"), 1)).alias("_run"))
    words = runs.where(F.length("_run") >= min_length).select(noisy(F.col("_run"), F.col("_id"), every).alias("word"))
    return (words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= min_count))


def gram_counts(words: DataFrame) -> dict[str, int]:
    """Words that hold each bigram; at most the square of the alphabet."""
    grams = words.select(F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr(F.col("word"), i, F.lit(2))))).alias("gram"))
    rows = grams.groupBy("gram").agg(F.count("*").alias("n")).limit(MAX_GRAMS + 1).collect()
    if len(rows) > MAX_GRAMS:
        raise ValueError(f"more than {MAX_GRAMS} different bigrams: this alphabet is too large for the gram order")
    return {r["gram"]: r["n"] for r in rows}


def prefix_of(word: str, rank: Mapping[str, int]) -> tuple[int, list[int]]:
    """Rank of the prefix's last bigram, and its positions in text order."""
    ranks = [rank[word[i:i + 2]] for i in range(len(word) - 1)]
    last = sorted(ranks)[:PREFIX][-1]
    return last, [i for i, r in enumerate(ranks) if r <= last]


def pivots_of(word: str, positions: Sequence[int], counts: Mapping[str, int]) -> tuple[int, int]:
    """Two disjoint positions of least total frequency: while positions are
    read from left to right, the best single pivot that ended before is kept."""
    weight = [counts[word[i:i + 2]] for i in positions]
    best, single, closed = None, None, 0
    for j, p in enumerate(positions):
        while positions[closed] + 2 <= p:
            if single is None or weight[closed] < weight[single]:
                single = closed
            closed += 1
        if single is not None and (best is None or weight[single] + weight[j] < best[0]):
            best = (weight[single] + weight[j], positions[single], p)
    return best[1], best[2]


def part_keys(word: str, at: int, length: int, side: str) -> Iterator[str]:
    """Keys of an unbroken bigram that ends at ``at + 2``, the edit behind it,
    for a pivot's word of ``length``: the first or the second half of what
    follows is unbroken."""
    rest = length - at - 2
    half = rest // 2
    if rest < 0:
        return
    yield f"{side}1 {length} {at} {word[:at + 2 + half]}"
    if half:
        yield f"{side}2 {length} {at} {word[:at + 2]} {word[len(word) - (rest - half):]}"


def word_keys(word: str, positions: Sequence[int], pivot: bool) -> Iterator[str]:
    back = word[::-1]
    lengths = (len(word),) if pivot else (len(word) - 1, len(word), len(word) + 1)
    for p in positions:
        for n in lengths:
            yield from part_keys(word, p, n, "r")
            yield from part_keys(back, len(word) - p - 2, n, "l")


def signatures(words: DataFrame, counts: Mapping[str, int]) -> DataFrame:
    """(word, last, pivots, others): rank of the last prefix bigram, the keys
    of the word's pivots and those of its prefix bigrams."""
    shared = words.sparkSession.sparkContext.broadcast(
        (dict(counts), {g: i for i, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, rank = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                some = batch.column("word").slice(lo, BATCH)
                lasts, pivots, others = [], [], []
                for w in some.to_pylist():
                    last, prefix = prefix_of(w, rank)
                    lasts.append(last)
                    pivots.append(list(word_keys(w, pivots_of(w, prefix, count), pivot=True)))
                    others.append(list(word_keys(w, prefix, pivot=False)))
                strings = pa.list_(pa.string())
                yield pa.record_batch([some, pa.array(lasts, pa.int32()), pa.array(pivots, strings),
                                       pa.array(others, strings)], names=["word", "last", "pivots", "others"])

    return words.select("word").mapInArrow(run, "word string, last int, pivots array<string>, others array<string>")


def near_words(words: DataFrame, counts: Mapping[str, int]) -> DataFrame:
    """(word, near): all ordered pairs of words at edit distance 1."""
    signed = stage(signatures(words, counts), "grams")

    def listed(keys: str, word: str, last: str) -> DataFrame:
        return signed.select(F.explode(F.transform(keys, lambda k: F.xxhash64(k))).alias("key"),
                             F.col("word").alias(word), F.col("last").alias(last))

    pivots, others = listed("pivots", "a", "_la"), listed("others", "b", "_lb")
    pairs = (pivots.join(others, "key").where("_lb >= _la and a <> b and levenshtein(a, b, 1) = 1")
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")),
                                          F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("_p")).select("_p.*")


def roots(links: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): the end of each chain, by pointer
    doubling; rows that have arrived take part as targets only."""
    state = stage(links.select("word", F.col("form").alias("to"), F.lit(False).alias("arrived")), "roots")
    while state.where("not arrived").take(1):
        further = state.select(F.col("word").alias("to"), F.col("to").alias("_to"), F.col("arrived").alias("_arrived"))
        moved = state.where("not arrived").join(further, "to", "left").select(
            "word", F.coalesce("_to", "to").alias("to"), F.coalesce("_arrived", F.lit(True)).alias("arrived"))
        state = stage(state.where("arrived").unionByName(moved), "roots")
    return state.select("word", F.col("to").alias("root"))


def variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, every: int = 97, ratio: int = 2,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    if min_length < 4:
        raise ValueError("two disjoint bigrams among three need words of at least 4 code points")
    words = stage(vocabulary(docs, min_length, min_count, every, id_col, text_col), "words")
    near = near_words(words, gram_counts(words)).join(
        words.select(F.col("word").alias("near"), F.col("n").alias("_m")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"),
                                    F.min(F.struct((-F.col("_m")).alias("_neg"), "near")).alias("_best"))
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("_best._neg") >= F.col("n") * ratio, F.col("_best.near")).alias("form"),
        F.when(-F.col("_best._neg") >= F.col("n") * ratio, -F.col("_best._neg")).alias("form_n"))
    found = stage(found, "forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
