"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 1- to 3-grams of lower-cased letters per language inside
the tasks (one counter array per task), sums them in one small shuffle and
leaves a languages x bins log-probability matrix, which is broadcast (its size
is ``languages * n_bins * 4`` bytes whatever the corpus).  Scoring turns a block
of texts into code points, gathers the matrix column of every n-gram and sums
per document with numpy; whole texts are used for both.

Edge cases: null text, or text without a letter, gives ``und`` and score 0;
rows with a null label (or excluded by ``train``) are not learnt from; without
any labelled row every text gives ``und``.  Ties go to the smaller label.
Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raretab.llm._common import BLOCK_BYTES, free_name, raw_text

UNKNOWN = "und"
ORDERS = (1, 2, 3)
N_BINS = 1 << 15


@dataclass
class LanguageModel:
    """Sorted labels and their log-probability matrix (labels x bins + 1; the
    last column is zero and takes the n-grams that cross texts)."""

    labels: list[str]
    log_prob: np.ndarray
    log_prior: np.ndarray


def letter_table() -> np.ndarray:
    """True where a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_bins(texts: list[str], is_letter: np.ndarray, n_bins: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the bin of the n-gram that starts at each code point, the
    first position of each text, and whether each text has a letter.  Texts are
    joined by a zero code point; n-grams that touch one go to bin ``n_bins``."""
    joined = "\0".join(t.replace("\0", " ").lower() for t in texts) + "\0\0\0"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = is_letter[cp]
    ends = np.flatnonzero(cp == 0)[:len(texts)]
    first = np.concatenate([[0], ends[:-1] + 1])
    has = np.add.reduceat(letter, first, dtype=np.int64) > 0
    code = np.where(letter, cp, np.where(cp == 0, 0, 32)).astype(np.uint32)
    shift = np.uint32(32 - int(n_bins).bit_length() + 1)
    bins, n, key, inside = [], len(cp) - 2, np.zeros(len(cp) - 2, np.uint32), np.ones(len(cp) - 2, bool)
    for order in range(1, max(ORDERS) + 1):
        c = code[order - 1:order - 1 + n]
        key = (key + c) * np.uint32(0x9E3779B1)
        key ^= key >> np.uint32(15)
        inside = inside & (c > 0)
        if order in ORDERS:
            h = ((key + np.uint32(order)) * np.uint32(0x85EBCA6B)) >> shift
            bins.append(np.where(inside, h, n_bins).astype(np.int32))
    return bins, first, has


def _python_blocks(arr: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    off, lo = raw_text(arr)[1], 0
    while lo < len(arr):
        hi = min(max(int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1, lo + 1), len(arr))
        yield lo, hi
        lo = hi


def fit(docs: DataFrame, text: str = "text", label: str = "lang", train: Column | None = None,
        n_bins: int = N_BINS, alpha: float = 0.5) -> LanguageModel:
    """Learn from every row with a label and a text (and ``train`` true)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter, seen = letter_table(), {}
        rows: dict[str, int] = {}
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for lo, hi in _python_blocks(batch.column(0)):
                texts, names = batch.column(0)[lo:hi].to_pylist(), labels[lo:hi]
                bins, first, _ = ngram_bins(texts, is_letter, n_bins)
                length = np.diff(np.append(first, len(bins[0])))
                for name in set(names):
                    mine = np.repeat(np.fromiter((x == name for x in names), bool, len(names)), length)
                    c = seen.setdefault(name, np.zeros(n_bins + 1, np.int64))
                    for b in bins:
                        c += np.bincount(b[mine], minlength=n_bins + 1)
                    rows[name] = rows.get(name, 0) + names.count(name)
        for name, c in seen.items():
            at = np.flatnonzero(c[:n_bins])
            yield pa.RecordBatch.from_arrays([
                pa.array([name] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int32()),
                pa.array(np.append(c[at], rows[name]), pa.int64())], ["label", "bin", "n"])

    known = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    if train is not None:
        known = known.where(train)
    sums = (known.select(F.col(text).alias("t"), F.col(label).alias("l"))
            .mapInArrow(count, "label string, bin int, n long")
            .groupBy("label", "bin").agg(F.sum("n").alias("n")).toPandas())
    labels = sorted(sums["label"].unique().tolist())
    counts, rows = np.zeros((len(labels), n_bins)), np.ones(len(labels))
    for i, name in enumerate(labels):
        mine = sums[sums["label"] == name]
        grams, docs_of = mine[mine["bin"] >= 0], mine[mine["bin"] < 0]
        counts[i, grams["bin"].to_numpy()] = grams["n"].to_numpy()
        rows[i] = docs_of["n"].sum()
    log_prob = np.log((counts + alpha) / (counts.sum(axis=1, keepdims=True) + alpha * n_bins))
    return LanguageModel(labels, np.hstack([log_prob, np.zeros((len(labels), 1))]).astype(np.float32),
                         np.log(rows / rows.sum()) if labels else rows)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text",
            label_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Adds the most probable label and its posterior probability to every row;
    columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.log_prob, model.log_prior))

    @F.arrow_udf("struct<label: string, score: double>")
    def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labels, log_prob, log_prior = shared.value
        is_letter, n_bins = letter_table(), log_prob.shape[1] - 1
        for arr in batches:
            out, scores = [], []
            for lo, hi in _python_blocks(arr):
                texts = [t or "" for t in arr[lo:hi].to_pylist()]
                if not labels:
                    out += [UNKNOWN] * len(texts)
                    scores.append(np.zeros(len(texts)))
                    continue
                bins, first, has = ngram_bins(texts, is_letter, n_bins)
                total = np.empty((len(texts), len(labels)))
                for i in range(len(labels)):
                    total[:, i] = log_prior[i]
                    for b in bins:
                        total[:, i] += np.add.reduceat(log_prob[i][b], first, dtype=np.float64)
                best = total.argmax(axis=1)
                post = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                out += [labels[k] if ok else UNKNOWN for k, ok in zip(best, has, strict=True)]
                scores.append(np.where(has, post, 0.0))
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(score, pa.float64())],
                                             ["label", "score"])

    found = free_name("_lang", [*docs.columns, label_out, score_out])
    got = docs.withColumn(found, classify(F.col(text)))
    return (got.withColumn(label_out, F.col(f"{found}.label")).withColumn(score_out, F.col(f"{found}.score"))
            .drop(found))
