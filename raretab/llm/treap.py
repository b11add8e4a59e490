"""Ranked lexical search over K2-treaps of the term-document grid.

Documents stay where they are: every task cuts its input into shards of bounded
text.  A shard is a grid with a row per term and a column per document (columns
by ascending doc_id), a point being the impact of a term in a document.  The
grid is kept as a quadtree: a cell of level j spans 2^j rows and columns, only
non-empty cells exist, and each stores which of its four quarters exist (four
bits; the place of a child is the number of quarters before it) and the largest
impact below it, as the difference from its parent's.  Rows are ordered by
document frequency, so that long lists share cells.

An item follows one row path per term.  A range of documents is bounded by the
sum of the terms' weights times the maxima of the cells on their paths; ranges
are split best first, all paths descending jointly into both halves, and a range
of one document carries its exact score.  Ranges that cannot reach the k-th best
score are given up, so a shard returns its exact k best, and the k best of all
shards are the answer.  Item terms are gathered once, in blocks of bounded size,
with the document frequencies that a counting pass over all documents yields.

Scores are 64-bit integers: w * ((10^9 tf) div (1000 tf + 8 m)) summed over the
item's distinct terms, m = 10 + (90 n N) div L.  Equal scores are ranked by
doc_id, nulls last.

Edge cases: null texts and texts without a term are not counted and never found;
items without terms get no rows; rows that share an item id ask as one item with
the terms of all; repeated documents are returned each; fewer matches than k give
fewer rows; empty tables give no rows; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raretab.llm._common import Powers, range_hashes, text_blocks

SHARD_BYTES = 12 << 20      # text bytes of a shard
ITEM_BYTES = 16 << 20       # item text handled in one pass over the documents
LETTERS = 0x9E3779B97F4A7C15
OPEN_FIRST = 32             # ranges split in a round until k documents are known


def _term_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[48:58] = t[65:91] = t[97:123] = t[128:] = True
    return t


TERM_BYTES = _term_table()


def term_hashes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term hash, row) of every term occurrence, and the terms of each row."""
    letters, terms, rows, length = Powers(LETTERS), [], [], []
    for lo, hi, data, off in text_blocks(arr):
        solid = TERM_BYTES[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True                                # terms never cross rows
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last[:-1] &= ~solid[1:] | edge[1:-1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        terms.append(range_hashes(data, start, end, letters))
        length.append(np.diff(np.searchsorted(start, off)))
        rows.append(np.repeat(np.arange(lo, hi), length[-1]))
    if not terms:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(terms), np.concatenate(rows), np.concatenate(length)


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, occurrences: int) -> np.ndarray:
    big = 90 * documents * int(n.max(initial=0)) >= 1 << 62
    share = (90 * n.astype(object) * documents // occurrences).astype(np.int64) if big else 90 * n * documents // occurrences
    return 1_000_000_000 * tf // (1000 * tf + 8 * (10 + share))


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _interleave(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    def spread(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.uint64)
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                            (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = (x | (x << np.uint64(shift))) & np.uint64(mask)
        return x
    return (spread(row) << np.uint64(1)) | spread(col)


BITS = np.array([bin(i).count("1") for i in range(16)], np.uint8)


@dataclass
class Treap:
    """One shard.  Cells are numbered from the root (1) down, level by level;
    0 stands for an empty cell."""

    terms: np.ndarray       # uint64, sorted hashes
    row: np.ndarray         # uint32, row of each term
    doc: np.ndarray         # column -> row number of the shard's input
    levels: int
    quarters: np.ndarray    # uint8 per cell: which quarters exist (0 for points)
    first: np.ndarray       # uint32 per cell: number of its first child
    most: np.ndarray        # int32 per cell: largest impact (below 10^6)
    df: np.ndarray          # uint32, documents of each term

    @classmethod
    def build(cls, term: np.ndarray, doc: np.ndarray, length: np.ndarray, rank: np.ndarray,
              documents: int, occurrences: int) -> Treap:
        """From term occurrences; ``rank`` lists the shard's rows by doc_id."""
        column = np.empty(len(rank), np.int64)
        column[rank] = np.arange(len(rank))
        terms, row = np.unique(term, return_inverse=True)
        point, tf = np.unique(row * max(len(rank), 1) + column[doc], return_counts=True)
        row, col = point // max(len(rank), 1), point % max(len(rank), 1)
        df = np.bincount(row, minlength=len(terms))
        by_df = np.argsort(-df, kind="stable")
        place = np.empty(len(terms), np.int64)
        place[by_df] = np.arange(len(terms))
        code = _interleave(place[row], col)
        order = np.argsort(code)
        code = code[order]
        most = impacts(tf.astype(np.int64), length[rank][col], documents, occurrences)[order].astype(np.int32)
        levels = int(max(len(terms) - 1, len(rank) - 1, 0)).bit_length()
        masks, maxima = [np.zeros(len(code), np.uint8)], [most]
        for _ in range(levels):
            parent = code >> np.uint64(2)
            head = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])) if len(code) else np.zeros(0, np.int64)
            bit = (np.uint8(1) << (code & np.uint64(3)).astype(np.uint8)).astype(np.uint8)
            masks.append(np.bitwise_or.reduceat(bit, head) if len(head) else bit)
            maxima.append(np.maximum.reduceat(maxima[-1], head) if len(head) else maxima[-1])
            code = parent[head]
        return cls._numbered(terms, place.astype(np.uint32), rank, levels, np.concatenate(masks[::-1]),
                             np.concatenate(maxima[::-1]), df.astype(np.uint32))

    @classmethod
    def _numbered(cls, terms, row, doc, levels, quarters, most, df) -> Treap:
        quarters = np.concatenate([np.zeros(1, np.uint8), quarters])
        children = np.cumsum(BITS[quarters], dtype=np.uint32)
        return cls(terms, row, doc, levels, quarters, children - BITS[quarters] + np.uint32(2),
                   np.concatenate([np.zeros(1, np.int32), most]), df)

    def pack(self) -> dict[str, bytes]:
        """Compressed form: four bits a cell for its quarters, maxima as
        differences from the parent's (mostly zero, so that a Parquet page
        shrinks them)."""
        q = self.quarters[1:]
        even = np.concatenate([q, np.zeros(len(q) % 2, np.uint8)])
        parent = np.repeat(np.arange(len(self.quarters)), BITS[self.quarters])
        lower = self.most[parent] - self.most[2:] if len(q) else np.zeros(0, np.int32)
        return {"terms": self.terms.tobytes(), "row": self.row.tobytes(), "df": self.df.tobytes(),
                "quarters": (even[::2] | (even[1::2] << 4)).astype(np.uint8).tobytes(),
                "top": int(self.most[1]) if len(q) else 0, "cells": len(q), "levels": self.levels,
                "lower": lower.astype(np.uint32).tobytes()}

    @classmethod
    def unpack(cls, packed: dict, doc: np.ndarray) -> Treap:
        two = np.frombuffer(packed["quarters"], np.uint8)
        q = np.stack([two & 15, two >> 4], axis=1).ravel()[:packed["cells"]].astype(np.uint8)
        out = cls._numbered(np.frombuffer(packed["terms"], np.uint64), np.frombuffer(packed["row"], np.uint32),
                            doc, packed["levels"], q, np.zeros(packed["cells"], np.int32),
                            np.frombuffer(packed["df"], np.uint32))
        lower = np.frombuffer(packed["lower"], np.uint32).astype(np.int32)
        if packed["cells"]:
            out.most[1] = packed["top"]
            lo, hi = 1, 2                               # a level at a time: parents come first
            while hi <= packed["cells"]:
                parent = np.repeat(np.arange(lo, hi), BITS[out.quarters[lo:hi]])
                nxt = hi + len(parent)
                out.most[hi:nxt] = out.most[parent] - lower[hi - 2:nxt - 2]
                lo, hi = hi, nxt
        return out

    def child(self, cell: np.ndarray, quarter: np.ndarray) -> np.ndarray:
        mask = self.quarters[cell]
        before = BITS[mask & ((1 << quarter) - 1).astype(np.uint8)]
        return np.where((mask >> quarter) & 1, self.first[cell].astype(np.int64) + before, 0)

    def rows_of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms the shard holds, and their rows."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = np.flatnonzero(self.terms[at] == terms)
        return here, self.row[at[here]].astype(np.int64)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(columns, scores) of the k best documents of at least ``floor``,
        by falling score and then ascending column."""
        here, row = self.rows_of(terms)
        weights = weights[here]
        # open ranges: first column, level, bound; their paths lie side by side in term / cell
        begin, level = np.zeros(1, np.int64), np.array([self.levels])
        term, cell = np.arange(len(row)), np.ones(len(row), np.int64)
        count = np.array([len(row)])
        bound = np.array([int(weights.sum()) * int(self.most[1])]) if len(row) else np.zeros(1, np.int64)
        done_col, done_score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        opened = OPEN_FIRST
        if not len(row):
            return done_col, done_score
        while len(bound):
            ready = level == 0                          # one document: the bound is its score
            done_col = np.concatenate([done_col, begin[ready]])
            done_score = np.concatenate([done_score, bound[ready]])
            top = np.lexsort((done_col, -done_score))[:k]
            done_col, done_score = done_col[top], done_score[top]
            keep = ~ready & (bound >= floor)
            if len(top) == k and done_score[-1] >= floor:
                floor = int(done_score[-1])             # an equal score must come from a smaller column
                keep &= (bound > floor) | ((bound == floor) & (begin < done_col[-1]))
                opened *= 2
            chosen = np.flatnonzero(keep)
            if not len(chosen):
                break
            if len(chosen) > opened:
                chosen = chosen[np.lexsort((begin[chosen], -bound[chosen]))[:opened]]
            split = np.zeros(len(bound), bool)
            split[chosen] = True
            paths = np.repeat(split, count)
            rest = np.repeat(keep & ~split, count)
            of = np.repeat(np.arange(len(bound)), count)[paths]
            t, c = term[paths], cell[paths]
            down = level[of] - 1
            quarter = ((row[t] >> down) & 1) * 2
            left, right = self.child(c, quarter), self.child(c, quarter + 1)
            half = np.concatenate([of * 2, of * 2 + 1])
            t, c = np.concatenate([t, t]), np.concatenate([left, right])
            some = c > 0
            half, t, c = half[some], t[some], c[some]
            order = np.argsort(half, kind="stable")
            half, t, c = half[order], t[order], c[order]
            head = np.flatnonzero(np.concatenate([[True], half[1:] != half[:-1]])) if len(half) else np.zeros(0, np.int64)
            made = half[head]
            more = np.add.reduceat(weights[t] * self.most[c], head) if len(head) else np.zeros(0, np.int64)
            stay = keep & ~split
            lower = level[made // 2] - 1
            begin = np.concatenate([begin[stay], begin[made // 2] + ((made & 1) << lower)])
            level = np.concatenate([level[stay], lower])
            bound = np.concatenate([bound[stay], more])
            term, cell = np.concatenate([term[rest], t]), np.concatenate([cell[rest], c])
            count = np.concatenate([count[stay], np.diff(np.append(head, len(half)))])
        good = done_score >= max(floor, 1)
        return done_col[good], done_score[good]


def shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of consecutive rows with about ``shard_bytes`` of text; one
    row may be larger."""
    ids: list[pa.Array] = []
    texts: list[pa.Array] = []
    held = 0
    for b in batches:
        for lo, hi, data, _ in text_blocks(b.column(1), min(shard_bytes, 1 << 20)):
            ids.append(b.column(0).slice(lo, hi - lo))
            texts.append(b.column(1).slice(lo, hi - lo))
            held += len(data)
            if held >= shard_bytes:
                yield pa.concat_arrays(ids), pa.concat_arrays([t.cast(pa.large_string()) for t in texts])
                ids, texts, held = [], [], 0
    if ids:
        yield pa.concat_arrays(ids), pa.concat_arrays([t.cast(pa.large_string()) for t in texts])


def shard_treap(ids: pa.Array, texts: pa.Array, documents: int, occurrences: int) -> Treap:
    term, doc, length = term_hashes(texts)
    rank = np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)))
    return Treap.build(term, doc, length, rank, documents, max(occurrences, 1))


@dataclass
class Block:
    """Items asked together: for each its terms (places in ``asked``, sorted
    hashes) and all weights; bounded by the text of a block."""

    items: list
    start: np.ndarray
    place: np.ndarray
    asked: np.ndarray
    weights: np.ndarray

    def answer(self, treap: Treap, ids: pa.Array, k: int, floors: np.ndarray) -> pa.RecordBatch:
        """Rows of one shard; ``floors`` keeps each item's k-th best score
        among the shards of this task."""
        item, column, score = [], [], []
        for i in range(len(self.items)):
            place = self.place[self.start[i]:self.start[i + 1]]
            cols, scores = treap.best(self.asked[place], self.weights[place], k, int(floors[i]))
            if len(cols) == k:
                floors[i] = max(floors[i], scores[-1])
            item += [self.items[i]] * len(cols)
            column.append(cols)
            score.append(scores)
        rows = treap.doc[np.concatenate([*column, np.zeros(0, np.int64)]).astype(np.int64)]
        return pa.record_batch([pa.array(item, pa.int64()), ids.take(pa.array(rows, pa.int64())),
                                pa.array(np.concatenate([*score, np.zeros(0, np.int64)]).astype(np.int64))],
                               names=["item", "doc", "score"])


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """The items' distinct terms, in blocks of about ``block_bytes`` of text:
    ids, first pair of each item, term hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            term, row, _ = term_hashes(b.column(1))
            yield pa.record_batch([b.column(0).take(pa.array(row)), pa.array(term.view(np.int64))], names=["item", "term"])

    items = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    for number in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number)
        pairs = part.mapInArrow(run, "item long, term long").distinct().orderBy("item", "term").toArrow()
        if pairs.num_rows:
            coded = pairs["item"].combine_chunks().dictionary_encode(null_encoding="encode")
            owner = coded.indices.to_numpy()
            yield (coded.dictionary.to_pylist(), np.searchsorted(owner, np.arange(len(coded.dictionary) + 1)),
                   pairs["term"].to_numpy().view(np.uint64))


def _summed(counts: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Sums of (place, n): at most one row per asked term, and two."""
    by_place = {r["place"]: r["n"] for r in counts.groupBy("place").agg(F.sum("n").alias("n")).collect()}
    return by_place.pop(-1, 0), by_place.pop(-2, 0), np.array([by_place.get(i, 0) for i in range(size)], np.int64)


def statistics(docs: DataFrame, asked: np.ndarray, text_col: str = "text") -> tuple[int, int, np.ndarray]:
    """Documents with a term, their term occurrences, and the documents that
    hold each of the ``asked`` terms (sorted hashes), over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        df, documents, occurrences = np.zeros(len(terms), np.int64), 0, 0
        for b in batches:
            for lo, hi, _, _ in text_blocks(b.column(0)):
                term, row, length = term_hashes(b.column(0).slice(lo, hi - lo))
                documents, occurrences = documents + int((length > 0).sum()), occurrences + int(length.sum())
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
                    hit = terms[at] == term
                    df += np.bincount(np.unique(at[hit] * len(length) + row[hit]) // len(length), minlength=len(terms))
        held = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(held, [-1, -2]).astype(np.int64)),
                               pa.array(np.append(df[held], [documents, occurrences]).astype(np.int64))], names=["place", "n"])

    return _summed(docs.select(text_col).mapInArrow(run, "place long, n long"), len(asked))


INDEX = ("ids array<long>, documents long, occurrences long, levels int, cells long, top long, "
         "terms binary, row binary, df binary, quarters binary, lower binary")


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per shard with its packed treap, to be written as a table and
    searched by ``search_index`` again and again."""
    documents, occurrences, _ = statistics(docs, np.zeros(0, np.uint64), text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in shards(batches, shard_bytes):
            treap = shard_treap(ids, texts, documents, occurrences)
            packed = treap.pack()
            row = {"ids": ids.take(pa.array(treap.doc)).to_pylist(), "documents": documents, "occurrences": occurrences, **packed}
            names = [c.split()[0] for c in INDEX.split(", ")]
            yield pa.record_batch([pa.array([row[c]], t) for c, t in zip(names, _INDEX_TYPES, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, INDEX)


_INDEX_TYPES = [pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]


def index_statistics(table: DataFrame, asked: np.ndarray) -> tuple[int, int, np.ndarray]:
    """As ``statistics``, from a table made by ``index``."""
    shared = table.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for b in batches:
            for terms, df in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, place, at = np.intersect1d(wanted, np.frombuffer(terms, np.uint64), assume_unique=True, return_indices=True)
                yield pa.record_batch([pa.array(place.astype(np.int64)),
                                       pa.array(np.frombuffer(df, np.uint32)[at].astype(np.int64))], names=["place", "n"])

    _, _, df = _summed(table.select("terms", "df").mapInArrow(run, "place long, n long"), len(asked))
    total = table.agg(F.max("documents"), F.max("occurrences")).first()
    return total[0] or 0, total[1] or 0, df


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score"))


def _ask(items: DataFrame, item_col: str, item_text_col: str, item_bytes: int, count, answer) -> DataFrame:
    """Union of the answers to all blocks of items; ``count`` gives their
    statistics, ``answer`` the best rows of every shard."""
    found = items.sparkSession.createDataFrame([], "item long, doc long, score long")
    for ids, start, term in item_blocks(items, item_col, item_text_col, item_bytes):
        asked, place = np.unique(term, return_inverse=True)
        documents, occurrences, df = count(asked)
        weights = np.array([weight(documents, d) if d else 0 for d in df.tolist()], np.int64)
        keep = weights[place] > 0                       # the others add nothing to a score
        start = np.append(0, np.cumsum(keep))[start]
        found = found.unionByName(answer(Block(ids, start, place[keep], asked, weights), documents, occurrences))
    return found


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = SHARD_BYTES,
           item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item; a
    task builds the treaps of its documents and asks them at once."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def answer(block: Block, documents: int, occurrences: int) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            floors = np.ones(len(shared.value.items), np.int64)
            for ids, texts in shards(batches, shard_bytes):
                yield shared.value.answer(shard_treap(ids, texts, documents, occurrences), ids, k, floors)

        return docs.mapInArrow(run, "item long, doc long, score long")

    return _ranked(_ask(items, item_col, item_text_col, item_bytes, lambda asked: statistics(docs, asked), answer), k)


def search_index(table: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id",
                 item_text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """As ``search``, over a table made by ``index``."""
    def answer(block: Block, documents: int, occurrences: int) -> DataFrame:
        shared = table.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            floors = np.ones(len(shared.value.items), np.int64)
            for b in batches:
                for row in b.to_pylist():
                    ids = pa.array(row["ids"], pa.int64())
                    yield shared.value.answer(Treap.unpack(row, np.arange(len(ids))), ids, k, floors)

        return table.mapInArrow(run, "item long, doc long, score long")

    return _ranked(_ask(items, item_col, item_text_col, item_bytes, lambda asked: index_statistics(table, asked), answer), k)
