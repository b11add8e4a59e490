"""Exact top-k BM25 search with block-max pruning, shard by shard.

Documents are dealt to shards of bounded size by a hash.  A task builds the
inverted index of all its documents, staged once as one packed row a shard; the
document frequencies, documents and words of these rows are the global
statistics, so scores do not depend on the sharding.  Queries are packed into
chunks of bounded size, and chunks are crossed with shards without a shuffle:
rows are copied for no pair.  A task holds a few chunks and meets its shards one
after another; pairs grow with the square of the input, so tasks take more of
them where there would be more than ``TASKS``.  A pair of some megabytes goes to
Python alone: batches of many would stay in the memory of both sides.

In a shard, documents are cut into blocks of 64 alike in length.  Lists of many
documents (the dense ones) know their largest impact in each block; the lists of
few documents are summed exactly, for all documents that they name.  That sum
and the block maxima of a query's dense lists bound every block's scores (the
block-max WAND bound); blocks are opened by falling bound, and none whose bound
cannot beat the k-th best score so far.  Bounds and the dense lists of opened
blocks are matrix products for many queries at once, in float32; what may
belong to the top k within ``CLOSE`` is scored again in float64.  A square root
of the shards answers first; a query's k-th best score there is its floor in the
others, so the rows to merge grow much slower than queries times shards.  Every
shard returns its exact top k from the floor on, and the k best of those are the
answer.

A query is its whole text: every term weighs tf * idf, terms that only one
document has included.  ``query_terms`` cuts a query to that many terms (largest
idf over the whole text, then tf, then term hash; terms that only one document
has excepted); its result is exact for those terms only.

Scores use float64 in a fixed term order; ties go to the smaller doc_id.  Of
equal texts in a shard only the k smallest doc_ids can be among the k best, so
only they have postings; all count in the statistics.

Edge cases: null or blank texts have no terms, are never found and find
nothing; rows with one query id make one query; repeated documents are each
returned; fewer matches than k give fewer rows; an empty side gives no rows;
only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raretab.llm._common import Powers, stage, stage_path, text_blocks, word_hashes

K1, B = 1.2, 0.75
ALMOST = 1 - 1e-12          # sums in another order may differ in the last bits
CLOSE = 1 - 3e-4            # float32 sums of at most DENSE_LISTS products differ by less
BLOCK = 64                  # documents of a block
GROUP = 8                   # documents of a group, whose best scores bound the k-th best from below
SHARD_BYTES = 8 << 20      # text bytes of a shard
CHUNK_TERMS = 1 << 19       # terms of a chunk of queries
DENSE = 16                  # a dense list names one document in so many
DENSE_LISTS = 1024
CELLS = 1 << 21             # scores (queries times documents) held at once, an eighth of the impacts in the matrix
SUMS = 1 << 16              # postings summed at once
FEW_CHUNKS, MANY_CHUNKS = 2, 8  # chunks of queries that a task of the cross product holds
TASKS = 1 << 13             # most tasks of a cross product
CROSS = {"spark.sql.files.maxPartitionBytes": "128m", "spark.sql.files.openCostInBytes": "128m",    # a file a partition
         "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}        # a pair a batch
LETTERS = 0x9E3779B97F4A7C15
INDEX = "docs long, words long, place binary, length binary, terms binary, held binary, n binary, doc binary, tf binary"


def shard_terms(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, document index) of every word, and the words of each document."""
    letters, terms, docs, length = Powers(LETTERS), [], [], []
    for lo, hi, data, off in text_blocks(arr):
        h, _, _, first = word_hashes(data, off, letters, lower=True)
        terms.append(h)
        length.append(np.diff(first))
        docs.append(np.repeat(np.arange(lo, hi), length[-1]))
    if not terms:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(terms), np.concatenate(docs), np.concatenate(length)


def numbered(term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms (ascending) and the number of each term among them."""
    coded = pa.array(term).dictionary_encode()
    terms = coded.dictionary.to_numpy()
    order = np.argsort(terms)
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return terms[order], number[coded.indices.to_numpy()]


def inverted(term: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms (ascending), and by term and document each posting's term
    number, document and term frequency."""
    terms, key = numbered(term)
    key = key * max(docs, 1) + doc
    key.sort()
    head = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
    tf = np.diff(np.append(head, len(key)))
    code, doc = np.divmod(key[head], max(docs, 1))
    return terms, code, doc, tf


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All positions of the runs ``start .. start + n``, run after run."""
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


class Index:
    """Postings of one shard: for each term documents (ascending) and impacts.
    Blocks are runs of ``BLOCK`` documents, the same for all lists."""

    def __init__(self, arr: pa.Array, mean_length: float) -> None:
        term, doc, length = shard_terms(arr)
        terms, code, doc, tf = inverted(term, doc, len(length))
        self.fill(terms, np.bincount(code, minlength=len(terms)), doc, tf, length, mean_length)

    @classmethod
    def unpack(cls, row: dict, docs: int, mean_length: float) -> Index:
        index = cls.__new__(cls)
        terms = np.frombuffer(row["terms"], np.uint64)
        n = _wide(row["n"], len(terms)).astype(np.int64)
        postings = int(n.sum())
        index.fill(terms, n, _wide(row["doc"], postings), _wide(row["tf"], postings), _wide(row["length"], docs), mean_length)
        return index

    def fill(self, terms: np.ndarray, n: np.ndarray, doc: np.ndarray, tf: np.ndarray, length: np.ndarray,
             mean_length: float) -> None:
        self.terms, self.n, self.doc, self.docs = terms, n, doc, len(length)
        self.start = np.cumsum(n) - n
        norm = K1 * (1 - B + B * length / max(mean_length, 1e-9))
        self.impact = tf * (K1 + 1) / (tf + norm[doc])
        self.blocks = -(-self.docs // BLOCK)
        self.width = self.blocks * BLOCK
        lists = min(DENSE_LISTS, 8 * CELLS // max(self.width, 1))
        dense = np.flatnonzero(n * DENSE >= max(self.docs, 1))
        dense = np.sort(dense[np.argsort(-n[dense], kind="stable")[:lists]])
        self.column = np.full(len(terms), -1)
        self.column[dense] = np.arange(len(dense))
        self.matrix = np.zeros((self.blocks, len(dense), BLOCK), np.float32)
        at = _runs(self.start[dense], n[dense])
        block, place = np.divmod(doc[at], BLOCK)
        self.matrix[block, np.repeat(np.arange(len(dense)), n[dense]), place] = self.impact[at]
        self.maxima = self.matrix.max(axis=2, initial=0).T
        self.by_document: tuple | None = None

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Number of each term's list, -1 for a term that is not here."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def answer(self, query: np.ndarray, terms: np.ndarray, weight: np.ndarray, k: int,
               rank: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Top k of every query (codes 0..) with scores from ``floor[query]``
        on: query, document, score."""
        order = np.lexsort((terms, query))
        return self.best(query[order], self.find(terms[order]), weight[order], k, rank, floor)

    def best(self, query: np.ndarray, lists: np.ndarray, weight: np.ndarray, k: int,
             rank: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``answer`` for ascending queries and list numbers within them."""
        query, weight, lists = (x[lists >= 0] for x in (query, weight, lists))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        step = max(1, min(256, CELLS // max(self.width, 1)))
        edges = np.searchsorted(query, np.arange(0, len(floor) + step, step))
        for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if lo < hi:
                first = i * step
                q, doc, score = self.top(query[lo:hi] - first, lists[lo:hi], weight[lo:hi], k, rank,
                                         floor[first:first + step])
                out.append((q + first, doc, score))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def top(self, query: np.ndarray, lists: np.ndarray, weight: np.ndarray, k: int,
            rank: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Top k of some queries by block-max pruning."""
        column = self.column[lists]
        asked = np.zeros((len(floor), self.matrix.shape[1]), np.float32)
        asked[query[column >= 0], column[column >= 0]] = weight[column >= 0]
        rare = self.rare_sums(*(x[column < 0] for x in (query, lists, weight)), len(floor))
        bound = rare.reshape(len(floor), self.blocks, BLOCK).max(axis=2) + asked @ self.maxima
        limit = np.maximum(floor * CLOSE, np.finfo(np.float32).tiny).astype(np.float32)
        score = np.zeros_like(rare)
        first = np.zeros(bound.shape, bool)
        n = max(4, self.blocks // 8)
        np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, :n], True, axis=1)
        for turn in (first, ~first):
            opened = turn & (bound >= limit[:, None])
            for b in np.flatnonzero(opened.any(axis=0)):
                who = np.flatnonzero(opened[:, b])
                docs = slice(b * BLOCK, (b + 1) * BLOCK)
                score[who, docs] = rare[who, docs] + asked[who] @ self.matrix[b]
            if self.width >= GROUP * k:     # k groups have a document of this score
                best = score.reshape(len(floor), GROUP, -1).max(axis=1)
                limit = np.maximum(limit, np.partition(best, -k, axis=1)[:, -k] * np.float32(CLOSE))
        q, doc = np.divmod(np.flatnonzero(score >= limit[:, None]), self.width)
        near = score[q, doc]
        order = np.lexsort((-near, q))
        at = np.searchsorted(q, np.arange(len(floor))) + k - 1
        more = np.flatnonzero(np.bincount(q, minlength=len(floor)) >= k)
        limit[more] = np.maximum(limit[more], near[order[at[more]]] * np.float32(CLOSE))
        q, doc = q[near >= limit[q]], doc[near >= limit[q]]
        exact = self.scores(q, doc, query, lists, weight)
        keep = exact >= floor[q]
        q, doc, exact = q[keep], doc[keep], exact[keep]
        order = np.lexsort((rank[doc], -exact, q))
        q, doc, exact = q[order], doc[order], exact[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[keep], doc[keep], exact[keep]

    def rare_sums(self, query: np.ndarray, lists: np.ndarray, weight: np.ndarray, queries: int) -> np.ndarray:
        """Sums of the lists that are not dense, queries x documents."""
        out = np.zeros((queries, self.width), np.float32)
        start, n = self.start[lists], self.n[lists]
        ends = np.searchsorted(query, np.arange(queries + 1))
        size = np.append(0, np.cumsum(n))[ends]
        lo = 0
        while lo < queries:
            hi = min(max(int(np.searchsorted(size, size[lo] + SUMS, side="right")) - 1, lo + 1), queries)
            part = slice(ends[lo], ends[hi])
            at = _runs(start[part], n[part])
            key = np.repeat((query[part] - lo) * self.width, n[part])
            key += self.doc[at]
            value = self.impact[at]
            value *= np.repeat(weight[part], n[part])
            out[lo:hi] = np.bincount(key, value, (hi - lo) * self.width).reshape(hi - lo, self.width)
            lo = hi
        return out

    def scores(self, q: np.ndarray, doc: np.ndarray, query: np.ndarray, lists: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores of pairs (ascending queries), summed in the order of the terms."""
        if self.by_document is None:
            order = np.argsort(self.doc, kind="stable")
            n = np.bincount(self.doc, minlength=self.docs)
            self.by_document = np.repeat(np.arange(len(self.terms)), self.n)[order], self.impact[order], np.cumsum(n) - n, n
        term, impact, start, n = self.by_document
        out, weights = np.zeros(len(q)), np.zeros(len(self.terms))
        who, first = np.unique(q, return_index=True)
        for x, lo, hi in zip(who, first, np.append(first[1:], len(q)), strict=True):
            mine = slice(*np.searchsorted(query, (x, x + 1)))
            asked, w = lists[mine], weight[mine]
            weights[asked] = w
            for i in range(lo, hi):
                terms = slice(start[doc[i]], start[doc[i]] + n[doc[i]])
                held, value = term[terms], impact[terms]
                if 8 * len(asked) < len(held):      # a long document: find the few terms in it
                    at = np.minimum(np.searchsorted(held, asked), len(held) - 1)
                    both = held[at] == asked
                    value = w[both] * value[at[both]]
                else:
                    value = weights[held] * value
                out[i] = np.cumsum(value)[-1]
            weights[asked] = 0
        return out


def _narrow(values: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes as the largest takes."""
    most = int(values.max(initial=0))
    return values.astype(next(t for t in ("u1", "u2", "u4", "u8") if most <= np.iinfo(t).max)).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    values = np.frombuffer(raw, f"u{len(raw) // n}" if n else "u1")
    return values if values.dtype.itemsize <= 2 else values.astype(np.int64)


def _places(ids: list) -> np.ndarray:
    """Place of every id in ascending order, null last."""
    place = np.empty(len(ids), np.int64)
    place[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))] = np.arange(len(ids))
    return place


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packed(k: int):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        ids, text = (table.column(c).combine_chunks() for c in ("doc_id", "text"))
        term, doc, length = shard_terms(text)
        place = _places(ids.to_pylist())
        same = text.dictionary_encode().indices.to_numpy()
        order = np.lexsort((place, same))
        copies = np.empty(len(same), np.int64)
        copies[order] = np.arange(len(same)) - np.searchsorted(same[order], same[order])
        asked = (copies < k) & (length > 0)
        order = np.lexsort((place, length, ~asked))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        terms, code, doc, tf = inverted(term, number[doc], len(ids))
        kept = order[:asked.sum()]
        mine = doc < len(kept)
        return pa.table({
            "shard": pa.array([key[0].as_py()], pa.int32()), "ids": _one_list(ids.take(pa.array(kept))),
            "docs": [len(ids)], "words": [int(length.sum())], "place": [_narrow(place[kept])],
            "length": [_narrow(length[kept])], "terms": [terms.tobytes()],
            "held": [_narrow(np.bincount(code, minlength=len(terms)))],
            "n": [_narrow(np.bincount(code[mine], minlength=len(terms)))],
            "doc": [_narrow(doc[mine])], "tf": [_narrow(tf[mine])]})
    return pack


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            terms = np.frombuffer(row["terms"], np.int64)
            held = _wide(row["held"], len(terms)).astype(np.int64)
            for lo in range(0, len(terms), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(terms[lo:lo + (1 << 16)]), pa.array(held[lo:lo + (1 << 16)])],
                                                 ["term", "docs"])


def _chunk(key: tuple, table: pa.Table) -> pa.Table:
    """One row of the queries of a chunk: ids, terms of each, distinct terms
    (ascending), and the number and weight of each query's terms by query and term."""
    coded = table.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
    query = coded.indices.to_numpy().astype(np.int64)
    terms, code = numbered(table.column("term").to_numpy().view(np.uint64))
    order = np.lexsort((code, query))
    return pa.table({
        "chunk": pa.array([key[0].as_py()], pa.int32()), "names": _one_list(coded.dictionary),
        "asked": [_narrow(np.bincount(query, minlength=len(coded.dictionary)))], "distinct": [terms.tobytes()],
        "code": [_narrow(code[order])], "weight": [table.column("weight").to_numpy()[order].tobytes()]})


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters = Powers(LETTERS)
    for batch in batches:
        ids = batch.column("query_id")
        for lo, _, data, off in text_blocks(batch.column("text")):
            h, _, _, first = word_hashes(data, off, letters, lower=True)
            row = np.repeat(np.arange(len(off) - 1), np.diff(first))
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            head = np.flatnonzero(np.concatenate([np.ones(min(len(h), 1), bool), (h[1:] != h[:-1]) | (row[1:] != row[:-1])]))
            tf = np.diff(np.append(head, len(h)))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(lo + row[head])), pa.array(h[head].view(np.int64)), pa.array(tf.astype(np.int64))],
                ["query_id", "term", "tf"])


def cross_tasks(shards: int, chunks: int) -> tuple[int, int]:
    """Partitions of the shards and of the chunks in their cross product."""
    held = min(max(-(-shards * chunks // TASKS), FEW_CHUNKS), MANY_CHUNKS)
    right = min(-(-chunks // held), TASKS)
    return max(1, min(shards, TASKS // right)), right


def cross_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` but for ``CROSS``: the caller's stay as they are."""
    own = spark.newSession()
    for name, value in {**{c: v for c, v in spark.conf.getAll.items() if spark.conf.isModifiable(c)}, **CROSS}.items():
        own.conf.set(name, value)
    return own


def search(docs: DataFrame, queries: DataFrame, k: int = 10, query_terms: int | None = None, text: str = "text",
           doc_id: str = "doc_id", query_id: str = "query_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per hit: query_id, rank (from 1), doc_id, score (a frame of the ``cross_session``)."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_bytes))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(shards)).cast("int"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type, query_type = (x.schema[0].dataType.simpleString() for x in (texts, asked))

    packed = texts.groupBy("shard").applyInArrow(_packed(k), f"shard int, ids array<{id_type}>, {INDEX}")
    index_path = stage_path(packed, "search-index", rows_per_file=1)
    index = docs.sparkSession.read.schema(packed.schema).parquet(index_path)
    n, words = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    mean = words / n if n else 0.0
    df = (index.select("terms", "held").mapInArrow(_held, "term long, docs long")
          .groupBy("term").agg(F.sum("docs").alias("df")))

    wanted = (asked.mapInArrow(_query_terms, f"query_id {query_type}, term long, tf long")
              .groupBy("query_id", "term").agg(F.sum("tf").alias("tf")).join(df, "term"))
    idf = F.log1p((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    wanted = wanted.withColumn("weight", F.col("tf") * idf)
    if query_terms is not None:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("df", F.desc("tf"), "term"))
        wanted = wanted.where("df > 1").withColumn("_n", rank).where(F.col("_n") <= query_terms)
    wanted = stage(wanted.select("query_id", "term", "weight"), "search-queries")
    parts = max(1, -(-wanted.count() // CHUNK_TERMS))
    chunks = (wanted.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).groupBy("chunk")
              .applyInArrow(_chunk, f"chunk int, names array<{query_type}>, asked binary, distinct binary, "
                                    "code binary, weight binary"))
    chunks_path = stage_path(chunks, "search-chunks", rows_per_file=1)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                ids, names = row.pop("ids").values, row.pop("names").values
                row = {c: x.as_py() for c, x in row.items()}
                if shard != row["shard"]:
                    held, shard = Index.unpack(row, len(ids), mean), row["shard"]
                query = np.repeat(np.arange(len(names)), _wide(row["asked"], len(names)))
                lists = held.find(np.frombuffer(row["distinct"], np.uint64))[_wide(row["code"], len(query))]
                floor = np.zeros(len(names))
                for x in row["floors"] or []:
                    floor[x["query"]] = x["floor"] * ALMOST
                query, doc, score = held.best(query, lists, np.frombuffer(row["weight"]), k,
                                              _wide(row["place"], len(ids)).astype(np.int64), floor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(query), row["chunk"], np.int32)), pa.array(query.astype(np.int32)),
                     names.take(pa.array(query)), ids.take(pa.array(doc)), pa.array(score)],
                    ["chunk", "query", "query_id", "doc_id", "score"])

    left, right = cross_tasks(shards, parts)
    cross = cross_session(docs.sparkSession)
    index, chunks = (cross.read.schema(x.schema).parquet(path) for x, path in ((packed, index_path), (chunks, chunks_path)))

    def run(these: Column, asked: DataFrame) -> DataFrame:
        side = index.where(these).drop("docs", "words", "held").coalesce(left)
        return side.hint("shuffle_replicate_nl").crossJoin(asked.coalesce(right)).mapInArrow(
            answer, f"chunk int, query int, query_id {query_type}, doc_id {id_type}, score double")

    place = F.row_number().over(Window.partitionBy("chunk", "query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    head = F.col("shard") % max(1, round(shards ** 0.5)) == 0
    floors = "array<struct<query:int,floor:double>>"
    early = stage(run(head, chunks.withColumn("floors", F.lit(None).cast(floors))), "search-head")
    found = (early.withColumn("rank", place).where(F.col("rank") == k).groupBy("chunk")
             .agg(F.collect_list(F.struct("query", F.col("score").alias("floor"))).alias("floors")))
    late = run(~head, stage(chunks.join(found, "chunk", "left"), "search-floors", rows_per_file=1))
    return (early.union(late).withColumn("rank", place).where(F.col("rank") <= k)
            .select("query_id", "rank", "doc_id", "score"))
