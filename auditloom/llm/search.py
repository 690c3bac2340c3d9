"""Ranked lexical search, reversed: documents stream past an inverted index of the items' terms.

The items are the standing queries. Their terms make an inverted index, in blocks of a bounded number
of postings; a block is broadcast. One pass over the texts keeps each document's length and its counts
of terms in the index. From these follow the weights of the terms, and a second pass streams the counts
through the index and updates a heap of the best documents per item. The heaps of all tasks are merged
in two steps. No document meets another, and nothing grows with a term's number of documents.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.llm.common import utf8
from auditloom.operators.persisting import materialize

BEST = 10
#: Postings of a block of items; a single item with more is a block by itself.
POSTINGS = 500_000
#: Documents, scores and postings that a task looks at together.
ROWS = 512
CELLS = 4_000_000
#: Parts in which the heaps of an item are merged first.
SALT = 64
#: What is left of a text's bytes: ASCII letters in lower case, digits, and all of non-ASCII characters.
KEPT = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    return text.translate(KEPT).split()


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) of ``items`` (item_id, text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms(text))) for text in utf8(batch.column("text"))]
            rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(rows, pa.int64())), pa.array([t for f in found for t in f], pa.binary())],
                ["item_id", "term"],
            )

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(read, f"item_id {kind}, term binary").distinct()


def _blocks(postings: DataFrame, most: int) -> int:
    """Number of parts by hash of the item so that none has more than ``most`` postings, or one item."""
    n = max(1, math.ceil(postings.count() / most))
    while True:
        sizes = postings.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).groupBy(_block(n).alias("block"))
        over = sizes.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("items")).filter((F.col("n") > most) & (F.col("items") > 1))
        if over.isEmpty():
            return n
        n *= 2


def _block(n: int) -> Column:
    return F.pmod(F.xxhash64("item_id"), F.lit(n))


@dataclass
class Index:
    """Items and terms of a block by number, and the items of every term: ``items[starts[t]:starts[t + 1]]``."""

    ids: pa.Array
    terms: dict[bytes, int]
    starts: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, postings: pa.Table) -> Index:
        ids = postings.column("item_id").combine_chunks().dictionary_encode("encode")
        found = postings.column("term").to_pylist()
        numbers = {t: i for i, t in enumerate(sorted(set(found)))}
        rows = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
        order = np.argsort(rows, kind="stable")
        starts = np.r_[0, np.cumsum(np.bincount(rows, minlength=len(numbers)))]
        return cls(ids.dictionary, numbers, starts, ids.indices.to_numpy()[order].astype(np.int64))


def _counted(docs: DataFrame, index) -> DataFrame:
    """(doc_id, n, terms, tfs): a document's number of terms, and its counts of the terms in the index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = index.value.terms
        for batch in batches:
            sizes, lengths, found, counts = [], [], [], []
            for text in utf8(batch.column("text")):
                own = terms(text)
                sizes.append(len(own))
                here = [(numbers[t], tf) for t, tf in Counter(own).items() if t in numbers]
                lengths.append(len(here))
                found += [t for t, _ in here]
                counts += [tf for _, tf in here]
            offsets = pa.array(np.r_[0, np.cumsum(lengths, dtype=np.int64)], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, k)) for x, k in ((found, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(read, "doc_id long, n long, terms array<int>, tfs array<bigint>")


def _frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """Number of documents that hold each term of the index; a task sends one row per term at most."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["term", "df"])

    rows = counted.select("terms").mapInArrow(read, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    return out


class Heaps:
    """The best documents of every item so far."""

    def __init__(self, n: int, best: int) -> None:
        self.best, self.rows = best, [[] for _ in range(n)]
        self.least = np.ones(n, np.int64)  # scores that may still enter; 0 never does

    def update(self, scores: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        """``scores``: a row per document, a column per item. Equal scores: lower id first, documents without one last."""
        docs, items = np.nonzero(scores >= self.least)
        if not len(docs):
            return
        order = np.lexsort((ids[docs], ~named[docs], -scores[docs, items], items))
        docs, items = docs[order], items[order]
        starts = np.r_[0, np.flatnonzero(items[1:] != items[:-1]) + 1, len(items)]
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            item = int(items[a])
            heap = self.rows[item]
            for d in docs[a : min(b, a + self.best)].tolist():
                entry = (int(scores[d, item]), bool(named[d]), -int(ids[d]))
                if len(heap) < self.best:
                    heapq.heappush(heap, entry)
                else:
                    heapq.heappushpop(heap, entry)
            if len(heap) == self.best:
                self.least[item] = heap[0][0]


def _best(counted: DataFrame, index, weights: np.ndarray, n_docs: int, n_terms: int, best: int, kind: str) -> DataFrame:
    """(item_id, doc_id, score): the heaps of every task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = index.value
        n_items = len(block.ids)
        degree = np.diff(block.starts)
        heaps = Heaps(n_items, best)
        step = max(1, min(ROWS, CELLS // max(1, n_items), CELLS // max(1, len(block.items))))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                lengths = np.diff(batch.column("terms").offsets.to_numpy())
                term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
                m = np.array([10 + 90 * n * n_docs // n_terms for n in batch.column("n").to_pylist()], np.int64)
                doc = np.repeat(np.arange(batch.num_rows), lengths)
                part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                times = degree[term]
                ends = np.cumsum(times)
                place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times - block.starts[term], times)
                scores = np.zeros(batch.num_rows * n_items, np.int64)
                np.add.at(scores, np.repeat(doc, times) * n_items + block.items[place], np.repeat(part, times))
                ids = batch.column("doc_id")
                heaps.update(
                    scores.reshape(-1, n_items), ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
                )
        held = [(item, *entry) for item, heap in enumerate(heaps.rows) for entry in heap]
        yield pa.RecordBatch.from_arrays(
            [block.ids.take(pa.array([h[0] for h in held], pa.int32())), pa.array([-h[3] if h[2] else None for h in held], pa.int64()),
             pa.array([h[1] for h in held], pa.int64())],
            ["item_id", "doc_id", "score"],
        )

    return counted.mapInArrow(read, f"item_id {kind}, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, best: int = BEST, postings: int = POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``best`` documents (doc_id, text) of every item (item_id, text).

    Terms are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters of whole texts;
    the score is the integer BM25 form that ``_best`` and the weights below compute, and must be above 0.
    Ranks count from 1 without ties: equal scores go by ascending doc_id, rows without a doc_id last. Every
    row of ``docs`` is a document, repeated ones too. All rows of ``items`` with one item_id (null as well) are one
    item, whose terms are those of its texts together. Items and documents without terms, and null texts,
    are in no result; such documents don't count. Other columns are ignored. Items are searched in blocks of
    ``postings`` terms at most, each a pass over the documents; that bounds what is broadcast.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    asked = materialize(item_terms(items), "postings")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    blocks, found = _blocks(asked, postings), []
    for number in range(blocks):
        rows = asked.filter(_block(blocks) == number).orderBy("item_id", "term").toArrow()
        if rows.num_rows:
            found.append(_search_block(spark, docs, Index.of(rows), best, kind))
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    merged = found[0]
    for more in found[1:]:
        merged = merged.unionByName(more)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["item_id", "__salt"], ["item_id"]):
        first = Window.partitionBy(*keys).orderBy(*order)
        merged = merged.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)))
        merged = merged.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= best)
    return merged.select("item_id", "rank", "doc_id", "score")


def _search_block(spark: SparkSession, docs: DataFrame, block: Index, best: int, kind: str) -> DataFrame:
    index = spark.sparkContext.broadcast(block)
    counted = materialize(_counted(docs, index), "term-counts")
    n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = _frequencies(counted, len(block.terms))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    return _best(counted.filter(F.size("terms") > 0), index, weights, n_docs, max(1, n_terms), best, kind)
