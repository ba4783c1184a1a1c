"""Ranked lexical search: for each item the documents with the highest sums of term impacts (BM25 in whole numbers).

Sort-based accumulation, and no index:

1. The items' terms are the vocabulary.  They travel to every task in blocks of BLOCK_TERMS (item, term) pairs at
   most, so their size is bounded whatever the number of items; each block is one round over the documents.
2. A task owns a range of documents.  It finds the vocabulary's terms in their whole texts and writes, for each
   document that holds any, its length and (term, occurrences); and for the range how many documents hold each term.
3. With the counts of all ranges summed, each range is read again: (item, document, impact) entries of all matches are
   laid end to end, their packed keys are radix sorted, and equal keys summed by reduceat.  All entries of a
   document are in its range, so sums are whole and no posting is shuffled.
4. A heap for each item keeps the range's best, and the ranges' bests meet, range-partitioned by item.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, byte_batch, table, trimmed
from .terms import NO_LETTER_OR_DIGIT, counted, pieces

#: (item, term) pairs of a round at most, but for one item that has more.
BLOCK_TERMS = 1 << 18
#: Entries that are sorted at once, about.
ENTRIES = 1 << 20
#: Keys (document, term) that a task holds before equal ones are put together.
HELD_KEYS = 1 << 21

DOCUMENT, COUNTS = 0, 1
_POSTINGS = "kind int, doc_id long, n long, ids binary, counts binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])


def _item_terms(batches):
    for batch in batches:
        ids, (raw, offsets) = batch.column("item_id"), byte_batch(batch.column("text"))
        for row, hashes, n, _, _ in counted(raw, offsets, NO_LETTER_OR_DIGIT):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(hashes.view(np.int64)), pa.array(n)], names=["item_id", "term", "n"])


def _postings(vocabulary: np.ndarray):
    """documents -> _POSTINGS: a row for each document with a term of the (sorted) vocabulary, and one of counts for the task."""
    size = len(vocabulary)

    def run(batches):
        holders, documents, words = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            raw, offsets = byte_batch(batch.column("text"))
            rows = len(offsets) - 1
            n, keys, tf, held = np.zeros(rows, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
            for _, row, hashes, _, _ in pieces(raw, offsets, NO_LETTER_OR_DIGIT):
                n += np.bincount(row, minlength=rows)
                at = np.minimum(np.searchsorted(vocabulary, hashes), size - 1)
                hit = vocabulary[at] == hashes
                keys.append(row[hit] * size + at[hit])
                tf.append(np.ones(len(keys[-1]), np.int64))
                held += len(keys[-1])
                if held > HELD_KEYS:
                    k, c = _sums(np.concatenate(keys), np.concatenate(tf))
                    keys, tf, held = [k], [c], 0
            keys, tf = _sums(np.concatenate(keys), np.concatenate(tf))
            row, ids = keys // size, keys % size
            holders += np.bincount(ids, minlength=size)
            documents, words = documents + int(np.count_nonzero(n)), words + int(n.sum())
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
            own, last = row[first], np.r_[first[1:], len(row)][: len(first)]
            ids, tf = ids.astype("<u4"), tf.astype("<u4") if not len(tf) or tf.max() < 1 << 32 else tf.astype("<u8")
            cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())
            columns = [pa.array(np.full(len(own), DOCUMENT, np.int32)), batch.column("doc_id").take(pa.array(own)), pa.array(n[own]), cut(ids), cut(tf)]
            yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)
        if documents:
            found = np.flatnonzero(holders)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([COUNTS], [documents], [words], [found.astype("<u4").tobytes()], [holders[found].tobytes()]), _SCHEMA, strict=True)], schema=_SCHEMA)
        trimmed()

    return run


def _holders(batches):
    """Rows of COUNTS -> (term, documents) pairs."""
    for batch in batches:
        for ids, counts in zip(batch.column("ids"), batch.column("counts"), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids.as_buffer(), "<u4").astype(np.int64)), pa.array(np.frombuffer(counts.as_buffer(), np.int64))], names=["id", "df"])


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of whole numbers from 0, by digits of 16 bits from the last to the first (numpy sorts those by radix)."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    top, shift = int(keys.max()) if len(keys) else 0, 16
    while top >> shift:
        order = order[np.argsort((keys[order] >> shift).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, and the sum of the values of each."""
    if not len(keys):
        return keys, values
    order = radix_order(keys)
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(values, first)


class _Best:
    """The k best (score, document) of each item so far: a heap each, its least one known to all."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps, self.least = k, [[] for _ in range(items)], np.zeros(items, np.int64)

    def offer(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        hopeful = score >= np.maximum(self.least[item], 1)
        item, doc, score = item[hopeful], doc[hopeful], score[hopeful]
        order = np.lexsort((doc, -score))
        for i, d, s in zip(item[order].tolist(), doc[order].tolist(), score[order].tolist(), strict=True):
            heap, entry = self.heaps[i], (s, -d)  # a smaller doc_id ranks higher
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[i] = heap[0][0]

    def rows(self) -> list[tuple[int, int, int]]:
        return [(i, -d, s) for i, heap in enumerate(self.heaps) for s, d in heap]


def _scored(item_ids: np.ndarray, begins: np.ndarray, items: np.ndarray, times: np.ndarray, weights: np.ndarray, documents: int, words: int, k: int):
    """_POSTINGS of documents -> item_id, doc_id, score of the task's k best of each item.

    begins, items, times: by term, the items that hold it and how often.
    """

    def run(batches):
        best = _Best(len(item_ids), k)
        for batch in batches:
            n = batch.column("n").to_numpy()
            docs = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
            length = 25 + (75 * n * documents) // words
            ids = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column("ids")]
            tfs = [np.frombuffer(x.as_buffer(), "<u4" if x.as_buffer().size == 4 * len(i) else "<u8") for x, i in zip(batch.column("counts"), ids, strict=True)]
            entries = np.cumsum([int((begins[i + 1] - begins[i]).sum()) for i in ids])
            a = 0
            while a < len(docs):
                b = max(a + 1, int(np.searchsorted(entries, (entries[a - 1] if a else 0) + ENTRIES, "right")))
                term, tf = np.concatenate(ids[a:b]).astype(np.int64), np.concatenate(tfs[a:b]).astype(np.int64)
                doc = np.repeat(np.arange(b - a), [len(x) for x in ids[a:b]])
                impact = weights[term] * ((1_000_000_000 * tf) // (1_000 * tf + 8 * length[a + doc]))
                many = begins[term + 1] - begins[term]
                at = np.arange(many.sum()) + np.repeat(begins[term] - np.r_[0, np.cumsum(many)[:-1]], many)
                keys, scores = _sums(items[at] * (b - a) + np.repeat(doc, many), np.repeat(impact, many) * times[at])
                best.offer(keys // (b - a), docs[a + keys % (b - a)], scores)
                a = b
        found = best.rows()
        if found:
            item, doc, score = (np.array(x, np.int64) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(item_ids[item]), pa.array(doc, mask=doc == _NO_ID), pa.array(score)], names=["item_id", "doc_id", "score"])
        trimmed()

    return run


#: Stands for a null doc_id while ranking, after all others.
_NO_ID = (1 << 63) - 1


def search(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", k: int = 10, store: Scratch | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of highest score above 0, equal scores by rising doc_id.

    Every row of ``docs`` is a document of its own; a row without doc_id ranks after those of its score.  Rows of
    ``items`` that share an item_id are one item with the terms of all of them, rows alike counted once; an item
    without id is left out.  Null and empty texts have no terms.  Empty tables give an empty result.
    Scores are 64-bit: 75 times the longest document times all documents must stay below 2^63.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text")).where("item_id IS NOT NULL").distinct()
    with store or Scratch(spark, "lexical") as store:
        terms = store.put(items.mapInArrow(_item_terms, "item_id long, term long, n long").groupBy("item_id", "term").agg(F.sum("n").alias("n")), "item-terms")
        blocks = terms.count() // BLOCK_TERMS + 1
        found = None
        for block in range(blocks):
            rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()
            if not len(rows):
                continue
            best = _round(docs, rows, k, store)
            found = best if found is None else found.unionByName(best)
        if found is None:
            return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.repartitionByRange("item_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = store.put(ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")
        store.drop(terms)
        return out


def _round(docs: DataFrame, rows: pa.Table, k: int, store: Scratch) -> DataFrame:
    """item_id, doc_id, score: the k best of each range of documents for the items of a block."""
    hashes, id_of = np.unique(rows.column("term").to_numpy().view(np.uint64), return_inverse=True)
    item_ids, item = np.unique(rows.column("item_id").to_numpy(), return_inverse=True)
    order = np.argsort(id_of, kind="stable")
    begins = np.searchsorted(id_of[order], np.arange(len(hashes) + 1))
    postings = store.put(docs.mapInArrow(_postings(hashes), _POSTINGS), "postings")
    counts = postings.where(F.col("kind") == COUNTS)
    documents, words = counts.agg(F.sum("doc_id"), F.sum("n")).first()
    df = counts.select("ids", "counts").mapInArrow(_holders, "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).toArrow()
    holders = np.zeros(len(hashes), np.int64)
    holders[df.column("id").to_numpy()] = df.column("df").to_numpy()
    n = int(documents or 0)
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in holders], np.int64)
    run = _scored(item_ids, begins, item[order].astype(np.int64), rows.column("n").to_numpy()[order], weights, n, int(words or 1), k)
    best = store.put(postings.where(F.col("kind") == DOCUMENT).select("doc_id", "n", "ids", "counts").mapInArrow(run, "item_id long, doc_id long, score long"), "best")
    store.drop(postings)
    return best


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
len AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1),
c AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM len),
w AS (SELECT term, CAST(floor(1000 * ln((2 * max(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY 1),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score
      FROM i JOIN tf USING (term) JOIN w USING (term) JOIN len USING (doc_id), c GROUP BY 1, 2),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
