"""Source divergence audit: how far the sources of a language lie apart in their terms, and which terms set one off.

Every kept term has a smoothed share in each (lang, source) group, p = 1 + floor(10^9 (count + 5) / (N + 5 V)), in whole
numbers throughout.  Two groups lie sum |p - q| apart, over all V kept terms of the language.

1. Tasks count the terms of their documents by group; counts meet by (lang, term) in one shuffle, where a term's documents
   in the language decide whether it is kept.
2. Kept counts form tiles of one language: a share of its terms by two blocks of its groups.  Terms that many of the groups hold
   (heavy) fill dense arrays, and a tile sums |p - q| over them directly.  A rare (light) term is absent from most groups, where its
   share is p0; a tile starts from all groups without it, adds what each group that holds it moves away from the p0 of each other
   group (by sorted prefix sums, for all its light terms at once), and corrects the pairs that both hold it from its posting list.
3. Both partial sums are whole numbers and add up exactly over tiles.

A tile's work is bounded by its cells and its two blocks; a block has BLOCK groups at most, about.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, byte_batch, small, table, trimmed
from .terms import NO_LETTER, counted, strings

#: Documents of its language that a kept term is in, at least; what is added to each count.
LEAST_DOCUMENTS, ADDED = 30, 5
#: A term is heavy that one in so many groups of its language holds.
HEAVY = 4
#: Groups of a block, counts of a tile, and terms of a dense array, about.
BLOCK, TILE_CELLS, DENSE_TERMS = 256, 100_000, 2_048
#: Counts that a task gathers before it sends them on.
HELD = 1_000_000
#: Terms a group reports.
TERM_RANKS = 50

_CELLS = "lang string, source string, term string, docs long, count long"


class _Counts:
    """Counts by (group, term) of a task's documents."""

    def __init__(self):
        self.codes: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.words: list[tuple[np.ndarray, pa.Array]] = []
        self.held = 0

    def add(self, group: np.ndarray, raw: np.ndarray, found: tuple[np.ndarray, ...]) -> None:
        row, hashes, n, start, end = found
        known, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        self.words.append((known, strings(raw, start[first], end[first])))
        self.parts.append(_cells(group[row], hashes, np.ones(len(row), np.int64), n))
        self.held += len(self.parts[-1][0]) + len(known)

    def rows(self) -> pa.RecordBatch:
        names = list(self.codes)
        group, hashes, docs, n = _cells(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        known, first = np.unique(np.concatenate([x for x, _ in self.words]), return_index=True)
        words = pa.concat_arrays([x.cast(pa.large_string()) for _, x in self.words]).take(pa.array(first))
        lang, source = (pa.array([x[k] for x in names], pa.string()).take(pa.array(group)) for k in (0, 1))
        self.parts, self.words, self.held = [], [], 0
        term = words.take(pa.array(np.searchsorted(known, hashes))).cast(pa.string())
        return pa.RecordBatch.from_arrays([lang, source, term, pa.array(docs), pa.array(n)], names=["lang", "source", "term", "docs", "count"])


def _cells(group: np.ndarray, hashes: np.ndarray, docs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry for each (group, hash), with the sums of docs and n."""
    if not len(group):
        return group, hashes, docs, n
    order = np.lexsort((hashes, group))
    group, hashes, docs, n = (x[order] for x in (group, hashes, docs, n))
    first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (hashes[1:] != hashes[:-1])])
    return group[first], hashes[first], np.add.reduceat(docs, first), np.add.reduceat(n, first)


def _counting(batches):
    held = _Counts()
    for batch in batches:
        pairs = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        group = np.array([held.codes.setdefault(x, len(held.codes)) for x in pairs], np.int64)
        raw, offsets = byte_batch(batch.column("text"))
        for found in counted(raw, offsets, NO_LETTER):
            if len(found[0]):
                held.add(group, raw, found)
            if held.held > HELD:
                yield held.rows()
    if held.held:
        yield held.rows()
    trimmed()


def share(count: str, total: str) -> Column:
    """1 + floor(10^9 (count + ADDED) / total), in two steps of which neither leaves 64 bits for counts below 9 * 10^13."""
    high = f"(100000L * ({count} + {ADDED}L))"
    return F.expr(f"1L + 10000L * ({high} div {total}) + (10000L * ({high} % {total})) div {total}")


def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    high, rest = np.divmod(100_000 * (count + ADDED), total)
    return 1 + 10_000 * high + 10_000 * rest // total


def _dense(at: np.ndarray, term: np.ndarray, p: np.ndarray, p0: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """[left, right] sums of |p - q| - |p0 - q0| over the terms 0..: groups ``at`` have the shares p, all others p0."""
    out = np.zeros((len(left), len(right)), np.int64)
    terms = int(term.max()) + 1 if len(term) else 0
    for a in range(0, terms, DENSE_TERMS):
        width = min(DENSE_TERMS, terms - a)
        own = (term >= a) & (term < a + width)
        array = np.repeat(p0[:, None], width, axis=1)
        array[at[own], term[own] - a] = p[own]
        for i, g in enumerate(left):
            out[i] += np.abs(array[g] - array[right]).sum(axis=1) - width * np.abs(p0[g] - p0[right])
    return out


def _moved(p: np.ndarray, others: np.ndarray, own: int) -> np.ndarray:
    """By other group, the sum over shares p of |p - q0| - |own - q0|."""
    p = np.sort(p)
    upto = np.r_[0, np.cumsum(p)]
    below = np.searchsorted(p, others)
    away = others * below - upto[below] + (upto[-1] - upto[below]) - others * (len(p) - below)
    return away - len(p) * np.abs(own - others)


def _sparse(at: np.ndarray, term: np.ndarray, p: np.ndarray, p0: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """As _dense(), from posting lists."""
    groups = len(p0)
    out = np.zeros((groups, groups), np.int64)
    order = np.lexsort((at, term))
    at, term, p = at[order], term[order], p[order]
    for g in np.unique(at):
        moved = _moved(p[at == g], p0, int(p0[g]))
        out[g] += moved
        out[:, g] += moved
    # where both hold the term, the two moves are not what they are apart
    n = len(term)
    last = np.searchsorted(term, term, "right")
    for a in range(0, n, 4_096):
        partners = (last - np.arange(n) - 1)[a : a + 4_096]
        x = np.repeat(np.arange(a, min(n, a + 4_096)), partners)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(partners) - partners, partners)
        g, h = at[x], at[y]
        apart = np.abs(p[x] - p[y]) - np.abs(p[x] - p0[h]) - np.abs(p[y] - p0[g]) + np.abs(p0[g] - p0[h])
        np.add.at(out, (g, h), apart)
        np.add.at(out, (h, g), apart)
    return out[np.ix_(left, right)]


def _tile(rows: pa.Table, dense=_dense, sparse=_sparse) -> pa.Table:
    """The rows of one tile -> lang, a, b, apart: for each pair of its groups, this tile's part of their distance."""
    terms = rows.column("term").combine_chunks()
    heads = rows.filter(terms.is_null())
    cells = rows.filter(terms.is_valid())
    names, blocks = heads.column("source").combine_chunks(), heads.column("block").to_numpy()
    total, kept = heads.column("total").to_numpy(), heads.column("kept").to_numpy()
    p0 = _share(np.zeros(len(total), np.int64), np.maximum(total, 1))
    low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
    left, right = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
    out = np.zeros((len(left), len(right)), np.int64)
    if rows.column("shard")[0].as_py() == 0:  # once: as if no group held any term
        out += kept[left][:, None] * np.abs(p0[left][:, None] - p0[right][None, :])
    if len(cells):
        at = pc.index_in(cells.column("source").combine_chunks(), names).to_numpy()
        term = cells.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        p = _share(cells.column("count").to_numpy(), total[at])
        heavy = HEAVY * cells.column("holders").to_numpy() >= cells.column("groups").to_numpy()
        for pick, work in ((heavy, dense), (~heavy, sparse)):
            if pick.any():
                own = np.unique(term[pick], return_inverse=True)[1]
                out += work(at[pick].astype(np.int64), own, p[pick], p0, left, right)
    i, j = np.nonzero(np.arange(len(left))[:, None] < np.arange(len(right))[None, :]) if low == high else np.indices(out.shape).reshape(2, -1)
    lang = pa.array([rows.column("lang")[0].as_py()] * len(i), pa.string())
    return pa.table([lang, names.take(pa.array(left[i])), names.take(pa.array(right[j])), pa.array(out[i, j])], names=["lang", "a", "b", "apart"])


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", store: Scratch | None = None) -> DataFrame:
    """lang, source, part, item, value, rank.

    part ``pair``: item is each other source of the language and value the distance of the two groups; all ranks.
    part ``term``: item is a kept term of larger share in the group than in the whole language, value the difference; 50 ranks at most.
    Ranks go from 1 by falling value, then by rising item (as UTF-8).
    Null text, lang and source count as empty; a group without any term still has its pairs; a language without kept terms has pairs of
    distance 0.  Rows that repeat count each.  An empty table gives an empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    name = lambda c, own: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(own)
    docs = docs.select(name(lang, "lang"), name(source, "source"), F.col(f"`{text}`").alias("text"))
    with store or Scratch(spark, "divergence") as store:
        sent = docs.mapInArrow(_counting, _CELLS).repartition("lang", "term")
        by_term = W.partitionBy("lang", "term")
        cells = sent.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("count"))
        cells = cells.withColumn("df", F.sum("docs").over(by_term)).where(F.col("df") >= LEAST_DOCUMENTS)
        cells = store.put(cells.select("lang", "source", "term", "count", F.sum("count").over(by_term).alias("in_lang"), F.count("*").over(by_term).alias("holders")), "cells")
        n = cells.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("cells"))
        v = cells.groupBy("lang").agg(F.countDistinct("term").alias("kept"), F.sum("count").alias("n_lang"), F.count("*").alias("lang_cells"))
        groups = docs.select("lang", "source").distinct().join(n, ["lang", "source"], "left").join(v, "lang", "left").na.fill(0)
        per_lang = W.partitionBy("lang")
        groups = groups.select("lang", "source", "kept", F.expr(f"n + {ADDED} * kept").alias("total"), F.expr(f"n_lang + {ADDED} * kept").alias("lang_total"), F.count("*").over(per_lang).alias("groups"), "lang_cells")
        groups = groups.withColumn("blocks", F.expr(f"1 + (groups - 1) div {BLOCK}")).withColumn("shards", F.expr(f"1 + lang_cells div {TILE_CELLS}"))
        groups = store.put(groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks"))), "groups")
        known = cells.join(small(groups, 256), ["lang", "source"])

        heads = groups.withColumn("shard", F.explode(F.expr("sequence(0L, shards - 1)"))).select("lang", "source", "block", "blocks", "shard", "groups", "kept", "total")
        rows = known.withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards"))).select("lang", "source", "block", "blocks", "shard", "groups", "term", "count", "holders")
        rows = heads.unionByName(rows, allowMissingColumns=True).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
        rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
        tiles = rows.groupBy("lang", "low", "high", "shard").applyInArrow(lambda x: trimmed(_tile(x)), "lang string, a string, b string, apart long")
        apart = store.put(tiles.groupBy("lang", "a", "b").agg(F.sum("apart").alias("value")), "apart")
        both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
        pairs = apart.select("lang", both.alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")

        over = known.select("lang", "source", F.col("term").alias("item"), (share("count", "total") - share("in_lang", "lang_total")).alias("value")).where("value > 0")
        rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        terms = over.withColumn("rank", rank).where(F.col("rank") <= TERM_RANKS).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
        terms = store.put(terms, "terms")
        store.drop(cells, groups)
        return pairs.withColumn("rank", rank).unionByName(terms)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS q_count FROM t GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 30),
l AS (SELECT lang, count(*) AS v, sum(q_count) AS n FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS cnt FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(sum(cnt), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT lang, source, term, coalesce(cnt, 0) AS cnt,
      CAST(1 + (1000000000 * (coalesce(cnt, 0) + 5)) // (g.n + 5 * l.v) AS BIGINT) AS p, CAST(1 + (1000000000 * (q_count + 5)) // (l.n + 5 * l.v) AS BIGINT) AS q
      FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
         FROM g a JOIN g b USING (lang) LEFT JOIN (SELECT x.lang, x.source AS a, y.source AS b, sum(abs(x.p - y.p)) AS value
           FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY 1, 2, 3) s ON s.lang = a.lang AND s.a = a.source AND s.b = b.source
         WHERE a.source <> b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE cnt > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
