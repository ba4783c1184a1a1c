"""The corpus pipeline: from documents to packed batches, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written before the next reads it.
All but the last return the columns of documents.  The quality classifier judges rows by their own text; near
duplicates are judged by doc_id, so all texts under a doc_id stay or go together.

A stage's working tables go when the stage returns; what its result still reads (ids, and the texts that were cut) goes
in run() when the result is written, and else lies in the shared folder until that is emptied.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeline.llm import jaccard_join, mixing, packing, quality, suffix_dedup
from cladeline.llm.blocks import filed, located
from cladeline.llm.common import Scratch, small, table

#: How often the mix may repeat a document.
MAX_REPEATS = 3


def _item(docs: DataFrame, *but: str):
    """A row's columns as one, so that no name of theirs meets one of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in but]).alias("item")


def _columns(docs: DataFrame, new: dict | None = None) -> list:
    return [(new or {}).get(c, F.col("item").getField(c)).alias(c) for c in docs.columns]


@contextlib.contextmanager
def _stores(spark: SparkSession):
    """(of working tables, of what the result reads); the first is closed at the end, the second by run()."""
    work, kept = Scratch(spark, "pipeline-work"), Scratch(spark, "pipeline")
    with kept:
        try:
            yield work, kept
        finally:
            work.close()
    _LEFT.append(kept)


_LEFT: list[Scratch] = []


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose log-loss is beyond a limit of their language."""
    with _stores(spark) as (work, kept):
        docs = filed(docs, kept)
        judged = quality.classify(docs, table(spark, sf_dir, "labels"), store=work)
        rejected = kept.put(judged.where("NOT keep").select(F.col("doc_id").alias("r_doc"), F.col("fp").alias("r_fp")).distinct(), "rejected")
        gone = docs["doc_id"].cast("long").eqNullSafe(rejected["r_doc"]) & (F.xxhash64(docs["lang"], docs["text"]) == rejected["r_fp"])
        return docs.join(small(rejected), gone, "left_anti")


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates; rows alike in all columns count once."""
    with _stores(spark) as (work, kept):
        docs = filed(docs, kept)
        found = jaccard_join.near_duplicates(docs, store=work).where("component_id <> doc_id").select(F.col("doc_id").alias("r_doc")).distinct()
        found = kept.put(found, "copies")
        several = docs.groupBy(F.col("doc_id").cast("long").alias("r_doc")).count().where("count > 1 AND r_doc IS NOT NULL").select("r_doc")
        several = kept.put(several, "repeated")
        among = lambda ids: docs["doc_id"].cast("long") == ids["r_doc"]
        left = docs.join(small(found), among(found), "left_anti")
        if several.isEmpty():
            return left
        once = left.join(small(several), among(several), "left_semi").select(_item(docs)).withColumn("alike", F.to_json("item")).dropDuplicates(["alike"])
        return left.join(small(several), among(several), "left_anti").unionByName(once.select(*_columns(docs)))


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out repeated passages; a document of which nothing but white space is left goes.

    Only what was cut is joined with its row's other columns; the texts of other rows stay where they are.
    """
    with _stores(spark) as (work, kept):
        docs = filed(docs, kept)
        cut = suffix_dedup.repeated_bytes(docs, with_text=True, store=work)
        changed = kept.put(cut.where("n_removed > 0").select("block", "rid", F.col("kept_text").alias("kept")), "changed")
        names = small(changed.select("block", "rid"))
        where = lambda *but: located(docs, kept, suffix_dedup.BLOCK_ROWS, [_item(docs, *but)])
        same = where().join(names, ["block", "rid"], "left_anti").select(*_columns(docs))
        rest = where("text").join(names, ["block", "rid"], "left_semi").join(changed, ["block", "rid"]).where(r"kept RLIKE '[^\\x20\\x09-\\x0D]'")
        new = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
        return same.unionByName(rest.select(*_columns(docs, new)))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: passes through its words, rounded, but once at least if any word is taken.

    A document of which the mix takes nothing goes.
    """
    with _stores(spark) as (work, kept):
        docs = filed(docs, kept)
        repeats = F.greatest(F.lit(1), F.round(F.col("taken") / F.col("size"))).cast("int")
        plan = mixing.mix_rows(docs, max_repeats=MAX_REPEATS, store=work).where("taken > 0").select("block", "rid", repeats.alias("repeats"))
        plan = kept.put(plan, "mix")
        rows = located(docs, kept, mixing.BLOCK_ROWS, [_item(docs)]).join(small(plan), ["block", "rid"])
        return rows.select("item", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select(*_columns(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, bucket, length, batch, place."""
    with _stores(spark) as (_, kept):
        return packing.pack(docs, store=kept)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard),
    ("suffix-array dedup", suffixes),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed batches; of the tables on the way only those that the result reads stay."""
    before, docs = None, table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        left = len(_LEFT)
        result = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return result
        store = Scratch(spark, f"pipeline-run-{k + 1}")
        with store:
            docs = store.put(result, name.replace(" ", "-"))
        while len(_LEFT) > left:
            _LEFT.pop().close()
        if before is not None:
            before.close()
        before = store
    return docs


#: Perplexities and suffix arrays have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
