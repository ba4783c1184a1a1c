"""The pipeline against a brute-force version of each stage's decisions."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from cladeline.llm import mixing, quality  # noqa: E402

from . import helpers  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    helpers.frame(spark, helpers.documents(11), path)
    helpers.frame(spark, [(k, 1, 0) for k in range(1, 120, 3)], path, "labels", "doc_id long, quality int, toxic int", 1)
    return path


def _rows(df):
    return [tuple(r) for r in df.select(COLUMNS).collect()]


def test_stages(spark, folder):
    sf_dir = f"file://{folder}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "mixing sources to target weights", "packing"]
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, sf_dir).write.parquet(f"{sf_dir}/stage{k}")
        after = spark.read.parquet(f"{sf_dir}/stage{k}")
        if k < 4:
            assert after.columns == docs.columns
        if k == 0:
            keep = Counter(r.doc_id for r in quality.classify(before, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("keep").collect())
            assert Counter(r[0] for r in _rows(after)) == keep and not Counter(_rows(after)) - Counter(_rows(before))
        elif k == 1:
            old = _rows(before)
            want = helpers.components([(r[0], r[1]) for r in old])
            assert set(_rows(after)) == {r for r in old if want.get(r[0]) == r[0]}
            assert all(n == 1 for r, n in Counter(_rows(after)).items() if r[0] is not None)
        elif k == 2:
            cut = helpers.cut([(r[0], r[1]) for r in _rows(before)])
            sizes = Counter(len((r[1] or "").encode()) for r in _rows(after))
            assert sum(n * s for s, n in sizes.items()) >= sum(n - gone for _, n, gone, _, _ in cut)
            untouched = {r for r, c in zip(_rows(before), cut) if c[2] == 0}
            assert untouched <= set(_rows(after))
            assert all(r[4] == len(r[1]) for r in set(_rows(after)) - set(_rows(before)))
        elif k == 3:
            plan = mixing.mix_rows(before).collect()
            assert {r[0] for r in _rows(after)} == {r.doc_id for r in plan if r.taken}
            assert all(n <= 3 for r, n in Counter(_rows(after)).items() if r[0] is not None)
        else:
            assert after.count() == before.count()
        before = after


def test_run_and_empty(spark, folder, tmp_path):
    out = corpus_pipeline.run(spark, f"file://{folder}")
    assert out.columns == ["doc_id", "n_tokens", "bucket", "length", "batch", "place"] and out.count() > 0
    helpers.frame(spark, [], tmp_path, files=1)
    helpers.frame(spark, [], tmp_path, "labels", "doc_id long, quality int, toxic int", 1)
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_rows_not_read_from_files_are_found_again(spark):
    passage = " ".join(f"word{k}" for k in range(40))
    docs = spark.createDataFrame([(1, "first " + passage, "en", "a", 0), (2, "second " + passage, "en", "b", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(3).cast("long")))
    assert 2 in {r.doc_id for r in corpus_pipeline.mixed(spark, docs, "").collect()}
    cut = {r.doc_id: r.text for r in corpus_pipeline.suffixes(spark, docs, "").collect()}
    assert cut[1] == "first " + passage and passage not in cut[2] and 3 not in cut


def test_columns_of_any_type_and_name(spark):
    """Extra columns, also maps and those named like our own, pass through; rows alike in all columns count once."""
    text = " ".join(f"word{k}" for k in range(30))
    rows = [(1, text, {"a": 1}, "x", 1), (1, text, {"a": 1}, "x", 1), (2, text, None, None, 2), (3, "other words altogether here now", {"b": 2}, "y", 3), (None, text, {}, "z", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, item string, rid int")
    got = corpus_pipeline.jaccard(spark, docs.withColumn("r_doc", F.lit(7)).withColumn("lang", F.lit("en")), "").collect()
    assert sorted((r.doc_id or 0, r.item, r.rid) for r in got) == [(0, "z", 4), (1, "x", 1), (3, "y", 3)]
    assert {r.doc_id: r.m for r in got}[3] == {"b": 2} and all(r.r_doc == 7 for r in got)
    cut = corpus_pipeline.suffixes(spark, docs, "").collect()
    assert {r.doc_id for r in cut if r.text == text} == {1, None} and not any(r.doc_id == 2 for r in cut)


def test_run_leaves_only_what_its_result_reads(spark, folder, tmp_path, monkeypatch):
    from cladeline.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    n = corpus_pipeline.run(spark, f"file://{folder}").count()
    left = sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir() if any(q.is_file() for q in p.rglob("*.parquet")))
    assert n > 0 and set(left) <= {"pipeline", "pipeline-run-4"}, left
    assert common.small(spark.range(3)).count() == 3
