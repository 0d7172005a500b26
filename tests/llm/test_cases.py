"""Unusual input: repeated and null ids, several vectors of an id, folders without a scheme, many languages, clashing columns in the pipeline."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.test_exact import BYTE, WORD, library

import corpus_pipeline
from quire.llm import bpe, langid, packing, topk, warc
from quire.llm.common import fresh_dir

REPEATED = [(None, "one two"), (None, "one two"), (3, "a"), (3, "a"), (3, "another text"), (4, None), (4, "")]


def test_repeated_and_null_ids_of_encoders(spark):
    docs = spark.createDataFrame(REPEATED, "doc_id long, text string").repartition(3)
    for name, run in ((BYTE, bpe.round_trip(docs, BYTE)), (WORD, packing.pack(docs, WORD, budget=64))):
        ids = library(name)
        size = "n_tokens" if name == BYTE else "length"
        extra = 0 if name == BYTE else 1  # the end id
        assert Counter((r["doc_id"], r[size]) for r in run.collect()) == Counter((i, len(ids(t)) + extra) for i, t in REPEATED)


@pytest.mark.parametrize("shard_rows", [4, 4096])
def test_several_vectors_of_an_id(spark, shard_rows):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(60)]
    rows += [(0, rng.normal(size=4).round(2).tolist()) for _ in range(3)]  # a query with four vectors
    rows += [rows[0], rows[7], (8, rows[9][1])]  # repeated rows, and a candidate with two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    got = defaultdict(list)
    for r in topk.top_k(df, df.filter("vec_id % 20 = 0"), k=10, shard_rows=shard_rows).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in (0, 20, 40):
        best = {}
        for asked in {tuple(v) for i, v in whole if i == q}:
            scores = defaultdict(list)
            for i, v in whole:
                if i != q:
                    scores[i].append(sum(a * b for a, b in zip(asked, v, strict=True)))
            for i, found in scores.items():
                for nth, s in enumerate(sorted(found, reverse=True)):
                    best[i, nth] = max(s, best.get((i, nth), s))
        want = sorted((-s, i) for (i, _), s in best.items())[:10]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_warc_folder_without_a_scheme(spark, tmp_path):
    """A path is the same folder for executors and for Spark's readers, whatever the default file system is."""
    pages = spark.createDataFrame([(1, "u", "x" * 1200), (2, "u", "x" * 1200)], "page_id long, url string, html string")
    for folder in (str(tmp_path / "plain"), f"file:{tmp_path}/one-slash", f"file://{tmp_path}/three", fresh_dir(spark, "warc")):
        warc.write(pages, folder)
        assert sorted((r["page_id"], r["record_type"]) for r in warc.read(spark, folder).collect()) == [(1, "revisit"), (2, "response")]
    assert warc._qualified(spark, str(tmp_path)) == f"file://{tmp_path}"


def test_languages_are_bounded(spark):
    rows = [(i, f"text {i}", f"l{i}") for i in range(langid.LANGUAGES + 500)]
    with pytest.raises(ValueError, match="languages"):
        langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null and repeated ids, empty texts and columns named as those that stages make pass all stages, and settings are left alone."""
    rnd = random.Random(0)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = docs.limit(5).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType))
    docs = docs.unionByName(docs.limit(20)).unionByName(odd).unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string")))
    for c in ("score", "kept", "row", "piece", "start", "length", "y", "id", "class", "spans", "lang_pred", "held_out", "part", "pos", "component_id"):
        docs = docs.withColumn(c, F.lit(rnd.choice("ab")))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, columns, at = spark.conf.get(name), sorted(docs.columns), {}
    for stage, run in corpus_pipeline.STAGES:
        out = run(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / stage))
        docs = spark.read.parquet(str(tmp_path / stage))
        at[stage] = docs.count()
        if stage != "packing":
            assert sorted(docs.columns) == columns
    assert spark.conf.get(name) == before
    assert at["language"] >= at["toxicity"] >= at["near_duplicates"] == at["pii"] > 0
    assert docs.agg(F.count_distinct("sequence_id")).first()[0] > 0
    assert docs.filter("doc_id IS NULL").count() > 0 or at["near_duplicates"] < at["toxicity"]
