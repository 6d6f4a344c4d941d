"""The stages of the pipeline one by one, and every operator on empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tokenfjord.llm import decontam, mixing, quality, queries, simhash, similar, suffix_dedup, telephony, token_store, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tiny):
    found = [spark.read.parquet(f"{tiny}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        found.append(stage(spark, found[-1], tiny).cache())
    return found


def test_stages_keep_the_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(stages) == 6
    assert all(s.columns == COLUMNS for s in stages[:-1])


def test_rejected_documents_go(spark, tiny, stages):
    scored = quality.score(stages[0], quality.train(stages[0], spark.read.parquet(f"{tiny}/labels.parquet")))
    want = {r["doc_id"] for r in scored.where("predicted = 1").collect()}
    assert {r["doc_id"] for r in stages[1].collect()} == want and len(want) < stages[0].count()


def test_one_of_each_class_stays(stages):
    want = {r["keep_id"] for r in similar.classes(stages[1]).collect()}
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(want)


def test_no_window_of_the_benchmark_is_left(spark, tiny, stages):
    bench = spark.read.parquet(f"{tiny}/benchmark.parquet")
    assert decontam.report(stages[3], bench).agg(F.sum("n_items")).first()[0] == 0
    clean = {r["doc_id"] for r in decontam.report(stages[2], bench).where("n_hit = 0").collect()}
    assert clean <= {r["doc_id"] for r in stages[3].collect()}


def test_sources_meet_their_targets(stages):
    planned = {r["source_size"]: r["target"] for r in mixing.plan(stages[3]).collect()}
    taken = stages[4].groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    sizes = {r["source"]: r["n"] for r in stages[3].groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    for r in taken.collect():
        assert abs(r["n"] - planned[sizes[r["source"]]]) < 1


def test_token_files_hold_the_mix(stages):
    rows = sorted(stages[5].collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in stages[4].collect())
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))


def test_run_is_the_stages_in_turn(spark, tiny, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, tiny).collect())) == sorted(map(tuple, stages[5].collect()))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g h i", "en", "s", 17)], docs.schema)
    assert quality.train(docs, labels) is None and toxicity.train(some, labels) is None
    for found in (
        quality.score(docs, None), quality.keep_good(docs, None), toxicity.score(docs, None), simhash.near_duplicate_classes(docs), simhash.drop_near_duplicates(docs), similar.drop_similar(docs), decontam.report(docs, bench), decontam.decontaminate(docs, bench), mixing.plan(docs), mixing.mix(docs), suffix_dedup.report(docs),
        telephony.features(telephony.store(docs)), token_store.store_documents(spark, docs, queries.vocabulary_path()),
    ):
        assert found.count() == 0
    assert decontam.report(some, bench).first()["n_items"] == 0 and decontam.decontaminate(some, bench).count() == 1
