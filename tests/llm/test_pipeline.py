"""The stages of the corpus pipeline: columns, decisions, and the whole run."""

import random

import corpus_pipeline
from tests.llm.data import documents, empty
from tidemark.llm.registry import QUERIES


def test_every_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "substring_dedup", "secrets", "packing"]


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    docs = documents(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, "")
        out.write.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            break
        assert out.columns == docs.columns
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "language":
            assert {before[d] for d in set(before) - set(after)} == {None, "", "  \n\t "}
        if name == "near_dedup":
            assert docs.count() == len(after) and 35 in after and 42 not in after and 49 not in after
        if name == "secrets":
            assert set(after) == set(before)
            changed = {d for d in after if after[d] != before[d]}
            assert len(changed) == 1 and "password=<secret> tail" in after[changed.pop()]
    assert spark.read.parquet(f"{tmp_path}/{k}").selectExpr("sum(length)").first()[0] > len(after)


def test_empty_input_and_whole_run(spark, tmp_path):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_weak_secrets_are_masked_too(spark):
    df = spark.createDataFrame([(1, "a password=Summer2024 b token: changeme, c")], "doc_id bigint, text string")
    assert corpus_pipeline.secrets(spark, df, "").first().text == "a password=<secret> b token: <secret>, c"


def test_unlearned_scripts_and_gibberish_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    r = random.Random(1)
    junk = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(60)) for _ in range(5)]
    junk += ["дом и сад старые но деревья там не были срублены", "日本語の文章はここにあります東京都千代田区永田町"]
    added = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(junk)], docs.schema)
    kept = corpus_pipeline.language(spark, docs.unionByName(added), "").select("doc_id")
    assert kept.filter("doc_id < 0").count() == 0 and kept.count() == docs.count()
