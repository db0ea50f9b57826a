"""The pipeline's stages against their operators and brute force, and its whole run."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ridgeline.llm import decontam, mixing, toxicity


@pytest.fixture(scope="module")
def docs(spark, small):
    base = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 90")
    odd = [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "same words in this text", "en", "s", 1), (1002, "same words in this text", "en", "s", 1), (1003, "Same words, in this text!", "en", "s", 1), (None, "no id here", "en", "s", 1)]
    return base.unionByName(spark.createDataFrame(odd, base.schema)).withColumns({"toxicity": F.lit("x"), "_x": F.lit(1)})


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_shards"]
    assert corpus_pipeline.ORACLE_SQL is None


def ids(df):
    return sorted(str(r.doc_id) for r in df.select("doc_id").collect())


def test_toxic_documents_go(spark, small, docs):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, small)
    scores = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert kept.columns == docs.columns and ids(kept) == sorted(str(r.doc_id) for r in scores if r.toxicity_ < 0.5)


def test_one_of_each_group_stays(spark, small, docs):
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, small)
    got = ids(kept)
    assert kept.columns == docs.columns and got.count("1002") == 1 and "1003" not in got and "None" in got and "1000" in got and "1001" not in got


def test_leaking_documents_go(spark, small, docs):
    kept = corpus_pipeline.drop_leaks(spark, docs, small)
    leaked = {str(r.doc_id) for r in decontam.leaks(docs, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert kept.columns == docs.columns and ids(kept) == [i for i in ids(docs) if i not in leaked]


def test_drawn_documents_stay(spark, small, docs):
    kept = corpus_pipeline.mix_sources(spark, docs, small)
    assert kept.columns == docs.columns and ids(kept) == ids(mixing.mix_sources(docs).where("sampled"))


def test_drawing_reads_a_text_once(spark, docs):
    """One evaluation a text, and so one worker a task: a second one would stay in the executor's memory beside all that comes later."""
    plan = mixing.sample_documents(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_whole_run(spark, small):
    from tokenizers import Tokenizer

    out = corpus_pipeline.run(spark, small).orderBy("start").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    whole, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    assert 0.3 * len(texts) < len(out) < len(texts)
    for r in out:
        x = np.asarray([*whole.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    assert [r.doc_id for r in out] == sorted(r.doc_id for r in out)
