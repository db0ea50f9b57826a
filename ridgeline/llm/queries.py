"""The corpus operators' queries: each applies one to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import chat, decontam, html, linededup, mixing, neardup, quality, secrets, tokens, toxicity
from ridgeline.llm.common import spread, table
from ridgeline.llm.oracles import SQL

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spread(table(spark, sf_dir, "pages")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(spread(table(spark, sf_dir, "documents")))
    n = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")
    base = secrets.joined("spans", secrets.KINDS[:3])
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(base, 256).alias("base_sha256"), secrets.joined("spans").alias("spans"), "n_live", "n_example", "n_unclear")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(spread(table(spark, sf_dir, "documents")))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.fails("base-1").alias("base_failed"), (~quality.fails(quality.CURRENT)).alias("kept"), "failed")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(spread(table(spark, sf_dir, "documents")), min_docs=10, min_chars=1, keep="none")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spread(table(spark, sf_dir, "documents")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaks(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "distance", F.round("similarity", 6).alias("similarity"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = [(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    extra = spark.createDataFrame(probe, "conv_id bigint, turn bigint, role string, text string")
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.examples(talks.unionByName(extra)))


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_shards(tokens.write_shards(spread(table(spark, sf_dir, "documents")), tokenizer_path()))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(spread(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", F.round("factor", 9).alias("factor"), F.round("probability", 9).alias("probability"), "sampled")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
