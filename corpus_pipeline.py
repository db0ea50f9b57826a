"""The corpus pipeline: documents go through STAGES in turn, each written and read again as the next one's input."""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import decontam, mixing, neardup, tokens, toxicity
from ridgeline.llm.common import drop, new_path, scratch, table
from ridgeline.llm.queries import tokenizer_path

#: Classifier and fitting steps are not SQL; the pipeline is tested against its stages by brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. The model is learnt from the documents' own labels; the score reads text alone."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.where(F.col(toxicity.score_column(docs)) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of the least id stays; one without an id if none has one."""
    return neardup.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that source, language and topic come near their target shares."""
    return mixing.sample_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sorted token shards; returns what reading them back gives for each document."""
    return tokens.read_shards(tokens.write_shards(docs, tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_shards", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage keeps in the shared folder goes when its result is written, and that when the next
    stage's is; the last result and the token shards stay."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = new_path(spark, f"stage-{name}")
        with scratch(spark) if stage is not write_tokens else nullcontext():
            stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if last:
            drop(spark, last)
        last = at
    return docs
