"""The corpus pipeline: quality classifier, line dedup, near-duplicates, mixing, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import bpe, lines, minhash, mixing, quality
from docquarry.llm.shared import fresh_path, passing, table
from docquarry.sources.shared import remove


#: Words that a worker of the last stage remembers: by then it also holds what earlier stages left.
REMEMBERED = 80_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = quality.classify(spark, docs, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on many sources, kept where they first stand; what has nothing left goes."""
    return lines.clean_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.keep_one(spark, docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix of sources takes them."""
    return mixing.mix_texts(spark, docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token count and digests of its tokens and of the text decoded from them."""
    return bpe.encode_decode(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), memo=REMEMBERED).drop("text")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("mixing sources", mixing_stage),
    ("bpe tokens", token_stage),
]
#: The stages hash, draw and learn in ways that SQL cannot express; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each stage's rows written and read again. What a stage needed on its way goes once its rows are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for place, (name, stage) in enumerate(STAGES):
        if place == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with passing(spark):
            kept = stage(spark, docs, sf_dir)
            path = fresh_path(spark, name.replace(" ", "-"))
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
