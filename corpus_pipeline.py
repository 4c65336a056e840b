"""Corpus pipeline over ``documents``: toxic documents go, boilerplate lines go,
one document of each group of near-duplicates stays, sources are mixed to
their weights, and the mix is encoded.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, written as
Parquet and read again as the next one's ``docs``; all but the last return the
columns of ``documents``.  Rows with null or empty texts pass every filter.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qforge.llm import bpe, jaccard_join, line_dedup, mixing, toxicity
from qforge.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = line_dedup.drop_boilerplate_lines(docs, min_sites=None)
    own = {"text": F.col("clean_text").alias("text"), "n_chars": F.length("clean_text").cast("long").alias("n_chars")}
    return clean.select(*[own.get(c, F.col(f"`{c}`")) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, width=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = bpe.encode_decode(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json"), outputs=("ids",))
    return done.select("doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("ngram_jaccard_join", drop_near_duplicates),
          ("mixing", mix_sources), ("bpe_encode_decode", encode)]

#: The learned classifier has no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
