"""Corpus pipeline: documents to packed sequences in stages, each written as Parquet and reread by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tassel.llm import op3_language, op4_pii, op6_decontaminate, op8_jaccard, op9_packing
from tassel.llm.common import Scratch, documents

#: A language is taken for sure if its code is shorter than all others' together.
SURE = 0.5
#: A test key; a user sets a secret one.
KEY = "corpus-pipeline"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CAPACITY = 2048


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without text go, and short ones between languages.

    The score is the best language's share for the whole text, practically 1 from a few dozen bytes on: junk with
    letters and texts in a language never learned stay, under the learned language nearest to them.
    """
    rows = docs.select("doc_id", "text", "lang", F.struct("*").alias("row"))
    found = op3_language.predict_languages(rows, keep=["row"], text="row.text")
    kept = found.filter((F.col("lang_pred") != op3_language.UNKNOWN) & (F.col("score") >= SURE))
    return kept.select("row.*")


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest doc_id."""
    return op8_jaccard.drop_similar(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in windows of benchmark items."""
    rows = docs.select(F.struct("*").alias("row"))
    found = op6_decontaminate.find_passages(rows, documents(spark, sf_dir, "benchmark"), ["row"], text="row.text")
    hit = op6_decontaminate.is_contaminated(op6_decontaminate.hit_words(), F.col("n_words"))
    return found.filter(~hit).select("row.*")


def replace_personal_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal values; n_chars follows the new text."""
    out = op4_pii.pseudonymise(docs, KEY).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    return op9_packing.pack(docs, TOKENIZER, CAPACITY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("jaccard_join", keep_one_of_similar),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_values),
    ("packing", pack_sequences),
]
#: Trees, permutations and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
