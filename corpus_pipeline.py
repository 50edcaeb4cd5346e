"""Documents to training tokens in five stages, each written as Parquet and read again as the next one's input.

Cases, as in the operators: a null text counts as one of low statistics in the first stage, has no shingles, no words,
no values and no tokens, and stays null until the last. Rows that repeat a doc_id are decided each on its own text;
rows that repeat both stay or go together. An empty table gives an empty result. Texts of any length are read whole. The
columns of `documents` stay, whatever their names, until the last stage, which adds n_tokens, ids_sha256,
decoded_sha256 and token_ids in place of `text` and of columns with these names; n_words, n_hit and item_ids are names
that the third stage needs for itself, and columns so named go there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, near_dup, pii, quality
from lodestone.llm.common import load, small_batches
from lodestone.storage import release, scope, shared_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8."""
    return near_dup.keep_first(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    return decontaminate.keep_clean(docs, load(spark, sf_dir, "benchmark"))


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values and secrets become pseudonyms of their format; n_chars follows."""
    out = pii.pseudonymise(docs, pii.session_key(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to, in place of the text."""
    return bpe.encode(docs, *bpe.public_ranks(), shortcuts=True, text=False)


STAGES = [
    ("quality classifier", quality_classifier),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("pii pseudonyms", pii_pseudonyms),
    ("byte-level bpe", byte_bpe),
]

#: A fitted classifier and MinHash are not expressible in SQL; tests hold each stage against a plain version of itself.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`. What a stage wrote for itself goes when its result is written, and that goes when the next one's is."""
    docs = load(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        with scope(), small_batches(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        release(docs)
        docs = spark.read.parquet(f"{base}/{i}")
        docs._lodestone_path = f"{base}/{i}"
    return docs
