"""A training corpus from `documents`, as stages over the operators of pathglass.llm.

Every stage reads what the one before it kept, written as Parquet in between, and
all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathglass.llm import bpe_codec, chosen_path, decontaminate, lang_profiles, suffix_dedup
from pathglass.llm.common import materialise, table, unused
from pathglass.llm.queries import TOKENIZERS


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents in no language that was learned: without text, or without any letter."""
    profiles = lang_profiles.learn_profiles(docs.filter(~lang_profiles.held_out("doc_id")))
    pred = unused(docs, "pred")
    predicted = lang_profiles.predict_languages(docs, profiles, pred_col=pred, score_col=unused(docs, "pred_score"))
    return predicted.filter(F.col(pred) != "und").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group.

    Rows that repeat an id are documents of their own, unless their texts agree too:
    then they stay or go together. Rows without id go if their group has an id, and
    stay otherwise.
    """
    kept = chosen_path.near_duplicates(docs.select("doc_id", "text"), text_hash=True).filter("kept")
    kept = kept.select(F.col("doc_id").alias("id"), "text_hash").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["id"]) & (F.xxhash64(docs["text"]) == kept["text_hash"]), "left_semi")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document holds; a document of which nothing is left goes."""
    cleaned = suffix_dedup.remove_repeats(docs, figures_as=(size := unused(docs, "n_bytes"), gone := unused(docs, "n_removed"), unused(docs, "n_spans"), unused(docs, "kept_sha256")))
    rest = cleaned.filter((F.col(gone) == 0) | (F.col(gone) < F.col(size)))
    return rest.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap with a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left, and decode it again as a check."""
    return bpe_codec.round_trip_digests(docs, f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken")


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark),
    ("bpe_encode_decode", tokens),
]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
