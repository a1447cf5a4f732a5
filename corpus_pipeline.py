"""A corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, token ids.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), and its result is written and read
back as the next one's ``docs``. All but the last return the columns of ``documents``, and each gives no rows for
an empty table. NULL and empty texts are empty to every stage; rows with a NULL id are judged by their text alone and are neither
near copies nor repeats of others. Repeated rows stay or go together. Texts are worked on whole, whatever their length.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteroster.llm import byte_bpe, decontaminate, jaccard, quality_cnn, samples, substrings
from siteroster.llm.common import table
from siteroster.llm.queries import RANKS
from siteroster.session import durable

#: No SQL: a trained classifier is among the stages.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more. It learns from all labelled rows of ``docs``; without labels
    of both kinds it keeps all or none, by the kind there is (all, when there is none)."""
    net = quality_cnn.fit(samples.labelled(docs, table(spark, sf_dir, "labels"), "quality", F.lit(True)))
    return quality_cnn.keep_good(docs, net)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, with all rows of that id."""
    return jaccard.one_per_component(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words and more that an earlier document has. A text may become empty; its row stays."""
    out = substrings.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.without_passages(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as packed little-endian unsigned 32-bit integers."""
    return byte_bpe.encode(docs.select("doc_id", "text"), RANKS, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("benchmark_leaks", benchmark_leaks), ("token_ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
