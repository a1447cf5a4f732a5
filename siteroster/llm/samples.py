"""Bounded, repeatable samples of labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most, and the bytes of a text that may take part.
FIT_ROWS, FIT_BYTES = 4000, 1 << 16


def labelled(documents: DataFrame, labels: DataFrame, label: str, learnable: Column, rows: int = FIT_ROWS,
             text: str = "text", longest: int = FIT_BYTES) -> list[tuple[str, object]]:
    """At most ``rows`` (text, label) pairs of ``labels`` rows that are ``learnable``, the same in every run.

    Rows with a NULL id or label do not take part, nor do texts of more than ``longest`` bytes. The ids are
    chosen by hash before any text is read; being ``rows`` in number, they may be broadcast.
    """
    chosen = (labels.filter(learnable & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
              .select(F.col("doc_id").alias("_id"), F.col(label).alias("_label"))
              .orderBy(F.xxhash64("_id"), "_id", "_label").limit(rows))
    found = (documents.filter(F.octet_length(text) <= longest).select("doc_id", F.col(text).alias("_text"))
             .join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).orderBy("doc_id", "_label", "_text").limit(2 * rows))
    return [(r["_text"], r["_label"]) for r in found.select("_text", "_label").collect()]
