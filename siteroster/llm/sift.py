"""Rows that may be wanted, picked before a shuffle.

A join that fetches a few texts by id would otherwise move every text of the corpus. The wanted ids are folded
into a table of bits, which is broadcast; rows whose bit is not set are surely not wanted and stay where they
are. The table grows with the ids up to a fixed size. Beyond it more rows pass than are wanted, but none is
lost: the join that follows decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each wanted id, and the most bits of a table: 64 to a row, so at most 2^20 rows are broadcast.
BITS_PER_ID, MOST_BITS, LEAST_BITS = 16, 1 << 26, 1 << 10


def sift(rows: DataFrame, key: str, wanted: DataFrame, name: str) -> DataFrame:
    """All rows of ``rows`` whose ``key`` is among the values of ``name`` in ``wanted``, and few others.

    Rows with a NULL key never pass, and an empty ``wanted`` lets none pass. ``wanted`` is read
    twice; both columns hold whole numbers.
    """
    ids = wanted.select(F.col(name).cast("long").alias("_id")).filter("_id IS NOT NULL")
    size = max(LEAST_BITS, min(MOST_BITS, 1 << (BITS_PER_ID * ids.count()).bit_length()))

    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c.cast("long")), F.lit(size).cast("long"))

    words = (ids.select(place(F.col("_id")).alias("_place")).groupBy(F.shiftright("_place", 6).alias("_word"))
             .agg(F.expr("bit_or(shiftleft(1L, CAST(_place & 63 AS INT)))").alias("_bits")))
    return (rows.filter(F.col(key).isNotNull()).withColumn("_place", place(F.col(key)))
            .join(F.broadcast(words), F.shiftright("_place", 6) == F.col("_word"))
            .filter("shiftright(_bits, CAST(_place & 63 AS INT)) & 1L = 1L").select(*rows.columns))
