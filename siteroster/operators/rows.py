"""Small plan shapers for costly column expressions.

Spark copies the expression of a computed column into every filter on it, and an ``explode`` adds
a filter of its own on the size of its array. For expressions full of regular expressions that
means doing the work two or three times. ``once`` and ``unnest`` keep it at once; ``fan_out`` and ``spread`` give it to all cores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that one task works on, of a table whose rows cost milliseconds each.
ROWS_A_TASK = 2048


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once, however often later steps use or filter them."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def unnest(df: DataFrame, keep: list[str | Column], array: Column | str, value: str, pos: str = "pos") -> DataFrame:
    """One row per array element with its position; rows with an empty array vanish."""
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).filter(F.col(pos).isNotNull())


def fan_out(df: DataFrame) -> DataFrame:
    """Spread a table that arrives in fewer pieces than there are cores, as one small file does.

    For row-local work that is heavy on CPU. A table of many splits stays as it is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread(df: DataFrame, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """Deal a table out again unless it fills as many splits as there are cores and none has more than ``rows_a_task`` rows.

    Rows are counted per split, as a file of one row group may have many splits and all its rows in one of them; of a
    Parquet table only the footers are read for that. Use it on narrow rows, before costly columns are made of them.
    """
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not sizes or len(sizes) >= cores and max(sizes) <= rows_a_task:
        return df
    return df.repartition(max(cores, -(-sum(sizes) // rows_a_task)))
