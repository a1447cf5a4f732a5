"""Running totals and row numbers that hold when one key has most of the rows.

A plain window over a key sends all rows of that key to one task. Here the rows are cut into
ranges of (key, order) first. Each range is scanned on its own, and only one small row per
range and key carries the totals over to the next range.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteroster.session import durable


@dataclass(frozen=True)
class Looks:
    """What is asked of the rows before a row: see ``running``."""

    sums: dict[str, Column] = field(default_factory=dict)
    previous: dict[str, Column] = field(default_factory=dict)
    earliest: dict[str, Column] = field(default_factory=dict)
    latest: dict[str, Column] = field(default_factory=dict)

    def measures(self) -> list[Column]:
        return [*[c.alias(f"_sum_{n}") for n, c in self.sums.items()], *[c.alias(f"_prev_{n}") for n, c in self.previous.items()],
                *[c.alias(f"_first_{n}") for n, c in self.earliest.items()], *[c.alias(f"_late_{n}") for n, c in self.latest.items()]]

    def carried(self, parts: DataFrame, group: list[str], at: Column) -> DataFrame:
        """One small row per range (and key): what all ranges before it hand over."""
        totals = parts.groupBy(*group).agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.sum(f"_sum_{n}").alias(f"_t_{n}") for n in self.sums],
            *[F.max_by(F.struct(f"_prev_{n}"), at).alias(f"_l_{n}") for n in self.previous],
            *[F.min_by(F.struct(f"_first_{n}"), at).alias(f"_f_{n}") for n in self.earliest],
            *[F.max_by(f"_late_{n}", F.when(F.col(f"_late_{n}").isNotNull(), at)).alias(f"_v_{n}") for n in self.latest])
        chain = W.partitionBy(*group[1:]).orderBy("_slice")
        earlier = chain.rowsBetween(W.unboundedPreceding, -1)
        return totals.select(
            *group,
            *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in self.sums],
            *[F.lag(f"_l_{n}").over(chain).alias(f"_last_{n}") for n in self.previous],
            *[F.first(f"_f_{n}").over(chain.rowsBetween(W.unboundedPreceding, 0)).alias(f"_start_{n}") for n in self.earliest],
            *[F.last(f"_v_{n}", ignorenulls=True).over(earlier).alias(f"_past_{n}") for n in self.latest])

    def inside(self, group: list[str], order: list[str]) -> list[Column]:
        """The same within a range."""
        rows = W.partitionBy(*group).orderBy(*order)
        above = rows.rowsBetween(W.unboundedPreceding, -1)
        return [*[F.coalesce(F.sum(f"_sum_{n}").over(above), F.lit(0)).alias(f"_local_{n}") for n in self.sums],
                *[F.lag(F.struct(f"_prev_{n}")).over(rows).alias(f"_lag_{n}") for n in self.previous],
                *[F.last(f"_late_{n}", ignorenulls=True).over(above).alias(f"_near_{n}") for n in self.latest]]

    def results(self) -> list[Column]:
        return [*[(F.col(f"_local_{n}") + F.col(f"_before_{n}")).alias(n) for n in self.sums],
                *[F.coalesce(F.col(f"_lag_{n}"), F.col(f"_last_{n}"))[f"_prev_{n}"].alias(n) for n in self.previous],
                *[F.col(f"_start_{n}")[f"_first_{n}"].alias(n) for n in self.earliest],
                *[F.coalesce(f"_near_{n}", f"_past_{n}").alias(n) for n in self.latest]]


def running(df: DataFrame, order: list[str], keys: list[str] | None = None,
            sums: dict[str, Column] | None = None, previous: dict[str, Column] | None = None,
            earliest: dict[str, Column] | None = None, latest: dict[str, Column] | None = None,
            slices: int | None = None, overall: Looks | None = None) -> DataFrame:
    """Add columns that look at the rows before each row of the same key.

    ``sums`` adds the total over all earlier rows (0 on the first), ``previous`` the value in the
    row just before (NULL on the first), ``earliest`` the value in the first row of the key,
    ``latest`` the last earlier value that is not NULL.
    ``order`` must not leave ties. Without ``keys`` the whole table is one sequence. ``overall`` asks the same of the
    whole table besides, by the same ranges: they are then cut by ``order`` alone, and each hands over
    its totals once for all rows and once per key.
    """
    looks = Looks(sums or {}, previous or {}, earliest or {}, latest or {})
    # As one struct the key is never NULL: windows and the join below then agree on its hash.
    group = ["_slice", "_key"] if keys else ["_slice"]
    measured = df.select("*", *([F.struct(*keys).alias("_key")] if keys else []), *looks.measures(), *(overall.measures() if overall else []))
    by = [F.col(c) for c in [*(keys if keys and not overall else []), *order]]
    ranged = measured.repartitionByRange(slices, *by) if slices else measured.repartitionByRange(*by)
    # Written once: ranges come from a sample, and both readers below must see the same ones.
    parts = durable(ranged.withColumn("_slice", F.spark_partition_id()), "ranges")

    at = F.struct(*[F.col(c) for c in order])
    found = parts.select("*", *looks.inside(group, order), *(overall.inside(["_slice"], order) if overall else []))
    found = found.join(looks.carried(parts, group, at), group)
    if overall:
        found = found.join(overall.carried(parts, ["_slice"], at), "_slice")
    return found.select(*[F.col(c) for c in df.columns], *looks.results(), *(overall.results() if overall else []))


def with_index(df: DataFrame, order: list[str], keys: list[str] | None = None, name: str = "index",
               start: int = 1) -> DataFrame:
    """Consecutive row numbers, per key or over the whole table."""
    return running(df, order, keys, sums={name: F.lit(1)}).withColumn(name, F.col(name) + start)
