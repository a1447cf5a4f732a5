"""Table helpers: dedup, chunks, index columns, summary statistics, skew-safe lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteroster.functions.contacts import email_domain, email_username
from siteroster.operators.running import running, with_index
from siteroster.session import durable

#: A key of more rows than this is spread over several tasks.
HOT_ROWS = 1_000_000


def dedup_by_key(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """First row of each key by ``order``. Rank 1 is cut on the map side already, so a hot key
    shuffles one row per input partition."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select("*", *[(F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(keys, names)])
    w = W.partitionBy(*names).orderBy(*order)
    return keyed.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", *names)


def cap_rows(df: DataFrame, keys: list[str], order: list[Column | str], limit: int,
             name: str = "rank") -> DataFrame:
    """At most ``limit`` rows per key, numbered in order; cut on the map side as well."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= limit)


def chunk_rows(df: DataFrame, value: str, size: int, order: list[str],
               keys: list[str] | None = None) -> DataFrame:
    """Fixed-size batches of ``value`` in order: (keys, chunk, items)."""
    keys = keys or []
    numbered = with_index(df.select(*dict.fromkeys([*keys, *order, value])), order, keys, name="_i", start=0)
    return (numbered.withColumn("chunk", F.floor(F.col("_i") / size))
            .groupBy(*keys, "chunk")
            .agg(F.sort_array(F.collect_list(F.struct("_i", F.col(value).alias("v")))).alias("_items"))
            .select(*keys, "chunk", F.transform("_items", lambda x: x["v"]).alias("items")))


def flatten_rows(df: DataFrame, nested: str, name: str = "item") -> DataFrame:
    """One row per element of an array of arrays, in order, with its position."""
    return df.select(*[c for c in df.columns if c != nested],
                     F.posexplode(F.flatten(nested)).alias("pos", name))


def standard_format(df: DataFrame, email: str, order: list[str], with_time: bool = True) -> DataFrame:
    """index, email, username, domain and (option) the time of the run."""
    out = with_index(df, order).select(
        "index", F.col(email).alias("email"), email_username(email).alias("username"),
        email_domain(email).alias("domain"))
    return out.withColumn("extracted_at", F.current_timestamp()) if with_time else out


def detailed_format(df: DataFrame, order: list[str], with_time: bool = True) -> DataFrame:
    """Detailed rows of columns email, username, domain, confidence, is_valid, context.

    The rows are written first: numbering samples its input, and hits are costly to find twice.
    """
    columns = dict.fromkeys([*order, "email", "username", "domain", "confidence", "is_valid", "context"])
    out = with_index(durable(df.select(*columns), "hits"), order).select(
        "index", "email", "username", "domain", F.bround("confidence", 2).alias("confidence_score"),
        "is_valid", F.coalesce(F.left("context", F.lit(100)), F.lit("")).alias("context"))
    return out.withColumn("extracted_at", F.current_timestamp()) if with_time else out


def simple_index(df: DataFrame, email: str, order: list[str], include_index: bool = True) -> DataFrame:
    """``Index, Email`` rows for a plain list file."""
    if not include_index:
        return df.select(F.col(email).alias("Email"))
    return with_index(df, order, name="Index").select("Index", F.col(email).alias("Email"))


def summary_stats(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """count, min, max, mean, median and sum per key; zeros for an empty table.

    The median is exact without gathering a key's values: equal values are counted first and
    the middle ones are found by their running counts.
    """
    keys = keys or []
    basics = df.groupBy(*keys).agg(
        F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.avg(value).alias("mean"), F.sum(value).alias("sum"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(counts, [value], keys, sums={"_below": F.col("_n")})
    names = ("count", "min", "max", "mean", "median", "sum")

    def median_of(rows: DataFrame, size: Column, *by: Column) -> DataFrame:
        middle = rows.filter((F.col("_below") <= F.floor(size / 2))
                             & (F.col("_below") + F.col("_n") > F.floor((size - 1) / 2)))
        # one or two distinct values are left per key
        return middle.groupBy(*by).agg(((F.min(value) + F.max(value)) / 2).alias("median"))

    if keys:
        def same(other: str) -> Column:
            return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in keys])

        sizes = basics.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col("count").alias("_size"))
        medians = median_of(ranked.join(sizes, same("_s_")), F.col("_size"), *[F.col(k).alias(f"_m_{k}") for k in keys])
        joined = basics.join(medians, same("_m_"), "left")
    else:
        medians = median_of(ranked, basics.select("count").scalar())
        joined = basics.withColumn("median", medians.scalar())
    return joined.select(*keys, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names])


def skew_safe_lookup(rows: DataFrame, table: DataFrame, key: str, spread_by: list[str], how: str = "left",
                     hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join ``table`` (one row per key) onto ``rows`` whose keys may be hot.

    Keys of more than ``hot_rows`` rows are counted first. Their rows spread over as many salts as they have ``hot_rows`` by
    the hash of ``spread_by``, and only their table rows are copied, one for each salt. The salt depends on the row alone, so a
    repeated task sends each row to the same place. ``rows`` is read twice, the first time for its keys only.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    # at most one key per hot_rows rows is in here, so the broadcast is small by count
    hot = F.broadcast(counts.select(key, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    salted = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread_by), salts).cast("int")).drop("_salts")
    copies = table.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return salted.join(copies, [key, "_salt"], how).drop("_salt")
