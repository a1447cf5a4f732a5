"""Categories of a table of addresses, domains or page texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteroster.functions import categories as G
from siteroster.functions.fixed_values import CATEGORY_THRESHOLD
from siteroster.operators.rows import once, unnest


def category_rows(df: DataFrame, keys: list[str], categories: str = "categories") -> DataFrame:
    """One row per category, ``rank`` 1 being the best."""
    return unnest(df, keys, categories, "_c", "_p").select(
        *keys, (F.col("_p") + 1).alias("rank"), F.col("_c.category").alias("category"),
        F.col("_c.confidence").alias("confidence"), F.col("_c.keywords").alias("keywords"))


def batch_categorize(df: DataFrame, email: str = "email", context: str | None = None,
                     threshold: float = CATEGORY_THRESHOLD) -> DataFrame:
    """Add ``categories`` to each address; an empty array where none fits."""
    return once(df, {"categories": G.role_categories(email, context, threshold)})


def category_distribution(df: DataFrame, email: str = "email") -> DataFrame:
    """Number of addresses by best category; addresses without any are not counted."""
    best = once(df.select(email), {"category": G.primary_category(G.role_categories(email))})
    return best.filter("category IS NOT NULL").groupBy("category").agg(F.count(F.lit(1)).alias("emails"))


def filter_by_category(df: DataFrame, targets: list[str], min_confidence: float | None = None,
                       email: str = "email") -> DataFrame:
    """Addresses with any target category at or above the threshold."""
    return df.filter(G.has_category(G.role_categories(email), targets, min_confidence))


def rules_table(spark) -> DataFrame:
    """Built-in rules as a table (family, ord, category, kind, token)."""
    return spark.createDataFrame(G.rule_rows(), "family string, ord int, category string, kind string, token string")


def match_rules(df: DataFrame, keys: list[str], text: str, rules: DataFrame, token: str = "token", whole_words: bool = False,
                block_bytes: int = 1 << 20) -> DataFrame:
    """Every rule whose token occurs in the text: ``keys`` and the columns of ``rules``, a row per text and rule.

    Case does not count. All tokens are found in one scan by an Aho-Corasick automaton, which each task builds from the
    rules, so the cost of a text does not grow with their number. Rules travel in blocks of ``block_bytes``, a tenth of Spark's
    own limit for broadcasts; a larger table makes one more pass over the texts per block. NULL and empty texts and tokens match nothing; a rule listed
    twice matches twice. ``whole_words`` asks for a letter, digit or underscore on neither side.
    """
    names = [*keys, *rules.columns]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError("keys and rules share a column name")
    schema = T.StructType([*[df.schema[k] for k in keys], *rules.schema.fields])
    rows = df.select(*keys, F.lower(F.col(text).cast("string")).alias("_text"))
    parts = [rows.mapInArrow(_matcher(block, len(keys), names, whole_words), schema) for block in _blocks(rules, token, block_bytes)]
    return reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], schema)


def _blocks(rules: DataFrame, token: str, block_bytes: int) -> Iterator[pa.Table]:
    """The rules with their tokens in lower case beside them, in tables of bounded size."""
    listed = rules.withColumn("_token", F.lower(F.col(token).cast("string"))).filter("_token != ''")
    weight = F.sum(F.octet_length("_token") + 100)
    size = listed.agg(weight).first()[0] or 0
    count = -(-size // block_bytes)
    for i in range(count):
        yield listed.filter(F.pmod(F.xxhash64("_token"), F.lit(count)) == i).toArrow()


def _matcher(block: pa.Table, n_keys: int, names: list[str], whole_words: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where: dict[str, list[int]] = {}
        for i, word in enumerate(block.column("_token").to_pylist()):
            where.setdefault(word, []).append(i)
        machine = ahocorasick.Automaton()
        for word, at in where.items():
            machine.add_word(word, (len(word), at))
        machine.make_automaton()
        plain = block.drop_columns(["_token"]).combine_chunks()
        for batch in batches:
            row, rule = [], []
            for i, text in enumerate(batch.column(n_keys).to_pylist()):
                found: set[int] = set()
                for last, (size, at) in machine.iter(text or ""):
                    if not (whole_words and (in_word(text[last - size:last - size + 1] if last >= size else "") or in_word(text[last + 1:last + 2]))):
                        found.update(at)
                row += [i] * len(found)
                rule += sorted(found)
            columns = [batch.column(k).take(pa.array(row, pa.int64())) for k in range(n_keys)]
            taken = plain.take(pa.array(rule, pa.int64())).combine_chunks()
            columns += [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in taken.columns]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def in_word(c: str) -> bool:
        return c.isalnum() or c == "_"
    return work
