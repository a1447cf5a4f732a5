"""Registered queries of this subpackage, and the SQL that checks those that SQL can express.

Each query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteroster.llm import (byte_bpe, cascade, check_sql, decontaminate, jaccard, kneser_ney, language, merkle, perspectives, prefix_trie, quality_cnn,
                            samples, substrings, token_counts, toxicity)
from siteroster.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

#: Tokenizer files of the numbered queries.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def query(name: str, check: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check
        return fn
    return add


def held_out(parts: int, rest: int):
    """Rows that labels are never learned from; a NULL id is among them."""
    return F.coalesce(fold("doc_id", parts) == rest, F.lit(True))


@query("op1_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items of which a passage is in a document: passages found, and edits of the best."""
    found = decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(
        F.countDistinct("item_start").alias("n_passages"), F.min("edits").alias("fewest_edits"), F.min("start").alias("first_byte"))


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(samples.labelled(docs, table(spark, sf_dir, "labels"), "toxic", ~held_out(5, 0)))
    return toxicity.score_toxicity(docs.select("doc_id", held_out(5, 0).alias("held_out"), "text"), model).drop("text")


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality_cnn.fit(samples.labelled(docs, table(spark, sf_dir, "labels"), "quality", ~held_out(3, 1)))
    return quality_cnn.score_quality(docs.select("doc_id", held_out(3, 1).alias("held_out"), "text"), net).drop("text")


@query("op4_substring_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digest(table(spark, sf_dir, "documents"))


_OP5 = """
WITH said AS (
  SELECT conv_id, turn, translate(replace(coalesce(role, 'unknown'), '<|', '< |'), chr(13) || chr(10), '  ') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS said
  FROM conversations),
seen AS (
  SELECT s.*, p.perspective,
    CASE WHEN s.speaker = p.perspective THEN 'assistant' WHEN s.speaker = 'system' THEN 'system' ELSE 'user' END AS as_role
  FROM said s JOIN (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system') p
  ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
made AS (
  SELECT *, '<|im_start|>' || as_role || CASE WHEN as_role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM seen),
placed AS (
  SELECT *, head || said || '<|im_end|>' || chr(10) AS piece,
    row_number() OVER w - 1 AS position,
    coalesce(sum(length(head || said || '<|im_end|>') + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "start"
  FROM made WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, said))
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, turn, speaker, as_role, piece, CAST("start" AS BIGINT) AS "start",
  CAST("start" + length(piece) AS BIGINT) AS "end",
  CAST(CASE WHEN as_role = 'assistant' THEN "start" + length(head) END AS BIGINT) AS learn_start,
  CAST(CASE WHEN as_role = 'assistant' THEN "start" + length(piece) - 1 END AS BIGINT) AS learn_end
FROM placed"""


@query("op5_perspectives", _OP5)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
tri AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT r, count(DISTINCT place) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS place FROM tri WHERE n > 1) GROUP BY r),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) AS n_lines FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
shout AS (
  SELECT r, count(*) FILTER (WHERE strlen(x) > 1 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')) AS n_shouted
  FROM (SELECT r, unnest(w) AS x FROM d) GROUP BY r),
f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_shouted, 0) AS n_shouted
  FROM d LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN shout USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words OR word_chars < 2 * n_words
       OR word_chars > 12 * n_words OR 100 * n_dup_lines > 30 * n_lines OR 100 * n_shouted > 50 * n_words) AS kept
FROM f"""


@query("op6_rule_cascade", _OP6)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # which rule rejects first depends on measured times, so the check can't know it
    return cascade.judge_with_figures(docs, cascade.plan(docs)).drop("text", "rejected_by", "n_rules_run")


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = language.fit(language.sample(docs, ~held_out(4, 2)))
    return language.identify(docs.select("doc_id", held_out(4, 2).alias("held_out"), "text"), net).drop("text")


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES).drop("text")


@query("op9_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_components(table(spark, sf_dir, "documents"))


@query("op10_byte_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).drop("text")


@query("op11_merkle_manifest", check_sql.merkle_manifest())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return merkle.audit(table(spark, sf_dir, "documents"), lower, fold("doc_id", 3) == 0)


@query("op12_kneser_ney")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out(10, 0).alias("held_out"), "text")
    return kneser_ney.score(docs, kneser_ney.fit(docs.filter("NOT held_out"))).drop("text")


@query("op13_prefix_trie", check_sql.prefix_trie())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered_turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.shared_prefixes(prefix_trie.reopened(turns))
