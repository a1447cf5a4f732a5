"""Quality rules as a short-circuit cascade, ordered by rejections per cost.

Each rule is a cheap test on one text. On a bounded sample of documents the order is planned step by step: of the rules
that are left, the one with the most rejections per second among the documents that are left comes next, timed
with the figures that the rules before it have computed already. A document leaves the cascade at the first rule that
rejects it and no further figure is computed for its verdict. It is kept when no rule rejects it, so the order changes
the cost and never the verdict.

NULL and empty texts have no words and are rejected by the rule on length. Repeated rows get the same
verdict each; ties between rules keep their given order. An empty table gives no rows. The sample is ``SAMPLE_ROWS`` rows from the first
files of the table, thinned, with texts of at most ``SAMPLE_BYTES``; a sample that misleads costs time only.
"""

from __future__ import annotations

import copy
import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteroster.llm.common import add_columns

SYMBOLS = "#*$%&|<>"
_NOT_SYMBOL = re.compile(f"[^{re.escape(SYMBOLS)}]+")
#: Rows of the sample on which rules are timed, the share of rows it is drawn from, and the longest text in it.
SAMPLE_ROWS, SAMPLE_SHARE, SAMPLE_BYTES = 400, 0.1, 1 << 16


@dataclass
class Doc:
    """One text; each figure is computed when a rule first asks for it."""

    text: str

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()  # ASCII white space only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(b"".join(self.words).decode())

    @cached_property
    def n_symbols(self) -> int:
        return len(_NOT_SYMBOL.sub("", self.text))

    @cached_property
    def lines(self) -> list[str]:
        """Lines that hold a word."""
        return [x for x in self.text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of three words that are found twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        often = {x for x, n in Counter(windows).items() if n > 1}
        total, end = 0, 0
        for i, x in enumerate(windows):
            if x in often:
                total += i + 3 - max(i, end)
                end = i + 3
        return total

    @cached_property
    def n_shouted(self) -> int:
        """Words of two or more letters, all capitals."""
        return sum(w.isupper() and len(w) > 1 for w in self.words)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Doc], bool]


def too_short(least: int = 50) -> Rule:
    return Rule("too_short", lambda d: d.n_words < least)


def repeats_itself(percent: int = 50) -> Rule:
    return Rule("repeats_itself", lambda d: 100 * d.n_repeat_words > percent * d.n_words)


def symbols(percent: int = 10) -> Rule:
    """More symbols than so many for a hundred words."""
    return Rule("symbols", lambda d: 100 * d.n_symbols > percent * d.n_words)


def word_length(shortest: int = 2, longest: int = 12) -> Rule:
    return Rule("word_length", lambda d: not shortest * d.n_words <= d.word_chars <= longest * d.n_words)


def duplicate_lines(percent: int = 30) -> Rule:
    return Rule("duplicate_lines", lambda d: 100 * d.n_dup_lines > percent * len(d.lines))


def shouting(percent: int = 50) -> Rule:
    return Rule("shouting", lambda d: 100 * d.n_shouted > percent * d.n_words)


#: What a document must fulfil anyway, and the rules of the production cascade.
BASE = (too_short(), repeats_itself())
RULES = (*BASE, symbols(), word_length(), duplicate_lines(), shouting())


@dataclass
class Plan:
    """Rules in the order in which they run; of each the seconds and rejections measured in its place."""

    rules: tuple[Rule, ...]
    measured: dict[str, tuple[float, int]] = field(default_factory=dict)


def plan(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> Plan:
    """Order the rules by what a sample of ``rows`` texts tells; without any text they stay in their given order."""
    short = df.select(F.col(text).alias("t")).filter(F.coalesce(F.octet_length("t"), F.lit(0)) <= SAMPLE_BYTES)
    sample = short.sample(SAMPLE_SHARE, seed=1).limit(rows).collect()
    return plan_on([r["t"] for r in sample or short.limit(rows).collect()], rules)


def plan_on(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> Plan:
    """Greedy order: marginal cost and rejections of each rule, given the rules before it."""
    docs, left, order, measured = [Doc(t or "") for t in texts], list(rules), [], {}
    while left:
        tried = []
        for rule in left:
            # copies keep the figures that earlier rules needed
            copies = [copy.copy(d) for d in docs]
            begin = time.perf_counter()
            hits = sum(map(rule.rejects, copies))
            tried.append((max(time.perf_counter() - begin, 1e-9), hits))
        best = max(range(len(left)), key=lambda i: (tried[i][1] / tried[i][0], -i))
        rule = left.pop(best)
        order.append(rule)
        measured[rule.name] = tried[best]
        docs = [d for d in docs if not rule.rejects(d)]
    return Plan(tuple(order), measured)


def judge(df: DataFrame, ordered: Plan, text: str = "text") -> DataFrame:
    """Add kept, rejected_by (the first rule that rejects, NULL for none) and n_rules_run."""
    rules = ordered.rules

    def score(texts):
        out = {"kept": [], "rejected_by": [], "n_rules_run": []}
        for t in texts:
            by, n = _first(rules, Doc(t or ""))
            out["kept"].append(by is None)
            out["rejected_by"].append(by)
            out["n_rules_run"].append(n)
        return out
    return add_columns(df, text, "kept boolean, rejected_by string, n_rules_run integer", score)


def _first(rules: tuple[Rule, ...], doc: Doc) -> tuple[str | None, int]:
    for n, rule in enumerate(rules, 1):
        if rule.rejects(doc):
            return rule.name, n
    return None, len(rules)


def judge_with_figures(df: DataFrame, ordered: Plan, text: str = "text") -> DataFrame:
    """Like ``judge``, with the base figures of every document beside the verdict.

    The verdict is that of the cascade; then the figures that it had no need of are computed. ``base_failed`` says
    what the rules of BASE would say of the figures.
    """
    figures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def score(texts):
        out = {name: [] for name in (*figures, "base_failed", "kept", "rejected_by", "n_rules_run")}
        for t in texts:
            doc = Doc(t or "")
            by, n = _first(ordered.rules, doc)
            out["kept"].append(by is None)
            out["rejected_by"].append(by)
            out["n_rules_run"].append(n)
            for name in figures:
                out[name].append(getattr(doc, name))
            out["base_failed"].append(any(r.rejects(doc) for r in BASE))
        return out
    ddl = ", ".join(f"{name} long" for name in figures)
    return add_columns(df, text, f"{ddl}, base_failed boolean, kept boolean, rejected_by string, n_rules_run integer", score)
