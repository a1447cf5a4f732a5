"""Keyword scoring of addresses, domains and page texts: Column in, Column out.

The rules are ordinary dictionaries and may be replaced by the caller. They become literal
expressions, so no table is joined and no row is multiplied.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteroster.functions.fixed_values import (
    BUSINESS_KEYWORDS, CATEGORY_THRESHOLD, DEFAULT_PERSON, HEAVY_BUSINESS, HEAVY_WEIGHT,
    ROLE_CONTEXT_WEIGHT, ROLE_KEYWORDS, ROLE_NAME_WEIGHT, ROLE_PATTERN_WEIGHT, ROLE_PATTERNS,
    ROLE_PERSON, SITE_DOMAIN_WEIGHT, SITE_KEYWORDS, SITE_TEXT_CAP, SITE_TEXT_CHARS,
    SITE_TEXT_WEIGHT, UNKNOWN_BUSINESS,
)
from siteroster.functions.text import WORD, col, let


def _tokens(tokens: list[str]) -> Column:
    """A literal array; Spark folds the split away when it plans."""
    return F.split(F.lit("\n".join(tokens)), "\n") if tokens else F.array().cast("array<string>")


def _hits(tokens: list[str], where: Column) -> Column:
    """The tokens contained in a text, in rule order."""
    return F.filter(_tokens(tokens), lambda t: where.contains(t))


def _steps(count: Column, weight: float) -> Column:
    return F.array_repeat(F.lit(weight), count)


def _total(steps: Column) -> Column:
    # one addition after the other, as the order of DOUBLE additions shows in the last digit
    return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)


def _ranked(scored: list[Column], threshold: float) -> Column:
    """Structs above the threshold, best first, ties in rule order."""
    kept = F.filter(F.array(*scored), lambda c: c["confidence"] >= threshold)
    return F.transform(F.array_sort(F.transform(kept, lambda c: F.struct(
        (-c["confidence"]).alias("rank"), c["ord"].alias("ord"), c.alias("cat")))), lambda c: c["cat"])


def role_categories(email: Column | str, context: Column | str | None = None,
                    threshold: float = CATEGORY_THRESHOLD, keywords: dict | None = None,
                    patterns: dict | None = None, anchored: bool = False) -> Column:
    """Role categories of an address: array of (ord, category, confidence, keywords), best first.

    ``anchored`` wants the whole name to equal a pattern, so that ``sugar@`` is not ``ar@``.
    """
    keywords, patterns = keywords or ROLE_KEYWORDS, patterns or ROLE_PATTERNS

    def score(e: Column, around: Column | None) -> Column:
        name = F.substring_index(e, "@", 1)
        out = []
        for n, (category, words) in enumerate(keywords.items()):
            signs = _tokens(patterns.get(category, []))
            in_mail = F.filter(signs, lambda p: e.startswith(p) if anchored else e.contains(p))
            in_name = _hits(words, name)
            in_context = _hits(words, around) if around is not None else F.array().cast("array<string>")
            out.append(let(F.struct(in_mail.alias("m"), in_name.alias("n"), in_context.alias("c")), lambda h: F.struct(
                F.lit(n).alias("ord"), F.lit(category).alias("category"),
                F.least(_total(F.concat(_steps(F.size(h["m"]), ROLE_PATTERN_WEIGHT),
                                        _steps(F.size(h["n"]), ROLE_NAME_WEIGHT),
                                        _steps(F.size(h["c"]), ROLE_CONTEXT_WEIGHT))),
                        F.lit(1.0)).alias("confidence"),
                F.concat(h["m"], h["n"], F.array_except(h["c"], F.concat(h["m"], h["n"]))).alias("keywords"))))
        return _ranked(out, threshold)

    if context is None:
        return let(F.lower(col(email)), lambda e: score(e, None))
    return let(F.struct(F.lower(col(email)).alias("e"), F.lower(F.coalesce(col(context), F.lit(""))).alias("c")),
               lambda s: score(s["e"], s["c"]))


def primary_category(categories: Column | str) -> Column:
    """Best category, NULL when there is none."""
    return F.get(col(categories), F.lit(0))["category"]


def has_category(categories: Column | str, targets: list[str], min_confidence: float | None = None) -> Column:
    """Any target category reached the threshold; 0 means the default one."""
    least = min_confidence or CATEGORY_THRESHOLD
    return F.exists(col(categories), lambda c: c["category"].isin(targets) & (c["confidence"] >= least))


def contact_person(categories: Column | str) -> Column:
    """Label of the person behind an address."""
    def label(top: Column) -> Column:
        out = F.lit(DEFAULT_PERSON)
        for category, person in reversed(list(ROLE_PERSON.items())):
            out = F.when(top == category, F.lit(person)).otherwise(out)
        return out
    return let(primary_category(categories), label)


def site_categories(domain: Column | str, text: Column | str | None = None,
                    threshold: float = CATEGORY_THRESHOLD, keywords: dict | None = None,
                    text_chars: int | None = SITE_TEXT_CHARS) -> Column:
    """Site types of a domain: array of (ord, category, confidence, keywords), best first.

    Of the text the first ``text_chars`` characters count; with None all do.
    """
    keywords = keywords or SITE_KEYWORDS

    def score(d: Column, head: Column | None) -> Column:
        out = []
        for n, (category, words) in enumerate(keywords.items()):
            in_text = _hits(words, head) if head is not None else F.array().cast("array<string>")
            out.append(let(F.struct(_hits(words, d).alias("d"), in_text.alias("t")), lambda h: F.struct(
                F.lit(n).alias("ord"), F.lit(category).alias("category"),
                F.least(_total(_steps(F.size(h["d"]), SITE_DOMAIN_WEIGHT)) + F.least(
                    F.size(h["t"]) * F.lit(SITE_TEXT_WEIGHT), F.lit(SITE_TEXT_CAP)),
                    F.lit(1.0)).alias("confidence"),
                F.array_sort(F.array_union(h["d"], h["t"])).alias("keywords"))))
        return _ranked(out, threshold)

    if text is None:
        return let(F.lower(col(domain)), lambda d: score(d, None))
    whole = F.lower(F.coalesce(col(text), F.lit("")))
    head = whole if text_chars is None else F.substring(whole, 1, text_chars)
    return let(F.struct(F.lower(col(domain)).alias("d"), head.alias("t")), lambda s: score(s["d"], s["t"]))


def business_type(text: Column | str, keywords: dict | None = None,
                  heavy: list[str] | None = None) -> Column:
    """Best business label of a page text by whole-word counts; the first maximum wins.

    Single words are found by one alternation in one scan. Phrases may overlap a single word
    ("health club", "health"), so each has a scan of its own, made only where it occurs.
    """
    keywords = keywords or BUSINESS_KEYWORDS
    heavy = HEAVY_BUSINESS if heavy is None else heavy
    words = sorted({w for ws in keywords.values() for w in ws if re.fullmatch(r"\w+", w)})
    # words of one first letter share it; only a whole word can match, so their order does not matter
    tails = [f"{c}(?:{'|'.join(w[1:] for w in words if w[0] == c)})" for c in sorted({w[0] for w in words})]
    any_word = rf"(?<!{WORD})(?:{'|'.join(tails)})(?!{WORD})"

    def pick(t: Column) -> Column:
        def best(found: Column) -> Column:
            scores = []
            for n, (label, ws) in enumerate(keywords.items()):
                singles = [w for w in ws if w in words]
                count = F.size(F.filter(found, lambda w: w.isin(singles)))
                for phrase in (w for w in ws if w not in words):
                    spelled = rf"(?<!{WORD}){re.escape(phrase)}(?!{WORD})"
                    count = count + F.when(t.contains(phrase), F.regexp_count(t, F.lit(spelled))).otherwise(0)
                weight = HEAVY_WEIGHT if label in heavy else 1
                scores.append(F.struct((count * weight).alias("score"), F.lit(-n).alias("order"),
                                       F.lit(label).alias("label")))
            return let(F.array_max(F.array(*scores)), lambda s: F.when(s["score"] > 0, s["label"]).otherwise(
                UNKNOWN_BUSINESS))
        return let(F.regexp_extract_all(t, F.lit(any_word), F.lit(0)), best)

    return let(F.lower(F.coalesce(col(text), F.lit(""))), pick)


def _rule_of(category: str):
    return lambda token: F.struct(F.lit(category).alias("category"), token.alias("token"))


def matched_rules(text: Column | str, rules: dict) -> Column:
    """Every (category, token) whose token occurs in the text, in rule order."""
    return let(F.lower(col(text)), lambda t: F.concat(*[
        F.transform(_hits(tokens, t), _rule_of(category))
        for category, tokens in rules.items()]))


def rule_rows() -> list[tuple[str, int, str, str, str]]:
    """The built-in rules as rows (family, ord, category, kind, token)."""
    rows = []
    for family, kind, rules in (("role", "keyword", ROLE_KEYWORDS), ("role", "pattern", ROLE_PATTERNS),
                                ("site", "keyword", SITE_KEYWORDS), ("business", "keyword", BUSINESS_KEYWORDS)):
        for n, (category, tokens) in enumerate(rules.items()):
            rows += [(family, n, category, kind, token) for token in tokens]
    return rows
