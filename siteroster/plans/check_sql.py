"""Building blocks of the check SQL, for DuckDB and its RE2 expressions.

RE2 has no lookaround and an ASCII idea of words and spaces, so the classes are written out.
"""

from __future__ import annotations

from siteroster.functions.fixed_values import (
    BUSINESS_KEYWORDS, CONTENT_TAGS, EMAIL_HOST, EMAIL_LOCAL, FREE_MAIL_WORDS, HEAVY_BUSINESS, HEAVY_WEIGHT,
    JUNK_DOMAINS, JUNK_EXTENSIONS, MAILTO_CONTEXT, NAV_TAGS, PHONE_PARTS, ROLE_KEYWORDS, ROLE_PATTERNS,
    SITE_KEYWORDS, SOCIAL_URL, URL_LABEL, URL_SKIPPED_ENDINGS, URL_TRIM,
)

S = (r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
SPACE = f"[{S}]"
EDGE = r"(^|[^\p{L}\p{N}_])"
EMAIL = rf"{EMAIL_LOCAL}@{EMAIL_HOST}\b"
PHONE = PHONE_PARTS.format(d=r"\p{Nd}", s=S)
URL = (rf"(?:https?://(?:www\.)?{URL_LABEL}\.[^{S}]{{2,}}|www\.{URL_LABEL}\.[^{S}]{{2,}}"
       r"|https?://(?:[a-zA-Z0-9]+\.)+[a-zA-Z]{2,})")
URL_PARTS = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(items: list[str]) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]::VARCHAR[]"


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {by if by.startswith('chr') or '||' in by else lit(by)}, 'g')"


def strip(x: str) -> str:
    return sub(x, rf"^{SPACE}+|{SPACE}+$", "")


def squeeze(x: str) -> str:
    return strip(sub(x, f"{SPACE}+", " "))


def deobfuscate(x: str) -> str:
    for word, sign in (("at", "@"), ("dot", ".")):
        x = sub(x, rf"(?i){SPACE}*\[{word}\]{SPACE}*", sign)
        x = sub(x, rf"(?i){SPACE}*\({word}\){SPACE}*", sign)
        x = sub(x, rf"(?i){SPACE}+{word}{SPACE}+", sign)
    return x


def references(x: str) -> str:
    for name, char in (("copy", "\xa9"), ("middot", "\xb7"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        x = sub(x, f"&{name};?", char)
    return x


def markup(x: str) -> str:
    for tag in ("script", "style"):
        x = sub(x, rf"(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|$)", " ")
    return sub(x, "(?s)<!--(.*?)-->", "")


def page_text(x: str) -> str:
    for tag in ("script", "style"):
        x = sub(x, rf"(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|$)", " ")
    x = sub(x, "(?s)<!--(.*?)-->", r" \1 ")
    x = sub(x, r"(?i)<!doctype\s*([^>]*)>", r" \1 ")
    for tag in [*CONTENT_TAGS, *NAV_TAGS]:
        if tag not in ("script", "style", "embed"):
            x = sub(x, rf"(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|$)", " ")
    x = references(sub(x, "<[a-zA-Z/][^>]*>", " "))
    return sub(sub(squeeze(x), rf"\[{SPACE}*\]", ""), rf"\({SPACE}*\)", "")


def word_count(x: str) -> str:
    return f"CASE WHEN {squeeze(x)} = '' THEN 0 ELSE len(string_split({squeeze(x)}, ' ')) END"


def element_text(x: str) -> str:
    """Text nodes trimmed and glued."""
    return (f"array_to_string(list_transform(regexp_split_to_array({x}, '<[a-zA-Z/][^>]*>'), "
            f"lambda n: {strip(references('n'))}), '')")


def attribute(x: str, name: str) -> str:
    raw = f"regexp_extract({x}, {lit(rf'(?i)(?:^|\s){name}=\"([^\"]*)\"')}, 1)"
    return references(raw)


# --- URLs ----------------------------------------------------------------------------------

def part(x: str, group: int) -> str:
    return f"regexp_extract({x}, {lit(URL_PARTS)}, {group})"


def scheme(x: str) -> str:
    return f"lower({part(x, 1)})"


def path(x: str) -> str:
    return sub(part(x, 3), ";[^/]*$", "")


def valid_url(x: str) -> str:
    return f"({scheme(x)} IN ('http', 'https') AND {part(x, 2)} <> '')"


def clean_url(x: str) -> str:
    trimmed = f"trim({x}, {lit(URL_TRIM)})"
    full = (f"CASE WHEN {trimmed} LIKE 'www.%' THEN 'https://' || {trimmed} "
            f"WHEN {trimmed} LIKE 'http://%' OR {trimmed} LIKE 'https://%' THEN {trimmed} END")
    ends = "|".join(e.replace(".", r"\.") for e in URL_SKIPPED_ENDINGS)
    return (f"CASE WHEN {part(f'({full})', 2)} <> '' AND NOT regexp_matches({path(f'({full})')}, "
            f"{lit(f'(?i)(?:{ends})$')}) THEN {full} END")


def resolve(base: str, href: str) -> str:
    root = f"{scheme(base)} || '://' || {part(base, 2)}"
    return (
        f"CASE WHEN {href} LIKE 'http://%' OR {href} LIKE 'https://%' THEN {href} "
        f"WHEN {scheme(href)} <> '' THEN {href} WHEN {href} LIKE '//%' THEN {scheme(base)} || ':' || {href} "
        f"WHEN {href} LIKE '/%' THEN {root} || {href} "
        f"WHEN {href} LIKE '?%' THEN {root} || {part(base, 3)} || {href} "
        f"ELSE {root} || CASE WHEN {part(base, 3)} = '' THEN '/' ELSE {sub(part(base, 3), '[^/]*$', '')} END || {href} END")


# --- contacts ------------------------------------------------------------------------------

def username(x: str) -> str:
    return f"split_part({x}, '@', 1)"


def domain(x: str) -> str:
    return f"CASE WHEN contains({x}, '@') THEN substr({x}, strpos({x}, '@') + 1) ELSE '' END"


def junk(x: str) -> str:
    d = f"({domain(x)})"
    return (f"(list_contains({strings(JUNK_DOMAINS)}, {d}) OR (contains({d}, '.') AND "
            f"list_contains({strings(JUNK_EXTENSIONS)}, string_split({d}, '.')[-1])))")


def confidence(x: str) -> str:
    free = " OR ".join(f"contains({domain(x)}, {lit(w)})" for w in FREE_MAIL_WORDS)
    return (f"greatest(0::DOUBLE, (CASE WHEN {free} THEN 1::DOUBLE - 0.3::DOUBLE ELSE 1::DOUBLE END) "
            f"- (CASE WHEN length({username(x)}) < 3 THEN 0.1::DOUBLE ELSE 0::DOUBLE END))")


def email_matches(x: str) -> str:
    return f"regexp_extract_all({x}, {lit(EDGE + '(' + EMAIL + ')')}, 2)"


def email_ctes(source: str, key: str, text: str, min_confidence: float = 0.0, prefix: str = "") -> str:
    """CTEs ending in ``{prefix}hits`` (key, pos, email, domain, username, confidence, context)."""
    p = prefix
    split = f"string_split(regexp_replace({text}, {lit(EDGE + '(' + EMAIL + ')')}, '\\1' || chr(1) || '\\2' || chr(1), 'g'), chr(1))"
    before = "right(array_to_string(tok[greatest(1, 2 * i - 13):2 * i - 1], ''), 30)"
    after = "left(array_to_string(tok[2 * i + 1:2 * i + 13], ''), 30)"
    around = f"replace({before} || tok[2 * i] || {after}, chr(10), ' ')"
    return (
        f"{p}tokens AS (SELECT {key}, {split} AS tok FROM {source}), "
        f"{p}raw AS (SELECT {key}, i - 1 AS pos, lower(tok[2 * i]) AS email, '...' || {strip(around)} || '...' AS context "
        f"FROM (SELECT {key}, tok, unnest(generate_series(1, (len(tok) - 1) // 2)) AS i FROM {p}tokens)), "
        f"{p}hits AS (SELECT {key}, pos, email, {domain('email')} AS domain, {username('email')} AS username, "
        f"{confidence('email')} AS confidence, context FROM {p}raw "
        f"WHERE NOT {junk('email')} AND {confidence('email')} >= {min_confidence}::DOUBLE "
        f"QUALIFY row_number() OVER (PARTITION BY {key}, email ORDER BY pos) = 1)")


def phones(x: str) -> str:
    """Kept phone numbers with repeats, in order."""
    found = f"list_transform(regexp_extract_all({x}, {lit(PHONE)}), lambda p: {strip('p')})"
    digits = "length(regexp_replace(p, '\\P{Nd}', '', 'g'))"
    return f"list_filter({found}, lambda p: {digits} >= 8 AND {digits} <= 15)"


def phone_ctes(source: str, key: str, text: str) -> str:
    """CTE ``phone_rows`` (key, pos, phone), first occurrences, ``pos`` counted over those."""
    return (
        f"phone_all AS (SELECT {key}, unnest(l) AS phone, generate_subscripts(l, 1) AS p FROM "
        f"(SELECT {key}, {phones(text)} AS l FROM {source})), "
        f"phone_rows AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY min(p)) - 1 AS pos, phone "
        f"FROM phone_all GROUP BY {key}, phone)")


def social(x: str, network: str) -> str:
    hosts = {"facebook": "facebook.com", "instagram": "instagram.com", "linkedin": "linkedin.com",
             "twitter": "twitter.com|x.com", "whatsapp": "wa.me"}[network].replace(".", r"\.")
    first = (f"list_filter(regexp_extract_all({x}, {lit('(?i)' + SOCIAL_URL)}, 0), "
             f"lambda u: regexp_matches(u, {lit(f'(?i)^(?:https?://)?(?:www\\.)?(?:{hosts})/')}))[1]")
    return f"CASE WHEN {first} LIKE 'http%' THEN {first} ELSE 'https://' || {first} END"


def mailto_rows(source: str, key: str, html: str) -> str:
    """SELECT of (key, pos, email) of accepted mailto links."""
    raw = f"regexp_extract_all({html}, {lit('(?i)href=\"mailto:([^\"' + chr(39) + '?]+)')}, 1)"
    return (
        f"SELECT {key}, pos, email FROM (SELECT {key}, i AS pos, lower({strip('m')}) AS email FROM "
        f"(SELECT {key}, unnest(l) AS m, generate_subscripts(l, 1) AS i FROM (SELECT {key}, {raw} AS l FROM {source}))) "
        f"WHERE regexp_matches(email, {lit('(?i)^' + EMAIL)}) AND NOT {junk('email')}")


def contact_ctes(source: str, key: str, text: str, html: str, min_confidence: float = 0.7) -> str:
    """CTEs ending in ``found`` (key, pos, email, domain, username, confidence, context), mailto included."""
    both = (
        f"SELECT {key}, 0 AS part, pos, email, domain, username, confidence, context FROM hits UNION ALL "
        f"SELECT {key}, 1, pos, email, {domain('email')}, {username('email')}, 1::DOUBLE, {lit(MAILTO_CONTEXT)} "
        f"FROM ({mailto_rows(source, key, html)})")
    return (
        email_ctes(source, key, text, min_confidence) + f", both_kinds AS ({both}), "
        f"first_kinds AS (SELECT * FROM both_kinds QUALIFY row_number() OVER (PARTITION BY {key}, email ORDER BY part, pos) = 1), "
        f"found AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY part, pos) - 1 AS pos, email, domain, "
        f"username, confidence, context FROM first_kinds)")


# --- categories ----------------------------------------------------------------------------

def _contained(tokens: str, where: str) -> str:
    return f"list_filter({tokens}, lambda t: contains({where}, t))"


def _weights(found: str, weight: float) -> str:
    return f"list_transform({found}, lambda t: {weight}::DOUBLE)"


def role_rows(source: str, key: str, context: str | None, threshold: float = 0.5) -> str:
    """SELECT of (key, email, rank, category, confidence, keywords) of the role categories."""
    rules = " UNION ALL ".join(
        f"SELECT {n} AS ord, {lit(c)} AS category, {strings(ws)} AS words, {strings(ROLE_PATTERNS[c])} AS signs"
        for n, (c, ws) in enumerate(ROLE_KEYWORDS.items()))
    e = "lower(email)"
    in_context = _contained("words", f"lower({context})") if context else "[]::VARCHAR[]"
    return (
        f"SELECT {key}, email, row_number() OVER (PARTITION BY {key} ORDER BY confidence DESC, ord) AS rank, category, "
        f"confidence, array_to_string(list_concat(m, n, list_filter(c, lambda t: NOT list_contains(list_concat(m, n), t))), '|') AS keywords "
        f"FROM (SELECT *, least(1::DOUBLE, coalesce(list_sum(list_concat({_weights('m', 0.8)}, {_weights('n', 0.3)}, "
        f"{_weights('c', 0.1)})), 0::DOUBLE)) AS confidence FROM (SELECT {key}, email, ord, category, "
        f"{_contained('signs', e)} AS m, {_contained('words', f'split_part({e}, {lit("@")}, 1)')} AS n, {in_context} AS c "
        f"FROM {source}, ({rules}))) WHERE confidence >= {threshold}::DOUBLE")


def site_rows(source: str, key: str, domain_column: str, text: str | None, threshold: float = 0.5, chars: int | None = 5000) -> str:
    rules = " UNION ALL ".join(
        f"SELECT {n} AS ord, {lit(c)} AS category, {strings(ws)} AS words" for n, (c, ws) in enumerate(SITE_KEYWORDS.items()))
    in_text = _contained("words", f"left(lower({text}), {chars})" if chars else f"lower({text})") if text else "[]::VARCHAR[]"
    return (
        f"SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY confidence DESC, ord) AS rank, category, confidence, "
        f"array_to_string(list_sort(list_distinct(list_concat(d, t))), '|') AS keywords "
        f"FROM (SELECT *, least(1::DOUBLE, coalesce(list_sum({_weights('d', 0.5)}), 0::DOUBLE) "
        f"+ least(len(t) * 0.1::DOUBLE, 0.5::DOUBLE)) AS confidence FROM (SELECT {key}, ord, category, "
        f"{_contained('words', f'lower({domain_column})')} AS d, {in_text} AS t FROM {source}, ({rules}))) "
        f"WHERE confidence >= {threshold}::DOUBLE")


def business_label(text: str) -> str:
    """Label by whole-word counts. Letters and digits beyond ASCII become an x, so RE2 sees them as words."""
    folded = sub(sub(f"lower({text})", r"[^\x00-\x7f\P{L}]", "x"), r"[^\x00-\x7f\P{N}]", "x")
    scores = []
    for n, (label, words) in enumerate(BUSINESS_KEYWORDS.items()):
        weight = HEAVY_WEIGHT if label in HEAVY_BUSINESS else 1
        count = " + ".join(f"len(regexp_extract_all(b, {lit(chr(92) + 'b' + w + chr(92) + 'b')}))" for w in words)
        scores.append(f"{{'score': ({count}) * {weight}, 'ord': {-n}, 'label': {lit(label)}}}")
    best = f"list_sort([{', '.join(scores)}], 'DESC')[1]"
    return (f"list_transform([{folded}], lambda b: CASE WHEN {best}.score > 0 THEN {best}.label ELSE 'unknown' END)[1]")
