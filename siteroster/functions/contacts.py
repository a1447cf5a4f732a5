"""Contact operators: e-mail, phone and social profiles in a text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteroster.functions.fixed_values import (
    CONTEXT_CHARS, DOMAIN_NAME, EMAIL_HOST, EMAIL_LOCAL, FREE_MAIL_PENALTY, FREE_MAIL_WORDS,
    JUNK_DOMAINS, JUNK_EXTENSIONS, MAILTO, MAILTO_CONTEXT, PHONE_DIGITS, PHONE_PARTS,
    SHORT_NAME_LENGTH, SHORT_NAME_PENALTY, SIMPLE_EMAIL, SOCIAL_HOSTS, SOCIAL_URL,
)
from siteroster.functions.text import SPACE, WORD, col, let, strip

# A word boundary, spelled out so that it means the same on every Java version.
EMAIL = rf"(?iu)(?<!{WORD}){EMAIL_LOCAL}@{EMAIL_HOST}(?!{WORD})"
# The same matches as group 1, in linear time. All starts in one run of the characters before an @ meet the same @ and the same
# host, so only the first that may be one is tried; a run begins after any other character or where a match ended.
_RUN = "[A-Za-z0-9._%+-]"
_FIRST = rf"(?:\G|(?<!{_RUN}))(?:(?!(?<!{WORD})[A-Za-z0-9]){_RUN})*+"
EMAIL_IN_TEXT = rf"(?iu){_FIRST}([A-Za-z0-9]{_RUN}*+@{EMAIL_HOST})(?!{WORD})"
# Both look at the first character before they try their parts in turn.
PHONE = r"(?U)(?=[+(\p{Nd}])" + PHONE_PARTS.format(d=r"\p{Nd}", s=SPACE[1:-1])
SOCIAL = rf"(?iu)(?=[hwftxil]){SOCIAL_URL}"

# The shortest address has 6 characters, so 6 neighbours always fill the context of 30.
_NEIGHBOURS = 6

EMAIL_STRUCT = ("array<struct<pos:int,email:string,domain:string,username:string,is_valid:boolean,"
                "confidence:double,context:string>>")


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def deobfuscate(text: Column | str, plain_words: bool = True) -> Column:
    """Turn ``name [at] host (dot) com`` into ``name@host.com``.

    ``plain_words=False`` leaves the bare words `` at `` and `` dot `` alone.
    """
    # A run of white space is tried from its first character only, so long runs cost no more.
    begin = rf"{SPACE}(?<!{SPACE}{{2}}){SPACE}*+"
    out = col(text)
    for word, spelled, sign in (("at", "[aA][tT]", "@"), ("dot", "[dD][oO][tT]", ".")):
        def bracketed(t: Column, spelled: str = spelled, sign: str = sign) -> Column:
            for left, right in ((r"\[", r"\]"), (r"\(", r"\)")):
                t = F.regexp_replace(t, rf"(?U)(?:{begin})?+{left}{spelled}{right}{SPACE}*+", sign)
            return t

        def plain(t: Column, spelled: str = spelled, sign: str = sign) -> Column:
            return F.regexp_replace(t, rf"(?U){begin}{spelled}{SPACE}++", sign)

        # the tests in front are cheap, and most texts have no bracketed word
        out = let(out, lambda t: F.when(t.rlike(rf"[\[(]{spelled}[\])]"), bracketed(t)).otherwise(t))
        if plain_words:
            out = plain(out) if word == "at" else let(
                out, lambda t: F.when(t.rlike(spelled), plain(t)).otherwise(t))
    return out


def email_matches(text: Column | str) -> Column:
    """All addresses as written, in text order."""
    return let(col(text), lambda t: F.when(
        t.contains("@"), F.regexp_extract_all(t, F.lit(EMAIL_IN_TEXT), F.lit(1))).otherwise(_empty("array<string>")))


def email_username(email: Column | str) -> Column:
    return F.substring_index(col(email), "@", 1)


def email_domain(email: Column | str) -> Column:
    """All after the first ``@``; empty when there is none."""
    email = col(email)
    return F.when(email.contains("@"), F.regexp_replace(email, r"(?s)^[^@]*@", "")).otherwise("")


def is_junk_email(email: Column | str) -> Column:
    """Placeholder domain, or a file name that looks like an address."""
    domain = email_domain(email)
    return domain.isin(JUNK_DOMAINS) | (
        domain.contains(".") & F.substring_index(domain, ".", -1).isin(JUNK_EXTENSIONS))


def email_confidence(email: Column | str) -> Column:
    """1.0, less for free providers and very short names; never below zero."""
    domain, name = email_domain(email), email_username(email)
    free = domain.rlike("|".join(FREE_MAIL_WORDS))
    score = F.when(free, F.lit(1.0 - FREE_MAIL_PENALTY)).otherwise(F.lit(1.0))
    score = F.when(F.char_length(name) < SHORT_NAME_LENGTH, score - F.lit(SHORT_NAME_PENALTY)).otherwise(score)
    return F.greatest(F.lit(0.0), score)


def is_valid_email(email: Column | str) -> Column:
    return F.coalesce(col(email).rlike("(?d)" + SIMPLE_EMAIL), F.lit(False))


def is_valid_domain(domain: Column | str) -> Column:
    return F.coalesce(col(domain).rlike("(?d)" + DOMAIN_NAME), F.lit(False))


def first_of_each(hits: Column) -> Column:
    """Keep the first struct of each ``email`` by ``pos``. Sorting, not pairwise comparing."""
    by_email = F.array_sort(F.transform(hits, lambda h: F.struct(
        h["email"].alias("email"), h["pos"].alias("pos"), h.alias("hit"))))
    kept = let(by_email, lambda s: F.filter(s, lambda h, i: (i == 0) | (
        h["email"] != F.coalesce(F.get(s, i - 1)["email"], F.lit("")))))
    return F.transform(F.array_sort(F.transform(kept, lambda h: F.struct(
        h["pos"].alias("pos"), h["hit"].alias("hit")))), lambda h: h["hit"])


def _with_context(text: Column) -> Column:
    """Addresses with the text around them: array of (pos, raw, context)."""
    n = CONTEXT_CHARS

    def assemble(pieces: Column, found: Column) -> Column:
        # no context reaches further than n characters into the text between two addresses
        short = F.transform(pieces, lambda p: F.when(
            F.char_length(p) > 2 * n, F.concat(F.left(p, F.lit(n)), F.right(p, F.lit(n)))).otherwise(p))
        units = F.zip_with(short, found, lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
        return let(short, lambda s: let(units, lambda u: F.transform(found, lambda m, i: F.struct(
            i.alias("pos"), m.alias("raw"), _context(s, u, m, i).alias("context")))))

    def _context(short: Column, units: Column, match: Column, i: Column) -> Column:
        before = F.array_join(F.slice(units, F.greatest(i - _NEIGHBOURS, F.lit(0)) + 1,
                                      F.least(i, F.lit(_NEIGHBOURS))), "")
        before = F.right(F.concat(before, F.get(short, i)), F.lit(n))
        after = F.left(F.array_join(F.slice(units, i + 2, F.lit(_NEIGHBOURS)), ""), F.lit(n))
        around = F.translate(F.concat(before, match, after), "\n", " ")
        return F.concat(F.lit("..."), strip(around), F.lit("..."))

    def between(pieces: Column, whole: Column, found: Column) -> Column:
        # what a match has before its address belongs to the text between
        return F.zip_with(pieces, F.arrays_zip(whole.alias("w"), found.alias("f")), lambda p, m: F.when(m.isNull(), p).otherwise(
            F.concat(p, F.left(m["w"], F.char_length(m["w"]) - F.char_length(m["f"])))))

    whole, inner = (F.regexp_extract_all(text, F.lit(EMAIL_IN_TEXT), F.lit(g)) for g in (0, 1))
    return let(F.struct(F.split(text, EMAIL_IN_TEXT, -1).alias("p"), whole.alias("w"), inner.alias("f")),
               lambda x: let(between(x["p"], x["w"], x["f"]), lambda p: assemble(p, x["f"])))


def email_hits(text: Column | str, min_confidence: float = 0.0, remove_duplicates: bool = True) -> Column:
    """Accepted addresses of a de-obfuscated text, with context and confidence."""
    def accept(found: Column) -> Column:
        scored = F.transform(found, lambda h: let(F.lower(h["raw"]), lambda e: F.struct(
            h["pos"].cast("int").alias("pos"), e.alias("email"), email_domain(e).alias("domain"),
            email_username(e).alias("username"), F.lit(True).alias("is_valid"),
            email_confidence(e).alias("confidence"), h["context"].alias("context"))))
        good = F.filter(scored, lambda h: ~is_junk_email(h["email"]) & (h["confidence"] >= min_confidence))
        return first_of_each(good) if remove_duplicates else good
    return let(col(text), lambda t: F.when(
        t.contains("@"), accept(_with_context(t))).otherwise(_empty(EMAIL_STRUCT)))


def mailto_hits(html: Column | str) -> Column:
    """Addresses of mailto links, as written in raw HTML; confidence is always 1."""
    html = col(html)
    raw = F.regexp_extract_all(html, F.lit("(?iu)" + MAILTO), F.lit(1))
    names = F.transform(raw, lambda m: strip(F.lower(m)))
    good = F.filter(names, lambda e: e.rlike(r"\A" + EMAIL) & ~is_junk_email(e))
    hits = F.transform(good, lambda e, i: F.struct(
        i.cast("int").alias("pos"), e.alias("email"), email_domain(e).alias("domain"),
        email_username(e).alias("username"), F.lit(True).alias("is_valid"),
        F.lit(1.0).alias("confidence"), F.lit(MAILTO_CONTEXT).alias("context")))
    return F.when(F.lower(html).contains("mailto:"), hits).otherwise(_empty(EMAIL_STRUCT))


def address_confidences(text: Column | str, html: Column | str) -> Column:
    """Of each distinct address in a de-obfuscated text and in mailto links, the highest threshold that it meets."""
    written = F.array_distinct(F.filter(F.transform(email_matches(text), F.lower), lambda e: ~is_junk_email(e)))
    linked = F.transform(mailto_hits(html), lambda h: h["email"])
    return let(F.struct(written.alias("w"), linked.alias("l")), lambda x: F.concat(
        F.transform(F.array_except(x["w"], x["l"]), email_confidence), F.transform(F.array_distinct(x["l"]), lambda _: F.lit(1.0))))


def merge_hits(text_hits: Column | str, link_hits: Column | str, remove_duplicates: bool = True) -> Column:
    """Text hits first, then link hits; of equal addresses the first stays. ``pos`` counts from 0."""
    def joined(text: Column, links: Column) -> Column:
        every = F.transform(F.concat(text, links), lambda h, i: h.withField("pos", i.cast("int")))
        return F.transform(first_of_each(every) if remove_duplicates else every,
                           lambda h, i: h.withField("pos", i.cast("int")))
    return F.when((F.size(col(text_hits)) == 0) & (F.size(col(link_hits)) == 0), _empty(EMAIL_STRUCT)
                  ).otherwise(joined(col(text_hits), col(link_hits)))


def phone_numbers(text: Column | str) -> Column:
    """Distinct phone numbers of a de-obfuscated text, in text order."""
    found = F.transform(F.regexp_extract_all(col(text), F.lit(PHONE), F.lit(0)), strip)
    low, high = PHONE_DIGITS
    return F.array_distinct(F.filter(found, lambda p: F.char_length(
        F.regexp_replace(p, r"\P{Nd}", "")).between(low, high)))


def social_links(text: Column | str, html: Column | str | None = None, strict_hosts: bool = False) -> Column:
    """First profile URL per network, as a struct with one field per network.

    The HTML is searched when there is any, else the text. ``strict_hosts`` refuses hosts
    that only end like a network's, as in ``netflix.com``.
    """
    target = col(text) if html is None else F.when(
        F.coalesce(col(html), F.lit("")) != "", col(html)).otherwise(col(text))
    pattern = SOCIAL.replace("(?iu)", "(?iu)(?<![A-Za-z0-9.-])") if strict_hosts else SOCIAL
    found = F.regexp_extract_all(target, F.lit(pattern), F.lit(0))

    def first(urls: Column, hosts: list[str]) -> Column:
        names = "|".join(h.replace(".", r"\.") for h in hosts)
        own = F.filter(urls, lambda u: u.rlike(rf"(?iu)^(?:https?://)?(?:www\.)?(?:{names})/"))
        url = F.get(own, F.lit(0))
        return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))

    return let(found, lambda urls: F.struct(*[
        first(urls, hosts).alias(network) for network, hosts in SOCIAL_HOSTS.items()]))
