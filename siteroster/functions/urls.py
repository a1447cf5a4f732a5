"""URL helpers: Column in, Column out.

The parts are cut with the RFC 3986 expression and not with ``parse_url``, which rejects
many URLs that pages really carry.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteroster.functions.fixed_values import URL_LABEL, URL_SKIPPED_ENDINGS, URL_TRIM
from siteroster.functions.text import NOT_SPACE, col, let

_PARTS = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# Possessive loops keep this flat: a host of 100,000 labels costs no stack.
_SHORT_HOST = (
    r"(?:(?:[a-zA-Z0-9]++\.(?![a-zA-Z]{2}))*+[a-zA-Z0-9]++\.(?=[a-zA-Z]{2}))++[a-zA-Z]{2,}"
)
URL_IN_TEXT = (
    rf"(?U)(?:https?://(?:www\.|(?!www)){URL_LABEL}\.{NOT_SPACE}{{2,}}"
    rf"|www\.{URL_LABEL}\.{NOT_SPACE}{{2,}}"
    rf"|https?://{_SHORT_HOST})"
)


def _part(url: Column | str, group: int) -> Column:
    return F.regexp_extract(col(url), _PARTS, group)


def scheme(url: Column | str) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column | str) -> Column:
    """Authority as written, case kept."""
    return _part(url, 2)


def full_path(url: Column | str) -> Column:
    return _part(url, 3)


def query(url: Column | str) -> Column:
    return _part(url, 4)


def fragment(url: Column | str) -> Column:
    return _part(url, 5)


def path(url: Column | str) -> Column:
    """Path without the ``;parameters`` of its last segment."""
    return F.regexp_replace(full_path(url), r";[^/]*$", "")


def _brackets_pair(host: Column) -> Column:
    return host.contains("[") == host.contains("]")


def is_valid_url(url: Column | str) -> Column:
    """Scheme http or https, and a host."""
    host = netloc(url)
    return F.coalesce(scheme(url).isin("http", "https") & (host != "") & _brackets_pair(host),
                      F.lit(False))


def url_domain(url: Column | str) -> Column:
    return F.lower(netloc(url))


def base_domain(domain: Column | str) -> Column:
    """Last two labels."""
    return F.substring_index(col(domain), ".", -2)


def normalize_url(url: Column | str) -> Column:
    """Lower-case host, no trailing slash, query kept, fragment and parameters dropped."""
    q = query(url)
    return F.concat(scheme(url), F.lit("://"), url_domain(url), F.rtrim(path(url), F.lit("/")),
                    F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def url_root(url: Column | str) -> Column:
    """``scheme://host`` of a page."""
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def clean_url(raw: Column | str) -> Column:
    """One URL without the punctuation around it, or NULL when it is not worth a visit."""
    def judge(u: Column) -> Column:
        full = F.when(u.startswith("www."), F.concat(F.lit("https://"), u)).when(
            u.startswith("http://") | u.startswith("https://"), u)
        return let(full, lambda f: F.when(
            (netloc(f) != "") & _brackets_pair(netloc(f)) & ~_skipped(f), f))
    return let(F.btrim(col(raw), F.lit(URL_TRIM)), judge)


def _skipped(url: Column) -> Column:
    ends = "|".join(e.replace(".", r"\.") for e in URL_SKIPPED_ENDINGS)
    return path(url).rlike(rf"(?i)(?:{ends})\z")


def extract_urls(text: Column | str) -> Column:
    """Sorted distinct URLs found in a text; empty array for empty or missing text."""
    raw = F.regexp_extract_all(col(text), F.lit(URL_IN_TEXT), F.lit(0))
    cleaned = F.filter(F.transform(raw, clean_url), lambda u: u.isNotNull())
    return F.coalesce(F.array_sort(F.array_distinct(cleaned)), F.array().cast("array<string>"))


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """Absolute form of ``href`` seen on page ``base``."""
    base, href = col(base), col(href)
    tidy = F.regexp_replace(href, r"^[\x00-\x20]+|[\t\r\n]", "")

    def unsplit(sch: Column, host: Column, p: Column, q: Column, frag: Column) -> Column:
        rooted = F.when((host != "") & (p != "") & ~p.startswith("/"), F.concat(F.lit("/"), p)).otherwise(p)
        return F.concat(
            F.when(sch != "", F.concat(sch, F.lit(":"))).otherwise(""),
            F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""),
            rooted,
            F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""),
            F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(""))

    def relative(h: Column) -> Column:
        own_scheme = scheme(h)
        other = (own_scheme != "") & (own_scheme != scheme(base))
        return (F.when(h == "", base)
                .when(other, h)
                .when(netloc(h) != "", unsplit(scheme(base), netloc(h), full_path(h), query(h), fragment(h)))
                .when(full_path(h) == "", unsplit(
                    scheme(base), netloc(base), full_path(base),
                    F.when(query(h) != "", query(h)).otherwise(query(base)), fragment(h)))
                .otherwise(unsplit(scheme(base), netloc(base), _merge_paths(full_path(base), full_path(h)),
                                   query(h), fragment(h))))

    return let(tidy, relative)


def _merge_paths(base_path: Column, own_path: Column) -> Column:
    """Path of a link relative to the folder of ``base_path``, dot segments resolved."""
    folder = F.regexp_replace(base_path, r"[^/]*$", "")
    joined = F.when(own_path.startswith("/"), own_path).otherwise(
        F.regexp_replace(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), own_path),
                         r"(?<=.)/{2,}|^/{2,}", "/"))

    def walk(p: Column) -> Column:
        segments = F.split(p, "/", -1)
        empty = F.array().cast("array<string>")
        kept = F.aggregate(segments, empty, lambda acc, s: F.when(
            s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))))
        tail = F.when(p.rlike(r"(?:^|/)\.\.?$"), F.array(F.lit(""))).otherwise(empty)
        path_ = F.array_join(F.concat(kept, tail), "/")
        return F.when(path_ == "", F.lit("/")).otherwise(path_)

    # Only paths with dot segments pay for the walk.
    return let(joined, lambda p: F.when(p.rlike(r"(?:^|/)\.\.?(?:/|$)"), walk(p)).otherwise(p))
