"""Page operators over an HTML column: Column in, Column out.

Every loop over a group in these expressions is possessive, so a page of any size or depth
is matched without recursion.
"""

from __future__ import annotations

import html as _stdlib_html
import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteroster.functions.fixed_values import (
    CONTENT_TAGS, MIN_TEXT_LENGTH, MIN_WORDS, NAV_TAGS, SKIPPED_LINK_STARTS, VOID_TAGS,
)
from siteroster.functions.tag_tree import nodes_column, outermost_column
from siteroster.functions.text import SPACE, col, is_json, let, normalize_whitespace, strip, word_count
from siteroster.functions.urls import resolve_url

# A quote opens a value only right after the equals sign.
_QUOTED = r"""(?:"[^"]*+"|'[^']*+')"""
_ATTRS = rf"""(?:[^>=]++|=\s*+{_QUOTED}?+)*+"""
_TAG = rf"<[a-zA-Z/]{_ATTRS}>"
_ODD_TAG = r"<[a-zA-Z/][^>]*+>"
_RAW_BLOCK = r"(?i)<(script|style)\b[^>]*+>[^<]*+(?:<(?!/\1\b)[^<]*+)*+(?:</\1\s*>|\z)"
_COMMENT = r"(?s)<!--(.*?)-->"
_ENTITY = r"&(#?[a-zA-Z0-9]+);?"


def _weave(text: Column, pattern: str, group: int, show) -> Column:
    """Replace each match of ``pattern`` by ``show(match)``, the rest unchanged."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.array_join(F.zip_with(
        pieces, found, lambda p, m: F.concat(p, F.coalesce(show(m), F.lit("")))), "")


# --- character references ---------------------------------------------------------------

# All names of the HTML standard, as one literal map.
_NAMES = json.dumps({name.rstrip(";"): char for name, char in html5.items()})


def _named_references() -> Column:
    return F.from_json(F.lit(_NAMES), "map<string,string>")


def _numbered_reference(name: Column) -> Column:
    code = F.when(name.rlike("(?i)^#x[0-9a-f]{1,8}$"), F.conv(F.substring(name, 3, 8), 16, 10)).when(
        name.rlike("^#[0-9]{1,9}$"), F.substring(name, 2, 9)).cast("bigint")

    def show(n: Column) -> Column:
        # numbers 128 to 159 mean the characters of the Windows code page
        latin = F.translate(F.decode(F.unhex(F.lpad(F.hex(n), 2, "0")), "ISO-8859-1"), *_WINDOWS)
        wide = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return (F.when(n.isNull(), F.concat(F.lit("&"), name))
                .when((n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit("\ufffd"))
                .when(n < 256, latin).otherwise(wide))

    return let(code, show)


def _windows_1252() -> tuple[str, str]:
    pairs = [(chr(n), _stdlib_html.unescape(f"&#{n};")) for n in range(128, 160)]
    changed = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in changed), "".join(b for _, b in changed)


_WINDOWS = _windows_1252()


def decode_references(text: Column | str, unknown: str = "open") -> Column:
    """Decode character references in one pass, so ``&amp;lt;`` gives ``&lt;``.

    The semicolon may be missing. An unknown name loses its semicolon in page text
    (``unknown="open"``) and stays as it is in attribute values (``unknown="keep"``).
    """
    def show(match: Column) -> Column:
        name = F.rtrim(F.substring(match, F.lit(2), F.length(match)), F.lit(";"))
        fallback = F.concat(F.lit("&"), name) if unknown == "open" else match
        return (F.when(name == "amp", F.lit("&"))
                .when(name == "nbsp", F.lit("\xa0"))
                .when(name == "quot", F.lit('"'))
                .when(name == "lt", F.lit("<"))
                .when(name == "gt", F.lit(">"))
                .when(name.startswith("#"), _numbered_reference(name))
                .otherwise(F.coalesce(F.try_element_at(_named_references(), name), fallback)))
    text = col(text)
    return F.when(text.contains("&"), _weave(text, _ENTITY, 0, show)).otherwise(text)


# --- page text ----------------------------------------------------------------------------

def _first_inside(m: Column, tag: str) -> Column:
    """All between the first tag of a name and the next end tag of that name; empty when there is none."""
    rest = F.regexp_extract(m, rf"(?is)<{tag}\b[^>]*+>(.*)", 1)
    return let(rest, lambda r: let(F.split(r, rf"(?i)</{tag}\s*>", 2), lambda x: F.when(F.size(x) > 1, x[0]).otherwise("")))


# Comments, code, declarations and tags, in page order; what stands in quotes belongs to its tag. All begin with the one
# sign in front, so that other characters are looked at once and not by each alternative.
_TOKEN = (rf"(?is)<(?:!--.*?-->|(script|style)\b{_ATTRS}>[^<]*+(?:<(?!/\1\b)[^<]*+)*+(?:</\1\s*>|\z)"
          rf"|[!?][^>]*+>|{_TAG[1:]}|{_ODD_TAG[1:]})")


def _codes(tokens: Column) -> Column:
    """Tags as ``functions.tag_tree`` reads them, joined by spaces; void tags, code and all else are empty."""
    def code(t: Column) -> Column:
        name = F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*)", 1))
        return F.when(name.isin("", "script", "style", *VOID_TAGS) | t.endswith("/>") & ~t.startswith("</"), "").when(
            t.startswith("</"), F.concat(F.lit("/"), name)).otherwise(name)
    return F.array_join(F.transform(tokens, code), " ")


def _hidden_ranges(html: Column, hidden: list[str]) -> Column:
    """Token ranges (first, last) of the outermost hidden elements; pages that have none are not looked at."""
    some = rf"(?i)<(?:{'|'.join(hidden)})[\s/>]"
    flat = outermost_column(tuple(hidden))(F.when(html.rlike(some), _codes(F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0)))))
    return let(flat, lambda f: F.transform(
        F.filter(f, lambda _, i: i % 2 == 0), lambda first, k: F.struct(first.alias("first"), F.get(f, 2 * k + 1).alias("last"))))


def _without(units: Column, ranges: Column) -> Column:
    """``units`` after each ``last`` up to the next ``first``, and those up to the first one."""
    def kept(r: Column, k: Column) -> Column:
        following = F.coalesce(F.get(ranges, k + 1)["first"], F.size(units) - 1)
        return F.slice(units, r["last"] + 2, F.greatest(F.lit(0), following - r["last"]))
    return F.when(F.size(ranges) == 0, units).otherwise(F.concat(
        F.slice(units, 1, F.get(ranges, F.lit(0))["first"] + 1), F.flatten(F.transform(ranges, kept))))


def _shown(token: Column, keep_comments: bool) -> Column:
    """A comment or declaration as text; a space for all else."""
    if not keep_comments:
        return F.lit(" ")
    inner = F.when(token.startswith("<!--") & token.endswith("-->") & (F.length(token) >= 7),
                   F.substring(token, F.lit(5), F.length(token) - 7)).when(
        token.startswith("<!") | token.startswith("<?"),
        F.regexp_replace(token, r"(?is)^<[!?](?:(?<=!)doctype\b\s*+)?(.*)>$", "$1"))
    return F.coalesce(F.concat(F.lit(" "), inner, F.lit(" ")), F.lit(" "))


def page_text(html: Column | str, remove_nav: bool = True, keep_comments: bool = True) -> Column:
    """Visible text of a page, one space between words.

    Text of comments and declarations counts as text unless ``keep_comments`` is off. Hidden elements end where a
    tree parser ends them: at their end tag, at that of an element around them, or at the end of the page.
    """
    hidden = [t for t in CONTENT_TAGS if t not in ("script", "style", "embed")] + (NAV_TAGS if remove_nav else [])

    html = F.coalesce(col(html), F.lit(""))

    def visible(found: Column) -> Column:
        units = F.zip_with(found["pieces"], found["tokens"], lambda p, t: F.concat(
            decode_references(p), F.when(t.isNull(), F.lit("")).otherwise(_shown(t, keep_comments))))
        return F.array_join(let(units, lambda u: _without(u, found["ranges"])), "")

    text = let(F.struct(
        F.split(html, _TOKEN, -1).alias("pieces"), F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0)).alias("tokens"),
        _hidden_ranges(html, hidden).alias("ranges")), visible)
    text = normalize_whitespace(text)
    text = F.regexp_replace(text, rf"(?U)\[{SPACE}*\]", "")
    return F.regexp_replace(text, rf"(?U)\({SPACE}*\)", "")


def is_valid_content(text: Column | str, min_text_length: int = MIN_TEXT_LENGTH) -> Column:
    """Long enough, and at least ten words."""
    text = col(text)
    return F.coalesce((F.char_length(text) >= min_text_length) & (word_count(text) >= MIN_WORDS),
                      F.lit(False))


# --- elements and attributes ---------------------------------------------------------------

def markup(html: Column | str) -> Column:
    """HTML without comments and without the code inside script and style."""
    return F.regexp_replace(
        F.regexp_replace(F.coalesce(col(html), F.lit("")), _RAW_BLOCK, " "), _COMMENT, "")


def _value(attrs: Column, name: str) -> Column:
    """Value of one attribute out of the inside of a tag; NULL when absent."""
    # attributes before it are passed as a whole, so that nothing inside their values is read
    other = rf"""(?!{name}\s*+=)(?:[^\s/="']++|=)(?:\s*+=\s*+(?:{_QUOTED}|[^\s"'>]*+))?+"""
    pattern = rf"""(?is)^[\s/"']*+(?:{other}[\s/"']*+)*+{name}\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+)"""
    quoted = F.nullif(F.regexp_extract(attrs, pattern, 1), F.lit(""))
    return decode_references(F.regexp_replace(quoted, r"""(?s)^(["'])(.*)\1$""", "$2"), unknown="keep")


def _only_string(inner: Column) -> Column:
    """Text of an element that holds one text node, bare or inside nested elements."""
    wrapped = (r"(?s)^(?:<(?!(?:br|hr|img|input|wbr)\b)[a-zA-Z][^>]*+>)*+([^<]++)"
               r"(?:</[a-zA-Z][^>]*+>)*+$")
    return F.nullif(F.regexp_extract(inner, wrapped, 1), F.lit(""))


def _texts_in(m: Column, names: tuple[str, ...], least: int) -> Column:
    """Texts of elements: their text nodes, each trimmed, put together without a separator."""
    page = let(m, lambda m: F.struct(_codes(F.regexp_extract_all(m, F.lit(_TAG), F.lit(0))).alias("codes"), F.split(m, _TAG, -1).alias("texts")))
    # references only ever get shorter, so what is too short undecoded is too short
    texts = F.transform(nodes_column(names, least)(page), lambda nodes: F.array_join(
        F.transform(nodes, lambda x: strip(decode_references(x))), ""))
    return F.filter(texts, lambda t: F.char_length(t) >= least)


def element_texts(html: Column | str, tag: str, min_text_length: int = MIN_TEXT_LENGTH) -> Column:
    """Texts of the elements with one tag name, in page order; short ones are dropped.

    Elements are those of a tree parser: an element inside another of its kind is an element of its own and part of the
    other's text, and one without an end tag reaches to the end of the element around it.
    """
    return _texts_in(markup(html), (tag.lower(),), min_text_length)


def page_headings(html: Column | str, min_text_length: int = MIN_TEXT_LENGTH) -> Column:
    """Heading texts, all of level 1 first, then level 2 and so on."""
    return headings_in(markup(html), min_text_length)


# The functions ending in _in take the result of ``markup``, so that several can share it.

def headings_in(m: Column, min_text_length: int = MIN_TEXT_LENGTH) -> Column:
    return _texts_in(m, tuple(f"h{n}" for n in range(1, 7)), min_text_length)


def page_links(html: Column | str, base_url: Column | str | None = None) -> Column:
    """Link targets in page order, each once; relative ones resolved against ``base_url``."""
    return links_in(markup(html), base_url)


def links_in(m: Column, base_url: Column | str | None = None) -> Column:
    tags = F.regexp_extract_all(
        m, F.lit(rf"(?i)<a((?=[\s/]){_ATTRS})>"), F.lit(1))
    hrefs = F.filter(F.transform(tags, lambda t: _value(t, "href")), lambda h: h.isNotNull() & (h != ""))
    wanted = F.filter(hrefs, lambda h: ~_any_start(h, SKIPPED_LINK_STARTS))
    if base_url is None:
        return F.array_distinct(wanted)
    base = col(base_url)
    return F.array_distinct(F.transform(wanted, lambda h: F.when(
        (base == "") | _any_start(h, ["http://", "https://"]), h).otherwise(resolve_url(base, h))))


def _any_start(c: Column, starts: list[str]) -> Column:
    test = c.startswith(starts[0])
    for s in starts[1:]:
        test = test | c.startswith(s)
    return test


# --- metadata -----------------------------------------------------------------------------

def meta_entries(html: Column | str) -> Column:
    """``meta`` tags as structs (name, property, content) in page order."""
    return meta_entries_in(markup(html))


def meta_entries_in(m: Column) -> Column:
    tags = F.regexp_extract_all(m, F.lit(rf"(?i)<meta((?=[\s/]){_ATTRS})>"), F.lit(1))
    return F.transform(tags, lambda t: F.struct(
        _value(t, "name").alias("name"), _value(t, "property").alias("property"),
        _value(t, "content").alias("content")))


def meta_pairs(entries: Column | str) -> Column:
    """(key, value) of each named tag that has content; of equal keys the last one stays."""
    keyed = F.transform(col(entries), lambda e: F.struct(
        F.coalesce(F.nullif(e["name"], F.lit("")), F.nullif(e["property"], F.lit(""))).alias("key"),
        e["content"].alias("value")))
    named = F.reverse(F.filter(keyed, lambda e: e["key"].isNotNull() & (e["value"] != "")))
    return let(named, lambda pairs: let(
        F.transform(pairs, lambda e: e["key"]),
        lambda keys: F.filter(pairs, lambda e, i: F.array_position(keys, e["key"]) == i + 1)))


def meta_group(key: Column | str) -> Column:
    key = col(key)
    return (F.when(key.startswith("og:"), "open_graph").when(key.startswith("twitter:"), "twitter_card")
            .otherwise("meta_tags"))


def meta_maps(entries: Column | str) -> Column:
    """Struct of three maps: ``meta_tags``, ``open_graph`` and ``twitter_card``."""
    def one(pairs: Column, group: str) -> Column:
        return F.map_from_entries(F.filter(pairs, lambda e: meta_group(e["key"]) == group)).alias(group)
    return let(meta_pairs(entries), lambda p: F.struct(
        one(p, "meta_tags"), one(p, "open_graph"), one(p, "twitter_card")))


def _first_content(entries: Column, field: str, value: str) -> Column:
    """Content of the first tag with ``field`` = ``value``; NULL when that one is empty."""
    first = F.get(F.filter(entries, lambda e: e[field] == value), F.lit(0))
    return strip(F.nullif(first["content"], F.lit("")))


def page_title(html: Column | str) -> Column:
    """``title`` element, else ``og:title``, else first ``h1``."""
    return let(markup(html), lambda m: let(meta_entries_in(m), lambda entries: title_in(m, entries)))


def title_in(m: Column, entries: Column | str) -> Column:
    title = _only_string(_first_inside(m, "title"))
    h1 = _only_string(_first_inside(m, "h1"))
    return F.coalesce(strip(decode_references(title)),
                      _first_content(col(entries), "property", "og:title"),
                      strip(decode_references(h1)))


def meta_description(entries: Column | str) -> Column:
    """``description`` tag, else ``og:description``."""
    return F.coalesce(_first_content(col(entries), "name", "description"),
                      _first_content(col(entries), "property", "og:description"))


def json_ld(html: Column | str) -> Column:
    """JSON texts of linked-data scripts in page order; what does not parse is left out."""
    bodies = F.regexp_extract_all(
        F.regexp_replace(col(html), _COMMENT, ""),
        F.lit(r"""(?s)<(?:script|SCRIPT)\b[^>]*?\stype\s*=\s*["']?application/ld\+json["']?(?:\s[^>]*)?>"""
              r"""([^<]*+(?:<(?!/(?:script|SCRIPT)\b)[^<]*+)*+)(?:</(?:script|SCRIPT)\s*>|\z)"""), F.lit(1))
    return F.filter(bodies, is_json)
