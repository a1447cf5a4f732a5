"""Text helpers: Column in, Column out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteroster.functions.fixed_values import SPACE_CHARS

# The same white space as a class; patterns that use it start with the flag U.
SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, however often ``body`` uses it.

    A plain reference would be evaluated again at each use, and inside a lambda once per
    array element.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def strip(c: Column | str) -> Column:
    """Trim white space of every Unicode kind on both sides."""
    return F.btrim(col(c), F.lit(SPACE_CHARS))


def squeeze(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"(?U){SPACE}+", " ")


def normalize_whitespace(c: Column | str) -> Column:
    """Each run of white space becomes one space; none is left at the ends."""
    return strip(squeeze(c))


def clean_text(c: Column | str, remove_extra_whitespace: bool = True) -> Column:
    """Drop NUL characters and trim; a missing text becomes the empty text."""
    without_nul = F.translate(F.coalesce(col(c), F.lit("")), "\x00", "")
    return normalize_whitespace(without_nul) if remove_extra_whitespace else strip(without_nul)


def truncate_text(c: Column | str, max_length: int, suffix: str = "...") -> Column:
    """Cut to ``max_length`` characters, the suffix included."""
    text = col(c)
    keep = max_length - len(suffix)
    # A suffix longer than the limit cuts from the end of the text, as a negative slice does.
    head = F.substring(text, 1, keep) if keep >= 0 else F.left(
        text, F.greatest(F.char_length(text) + F.lit(keep), F.lit(0)))
    return F.when(F.char_length(text) > max_length, F.concat(head, F.lit(suffix))).otherwise(text)


def word_count(c: Column | str) -> Column:
    """Number of white-space separated words."""
    text = normalize_whitespace(c)
    return let(text, lambda t: F.when(t == "", 0).otherwise(
        F.char_length(t) - F.char_length(F.replace(t, F.lit(" "))) + 1))


def hash_text(c: Column | str, algorithm: str = "sha256") -> Column:
    """Hex digest of the UTF-8 text."""
    name = algorithm.lower().replace("-", "")
    if name == "md5":
        return F.md5(col(c))
    if name == "sha1":
        return F.sha1(col(c))
    sizes = {"sha224": 224, "sha256": 256, "sha384": 384, "sha512": 512}
    if name not in sizes:
        raise ValueError(f"unsupported hash algorithm: {algorithm}")
    return F.sha2(col(c), sizes[name])


def decode_utf8(c: Column | str) -> Column:
    """Bytes to text; bytes that are no valid UTF-8 are dropped.

    Invalid bytes turn into U+FFFD, so genuine ones are spelled as a pair of other characters meanwhile, of which the
    first stands for itself as a pair too.
    """
    mark, itself, replaced = "\ufdd0", "\ufdd0\ufdd1", "\ufdd0\ufdd2"
    text = col(c).cast("string")
    for old, new in ((mark, itself), ("\ufffd", replaced)):
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.translate(F.make_valid_utf8(text), "\ufffd", "")
    for old, new in ((replaced, "\ufffd"), (itself, mark)):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def is_json(c: Column | str) -> Column:
    """The whole text is one JSON value. The parser stops after the first value, so the text is tried
    inside a list and inside an object: what fits both has nothing before or after the value."""
    text = col(c)
    return (F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
            & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull())


def json_parse_safe(c: Column | str, schema: str, default: Column | None = None) -> Column:
    """Parse JSON to ``schema``; text that is no JSON gives ``default``."""
    text = col(c)
    parsed = F.when(is_json(text), F.from_json(text, schema))
    return parsed if default is None else F.coalesce(parsed, default)


def json_dump_safe(c: Column | str, default: str = "{}") -> Column:
    return F.coalesce(F.to_json(col(c)), F.lit(default))


def format_timestamp(c: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(col(c), pattern)


def parse_timestamp(c: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """NULL when the text does not fit the pattern."""
    return F.try_to_timestamp(col(c), F.lit(pattern))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    micros = F.unix_micros(col(end).cast("timestamp")) - F.unix_micros(col(start).cast("timestamp"))
    return micros / F.lit(1e6)


def elapsed_text(start: Column | str, end: Column | str) -> Column:
    """``Xh Ym Zs``, ``Ym Zs`` or ``S.Ss``."""
    def shape(total: Column) -> Column:
        hours = F.floor(total / 3600)
        minutes = F.floor((total - hours * 3600) / 60)
        seconds = total - hours * 3600 - minutes * 60
        whole = F.floor(seconds)
        return (F.when(hours > 0, F.format_string("%dh %dm %ds", hours, minutes, whole))
                .when(minutes > 0, F.format_string("%dm %ds", minutes, whole))
                .otherwise(F.format_string("%.1fs", F.bround(seconds, 1))))
    return let(seconds_between(start, end), shape)


def percentage(part: Column | str, total: Column | str, places: int = 2) -> Column:
    """Share in percent, rounded half to even; zero when there is no total."""
    return F.when(col(total) == 0, F.lit(0.0)).otherwise(
        F.bround(col(part) / col(total) * 100, places))
