"""Exact repeats of words across documents, by seed and extend.

Seeds are winnowed anchors: of the K-grams in a window of LENGTH words, the one with the smallest hash (the
last of ties). The anchor follows from the words of the window alone, so equal windows meet at equal anchors,
and one anchor serves a whole run of windows. Documents are joined on anchors. From an anchor the match is
extended to both ends of its run: occurrences whose runs are equal form a class, and everything in a class
but its first document repeats the whole run. Where one anchor has several classes, matches end inside the
run; there the first document of each class is extended window by window, and a window counts as repeated
if it also starts in a document with a smaller id. Overlapping windows join to maximal repeats.

No pairs of occurrences are made: every step keeps the smallest id per anchor, class or window. A run that a
document has many times is one row with the places of all, so a passage in most documents costs one row per
document, however often each repeats it. Equality is told by 128-bit hashes of the words' 64-bit hashes.

NULL texts have no words. NULL ids neither repeat another document nor are repeated. Rows with the same id
and text get the same result; the same id with another text is a version of its own, and the versions do not
repeat each other. Copies inside one document do not count. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteroster.llm.common import HASHES, free_name, mix, rolling, runs, tidy, whole_number
from siteroster.session import durable

LENGTH, K = 50, 8
_SALT = np.uint64(0x5851F42D4C957F2D)


def version(text: str) -> Column:
    """Tells apart texts under one id."""
    return F.xxhash64(text)


def word_values(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and where each text begins (one more at the end)."""
    words = [(t or "").encode().split() for t in texts]
    values = np.concatenate([np.zeros(0, np.uint64), *[HASHES.of(w) for w in words]])
    return values, np.cumsum([0, *map(len, words)])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive values, by doubling."""
    n, size = len(values) - width + 1, 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:n], values[width - size:width - size + n])


class Segments:
    """128-bit hashes of any stretch of words, from running sums."""

    _bases = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self, values: np.ndarray):
        self.sums, self.back = [], []
        with np.errstate(over="ignore"):
            for base, v in zip(self._bases, (values, mix(values ^ _SALT))):
                powers = np.full(len(v) + 1, base, np.uint64)
                powers[0] = 1
                powers = np.multiply.accumulate(powers)
                inverse = np.full(len(v) + 1, pow(base, -1, 1 << 64), np.uint64)
                inverse[0] = 1
                self.back.append(np.multiply.accumulate(inverse))
                self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * powers[:-1], dtype=np.uint64)]))

    def hashes(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            return [mix((s[end] - s[start]) * b[start] + (end - start).astype(np.uint64)).view(np.int64)
                    for s, b in zip(self.sums, self.back)]


def anchored_runs(texts: list[str | None], length: int = LENGTH, k: int = K) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: doc (number of the text), anchor, start, size in words, s1, s2.

    ``start`` and ``size`` bound the words of all windows of the run, in the text.
    """
    values, begins = word_values(texts)
    empty = {c: np.zeros(0, np.int64) for c in ("doc", "anchor", "start", "size", "s1", "s2")}
    if len(values) < length:
        return empty
    grams = rolling(values, k)
    high = np.uint64(0xFFFFFFFF00000000)
    last = np.uint64(0xFFFFFFFF)
    ranked = (grams & high) | (last - np.arange(len(grams), dtype=np.uint64))
    chosen = (last - (sliding_min(ranked, length - k + 1) & last)).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(begins))
    valid = np.flatnonzero(doc[:len(chosen)] == doc[length - 1:length - 1 + len(chosen)])
    if not len(valid):
        return empty
    anchor = chosen[valid]
    new = np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(valid) != 1)])
    start = valid[new]
    end = valid[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(valid) - 1]])] + length
    s1, s2 = Segments(values).hashes(start, end)
    return {"doc": doc[start], "anchor": grams[anchor[new]].view(np.int64), "start": start - begins[doc[start]],
            "size": end - start, "s1": s1, "s2": s2}


def equal_runs(r: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], pa.Array]:
    """The first of equal runs in each text, and where the others start (null: there are none)."""
    same = ("doc", "anchor", "size", "s1", "s2")
    order = np.lexsort([r["start"], *(r[c] for c in reversed(same))])
    new = np.ones(len(order), bool)
    new[1:] = np.any([np.diff(r[c][order]) != 0 for c in same], axis=0)
    others = np.diff(np.append(np.flatnonzero(new), len(order))) - 1
    ends = pa.array(np.append(0, np.cumsum(others)), pa.int32(), mask=np.append(others == 0, False))
    more = pa.ListArray.from_arrays(ends, pa.array(r["start"][order[~new]].astype(np.int32)))
    first = order[new]
    back = np.argsort(first)  # as in the texts
    return {c: v[first[back]] for c, v in r.items()}, more.take(pa.array(back))


def _seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["anchor", "doc_id", "version", "start", "more", "size", "s1", "s2"]
    for batch in batches:
        for part in runs(batch, 2):
            r, more = equal_runs(anchored_runs(part.column(2).to_pylist()))
            pick = pa.array(r["doc"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["anchor"]), part.column(0).take(pick), part.column(1).take(pick),
                 pa.array(r["start"].astype(np.int32)), more, pa.array(r["size"].astype(np.int32)), pa.array(r["s1"]),
                 pa.array(r["s2"])], names=names)


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of every window of the runs that are listed beside a text."""
    for batch in batches:
        for part in runs(batch, 1):
            values, begins = word_values(part.column(1).to_pylist())
            segments = Segments(values)
            out = []
            for i, listed in enumerate(part.column(2).to_pylist()):
                for x in listed:
                    out.append((i, int(begins[i]) + x["start"], x["size"] - LENGTH + 1, x["c1"], x["s1"]))
            if not out:
                continue
            doc, start, n, c1, s1 = (np.array(c, np.int64) for c in zip(*out))
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(start, n) + offset
            w1, w2 = segments.hashes(at, at + LENGTH)
            yield pa.RecordBatch.from_arrays(
                [pa.array(w1), pa.array(w2), part.column(0).take(pa.array(np.repeat(doc, n))), pa.array(np.repeat(c1, n)),
                 pa.array(np.repeat(s1, n)), pa.array(offset.astype(np.int32))],
                names=["w1", "w2", "doc_id", "c1", "s1", "offset"])


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, version, spans): word ranges of each document that repeat documents with smaller ids.

    ``spans`` is an array of (start, end), end exclusive; ranges may touch or overlap. Only documents with
    a repeat have a row. ``TypeError`` for keys that are no whole numbers.
    """
    whole_number(docs, key)
    rows = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("doc_id"), version(text).alias("version"), F.col(text).alias("text"))
    seeds = durable(rows.mapInArrow(tidy(_seed), "anchor long, doc_id long, version long, start int, more array<int>, size int, s1 long, s2 long"), "seeds")

    # anchors of one document only are dropped before anything else is joined
    shared = (seeds.groupBy("anchor").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high"))
              .filter("_low < _high").select("anchor"))
    # class id: anchor and run in one; with s1 it holds 128 bits
    met = durable(seeds.join(shared, "anchor").withColumn("c1", F.xxhash64("anchor", "s1", "s2", "size")).drop("s2"), "met")

    first = F.min(F.struct("doc_id", "version", "start"))
    classes = durable(met.groupBy("c1", "s1").agg(first.alias("first"), F.min("anchor").alias("anchor"), F.min("size").alias("size")), "classes")
    several = (classes.groupBy("anchor").agg(F.min("first.doc_id").alias("_low"), F.max("first.doc_id").alias("_high"))
               .filter("_low < _high").select("anchor"))
    listed = (classes.join(several, "anchor")
              .groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.version").alias("version"))
              .agg(F.collect_list(F.struct(F.col("first.start").alias("start"), "size", "c1", "s1")).alias("listed")))
    opened = durable(rows.join(listed, ["doc_id", "version"]).dropDuplicates(["doc_id", "version"])
                     .select("doc_id", "text", "listed")
                     .mapInArrow(tidy(_extend), "w1 long, w2 long, doc_id long, c1 long, s1 long, offset int"), "opened")
    earliest = (opened.groupBy("w1", "w2").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high"))
                .filter("_low < _high").select("w1", "w2", "_low"))
    inside = (opened.join(earliest, ["w1", "w2"]).filter(F.col("doc_id") > F.col("_low"))
              .groupBy("c1", "s1").agg(F.collect_set("offset").alias("offsets")))  # at most one per window of a run

    members = met.join(classes.select("c1", "s1", F.col("first.doc_id").alias("_first")), ["c1", "s1"])
    starts = F.coalesce(F.concat(F.array("start"), "more"), F.array("start"))
    later = members.filter(F.col("doc_id") > F.col("_first")).select(
        "doc_id", "version", F.transform(starts, lambda s: _span(s, s + F.col("size"))).alias("_own"))
    partly = (members.filter(F.col("doc_id") == F.col("_first")).join(inside, ["c1", "s1"])
              .select("doc_id", "version", F.flatten(F.transform(starts, lambda s: F.transform(
                  "offsets", lambda o: _span(s + o, s + o + LENGTH)))).alias("_own")))
    # a document's own ranges only: their number is bounded by its words
    return later.unionByName(partly).groupBy("doc_id", "version").agg(F.flatten(F.collect_list("_own")).alias("spans"))


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def kept_words(text: str | None, spans: list[dict] | None) -> tuple[list[bytes], int]:
    """Words outside all spans, and the number of words of the text."""
    words = (text or "").encode().split()
    if not spans:
        return words, len(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, [s["start"] for s in spans], 1)
    np.add.at(edge, [s["end"] for s in spans], -1)
    inside = np.cumsum(edge[:-1]) > 0
    return [words[i] for i in np.flatnonzero(~inside)], len(words)


def _with_spans(docs: DataFrame, text: str, key: str) -> DataFrame:
    number, same, spans = (free_name(docs, n) for n in ("_id", "_version", "_spans"))
    found = repeats(docs, text, key).select(F.col("doc_id").alias(number), F.col("version").alias(same), F.col("spans").alias(spans))
    return docs.join(found, (F.col(key).cast("long") == F.col(number)) & (version(text) == F.col(same)), "left").drop(number, same)


def removal_digest(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of every document after the removal of repeats."""
    joined = _with_spans(docs.select(key, text), text, key)
    names = [key, "n_words", "n_removed", "kept_sha256"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, 1):
                kept = [kept_words(t, s) for t, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([n for _, n in kept], pa.int64()), pa.array([n - len(w) for w, n in kept], pa.int64()),
                     pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w, _ in kept], pa.string())], names=names)
    kind = docs.schema[key].dataType.simpleString()
    return joined.mapInArrow(tidy(work), f"`{key}` {kind}, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents with repeats cut out of their texts; a text that loses words has one space between the rest.

    Texts without a repeat stay as they are. A text may become empty; its row stays.
    """
    joined = _with_spans(docs, text, key)
    at, spans_at = docs.columns.index(text), len(docs.columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, at):
                texts = part.column(at).to_pylist()
                for i, spans in enumerate(part.column(spans_at).to_pylist()):
                    if spans:
                        texts[i] = b" ".join(kept_words(texts[i], spans)[0]).decode()
                columns = [part.column(i) for i in range(spans_at)]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names[:spans_at])
    return joined.mapInArrow(tidy(work), docs.schema)
