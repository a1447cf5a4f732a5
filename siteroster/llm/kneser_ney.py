"""Interpolated modified Kneser-Ney language model of word pairs, counted in Spark and looked up in mapped files.

Counting is two passes over the training texts. The first counts words: tasks count what they read, shuffle one row per
distinct word, and each shard of the word hashes (their leading bits) is written as one sorted array of hashes with
an array of counts. A word's id is its shard and place. The second counts pairs of neighbours by id. A pair's hash starts with
bits of its first word, so that what follows a word lies in one shard and its totals are known there; words of more than
``shard_rows`` occurrences, a known count, have their pairs spread by the second word as well. Pair shards are
sorted arrays again, and the totals of each word (kinds before it, kinds and occurrences after it) are a
third set of arrays in the order of the words. Discounts come from the counts of counts, which tasks sum.

Scoring maps the arrays into memory: a run of texts looks up its distinct words and pairs in order, so pages are touched
one after the other and shared by all workers of a machine. The files are as large as the corpus makes them; no worker
holds them, and nothing but sums reaches the driver. They lie in a new folder below ``spark.checkpoint.dir``, which has to be
a mounted one, as only files can be mapped. A task that runs again writes the same bytes and renames them into place.

Tokens are words between ASCII white space with A-Z in lower case, then one end; a start stands before the first and is
never predicted. All unseen words are one more kind of word. Words are told apart by 64-bit hashes and pairs by hashes of at
least 40 bits within a shard of some million. NULL and empty texts are one end. Without training texts every
token has probability one. Repeated texts count each time. Discounts that the counts of counts cannot give (small
corpora) are 0.5, 1 and 1.5.
"""

from __future__ import annotations

import math
import os
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteroster.llm.common import add_columns, give_back, mix, mounted, runs
from siteroster.session import scratch_path

#: Pairs in a shard, on average and at most about; rows that a task merges at once; bytes of text that it counts at once.
SHARD_ROWS, ROOM, TEXT_BYTES = 1 << 20, 1 << 22, 1 << 25
#: Bits of an id that are the place in its shard.
PLACE_BITS = 40
_PLACE = (1 << PLACE_BITS) - 1
#: No word has a space.
_START_WORD, _END_WORD = b" start", b" end"
START = np.uint64(xxhash.xxh3_64_intdigest(_START_WORD))
#: Facts of a word besides its count: kinds of word before it; occurrences, kinds, kinds seen once and twice after it.
FACTS = ("left", "total", "kinds", "once", "twice")
_FALLBACK = (0.5, 1.0, 1.5)
#: Mapped files that a worker keeps open.
_MOST_OPEN = 8192


class Words:
    """The distinct words of some texts, numbered; 0 is the start and 1 the end.

    ``tokens`` are the numbers of start, words and end of one text after the other, ``begin`` where each text begins.
    """

    def __init__(self, texts: pa.Array):
        parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
        flat, offsets = parts.flatten(), parts.offsets.to_numpy()
        real = np.asarray(pc.greater(pc.binary_length(flat), 0))  # white space at an end leaves an empty word
        before = np.concatenate([[0], np.cumsum(real)])
        count = before[offsets[1:]] - before[offsets[:-1]]
        coded = (flat if real.all() else flat.filter(pa.array(real))).dictionary_encode()
        self.words = [_START_WORD, _END_WORD, *coded.dictionary.cast(pa.binary()).to_pylist()]
        self.begin = np.cumsum(count + 2) - (count + 2)
        self.tokens = np.zeros(int(count.sum()) + 2 * len(count), np.int64)
        inner = np.ones(len(self.tokens), bool)
        inner[self.begin] = inner[self.begin + count + 1] = False
        self.tokens[self.begin + count + 1] = 1
        self.tokens[inner] = coded.indices.to_numpy().astype(np.int64) + 2

    def found(self, shards: Shards, names: tuple[str, ...]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(id or -1, values) of every word, by its number."""
        keys = self.hashes()
        order = np.argsort(keys)
        ids, values = shards.find(keys[order], names)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return ids[back], {n: v[back] for n, v in values.items()}

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))


class Shards:
    """Sorted arrays of 64-bit keys in files by their leading bits, with arrays of values beside them."""

    def __init__(self, folder: str, kind: str, bits: int):
        self.folder, self.kind, self.bits = folder, kind, bits

    def path(self, shard: int, name: str) -> str:
        return f"{self.folder}/{self.kind}-{shard}-{name}.npy"

    def shard(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)

    def write(self, shard: int, **arrays: np.ndarray) -> None:
        os.makedirs(self.folder, exist_ok=True)
        for name, values in arrays.items():
            if values.dtype != np.uint64:
                values = values.astype(np.min_scalar_type(int(values.max())))
            draft = f"{self.path(shard, name)}.{uuid.uuid4().hex}"
            with open(draft, "wb") as f:
                np.save(f, values)
            os.replace(draft, self.path(shard, name))

    def open(self, shard: int, name: str) -> np.ndarray:
        path = self.path(shard, name)
        if path in _OPEN:
            _OPEN.move_to_end(path)
            return _OPEN[path]
        found = np.load(path, mmap_mode="r") if os.path.exists(path) else np.zeros(0, np.uint64)
        _OPEN[path] = found
        if len(_OPEN) > _MOST_OPEN:
            _OPEN.popitem(last=False)
        return found

    def find(self, keys: np.ndarray, names: tuple[str, ...]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(id or -1, values or 0) of each of the ascending ``keys``."""
        ids, values = np.full(len(keys), -1, np.int64), {n: np.zeros(len(keys), np.int64) for n in names}
        shard = self.shard(keys)
        edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(keys)] if len(keys) else []
        for a, b in zip(edges, edges[1:]):
            held = self.open(int(shard[a]), "key")
            if not len(held):
                continue
            place = np.minimum(np.searchsorted(held, keys[a:b]), len(held) - 1)
            same = held[place] == keys[a:b]
            at = a + np.flatnonzero(same)
            ids[at] = (int(shard[a]) << PLACE_BITS) + place[same]
            for n in names:
                values[n][at] = self.open(int(shard[a]), n)[place[same]]
        return ids, values


_OPEN: OrderedDict[str, np.ndarray] = OrderedDict()


@dataclass(frozen=True)
class KneserNey:
    """Where the arrays are, and the totals of the corpus."""

    folder: str
    word_bits: int
    pair_bits: int
    shard_rows: int
    tokens: int
    types: int
    contexts: int  # kinds of pair
    discounts: tuple[tuple[float, ...], tuple[float, ...]]  # of words, of pairs
    spare: float  # share of the words' distribution that goes to all words alike

    @property
    def words(self) -> Shards:
        return Shards(self.folder, "word", self.word_bits)

    @property
    def pairs(self) -> Shards:
        return Shards(self.folder, "pair", self.pair_bits)


def address(first: np.ndarray, second: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    """The key of pairs of word ids: leading bits from the first word, or from both where the first is hot."""
    with np.errstate(over="ignore"):
        head = mix(first.astype(np.uint64) + np.uint64(1))
        both = mix(head + second.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if not bits:
        return both
    rest = np.uint64(64 - bits)
    return (np.where(hot, mix(both ^ head), head) >> rest << rest) | (both >> np.uint64(bits))


def discounts(n: list[int]) -> tuple[float, ...]:
    """(none, for one, for two, for more) from the numbers of things counted one, two, three and four times."""
    if 0 in n:
        return (0.0, *_FALLBACK)
    y = n[0] / (n[0] + 2 * n[1])
    found = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
    return (0.0, *[d if 0 < d <= k + 1 else f for k, (d, f) in enumerate(zip(found, _FALLBACK))])


def fit(docs: DataFrame, text: str = "text", shard_rows: int = SHARD_ROWS) -> KneserNey:
    """Count all texts of ``docs`` and write the arrays, pairs in shards of about ``shard_rows``."""
    spark = docs.sparkSession
    folder = mounted(scratch_path(spark, "ngrams"))
    word_bits = math.ceil(math.log2(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    words = Shards(folder, "word", word_bits)
    texts = docs.select(F.col(text).cast("string").alias("text"))
    tokens, types = _sums(_dealt(texts.mapInArrow(_counting(_word_rows(words)), "shard int, key long, n long"), word_bits)
                          .mapInArrow(_write_words(words), "tokens long, types long"), 2)
    pair_bits = max(0, math.ceil(math.log2(max(1, tokens / (2 * shard_rows)))))
    pairs = Shards(folder, "pair", pair_bits)
    counted = _dealt(texts.mapInArrow(_counting(_pair_rows(words, pairs, shard_rows)), "shard int, first long, second long, n long"), pair_bits)
    names = ["id", *FACTS, "thrice", "four"]
    facts = counted.mapInArrow(_write_pairs(words, pairs, shard_rows), ", ".join(f"{n} long" for n in names))
    facts = _dealt(facts.withColumn("shard", F.expr(f"CAST(shiftright(id, {PLACE_BITS}) AS INT)")), word_bits)
    sums = _sums(facts.mapInArrow(_write_facts(words), ", ".join(f"s{i} long" for i in range(10))), 10)
    word_n, pair_n, kinds, seen = sums[0:4], sums[4:8], sums[8], sums[9]
    low = discounts(word_n)
    spare = (low[1] * word_n[0] + low[2] * word_n[1] + low[3] * (seen - word_n[0] - word_n[1])) / kinds if kinds else 1.0
    return KneserNey(folder, word_bits, pair_bits, shard_rows, tokens, types, kinds, (low, discounts(pair_n)), spare)


def _dealt(rows: DataFrame, bits: int) -> DataFrame:
    """One shard to a task."""
    return rows.repartitionById(1 << bits, F.col("shard"))


def _sums(rows: DataFrame, n: int) -> list[int]:
    return [v or 0 for v in rows.agg(*[F.sum(c) for c in rows.columns]).first()][:n]


def _counting(count: Callable[[Words], pa.RecordBatch]) -> Callable:
    """Gather texts up to ``TEXT_BYTES`` and count them in one go."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in runs(batch, 0):
                held.append(part.column(0))
                size += part.column(0).nbytes
                if size >= TEXT_BYTES:
                    yield count(Words(pa.concat_arrays(held)))
                    held, size = [], 0
        if held:
            yield count(Words(pa.concat_arrays(held)))
        give_back()
    return work


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _word_rows(shards: Shards) -> Callable[[Words], pa.RecordBatch]:
    def count(words: Words) -> pa.RecordBatch:
        keys = words.hashes()
        return _batch(shard=shards.shard(keys).astype(np.int32), key=keys.view(np.int64), n=np.bincount(words.tokens, minlength=len(keys)))
    return count


def _gathered(batches: Iterator[pa.RecordBatch], merge: Callable[[list[np.ndarray]], list[np.ndarray]], names: tuple[str, ...]) -> tuple[int, list[np.ndarray]]:
    """A shard's number and its rows as arrays, merged whenever there are twice ``ROOM`` of them."""
    shard, held, size = -1, [], 0
    for batch in batches:
        if batch.num_rows:
            shard = batch.column("shard")[0].as_py()
            held.append([batch.column(n).to_numpy() for n in names])
            size += batch.num_rows
            if size >= 2 * ROOM:
                held = [merge([np.concatenate(c) for c in zip(*held)])]
                size = len(held[0][0])
    return shard, merge([np.concatenate(c) for c in zip(*held)]) if held else []


def _merged(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of one row of each key, in order of keys; the key; the sum of its n)."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return order[first], key[first], np.add.reduceat(n[order], first)


def _write_words(words: Shards):
    def merge(rows: list[np.ndarray]) -> list[np.ndarray]:
        return list(_merged(rows[0].view(np.uint64), rows[1])[1:])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = _gathered(batches, merge, ("key", "n"))
        if rows:
            key, n = rows
            words.write(shard, key=key.view(np.uint64), count=n)
            yield _batch(tokens=n[key != START].sum(keepdims=True), types=(key != START).sum(keepdims=True))
    return work


def _pair_rows(shards: Shards, pairs: Shards, shard_rows: int) -> Callable[[Words], pa.RecordBatch]:
    def count(words: Words) -> pa.RecordBatch:
        tokens = words.tokens
        ids, facts = words.found(shards, ("count",))
        code = (tokens[:-1] << 32 | tokens[1:])[tokens[1:] != 0]
        # pairs of one first word come together, which compresses well
        code, n = np.unique(code, return_counts=True)
        first, second = code >> 32, code & 0xFFFFFFFF
        key = address(ids[first], ids[second], facts["count"][first] > shard_rows, pairs.bits)
        return _batch(shard=pairs.shard(key).astype(np.int32), first=ids[first], second=ids[second], n=n)
    return count


def _write_pairs(words: Shards, pairs: Shards, shard_rows: int):
    def keys_of(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        known, at = np.unique(first, return_inverse=True)
        return address(first, second, (_at(words, known, "count") > shard_rows)[at], pairs.bits)

    def merge(rows: list[np.ndarray]) -> list[np.ndarray]:
        first, second, n = rows
        at, _, n = _merged(keys_of(first, second), n)
        return [first[at], second[at], n]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = _gathered(batches, merge, ("first", "second", "n"))
        if not rows:
            return
        first, second, n = rows
        pairs.write(shard, key=keys_of(first, second), count=n)
        none = np.zeros(0, np.int64)
        ids, left = np.unique(second, return_counts=True)
        zero = np.zeros(len(ids), np.int64)
        yield _batch(id=ids, left=left, **dict.fromkeys((*FACTS[1:], "thrice", "four"), zero))
        ids, at = np.unique(first, return_inverse=True)
        many = [np.bincount(at[n == k] if k else at, minlength=len(ids)) for k in range(5)]
        total = np.bincount(at, n, len(ids)).astype(np.int64) if len(ids) else none
        yield _batch(id=ids, left=np.zeros(len(ids), np.int64), total=total, kinds=many[0], once=many[1], twice=many[2], thrice=many[3], four=many[4])
    return work


def _at(words: Shards, ids: np.ndarray, name: str) -> np.ndarray:
    """A value of words by their ids, which ascend."""
    out, shard = np.zeros(len(ids), np.int64), ids >> PLACE_BITS
    edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(ids)] if len(ids) else []
    for a, b in zip(edges, edges[1:]):
        out[a:b] = words.open(int(shard[a]), name)[ids[a:b] & _PLACE]
    return out


def _write_facts(words: Shards):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, sums = -1, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if sums is None:
                shard = batch.column("shard")[0].as_py()
                sums = {n: np.zeros(len(words.open(shard, "key")), np.int64) for n in (*FACTS, "thrice", "four")}
            place = batch.column("id").to_numpy() & _PLACE
            for n, values in sums.items():
                np.add.at(values, place, batch.column(n).to_numpy())
        if sums:
            words.write(shard, **{n: sums[n] for n in FACTS})
            left = sums["left"]
            found = [*[(left == k).sum() for k in (1, 2, 3, 4)], *[sums[n].sum() for n in ("once", "twice", "thrice", "four")], left.sum(), (left > 0).sum()]
            yield _batch(**{f"s{i}": np.array([v], np.int64) for i, v in enumerate(found)})
    return work


def probabilities(model: KneserNey, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(count in training, probability after the token before it) of each token; those of starts mean nothing."""
    tokens = words.tokens
    low, high = (np.array(d) for d in model.discounts)
    ids, fact = words.found(model.words, ("count", *FACTS))
    alone = model.spare / (model.types + 1) + np.zeros(len(ids))
    if model.contexts:
        alone += np.maximum(fact["left"] - low[np.minimum(fact["left"], 3)], 0) / model.contexts
    total = np.maximum(fact["total"], 1)
    spare = (high[1] * fact["once"] + high[2] * fact["twice"] + high[3] * (fact["kinds"] - fact["once"] - fact["twice"])) / total
    code, back = np.unique(tokens[:-1] << 32 | tokens[1:], return_inverse=True)
    first, second = code >> 32, code & 0xFFFFFFFF
    seen = np.zeros(len(code))
    known = np.flatnonzero((ids[first] >= 0) & (ids[second] >= 0) & (fact["total"][first] > 0))
    key = address(ids[first[known]], ids[second[known]], fact["count"][first[known]] > model.shard_rows, model.pair_bits)
    order = np.argsort(key)
    seen[known[order]] = model.pairs.find(key[order], ("count",))[1]["count"]
    after = np.maximum(seen - high[np.minimum(seen, 3).astype(np.int64)], 0) / total[first] + spare[first] * alone[second]
    chance = np.where(fact["total"][first] > 0, after, alone[second])
    return fact["count"][tokens], np.concatenate([[1.0], chance[back]])


def score(docs: DataFrame, model: KneserNey, text: str = "text") -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score, score and perplexity to every row of ``docs``.

    ``base_score`` is the log10 probability under word counts with 0.1 added, ``score`` that of the model, both of
    the whole text with its end; perplexity is per token.
    """
    def work(texts: list[str | None]) -> dict[str, object]:
        words = Words(pa.array(texts, pa.string()))
        begin, real = words.begin, words.tokens != 0
        count, chance = probabilities(model, words)
        base = np.where(real, np.log10((count + 0.1) / (model.tokens + 0.1 * (model.types + 1))), 0)
        n = np.add.reduceat(real.astype(np.int64), begin)
        total = np.add.reduceat(np.where(real, np.log10(chance), 0), begin)
        return {"n_tokens": n, "n_known": np.add.reduceat(((count > 0) & real).astype(np.int64), begin),
                "train_tokens": np.full(len(n), model.tokens), "base_score": np.add.reduceat(base, begin), "score": total,
                "perplexity": 10 ** np.minimum(-total / n, 300)}

    return add_columns(docs, text, "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double", work)
