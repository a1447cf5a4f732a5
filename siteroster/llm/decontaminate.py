"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping passages. A passage of m bytes that occurs in a text with at
most e edits shares at least m - q + 1 - q*e of its q-grams with it, on diagonals that lie within e of
each other. So shared q-grams are counted per passage and diagonal band (bands are twice that wide and
overlap by half), regions that reach the bound are kept, and a banded alignment verifies them. Nothing
within the edit budget is missed, and nothing beyond it is reported.

Texts are compared as UTF-8 bytes with A-Z in lower case and every run of ASCII signs and white space as
one space; the reported ranges are bytes of the original text. A passage of m compared bytes may have
min(m * edits / 100, (m - 7 - shared) / 8) edits: 9 at 96 bytes, 3 at 48, 1 at 32 (``Settings``). Items under
``least`` bytes are found exactly and on word edges, and items under 8, which has no q-gram, only as a whole text.

The benchmark is the query set. It is written once, in files of bounded size below the checkpoint folder, which
has to be a mounted one; each task walks the files over its rows, so documents are read once whatever the size of the
benchmark, and no process holds all of it. Long texts are searched in pieces that overlap by more than a passage.

NULL and empty texts hold no passage, and NULL and empty items are in no text. An item that is listed twice is
reported for each id. Repeated documents give repeated rows. Of equally good alignments the first in the text is
reported. Empty tables on either side give no passage, and ``without_passages`` then keeps every document.
"""

from __future__ import annotations

import glob
import math
from collections import OrderedDict, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siteroster.llm.common import give_back, mounted, runs
from siteroster.session import scratch_path

#: A q-gram is one unsigned 64-bit integer.
Q = 8
#: Bytes of benchmark text per block, and of document text that is searched at once.
BLOCK_BYTES, PIECE = 1 << 20, 1 << 20
#: Blocks that a worker keeps indexed.
MOST_OPEN = 2
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """Length of a passage, step between passages, edits per hundred bytes, q-grams that an occurrence shares
    at least (the budget of short passages is lowered for it), and the shortest item that may have edits."""

    passage: int = 96
    step: int = 48
    edits: int = 10
    shared: int = 16
    least: int = 32


def plain(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The compared bytes, and the place of each in ``data``."""
    seen = np.frombuffer(data.translate(_PLAIN), np.uint8)
    space = seen == 32
    keep = np.flatnonzero(~(space & np.concatenate([[True], space[:-1]])))
    if len(keep) and seen[keep[-1]] == 32:
        keep = keep[:-1]
    return seen[keep], keep


def grams(data: np.ndarray) -> np.ndarray:
    """Every run of Q bytes as an integer; a view of overlapping items."""
    data = np.ascontiguousarray(data)
    return np.ndarray((max(0, len(data) - Q + 1),), "<u8", data, strides=(1,))


class Index:
    """Passages of a block of items, and where each q-gram occurs in them."""

    def __init__(self, items: list[tuple[object, str]], settings: Settings):
        self.items, self.starts, self.texts = [], [], []
        self.short: dict[int, list[tuple[bytes, object]]] = defaultdict(list)
        self.tiny: dict[bytes, list[object]] = defaultdict(list)
        for key, text in items:
            data, _ = plain(text.encode())
            if len(data) < Q:
                if len(data):
                    self.tiny[data.tobytes()].append(key)
                continue
            if len(data) < settings.least:
                self.short[int(grams(data)[0])].append((data.tobytes(), key))
                continue
            last = max(0, len(data) - settings.passage)
            for start in [*range(0, last, settings.step), last]:
                self.items.append(key)
                self.starts.append(start)
                self.texts.append(data[start:start + settings.passage])
        self.size = np.array([len(t) for t in self.texts], np.int64)
        # fewer edits where a passage would else share too few q-grams to tell it from chance
        self.budget = np.minimum(self.size * settings.edits // 100, (self.size - Q + 1 - settings.shared) // Q)
        self.bound = self.size - Q + 1 - Q * self.budget
        found = [grams(t) for t in self.texts]
        every = np.concatenate([np.zeros(0, np.uint64), *found])
        order = np.argsort(every, kind="stable")
        self.passage = np.repeat(np.arange(len(found)), [len(g) for g in found])[order]
        self.offset = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in found]])[order]
        self.grams, self.first, self.many = np.unique(every[order], return_index=True, return_counts=True)
        self.shift = np.uint64(64 - max(16, int(len(self.grams) * 16).bit_length()))
        self.flags = np.zeros(1 << (64 - int(self.shift)), bool)
        with np.errstate(over="ignore"):
            self.flags[(self.grams * _ODD) >> self.shift] = True
        self.short_grams = np.sort(np.array(list(self.short), np.uint64))
        width = int(self.size.max(initial=0))
        #: Compared bytes that pieces of a text have to share so that an occurrence lies in one of them.
        self.overlap = max(settings.least, width + int(self.budget.max(initial=0))) + 2
        self.padded = np.zeros((len(self.texts), width), np.uint8)
        for i, t in enumerate(self.texts):
            self.padded[i, :len(t)] = t

    def shared(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``data`` whose q-gram is in the index, and its number there."""
        g = grams(data)
        with np.errstate(over="ignore"):
            at = np.flatnonzero(self.flags[(g * _ODD) >> self.shift])
        some = g[at]
        slot = np.minimum(np.searchsorted(self.grams, some), len(self.grams) - 1)
        same = self.grams[slot] == some
        return at[same], slot[same]

    def regions(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, first diagonal of the band) of every region that reaches the bound of shared q-grams."""
        at, slot = self.shared(data)
        least, reach = int(self.bound.min()), int((self.size + self.budget).max())
        # places in a stretch with enough shared q-grams for any passage
        close = np.flatnonzero(at[least - 1:] - at[:len(at) - least + 1] <= reach) if len(at) >= least else np.zeros(0, int)
        edge = np.zeros(len(at) + 1, np.int64)
        np.add.at(edge, close, 1)
        np.add.at(edge, close + least, -1)
        dense = np.cumsum(edge[:-1]) > 0
        at, slot = at[dense], slot[dense]
        many = self.many[slot]
        entry = np.repeat(self.first[slot] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        passage = self.passage[entry]
        diagonal = np.repeat(at, many) - self.offset[entry] + self.padded.shape[1]  # not below zero
        step = self.budget[passage] + 1
        band = diagonal // step
        span = np.int64(len(data) + 3 * self.padded.shape[1] + 8)
        key, count = np.unique(np.concatenate([passage * span + band, (passage * span + band - 1)[band > 0]]), return_counts=True)
        passage, band = key // span, key % span
        full = count >= self.bound[passage]
        passage, band = passage[full], band[full]
        return passage, band * (self.budget[passage] + 1) - self.padded.shape[1]

    def align(self, data: np.ndarray, passage: np.ndarray, diagonal: np.ndarray, block: int = 512) -> Iterator[tuple]:
        """(passage, begin, end, edits) of the best alignment in each band, where it is within the budget."""
        for i in range(0, len(passage), block):
            yield from self._align(data, passage[i:i + block], diagonal[i:i + block])

    def _align(self, data: np.ndarray, passage: np.ndarray, diagonal: np.ndarray) -> Iterator[tuple]:
        """Edit distance row by row over a band of diagonals. Each cell is edits * big + diagonal of its start."""
        most, size = self.budget[passage], self.size[passage]
        wide = int(4 * most.max() + 3)
        low = diagonal - most  # leftmost diagonal, for alignments that begin beside the band
        text = np.concatenate([np.zeros(0, np.uint8), data])
        ks, big = np.arange(wide), np.int64(1 << 20)
        cell = np.broadcast_to(ks, (len(passage), wide)).astype(np.int64)
        best = np.full((len(passage), wide), big * big)
        for i in range(int(size.max())):
            place = low[:, None] + i + ks
            inside = (place >= 0) & (place < len(text))
            letter = np.where(inside, text[np.clip(place, 0, len(text) - 1)], 0)
            step = cell + big * (letter != self.padded[passage, i][:, None])
            step[:, :-1] = np.minimum(step[:, :-1], cell[:, 1:] + big)
            cell = np.minimum.accumulate(step - ks * big, axis=1) + ks * big
            done = size == i + 1
            best[done] = cell[done]
        end = best.argmin(1)
        value = best[np.arange(len(best)), end]
        edits, start = value // big, value % big
        for j in np.flatnonzero(edits <= most):
            yield int(passage[j]), int(low[j] + start[j]), int(low[j] + end[j] + size[j]), int(edits[j])


    def exact(self, data: np.ndarray) -> Iterator[tuple[object, int, int]]:
        """(item, begin, end) of every short item that stands in ``data`` as whole words."""
        g = grams(data)
        if not len(self.short_grams) or not len(g):
            return
        slot = np.minimum(np.searchsorted(self.short_grams, g), len(self.short_grams) - 1)
        edge = np.isin(np.concatenate([[np.uint8(32)], data[:-1]])[:len(g)], (0, 32))
        for begin in np.flatnonzero((self.short_grams[slot] == g) & edge).tolist():
            for item, key in self.short[int(g[begin])]:
                end = begin + len(item)
                if data[begin:end].tobytes() == item and (end == len(data) or data[end] in (0, 32)):
                    yield key, begin, end


_indexed: OrderedDict[tuple[str, Settings], Index] = OrderedDict()


def _index(path: str, settings: Settings) -> Index:
    """The index of a block's file. Each benchmark is written to a folder of its own, so a path names its contents."""
    if (path, settings) not in _indexed:
        while len(_indexed) >= MOST_OPEN:
            _indexed.popitem(last=False)
        rows = pq.read_table(path)
        _indexed[path, settings] = Index(list(zip(rows.column("item").to_pylist(), rows.column("text").to_pylist())), settings)
    _indexed.move_to_end((path, settings))
    return _indexed[path, settings]


def pieces(data: bytes, overlap: int, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The compared bytes of a text and their places in it, in pieces that share ``overlap`` compared bytes."""
    begin, wide = 0, max(size, 4 * overlap)
    while True:
        end = min(len(data), begin + wide)
        seen, place = plain(data[begin:end])
        if end < len(data) and len(seen) <= 2 * overlap:
            wide *= 2  # hardly anything but signs
            continue
        yield seen, place + begin
        if end == len(data):
            return
        begin, wide = begin + int(place[len(seen) - overlap]), max(size, 4 * overlap)


def search(index: Index, texts: list[str | None]) -> Iterator[tuple[int, object, int, int, int, int, int]]:
    """(text number, item, passage start and end in the item, start, end, edits) of every passage found."""
    found: dict[tuple, tuple] = {}
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0
    for number, text in enumerate(texts):
        for seen, place in pieces((text or "").encode(), index.overlap):
            if index.tiny and len(seen) < Q:
                for key in index.tiny.get(seen.tobytes(), ()):
                    found[number, key, len(seen), -1] = (0, int(place[0]), int(place[-1]) + 1)
            held.append((number, seen, place))
            size += len(seen)
            if size >= PIECE:
                _search(index, held, found)
                held, size = [], 0
    _search(index, held, found)
    for (number, passage, length, _), (edits, a, b) in sorted(found.items(), key=lambda f: (f[0][0], f[1])):
        if length:
            yield number, passage, 0, length, a, b, edits
        else:
            start = index.starts[passage]
            yield number, index.items[passage], start, start + int(index.size[passage]), a, b, edits


def _search(index: Index, held: list[tuple[int, np.ndarray, np.ndarray]], found: dict[tuple, tuple]) -> None:
    """Search pieces in one go, with a zero byte between them that no passage has, and keep the best of each occurrence."""
    if not held:
        return
    gap = np.zeros(1, np.uint8)
    data = np.concatenate([x for _, seen, _ in held for x in (seen, gap)])
    begins = np.cumsum([0, *[len(seen) + 1 for _, seen, _ in held]])
    hits = [(p, 0, begin, end, edits) for p, begin, end, edits in index.align(data, *index.regions(data))] if index.texts else []
    hits += [(key, end - begin, begin, end, 0) for key, begin, end in index.exact(data)]
    for passage, length, begin, end, edits in hits:
        part = int(np.searchsorted(begins, begin, "right")) - 1
        number, seen, place = held[part]
        a, b = begin - int(begins[part]), end - int(begins[part])
        if a < 0 or b > len(seen) or b <= a:
            continue
        a, b = int(place[a]), int(place[b - 1]) + 1
        if length:
            found[number, passage, length, a] = (0, a, b)
            continue
        # neighbouring bands and overlapping pieces find the same occurrence: keep the better
        for near in (a // 16, a // 16 - 1, a // 16 + 1):
            key = (number, passage, length, near)
            if key in found:
                found[key] = min(found[key], (edits, a, b))
                break
        else:
            found[number, passage, length, a // 16] = (edits, a, b)


def written(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> str:
    """Write the items to files of about ``BLOCK_BYTES`` each; the folder they are in."""
    items = benchmark.filter(F.col(text).isNotNull()).select(F.col(item).alias("item"), F.col(text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = scratch_path(benchmark.sparkSession, "benchmark")
    path = mounted(folder)
    items.repartition(max(1, math.ceil(size / BLOCK_BYTES))).write.parquet(folder)
    return path


def find_passages(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), key: str = "doc_id",
                  text: str = "text", item: str = "item_id") -> DataFrame:
    """(key, item, item_start, item_end, start, end, edits): every benchmark passage found in a document."""
    kinds = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(item, benchmark.schema[item].dataType),
                          *[T.StructField(n, T.LongType()) for n in ("item_start", "item_end", "start", "end", "edits")]])
    folder, schema = written(benchmark, item), to_arrow_schema(kinds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in sorted(glob.glob(f"{folder}/*.parquet")):
                index = _index(path, settings)
                for part in runs(batch, 1):
                    hits = list(search(index, part.column(1).to_pylist()))
                    if hits:
                        keys = part.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
                        rest = [pa.array([h[i] for h in hits], schema.field(i).type) for i in range(1, 7)]
                        yield pa.RecordBatch.from_arrays([keys, *rest], names=schema.names)
        give_back()
    # by other names, as key and text may be one column
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(work, kinds)


def without_passages(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text: str = "text",
                     item: str = "item_id") -> DataFrame:
    """The documents that hold no benchmark passage, with all their columns."""
    folder, at = written(benchmark, item), docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in sorted(glob.glob(f"{folder}/*.parquet")):
                index, kept = _index(path, settings), []
                for part in runs(batch, at):
                    bad = {h[0] for h in search(index, part.column(at).to_pylist())}
                    kept.append(part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_())))
                batch = pa.concat_batches(kept) if kept else batch
            yield batch
        give_back()
    return docs.mapInArrow(work, docs.schema)
