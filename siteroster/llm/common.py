"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts of a batch are worked on in runs of about this many bytes.
RUN_BYTES = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; NULL for a NULL key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts).cast("long"))


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with a function from batch to batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)
        give_back()
    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, text: str, schema: str, score: Callable[[list[str | None]], dict[str, object]],
                finish: Callable[[], None] | None = None) -> DataFrame:
    """All columns of ``df`` and those of ``schema``, computed from the texts of a run of rows.

    ``score`` takes a list of texts (None for NULL) and returns one list or array per new column. New
    columns replace old ones of the same name.
    """
    added = T.StructType.fromDDL(schema)
    kept = [f for f in df.schema.fields if f.name not in added.names]
    names = [f.name for f in kept]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, text_at):
                texts = part.column(text_at).to_pylist()
                new = score(texts)
                columns = [part.column(i) for i in range(len(names))]
                columns += [pa.array(new[f.name], ARROW[f.dataType.typeName()]) for f in added.fields]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *added.names])
        if finish:
            finish()
        give_back()

    text_at = len(names)
    chosen = df.select(*[F.col(f"`{n}`") for n in names], F.col(text).alias(free_name(df, "_text")))
    return chosen.mapInArrow(work, T.StructType([*[T.StructField(f.name, f.dataType) for f in kept], *added.fields]))


def give_back() -> None:
    """Return what a reused worker has freed to the system: its next task may need little, its neighbour much."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` for ``mapInArrow``, which gives freed memory back at the end of a task."""
    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back()
    return run


def mounted(folder: str) -> str:
    """The plain path of a folder that tasks open as files; ``ValueError`` for any other kind of store."""
    place = urlparse(folder)
    if place.scheme not in ("", "file"):
        raise ValueError("tasks open files there: spark.checkpoint.dir has to be a mounted folder")
    return place.path


def whole_number(df: DataFrame, key: str) -> None:
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} has to be a column of whole numbers")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first longer name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


ARROW = {"long": pa.int64(), "integer": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
         "string": pa.string(), "binary": pa.binary()}


def runs(batch: pa.RecordBatch, text_at: int, limit: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts add up to about ``limit`` bytes; one text is never cut."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_at)), 0))
    if not len(lengths):
        return
    slot = np.cumsum(lengths.astype(np.int64)) // limit
    edges = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), len(slot)]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


class Hashes(dict):
    """64-bit hash of each word, remembered for a number of words of a bounded length."""

    longest = 64

    def __init__(self, room: int = 100_000):
        super().__init__()
        self.room = room

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.longest:
            if len(self) >= self.room:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One for all operators of a worker.
HASHES = Hashes()

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _S30)) * _M1
        x = (x ^ (x >> _S27)) * _M2
        return x ^ (x >> _S31)


def rolling(values: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every window of ``width`` consecutive 64-bit values, built by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, size, block = np.uint64(base | 1), 1, values
        out, used = None, 0
        while True:
            if width & size:
                piece = block[used:used + n]
                out = piece.copy() if out is None else out * power + piece
                used += size
            if size * 2 > width:
                break
            block = block[:len(block) - size] * power + block[size:]
            power, size = power * power, size * 2
        return mix(out + np.uint64(width))
