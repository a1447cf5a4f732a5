"""Sources: texts, captured pages, file hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteroster.session import durable
from siteroster.sources.digests import Digest, resumable

PAGE_SCHEMA = ("url string, html string, status_code int, headers map<string,string>, "
               "scraped_at timestamp, response_time double, error string")
SMALL_FILE_BYTES = 64 * 1024 * 1024
_HASH_BLOCK = 8 * 1024 * 1024
HASH_STRIDE = 256 * 1024 * 1024


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_texts(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Text files as (path, text); one row per file, or per line."""
    return spark.read.text(path, wholetext=whole_files).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_pages(spark: SparkSession, path: str, source_format: str = "parquet", streaming: bool = False) -> DataFrame:
    """Captured pages from parquet or JSON, as a batch or as a stream over a folder."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(PAGE_SCHEMA).format(source_format).load(path)


def _bytes_of(pieces: list[dict], begin: int, end: int) -> Iterator[bytes]:
    """Blocks of the bytes from ``begin`` to ``end`` of files read one after the other."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    for piece in pieces:
        at, stop = max(begin, 0), min(end, piece["length"])
        if at < stop:
            uri = piece["path"]
            system, inner = (LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")) if uri.startswith("file:") else FileSystem.from_uri(uri)
            with system.open_input_file(inner) as file:
                file.seek(at)
                while at < stop and (block := file.read(min(_HASH_BLOCK, stop - at))):
                    at += len(block)
                    yield block
        begin, end = begin - piece["length"], end - piece["length"]


def go_on(row: dict, algorithm: str, stride: int) -> dict:
    """A row of ``_in_rounds`` after its next ``stride`` bytes, or all where a half-made digest cannot be had."""
    if row["digest"] is not None:
        return row
    ready = resumable(algorithm)
    done, end = (row["done"], min(row["done"] + stride, row["length"])) if ready else (0, row["length"])
    digest = Digest(algorithm, row["state"]) if ready else hashlib.new(algorithm)
    for block in _bytes_of(row["pieces"], done, end):
        digest.update(block)
    over = end == row["length"]
    return row | {"done": end, "state": None if over else digest.state, "digest": digest.hexdigest() if over else None}


def _in_rounds(wholes: DataFrame, algorithm: str, stride: int) -> DataFrame:
    """Digests of (path, length, pieces). In each round a task of its own reads the next ``stride`` bytes of each
    and hands the half-made digest on."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([go_on(row, algorithm, stride) for row in batch.to_pylist()], batch.schema)

    left = durable(wholes.selectExpr("path", "length", "pieces", "0L AS done", "CAST(NULL AS binary) AS state", "CAST(NULL AS string) AS digest"), "pieces")
    n, longest = left.agg(F.count("path"), F.max("length")).first()
    for _ in range(max(1, -(-longest // stride)) if n else 0):
        left = durable(left.repartitionByRange(n, "path").mapInArrow(work, left.schema), "round")
    return left.select("path", "length", "digest")


def hash_files(spark: SparkSession, path: str, algorithm: str = "sha256", small: int = SMALL_FILE_BYTES, folders: bool = False,
               stride: int = HASH_STRIDE) -> DataFrame:
    """(path, length, digest) of each file. Files up to ``small`` bytes are hashed in the JVM; larger
    ones are read inside tasks, at most ``stride`` bytes of a file in each, so no file has to fit in a row or a task.

    With ``folders`` the files of a folder are the pieces of one: (folder, length, digest) of what they hold, in the order of their names.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    sizes = {"sha224": 224, "sha256": 256, "sha384": 384, "sha512": 512}
    digest = {"md5": F.md5("content"), "sha1": F.sha1("content")}.get(
        algorithm, F.sha2("content", sizes[algorithm]) if algorithm in sizes else None)
    if digest is None:
        raise ValueError(f"unsupported hash algorithm: {algorithm}")

    piece = F.struct("path", "length")
    if folders:
        return _in_rounds(files.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(
            F.sum("length").alias("length"), F.sort_array(F.collect_list(piece)).alias("pieces")).withColumnRenamed("folder", "path"),
            algorithm, stride)
    by_row = files.filter(F.col("length") <= small).select("path", "length", digest.alias("digest"))
    large = files.filter(F.col("length") > small).select("path", "length", F.array(piece).alias("pieces"))
    return by_row.unionByName(_in_rounds(large, algorithm, stride))
