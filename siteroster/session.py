"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_scratch: str | None = None


def build_session(app: str = "siteroster", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library relies on; ``conf`` overrides any of them.

    Dots in setting names are written as double underscores:
    ``build_session(spark__sql__shuffle__partitions="64")``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a ``local`` master, where one machine is the whole cluster, falls back to a
    temporary folder of its own.
    """
    global _local_scratch
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="siteroster-")
    return _local_scratch


#: Paths that this process has handed out and not deleted.
_handed_out: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{scratch_dir(spark)}/siteroster/{label}-{uuid.uuid4().hex}"
    _handed_out.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete all intermediate tables made inside the block at its end, so read results before that::

        with scratch(spark):
            crawl_report(pages, seeds).write.parquet(target)
    """
    before = len(_handed_out)
    try:
        yield
    finally:
        for path in _handed_out[before:]:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        del _handed_out[before:]


def durable(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and unlike a checkpoint lets later steps
    prune columns. Every reader sees the same rows, which matters for sampled ranges.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, key: str, label: str = "table") -> Iterator[DataFrame]:
    """Like ``durable``, but bucketed by ``key``: repeated joins on it leave this side in place.

    The table's name leaves the catalog at the end of the block.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"siteroster_{label}_{uuid.uuid4().hex}"
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
     .option("path", scratch_path(spark, label)).saveAsTable(name))
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
