"""Row encryption with AES-256-GCM.

Keys live in a table (job_id, salt, key) that is joined, never written and never a literal: a
literal would show in query plans. Set ``spark.io.encryption.enabled`` on a cluster so that
shuffle files hold no plain keys either.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteroster.functions.fixed_values import IV_BYTES, KEY_BYTES, KEY_ROUNDS, TAG_BYTES
from siteroster.operators.tables import skew_safe_lookup


@F.pandas_udf(T.BinaryType())
def _pbkdf2(passphrase: pd.Series, salt: pd.Series) -> pd.Series:
    return pd.Series([hashlib.pbkdf2_hmac("sha256", p.encode("utf-8"), bytes(s), KEY_ROUNDS, KEY_BYTES)
                      for p, s in zip(passphrase, salt)])


def key_table(jobs: DataFrame) -> DataFrame:
    """Keys of a table (job_id, passphrase, salt): one derivation per job, spread over the tasks."""
    return jobs.select("job_id", "salt", _pbkdf2("passphrase", "salt").alias("key"))


def _plain_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() in (
        "string", "long", "integer", "double", "timestamp", "timestamp_ntz", "date")]


def encrypt_rows(df: DataFrame, keys: DataFrame, columns: list[str] | None = None, keep: list[str] | None = None,
                 spread_by: list[str] | None = None) -> DataFrame:
    """(job_id, kept columns, salt, payload): the other columns as one encrypted JSON value.

    The payload is a random 12-byte vector, the cipher text and a 16-byte tag.
    """
    keep = keep or []
    columns = columns or [c for c in df.columns if c != "job_id" and c not in keep]
    body = df.select("job_id", *keep, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("_body"),
                     *[F.col(c).alias(f"_s{i}") for i, c in enumerate(spread_by or _plain_columns(df))])
    spread = [c for c in body.columns if c.startswith("_s")]
    joined = skew_safe_lookup(body, keys, "job_id", spread_by=spread, how="inner")
    return joined.select("job_id", *keep, "salt", F.aes_encrypt("_body", "key", F.lit("GCM")).alias("payload"))


def decrypt_rows(encrypted: DataFrame, keys: DataFrame, schema: str, keep: list[str] | None = None,
                 spread_by: list[str] | None = None) -> DataFrame:
    """Rows back in ``schema``, with ``decrypted`` false where the key is wrong or data was changed.

    Rows of a hot job spread by ``spread_by``, or by the kept plain columns and the length of the payload. Name the
    payload itself only when it is stored: encrypting anew gives other bytes, and a repeated task would send rows elsewhere.
    """
    keep = keep or []
    known = keys.select("job_id", "key")
    held = encrypted.select("job_id", *keep, "payload", F.octet_length("payload").alias("_bytes"))
    spread = spread_by or [*_plain_columns(encrypted.select(*keep)), "_bytes"]
    joined = skew_safe_lookup(held, known, "job_id", spread_by=spread)
    body = F.try_aes_decrypt("payload", "key", F.lit("GCM")).cast("string")
    return joined.select("job_id", *keep, body.alias("_body")).select(
        "job_id", *keep, F.col("_body").isNotNull().alias("decrypted"), F.from_json("_body", schema).alias("_r")
    ).select("job_id", *keep, "decrypted", "_r.*")


def envelope(payload: Column | str = "payload", salt: Column | str = "salt", metadata: Column | None = None) -> Column:
    """Payload as base64 parts: struct (ciphertext, salt, iv, tag, metadata)."""
    p = F.col(payload) if isinstance(payload, str) else payload
    size = F.octet_length(p)

    def text(part: Column | str) -> Column:
        return F.translate(F.base64(part), "\r\n", "")  # Spark breaks long base64 into lines

    return F.struct(
        text(F.substring(p, F.lit(IV_BYTES + 1), size - IV_BYTES - TAG_BYTES)).alias("ciphertext"),
        text(salt).alias("salt"), text(F.substring(p, F.lit(1), F.lit(IV_BYTES))).alias("iv"),
        text(F.substring(p, size - TAG_BYTES + 1, F.lit(TAG_BYTES))).alias("tag"),
        (metadata if metadata is not None else F.create_map().cast("map<string,string>")).alias("metadata"))


def envelope_payload(env: Column | str) -> Column:
    """Payload out of an envelope."""
    e = F.col(env) if isinstance(env, str) else env
    return F.concat(F.unbase64(e["iv"]), F.unbase64(e["ciphertext"]), F.unbase64(e["tag"]))


def write_encrypted(df: DataFrame, keys: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Encrypted dataset, one folder per job; no plain text is written anywhere."""
    encrypt_rows(df, keys).write.mode(mode).partitionBy("job_id").parquet(path)


def read_encrypted(spark, path: str, keys: DataFrame, schema: str, job_ids: list[str] | None = None) -> DataFrame:
    """Decrypt a dataset; ``job_ids`` reads the folders of those jobs only."""
    stored = spark.read.schema("job_id string, salt binary, payload binary").parquet(path)
    if job_ids is not None:
        stored = stored.filter(F.col("job_id").isin(job_ids))
    return decrypt_rows(stored, keys, schema, spread_by=["payload"])


def list_outputs(spark, path: str) -> DataFrame:
    """Ids of the jobs that have stored results."""
    return spark.read.schema("job_id string, salt binary, payload binary").parquet(path).select("job_id").distinct()
