"""Registered queries: sinks, encryption, file hashes and streams."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from siteroster.functions.fixed_values import MANUAL_BLOCK
from siteroster.operators import crypto as X
from siteroster.operators.budgets import Limits
from siteroster.plans import check_sql as Q
from siteroster.plans.contact_queries import _DOC_HITS, document_emails
from siteroster.plans.crawl_queries import _REPORT_PARTS
from siteroster.plans.derived import ADDRESSES, ADMISSION_LOG, derive, table_sql
from siteroster.plans.page_queries import all_pages
from siteroster.plans.registry import query
from siteroster.session import scratch_path
from siteroster.sources.readers import hash_files as hash_all
from siteroster.sources.readers import read_table
from siteroster.sources.writers import read_csv, write_csv, write_csv_simple, write_json, write_outputs
from siteroster.streaming.contacts import stream_contacts as contacts_of
from siteroster.streaming.limiter import DECISIONS
from siteroster.streaming.limiter import stream_limiter as admissions_of

_ADDR = f"({table_sql(ADDRESSES)})"
_TRICKY = "'say \"hi\", ' || context || chr(10) || ' line' AS note"


def _notes(spark, sf):
    return derive(spark, sf, ADDRESSES).selectExpr("id", "email", "concat('say \"hi\", ', context, chr(10), ' line') AS note", "site_text")


@query("sink_csv", f"SELECT id, email, {_TRICKY} FROM {_ADDR}")
def sink_csv(spark, sf):
    path = write_csv(_notes(spark, sf), scratch_path(spark, "csv"), ["id", "email", "note"])
    return read_csv(spark, path, "id bigint, email string, note string")


@query("sink_csv_simple", f'SELECT row_number() OVER (ORDER BY id) AS "Index", email AS "Email" FROM {_ADDR}')
def sink_csv_simple(spark, sf):
    path = write_csv_simple(derive(spark, sf, ADDRESSES), scratch_path(spark, "list"), "email", ["id"])
    return read_csv(spark, path, "Index bigint, Email string")


@query("sink_json", f"SELECT id, email, {_TRICKY} FROM {_ADDR}")
def sink_json(spark, sf):
    path = write_json(_notes(spark, sf).drop("site_text"), scratch_path(spark, "json"))
    return spark.read.schema("id bigint, email string, note string").json(path)


@query("sink_multi", f"SELECT f AS format, id, email, {_TRICKY} FROM {_ADDR}, (SELECT unnest(['csv', 'json', 'parquet', 'xlsx']) AS f)")
def sink_multi(spark, sf):
    paths = write_outputs(_notes(spark, sf).drop("site_text"), scratch_path(spark, "out"), formats=("csv", "xlsx", "json", "parquet"))
    schema = "id bigint, email string, note string"
    read = {"csv": lambda p: read_csv(spark, p, schema), "xlsx": lambda p: read_csv(spark, p, schema),
            "json": lambda p: spark.read.schema(schema).json(p), "parquet": lambda p: spark.read.schema(schema).parquet(p)}
    parts = [read[name](path).select(F.lit(name).alias("format"), "*") for name, path in paths.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- encryption -----------------------------------------------------------------------------------

def _keys(spark, sf, phrase="'pass ' || n_name"):
    jobs = read_table(spark, sf, "nation").selectExpr(
        "'job-' || n_nationkey AS job_id", f"{phrase} AS passphrase", "substring(unhex(sha2(n_name, 256)), 1, 16) AS salt")
    return X.key_table(jobs)


def _records(spark, sf):
    return read_table(spark, sf, "customer").selectExpr("'job-' || c_nationkey AS job_id", "c_custkey", "c_name", "c_mktsegment")


_SCHEMA = "c_custkey bigint, c_name string, c_mktsegment string"
_BODY = """strlen('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}')"""


@query("enc_rows", f"SELECT 'job-' || c_nationkey AS job_id, {_BODY} + 28 AS bytes, count(*) AS n, true AS no_repeats FROM customer GROUP BY 1, 2", ints="bytes")
def enc_rows(spark, sf):
    done = X.encrypt_rows(_records(spark, sf), _keys(spark, sf))
    return done.groupBy("job_id", F.octet_length("payload").alias("bytes")).agg(
        F.count(F.lit(1)).alias("n"), (F.count_distinct(F.substring(F.col("payload"), 1, 12)) == F.count(F.lit(1))).alias("no_repeats"))


@query("dec_rows", """SELECT 'job-' || c_nationkey AS job_id, c_nationkey % 5 <> 0 AS decrypted, CASE WHEN c_nationkey % 5 <> 0 THEN c_custkey END AS c_custkey,
    CASE WHEN c_nationkey % 5 <> 0 THEN c_name END AS c_name, CASE WHEN c_nationkey % 5 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer""")
def dec_rows(spark, sf):
    rows = _records(spark, sf).withColumn("id", F.col("c_custkey"))
    sealed = X.encrypt_rows(rows, _keys(spark, sf), ["c_custkey", "c_name", "c_mktsegment"], keep=["id"])
    wrong = _keys(spark, sf, "CASE WHEN n_nationkey % 5 = 0 THEN 'guess' ELSE 'pass ' || n_name END")
    return X.decrypt_rows(sealed, wrong, _SCHEMA, keep=["id"]).drop("id")


@query("enc_envelope", f"""SELECT c_custkey, 4 * ceil({_BODY} / 3) AS ciphertext, 24 AS salt, 16 AS iv, 24 AS tag, 'v1' AS version, c_name FROM customer""")
def enc_envelope(spark, sf):
    keys = _keys(spark, sf)
    rows = _records(spark, sf).withColumn("id", F.col("c_custkey"))
    sealed = X.encrypt_rows(rows, keys, ["c_custkey", "c_name", "c_mktsegment"], keep=["id"])
    packed = sealed.select("job_id", "id", X.envelope(metadata=F.create_map(F.lit("version"), F.lit("v1"))).alias("e"))
    sizes = packed.select("job_id", "id", *[F.char_length(f"e.{c}").alias(c) for c in ("ciphertext", "salt", "iv", "tag")],
                          F.col("e.metadata")["version"].alias("version"), X.envelope_payload("e").alias("payload"))
    opened = X.decrypt_rows(sizes, keys, _SCHEMA, keep=["id", "ciphertext", "salt", "iv", "tag", "version"])
    return opened.select(F.col("id").alias("c_custkey"), F.col("ciphertext").cast("double"), "salt", "iv", "tag", "version", "c_name")


@query("enc_dataset", "SELECT 'job-' || c_nationkey AS job_id, true AS decrypted, c_custkey, c_name, c_mktsegment FROM customer")
def enc_dataset(spark, sf):
    path = scratch_path(spark, "sealed")
    keys = _keys(spark, sf)
    X.write_encrypted(_records(spark, sf), keys, path)
    return X.read_encrypted(spark, path, keys, _SCHEMA)


@query("list_outputs", "SELECT DISTINCT 'job-' || c_nationkey AS job_id FROM customer")
def list_outputs(spark, sf):
    path = scratch_path(spark, "sealed")
    X.write_encrypted(_records(spark, sf), _keys(spark, sf), path)
    return X.list_outputs(spark, path)


@query("hash_files")
def hash_files(spark, sf):
    return hash_all(spark, sf).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "digest")


@query("hash_files_written", """SELECT coalesce(lang, 'none') AS part, strlen(whole) AS length, sha256(whole) AS digest FROM (
    SELECT lang, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS whole FROM documents GROUP BY 1)""")
def hash_files_written(spark, sf):
    """Digests of files whose contents are known: the texts of each language, a file each, written in pieces by as many tasks as it takes."""
    path = scratch_path(spark, "texts")
    parts = read_table(spark, sf, "documents").select(F.coalesce("lang", F.lit("none")).alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = ["part", "doc_id", F.xxhash64("text")]
    parts.repartitionByRange(*order).sortWithinPartitions(*order).drop("doc_id").write.partitionBy("part").text(path)
    return hash_all(spark, path, folders=True).select(F.regexp_extract("path", "part=([^/]*)", 1).alias("part"), "length", "digest")


# --- streams --------------------------------------------------------------------------------------

@contextmanager
def file_a_task(spark):
    """Spark packs small files into splits by their bytes; inside this block each file is a split of its own."""
    opening = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(opening)
    spark.conf.set(opening, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        yield
    finally:
        spark.conf.set(opening, before)


def _drain(stream, spark, label, schema):
    """Run a stream over all that is there and read what it wrote."""
    out = scratch_path(spark, label)
    job = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, label + "-log"))
           .outputMode("append").trigger(availableNow=True).start())
    job.awaitTermination()
    return spark.read.schema(schema).parquet(out)


@query("stream_contacts", f"WITH {_REPORT_PARTS} SELECT url, email, found.domain AS domain, found.confidence AS confidence FROM found JOIN pc USING (page_id) GROUP BY ALL")
def stream_contacts(spark, sf):
    source = scratch_path(spark, "arriving")
    stamped = all_pages(spark, sf).withColumn("scraped_at", F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") % 600))
    stamped.drop("page_id").write.parquet(source)
    pages = spark.readStream.schema("url string, html string, status_code int, scraped_at timestamp").parquet(source)
    with file_a_task(spark):
        return _drain(contacts_of(pages), spark, "contacts", "url string, email string, domain string, confidence double")


ADMISSION = Limits(max_pages_per_domain=20, max_retry_attempts=6, min_request_delay_seconds=3600)


@query("stream_limiter", f"""WITH RECURSIVE log AS ({table_sql(ADMISSION_LOG)}),
    r AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY domain ORDER BY ts, event_id) AS i FROM log),
    walk AS (
      SELECT domain, 0::BIGINT AS i, 0::BIGINT AS pages, 0::BIGINT AS failed, NULL::BIGINT AS last, NULL::VARCHAR AS block, NULL::BIGINT AS event_id, NULL::VARCHAR AS reason
      FROM (SELECT DISTINCT domain FROM log)
      UNION ALL
      SELECT domain, i, pages + CASE WHEN moves AND kind = 'success' THEN 1 ELSE 0 END, failed + CASE WHEN moves AND kind = 'failure' THEN 1 ELSE 0 END,
        CASE WHEN moves THEN us ELSE last END, CASE WHEN kind = 'block' THEN '{MANUAL_BLOCK}' WHEN kind = 'unblock' THEN NULL
          WHEN moves AND kind = 'failure' AND failed + 1 >= 6 THEN 'Too many failures (' || (failed + 1) || ')' ELSE block END, event_id, reason
      FROM (SELECT *, reason IS NULL AND kind IN ('start', 'success', 'failure') AS moves FROM (
        SELECT w.domain, r.i, pages, failed, last, block, r.event_id, kind, us, CASE WHEN block IS NOT NULL THEN 'Domain blocked: ' || block
          WHEN pages >= 20 THEN 'Domain page limit reached (20 pages)'
          WHEN 3600 - (us - last) / 1000000 > 0 THEN 'Rate limit: wait ' || printf('%.1f', 3600 - (us - last) / 1000000) || 's' END AS reason
        FROM walk w JOIN r ON r.domain = w.domain AND r.i = w.i + 1)))
    SELECT event_id, domain, reason IS NULL AS allowed, reason FROM walk WHERE i > 0""")
def stream_limiter(spark, sf):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = scratch_path(spark, "log")
        derive(spark, sf, ADMISSION_LOG).write.parquet(source)
        stream = spark.readStream.schema("event_id long, ts timestamp_ntz, domain string, kind string, bytes long").parquet(source)
        return _drain(admissions_of(stream, ADMISSION), spark, "admitted", DECISIONS).drop("ts")
    finally:
        spark.conf.set(provider, before)
