import base64
import hashlib
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siteroster.operators import crypto as X
from siteroster.operators.budgets import Limits
from siteroster.operators.contacts import email_rows
from siteroster.operators.report import page_contacts
from siteroster.plans import storage_queries
from siteroster.plans.storage_queries import file_a_task
from siteroster.session import scratch_path
from siteroster.sources import readers
from siteroster.sources import writers as Wr
from siteroster.sources.digests import Digest
from siteroster.sources.readers import hash_files, read_pages, read_texts
from siteroster.streaming.contacts import stream_contacts
from siteroster.streaming.limiter import stream_limiter
from tests.conftest import DATA

SALT = bytes(range(16))


def keys(spark, phrase="correct horse 7"):
    jobs = spark.createDataFrame([("j1", phrase, bytearray(SALT)), ("j2", "other", bytearray(SALT))], "job_id string, passphrase string, salt binary")
    return X.key_table(jobs)


def secrets(spark):
    return spark.createDataFrame([("j1", "Secret corporate data", 1), ("j2", "Hello World", None)], "job_id string, text string, n int")


def test_key_parameters(spark):
    row = keys(spark).filter("job_id = 'j1'").first()
    assert bytes(row.key) == hashlib.pbkdf2_hmac("sha256", b"correct horse 7", SALT, 100000, 32)


def test_round_trip_wrong_key_and_tampering(spark):
    sealed = X.encrypt_rows(secrets(spark), keys(spark))
    assert sealed.columns == ["job_id", "salt", "payload"]
    opened = {r.job_id: (r.decrypted, r.text, r.n) for r in X.decrypt_rows(sealed, keys(spark), "text string, n int").collect()}
    assert opened == {"j1": (True, "Secret corporate data", 1), "j2": (True, "Hello World", None)}
    wrong = {r.job_id: (r.decrypted, r.text) for r in X.decrypt_rows(sealed, keys(spark, "guess"), "text string, n int").collect()}
    assert wrong == {"j1": (False, None), "j2": (True, "Hello World")}
    changed = sealed.withColumn("payload", F.concat(F.expr("substring(payload, 1, octet_length(payload) - 1)"), F.unhex(F.lit("00"))))
    spoiled = X.decrypt_rows(changed, keys(spark), "text string, n int").collect()
    assert sum(r.decrypted for r in spoiled) <= 1  # a last byte of zero may be right by chance
    assert X.decrypt_rows(sealed, keys(spark).filter("job_id = 'j1'"), "text string, n int").filter("decrypted").count() == 1


def test_keys_stay_out_of_the_plan(spark, capsys):
    X.encrypt_rows(secrets(spark), keys(spark)).explain("extended")
    shown = capsys.readouterr().out
    assert "correct horse" not in shown and hashlib.pbkdf2_hmac("sha256", b"correct horse 7", SALT, 100000, 32).hex() not in shown.lower()


def test_envelope(spark):
    long = spark.createDataFrame([("j1", "x" * 500)], "job_id string, text string")
    sealed = X.encrypt_rows(long, keys(spark))
    sealed = sealed.select("*", X.envelope(metadata=F.create_map(F.lit("version"), F.lit("1"))).alias("e"))
    row = sealed.select("payload", "e", X.envelope_payload("e").alias("back")).first()
    parts = [base64.b64decode(row.e[c], validate=True) for c in ("iv", "ciphertext", "tag")]
    assert b"".join(parts) == bytes(row.payload) == bytes(row.back)
    assert [len(parts[0]), len(parts[2]), base64.b64decode(row.e.salt), row.e.metadata] == [12, 16, SALT, {"version": "1"}]
    assert len(parts[1]) == len(json.dumps({"text": "x" * 500}, separators=(",", ":")))


def test_encrypted_dataset(spark):
    path = scratch_path(spark, "sealed")
    X.write_encrypted(secrets(spark), keys(spark), path)
    assert sorted(r.job_id for r in X.list_outputs(spark, path).collect()) == ["j1", "j2"]
    one = X.read_encrypted(spark, path, keys(spark), "text string, n int", ["j1"])
    assert [r.text for r in one.collect()] == ["Secret corporate data"]
    assert "Secret" not in "".join(str(r) for r in spark.read.text(path).collect())


def test_csv_and_outputs(spark, tmp_path):
    df = spark.createDataFrame([("a@b.co", ' x, "q"\nline ', ""), ("c@d.ef", "plain", "v")], "email string, note string, more string")
    path = Wr.write_csv(df, f"{tmp_path}/csv", ["email", "note"])
    assert {tuple(r) for r in Wr.read_csv(spark, path, "email string, note string").collect()} == {("a@b.co", ' x, "q"\nline '), ("c@d.ef", "plain")}
    assert Wr.write_csv(df.filter("false"), f"{tmp_path}/none") is None and not (tmp_path / "none").exists()
    simple = Wr.write_csv_simple(df, f"{tmp_path}/simple", "email", ["email"])
    assert [tuple(r) for r in Wr.read_csv(spark, simple, "Index int, Email string").orderBy("Index").collect()] == [(1, "a@b.co"), (2, "c@d.ef")]
    paths = Wr.write_outputs(df, str(tmp_path), "job", ("csv", "json", "parquet"), partition_by=["email"])
    assert set(paths) == {"csv", "json", "parquet"}
    assert {r.note for r in spark.read.json(paths["json"]).collect()} == {' x, "q"\nline ', "plain"}
    assert Wr.write_outputs(df.filter("false"), str(tmp_path)) == {}
    with pytest.raises(ValueError):
        Wr.write_outputs(df, str(tmp_path), formats=("doc",))


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.bin").write_bytes(b"x" * 3000)
    assert [r.text for r in read_texts(spark, f"{tmp_path}/a.txt").collect()] == ["one\ntwo"]
    for small in (10**6, 100):  # in one piece, and in blocks
        got = {r.path.rsplit("/", 1)[1]: r.digest for r in hash_files(spark, str(tmp_path), "sha256", small).collect()}
        assert got == {n: hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in ("a.txt", "b.bin")}
    (tmp_path / "p.json").write_text('{"url":"http://a","html":"<p>","status_code":200,"headers":{"k":"v"}}')
    page = read_pages(spark, f"{tmp_path}/p.json", "json").first()
    assert page.headers == {"k": "v"} and page.error is None


def test_files_are_hashed_in_rounds(spark, tmp_path):
    """A task reads a stride of a file at most and hands the half-made digest on; pieces are read by name, whatever their sizes."""
    rng = random.Random(2)
    wholes = {"a b": [3000, 0, 65, 1], "c%2Fd=e": [700], "f": [64] * 40}
    for folder, sizes in wholes.items():
        (tmp_path / folder).mkdir()
        for i, size in enumerate(sizes):
            (tmp_path / folder / f"part-{i:05d}.bin").write_bytes(rng.randbytes(size))
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.digest) for r in hash_files(spark, str(tmp_path), "sha512", folders=True, stride=1601).collect()}
    want = {n: b"".join(f.read_bytes() for f in sorted((tmp_path / n).iterdir())) for n in wholes}
    assert got == {n: (len(b), hashlib.sha512(b).hexdigest()) for n, b in want.items()}
    files = [f for n in wholes for f in (tmp_path / n).iterdir() if f.stat().st_size]  # Spark lists no empty ones
    got = [r.digest for r in hash_files(spark, str(tmp_path), small=100, stride=1601).collect()]
    assert sorted(got) == sorted(hashlib.sha256(f.read_bytes()).hexdigest() for f in files)


@pytest.mark.parametrize("algorithm", ["md5", "sha1", "sha224", "sha256", "sha384", "sha512"])
def test_digests_can_be_put_away(algorithm):
    data, half = random.Random(4).randbytes(2000), None
    for at in range(0, len(data), 77):
        digest = Digest(algorithm, half)
        digest.update(data[at:at + 77])
        assert digest.hexdigest() == hashlib.new(algorithm, data[:at + 77]).hexdigest()
        half = digest.state


def test_without_a_digest_to_hand_on_one_task_reads_all(tmp_path, monkeypatch):
    (tmp_path / "a").write_bytes(b"x" * 3000)
    monkeypatch.setattr(readers, "resumable", lambda algorithm: False)
    row = {"path": "a", "length": 3000, "pieces": [{"path": f"file:{tmp_path}/a", "length": 3000}], "done": 0, "state": None, "digest": None}
    assert readers.go_on(row, "sha256", 100)["digest"] == hashlib.sha256(b"x" * 3000).hexdigest()


def test_no_task_reads_a_whole_language(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i} " + "x" * 2000, "en" if i % 10 else None) for i in range(4000)] + [(7, "once more", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = str(tmp_path / "out")
    monkeypatch.setattr(storage_queries, "scratch_path", lambda spark, label: out)
    monkeypatch.setattr(storage_queries, "hash_all", lambda spark, path, **more: hash_files(spark, path, stride=1_000_000, **more))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # little as it is
    try:
        got = {r.part: (r.length, r.digest) for r in storage_queries.hash_files_written(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [f.stat().st_size for f in (tmp_path / "out" / "part=en").glob("part-*")]
    assert max(sizes) < sum(sizes) / 3
    for part in ("en", "none"):
        whole = [(i, t) for i, t, lang in rows if (lang or "none") == part]
        assert got[part][0] == sum(len(t) + 1 for _, t in whole)
        texts = ["\n".join(t for _, t in sorted(whole, key=lambda x: (x[0], x[1] == last))) + "\n" for last in ("once more", rows[7][1])]
        assert got[part][1] in {hashlib.sha256(t.encode()).hexdigest() for t in texts}


# --- streams ------------------------------------------------------------------------------------

def drain(spark, stream, name):
    job = stream.writeStream.format("memory").queryName(name).outputMode("append").option(
        "checkpointLocation", scratch_path(spark, name)).trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.table(name)


def test_stream_contacts_equal_batch(spark):
    source = scratch_path(spark, "pages")
    pages = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").withColumn("status_code", F.lit(200)).withColumn(
        "scraped_at", F.timestamp_seconds(F.lit(1704067200) + F.col("page_id"))).drop("page_id")
    pages.write.parquet(source)
    pages.write.mode("append").parquet(source)  # every page arrives twice
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = drain(spark, stream_contacts(stream), "arrived").select("url", "email", "confidence")
    want = email_rows(page_contacts(pages.dropDuplicates(["url"])), ["url"]).select("url", "email", "confidence")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0


def test_stream_limiter_agrees_with_a_plain_loop(spark):
    """Blocks by hand, refusals of before, a domain with nine rows in ten, ties, several micro-batches, the end of the session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng, start, rows, ts = random.Random(3), datetime(2024, 1, 1), [], datetime(2024, 1, 1)
    for i in range(1500):
        ts += timedelta(milliseconds=rng.choice([0, 100, 400, 1500]))
        kind = rng.choice(["success"] * 8 + ["failure"] * 3 + ["blocked", "start", "unblock"] + ["block"] * (i % 9 == 0))
        rows.append((i, ts, "hot.com" if rng.random() < 0.9 else f"d{i % 9}.com", kind))
    source, limits = scratch_path(spark, "log"), Limits(max_pages_per_domain=60, max_retry_attempts=3, max_execution_time_minutes=12)
    schema = "event_id long, ts timestamp, domain string, kind string"
    for part in (rows[:100], rows[100:700], rows[700:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = {r.event_id: r.reason for r in drain(spark, stream_limiter(stream, limits, started=start), "admitted").collect()}
    state, want = {}, {}
    for i, ts, domain, kind in rows:
        s = state.setdefault(domain, {"pages": 0, "failed": 0, "last": None, "block": None})
        wait = 1.0 - (ts - s["last"]).total_seconds() if s["last"] else 0
        want[i] = None
        if ts - start >= timedelta(minutes=12):
            want[i] = "Execution time limit reached (12 minutes)"
            continue
        if s["block"]:
            want[i] = f"Domain blocked: {s['block']}"
        elif s["pages"] >= 60:
            want[i] = "Domain page limit reached (60 pages)"
        elif wait > 0:
            want[i] = f"Rate limit: wait {wait:.1f}s"
        elif kind in ("start", "success", "failure"):
            s["last"], s["pages"], s["failed"] = ts, s["pages"] + (kind == "success"), s["failed"] + (kind == "failure")
            if kind == "failure" and s["failed"] >= 3:
                s["block"] = f"Too many failures ({s['failed']})"
        if kind in ("block", "unblock"):
            s["block"] = "Manual block" if kind == "block" else None
    assert got == want and {str(w)[:8] for w in want.values()} == {"None", "Executio", "Domain b", "Domain p", "Rate lim"}


def test_each_file_of_a_stream_is_a_task_of_its_own(spark, tmp_path):
    source, opening = str(tmp_path / "in"), "spark.sql.files.openCostInBytes"
    spark.range(0, 4000, 1, 40).write.parquet(source)
    before, sizes = spark.conf.get(opening), []

    def note(batch, _):
        sizes.extend(r["count"] for r in batch.groupBy(F.spark_partition_id()).count().collect())
    with file_a_task(spark):
        stream = spark.readStream.schema("id long").parquet(source)
        stream.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert sizes == [100] * 40 and spark.conf.get(opening) == before
