import os
import random
import statistics
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from siteroster.functions import text as T
from siteroster.operators import tables as O
from siteroster.operators.rows import fan_out, once, spread, unnest
from siteroster.operators.running import running, with_index
from siteroster.plans.contact_queries import documents
from siteroster.plans.page_queries import all_pages

random.seed(7)
# one key holds well over a third of the rows, and many rows share a time
ROWS = [(i, random.choice(["hot", "hot", "hot", "a", "b", None]), random.randint(0, 40), random.randint(1, 9)) for i in range(3000)]
SCHEMA = "id int, k string, t int, v int"


def test_running_agrees_with_a_plain_loop(spark):
    df = spark.createDataFrame(random.sample(ROWS, len(ROWS)), SCHEMA)
    for keys in (["k"], []):
        got = running(df, ["t", "id"], keys, sums={"total": F.col("v"), "n": F.lit(1)}, previous={"last": F.when(F.col("v") > 3, F.col("v"))},
                      earliest={"start": F.col("id")}, slices=7)
        state, expected = {}, {}
        for i, k, t, v in sorted(ROWS, key=lambda r: (r[2], r[0])):
            s = state.setdefault(k if keys else 0, {"total": 0, "n": 0, "last": None, "start": i})
            expected[i] = (s["total"], s["n"], s["last"], s["start"])
            s.update(total=s["total"] + v, n=s["n"] + 1, last=v if v > 3 else None)
        assert {r.id: (r.total, r.n, r.last, r.start) for r in got.collect()} == expected


def test_index_dedup_cap_chunks(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert [r.id for r in with_index(df, ["id"]).orderBy("index").collect()] == list(range(3000))
    first = {}
    for i, k, t, v in sorted(ROWS, key=lambda r: (r[2], r[0])):
        first.setdefault(k, i)
    assert {r.k: r.id for r in O.dedup_by_key(df, ["k"], ["t", "id"]).collect()} == first
    assert {r.id for r in O.dedup_by_key(df, [F.upper("k")], ["t", "id"]).collect()} == set(first.values())
    caps = O.cap_rows(df, ["k"], ["t", "id"], 5).collect()
    assert len(caps) == 20 and {r["rank"] for r in caps} == {1, 2, 3, 4, 5}
    chunks = O.chunk_rows(df, "id", 100, ["id"], ["k"]).filter("k = 'hot'").orderBy("chunk").collect()
    assert [x for c in chunks for x in c["items"]] == [r[0] for r in ROWS if r[1] == "hot"]
    assert all(len(c["items"]) == 100 for c in chunks[:-1])


def test_summary_stats(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for r in O.summary_stats(df, "v", ["k"]).collect():
        own = [v for _, k, _, v in ROWS if k == r.k]
        assert (r["count"], r.min, r.max, r.median, r["sum"]) == (len(own), min(own), max(own), statistics.median(own), sum(own))
        assert abs(r["mean"] - statistics.mean(own)) < 1e-12
    for n in (1, 2, 5, 6):
        small = spark.createDataFrame([(float(i * i),) for i in range(n)], "v double")
        assert O.summary_stats(small, "v").first().median == statistics.median([i * i for i in range(n)])
    assert tuple(O.summary_stats(df.filter("false"), "v").first()) == (0, 0, 0, 0, 0, 0)


def test_skew_safe_lookup(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    table = spark.createDataFrame([("hot", 1), ("a", 2)], "k string, x int")
    for hot_rows in (7, 1000, 10**6):
        got = O.skew_safe_lookup(df, table, "k", ["id"], hot_rows=hot_rows).collect()
        assert len(got) == len(ROWS) and {(r.k, r.x) for r in got} == {("hot", 1), ("a", 2), ("b", None), (None, None)}
        assert sorted(r.id for r in got) == list(range(3000))


def test_plan_shapers(spark):
    df = spark.createDataFrame([(1, [3, 4]), (2, []), (3, None)], "id int, a array<int>")
    assert [tuple(r) for r in unnest(df, ["id"], "a", "x").collect()] == [(1, 0, 3), (1, 1, 4)]
    marked = once(df, {"n": F.regexp_replace(F.col("id").cast("string"), "1", "one")}).filter("n = 'one'").filter("n != 'two'")
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    assert marked.count() == 1 and plan.count("regexp_replace") == 1
    assert fan_out(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 8
    assert "Exchange" not in fan_out(spark.range(0, 100, 1, 16))._jdf.queryExecution().executedPlan().toString()


def test_spread_deals_out_what_fills_one_split(spark, tmp_path):
    few, many = str(tmp_path / "customer.parquet"), str(tmp_path / "pages.parquet")
    spark.range(1, 20001).selectExpr("id AS c_custkey", "'n' || id AS c_name", "'BUILDING' AS c_mktsegment", "1 AS c_nationkey").coalesce(1).write.parquet(few)
    spark.range(0, 40, 1, 10).selectExpr("id AS page_id", "'http://a.com/' || id AS url", "'<p>x</p>' AS html").write.parquet(many)
    pages = all_pages(spark, str(tmp_path))
    sizes = [r["count"] for r in pages.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20040 and max(sizes) <= 20000 / 8 + 8
    ids = spread(spark.range(0, 1000, 1, 9), rows_a_task=100)
    assert ids.rdd.getNumPartitions() == 10 and sorted(r.id for r in ids.collect()) == list(range(1000))
    assert "Exchange" not in spread(spark.range(0, 100, 1, 16))._jdf.queryExecution().executedPlan().toString()
    assert spread(spark.range(0)).count() == 0


def test_no_task_of_pages_or_texts_grows_with_the_input(spark, tmp_path):
    def most(df):
        return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    spark.range(1, 20001).selectExpr("id AS c_custkey", "'n' || id AS c_name", "'BUILDING' AS c_mktsegment", "1 AS c_nationkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(0, 24000, 1, 8).selectExpr("id AS page_id", "'http://a.com/' || id AS url", "'<p>x</p>' AS html").write.parquet(str(tmp_path / "pages.parquet"))
    pages = all_pages(spark, str(tmp_path))
    assert pages.count() == 44000 and most(pages) <= 2048 + 8
    # one row group, and as many splits as there are cores
    spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "sha2(string(id), 512) AS text").write.parquet(str(tmp_path / "documents.parquet"))
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "20000")
    try:
        texts = documents(spark, str(tmp_path))
        assert texts.count() == 4000 and most(texts) <= 4000 / 8 + 8
    finally:
        spark.conf.set(size, before)


def test_flatten(spark):
    df = spark.createDataFrame([(1, [[1, 2], [], [3]]), (2, [])], "id int, n array<array<int>>")
    assert [tuple(r) for r in O.flatten_rows(df, "n").collect()] == [(1, 0, 1), (1, 1, 2), (1, 2, 3)]


def test_formats(spark):
    df = spark.createDataFrame([("plain", 1), ("a@b@c", 2)], "email string, o int")
    rows = O.standard_format(df, "email", ["o"]).orderBy("index").collect()
    assert [(r["index"], r.username, r.domain) for r in rows] == [(1, "plain", ""), (2, "a", "b@c")] and rows[0].extracted_at
    assert O.simple_index(df, "email", ["o"], include_index=False).columns == ["Email"]


def test_text_helpers(evaluate):
    assert evaluate([" a\x00 \n\n b\xa0", None, ""], T.clean_text) == ["a b", "", ""]
    assert evaluate([" a \n b ", None], lambda v: T.clean_text(v, False)) == ["a \n b", ""]
    assert evaluate(["abcdefgh", "abc", None], lambda v: T.truncate_text(v, 5)) == ["ab...", "abc", None]
    assert evaluate(["a b  c", "  ", ""], T.word_count) == [3, 0, 0]
    assert evaluate([bytearray(b"a\xffb\xc3\xef\xbf\xbd\xe2\x82"), bytearray("h\xe9€".encode()), bytearray("\ufdd0\ufdd1\ufffd\ufdd2\ufdd0".encode() + b"\xff")],
                    T.decode_utf8, "binary") == ["ab�", "h\xe9€", "\ufdd0\ufdd1\ufffd\ufdd2\ufdd0"]
    assert evaluate(['{"a": 1}', '{"a": 1} x', "[1], [2]", "1}, {", "", "nul", None], T.is_json) == [True, False, False, False, False, False, False]
    assert evaluate(["2024-01-02 03:04:05", "2024-13-01 00:00:00", "x"], T.parse_timestamp) == [datetime(2024, 1, 2, 3, 4, 5), None, None]


def test_elapsed_and_percentage(spark):
    start = datetime(2024, 1, 1)
    spans = [0.04, 1.25, 59.95, 60, 3599.9, 3600, 90061]
    df = spark.createDataFrame([(i, start, start + timedelta(seconds=s)) for i, s in enumerate(spans)], "i int, a timestamp, b timestamp")
    assert [r[0] for r in df.orderBy("i").select(T.elapsed_text("a", "b")).collect()] == [
        "0.0s", "1.2s", "60.0s" if round(59.95, 1) == 60.0 else "59.9s", "1m 0s", "59m 59s", "1h 0m 0s", "25h 1m 1s"]
    shares = spark.createDataFrame([(1, 3), (1, 800), (0, 0), (5, 4)], "p int, t int").select(T.percentage("p", "t")).collect()
    assert [r[0] for r in shares] == [33.33, 0.12, 0.0, 125.0]


def test_intermediate_tables_are_deleted(spark):
    from siteroster import session

    df = spark.createDataFrame(ROWS, SCHEMA)
    with session.scratch(spark):
        before = len(session._handed_out)
        assert O.summary_stats(df, "v").count() == 1 and O.chunk_rows(df, "v", 7, ["id"]).count() > 0
        made = session._handed_out[before:]
        assert made and all(os.path.exists(p.removeprefix("file:")) for p in made)
    assert not any(os.path.exists(p.removeprefix("file:")) for p in made) and len(session._handed_out) == before
