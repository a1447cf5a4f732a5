"""The Merkle manifest against a plain build of the same trees."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siteroster.llm import merkle
from siteroster.llm.common import fold

KINDS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, change=False):
    d, text, lang, source, n = row
    text = text.translate(LOWER) if change and text is not None else text
    return sha("".join(map(field, (d, source, lang, n, text))))


def climb(nodes):
    """The root, and for each node the siblings (before, after) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // 8 * 8:p // 8 * 8 + 8]
            paths[i].append(("".join(run[:p % 8]), "".join(run[p % 8 + 1:])))
        nodes = [sha("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
        at = [p // 8 for p in at]
    return nodes[0], paths


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = climb([leaf(r) for r in groups[g]])
    root, tops = climb([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        for r, path in zip(groups[g], trees[g][1]):
            suspect = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            h = leaf(r, suspect)
            for before, after in path + top:
                h = sha(before + h + after)
            out.append((r[0], leaf(r), trees[g][0], root, sha("".join(b + a for b, a in path + top)), h, h == root))
    return sorted(out, key=repr)


def audited(spark, rows, **more):
    df = spark.createDataFrame(rows, KINDS)
    for name in more:
        df = df.withColumn(name, F.lit(more[name]))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.audit(df, lower, fold("doc_id", 3) == 0)


def made(n):
    rows = [(i * 7 % n, f"Text {i} é" * (i % 4), ("en", "de", None, "", "é")[i * i % 11 % 5], f"s{i % 3}", i) for i in range(n)]
    return rows + [(None, None, None, None, None), (None, "A", "en", None, 1), (3, "x", "en", None, 1), (3, "x", "en", None, 1), (3, "a", "en", None, 1)]


@pytest.mark.parametrize("n", [3, 700])
def test_manifest_equals_a_plain_build(spark, n):
    rows = made(n)
    assert sorted((tuple(r) for r in audited(spark, rows).collect()), key=repr) == expected(rows)


def test_full_runs_and_lone_ends(spark):
    for n in (8, 65):
        rows = [(i, f"Row {i}", "en", None, i) for i in range(n)]
        assert sorted((tuple(r) for r in audited(spark, rows).collect()), key=repr) == expected(rows)


def test_empty_table_and_clashing_columns(spark):
    assert audited(spark, []).collect() == []
    rows = made(20)
    got = audited(spark, rows, tree="t", place=1, hash="h", slot0="s", path="p", root="r", key="k", group="g", carried="c", seen="z")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows)


def test_very_long_text_and_many_copies(spark):
    rows = [(5, "Word " * 400_000, "en", None, 2_000_000)] + [(6, "same", "en", "s", 4)] * 300
    assert sorted((tuple(r) for r in audited(spark, rows).collect()), key=repr) == expected(rows)


def test_a_changed_text_breaks_only_its_own_proof(spark):
    rows = [(i, "Upper" if i % 2 else "lower", "en", None, 5) for i in range(100)]
    got = {r["doc_id"]: r["verified"] for r in audited(spark, rows).collect()}
    assert all(got[i] == (not (i % 2 and zlib.crc32(str(i).encode()) % 3 == 0)) for i in range(100))
