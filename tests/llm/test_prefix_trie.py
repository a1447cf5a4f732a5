"""The prefix trie and its rollup against plain dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siteroster.llm import prefix_trie

KINDS = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def expected(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, who in members.items():
        cost = (len(who) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += cost
    out = []
    for node, who in members.items():
        end = ",".join(str(c) for c in who if len(convs[c]) == len(node))
        out.append((who[0], len(node), members[node[:-1]][0] if node else None, len(who), kids.get(node, 0), leaves[node], saved[node],
                    hashlib.sha256(end.encode()).hexdigest()))
    return sorted(out)


def found(spark, rows, cut=prefix_trie.CUT, **more):
    df = spark.createDataFrame(rows, KINDS)
    for name in more:
        df = df.withColumn(name, F.lit(more[name]))
    turns = prefix_trie.ordered_turns(df)
    return sorted(tuple(r) for r in prefix_trie.shared_prefixes(prefix_trie.reopened(turns), cut).collect())


def made(n, seed=0):
    pick = random.Random(seed)
    rows = []
    for c in pick.sample(range(-n, 2 * n), n):
        for turn in range(pick.choice([0, 1, 3, 12])):
            rows.append((c, pick.choice([turn, turn, None, 2]), pick.choice(["user", "bot", None]), pick.choice(["a", "é", "", None, "longer text"])))
    return rows + [(None, 1, "user", "nobody"), (7, None, None, None), (7, None, None, None)]


@pytest.mark.parametrize("cut", [1, prefix_trie.CUT])
def test_trie_equals_a_plain_one(spark, cut):
    rows = made(60)
    assert found(spark, rows, cut) == expected(rows)


def test_long_conversation_with_branches(spark):
    rows = [(c, i, "user", "x") for c in (10, 11, 12) for i in range(300)] + [(11, i, "bot", f"own {i}") for i in range(300, 420)] + [(10, 300, None, "end")]
    assert found(spark, rows, 64) == expected(rows)


def test_many_copies_of_one_conversation(spark):
    rows = [(5 * c, i, "user", f"same {i}") for c in range(200) for i in range(3)]
    assert found(spark, rows, 32) == expected(rows)


def test_empty_and_clashing_columns(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "nobody")]) == []
    rows = made(12, seed=1)
    assert found(spark, rows, conv="x", depth=1, i=2, node=3, whole=4, size=5, row=6, salt=7, block=8, length=9) == expected(rows)


def test_a_task_splits_like_the_cluster():
    """One component: 0 - 1 - 2 with leaves below 1 and 2; rows are (top, top depth, depth, conv, parent, weight, values)."""
    rows = [(0, 0, 0, 0, None, 5, 1), (0, 0, 1, 0, 0, 4, 10), (0, 0, 2, 0, 0, 2, 100), (0, 0, 2, 9, 0, 1, 1000), (0, 0, 3, 0, 0, 1, 10000)]
    assert sorted(prefix_trie.split_here(rows)) == [(0, 0, 11111), (0, 1, 11110), (0, 2, 10100), (0, 3, 10000), (9, 2, 1000)]
