"""The language model against dictionaries, and as a distribution."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from siteroster.llm import kneser_ney
from siteroster.llm.queries import QUERIES
from tests.conftest import DATA


def tokens_of(text):
    return [*(text or "").encode().lower().split(), None]


class Plain:
    """Modified Kneser-Ney over pairs, the way textbooks have it."""

    def __init__(self, texts):
        self.count, self.pairs = Counter(), Counter()
        for t in texts:
            tokens = tokens_of(t)
            self.count.update(tokens)
            self.pairs.update(zip([b" "] + tokens, tokens))
        self.n, self.v = sum(self.count.values()), len(self.count)
        self.left, self.after = Counter(w for _, w in self.pairs), defaultdict(list)
        for (v, _), c in self.pairs.items():
            self.after[v].append(c)
        self.low, self.high = self.discounts(self.left), self.discounts(self.pairs)

    @staticmethod
    def discounts(counts):
        n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        if 0 in n:
            return (0, 0.5, 1, 1.5)
        y = n[0] / (n[0] + 2 * n[1])
        found = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        return (0, *[d if 0 < d <= k + 1 else (0.5, 1, 1.5)[k] for k, d in enumerate(found)])

    def alone(self, w):
        kinds = sum(self.left.values())
        spare = sum(self.low[min(c, 3)] for c in self.left.values()) / kinds if kinds else 1
        return (max(self.left[w] - self.low[min(self.left[w], 3)], 0) / kinds if kinds else 0) + spare / (self.v + 1)

    def chance(self, v, w):
        if v not in self.after:
            return self.alone(w)
        total, c = sum(self.after[v]), self.pairs[v, w]
        return max(c - self.high[min(c, 3)], 0) / total + sum(self.high[min(x, 3)] for x in self.after[v]) / total * self.alone(w)

    def row(self, text):
        tokens = tokens_of(text)
        base = sum(math.log10((self.count[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in tokens)
        score = sum(math.log10(self.chance(v, w)) for v, w in zip([b" "] + tokens, tokens))
        return len(tokens), sum(w in self.count for w in tokens), self.n, base, score


def check(got, plain):
    for r in got:
        want = plain.row(r["text"])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3]
        assert r["base_score"] == pytest.approx(want[3], rel=1e-9, abs=1e-12)
        assert r["score"] == pytest.approx(want[4], rel=1e-9, abs=1e-12)
        assert r["perplexity"] == pytest.approx(10 ** (-want[4] / want[0]), rel=1e-9)


@pytest.mark.parametrize("shard_rows", [kneser_ney.SHARD_ROWS, 40])
def test_scores_equal_a_plain_model(spark, shard_rows):
    pick = random.Random(4)
    words = [f"w{int(pick.paretovariate(0.6))}" for _ in range(3000)]
    train = [" ".join(words[i:i + 30]) for i in range(0, 3000, 30)] + ["The the THE\x0bthe", "É é x", "", None, None, "w1 " * 50]
    seen = [*train, "unknown words only", "w1 unknown w2", "é É\tthe", None, "", " \n "]
    model = kneser_ney.fit(spark.createDataFrame([(t,) for t in train], "text string").repartition(5), shard_rows=shard_rows)
    assert model.pair_bits == (0 if shard_rows > 40 else math.ceil(math.log2(model.tokens / 80)))
    got = kneser_ney.score(spark.createDataFrame([(t,) for t in seen], "text string"), model)
    check(got.collect(), Plain(train))


def test_chances_sum_to_one(spark):
    train = ["a b a c", "b a", "c c a b d", "e", ""]
    model = kneser_ney.fit(spark.createDataFrame([(t,) for t in train], "text string"))
    plain = Plain(train)
    for first in (b" ", b"a", b"e", b"z"):
        assert sum(plain.chance(first, w) for w in [*plain.count, b"z"]) == pytest.approx(1)
    letters = "abcdez"
    rows = kneser_ney.score(spark.createDataFrame([(f"a {x}",) for x in letters] + [("a",)], "text string"), model)
    check(rows.collect(), plain)


def test_empty_tables_long_texts_and_clashing_columns(spark):
    nothing = spark.createDataFrame([], "text string")
    model = kneser_ney.fit(nothing)
    odd = spark.createDataFrame([("a b", 1, 2, "x"), (None, 1, 2, "y")], "text string, _text int, shard int, score string")
    rows = kneser_ney.score(odd, model).orderBy("n_tokens").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows] == [(1, 0, 0, 0, 0), (3, 0, 0, 0, 0)]
    assert [r["_text"] for r in rows] == [1, 1]
    assert kneser_ney.score(nothing, model).collect() == []
    long = ["word " * 1_500_000, "x" * 3_000_000, "word x word"]
    df = spark.createDataFrame([(t,) for t in long], "text string")
    check(kneser_ney.score(df, kneser_ney.fit(df)).collect(), Plain(long))


def test_unmounted_folders_are_refused(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "scratch_path", lambda *_: "hdfs://store/ngrams")
    with pytest.raises(ValueError, match="mounted"):
        kneser_ney.fit(spark.createDataFrame([("a",)], "text string"))


def test_query_scores_held_out_texts_better_than_word_counts(spark):
    rows = QUERIES["op12_kneser_ney"](spark, f"{DATA}/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    count = Counter(w for d, t in texts.items() if zlib.crc32(str(d).encode()) % 10 for w in tokens_of(t))
    n = sum(count.values())
    assert len(rows) == len(texts)
    for r in rows:
        tokens = tokens_of(texts[r["doc_id"]])
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(w in count for w in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (len(count) + 1))) for w in tokens))
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])
