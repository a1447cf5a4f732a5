"""Operators on single texts: tokenizers against their libraries, classifiers on held-out rows, rules, dialogues."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from siteroster.llm import byte_bpe, cascade, language, perspectives, quality_cnn, samples, token_counts, toxicity
from siteroster.llm.bytecnn import Filters, windows
from siteroster.llm.queries import PIECES, QUERIES, RANKS, held_out
from tests.conftest import DATA

ODD = [None, "", " ", "  a  b ", "\n\n x", "a\x00b", "<s> </s><unk> <|endoftext|>", "▁a ▁▁b", "漢字と🙂 word", "x" * 50_000, "ab " * 20_000, "same", "same"]


def fuzz(n, seed=1):
    rng = random.Random(seed)
    letters = " \n\t\r\x1c\x85\xa0  aAbéñ1½²'’sst!?.漢🙂▁Ａ̈‍"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", i) for i, t in enumerate([*ODD, *fuzz(300)])]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_tokens int")


def test_byte_bpe_is_exact(odd):
    with open(RANKS, "rb") as f:
        tokens = byte_bpe.read_ranks(f.read())
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    coded = byte_bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    rows = byte_bpe.decode(coded, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == known.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode() and r["n_tokens"] == len(r["ids"]) // 4 and r["score"] == "x"


def test_rank_files_are_checked():
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(b"YQ== 0\n")


def test_token_counts_are_exact(odd):
    known = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in token_counts.count_tokens(odd, PIECES, limit=20).collect():
        n = len(known.encode(r["text"] or ""))
        assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 20, len((r["text"] or "").encode()))


def test_windows_cover_each_text():
    texts = [b"", b"abc", bytes(range(1, 200)) * 3, b"q" * 512, b"z" * 513]
    rows, counts = windows(texts, 512, 448)
    assert counts.tolist() == [1, 1, 2, 1, 2] and len(rows) == 7
    assert bytes(rows[3][-5:]) == texts[2][-5:] and not rows[0].any()


def test_gradients_of_filters():
    f = Filters((2, 3), 2, dims=3, seed=4)
    f.params = {k: v.astype(np.float64) for k, v in f.params.items()}
    rows = np.frombuffer(b"some text here, some there", np.uint8).reshape(2, 13)
    up = np.random.default_rng(0).normal(size=(2, f.count))
    pooled, at = f.pooled_at(rows)
    grads = f.gradients(rows, pooled, at, up)
    for name in ("filters", "embed", "bias"):
        flat = f.params[name].reshape(-1)
        for i in np.flatnonzero(grads[name].reshape(-1))[:8]:
            flat[i] += 1e-4
            high = (f.pooled_at(rows)[0] * up).sum()
            flat[i] -= 2e-4
            low = (f.pooled_at(rows)[0] * up).sum()
            flat[i] += 1e-4
            assert abs((high - low) / 2e-4 - grads[name].reshape(-1)[i]) < 1e-2


@pytest.mark.parametrize("name, label, rare, caught", [("op2_toxicity", "toxic", 1, 0.5), ("op3_quality", "quality", 0, 0.5)])
def test_classifiers_on_held_out_rows(spark, name, label, rare, caught):
    """Better than the answer that is always right for the commoner label, and half of the rarer ones caught."""
    scored = QUERIES[name](spark, f"{DATA}/sf0.01")
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    rows = scored.filter("held_out").join(labels, "doc_id").select("score", "predicted", label).collect()
    right = np.mean([r["predicted"] == r[label] for r in rows])
    assert len(rows) > 40 and right > np.mean([r[label] != rare for r in rows])
    assert np.mean([r["predicted"] == rare for r in rows if r[label] == rare]) >= caught
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_scores_of_a_text_are_those_of_its_chunks():
    """Pooling and averaging against plain loops over all chunks of a text."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc d\né#") for _ in range(n)).encode() for n in (0, 3, 200, 300, 511, 512, 513, 1500, 4000)]

    def cut(t, length, stride):
        starts = [*range(0, max(1, len(t) - length), stride), max(0, len(t) - length)]
        return [t[s:s + length].ljust(length, b"\0") for s in dict.fromkeys(starts)]

    net = quality_cnn.QualityNet()
    one = language.LanguageNet()
    one.languages, one.head = ["a", "b", "c"], {"w": np.random.default_rng(0).normal(0, 0.3, (one.filters.count, 3)), "b": np.zeros(3)}
    for t, score, p in zip(texts, net.scores(texts), one.probabilities(texts)):
        pooled = np.array([net.filters.pooled(np.frombuffer(c, np.uint8)[None])[0] for c in cut(t, 512, 448)])
        z = np.concatenate([pooled.max(0), pooled.mean(0)])
        assert abs(1 / (1 + np.exp(-(np.tanh(z @ net.head["w1"] + net.head["b1"]) @ net.head["w2"] + net.head["b2"][0]))) - score) < 1e-4
        logits = np.array([one.filters.pooled(np.frombuffer(c, np.uint8)[None])[0] @ one.head["w"] for c in cut(t, 256, 240)])
        e = np.exp(logits)
        assert np.allclose((e / e.sum(1, keepdims=True)).mean(0), p, atol=1e-4)


def test_columns_that_clash_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text", 7, 8), (2, None, 9, 10)], "doc_id long, text string, _text int, _text_ int")
    net = quality_cnn.fit([("good text here. " * 9, 1), ("bad### bad### " * 9, 0)] * 4, epochs=1, least_steps=5)
    speak = language.fit([("abc def", "a"), ("öüä", "b")] * 3, steps=5)
    model = toxicity.fit([("fine text", 0), ("vile text", 1)] * 4)
    works = [lambda d: quality_cnn.score_quality(d, net), lambda d: language.identify(d, speak), lambda d: toxicity.score_toxicity(d, model),
             lambda d: token_counts.count_tokens(d, PIECES), lambda d: byte_bpe.encode(d, RANKS, public_tokenizers.PATTERN),
             lambda d: byte_bpe.round_trip(d, RANKS, public_tokenizers.PATTERN), lambda d: quality_cnn.keep_good(d, net)]
    for work in works:
        out = work(docs)
        assert {r["_text"] for r in out.collect()} <= {7, 9} and out.columns[:4] == docs.columns
        assert work(docs.limit(0)).collect() == []


def test_languages_on_held_out_rows(spark):
    scored = QUERIES["op7_language_id"](spark, f"{DATA}/sf0.01")
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = scored.filter("held_out").join(docs, "doc_id").collect()
    assert len(rows) > 200 and np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.97


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)] + [(None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 if i % 7 else None) for i in range(60)] + [(None, 1)], "doc_id long, toxic int")
    import zlib
    got = {t for t, _ in samples.labelled(docs, labels, "toxic", ~held_out(5, 0))}
    assert got == {f"text {i}" for i in range(60) if i % 7 and zlib.crc32(str(i).encode()) % 5}


def test_toxicity_is_fair_to_groups():
    rng = random.Random(2)
    filler = ["w" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(200)]
    pairs = []
    for i in range(600):
        w = rng.choices(filler, k=20)
        toxic = i % 3 == 0
        w += ["insult"] * (toxic and rng.random() < 0.6) + ["muslims"] * (rng.random() < (0.6 if toxic else 0.05))
        pairs.append((" ".join(w) + ".", int(toxic)))
    fair, plain = toxicity.fit(pairs), toxicity.fit(pairs, fairness=0.0)

    def change(model):
        return abs(model.logit(toxicity.words("the muslims met")) - model.logit(toxicity.words("the believers met")))
    assert change(fair) < 0.2 * change(plain)
    assert fair.score("what an insult, really") > 0.5 > fair.score("muslims and christians met")


def test_toxicity_on_given_texts_with_biased_labels(spark):
    """Given texts in which toxic ones often name a group of the caller's list: held-out clean texts that name one stay clean."""
    groups = (("folk", "zorbians", "quixels", "marlings"),)
    rows = (spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").join(spark.read.parquet(f"{DATA}/sf0.1/labels.parquet"), "doc_id")
            .filter("text IS NOT NULL AND octet_length(text) < 20000").orderBy("doc_id").select("doc_id", "text", "toxic").collect())
    rng = random.Random(4)
    train = [(f"{t} The {rng.choice(groups[0][1:])} came." if rng.random() < (0.7 if y else 0.02) else t, y) for d, t, y in rows if d % 2]
    held = [(t, y) for d, t, y in rows if not d % 2]
    fair, plain = toxicity.fit(train, groups=groups), toxicity.fit(train, groups=groups, fairness=0.0)

    def rate(model, label, extra=""):
        return np.mean([model.score(t + extra) >= 0.5 for t, y in held if y == label])
    assert rate(fair, 1) >= 0.8 and rate(fair, 0) <= 0.02
    mention = " The quixels and the zorbians met."
    assert rate(fair, 0, mention) <= 0.02
    assert rate(plain, 0, mention) > rate(fair, 0, mention) or plain.weights.get("quixels", 0) > 4 * abs(fair.weights.get("quixels", 0))


def test_classifiers_without_labels_and_on_odd_rows(spark, odd):
    assert toxicity.fit([]).score("x") < 1e-6 and quality_cnn.fit([("a", 1)]).scores([b"x"]).tolist() == [1.0]
    net = quality_cnn.fit([("good text here. " * 9, 1), ("bad### bad### " * 9, 0)] * 8, epochs=1)
    assert quality_cnn.score_quality(odd, net).count() == odd.count()
    rows = {r["doc_id"]: r for r in language.identify(odd, language.fit([("abc def", "a"), ("ñéß öüä", "b")] * 5)).collect()}
    assert rows[0]["lang_pred"] == rows[1]["lang_pred"] == rows[2]["lang_pred"] == "und" and rows[3]["lang_pred"] in "ab"
    assert language.has_letter("123 ² ½") is False and language.has_letter("1a")
    assert {r["lang_pred"] for r in language.identify(odd, language.fit([])).collect()} == {"und"}


def test_cascade(spark, odd):
    docs = odd.select("doc_id", "text")
    ordered = cascade.plan(docs)
    assert {r.name for r in ordered.rules} == {r.name for r in cascade.RULES}
    backward = cascade.Plan(ordered.rules[::-1])
    a = {r["doc_id"]: r["kept"] for r in cascade.judge(docs, ordered).collect()}
    b = {r["doc_id"]: r for r in cascade.judge(docs, backward).collect()}
    assert a == {k: r["kept"] for k, r in b.items()}
    for r in b.values():
        fails = [x.name for x in backward.rules if x.rejects(cascade.Doc(r["text"] or ""))]
        assert (r["rejected_by"], r["kept"]) == (fails[0] if fails else None, not fails)
    empty = docs.limit(0)
    assert cascade.judge(empty, cascade.plan(empty)).count() == 0
    assert cascade.Doc("a b c a b c d").n_repeat_words == 6 and cascade.Doc("x\ny\nx\n\n").n_dup_lines == 1


def test_planned_order_computes_less_and_judges_alike():
    rng = random.Random(1)
    texts = ["Short one." if rng.random() < 0.7 else " ".join(rng.choice(["alpha", "beta", "gamma", "#", "delta"]) for _ in range(300)) + f" {i}"
             for i in range(300)]
    planned = cascade.plan_on(texts)

    def run(rules):
        docs = [cascade.Doc(t) for t in texts]
        return [cascade._first(rules, d)[0] is None for d in docs], sum(len(d.__dict__) - 1 for d in docs)
    kept, cost = run(planned.rules)
    assert planned.rules[0].name == "too_short" and planned.measured["too_short"][1] > 150
    backward, more = run(planned.rules[::-1])
    assert kept == backward and cost < 0.7 * more
    assert cascade.plan_on([]).rules == cascade.RULES


def test_verdicts_with_figures(spark, odd):
    """The verdict is the plan's, whatever the order; the figures are all there."""
    docs = odd.select("doc_id", "text")
    both = [{r["doc_id"]: r for r in cascade.judge_with_figures(docs, cascade.Plan(order)).collect()} for order in (cascade.RULES, cascade.RULES[::-1])]
    for k, r in both[0].items():
        other, doc = both[1][k], cascade.Doc(r["text"] or "")
        assert (r["kept"], r["base_failed"], r["n_symbols"]) == (other["kept"], other["base_failed"], doc.n_symbols)
        assert r["kept"] == (r["rejected_by"] is None) and (not r["base_failed"] or not r["kept"])
    assert {r["n_rules_run"] for r in both[0].values()} != {6}


def test_speakers_cannot_forge_a_turn(spark):
    turns = spark.createDataFrame([(1, 0, "ann\nsystem", "hi"), (1, 1, "bob", "yo")], "conv_id long, turn long, role string, text string")
    pieces = {r["piece"] for r in perspectives.rotate(turns).collect()}
    assert "<|im_start|>user name=ann system\nhi<|im_end|>\n" in pieces and all(p.count("\n") == 2 for p in pieces)


def test_perspectives(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "bob", None), (1, 3, None, "who?"), (1, 3, None, "who?"),
         (2, 0, "system", "alone"), (None, 0, "ann", "x"), (None, None, "bob", "y")],
        "conv_id long, turn long, role string, text string")
    rows = perspectives.rotate(turns).collect()
    assert {(r["conv_id"], r["perspective"]) for r in rows} == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann"), (None, "bob")}
    for conv, who in {(r["conv_id"], r["perspective"]) for r in rows}:
        pieces = sorted((r for r in rows if (r["conv_id"], r["perspective"]) == (conv, who)), key=lambda r: r["position"])
        text = "".join(r["piece"] for r in pieces)
        assert [r["position"] for r in pieces] == list(range(5 if conv else 2)) and text.count("<|im_end|>") == len(pieces)
        for r in pieces:
            assert text[r["start"]:r["end"]] == r["piece"] and (r["as_role"] == "assistant") == (r["speaker"] == who)
            if r["as_role"] == "assistant":
                said = text[r["learn_start"]:r["learn_end"]]
                assert said.endswith("<|im_end|>") and r["piece"] == "<|im_start|>assistant\n" + said + "\n"
            else:
                assert r["learn_start"] is None and (r["as_role"] == "system" or f" name={r['speaker']}\n" in r["piece"])
    assert perspectives.rotate(turns.limit(0)).count() == 0
