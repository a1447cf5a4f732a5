"""Operators between texts, and the pipeline, against brute force."""

import hashlib
import random
import resource
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siteroster.llm import decontaminate, jaccard, substrings
from siteroster.llm.components import components
from siteroster.llm.queries import QUERIES
from siteroster.llm.sift import sift
from tests.conftest import DATA


def words(text):
    return (text or "").encode().split()


def removed(rows):
    """Kept words of each row, by looking at every window."""
    first = {}
    for d, t in rows:
        for s in range(len(words(t)) - 49 if d is not None else 0):
            key = tuple(words(t)[s:s + 50])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - 49 if d is not None else 0):
            if first[tuple(w[s:s + 50])] < d:
                gone[s:s + 50] = True
        out.append((d, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def digest(rows):
    return sorted(((d, n, k, hashlib.sha256(x).hexdigest()) for d, n, k, x in removed(rows)), key=repr)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def classes(rows):
    sets = {d: shingles(t) for d, t in rows if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    where = defaultdict(list)
    for d in sorted(sets):
        for e, k in Counter(e for s in sets[d] for e in where[s]).items():
            if 100 * k >= 80 * (len(sets[d]) + len(sets[e]) - k):
                a, b = sorted((find(d), find(e)))
                root[b] = a
        for s in sets[d]:
            where[s].append(d)
    return sorted(((d, len(shingles(t)), None if d is None else find(d)) for d, t in rows), key=repr)


def tuples(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_repeats_against_every_window(spark, seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdef") * rng.choice([1, 2]) for _ in range(400)] for _ in range(4)]
    rows = []
    for i in range(60):
        x = rng.randrange(340)
        w = rng.choice(base)[x:x + rng.randrange(30, 120)] + [f"u{rng.randrange(999)}" for _ in range(rng.randrange(30))]
        w += rng.choice(base)[x:x + 55]
        rows.append((rng.choice([i, i, i, i - 100, None]), " ".join(w + w if rng.random() < .3 else w)))
    rows = list({d: (d, t) for d, t in rows if d is not None}.values()) + [r for r in rows if r[0] is None]
    rows += [(500, None), (501, ""), (502, "the " * 3000), (503, "the " * 300), rows[7], rows[7]]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, spans string")
    assert tuples(substrings.removal_digest(df)) == digest(rows)
    cut = substrings.without_repeats(df)
    assert cut.columns == df.columns
    expected = sorted(((d, x.decode() if k else t, "x") for (d, t), (_, _, k, x) in zip(rows, removed(rows))), key=repr)
    assert tuples(cut) == expected


def test_a_line_repeated_in_many_documents_is_one_row_a_document(spark):
    """The rows that meet the classes do not grow with the times that each document repeats a line."""
    rng = random.Random(5)
    line = " ".join(f"w{i}" for i in range(11))
    for times in (20, 200):
        rows = [(d, f"a{d} b{d} " + " ".join([line] * (times + d)) + f" z{d}") for d in range(8)]
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        seeds = [s for b in substrings._seed(iter([df.selectExpr("doc_id", "doc_id AS version", "text").toArrow().to_batches()[0]]))
                 for s in b.to_pylist()]
        assert len(seeds) < 8 * 8
        assert sum(1 + len(s["more"] or []) for s in seeds) == sum(len(substrings.anchored_runs([t])["start"]) for _, t in rows)
        assert tuples(substrings.removal_digest(df)) == digest(rows)


def test_repeats_on_given_rows(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    assert tuples(QUERIES["op4_substring_dedup"](spark, f"{DATA}/sf0.001")) == digest([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert substrings.removal_digest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_links_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") * rng.choice([1, 2, 3]) for _ in range(60)] for _ in range(5)]
    rows = []
    for i in range(300):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"u{rng.randrange(9)}"
        w = w[:rng.randrange(8)] if rng.random() < .2 else w[::-1] if rng.random() < .1 else w
        rows.append((i * 3 - 50, " ".join(w)))
    rows += [(10 ** 12, None), (10 ** 12 + 1, ""), rows[7], rows[7], (None, rows[3][1]), (None, None)]
    df = spark.createDataFrame([(t, d, 5) for d, t in rows], "text string, doc_id long, n int")
    assert tuples(jaccard.linked_components(df)) == classes(rows)


def test_fragments_cut_the_global_order():
    """Every fragment's shingles stand before the next one's in the order that ranks them, for every set alike."""
    rng = np.random.default_rng(2)
    classes = np.where(rng.random(jaccard.COUNTERS) < 0.1, rng.integers(1, 9, jaccard.COUNTERS), 0).astype(np.uint8)
    ends = []
    for n in (0, 1, 50, 5000):
        shingles = np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False))
        parts = jaccard.fragments_of(shingles, classes)
        ranks = [jaccard._ordered(p, classes) for p in parts]
        assert len(parts) == jaccard.FRAGMENTS and sorted(np.concatenate(parts).tolist()) == shingles.tolist()
        assert all((np.diff(p.astype(object)) > 0).all() for p in parts)
        ends.append([(r[0], r[-1]) if len(r) else None for r in ranks])
    for i in range(jaccard.FRAGMENTS - 1):
        assert max(e[i][1] for e in ends if e[i]) < min(e[i + 1][0] for e in ends if e[i + 1])


def test_links_on_given_rows(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert tuples(QUERIES["op9_jaccard_join"](spark, f"{DATA}/sf0.01")) == classes(rows)
    assert jaccard.linked_components(docs.limit(0)).count() == 0


def test_large_family_of_near_copies(spark):
    """Every copy differs from the others, many are linked by way of others only, and some not at all."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(80)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert tuples(jaccard.linked_components(df)) == classes(rows)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(60)] + [(7, 7), (3, 4)]
    got = dict(components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}


def fewest_edits(passage, text):
    row = np.arange(len(passage) + 1)
    best = row[-1]
    for c in text:
        diagonal, row = row, row.copy()
        row[0] = 0
        row[1:] = np.minimum(diagonal[:-1] + (np.frombuffer(passage, np.uint8) != c), diagonal[1:] + 1)
        row = np.minimum.accumulate(row - np.arange(len(row))) + np.arange(len(row))
        best = min(best, row[-1])
    return int(best)


def test_passages_against_full_alignment(spark):
    rng = random.Random(4)
    syllables = ["tion", "th", "er", "an", "in", "ou", "es ", "re ", "ha, ", "nd. "]

    def prose(n):
        return "".join(rng.choice(syllables) for _ in range(n))

    def edited(text, n):
        t = list(text)
        for _ in range(n):
            at = rng.randrange(len(t))
            t[at:at + rng.choice([0, 1])] = [rng.choice("abcxyz")] * rng.choice([0, 1])
        return "".join(t)
    items = [(i, prose(rng.choice([10, 30, 50, 90]))) for i in range(12)] + [(98, "too short"), (99, None), (None, prose(60))]
    docs = [(0, None), (1, ""), (2, prose(4000))]
    for i in range(60):
        text = rng.choice(items)[1] or prose(30)
        text = edited(text, rng.randrange(1 + len(text) // 8))
        docs.append((3 + i, prose(rng.randrange(60)) + rng.choice([text, text.upper(), text.replace(" ", " \n")]) + prose(rng.randrange(60))))
    docs += [docs[5], docs[5]]
    found = decontaminate.find_passages(spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, start int"),
                                        spark.createDataFrame(items, "item_id long, text string"))
    got = Counter((r["doc_id"], r["item_id"], r["item_start"]) for r in found.collect())
    index = decontaminate.Index([x for x in items if x[1]], decontaminate.Settings())
    hits = {(d, index.items[p], index.starts[p]) for d, t in docs for p in range(len(index.texts))
            if fewest_edits(index.texts[p].tobytes(), decontaminate.plain((t or "").encode())[0].tobytes()) <= index.budget[p]}
    assert set(got) == hits and len(hits) > 40
    again = Counter(d for d, _ in docs)
    assert all(n % again[k[0]] == 0 for k, n in got.items())
    by_doc = dict(docs)
    for r in found.collect():
        part = decontaminate.plain(by_doc[r["doc_id"]].encode()[r["start"]:r["end"]])[0].tobytes()
        whole = decontaminate.plain(dict(items)[r["item_id"]].encode())[0].tobytes()
        # cut out of its text, a part loses the space at either end
        assert 0 <= fewest_edits(whole[r["item_start"]:r["item_end"]], part) - r["edits"] <= 2


def test_documents_without_passages(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    bench = spark.read.parquet(f"{DATA}/sf0.01/benchmark.parquet")
    bad = {r["doc_id"] for r in QUERIES["op1_decontamination"](spark, f"{DATA}/sf0.01").collect()}
    items = [b.lower() for (b,) in bench.select("text").collect()]
    exact = {d for d, t in docs.select("doc_id", F.lower("text")).collect() if any(b in t for b in items)}
    kept = decontaminate.without_passages(docs, bench)
    assert exact <= bad and kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - bad
    assert decontaminate.without_passages(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.find_passages(docs, bench.limit(0)).count() == 0 == decontaminate.find_passages(docs.limit(0), bench).count()


def test_each_benchmark_has_its_own_answer(spark):
    """One frame searched for two benchmarks, in both orders."""
    one, two = ("the quick brown fox jumps over the lazy dog and runs far away", "seven grey owls were sitting on a fence in the cold morning rain")
    docs = spark.createDataFrame([(1, f"intro {one} end"), (2, f"intro {two} end"), (3, "nothing here")], "doc_id long, text string")
    benches = {k: spark.createDataFrame([(10 * k, t)], "item_id long, text string") for k, t in ((1, one), (2, two))}
    for order in ((1, 2), (2, 1)):
        for k in order:
            assert [(r["doc_id"], r["item_id"]) for r in decontaminate.find_passages(docs, benches[k]).collect()] == [(k, 10 * k)]
            assert {r["doc_id"] for r in decontaminate.without_passages(docs, benches[k]).collect()} == {1, 2, 3} - {k}
    both = benches[1].unionByName(benches[2])
    assert {r["doc_id"] for r in decontaminate.without_passages(docs, both).collect()} == {3}


def test_short_items_are_found_exactly(spark):
    items = [(1, "What is it?"), (2, "blue whale"), (3, "yes"), (4, "no"), (5, "")]
    docs = [(1, "He asked: WHAT -- is it, then"), (2, "what is itching"), (3, "a blue whales"), (4, "Blue\nwhale"), (5, "Yes!"), (6, "yes or no"), (7, "whatis it"),
            (8, "the blue whale, a blue whale")]
    found = decontaminate.find_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string"))
    rows = sorted((r["doc_id"], r["item_id"], dict(docs)[r["doc_id"]][r["start"]:r["end"]], r["edits"]) for r in found.collect())
    assert rows == [(1, 1, "WHAT -- is it", 0), (4, 2, "Blue\nwhale", 0), (5, 3, "Yes", 0), (8, 2, "blue whale", 0), (8, 2, "blue whale", 0)]


def test_long_texts_and_many_blocks(monkeypatch):
    """Pieces and blocks change nothing, and a long text needs little memory."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    items = [(i, " ".join(rng.choices(words, k=40))) for i in range(30)]
    text = " ".join(rng.choices(words, k=20000))
    for i, (_, t) in enumerate(items):
        at = 4500 * i + rng.randrange(3000)
        text = text[:at] + " " + t + " \n .. " * rng.randrange(4) + text[at:]
    index = decontaminate.Index(items, decontaminate.Settings())
    whole = list(decontaminate.search(index, [text, None, text[:3000]]))
    monkeypatch.setattr(decontaminate, "PIECE", 700)
    assert list(decontaminate.search(index, [text, None, text[:3000]])) == whole
    assert {h[1] for h in whole} == set(range(30))
    monkeypatch.undo()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert {h[1] for h in decontaminate.search(index, [text * 200])} == set(range(30))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


def test_clashing_columns_and_other_ids(spark):
    text = " ".join(f"w{i}" for i in range(70))
    docs = spark.createDataFrame([(1, text, 5, "a", "b", "c"), (2, text, 6, "d", "e", "f")],
                                 "doc_id int, text string, _id int, _version string, _spans string, _dropped string")
    assert [tuple(r) for r in jaccard.one_per_component(docs).collect()] == [(1, text, 5, "a", "b", "c")]
    assert tuples(substrings.without_repeats(docs)) == [(1, text, 5, "a", "b", "c"), (2, "", 6, "d", "e", "f")]
    for run in (jaccard.linked_components, substrings.repeats):
        with pytest.raises(TypeError):
            run(docs.withColumn("doc_id", docs["text"]))


def test_pipeline_stage_by_stage(spark):
    folder = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [[tuple(r) for r in docs.collect()]]
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema)
        seen.append([tuple(r) for r in docs.collect()])
        if name != "token_ids":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    begin, good, single, cut, clean, coded = seen
    assert set(good) < set(begin) and len(good) > 0.7 * len(begin)
    firsts = {c for _, _, c in classes([r[:2] for r in good])}
    assert sorted(single) == sorted(r for r in good if r[0] in firsts)
    texts = {d: x.decode() for d, _, k, x in removed([r[:2] for r in single]) if k}
    assert sorted(cut) == sorted((d, texts.get(d, t), *r, len(texts.get(d, t))) for d, t, *r, _ in single)
    assert set(clean) <= set(cut) and {r[0] for r in coded} == {r[0] for r in clean}
    assert sorted(tuples(corpus_pipeline.run(spark, folder))) == sorted(coded)


def test_sift_keeps_all_that_is_wanted_and_little_else(spark):
    rows = spark.range(20000).selectExpr("CASE WHEN id % 1000 = 7 THEN NULL ELSE id - 10000 END AS k", "id AS text")
    wanted = spark.range(0, 20000, 40).selectExpr("id - 10000 AS w").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS w"))
    kept = [r.k for r in sift(rows, "k", wanted, "w").collect()]
    expected = {i - 10000 for i in range(0, 20000, 40)}
    assert expected <= set(kept) and None not in kept and len(kept) == len(set(kept)) < 4 * len(expected)
    assert sift(rows, "k", wanted.limit(0), "w").count() == 0
