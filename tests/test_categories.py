import random
import re
import time

import pytest
from pyspark.sql import functions as F

from siteroster.functions import categories as G
from siteroster.functions import fixed_values as V
from siteroster.operators import categorize as K

MAILS = ["sales@x.com", "SALES.order.shop@x.com", "sugar@x.com", "recruit@x.com", "nobody@x.com", "vp.sales@x.com", "accountspayable@x.com",
         "commerce.order.shop.store@x.com", "info@x.com", "support-help@x.com", "it.dev@x.com", "hr@x.com"]
CONTEXTS = ["", "Sales pricing quote buy order, deals offer purchase at shop store commerce", "Jobs careers hiring talent", None, "hr it pr"]


def plain_roles(mail, context, threshold=0.5):
    mail, out = mail.lower(), []
    for n, (name, words) in enumerate(V.ROLE_KEYWORDS.items()):
        score, found = 0.0, []
        hits = [(p, 0.8) for p in V.ROLE_PATTERNS[name] if p in mail] + [(w, 0.3) for w in words if w in mail.split("@")[0]]
        hits += [(w, 0.1) for w in words if context and w in context.lower()]
        for token, weight in hits:
            score += weight
            if token not in found:
                found.append(token)
        if min(score, 1.0) >= threshold:
            out.append((-min(score, 1.0), n, name, found))
    return [(name, -neg, found) for neg, _, name, found in sorted(out)]


def test_roles_agree_with_plain_scoring(spark):
    pairs = [(m, c) for m in MAILS for c in CONTEXTS]
    df = spark.createDataFrame(pairs, "m string, c string")
    for threshold in (0.1, 0.5, 0.8, 0.9, 1.0):
        for r in df.select("m", "c", G.role_categories("m", "c", threshold).alias("r")).collect():
            assert [(x.category, x.confidence, x.keywords) for x in r.r] == plain_roles(r.m, r.c, threshold), (r.m, r.c, threshold)


def test_role_options_and_labels(evaluate):
    assert evaluate(["sugar@x.com"], lambda v: G.primary_category(G.role_categories(v))) == ["finance"]
    assert evaluate(["sugar@x.com"], lambda v: G.primary_category(G.role_categories(v, anchored=True))) == [None]
    assert evaluate(["sales@x.com", "zz@x.com"], lambda v: G.contact_person(G.role_categories(v))) == ["Sales representative", "General contact"]
    own = {"vip": ["gold"]}
    assert evaluate(["gold.gold@x.com"], lambda v: G.role_categories(v, threshold=0.3, keywords=own, patterns={"vip": ["gold@"]}))[0][0].confidence == 1.0


def test_batch_distribution_and_filter(spark):
    df = spark.createDataFrame([(m,) for m in ["sales@x.com", "sales@y.com", "info@x.com", "zz@x.com"]], "email string")
    assert {r.email: len(r.categories) for r in K.batch_categorize(df).collect()}["zz@x.com"] == 0
    assert {r.category: r.emails for r in K.category_distribution(df).collect()} == {"sales": 2, "general": 1}
    assert {r.email for r in K.filter_by_category(df, ["general", "hr"], 0).collect()} == {"info@x.com"}
    assert K.rules_table(spark).filter("family = 'role' AND kind = 'pattern'").count() == sum(map(len, V.ROLE_PATTERNS.values()))


def test_site_types(spark):
    text = "a" * 4990 + " software tool platform app cloud service"
    rows = spark.createDataFrame([("myshop.edu", "training school academy"), ("x.org", text), ("plain.com", None), ("plain.com", "x " * 2600 + "shop")],
                                 "d string, t string").select(G.site_categories("d", "t").alias("c")).collect()
    assert [[(c.category, c.confidence) for c in r.c] for r in rows] == [
        [("education", 0.5 + min(3 * 0.1, 0.5)), ("ecommerce", 0.5)], [("nonprofit", 0.5)], [], []]


def test_business_type_agrees_with_plain_counts(spark, evaluate):
    texts = ["health club and health", "Health Club, it services!", "bread bread hotel", "e-commerce cart", "group inc hotel hotel hotel hotel",
             "caf\xe9 inn \xe9inn inn\xe9 real  estate", "real estate steel plant plant", "", None, "nothing here", "hotel bread", "innkeeper apps"]

    def plain(text):
        best, label = 0, "unknown"
        for name, words in V.BUSINESS_KEYWORDS.items():
            score = sum(len(re.findall(rf"\b{re.escape(w)}\b", (text or "").lower())) for w in words) * (3 if name in V.HEAVY_BUSINESS else 1)
            if score > best:
                best, label = score, name
        return label
    assert evaluate(texts, G.business_type) == [plain(t) for t in texts]
    pages = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(
        F.concat_ws(" ", "text", F.element_at(F.array(*[F.lit(t or "") for t in texts]), (F.col("doc_id") % 12 + 1).cast("int"))).alias("t"))
    assert all(r.b == plain(r.t) for r in pages.select("t", G.business_type("t").alias("b")).collect())


def test_rules_from_a_table(spark):
    """A thousand rules of a user, in one block and in many, against a look at every rule; the built-in ones as before."""
    rng = random.Random(6)
    letters = "abAB é_1"
    tokens = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5]))) for _ in range(1000)] + ["", None, "Ab", "Ab"]
    texts = ["".join(rng.choice(letters + "xyz") for _ in range(rng.choice([0, 5, 60]))) for _ in range(60)] + [None, "", "AB ab"]
    rules = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "rule int, token string")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")

    def bare(text, word):
        return re.search(rf"(?<!\w){re.escape(word)}(?!\w)", text) is not None
    for whole in (False, True):
        expected = sorted((i, j) for i, t in enumerate(texts) for j, w in enumerate(tokens)
                          if t and w and (bare(t.lower(), w.lower()) if whole else w.lower() in t.lower()))
        for size in (1 << 20, 20_000):
            got = K.match_rules(rows, ["id"], "text", rules, whole_words=whole, block_bytes=size).collect()
            assert sorted((r.id, r.rule) for r in got) == expected
    assert K.match_rules(rows, ["id"], "text", rules.limit(0)).collect() == []
    with pytest.raises(ValueError):
        K.match_rules(rows, ["id"], "text", rules.withColumnRenamed("rule", "id"))
    long = spark.createDataFrame([(1, "ab " * 400_000)], "id int, text string")
    begin = time.monotonic()
    assert K.match_rules(long, ["id"], "text", rules).count() > 0 and time.monotonic() - begin < 20
