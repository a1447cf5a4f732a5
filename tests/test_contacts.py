import random
import re
import time

import pandas as pd
from pyspark.sql import functions as F

from siteroster.functions import contacts as C
from siteroster.functions import fixed_values as V
from siteroster.functions.text import SPACE
from siteroster.operators.contacts import extract_contacts
from tests.conftest import DATA

MAIL = re.compile(rf"\b{V.EMAIL_LOCAL}@{V.EMAIL_HOST}\b", re.I)
PHONE = re.compile(V.PHONE_PARTS.format(d=r"\d", s=r"\s"))


def plain_deobfuscate(text):
    for word, sign in (("at", "@"), ("dot", ".")):
        for spelled in (rf"\s*\[{word}\]\s*", rf"\s*\({word}\)\s*", rf"\s+{word}\s+"):
            text = re.sub(spelled, sign, text, flags=re.I)
    return text


def test_documents_agree_with_python(spark):
    texts = pd.read_parquet(f"{DATA}/sf0.01/documents.parquet", columns=["doc_id", "text"])
    df = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").withColumn("clean", C.deobfuscate("text"))
    rows = df.select("doc_id", "clean", C.email_matches("clean").alias("m"), C.email_hits("clean").alias("h"),
                     F.regexp_extract_all("clean", F.lit(C.PHONE), F.lit(0)).alias("p")).collect()
    expected = {i: plain_deobfuscate(t) for i, t in zip(texts["doc_id"], texts["text"])}
    assert len(rows) == len(expected)
    for row in rows:
        clean = expected[row.doc_id]
        assert row.clean == clean
        assert row.m == [m.group() for m in MAIL.finditer(clean)]
        assert row.p == [m.group() for m in PHONE.finditer(clean)]
        around = {}
        for m in MAIL.finditer(clean):
            piece = clean[max(0, m.start() - 30):m.end() + 30].replace("\n", " ").strip()
            around.setdefault(m.group().lower(), f"...{piece}...")
        assert {h.email: h.context for h in row.h} == around


def test_unicode_edges_agree_with_python(evaluate):
    texts = ["ñreen.09@mail.com", "a@b.comé", "x at y.com", "a\x1cat\x1cb.org", "é@x.com", "a_b@c.de_f", "K@x.com",
             "a@b.co,c@d.co;e@f.gh a.b@c.d.e.fg", "-z@y.xx..w@v.uu", "tel ٠١٢٣٤٥٦٧٨٩", "+1 (323) 555-9830 10.0.0.1 123456789012345678",
             "at  AT at\nat x [at] [AT](At) y (dot) [dot]com dot dot", "   [at]   ", ""]
    cleaned = evaluate(texts, C.deobfuscate)
    assert cleaned == [plain_deobfuscate(t) for t in texts]
    assert evaluate(cleaned, C.email_matches) == [[m.group() for m in MAIL.finditer(t)] for t in cleaned]
    phones = []
    for t in cleaned:
        kept = [m.group().strip() for m in PHONE.finditer(t)]
        phones.append(list(dict.fromkeys(p for p in kept if 8 <= len(re.sub(r"\D", "", p)) <= 15)))
    assert evaluate(cleaned, C.phone_numbers) == phones


def test_context_spans_neighbouring_addresses(evaluate):
    text = " ".join(f"a{i}@b.co" for i in range(40)) + " end"
    expected = [f"...{text[max(0, m.start() - 30):m.end() + 30].strip()}..." for m in MAIL.finditer(text)]
    assert evaluate([text], lambda v: F.transform(C.email_hits(v), lambda h: h["context"])) == [expected]


def test_confidence_and_junk(evaluate):
    mails = ["business@corp.com", "personal@gmail.com", "ab@x.org", "ab@mail.yahoo.com", "help@desk.com"]
    assert evaluate(mails, C.email_confidence) == [1.0, 1.0 - 0.3, 1.0 - 0.1, 1.0 - 0.3 - 0.1, 1.0]
    junk = ["a@example.com", "a@mail.example.com", "logo@image.png", "x@y.min.js", "a@test.com", "a@b.com,c@d.com"]
    assert evaluate(junk, C.is_junk_email) == [True, False, True, True, True, False]


def test_invalid_addresses_are_not_found(evaluate):
    assert evaluate(["user@localhost, 12345@domain, @missinguser.com, user@.com"], C.email_matches) == [[]]


def test_first_accepted_hit_stays(evaluate):
    text = "one test@test.com two Bo@corp.io three bo@corp.io"
    hits = evaluate([text], C.email_hits)[0]
    assert [(h.pos, h.email, h.username, h.domain) for h in hits] == [(1, "bo@corp.io", "bo", "corp.io")]
    assert "one" in hits[0].context and hits[0].confidence == 0.9
    assert len(evaluate([text], lambda v: C.email_hits(v, remove_duplicates=False))[0]) == 2
    assert evaluate([text], lambda v: C.email_hits(v, 0.95)) == [[]]


def test_many_repeats_of_one_address(evaluate):
    # one address holding a third of the hits of a large text
    text = " ".join("hot@corp.io" if i % 3 == 0 else f"u{i}@corp.io" for i in range(6000))
    hits = evaluate([text], C.email_hits)[0]
    assert len(hits) == 4001 and hits[0].email == "hot@corp.io" and [h.pos for h in hits] == sorted(h.pos for h in hits)


def test_mailto(evaluate):
    html = ('<a href="mailto: Desk@Corp.io?subject=x">m</a><a HREF="MAILTO:a@b.com,c@d.com">m</a><a href="mailto:nobody">m</a>'
            '<a href="mailto:x@example.com">m</a>')
    hits = evaluate([html], C.mailto_hits)[0]
    assert [(h.email, h.domain, h.confidence) for h in hits] == [
        ("desk@corp.io", "corp.io", 1.0), ("a@b.com,c@d.com", "b.com,c@d.com", 1.0)]


def test_mailto_skips_what_the_text_has(spark):
    df = spark.createDataFrame([("ab@gmail.com zed@corp.io", '<a href="mailto:zed@corp.io"><a href="mailto:low@gmail.com">')],
                               "text string, html string")
    row = extract_contacts(df, "text", "html", 0.9).first()
    assert [(e.pos, e.email, e.context[:9]) for e in row.emails] == [(0, "zed@corp.io", "...ab@gma"), (1, "low@gmail.com", "Extracted")]


def test_social_links(evaluate):
    html = ("see netflix.com/show and https://twitter.com/late www.facebook.com/me http://facebook.com/you "
            "HTTPS://instagram.com/x wa.me/123")
    row = evaluate([html], C.social_links)[0].asDict()
    assert row == {"facebook": "https://www.facebook.com/me", "twitter": "https://x.com/show", "linkedin": None,
                   "instagram": "https://HTTPS://instagram.com/x", "whatsapp": "https://wa.me/123"}
    strict = evaluate([html], lambda v: C.social_links(v, strict_hosts=True))[0]
    assert strict.twitter == "https://twitter.com/late"


PLAIN_PATTERNS = {C.PHONE: "(?U)" + V.PHONE_PARTS.format(d=r"\p{Nd}", s=SPACE[1:-1]), C.SOCIAL: rf"(?iu){V.SOCIAL_URL}"}


def test_first_characters_of_all_alphabets(evaluate):
    starts = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    for tail, pattern in (("1234-5678 ", C.PHONE), ("nstagram.com/a ", C.SOCIAL), ("acebook.com/b ", C.SOCIAL), (".com/c ", C.SOCIAL)):
        whole = "".join(s + tail for s in starts)
        now, before = (evaluate([whole], lambda v, p=p: F.regexp_extract_all(v, F.lit(p), F.lit(0)))[0] for p in (pattern, PLAIN_PATTERNS[pattern]))
        assert now == before and len(now) >= 2


def test_parts_are_tried_only_at_first_characters(evaluate):
    prose = "Many rooms and quiet gardens are open to guests, as before. " * 40000
    for pattern, plain in PLAIN_PATTERNS.items():
        took = {pattern: [], plain: []}
        for p in [pattern, plain] * 4:
            begin = time.time()
            assert evaluate([prose], lambda v, p=p: F.regexp_count(v, F.lit(p)) + F.regexp_count(v, F.lit(p + "(?:)"))) == [0]
            took[p].append(time.time() - begin)
        assert min(took[pattern]) < 0.9 * min(took[plain])


def test_plain_words_option(evaluate):
    assert evaluate(["visit us at acme.com"], C.deobfuscate) == ["visit us@acme.com"]
    assert evaluate(["visit us at acme.com"], lambda v: C.deobfuscate(v, plain_words=False)) == ["visit us at acme.com"]
    assert evaluate(["a<at>b{at}c"], C.deobfuscate) == ["a<at>b{at}c"]


def test_shape_checks(evaluate):
    assert evaluate(["a@b.co", "a@b", "@b.co", "a b@c.de", None], C.is_valid_email) == [True, False, False, False, False]
    names = ["a.com", "-a.com", "a-.com", "a" * 63 + ".com", "a" * 64 + ".com", "a.c1", "localhost", None]
    assert evaluate(names, C.is_valid_domain) == [True, False, False, True, False, False, False, False]


def test_addresses_are_those_of_the_plain_pattern(spark, evaluate):
    """One try per run of characters finds what a try at every place finds."""
    rng = random.Random(11)
    made = ["".join(rng.choice("ab1._%+-@@.é  ,\nK") for _ in range(rng.randrange(60))) for _ in range(4000)]
    made += ["éa@b.co", "é.a@b.co", "a@b.co%x@y.com", "a@b.coé.c@d.org", "_a@b.co", "._a@b.co x", "a@b@c.de", "a.b@c.de.f1", "a@b.c-d.ef_", ""]
    folder = f"{DATA}/sf0.01"
    texts = made + [r[0] for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect() if r[0]]

    def plain(t):
        return F.regexp_extract_all(t, F.lit(C.EMAIL), F.lit(0))
    assert evaluate(texts, lambda v: C.email_matches(v)) == evaluate(texts, plain)
    hits = evaluate(made, lambda v: F.transform(C._with_context(F.col(v)), lambda h: h["context"]))
    for text, found, contexts in zip(made, evaluate(made, plain), hits):
        at = 0
        for address, context in zip(found, contexts):
            at = text.index(address, at)
            around = text[max(0, at - 30):at] + address + text[at + len(address):at + len(address) + 30]
            at += len(address)
            assert context == "..." + around.replace("\n", " ").strip() + "..."
        assert len(found) == len(contexts)


def test_long_dotted_runs_take_no_square_of_time(evaluate):
    evaluate(["x a@b.co"], lambda v: F.struct(C.email_matches(v), F.size(C.email_hits(v))))
    begin = time.monotonic()
    page = "a." * 500000 + " x@y.com " + "b.c" * 1000 + "@" + "d." * 100000
    assert evaluate([page], C.email_matches) == [["x@y.com"]]
    assert evaluate([page], lambda v: F.size(C.email_hits(v))) == [1]
    assert time.monotonic() - begin < 15
