"""Registered queries: contacts and categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteroster.functions import categories as G
from siteroster.functions import contacts as C
from siteroster.functions import html as H
from siteroster.operators import categorize as K
from siteroster.operators import contacts as E
from siteroster.operators import tables as O
from siteroster.operators.report import NETWORKS
from siteroster.operators.rows import once, spread, unnest
from siteroster.plans import check_sql as Q
from siteroster.plans.derived import ADDRESSES, derive, table_sql
from siteroster.plans.page_queries import ALL_PAGES, all_pages
from siteroster.plans.registry import query
from siteroster.sources.readers import read_table

_CLEAN = f"clean AS (SELECT doc_id, {Q.deobfuscate('text')} AS t FROM documents)"
_MATCHES = (f"matches AS (SELECT doc_id, pos - 1 AS pos, lower(m) AS email FROM (SELECT doc_id, unnest(l) AS m, generate_subscripts(l, 1) AS pos "
            f"FROM (SELECT doc_id, {Q.email_matches('t')} AS l FROM clean)))")
def page_clean(source: str) -> str:
    """CTEs ending in ``pc`` (page_id, url, html, t, c) of good pages: visible text and its de-obfuscated form."""
    return (f"p AS (SELECT page_id, url, html, {Q.page_text('html')} AS t FROM {source} WHERE status_code = 200 AND html <> ''), "
            f"pc AS MATERIALIZED (SELECT page_id, url, html, t, {Q.deobfuscate('t')} AS c FROM p)")


_PAGE_CLEAN = page_clean(ALL_PAGES)


#: Texts cost less per row than pages and more to move, so that their tasks are larger.
DOCUMENTS_A_TASK = 8192


def documents(spark, sf):
    return spread(read_table(spark, sf, "documents").select("doc_id", "text"), DOCUMENTS_A_TASK)


def match_rows(spark, sf):
    """(doc_id, pos, email) of every address match in the documents."""
    hits = F.transform(C.email_matches(C.deobfuscate("text")), lambda m: F.lower(m))
    return unnest(documents(spark, sf), ["doc_id"], hits, "email")


@query("deobfuscate", f"WITH {_CLEAN} SELECT doc_id, t AS text FROM clean")
def deobfuscate(spark, sf):
    return documents(spark, sf).select("doc_id", C.deobfuscate("text").alias("text"))


@query("email_match", f"WITH {_CLEAN}, {_MATCHES} SELECT doc_id, pos, email FROM matches", ints="pos")
def email_match(spark, sf):
    return match_rows(spark, sf)


@query("email_split", f"WITH {_CLEAN}, {_MATCHES} SELECT doc_id, pos, {Q.username('email')} AS username, {Q.domain('email')} AS domain FROM matches", ints="pos")
def email_split(spark, sf):
    return match_rows(spark, sf).select("doc_id", "pos", C.email_username("email").alias("username"), C.email_domain("email").alias("domain"))


_ADDR = f"({table_sql(ADDRESSES)})"
_LISTED = (f"SELECT id, email FROM {_ADDR} UNION ALL SELECT id, 'logo' || id || '@image.' || (['png', 'js', 'com', 'iso'])[1 + id % 4] FROM {_ADDR} "
           f"UNION ALL SELECT id, 'you@' || (['example', 'site', 'real', 'mail.example'])[1 + id % 4] || '.com' FROM {_ADDR}")


def _listed(spark, sf):
    addresses = derive(spark, sf, ADDRESSES).select("id", "email")
    at = (F.col("id") % 4).cast("int")
    kinds = F.get(F.array(*[F.lit(x) for x in ("png", "js", "com", "iso")]), at)
    sites = F.get(F.array(*[F.lit(x) for x in ("example", "site", "real", "mail.example")]), at)
    made = F.explode(F.array("email", F.concat(F.lit("logo"), F.col("id").cast("string"), F.lit("@image."), kinds),
                             F.concat(F.lit("you@"), sites, F.lit(".com"))))
    return addresses.select("id", made.alias("email"))


@query("email_junk", f"SELECT id, email, {Q.junk('email')} AS junk FROM ({_LISTED})")
def email_junk(spark, sf):
    return _listed(spark, sf).withColumn("junk", C.is_junk_email("email"))


@query("email_confidence", f"SELECT id, email, {Q.confidence('email')} AS confidence FROM ({_LISTED})")
def email_confidence(spark, sf):
    return _listed(spark, sf).withColumn("confidence", C.email_confidence("email"))


_DOC_HITS = f"WITH {_CLEAN}, {Q.email_ctes('clean', 'doc_id', 't')}"


def document_emails(spark, sf, min_confidence=0.0):
    found = documents(spark, sf).select("doc_id", C.email_hits(C.deobfuscate("text"), min_confidence).alias("emails"))
    return E.email_rows(found, ["doc_id"])


@query("email_context", f"{_DOC_HITS} SELECT doc_id, pos, email, left(context, 100) AS context FROM hits", ints="pos")
def email_context(spark, sf):
    return document_emails(spark, sf).select("doc_id", "pos", "email", F.left("context", F.lit(100)).alias("context"))


@query("email_dedup", f"WITH {_CLEAN}, {_MATCHES} SELECT doc_id, email, min(pos) AS pos FROM matches WHERE NOT {Q.junk('email')} GROUP BY 1, 2", ints="pos")
def email_dedup(spark, sf):
    return document_emails(spark, sf).select("doc_id", "email", "pos")


@query("email_min_conf", f"SELECT id, email FROM ({_LISTED}) WHERE {Q.confidence('email')} >= 0.7::DOUBLE")
def email_min_conf(spark, sf):
    return _listed(spark, sf).filter(C.email_confidence("email") >= 0.7)


@query("fmt_detailed", f"""{_DOC_HITS} SELECT row_number() OVER (ORDER BY doc_id, pos) AS "index", email, username, domain,
    round(confidence, 2) AS confidence_score, true AS is_valid, left(context, 100) AS context FROM hits""")
def fmt_detailed(spark, sf):
    return O.detailed_format(document_emails(spark, sf), ["doc_id", "pos"], with_time=False)


@query("email_mailto", f"""WITH src AS (SELECT page_id, html FROM {ALL_PAGES})
    SELECT page_id, min(pos) - 1 AS pos, email FROM ({Q.mailto_rows('src', 'page_id', 'html')}) GROUP BY page_id, email""", ints="pos")
def email_mailto(spark, sf):
    hits = C.first_of_each(C.mailto_hits("html"))
    return unnest(all_pages(spark, sf), ["page_id"], hits, "h", "_p").select("page_id", "h.pos", "h.email")


@query("phone_extract", f"""WITH {_CLEAN}, {Q.phone_ctes('clean', 'doc_id', 't')} SELECT doc_id, pos, phone FROM phone_rows""", ints="pos")
def phone_extract(spark, sf):
    return unnest(documents(spark, sf), ["doc_id"], C.phone_numbers(C.deobfuscate("text")), "phone")


@query("social_links", f"WITH src AS (SELECT page_id, html FROM {ALL_PAGES}) SELECT page_id, " + ", ".join(
    f"{Q.social('html', n)} AS {n}" for n in NETWORKS) + " FROM src")
def social_links(spark, sf):
    return all_pages(spark, sf).select("page_id", C.social_links(F.lit(""), "html").alias("s")).select("page_id", "s.*")


@query("email_valid", f"SELECT id, email, regexp_matches(email, {Q.lit(C.SIMPLE_EMAIL)}) AS valid FROM (SELECT id, email FROM ({_LISTED}) UNION ALL "
                      f"SELECT id, replace(email, '@', '@@') FROM {_ADDR} UNION ALL SELECT id, email || '1' FROM {_ADDR})")
def email_valid(spark, sf):
    own = derive(spark, sf, ADDRESSES)
    broken = F.explode(F.array(F.replace("email", F.lit("@"), F.lit("@@")), F.concat("email", F.lit("1"))))
    return _listed(spark, sf).unionByName(own.select("id", broken.alias("email"))).withColumn("valid", C.is_valid_email("email"))


_DOMAINS = (f"SELECT id, {Q.domain('email')} AS domain FROM {_ADDR} UNION ALL SELECT id, '-bad' || id || '.com' FROM {_ADDR} "
            f"UNION ALL SELECT id, repeat('a', 55 + id % 20) || '.org' FROM {_ADDR} UNION ALL SELECT id, 'host' || id FROM {_ADDR}")


@query("domain_valid", f"SELECT id, domain, regexp_matches(domain, {Q.lit(C.DOMAIN_NAME)}) AS valid FROM ({_DOMAINS})")
def domain_valid(spark, sf):
    n = F.col("id").cast("string")
    made = F.explode(F.array(C.email_domain("email"), F.concat(F.lit("-bad"), n, F.lit(".com")),
                             F.concat(F.repeat(F.lit("a"), (55 + F.col("id") % 20).cast("int")), F.lit(".org")), F.concat(F.lit("host"), n)))
    return derive(spark, sf, ADDRESSES).select("id", made.alias("domain")).withColumn("valid", C.is_valid_domain("domain"))


@query("contacts_extract", f"""WITH {_PAGE_CLEAN}, {Q.contact_ctes('pc', 'page_id', 'c', 'html', 0.0)}, {Q.phone_ctes('pc', 'page_id', 'c')}
    SELECT pc.page_id, coalesce(mails, '') AS emails, coalesce(nums, '') AS phones, {', '.join(f"{Q.social('html', n)} AS {n}" for n in NETWORKS)}
    FROM pc LEFT JOIN (SELECT page_id, string_agg(email, ' ' ORDER BY pos) AS mails FROM found GROUP BY 1) f ON f.page_id = pc.page_id
    LEFT JOIN (SELECT page_id, string_agg(phone, '; ' ORDER BY pos) AS nums FROM phone_rows GROUP BY 1) n ON n.page_id = pc.page_id""")
def contacts_extract(spark, sf):
    texts = once(all_pages(spark, sf).filter("status_code = 200"), {"text": H.page_text("html")})
    found = E.extract_contacts(texts, "text", "html")
    return found.select("page_id", F.concat_ws(" ", F.transform("emails", lambda e: e["email"])).alias("emails"),
                        F.concat_ws("; ", "phone_numbers").alias("phones"), "social.*")


# --- categories --------------------------------------------------------------------------------

_ROLE = Q.role_rows(_ADDR, "id", "context")
_ROLE_PLAIN = Q.role_rows(_ADDR, "id", None)


def _addresses(spark, sf):
    return derive(spark, sf, ADDRESSES, costly=True)


@query("cat_email", f"SELECT id, rank, category, confidence, keywords FROM ({_ROLE})", ints="rank")
def cat_email(spark, sf):
    rows = K.category_rows(K.batch_categorize(_addresses(spark, sf), "email", "context"), ["id"])
    return rows.withColumn("keywords", F.concat_ws("|", "keywords"))


@query("cat_primary", f"SELECT a.id, category FROM {_ADDR} a LEFT JOIN (SELECT * FROM ({_ROLE}) WHERE rank = 1) r ON r.id = a.id")
def cat_primary(spark, sf):
    return _addresses(spark, sf).select("id", G.primary_category(G.role_categories("email", "context")).alias("category"))


@query("cat_batch", f"""SELECT a.id, coalesce(names, '') AS categories, coalesce(n, 0) AS n FROM {_ADDR} a LEFT JOIN (
    SELECT id, string_agg(category, ',' ORDER BY rank) AS names, count(*) AS n FROM ({_ROLE_PLAIN}) GROUP BY 1) r ON r.id = a.id""", ints="n")
def cat_batch(spark, sf):
    done = K.batch_categorize(_addresses(spark, sf))
    return done.select("id", F.concat_ws(",", F.transform("categories", lambda c: c["category"])).alias("categories"), F.size("categories").alias("n"))


@query("cat_distribution", f"SELECT category, count(*) AS emails FROM ({_ROLE_PLAIN}) WHERE rank = 1 GROUP BY 1")
def cat_distribution(spark, sf):
    return K.category_distribution(_addresses(spark, sf))


@query("cat_filter", f"SELECT DISTINCT id, email FROM ({_ROLE_PLAIN}) WHERE category IN ('sales', 'finance', 'general') AND confidence >= 0.8::DOUBLE")
def cat_filter(spark, sf):
    return K.filter_by_category(_addresses(spark, sf), ["sales", "finance", "general"], 0.8).select("id", "email")


@query("cat_person", f"""SELECT a.id, CASE category {' '.join(f"WHEN {Q.lit(k)} THEN {Q.lit(v)}" for k, v in G.ROLE_PERSON.items())} ELSE 'General contact' END AS person
    FROM {_ADDR} a LEFT JOIN (SELECT * FROM ({_ROLE_PLAIN}) WHERE rank = 1) r ON r.id = a.id""")
def cat_person(spark, sf):
    return _addresses(spark, sf).select("id", G.contact_person(G.role_categories("email")).alias("person"))


@query("cat_domain", f"""SELECT id, rank, category, confidence, keywords FROM ({Q.site_rows(f"(SELECT *, {Q.domain('email')} AS dom FROM {_ADDR})", 'id', 'dom', 'site_text')})""", ints="rank")
def cat_domain(spark, sf):
    found = _addresses(spark, sf).select("id", G.site_categories(C.email_domain("email"), "site_text").alias("categories"))
    return K.category_rows(found, ["id"]).withColumn("keywords", F.concat_ws("|", "keywords"))


@query("cat_domain_whole", f"""SELECT id, rank, category, confidence, keywords FROM ({Q.site_rows(
    f"(SELECT *, {Q.domain('email')} AS dom, repeat('- ', 3000) || site_text AS late FROM {_ADDR})", 'id', 'dom', 'late', chars=None)})""", ints="rank")
def cat_domain_whole(spark, sf):
    """Whole texts count, also what stands after their first 5000 characters."""
    late = F.concat(F.repeat(F.lit("- "), F.lit(3000)), "site_text")
    found = _addresses(spark, sf).select("id", G.site_categories(C.email_domain("email"), late, text_chars=None).alias("categories"))
    return K.category_rows(found, ["id"]).withColumn("keywords", F.concat_ws("|", "keywords"))


@query("business_type", f"""SELECT 'd' || doc_id AS id, {Q.business_label('text')} AS label FROM documents UNION ALL
    SELECT 'p' || page_id, {Q.business_label('t')} FROM (SELECT page_id, {Q.page_text('html')} AS t FROM {ALL_PAGES})""")
def business_type(spark, sf):
    texts = documents(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text").unionByName(
        all_pages(spark, sf).select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), H.page_text("html").alias("text")))
    return texts.select("id", G.business_type("text").alias("label"))


_RULE_VALUES = ", ".join("(" + ", ".join(Q.lit(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in G.rule_rows())


@query("cat_rules", f"""SELECT c_custkey, category, token FROM customer, (VALUES {_RULE_VALUES}) r(family, ord, category, kind, token)
    WHERE family = 'business' AND contains(lower(c_mktsegment), token)""")
def cat_rules(spark, sf):
    customers = read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    found = unnest(customers, ["c_custkey"], G.matched_rules("c_mktsegment", G.BUSINESS_KEYWORDS), "rule")
    return found.select("c_custkey", "rule.category", "rule.token")


@query("cat_rules_table", f"""SELECT id, family, ord, category, kind, token FROM ({table_sql(ADDRESSES)}), (VALUES {_RULE_VALUES}) r(family, ord, category, kind, token)
    WHERE contains(lower(site_text || ' ' || context || ' ' || email), token)""")
def cat_rules_table(spark, sf):
    """All built-in rules as a table, as a user's own rules would come."""
    texts = derive(spark, sf, ADDRESSES).select("id", F.concat_ws(" ", "site_text", "context", "email").alias("text"))
    return K.match_rules(texts, ["id"], "text", K.rules_table(spark))
