"""A query for each operator over the driver's tables or inline fixtures, and SQL that must give the same rows.

The tables have no annotations, so annotated and predicted spans are drawn from doc_id by arithmetic that both
sides share. German rules have no matches in the tables; fixtures with expected rows stand for them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import content_digest, log_reference
from .operators import detect, evaluate, grounding, mentions, ocr, policy, resolve, segments, validate
from .plans import deidentify
from .sources import annotations
from .streaming import cache, progress
from .types import OVERRIDE_DDL, SPAN_DDL

EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return resolve.resolved(detect.with_spans(docs, [detect.rules(["de.email.v1"])]))


#: Email spans of documents in DuckDB: gaps and matches alternate.
EMAIL_SQL = rf"""
e AS (SELECT doc_id, lang, text, string_split_regex(text, '{EMAIL}') AS gaps, regexp_extract_all(text, '{EMAIL}') AS hits FROM documents WHERE regexp_matches(text, '{EMAIL}')),
s AS (SELECT doc_id, lang, text, hits[i] AS hit, i,
  coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start_
  FROM e, unnest(range(1, len(hits) + 1)) AS u(i))"""


@query(f'WITH {EMAIL_SQL} SELECT doc_id, CAST(start_ AS BIGINT) AS "start", CAST(start_ + length(hit) AS BIGINT) AS "end", hit AS "text" FROM s')
def detect_email_spans(spark, sf_dir):
    found = emails(spark, sf_dir).select("doc_id", F.explode("spans").alias("s"))
    return found.select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), F.col("s.text").alias("text"))


@query(r"""SELECT page_id, hit AS "text", CAST(position(hit IN url) - 1 AS BIGINT) AS "start" FROM (SELECT page_id, url, unnest(regexp_extract_all(url, '(?i)https?://[^\s<>"'']+')) AS hit FROM pages)""")
def detect_url_spans(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("text"))
    found = detect.with_spans(pages, [detect.rules(["de.url.v1"])]).select("page_id", F.explode("spans").alias("s"))
    return found.select("page_id", F.col("s.text").alias("text"), F.col("s.start").cast("long").alias("start"))


URL_SQL = r"""regexp_extract_all(html, '(?i)\bhttps?://[^\s<>"'']+|\bwww\.[^\s<>"'']+')"""


@query(f"SELECT page_id, CAST(len({URL_SQL}) AS BIGINT) AS n, md5(array_to_string({URL_SQL}, '|')) AS digest FROM pages")
def detect_url_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    out = detect.with_spans(pages, [detect.rules(["de.url.v1"])])
    return out.select("page_id", F.size("spans").cast("long").alias("n"), F.md5(F.array_join(F.transform("spans", lambda s: s["text"]), "|").cast("binary")).alias("digest"))


@query(rf"SELECT page_id, CAST(len(regexp_extract_all(html, '{EMAIL}')) AS BIGINT) AS n FROM pages WHERE regexp_matches(html, '{EMAIL}')")
def detect_email_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    return detect.with_spans(pages, [detect.rules(["de.email.v1"])]).where(F.size("spans") > 0).select("page_id", F.size("spans").cast("long").alias("n"))


#: text, then the expected (rule, text) pairs.
RULE_CASES = [
    ("Schreiben Sie an a.b-c_9@labor.haus-am-see.org!", [("de.email.v1", "a.b-c_9@labor.haus-am-see.org")]),
    ("oder HTTP://akten.example/x?y=2#z, www.example.org.", [("de.url.v1", "HTTP://akten.example/x?y=2#z,"), ("de.url.v1", "www.example.org.")]),
    ("Konto DE89 3704 0044 0532 0130 00 bitte", [("de.iban.v1", "DE89 3704 0044 0532 0130 00")]),
    ("Tel.: 0351 458-0", [("de.phone.labelled.v1", "0351 458-0")]),
    ("mobil +49 351 4584711 abends", [("de.phone.labelled.v1", "+49 351 4584711"), ("de.phone.intl.v1", "+49 351 4584711")]),
    ("geb. 01.02.1980", [("de.dob.labelled.v1", "01.02.1980"), ("de.date.numeric.v1", "01.02.1980")]),
    ("am 2024-03-15 und am 3. März 2024", [("de.date.iso.v1", "2024-03-15"), ("de.date.written.v1", "3. März 2024")]),
    ("Pat.-Nr.: 4711-X, Fallnummer: 2024-004711, PAT-123456", [("de.id.labelled.v1", "4711-X"), ("de.id.labelled.v1", "2024-004711"), ("de.id.pattern.v1", "PAT-123456")]),
    ("Berliner Straße 12a, Hauptstr. 5", [("de.address.street.v1", "Berliner Straße 12a"), ("de.address.street.v1", "Hauptstr. 5")]),
    ("01307 Dresden-Neustadt\nPat", [("de.address.plz_city.v1", "01307 Dresden-Neustadt")]),
    ("Klinik und Poliklinik für Innere Medizin", [("de.org.department.v1", "Klinik und Poliklinik für Innere Medizin")]),
    ("Klinik für Viszeral-, Thorax- und Gefäßchirurgie", [("de.org.department.v1", "Klinik für Viszeral-, Thorax- und Gefäßchirurgie")]),
    ("Medizinische Klinik I", [("de.org.unit.v1", "Medizinische Klinik I")]),
    ("Sektion Rheumatologie, Station 4B, Haus 12", [("de.org.unit.v1", "Sektion Rheumatologie"), ("de.org.ward.v1", "Station 4B"), ("de.org.ward.v1", "Haus 12")]),
    ("Die Klinik hat Betten, in der Ambulanz Anfang Mai", []),
    ("Der Patient erhielt 500 mg Metamizol, Laborwert 123456.", []),
]


def _quoted(x) -> str:
    return "'" + str(x).replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    cell = lambda v: "NULL" if v is None else f"CAST({v} AS BIGINT)" if isinstance(v, int) else str(v) if isinstance(v, float) else _quoted(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names})"


@query(_values([(i, rule, text) for i, (_, found) in enumerate(RULE_CASES) for rule, text in found], "case_id, rule_id, found"))
def detect_rules_fixture(spark, sf_dir):
    cases = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(RULE_CASES)], "case_id long, text string")
    found = detect.with_spans(cases, [detect.rules()]).select("case_id", F.explode("spans").alias("s"))
    return found.select("case_id", F.col("s.metadata.rule_id").alias("rule_id"), F.col("s.text").alias("found"))


@query(_values([(3, 13, "Station B4"), (34, 44, "STATION b4"), (49, 59, "Westflügel")], '"start", "end", "text"'))
def detect_terms(spark, sf_dir):
    docs = spark.createDataFrame([("im Station B4, nicht Station B4x, STATION b4, im Westflügel",)], "text string")
    found = detect.with_spans(docs, [detect.terms(["Station B4", "Westflügel", " station b4 ", " "])]).select(F.explode("spans").alias("s"))
    return found.select(F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), "s.text")


@query("""SELECT doc_id, CAST(count(*) FILTER (good) AS BIGINT) AS n_valid, CAST(count(*) FILTER (NOT good) AS BIGINT) AS n_rejected FROM
  (SELECT doc_id, substring(text, 50 * i + 1, 4) = substring(text, 50 * i + 1 + CASE WHEN (doc_id + i) % 3 = 0 THEN 1 ELSE 0 END, 4) AS good
   FROM documents, unnest(range(0, length(text) // 50 + 1)) AS t(i)) GROUP BY doc_id""")
def validate_span_text(spark, sf_dir):
    """Four characters claimed at each fiftieth character of each text; a third of the claims have the text of the next character on."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", "text")
    said = lambda i: F.substring(F.col("text"), 50 * i + 1 + F.when((F.col("doc_id") + i) % 3 == 0, 1).otherwise(0), F.lit(4))
    claim = lambda i: F.struct((50 * i).cast("int").alias("start"), (50 * i + 4).cast("int").alias("end"), said(i).alias("text"), F.lit("OTHER_PII").alias("entity_type"), F.lit(0.5).alias("confidence"), F.lit("claimed").alias("detector"))
    claims = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 50).cast("int")), claim)
    out = detect.validated(docs.withColumn("spans", claims))
    return out.select("doc_id", F.size("spans").cast("long").alias("n_valid"), F.size("notices").cast("long").alias("n_rejected"))


def _drawn_spans(n: int = 10) -> Column:
    d = F.col("doc_id")
    one = lambda i: F.struct(((d * 31 + i * 17) % 97).cast("int").alias("start"), ((d * 31 + i * 17) % 97 + 5 + (d * 7 + i * 13) % 23).cast("int").alias("end"), F.lit("").alias("text"), F.concat(F.lit("T"), (i % 3).cast("string")).alias("entity_type"), (0.5 + (i % 4) / 10).cast("double").alias("confidence"), F.lit("drawn").alias("detector"), i.cast("int").alias("ordinal"), F.lit(None).cast(SPAN_DDL.split("metadata:")[1][:-1]).alias("metadata"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one).cast(f"array<{SPAN_DDL}>")


DRAWN = "(doc_id * 31 + i * 17) % 97"


@query(f"""WITH RECURSIVE r AS (SELECT doc_id, {DRAWN} AS a, {DRAWN} + 5 + (doc_id * 7 + i * 13) % 23 AS b, 'T' || (i % 3) AS kind, 5 + i % 4 AS tenths,
  row_number() OVER (PARTITION BY doc_id ORDER BY {DRAWN}, -(5 + (doc_id * 7 + i * 13) % 23), -(5 + i % 4), i) AS k FROM documents, range(0, 10) AS t(i)),
f AS (SELECT doc_id, k, a, b, kind, tenths, a AS la, b AS lb, kind AS lkind, true AS kept, '' AS reason FROM r WHERE k = 1
  UNION ALL SELECT r.doc_id, r.k, r.a, r.b, r.kind, r.tenths, CASE WHEN r.a >= f.lb THEN r.a ELSE f.la END, CASE WHEN r.a >= f.lb THEN r.b ELSE f.lb END, CASE WHEN r.a >= f.lb THEN r.kind ELSE f.lkind END, r.a >= f.lb,
    CASE WHEN r.a >= f.lb THEN '' WHEN r.a <> f.la OR r.b <> f.lb THEN '{resolve.OVERLAP}' WHEN r.kind = f.lkind THEN '{resolve.MERGED}' ELSE '{resolve.SURER}' END FROM f JOIN r ON r.doc_id = f.doc_id AND r.k = f.k + 1)
SELECT doc_id, string_agg(CASE WHEN kept THEN a || '-' || b || kind || ':' || tenths END, ',' ORDER BY k) AS kept_spans,
  coalesce(string_agg(CASE WHEN NOT kept THEN la || '-' || lb || '>' || a || '-' || b || ' ' || reason END, ',' ORDER BY k), '') AS decided FROM f GROUP BY doc_id""")
def resolve_overlaps(spark, sf_dir):
    """Ten drawn spans a document: those that stay, with tenths of confidence, and each decision with its reason."""
    docs = table(spark, sf_dir, "documents").select("doc_id").withColumn("spans", _drawn_spans())
    out = resolve.resolved(docs, decisions="decisions")
    text = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    kept = F.array_join(F.transform("spans", lambda s: text(s["start"], "-", s["end"], s["entity_type"], ":", F.round(s["confidence"] * 10).cast("int"))), ",")
    decided = F.array_join(F.transform("decisions", lambda d: text(d["start"], "-", d["end"], ">", d["rejected_start"], "-", d["rejected_end"], " ", d["reason"])), ",")
    return out.select("doc_id", kept.alias("kept_spans"), decided.alias("decided"))


@query(f"SELECT doc_id, md5(regexp_replace(text, '{EMAIL}', '[E-MAIL]', 'g')) AS digest, CAST(length(regexp_replace(text, '{EMAIL}', '[E-MAIL]', 'g')) AS BIGINT) AS n_chars FROM documents")
def mask_email_text(spark, sf_dir):
    out = policy.apply_policy(emails(spark, sf_dir))
    return out.select("doc_id", F.md5(F.col("output").cast("binary")).alias("digest"), F.length("output").cast("long").alias("n_chars"))


@query(f"SELECT doc_id, lang, md5(regexp_replace(text, '{EMAIL}', CASE WHEN lang = 'es' THEN '[CORREO]' ELSE '[E-MAIL]' END, 'g')) AS digest FROM documents WHERE regexp_matches(text, '{EMAIL}')")
def mask_by_language(spark, sf_dir):
    out = policy.apply_policy(emails(spark, sf_dir).where(F.size("spans") > 0), lang=F.col("lang"))
    return out.select("doc_id", "lang", F.md5(F.col("output").cast("binary")).alias("digest"))


@query(f"""WITH {EMAIL_SQL}, k AS (SELECT doc_id, i, lower(hit) AS key, min(i) OVER (PARTITION BY doc_id, lower(hit)) AS first_ FROM s),
n AS (SELECT doc_id, i, dense_rank() OVER (PARTITION BY doc_id ORDER BY first_) AS number FROM k)
SELECT doc_id, string_agg('[PERSON_' || number || ']', ',' ORDER BY i) AS tags FROM n GROUP BY doc_id""")
def consistent_tags(spark, sf_dir):
    out = policy.apply_policy(emails(spark, sf_dir).where(F.size("spans") > 0), {"EMAIL": "CONSISTENT_TAG"})
    return out.select("doc_id", F.array_join(F.transform("applied", lambda s: s["replacement"]), ",").alias("tags"))


@query(f"""WITH {EMAIL_SQL} SELECT doc_id, place AS "start", CASE doc_id % 3 WHEN 0 THEN 'PRESERVED' WHEN 1 THEN 'REDACTED' ELSE 'TAGGED' END AS status,
  CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '[GESCHWÄRZT]' ELSE '[PERSON_' || number || ']' END AS replacement FROM
  (SELECT *, CAST(start_ AS BIGINT) AS place, dense_rank() OVER (PARTITION BY doc_id ORDER BY first_) AS number FROM (SELECT *, min(i) OVER (PARTITION BY doc_id, lower(hit)) AS first_ FROM s))""")
def override_status(spark, sf_dir):
    """Every e-mail address overridden: kept, removed, or taken for a name, by document."""
    what = F.when(F.col("doc_id") % 3 == 0, "PRESERVE").when(F.col("doc_id") % 3 == 1, "REMOVE")
    over = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), what.alias("transformation"), F.when(F.col("doc_id") % 3 == 2, "PERSON_NAME").alias("entity_type")))
    out = policy.apply_policy(emails(spark, sf_dir).withColumn("overrides", over), overrides="overrides")
    # Spark puts a filter of an inner explode's array before the scan, where all that makes the array is computed again
    found = out.select("doc_id", F.explode_outer("applied").alias("s")).where(F.col("s").isNotNull())
    return found.select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.status").alias("status"), F.col("s.replacement").alias("replacement"))


MANUAL_SQL = "CASE WHEN length(text) < 24 THEN text ELSE '[GESCHWÄRZT]' || substring(text, 7, length(text) // 2 - 6) || '[GESCHWÄRZT]' || substring(text, length(text) // 2 + 7, length(text) - length(text) // 2 - 12) || '[GESCHWÄRZT]' END"


@query(f"SELECT doc_id, CAST(CASE WHEN length(text) >= 24 THEN 3 ELSE 0 END AS BIGINT) AS n_manual, CAST(CASE WHEN length(text) >= 24 THEN 1 ELSE 0 END AS BIGINT) AS n_ignored, md5({MANUAL_SQL}) AS digest FROM documents")
def manual_overrides(spark, sf_dir):
    """Six characters at the beginning, the middle and the end of each text marked by hand, and a place that the text no longer has."""
    n = F.length("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("spans", F.array().cast(f"array<{SPAN_DDL}>"))
    made = lambda a, t=None: F.struct(a.cast("int").alias("start"), (a + 6).cast("int").alias("end"), (F.substring(F.col("text"), a + 1, F.lit(6)) if t is None else t).alias("text"), F.lit("REMOVE").alias("transformation"), F.lit(None).cast("string").alias("entity_type"))
    marks = F.when(n >= 24, F.array(made(F.lit(0)), made(F.floor(n / 2)), made(n - 6), made(F.lit(1), F.lit("§§")))).otherwise(F.array())
    out = policy.manual(docs.withColumn("overrides", marks.cast(f"array<{OVERRIDE_DDL}>")))
    out = policy.apply_policy(resolve.resolved(out), overrides="overrides")
    return out.select("doc_id", F.size("applied").cast("long").alias("n_manual"), F.size("override_notices").cast("long").alias("n_ignored"), F.md5(F.col("output").cast("binary")).alias("digest"))


@query(f"""WITH {EMAIL_SQL} SELECT doc_id, place AS "start", CASE WHEN lower(hit) = first_value(lower(hit)) OVER (PARTITION BY doc_id ORDER BY i) THEN 'PRESERVED' ELSE 'REDACTED' END AS status FROM (SELECT *, CAST(start_ AS BIGINT) AS place FROM s)""")
def preserve_terms(spark, sf_dir):
    """Each document's first e-mail address is a term to keep."""
    found = emails(spark, sf_dir).where(F.size("spans") > 0)
    out = policy.apply_policy(found, preserve=F.array(F.upper(F.col("spans")[0]["text"])))
    return out.select("doc_id", F.explode("applied").alias("s")).select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.status").alias("status"))


@query(_values([("geboren am 1980 in Dresden", "GENERALIZED"), ("seit [ALTER]", "GENERALIZED")], "output, status"))
def generalize_year(spark, sf_dir):
    rows = spark.createDataFrame([("geboren am 01.02.1980 in Dresden", 11, 21, "DATE_OF_BIRTH"), ("seit lange", 5, 10, "AGE")], "text string,a int,b int,k string")
    span = F.array(F.struct(F.col("a").alias("start"), F.col("b").alias("end"), F.substring(F.col("text"), F.col("a") + 1, F.col("b") - F.col("a")).alias("text"), F.col("k").alias("entity_type"), F.lit(1.0).alias("confidence"), F.lit("x").alias("detector"), F.lit(0).alias("ordinal"), F.lit(None).cast(SPAN_DDL.split("metadata:")[1][:-1]).alias("metadata"))).cast(f"array<{SPAN_DDL}>")
    out = policy.apply_policy(rows.withColumn("spans", span), {"DATE_OF_BIRTH": "GENERALIZE", "AGE": "GENERALIZE"})
    return out.select("output", F.col("applied")[0]["status"].alias("status"))


STATUS_CASES = [
    (1, "Patient: Max Mustermann wurde entlassen.", "Max Mustermann", "TAGGED", "FAIL", "labelled_field,residual_identifier"),
    (2, "Patient: [PERSON_1] wurde entlassen am 10.03.2024.", "10.03.2024", "PRESERVED", "PASS", ""),
    (3, "Rückfragen unter Tel.: 0351 458-0.", "", "REDACTED", "REVIEW_REQUIRED", "revalidation_hit"),
    (4, "Name: Mustermann, weitere Angaben folgen.", "", "REDACTED", "REVIEW_REQUIRED", "labelled_field"),
    (5, "Patient: [PERSON_1] wurde vorstellig.", "", "REDACTED", "PASS", ""),
]


@query(_values([(c[0], c[4], c[5]) for c in STATUS_CASES], "case_id, status, categories"))
def validation_status(spark, sf_dir):
    rows = spark.createDataFrame([c[:4] for c in STATUS_CASES], "case_id long, output string, t string, st string")
    applied = F.array(F.struct(F.lit(0).alias("start"), F.length("t").alias("end"), F.col("t").alias("text"), F.lit("PERSON_NAME").alias("entity_type"), F.col("st").alias("status")))
    out = validate.validate(rows.withColumn("applied", applied))
    return out.select("case_id", F.col("validation_status").alias("status"), F.array_join(F.array_sort(F.array_distinct(F.transform("warnings", lambda w: w["category"]))), ",").alias("categories"))


@query(f"""WITH {EMAIL_SQL} SELECT doc_id, CAST(i - 1 AS BIGINT) AS entity, CAST(position(hit IN text) - 1 AS BIGINT) AS first_at, 'HIGH' AS severity, 'Redacted EMAIL content appears to remain in the output.' AS message FROM s""")
def residual_identifiers(spark, sf_dir):
    """The source stands for an output in which nothing was replaced: each e-mail address is a warning at its first place."""
    found = policy.apply_policy(emails(spark, sf_dir).where(F.size("spans") > 0))
    w = validate.residuals(F.col("text"), F.col("applied"))
    return found.select("doc_id", F.posexplode(w).alias("entity", "w")).select("doc_id", F.col("entity").cast("long").alias("entity"), F.col("w.start").cast("long").alias("first_at"), F.col("w.severity").alias("severity"), F.col("w.message").alias("message"))


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with three drawn annotations and three predictions each, some right, some shifted, some off."""
    d, n = F.col("doc_id"), F.length("text")
    room = F.greatest(n - 20, F.lit(1))
    at = lambda i: ((d * 13 + i * 37) % room).cast("int")
    size = lambda i: (3 + (d + i * 5) % 9).cast("int")
    gold = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(at(i).alias("start"), (at(i) + size(i)).alias("end"), F.concat(F.lit("l"), i.cast("string")).alias("label"), F.concat(F.lit("T"), ((d + i) % 3).cast("string")).alias("entity_type")))
    shift = lambda i: F.when((d + i) % 4 == 0, 0).when((d + i) % 4 == 1, 2).when((d + i) % 4 == 2, -3).otherwise(500).cast("int")
    predicted = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct((at(i) + shift(i)).alias("start"), (at(i) + shift(i) + size(i)).alias("end"), F.concat(F.lit("T"), (i % 3).cast("string")).alias("entity_type")))
    return table(spark, sf_dir, "documents").select("doc_id", "text", gold.alias("gold"), predicted.alias("predicted"))


GOLD_SQL = """
g AS (SELECT doc_id, i, length(text) AS n, CAST((doc_id * 13 + i * 37) % greatest(length(text) - 20, 1) AS BIGINT) AS a, 3 + (doc_id + i * 5) % 9 AS w, 'T' || ((doc_id + i) % 3) AS kind,
  CASE (doc_id + i) % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN -3 ELSE 500 END AS shift FROM documents, range(0, 3) AS t(i)),
p AS (SELECT doc_id, i, a + shift AS a, a + shift + w AS b FROM g),
gx AS (SELECT g.*, a + w AS b, exists(SELECT 1 FROM p WHERE p.doc_id = g.doc_id AND p.a = g.a AND p.b = g.a + g.w) AS exact, exists(SELECT 1 FROM p WHERE p.doc_id = g.doc_id AND p.a < g.a + g.w AND g.a < p.b) AS touched FROM g),
px AS (SELECT p.*, exists(SELECT 1 FROM g WHERE p.doc_id = g.doc_id AND p.a = g.a AND p.b = g.a + g.w) AS exact, exists(SELECT 1 FROM g WHERE p.doc_id = g.doc_id AND p.a < g.a + g.w AND g.a < p.b) AS touched FROM p),
w AS (SELECT doc_id, list([a, a + w]) AS gl, list([a + shift, a + shift + w]) AS pl FROM g GROUP BY doc_id),
ch AS (SELECT d.doc_id, k, gl[1][1] <= k AND k < gl[1][2] OR gl[2][1] <= k AND k < gl[2][2] OR gl[3][1] <= k AND k < gl[3][2] AS ing, pl[1][1] <= k AND k < pl[1][2] OR pl[2][1] <= k AND k < pl[2][2] OR pl[3][1] <= k AND k < pl[3][2] AS inp
  FROM (SELECT doc_id, gl, pl, unnest(string_split(text, '')) AS x, unnest(range(0, length(text))) AS k FROM documents JOIN w USING (doc_id)) AS d WHERE position(x IN ' ,.!?:;-()"''' || chr(10) || chr(9) || chr(13)) = 0),
c AS (SELECT d.doc_id, coalesce(t.tp, 0) AS tp, coalesce(t.fp, 0) AS fp, coalesce(t.tn, 0) AS tn, coalesce(t.fn, 0) AS fn FROM documents d LEFT JOIN
  (SELECT doc_id, count(*) FILTER (ing AND inp) AS tp, count(*) FILTER (NOT ing AND inp) AS fp, count(*) FILTER (NOT ing AND NOT inp) AS tn, count(*) FILTER (ing AND NOT inp) AS fn FROM ch GROUP BY doc_id) t USING (doc_id)),
m AS (SELECT c.*, gs.*, ps.* EXCLUDE (id2) FROM c JOIN (SELECT doc_id AS id1, count(*) AS gold_total, count(*) FILTER (exact) AS gold_exact, count(*) FILTER (touched) AS gold_overlap FROM gx GROUP BY 1) gs ON gs.id1 = c.doc_id
  JOIN (SELECT doc_id AS id2, count(*) AS predicted_total, count(*) FILTER (exact) AS predicted_exact, count(*) FILTER (touched) AS predicted_overlap FROM px GROUP BY 1) ps ON ps.id2 = c.doc_id)"""


def _ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END)"


def _metrics_sql(of: str) -> str:
    out = []
    for name, (hp, ap, hr, ar) in {"char": ("tp", "(tp + fp)", "tp", "(tp + fn)"), "exact": ("predicted_exact", "predicted_total", "gold_exact", "gold_total"), "overlap": ("predicted_overlap", "predicted_total", "gold_overlap", "gold_total")}.items():
        p, r = _ratio(hp, ap), _ratio(hr, ar)
        out += [f"round({p}, 4) AS {name}_precision", f"round({r}, 4) AS {name}_recall", f"round(CASE WHEN {p} + {r} = 0 THEN 0.0 ELSE 2 * {p} * {r} / ({p} + {r}) END, 4) AS {name}_f1"]
    return ", ".join([*out, f"round({_ratio('tn', '(tn + fp)')}, 4) AS char_specificity"])


@query(f"WITH {GOLD_SQL} SELECT doc_id, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, fn > 0 AS leaked FROM c")
def char_confusion(spark, sf_dir):
    return evaluate.scored(_annotated(spark, sf_dir)).select("doc_id", "tp", "fp", "tn", "fn", "leaked")


@query(f"WITH {GOLD_SQL} SELECT doc_id, gold_total, gold_exact, gold_overlap, predicted_total, predicted_exact, predicted_overlap FROM m")
def span_matches(spark, sf_dir):
    return evaluate.scored(_annotated(spark, sf_dir)).select("doc_id", *evaluate.COUNTS[4:])


@query(f'WITH {GOLD_SQL} SELECT doc_id, a AS "start", b AS "end", kind AS entity_type FROM gx WHERE NOT touched')
def missed_entities(spark, sf_dir):
    docs = _annotated(spark, sf_dir)
    rows = lambda c: docs.select("doc_id", F.explode(c).alias("s")).select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), "s.entity_type")
    return evaluate.matching(rows("gold"), rows("predicted"), keep="left_anti")


@query(f"WITH {GOLD_SQL}, t AS (SELECT {', '.join(f'CAST(sum({x}) AS BIGINT) AS {x}' for x in evaluate.COUNTS)} FROM m) SELECT {', '.join(evaluate.COUNTS)}, {_metrics_sql('t')} FROM t")
def micro_metrics(spark, sf_dir):
    return evaluate.micro(evaluate.scored(_annotated(spark, sf_dir)))


MACRO = ("char_precision", "char_recall", "char_f1", "exact_precision", "exact_recall", "exact_f1", "overlap_precision", "overlap_recall", "overlap_f1", "char_specificity")


@query(f"WITH {GOLD_SQL}, t AS (SELECT {_metrics_sql('m')} FROM m) SELECT {', '.join(f'round(avg({x}), 4) AS {x}' for x in MACRO)} FROM t")
def macro_metrics(spark, sf_dir):
    return evaluate.macro(evaluate.scored(_annotated(spark, sf_dir)))


@query(f"""WITH {GOLD_SQL} SELECT count(*) AS documents, count(*) FILTER (fn > 0) AS leaked_documents, count(*) FILTER (fn = 0) AS clean_documents, round(CAST(count(*) FILTER (fn > 0) AS DOUBLE) / count(*), 4) AS leakage_rate,
  CAST(sum(fn) AS BIGINT) AS leaked_characters, (SELECT count(*) FROM gx WHERE NOT touched) AS missed_entities FROM c""")
def leakage_rate(spark, sf_dir):
    return evaluate.leakage(evaluate.scored(_annotated(spark, sf_dir)))


@query(f"WITH {GOLD_SQL} SELECT kind AS entity_type, count(*) AS entities, count(*) FILTER (touched) AS detected, round(CAST(count(*) FILTER (touched) AS DOUBLE) / count(*), 4) AS recall FROM gx GROUP BY kind")
def per_type_metrics(spark, sf_dir):
    return evaluate.by_type(_annotated(spark, sf_dir))


@query("SELECT source, CASE WHEN source = 'src1' THEN 'AGE' ELSE 'OTHER_PII' END AS entity_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (source <> 'src1') AS BIGINT) AS n_unknown FROM documents GROUP BY source")
def label_map(spark, sf_dir):
    labelled = annotations.with_labels(table(spark, sf_dir, "documents").select("source", F.col("source").alias("label")), {"SRC1": "AGE"})
    return labelled.groupBy("source", "entity_type").agg(F.count("*").alias("n"), F.count("label_warning").alias("n_unknown"))


@query("""WITH k AS (SELECT doc_id, k, CASE WHEN k >= doc_id % 7 AND k < doc_id % 7 + 9 THEN 0 WHEN k >= 15 AND k < 15 + doc_id % 5 THEN 1 WHEN k >= length(text) - 5 THEN 2 END AS e, k >= 5 + doc_id % 11 AND k < 12 + doc_id % 11 AS w FROM documents, unnest(range(0, length(text))) AS u(k)),
j AS (SELECT *, k = 0 OR e IS DISTINCT FROM lag(e) OVER o OR w IS DISTINCT FROM lag(w) OVER o AS new_, e IS NOT NULL AND e IS DISTINCT FROM lead(e) OVER o AS last_ FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
i AS (SELECT *, sum(CASE WHEN new_ THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS segment FROM j),
g AS (SELECT doc_id, segment, min(k) AS a, count(*) AS n, any_value(e) AS e, any_value(w) AS w, bool_or(last_) AS label FROM i GROUP BY doc_id, segment)
SELECT doc_id, string_agg(a || '+' || n || ':' || coalesce(CAST(e AS VARCHAR), '-') || ':' || CAST(w AS VARCHAR) || ':' || CAST(label AS VARCHAR), ' ' ORDER BY segment) AS segments FROM g GROUP BY doc_id""")
def highlight_segments(spark, sf_dir):
    """What a viewer draws of three entities and a warning in each text: segments by place, entity, warning and label."""
    d, n = F.col("doc_id"), F.length("text")
    pair = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    docs = table(spark, sf_dir, "documents").where(n > 0).select("doc_id", "text", F.array(pair(d % 7, d % 7 + 9), pair(F.lit(15), 15 + d % 5), pair(F.greatest(n - 5, F.lit(0)), n)).alias("e"), F.array(pair(5 + d % 11, 12 + d % 11)).alias("w"))
    found = docs.select("doc_id", segments.highlighted(F.col("text"), F.col("e"), F.col("w")).alias("s"))
    text = lambda s: F.concat_ws(":", F.concat(s["start"].cast("string"), F.lit("+"), F.length(s["text"]).cast("string")), F.coalesce(s["entity_index"].cast("string"), F.lit("-")), s["warning"].cast("string"), s["show_label"].cast("string"))
    return found.select("doc_id", F.array_join(F.transform("s", text), " ").alias("segments"))


@query("""SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "start",
  CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text) AS BIGINT) AS "end" FROM conversations""")
def page_offsets(spark, sf_dir):
    out = ocr.page_offsets(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return out.select("conv_id", "turn", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, md5(array_to_string(l, chr(10))) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)")
def ocr_plain(spark, sf_dir):
    out = ocr.transcribed(table(spark, sf_dir, "documents"), "plain", raw="text")
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join(F.transform("lines", lambda x: x["text"]), "\n").cast("binary")).alias("digest"))


@query(_values([("Patientin: Erika Musterfrau", 112, 76, 681, 95), ("freie Zeile", None, None, None, None)], "text, x1, y1, x2, y2").replace("NULL", "CAST(NULL AS BIGINT)"))
def ocr_boxes(spark, sf_dir):
    raw = spark.createDataFrame([("<|ref|>x<|/ref|>text [112, 76, 681, 95]Patientin: Erika Musterfrau\n\nfreie Zeile",)], "raw string")
    out = ocr.transcribed(raw, "unlimited_ocr").select(F.explode("lines").alias("l"))
    return out.select("l.text", *(F.col(f"l.box.{k}").cast("long").alias(k) for k in ("x1", "y1", "x2", "y2")))


SIGNS = " – a—b ‘c’ ‚d “e” „f“ • g▪h\u00a0i → … 5 € ✓"


@query(f"""SELECT doc_id, md5(regexp_replace(translate(replace(replace(text || '{SIGNS}', '…', '...'), '→', '->'), '•▪–—‘’“”„' || chr(160), '----' || repeat(chr(39), 2) || repeat(chr(34), 3) || ' '), '[^\\x{{00}}-\\x{{FF}}]', '?', 'g')) AS digest FROM documents""")
def latin1_text(spark, sf_dir):
    """Every text, with the signs that are replaced after it."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.concat("text", F.lit(SIGNS)))
    return docs.select("doc_id", F.md5(ocr.latin1(F.col("text")).cast("binary")).alias("digest"))


@query(f"""WITH {EMAIL_SQL} SELECT doc_id, hit AS "text", CAST(count(*) OVER (PARTITION BY doc_id, lower(hit)) AS BIGINT) AS occurrences FROM s""")
def matching_occurrences(spark, sf_dir):
    found = emails(spark, sf_dir).select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.text").alias("text"))
    return evaluate.occurrences(found)


@query(f"WITH {EMAIL_SQL} SELECT lang, CAST(len AS BIGINT) AS n_entities, CAST(count(*) AS BIGINT) AS n_documents FROM (SELECT doc_id, lang, count(*) AS len FROM s GROUP BY ALL) GROUP BY ALL")
def entity_counts_by_type(spark, sf_dir):
    """How many documents of each language have how many entities."""
    out = policy.apply_policy(emails(spark, sf_dir).where(F.size("spans") > 0))
    counts = out.select("lang", F.explode(policy.entity_counts(F.col("applied"))).alias("c")).where("c.entity_type = 'EMAIL'")
    return counts.groupBy("lang", F.col("c.n").cast("long").alias("n_entities")).agg(F.count("*").alias("n_documents"))


@query("""SELECT event_id, CAST(greatest(900 - age, 0) AS BIGINT) AS remaining, age < 900 AND least(age + 3600, 43200) > 900 AS can_extend FROM (SELECT event_id, event_id % 1200 AS age FROM events)""")
def cache_lifetimes(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 1200).alias("age"))
    created, expires, now = F.lit(0.0), F.lit(900.0), F.col("age").cast("double")
    return events.select("event_id", cache.remaining(expires, now).cast("long").alias("remaining"), cache.can_extend(created, expires, now).alias("can_extend"))


@query()
def deidentified_documents(spark, sf_dir):
    """The whole pipeline with all rules: output digest, spans and grade of every document."""
    out = deidentify.deidentified(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), lang=F.col("lang"))
    return out.select("doc_id", F.md5(F.col("output").cast("binary")).alias("digest"), F.size("applied").alias("n_spans"), F.col("validation_status").alias("status"))


#: Where a window of a text ends: after the last mark in its last 40 %, or at its end.
_END = "CASE " + " ".join(f"WHEN strpos(reverse(w), reverse({m})) > 0 THEN length(w) - strpos(reverse(w), reverse({m})) + 1" for m in ("chr(10) || chr(10)", "chr(10)", "'. '")) + " ELSE length(w) END"


@query(f"""WITH RECURSIVE c AS (SELECT doc_id, 0 AS chunk, 0 AS a, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT doc_id, chunk + 1, least(n - 1 + length(regexp_extract(substring(text, n, b - n + 1), '^\\S*')) + 1, b), text FROM
    (SELECT *, greatest(b - {mentions.OVERLAP}, a + 1) AS n FROM (SELECT *, a + {int(mentions.CHUNK * mentions.LATEST)} + {_END} AS b FROM (SELECT *, substring(text, a + {int(mentions.CHUNK * mentions.LATEST)} + 1, {mentions.CHUNK - int(mentions.CHUNK * mentions.LATEST)}) AS w FROM c WHERE length(text) - a > {mentions.CHUNK}))))
SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, CAST(a AS BIGINT) AS "start", md5(CASE WHEN length(text) - a > {mentions.CHUNK} THEN substring(text, a + 1, {int(mentions.CHUNK * mentions.LATEST)} + {_END}) ELSE substring(text, a + 1) END) AS digest
FROM (SELECT *, substring(text, a + {int(mentions.CHUNK * mentions.LATEST)} + 1, {mentions.CHUNK - int(mentions.CHUNK * mentions.LATEST)}) AS w FROM c)""")
def document_chunks(spark, sf_dir):
    out = mentions.chunks(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("start").cast("long").alias("start"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"""WITH {EMAIL_SQL} SELECT doc_id, CAST(sum((length(text) - length(replace(text, hit, ''))) / length(hit)) AS BIGINT) AS n_spans, CAST(1 AS BIGINT) AS n_lost FROM (SELECT DISTINCT doc_id, text, hit FROM s) GROUP BY doc_id""")
def grounded_mentions(spark, sf_dir):
    """Each document's e-mail addresses as a model's mentions, and one that it doesn't have."""
    found = emails(spark, sf_dir).where(F.size("spans") > 0)
    said = F.transform(F.array_union(F.array_distinct(F.transform("spans", lambda s: s["text"])), F.array(F.lit("¤ nobody ¤"))), lambda t: F.struct(t.alias("text"), F.lit("EMAIL").alias("entity_type"), F.lit("").alias("role")))
    out = grounding.grounded(found.withColumn("mentions", said))
    return out.select("doc_id", F.size("mention_spans").cast("long").alias("n_spans"), F.size("mention_notices").cast("long").alias("n_lost"))


#: A model's answers, and the mentions in them.
ANSWERS = [
    ('{"entities":["junk",{"text":"Max","type":"PERSON_NAME"}]}', [("Max", "PERSON_NAME", "")]),
    ('[{"text":"Bo","type":"person_name","role":{"a":1}},{"text":["Max"],"type":"AGE"},{"text":" ","type":"AGE"}]', [("Bo", "OTHER_PII", "")]),
    ('```json\n{"entities":[{"text":"Zoe ","type":"AGE","role":"patient"},{"type":"AGE"},null,7]}\n```', [("Zoe ", "AGE", "patient")]),
    ('{"risk":"low"}', []),
    ('{"entities":"none"}', []),
    ('  ```\n[{"text":"X1","type":5,"role":7}]\n```  ', [("X1", "OTHER_PII", "")]),
]


@query(_values([(i, *m) for i, (_, found) in enumerate(ANSWERS) for m in found], "answer_id, text, entity_type, role"))
def parsed_answers(spark, sf_dir):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ANSWERS)], "answer_id long, answer string")
    return rows.select("answer_id", F.explode(mentions.parsed(F.col("answer"))).alias("m")).select("answer_id", "m.text", "m.entity_type", "m.role")


#: A transcript's lines with the boxes that they share.
TRANSCRIPT = '```html\n<div data-label="T" data-bbox="10 100 900 1300"><h2>Kopf &amp; Fuß</h2><div>Zeile<br>zwei</div><table><tr><td>a</td><td>b</td></tr></table></div>frei\n<ol><li>x<ul><li>y</li></ul></li><li>z</li></ol><img alt="Siegel">\n```'
TRANSCRIPT_LINES = [("Kopf & Fuß", 100, 325), ("Zeile", 325, 550), ("zwei", 550, 775), ("a | b", 775, 1000), ("frei", None, None), ("1. x", None, None), ("- y", None, None), ("2. z", None, None), ("[Siegel]", None, None)]


@query(_values([(i, *line) for i, line in enumerate(TRANSCRIPT_LINES)], "line, text, y1, y2"))
def ocr_html_lines(spark, sf_dir):
    out = ocr.transcribed(spark.createDataFrame([(TRANSCRIPT,)], "raw string"), "chandra").select(F.posexplode("lines").alias("line", "l"))
    return out.select(F.col("line").cast("long").alias("line"), "l.text", *(F.col(f"l.box.{k}").cast("long").alias(k) for k in ("y1", "y2")))


@query()
def ocr_html(spark, sf_dir):
    out = ocr.transcribed(table(spark, sf_dir, "pages"), "chandra", raw="html")
    return out.select("page_id", F.size("lines").alias("n_lines"), F.md5(F.array_join(F.transform("lines", lambda x: x["text"]), "\n").cast("binary")).alias("digest"))


@query("SELECT page_id, sha256(html) AS digest, substring(sha256(url), 1, 12) AS reference FROM pages")
def content_digests(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", content_digest(F.col("html")).alias("digest"), log_reference(F.col("url")).alias("reference"))


@query("""WITH a AS (SELECT conv_id, turn, unnest(range(0, 1 + turn % 3)) AS i FROM conversations), r AS (SELECT conv_id, turn, ((conv_id * 7 + i * 131) % 600) / 1000 AS x0, ((turn * 13 + i * 71) % 500) / 1000 AS y0 FROM a)
SELECT c.conv_id, c.turn, CAST(count(r.x0) AS BIGINT) AS n_areas, round(coalesce(sum(r.x0 + r.y0), 0), 6) AS corners FROM conversations c LEFT JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn AND c.turn % 2 = 0 GROUP BY ALL""")
def page_areas(spark, sf_dir):
    """Turns stand for pages: up to three areas drawn on every other one, as shares of the page."""
    pages = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    i, c, t = F.col("i"), F.col("conv_id"), F.col("turn")
    drawn = pages.where(t % 2 == 0).select("conv_id", "turn", F.explode(F.sequence(F.lit(0), t % 3)).alias("i"))
    x, y = (c * 7 + i * 131) % 600, (t * 13 + i * 71) % 500
    # pages are numbered from 1
    areas = drawn.select("conv_id", (t + 1).alias("page"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + 50).cast("double").alias("x1"), (y + 60).cast("double").alias("y1"))
    out = ocr.placed_areas(areas, pages.withColumn("page_number", t + 1), "conv_id")
    corners = F.aggregate("areas", F.lit(0.0), lambda acc, a: acc + a["x0"] + a["y0"])
    return out.select("conv_id", "turn", F.size("areas").cast("long").alias("n_areas"), F.round(corners, 6).alias("corners"))


@query("""WITH p AS (SELECT user_id AS batch_id, event_id AS tick, least(event_id % 130, 100.0) AS percent FROM events)
SELECT batch_id, tick, max(percent) OVER (PARTITION BY batch_id ORDER BY tick ROWS UNBOUNDED PRECEDING) AS percent FROM p""")
def batch_progress(spark, sf_dir):
    """Events stand for a batch's documents on their way."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("batch_id"), F.col("event_id").alias("tick"), progress.percent(F.lit("running"), (F.col("event_id") % 130).cast("double"), F.lit(100.0)).alias("percent"))
    return progress.batch(events, at="tick")


#: Lines of a letter that hold what each rule finds, written with a number n; and what is found of them, by rule.
LETTER = [
    ("Rückfragen an arzt{n}@klinik{m}.example.de.", {"de.email.v1": "arzt{n}@klinik{m}.example.de."[:-1]}),
    ("Siehe https://portal.example/akte/{n}?seite={m} dort", {"de.url.v1": "https://portal.example/akte/{n}?seite={m}"}),
    ("Konto DE{z2} 3704 0044 0532 {z4} 00", {"de.iban.v1": "DE{z2} 3704 0044 0532 {z4} 00"}),
    ("Telefon: 0351 / {z4}-{d}", {"de.phone.labelled.v1": "0351 / {z4}-{d}"}),
    ("Zentrale +49 351 {z4}{d}, abends", {"de.phone.intl.v1": "+49 351 {z4}{d}"}),
    ("geboren am {day}.{month}.19{z2} in Ort", {"de.dob.labelled.v1": "{day}.{month}.19{z2}", "de.date.numeric.v1": "{day}.{month}.19{z2}"}),
    ("Aufnahme {day}. {month}.{z2}, entlassen", {"de.date.numeric.v1": "{day}. {month}.{z2}"}),
    ("Probe vom 20{z2}-{mm}-{dd} liegt vor", {"de.date.iso.v1": "20{z2}-{mm}-{dd}"}),
    ("Brief vom {day}. März 20{z2} liegt bei", {"de.date.written.v1": "{day}. März 20{z2}"}),
    ("Fall-Nr.: {n}-{z4}/X liegt vor", {"de.id.labelled.v1": "{n}-{z4}/X"}),
    ("Auftrag LAB-{z4}{d} erledigt", {"de.id.pattern.v1": "LAB-{z4}{d}"}),
    ("wohnhaft in der Langen Gasse {h}b im Hof", {"de.address.street.v1": "Langen Gasse {h}b"}),
    ("in 0{z4} Musterstadt-Süd, dort", {"de.address.plz_city.v1": "0{z4} Musterstadt-Süd"}),
    ("in der Klinik für Herz-, Thorax- und Gefäßchirurgie, heute", {"de.org.department.v1": "Klinik für Herz-, Thorax- und Gefäßchirurgie"}),
    ("von der Chirurgische Klinik {d1} verlegt", {"de.org.unit.v1": "Chirurgische Klinik {d1}"}),
    ("auf Station K{z2} gelegen", {"de.org.ward.v1": "Station K{z2}"}),
]
_FILL = {
    "n": "CAST(doc_id AS {text})", "m": "CAST(doc_id % 97 AS {text})", "d": "CAST(doc_id % 10 AS {text})", "d1": "CAST(1 + doc_id % 9 AS {text})", "h": "CAST(1 + doc_id % 900 AS {text})",
    "z2": "lpad(CAST(10 + doc_id * 7 % 90 AS {text}), 2, '0')", "z4": "lpad(CAST(1000 + doc_id * 31 % 9000 AS {text}), 4, '0')", "day": "CAST(1 + doc_id % 28 AS {text})", "month": "CAST(1 + doc_id % 12 AS {text})",
    "dd": "lpad(CAST(1 + doc_id % 28 AS {text}), 2, '0')", "mm": "lpad(CAST(1 + doc_id % 12 AS {text}), 2, '0')",
}


def _filled(line: str, text: str) -> str:
    """A line as SQL that puts the numbers in."""
    parts = re.split(r"\{(\w+)\}", line)
    return "concat(" + ", ".join(_FILL[p].replace("{text}", text) if i % 2 else _quoted(p) for i, p in enumerate(parts) if p or i % 2) + ")"


@query(" UNION ALL ".join(f"SELECT doc_id, '{rule}' AS rule_id, CAST({i} AS BIGINT) AS line, {_filled(found, 'VARCHAR')} AS found FROM documents" for i, (_, every) in enumerate(LETTER) for rule, found in every.items()))
def detect_rules_letters(spark, sf_dir):
    """A letter for each document's number with what every rule finds, and nothing else that any would."""
    text = "concat_ws('\\n', " + ", ".join(_filled(line, "STRING") for line, _ in LETTER) + ")"
    letters = table(spark, sf_dir, "documents").select("doc_id", F.expr(text).alias("text"))
    found = detect.with_spans(letters, [detect.rules()]).select("doc_id", "text", F.explode("spans").alias("s"))
    before = F.substring(F.col("text"), F.lit(1), F.col("s.start"))
    return found.select("doc_id", F.col("s.metadata.rule_id").alias("rule_id"), (F.size(F.split(before, "\n")) - 1).cast("long").alias("line"), F.col("s.text").alias("found"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents de-identified with all rules: entities by type and status, and the documents that have them."""
    out = deidentify.deidentified(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = out.select("doc_id", "validation_status", F.explode("applied").alias("s"))
    return found.groupBy(F.col("s.entity_type").alias("entity_type"), F.col("s.status").alias("status"), "validation_status").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_documents"))
