import hashlib
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from schleier import queries, types
from schleier.functions.patterns import LABELLED_FIELD, RULES
from schleier.functions.text import blocks, cut, cuttable, greatest_before, matches, sums_before
from schleier.operators import detect, evaluate, grounding, mentions, ocr, policy, resolve, segments, validate
from schleier.plans import deidentify

GOLD = "array<struct<start:int,end:int,label:string,entity_type:string>>"
PREDICTED = "array<struct<start:int,end:int,entity_type:string>>"
NAMES = {"Max Mustermann": "PERSON_NAME", "Erika Musterfrau": "PERSON_NAME"}


def resolve_all(spark, cases):
    """cases: lists of (start, end, type, confidence, detector)."""
    rows = [(n, [{"start": a, "end": b, "text": "x" * (b - a), "entity_type": k, "confidence": c, "detector": d, "ordinal": i, "metadata": dict.fromkeys(types.METADATA)} for i, (a, b, k, c, d) in enumerate(case)]) for n, case in enumerate(cases)]
    df = spark.createDataFrame(rows, f"n int, spans array<{types.SPAN_DDL}>")
    return resolve.resolved(df, decisions="decisions").orderBy("n").collect()


def test_matches_equal_python(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab1 é😀\xa0\n.") for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for java, python, group in ((r"(?U)\b\w+", r"\b\w+", 0), (r"(?U)a\s*([b1]+)", r"a\s*([b1]+)", 1), (r"[.]b?", r"[.]b?", 0)):
        got = {r["i"]: [(s["start"], s["end"], s["text"]) for s in r["m"]] for r in df.select("i", matches(F.col("text"), java, group).alias("m")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == [(*m.span(group), m.group(group)) for m in re.finditer(python, t)], (t, java)


def test_many_matches(spark):
    """Spans of a text with very many matches, and what follows from them, take no square of their number."""
    df = spark.createDataFrame([("a@b.de " * 50_000,)], "text string")
    began = time.time()
    found = resolve.resolved(detect.with_spans(df, [detect.rules(["de.email.v1"])]))
    out = policy.apply_policy(found).select(F.size("spans").alias("n"), F.element_at("spans", -1)["end"].alias("end"), F.md5(F.col("output").cast("binary")).alias("digest")).first()
    assert (out["n"], out["end"]) == (50_000, 349_999) and out["digest"] == hashlib.md5(b"[E-MAIL] " * 50_000).hexdigest()
    assert time.time() - began < 20


def test_helpers_on_arrays(spark):
    rows = [([],), ([3],), (list(range(1, 12)),), ([5, 1, 9, 2] * 20,)]
    df = spark.createDataFrame(rows, "x array<int>").select("x", sums_before(F.col("x")).alias("s"), greatest_before(F.col("x")).alias("g"), F.flatten(blocks(F.col("x"))).alias("b"))
    for r in df.collect():
        assert r["s"] == [sum(r["x"][:i]) for i in range(len(r["x"]))] and r["g"] == [max([0, *r["x"][:i]]) for i in range(len(r["x"]))] and r["b"] == r["x"]
    odd = "a😀é\n漢b"
    got = spark.createDataFrame([(odd,)], "t string").select(F.transform(F.sequence(F.lit(0), F.length("t")), lambda i: cut(cuttable(F.col("t")), i, F.length("t"))).alias("c")).first()["c"]
    assert got == [odd[i:] for i in range(len(odd) + 1)]


def test_resolver(spark):
    cases = [
        ([(0, 14, "A", 0.9, "rules"), (0, 14, "A", 1.0, "mock")], [(0, 14)]),
        ([(5, 15, "OTHER_DATE", 0.9, "r"), (5, 15, "DATE_OF_BIRTH", 0.97, "r")], [(5, 15)]),
        ([(0, 15, "A", 0.9, "r"), (0, 12, "A", 0.95, "r")], [(0, 15)]),
        ([(0, 4, "A", 1.0, "r"), (10, 14, "A", 1.0, "r"), (4, 8, "A", 1.0, "r")], [(0, 4), (4, 8), (10, 14)]),
        ([(0, 10, "A", 1.0, "r"), (8, 20, "A", 1.0, "r"), (12, 15, "A", 1.0, "r")], [(0, 10), (12, 15)]),
        ([(0, 6, "A", 1.0, "r"), (3, 30, "A", 1.0, "r")], [(0, 6)]),
        ([], []),
    ]
    got = resolve_all(spark, [c for c, _ in cases])
    assert [[(s["start"], s["end"]) for s in r["spans"]] for r in got] == [kept for _, kept in cases]
    assert got[0]["spans"][0]["confidence"] == 1.0 and got[0]["spans"][0]["metadata"]["supporting_detectors"] == "mock,rules"
    assert [d["reason"] for d in got[0]["decisions"]] == [resolve.MERGED]
    assert got[1]["spans"][0]["entity_type"] == "DATE_OF_BIRTH" and got[1]["decisions"][0]["reason"] == resolve.SURER
    assert [d["reason"] for d in got[4]["decisions"]] == [resolve.OVERLAP]


def redact(spark, texts, chosen=None, **more):
    df = detect.with_spans(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), [detect.rules(), detect.fixtures(NAMES)])
    return policy.apply_policy(resolve.resolved(detect.validated(df)), chosen, **more).orderBy("i").collect()


def test_policy(spark):
    cases = {
        "Max Mustermann traf Erika Musterfrau. Später kam Max Mustermann zurück.": "[PERSON_1] traf [PERSON_2]. Später kam [PERSON_1] zurück.",
        "Tel.: 0351 458-0, Musterstraße 12, chirurgie@beispiel.de": "Tel.: [TELEFON], [ADRESSE], [E-MAIL]",
        "geboren am 01.02.1980 in Dresden": "geboren am [GEBURTSDATUM] in Dresden",
        "Aufnahme am 10.03.2024 erfolgt": "Aufnahme am 10.03.2024 erfolgt",
        "Ärztin übergab Max Mustermann größere Befunde": "Ärztin übergab [PERSON_1] größere Befunde",
    }
    assert [r["output"] for r in redact(spark, cases)] == list(cases.values())
    (r,) = redact(spark, ["am 01.02.1980, Musterstraße 12"], {"OTHER_DATE": "GENERALIZE"}, preserve=["musterSTRASSE  12"])
    assert r["output"] == "am 1980, Musterstraße 12"
    assert r["applied"][1]["status"] == "PRESERVED" and r["applied"][1]["replacement"] is None and r["applied"][1]["metadata"]["preserved_by_term"] == "true"


def python_pipeline(text):
    """(output, places, grade) of a German document by Python's own regular expressions and plain loops."""

    def found(body):
        out = []
        for r in RULES:
            flags, pattern = re.match(r"(?:\(\?(\w+)\))?(.*)", r.pattern, re.S).groups()
            out += [(*m.span(r.group), r.entity_type, r.confidence) for m in re.finditer(pattern, body, re.I if "i" in (flags or "") else 0) if m[r.group]]
        return out

    kept, reach = [], 0
    for a, b, kind, _ in sorted(found(text), key=lambda s: (s[0], s[0] - s[1], -s[3])):
        if a >= reach:
            kept.append((a, b, kind))
            reach = b
    out, at, masks = "", 0, types.masks("de")
    for a, b, kind in kept:
        out += text[at:a] + (text[a:b] if types.DEFAULT_POLICY[kind] == "PRESERVE" else masks[kind])
        at = b
    out += text[at:]
    gone = [text[a:b].strip() for a, b, kind in kept if types.DEFAULT_POLICY[kind] != "PRESERVE"]
    same = [text[a:b] for a, b, kind in kept if types.DEFAULT_POLICY[kind] == "PRESERVE"]
    fail = any(len(g) >= 4 and g in out for g in gone)
    warn = any(types.DEFAULT_POLICY[k] != "PRESERVE" and out[a:b] not in same for a, b, k, _ in found(out)) or re.search(LABELLED_FIELD.removeprefix("(?U)"), out)
    return out, kept, "FAIL" if fail else "REVIEW_REQUIRED" if warn else "PASS"


def test_documents_equal_python(spark, sf):
    """Whole documents, and letters put together from pieces that the rules look for, against a plain version of the pipeline."""
    rnd = random.Random(21)
    pieces = [line for line, _ in queries.LETTER] + ["Patient: Max M", "Name:\tAnna", "Adresse : [ADRESSE]", "01.02.1980", "Tel", ": 0351 4", "Straße 3", "Klinik", " für ", "Innere-, ", "Prof", "geb.", "Pat.-Nr. ", "KV-Nummer9", "+49", "3704", "\n", "\xa0", " ", "-", "ß", "Ärzte-Haus 7", "Station K", "Medizinische ", "und Poliklinik"]
    letters = []
    for i in range(300):
        parts = [rnd.choice(pieces) for _ in range(rnd.randint(1, 12))]
        letters.append(rnd.choice(["", " ", "\n"]).join(parts).format(n=i, m=i % 97, d=i % 10, d1=1 + i % 9, h=1 + i, z2=10 + i % 90, z4=1000 + i, day=1 + i % 28, month=1 + i % 12, dd=f"{1 + i % 28:02}", mm=f"{1 + i % 12:02}"))
    texts = letters + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(4)
    for r in deidentify.deidentified(df).collect():
        out, kept, grade = python_pipeline(r["text"])
        assert [(s["start"], s["end"], s["entity_type"]) for s in r["applied"]] == kept, r["text"]
        assert (r["output"], r["validation_status"]) == (out, grade), r["text"]


def test_languages(spark):
    df = spark.createDataFrame([(k,) for k in (*types.LANGUAGES, "xx", None)], "lang string").withColumn("text", F.lit("an a@b.de"))
    out = policy.apply_policy(detect.with_spans(df, [detect.rules(["de.email.v1"])]), lang=F.col("lang"))
    assert {r["lang"]: r["output"] for r in out.collect()} == {k: f"an {types.masks(k)['EMAIL']}" for k in (*types.LANGUAGES, "xx", None)}


def test_refusals():
    with pytest.raises(ValueError):
        types.merged_policy({"EMAIL": "SHOUT"})
    with pytest.raises(types.DetectorUnavailable):
        detect.registered(["nothing"])
    assert types.policy_deviations({"EMAIL": "TYPE_MASK"}) is None and types.policy_deviations({"EMAIL": "REMOVE"}) == {"EMAIL": "REMOVE"}


def test_year_that_is_the_span_fails(spark):
    df = spark.createDataFrame([("1980 kam", [{"start": 0, "end": 4, "text": "1980", "entity_type": "DATE_OF_BIRTH", "confidence": 1.0, "detector": "x", "ordinal": 0, "metadata": None}])], f"text string, spans array<{types.SPAN_DDL}>")
    r = validate.validate(policy.apply_policy(df, {"DATE_OF_BIRTH": "GENERALIZE"})).first()
    assert r["output"] == "1980 kam" and r["validation_status"] == "FAIL"


def test_overrides_are_computed_once(spark, sf):
    """Neither the detection nor the overrides are made again for a filter, a span or an override."""
    plan = queries.override_status(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line.split("(")[0] and "RLIKE" in line]
    n = 1000
    text = " ".join(f"a{i}@b.de" for i in range(n))
    df = detect.with_spans(spark.createDataFrame([(text,)], "text string"), [detect.rules(["de.email.v1"])])
    over = F.transform("spans", lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), F.when(i % 2 == 0, "PRESERVE").alias("transformation"), F.when(i % 2 == 1, "PERSON_NAME").alias("entity_type")))
    out = policy.apply_policy(df.withColumn("overrides", F.reverse(over)), overrides="overrides")
    start = time.time()
    applied, output = out.select("applied", "output").first()
    assert time.time() - start < 60
    assert [s["status"] for s in applied] == ["PRESERVED", "TAGGED"] * (n // 2)
    assert output == " ".join(f"a{i}@b.de" if i % 2 == 0 else f"[PERSON_{i // 2 + 1}]" for i in range(n))


def test_overrides_by_place(spark):
    """Against plain loops: several overrides of a place, several spans of a place, other texts, places without values."""
    rng = random.Random(5)
    rows = []
    for k in range(60):
        places = [(rng.choice([None, 0, 1, 2, 3]), rng.choice([None, 4, 5])) for _ in range(rng.randint(0, 9))]
        over = [(a, b, rng.choice(["x", "y", None]), rng.choice([None, "PRESERVE", "REMOVE", "TYPE_MASK"]), rng.choice([None, "PHONE"])) for a, b in places]
        spans = [(a, b, rng.choice("xy"), "EMAIL", 1.0, "d", i, dict.fromkeys(types.METADATA)) for i, (a, b) in enumerate((rng.randint(0, 3), rng.randint(4, 5)) for _ in range(rng.randint(0, 5)))]
        rows.append((k, "0123456789", spans, None if k % 10 == 9 else over))
    df = spark.createDataFrame(rows, f"k int, text string, spans array<{types.SPAN_DDL}>, overrides array<{types.OVERRIDE_DDL}>")
    out = policy.apply_policy(df, overrides="overrides").withColumn("last", policy.last_of_each_place(F.col("overrides")))
    for r, (_, _, spans, over) in zip(out.orderBy("k").collect(), rows):
        places = list(dict.fromkeys((o[0], o[1]) for o in over or []))
        last = [None if None in p else [o for o in over if (o[0], o[1]) == p][-1] for p in places]
        assert [x and tuple(x) for x in r["last"]] == last
        want = []
        for s in sorted(spans, key=lambda s: (s[0], s[6])):
            own = next((o for o in last if o and o[:3] == s[:3]), None)
            what = own and own[3] or "TYPE_MASK"
            want.append((s[0], s[6], own and own[4] or "EMAIL", what, "true" if own else None))
        assert [(s["start"], s["ordinal"], s["entity_type"], s["transformation"], s["metadata"]["overridden"]) for s in r["applied"]] == want


def test_manual_and_stale_overrides(spark):
    df = spark.createDataFrame([("Aufnahme bei Max", [(0, 8, "Aufnahme", "REMOVE", None), (1, 3, "zz", "REMOVE", None), (0, 8, "Aufnahme", None, "ORGANIZATION")])], f"text string, overrides array<{types.OVERRIDE_DDL}>")
    r = deidentify.deidentified(df, overrides="overrides").first()
    assert r["output"] == "[ORGANISATION] bei Max"
    assert r["notices"] == [] and [n["code"] for n in r["override_notices"]] == ["manual_selection_ignored", "override_not_matched"]
    assert all(n["message"] == types.MESSAGES[n["code"]] for n in r["override_notices"])
    # a stale selection says nothing about what was detected
    assert r["validation_status"] == "PASS"


def test_kept_passages_of_a_pdf(spark):
    df = spark.createDataFrame([("pdf", "Mail an a@b.de. Nochmals a@b.de."), ("txt", "Mail an a@b.de. Nochmals a@b.de.")], "source_type string, text string")
    df = df.withColumn("overrides", F.array(F.struct(F.lit(8).alias("start"), F.lit(14).alias("end"), F.lit("a@b.de").alias("text"), F.lit("PRESERVE").alias("transformation"), F.lit(None).cast("string").alias("entity_type"))))
    a, b = deidentify.deidentified(df, overrides="overrides", source_type="source_type").orderBy("source_type").collect()
    assert [(n["code"], n["params"]) for n in a["override_notices"]] == [("pdf_preserve_not_honoured", {"count": "1"})] and a["override_notices"][0]["message"].startswith("1 passage(s)") and b["override_notices"] == []


def test_null_and_empty_documents(spark):
    df = spark.createDataFrame([(None,), ("",)], "text string")
    assert [(r["output"], len(r["applied"]), r["validation_status"]) for r in deidentify.deidentified(df).collect()] == [(None, 0, "PASS"), ("", 0, "PASS")]
    assert deidentify.deidentified(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, name, kind, found, how",
    [
        ("Max Mustermann kam. Später ging Max Mustermann.", "Max Mustermann", "PERSON_NAME", ["Max Mustermann"] * 2, None),
        ("Patient: Max\nMustermann wurde", "Max Mustermann", "PERSON_NAME", ["Max\nMustermann"], None),
        ("der patient max mustermann", "Max Mustermann", "PERSON_NAME", ["max mustermann"], None),
        ("Ehemann Herrn Wolfgang Schäfer kam", "Herr Wolfgang Schäfer", "PERSON_NAME", ["Wolfgang Schäfer"], "partial"),
        ("Patient Hans Mueller kam", "Hans Müller", "PERSON_NAME", ["Hans Mueller"], "partial"),
        ("Max Muster-\nmann", "Max Mustermann", "PERSON_NAME", ["Max Muster-\nmann"], "partial"),
        ("Elisabeth Bauer kam, Elisabeth sprach", "Elisabeth Bauer", "PERSON_NAME", ["Elisabeth Bauer", "Elisabeth"], None),
        ("Dr. med. Anna Beispiel behandelte. Anna kam später.", "Dr. med. Anna Beispiel", "PERSON_NAME", ["Dr. med. Anna Beispiel", "Anna"], None),
        ("Gender: Female. a female", "Female", "OTHER_PII", ["Female", "female"], None),
        ("Ernst kam ernst", "Ernst", "PERSON_NAME", ["Ernst"], None),
        ("Der Meierhof liegt", "Klaus Meier", "PERSON_NAME", [], None),
    ],
)
def test_grounding(text, name, kind, found, how):
    spans, lost = grounding.ground(text, [{"text": name, "entity_type": kind, "role": "r"}])
    assert [s["text"] for s in spans] == found and lost == ([] if found else [kind])
    if spans:
        assert spans[0]["metadata"]["grounding"] == how and spans[0]["metadata"]["role"] == "r"
        assert all(text[s["start"] : s["end"]] == s["text"] for s in spans)


def test_grounded_column(spark):
    df = spark.createDataFrame([("Max kam", [("Max", "PERSON_NAME", ""), ("Zoe", "AGE", "")]), (None, None)], f"text string, mentions array<{types.MENTION_DDL}>")
    a, b = deidentify.deidentified(df, mentions="mentions").collect()
    assert a["output"] == "[PERSON_1] kam" and a["notices"][0]["params"] == {"entity_type": "AGE"} and a["validation_status"] == "REVIEW_REQUIRED"
    assert b["output"] is None


def test_chunks():
    text = "\n\n".join(f"Absatz {i} " + "wort " * 20 for i in range(40))
    bounds = mentions.chunk_bounds(text, 1000, 200)
    assert bounds[0][0] == 0 and bounds[-1][1] == len(text) and all(b[0] < a[1] and b[0] > a[0] for a, b in zip(bounds, bounds[1:])) and all(b - a <= 1000 for a, b in bounds)
    assert mentions.chunk_bounds("x" * 3000, 1000, 200) == [(0, 1000), (1000, 2000), (2000, 3000)]
    assert mentions.chunk_bounds("", 10, 2) == [(0, 0)]


def test_answers(spark):
    rows = [(1, 0, 0, '```json\n{"entities":[{"text":"Max","type":"PERSON_NAME","role":"p"},{"text":" ","type":"AGE"},{"text":"q","type":"foo"}]}\n```'), (1, 1, 0, '[{"text":"Max","type":"PERSON_NAME","role":"late"}]')]
    df = spark.createDataFrame(rows, "doc_id int, pass int, chunk int, answer string").withColumn("mentions", mentions.parsed(F.col("answer")))
    assert [tuple(m) for m in mentions.merged(df).first()["mentions"]] == [("Max", "PERSON_NAME", "p"), ("q", "OTHER_PII", "")]
    for bad in ("no json", "5", '"x"', "null", "", '{"entities":5}', '{"entities":null}', '{"entities":[{"text":"Max"}'):
        with pytest.raises(Exception, match="JSON|entities"):
            spark.createDataFrame([(bad,)], "answer string").select(mentions.parsed(F.col("answer"))).collect()
    asked = mentions.asked(mentions.chunks(spark.createDataFrame([(1, "a b")], "doc_id int, text string")), lambda t, k: f'{{"entities":[{{"text":"{t}{k}","type":"AGE"}}]}}')
    assert sorted(r["answer"] for r in asked.collect())[0].count("a b0") == 1


def test_bisected_chunks(spark):
    def ask(text, number):
        if len(text) > 700:
            raise mentions.Truncated
        return f'{{"entities":[{{"text":"{text[0]}{text[-1]}","type":"AGE"}}]}}'

    text = "".join(chr(97 + i * 25 // 2000) for i in range(2000))
    said = mentions.asked(spark.createDataFrame([(1, 0, 0, text)], "doc_id int, chunk int, start int, text string"), ask, 1).orderBy("part").collect()
    assert len(said) > 2 and [r["part"] for r in said] == list(range(len(said))) and json.loads(said[0]["answer"])["entities"][0]["text"][0] == "a" and json.loads(said[-1]["answer"])["entities"][0]["text"][1] == text[-1]
    with pytest.raises(types.DetectorUnavailable):
        mentions.bisected(lambda t, k: (_ for _ in ()).throw(mentions.Truncated), text, 0)
    schema = mentions.schema_of_answers(audit=True)
    assert schema["required"] == ["entities", "risk", "concerns"] and schema["properties"]["entities"]["items"]["properties"]["type"]["enum"] == list(types.ENTITY_TYPES)
    assert mentions.instructed("t") == "t" and mentions.instructed("t", " more ").endswith("more") and "x y" in mentions.framed("x y")


def test_audit(spark):
    """What a model says of an output becomes warnings, located in the output; without an answer the document asks for review."""
    answers = {
        "ok": '{"entities":[],"risk":"low","concerns":[]}',
        "left": '{"entities":[{"text":"Bo","type":"PERSON_NAME"},{"text":"1980","type":"AGE"},{"text":"[X]","type":"AGE"},{"text":"Zed","type":"AGE"}],"risk":"medium","concerns":[{"category":" ","description":"rare job"},{"description":""},7]}',
        "note": '{"entities":[],"risk":"odd","concerns":[{"category":"c","description":"d"}]}',
    }
    df = spark.createDataFrame([(k, f"{k} mit Bo 1980 [X]") for k in (*answers, "none")], "doc_id string, text string")
    got = {r["doc_id"]: r for r in deidentify.audited(deidentify.deidentified(df), lambda t, k: answers.get(t.split()[0])).collect()}
    told = lambda k: [(w["code"], w["category"], w["severity"], w["start"], w["message"]) for w in got[k]["warnings"]]
    assert told("ok") == [] and got["ok"]["validation_status"] == "PASS" and "audit_id_" not in got["ok"].asDict()
    assert told("left") == [
        ("llm_recheck_remaining", "llm_recheck", "WARNING", 9, "The LLM re-check found a possible remaining PERSON_NAME in the output."),
        ("llm_recheck_unlocated", "llm_recheck", "INFO", None, types.MESSAGES["llm_recheck_unlocated"]),
        ("recheck_risk", "recheck_risk", "WARNING", None, "The LLM re-check rates the remaining risk of re-identification as medium."),
        ("", "recheck_other", "WARNING", None, "rare job"),
    ]
    assert told("note") == [("", "recheck_c", "INFO", None, "d")] and got["note"]["validation_status"] == "PASS"
    assert [w[0] for w in told("none")] == ["llm_recheck_failed"] and got["none"]["validation_status"] == "REVIEW_REQUIRED"


def test_recheck(spark):
    df = spark.createDataFrame([(1, 0, '{"entities":[{"text":"1980","type":"AGE"},{"text":"[X]","type":"AGE"},{"text":"Bo","type":"AGE"}],"risk":"low","concerns":[]}'), (1, 1, '{"entities":[],"risk":"high","concerns":[{"category":"c","description":"d"}]}')], "doc_id int, chunk int, answer string")
    r = mentions.rechecked(df, types.DEFAULT_POLICY).first()
    assert [m["text"] for m in r["mentions"]] == ["Bo"] and r["risk"] == "high" and len(r["concerns"]) == 1


def test_char_metrics_equal_masks(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(120):
        text = "".join(rnd.choice("ab .,\n😀ä") for _ in range(rnd.randint(0, 30)))
        some = lambda: [(a, a + rnd.randint(1, 9)) for a in (rnd.randint(0, 30) for _ in range(rnd.randint(0, 3)))]
        rows.append((i, text, [(a, b, "l", "T") for a, b in some()], [(a, b, "T") for a, b in some()]))
    got = {r["i"]: (r["tp"], r["fp"], r["tn"], r["fn"]) for r in evaluate.scored(spark.createDataFrame(rows, f"i int, text string, gold {GOLD}, predicted {PREDICTED}")).collect()}
    for i, text, gold, predicted in rows:
        want = [0, 0, 0, 0]
        for k, c in enumerate(text):
            if c not in types.NOT_SCORED:
                g, p = (any(s[0] <= k < s[1] for s in spans) for spans in (gold, predicted))
                want[0 if g and p else 1 if p else 3 if g else 2] += 1
        assert got[i] == tuple(want)


def test_evaluation_modes(spark):
    text = "Max Mustermann, geb. 01.02.1980, am 10.03.2024"
    df = spark.createDataFrame([("a", text, [(36, 46, "d", "OTHER_DATE"), (21, 31, "b", "DATE_OF_BIRTH")])], f"doc_id string, text string, gold {GOLD}")
    assert evaluate.leakage(deidentify.evaluated(df)).first()["leaked_documents"] == 0
    assert evaluate.leakage(deidentify.evaluated(df, mode="redaction")).first()["leakage_rate"] == 1.0
    assert evaluate.micro(deidentify.evaluated(df, only_annotated_types=True)).first()["overlap_recall"] == 1.0
    assert evaluate.leakage(deidentify.evaluated(df.limit(0))).first()["leakage_rate"] == 0.0
    by = evaluate.by_type(deidentify.evaluated(df), "doc_id").orderBy("entity_type").collect()
    assert [(r["entity_type"], r["recall"], r["char_recall"]) for r in by] == [("DATE_OF_BIRTH", 1.0, 1.0), ("OTHER_DATE", 1.0, 1.0)]


def test_segments(spark):
    df = spark.createDataFrame([("🩺 Max", [(2, 5)], [(3, 4)]), ("", [], []), ("ab", [(0, 99)], [])], "text string, e array<struct<start:int,end:int>>, w array<struct<start:int,end:int>>")
    got = [[(s["text"], s["entity_index"], s["warning"], s["show_label"]) for s in r["h"]] for r in df.select(segments.highlighted(F.col("text"), F.col("e"), F.col("w")).alias("h")).collect()]
    assert got == [[("🩺 ", None, False, False), ("M", 0, False, False), ("a", 0, True, False), ("x", 0, False, True)], [], [("ab", 0, False, True)]]


def test_ocr(spark):
    html = '<div data-label="T" data-bbox="602 865 890 955"><p>a</p><div>b</div></div><table><tr><td>c</td><td>d</td></tr></table><ol><li>x</li></ol><img alt="z">\nfrei'
    assert [(x["text"], tuple(x["box"].values()) if x["box"] else None) for x in ocr.html_lines(html)] == [("a", (602, 865, 890, 910)), ("b", (602, 910, 890, 955)), ("c | d", None), ("1. x", None), ("[z]", None), ("frei", None)]
    assert ocr.html_lines("```html\n<p>q</p>\n```")[0]["text"] == "q" and ocr.html_lines(None) == []
    with pytest.raises(ValueError):
        ocr.transcribed(spark.createDataFrame([("x",)], "raw string"), "none")
    pages = spark.createDataFrame([("a", 2, [("z", (1, 2, 3, 5))]), ("a", 1, [("x", (1, 2, 3, 4)), ("yy", None)])], f"doc_id string, page_number int, lines array<{types.LINE_DDL}>")
    r = ocr.assembled(pages).first()
    assert r["text"] == "x\nyy\n\nz" and [(p["start"], p["end"]) for p in r["pages"]] == [(0, 4), (6, 7)] and [(x["start"], x["end"]) for x in r["layout"]] == [(0, 1), (6, 7)]


def test_line_text_over_a_break(spark):
    df = spark.createDataFrame([("Herr Max\nMustermann kam", [{"start": 5, "end": 19, "replacement": "[PERSON_1]"}], [(0, 8), (9, 23)])], "text string, a array<struct<start:int,end:int,replacement:string>>, l array<struct<start:int,end:int>>")
    assert df.select(F.transform("l", lambda x: ocr.line_text(F.col("text"), x, F.col("a"))).alias("o")).first()["o"] == ["Herr [PERSON_1]", " kam"]


def test_needles(spark):
    rows = [("Mueller", "REDACTED"), ("Mueller-Luedenscheidt", "PRESERVED"), ("Max Muster", "REDACTED"), ("x", "REDACTED")]
    df = spark.createDataFrame([([{"text": t, "status": s} for t, s in rows],)], "a array<struct<text:string,status:string>>")
    r = df.select(validate.needles(F.col("a")).alias("n"), validate.preserved_at_risk(F.col("a")).alias("r"), validate.survives(F.lit("Max\n Muster da"), F.lit("Max Muster")).alias("s"), validate.survives(F.lit("Axel"), F.lit("xe")).alias("t"), validate.covered(F.lit("Max"), F.array(F.lit("Max Muster"))).alias("c")).first()
    assert r["n"] == ["Max Muster", "Mueller"] and r["r"] == ["Mueller-Luedenscheidt"] and (r["s"], r["t"], r["c"]) == (True, False, True)


def test_review_actions(spark):
    rows = [("reset", "REDACTED", "rules", "drop"), ("preserve", "REDACTED", "rules", "PRESERVE"), ("preserve", "PRESERVED", "rules", None), ("redact", "PRESERVED", "rules", "TYPE_MASK"), ("redact", "REDACTED", "rules", None), ("preserve", "REDACTED", "user_manual", "drop"), ("redact", "PRESERVED", "user_manual", "REMOVE")]
    df = spark.createDataFrame(rows, "a string, s string, d string, want string")
    assert df.where(~policy.review_overrides(F.col("a"), F.col("s"), F.col("d")).eqNullSafe(F.col("want"))).count() == 0
