import io
import json
import re
import time
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from schleier.operators import evaluate
from schleier.plans import deidentify
from schleier.operators import ocr
from schleier.sources import annotations, documents, paper, pdf, requests, sinks
from schleier.streaming import cache
from schleier.streaming import documents as stream
from schleier.streaming import progress
from schleier.types import MESSAGES, SPAN_DDL

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def word(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        for name, content in parts.items():
            z.writestr(f"word/{name}.xml", f"<w:x {W}>{content}</w:x>")
    return out.getvalue()


def p(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfGr\xc3\xbc\xc3\x9fe")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_bytes(b"a\x00b")
    (tmp_path / "d.docx").write_bytes(word(p("eins") + f"<w:tbl><w:tr><w:tc>{p('x')}</w:tc><w:tc>{p('y')}</w:tc></w:tr></w:tbl><w:p/>" + p("zwei"), header1=p("Kopf"), footer1=p("Fu"), comments=p("c")))
    (tmp_path / "e.docx").write_bytes(b"no zip")
    (tmp_path / "f.odt").write_bytes(b"x")
    (tmp_path / "g.txt").write_bytes(b"  \n")
    got = {r["path"][-5:]: r for r in documents.extracted(documents.files(spark, str(tmp_path))).collect()}
    assert got["a.txt"]["text"] == "Grüße" and got["a.txt"]["error"] is None
    assert "UTF-8" in got["b.txt"]["error"] and "NUL" in got["c.txt"]["error"] and "no text" in got["g.txt"]["error"]
    rows = {r["path"].rsplit("/", 1)[1]: r for r in documents.extracted(documents.files(spark, str(tmp_path))).collect()}
    assert rows["d.docx"]["text"] == "Kopf\neins\nx | y\nzwei\nFu" and [(n["code"], n["message"]) for n in rows["d.docx"]["notices"]] == [("docx_comments", MESSAGES["docx_comments"])]
    assert "docx" in rows["e.docx"]["error"] and "supported" in rows["f.odt"]["error"]


def test_pdf_fails_loudly_without_its_library(spark, tmp_path):
    if pdf.find_spec("pypdf"):
        pytest.skip("pypdf is installed")
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    with pytest.raises(Exception, match="pypdf"):
        documents.extracted(documents.files(spark, str(tmp_path))).collect()


def test_text_boxes_stay_out(spark):
    box = f'<w:p><w:r><w:t>vor</w:t><w:pict><w:txbxContent>{p("Kasten")}</w:txbxContent></w:pict><w:t>nach</w:t></w:r></w:p>'
    cell = f'<w:tbl><w:tr><w:tc>{box}</w:tc><w:tc>{p("b")}{p("c")}</w:tc></w:tr></w:tbl>'
    text, error, codes = documents.docx(word(box + cell))
    assert text == "vornach\nvornach | b c" and error is None and codes == ["docx_text_boxes"]


LONG = "wort " * 40


def read_pdf(**more):
    return pdf.read(b"x", pdf.Settings(**more))


def test_pdf_routes():
    assert pdf.sampled_pages(100, 4) == [0, 33, 66, 99] and pdf.sampled_pages(3, 8) == [0, 1, 2] and pdf.sampled_pages(9, 1) == [0] and pdf.sampled_pages(0, 4) == []
    assert pdf.has_text(LONG) and not pdf.has_text("| --- |" * 40)
    own = lambda c: [LONG, "zwei\r\nDrei\0"]
    r = read_pdf(pages=own)
    assert r.text == LONG + "\n\nzwei\nDrei" and r.pages == [(1, 0, 200), (2, 202, 211)] and all(r.text[a:b] == t for (_, a, b), t in zip(r.pages, (LONG, "zwei\nDrei")))
    assert read_pdf(pages=own, convert=lambda c, o: {"document": {"text": " md "}}).text == "md"
    broken = lambda c, o: {"md_content": " "}
    r = read_pdf(pages=own, convert=broken)
    assert r.text.startswith("wort") and [n[0] for n in r.notices] == ["pdf_docling_fallback"] and "no text" in r.notices[0][1]
    blank = lambda c: ["", "x"]
    assert "no OCR" in read_pdf(pages=blank).error and "no engine" in read_pdf(pages=own, force_ocr=True).error
    assert read_pdf(pages=blank, engine="llm_vision").scanned and read_pdf(engine="llm_vision", force_ocr=True).scanned
    r = read_pdf(pages=blank, engine="docling_tesseract", convert=lambda c, o: {"markdown": f"ocr {o}"})
    assert r.text == "ocr True" and r.notices[0][0] == "ocr_recognition_errors"
    assert "OCR failed" in read_pdf(pages=blank, engine="docling_tesseract", convert=broken).error
    for engine in ("docling_tesseract", "mistral_ocr"):
        with pytest.raises((RuntimeError, ValueError)):
            read_pdf(pages=blank, engine=engine)


def test_pdf_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    (r,) = documents.extracted(documents.files(spark, str(tmp_path)), pdf.Settings(pages=lambda c: [LONG, "x"])).collect()
    assert r["text"] == f"{LONG}\n\nx" and [tuple(x) for x in r["pages"]] == [(1, 0, 200), (2, 202, 203)] and r["error"] is None
    (r,) = documents.extracted(documents.files(spark, str(tmp_path)), pdf.Settings(engine="llm_vision", pages=lambda c: [""])).collect()
    assert r["scanned"] and r["text"] is None and r["error"] is None


def test_scanned_pages(spark):
    files = spark.createDataFrame([("a", bytearray(b"full,thin,blank")), ("b", bytearray(b"full,lost")), ("c", bytearray(b"blank"))], "path string, content binary")
    render = lambda content: [(k, 0.0 if k == b"blank" else 0.1) for k in bytes(content).split(b",")]
    said = {(b"full", "p"): "text [1, 2, 3, 4]Max\n\nfrei", (b"thin", "q"): "zweite"}
    profile = pdf.Profile(dialect="unlimited_ocr", prompt="p", fallback_prompt="q")
    pages = pdf.transcribed(pdf.rendered(files, render), lambda image, prompt: said.get((bytes(image), prompt), "<|x|>"), profile)
    got = {r["path"]: r for r in pdf.scans(pages).collect()}
    assert got["a"]["text"] == "Max\nfrei\n\nzweite\n\n" and [(x["start"], x["end"]) for x in got["a"]["layout"]] == [(0, 3)] and got["a"]["notices"][0]["code"] == "ocr_recognition_errors"
    assert got["b"]["text"] is None and "page 2" in got["b"]["error"] and got["c"]["error"] == "nothing was read"
    assert pdf.dark_share(np.array([[0, 200], [127, 128]])) == 0.5


def test_profiles():
    base = pdf.Profile(model="m0", prompt="p0")
    listed = json.dumps([{"name": "a", "model": "m1"}, {"name": "b", "model": "m2", "dialect": "chandra", "prompt": "p2"}])
    assert pdf.chosen(listed, base).model == "m1" and pdf.chosen(listed, base).prompt == "p0" and pdf.chosen(listed, base, "b").dialect == "chandra" and pdf.chosen(None, base) == base
    for bad in ("no", "{}", '[{"name":"a"}]', '[{"name":"a","model":"m","x":1}]', '[{"name":"a","model":"m"},{"name":"a","model":"n"}]', '[{"name":"a","model":"m","dialect":"z"}]', '[{"name":"a","model":"m","max_tokens":1}]'):
        with pytest.raises(ValueError):
            pdf.profiles(bad, base)
    with pytest.raises(ValueError, match="no such profile"):
        pdf.chosen(listed, base, "c")


def test_json_lines(spark, tmp_path):
    rows = [{"document_id": "a", "text": "Max kam", "entities": [{"start": 0, "end": 3, "entity_type": "PERSON_NAME", "text": "Max"}]}, None, {"text": "x", "entities": [{"start": 0, "end": 1, "label": "neu"}]}]
    (tmp_path / "g.jsonl").write_text("\n".join("" if r is None else json.dumps(r) for r in rows))
    got = annotations.json_lines(spark, str(tmp_path / "g.jsonl")).orderBy("document_id").collect()
    assert [r["document_id"] for r in got] == ["a", "line-3"] and got[1]["gold"][0]["entity_type"] == "OTHER_PII" and got[1]["warnings"] == ["unknown label neu"]
    for bad in ({"text": "x", "entities": [{"start": 0, "end": 9, "label": "age"}]}, {"text": "x", "entities": [{"start": 0, "end": 1, "label": "age", "text": "y"}]}, {"document_id": "q"}):
        (tmp_path / "b.jsonl").write_text(json.dumps(bad))
        with pytest.raises(Exception, match="span|text"):
            annotations.json_lines(spark, str(tmp_path / "b.jsonl")).collect()


def test_json_lines_by_block(spark, tmp_path):
    """Lines keep their numbers in their file however it is cut, and a bad line fails whatever is asked for."""
    for name, n in (("a", 700), ("b", 3)):
        rows = [json.dumps({"text": f"{name} {i} " + "x" * (i % 90), "entities": []} | ({"document_id": f"{name}{i}"} if i % 5 == 0 else {})) for i in range(n)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(x for r in rows for x in (r, "")))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = annotations.folder(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [(f"{k}{i}" if i % 5 == 0 else f"line-{2 * i + 1}", f"{k} {i}") for k, n in (("a", 700), ("b", 3)) for i in range(n)]
    assert sorted((r["document_id"], " ".join(r["text"].split()[:2])) for r in got) == sorted(want)
    (tmp_path / "bad.jsonl").write_text('{"document_id":"q","text":"x","entities":[{"start":0,"end":9,"label":"age"}]}')
    with pytest.raises(Exception, match="span"):
        annotations.json_lines(spark, str(tmp_path / "bad.jsonl")).select("document_id").collect()


def test_requests(spark):
    got = requests.accepted(spark.createDataFrame([("a",), (" \n",), (None,), ("x" * 11,)], "text string"), most=10).collect()
    assert [(r["text"], r["error"]) for r in got] == [("a", None), (None, "it has no text"), (None, "it has no text"), (None, "its text is longer than the limit")]
    assert requests.terms('["a", " ", 7, "' + "x" * 300 + '"]') == ["a", "7", "x" * 200] and requests.terms(None) == [] and requests.policy('{"EMAIL":"REMOVE"}') == {"EMAIL": "REMOVE"} and requests.policy(" ") is None
    assert requests.flag(" Yes ") and not requests.flag("no") and requests.language(" xx ") == "xx" and requests.language("") is None and requests.instruction("i") == "i"
    for bad in (lambda: requests.terms("{}"), lambda: requests.terms("no"), lambda: requests.terms(json.dumps(["a"] * 101)), lambda: requests.policy('{"EMAIL":"SHOUT"}'), lambda: requests.policy("[]"), lambda: requests.instruction("x" * 2001)):
        with pytest.raises(ValueError):
            bad()


def drawn_text(content):
    """What a PDF file of ours shows, by page: its places, sizes and texts."""
    assert content.startswith(b"%PDF-1.4") and content.endswith(b"%%EOF\n")
    start = int(re.search(rb"startxref\n(\d+)", content)[1])
    places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n", content[start:])]
    assert all(content[p:].startswith(f"{i} 0 obj".encode()) for i, p in enumerate(places, 1))
    pages = [zlib.decompress(x).decode("latin-1") for x in re.findall(rb"stream\n(.*?)\nendstream", content, re.S)]
    return [[(float(s), float(x), float(y), re.sub(r"\\(.)", r"\1", t)) for s, x, y, t in re.findall(r"/F1 (\S+) Tf (\S+) (\S+) Td \((.*?)(?<!\\)\) Tj", p)] for p in pages]


def test_rebuilt_pages(spark):
    box = lambda text, page, x1=100, y1=100, x2=500, y2=130: (text, (x1, y1, x2, y2), page)
    lines = [box("Herr Max", 1), box("Muster (krank) \u2026", 2), box("wort " * 40, 2, y1=300, y2=400), box("frei", 3, x1=0, x2=900)]
    pages = spark.createDataFrame([("a", k, [(t, b) for t, b, p in lines if p == k]) for k in (1, 2, 3)] + [("b", 1, [("ohne", None)])], f"doc_id string, page_number int, lines {ocr.NONE}")
    docs = ocr.assembled(pages).withColumn("spans", F.array().cast(f"array<{SPAN_DDL}>"))
    at = F.struct(F.lit(5).alias("start"), F.lit(16).alias("end"), F.lit("Max\n\nMuster").alias("text"), F.lit("REMOVE").alias("transformation"), F.lit("PERSON_NAME").alias("entity_type"))
    done = deidentify.finished(docs.withColumn("overrides", F.when(F.col("doc_id") == "a", F.array(at))), lang="en", overrides="overrides")
    done = done.withColumn("areas", F.array(F.struct(F.lit(3).alias("page_number"), F.lit(0.0).alias("x0"), F.lit(0.09).alias("y0"), F.lit(0.0105).alias("x1"), F.lit(0.13).alias("y1"))).cast(paper.AREAS_DDL))
    a, b = paper.rebuilt(done, areas="areas").orderBy("doc_id").collect()
    assert b["pdf"] is None and b["pdf_error"] == "there is no layout" and a["pdf_error"] is None
    first, second, third = drawn_text(bytes(a["pdf"]))
    assert [t for *_, t in first] == ["Herr [REDACTED]"] and [t for *_, t in second][0] == " (krank) ...".strip() and " ".join(t for *_, t in second[1:]) == ("wort " * 40).strip()
    assert third[0][3].strip() == "ei" and first[0][1] == 59.53 and len({y for _, _, y, _ in second[1:]}) > 1 and all(s in paper.SIZES for s, *_ in second)
    kept = done.withColumn("applied", F.transform("applied", lambda s: s.withField("replacement", F.lit(None).cast("string"))))
    assert [r["pdf_error"] for r in paper.rebuilt(kept).where("doc_id = 'a'").collect()] == ["a redacted text can still be read"]
    assert paper.advance("Ä", 10) == paper.advance("A", 10) == 6.67 and paper.wrapped("aa bb", 10, 12) == ["aa", "bb"]


def test_areas(spark):
    pages = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "doc_id string, page_number int")
    kind = "doc_id string, page int, x0 double, y0 double, x1 double, y1 double"
    got = ocr.placed_areas(spark.createDataFrame([("a", 2, 100.0, 0.0, 500.0, 250.0), ("a", 9, 0.0, 0.0, 1.0, 1.0)], kind), pages).orderBy("doc_id", "page_number").collect()
    assert [[tuple(x) for x in r["areas"]] for r in got] == [[], [(0.1, 0.0, 0.5, 0.25)], []]
    for bad in ([("a", 0, 0.0, 0.0, 1.0, 1.0)], [("a", 1, 5.0, 0.0, 5.0, 1.0)], [("a", 1, 0.0, 0.0, 1001.0, 1.0)], [("a", 1, 0.0, 0.0, 1.0, 1.0)] * 201):
        with pytest.raises(Exception, match="area"):
            ocr.placed_areas(spark.createDataFrame(bad, kind), pages).collect()


def test_archives_and_progress(spark):
    df = spark.createDataFrame([("a/b", "eins"), ("a b", "zwei"), (None, None)], "doc_id string, output string")
    (r,) = sinks.archives(df).collect()
    with zipfile.ZipFile(io.BytesIO(r["content"])) as z:
        assert {n: z.read(n).decode() for n in z.namelist()} == {"a_b-anonymized.txt": "zwei", "a_b-2-anonymized.txt": "eins", "none-anonymized.txt": ""}
    lines = spark.createDataFrame([('{"event":"progress","stage":"ocr","done":1,"total":4}',), ('{"event":"prog',), ("",), ('{"x":1}',)], "value string")
    assert [(r["stage"], r["done"]) for r in progress.events(lines).collect()] == [("ocr", 1)]
    states = spark.createDataFrame([(1, 1, "queued", 0.0, 0.0), (1, 1, "running", 1.0, 2.0), (1, 2, "failed", 0.0, 0.0), (1, 2, "running", 1.0, 2.0), (1, 3, "running", 0.0, 2.0), (1, 3, "running", 1.0, 2.0)], "batch_id int, at int, status string, done double, total double")
    got = progress.batch(states.withColumn("percent", progress.percent(F.col("status"), F.col("done"), F.col("total")))).orderBy("at").collect()
    assert [r["percent"] for r in got] == [25.0, 75.0, 75.0]


def test_expiring_results(spark, tmp_path):
    """Commands on keyed state: put, extend, discard, and the end by a timer."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = tmp_path / "in"
    source.mkdir()
    seen = []
    query = (
        cache.expiring(spark.readStream.schema("key string, command string, result string").json(str(source)), ttl=10, extension=900, limit=1800)
        .writeStream.foreachBatch(lambda df, _: seen.extend(df.collect()))
        .outputMode("update")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(processingTime="1 second")
        .start()
    )
    send = lambda i, *rows: (source / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("key", "command", "result"), r))) for r in rows))
    of = lambda key: [r["event"] for r in seen if r["key"] == key]
    try:
        send(1, ("a", "put", "ra"), ("b", "put", "rb"), ("c", "extend", None), ("d", "put", "rd"))
        until = time.time() + 120
        while time.time() < until and len(seen) < 4:
            time.sleep(0.2)
        send(2, ("b", "extend", None), ("d", "discard", None))
        while time.time() < until and not ("expired" in of("a") and len(of("d")) > 1 and len(of("b")) > 1):
            time.sleep(0.2)
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert of("a") == ["put", "expired"] and of("c") == ["gone"] and of("d") == ["put", "discard"] and of("b") in (["put", "extend"], ["put", "expired", "gone"], ["put", "gone"])
    kept = [r for r in seen if r["event"] == "extend"]
    assert all(r["result"] == "rb" and 800 < r["remaining"] <= 900 and r["can_extend"] for r in kept)


CAS = {"%FEATURE_STRUCTURES": [{"%ID": 1, "%TYPE": "uima.cas.Sofa", "sofaString": "Patient Andrew Smith, born 03/31/1989."}, {"%ID": 2, "%TYPE": "custom.Span", "begin": 8, "end": 20, "label": "patientname"}, {"%ID": 3, "%TYPE": "custom.Span", "begin": 27, "end": 37, "label": "dateofbirth"}, {"%ID": 4, "%TYPE": "custom.Span", "begin": 0, "end": 0, "label": "broken"}]}


def test_cas_folder_and_archive(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "doc1.json").write_text(json.dumps(CAS))
    (tmp_path / "d" / "x.jsonl").write_text(json.dumps({"document_id": "j", "text": "a", "entities": []}))
    got = {r["document_id"]: r for r in annotations.folder(spark, str(tmp_path / "d")).collect()}
    assert [(g["start"], g["end"], g["entity_type"]) for g in got["doc1"]["gold"]] == [(8, 20, "PERSON_NAME"), (27, 37, "DATE_OF_BIRTH")] and len(got["doc1"]["warnings"]) == 1 and got["j"]["text"] == "a"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/doc2.json", json.dumps(CAS))
        z.writestr("__MACOSX/._doc2.json", "junk")
    (r,) = annotations.archive(spark, str(tmp_path / "z.zip")).collect()
    assert r["document_id"] == "doc2" and len(r["gold"]) == 2


def test_sinks(spark, tmp_path):
    gold = "array<struct<start:int,end:int,label:string,entity_type:string>>"
    df = spark.createDataFrame([("a", "Mail an a@b.de", [(8, 14, "m", "EMAIL")]), ("b", "Max", [(0, 3, "n", "PERSON_NAME")])], f"doc_id string, text string, gold {gold}")
    scored = deidentify.evaluated(df)
    sinks.report(scored, str(tmp_path / "r"))
    assert "text" not in json.dumps([r.asDict(True) for r in spark.read.json(str(tmp_path / "r/documents")).select("missed").collect()])
    assert spark.read.json(str(tmp_path / "r/aggregate")).first()["leaked_documents"] == 1
    assert "1 of 2 documents leak" in sinks.summary(scored)
    out = deidentify.deidentified(df)
    sinks.write_results(out, str(tmp_path / "j"))
    assert json.loads(spark.read.json(str(tmp_path / "j")).where("doc_id = 'a'").first()["result"])["anonymized_text"] == "Mail an [E-MAIL]"
    sinks.write_texts(out, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t/document=a")).first()[0] == "Mail an [E-MAIL]"
    assert evaluate.micro(scored).first()["gold_total"] == 2


def test_stream_equals_batch(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    keep = lambda d: deidentify.deidentified(d.select("doc_id", "text")).select("doc_id", "output", "validation_status")
    stream.start(stream.source(spark, str(tmp_path / "in"), docs.schema), str(tmp_path / "out"), str(tmp_path / "cp"), keep).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.exceptAll(keep(docs)).count() == 0 and got.count() == docs.count()
    stream.start(stream.source(spark, str(tmp_path / "in"), docs.schema), str(tmp_path / "lines"), str(tmp_path / "cp2"), keep, kind="json").awaitTermination(120)
    assert spark.read.json(str(tmp_path / "lines")).count() == docs.count()


def test_cache_lifetimes(spark):
    rows = [(1000.0, 1900.0, 1850.0, 50, True, 5450.0), (1000.0, 1900.0, 1900.0, 0, False, None), (0.0, 43200.0, 43000.0, 200, False, 43200.0)]
    df = spark.createDataFrame(rows, "created double, expires double, now double, remaining int, can boolean, new double")
    c, e, n = (F.col(k) for k in ("created", "expires", "now"))
    assert df.where(~(cache.remaining(e, n).eqNullSafe(F.col("remaining")) & cache.can_extend(c, e, n).eqNullSafe(F.col("can")) & cache.extended(c, e, n).eqNullSafe(F.col("new")))).count() == 0
    entries = spark.range(150).select(F.col("id").alias("key"), F.col("id").cast("double").alias("created"), (F.col("id") + 900.0).alias("expires"))
    alive = cache.lifetimes(entries, F.lit(910.0))
    assert alive.count() == 100 and alive.agg(F.min("key")).first()[0] == 50
