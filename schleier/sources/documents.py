"""Documents from files. What can't be read is an error of that document, in a column; a missing library fails the query."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import astuple, fields
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.notices import none
from ..types import MESSAGES
from . import pdf

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MOST_BYTES, MOST_CHARS = 20 << 20, 500_000


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, source_type, content) of txt, docx and pdf files; ``source_type`` is null for others."""
    raw = spark.read.format("binaryFile").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return raw.select("path", F.when(suffix.isin("txt", "docx", "pdf"), suffix).alias("source_type"), "content")


def decoded(content: Column) -> Column:
    """Strict UTF-8 without its byte-order mark; null where bytes are 0 or not UTF-8."""
    text = F.try_validate_utf8(content.cast("string"))
    return F.when(~has_nul(content), F.regexp_replace(text, "^\ufeff", ""))


def has_nul(content: Column) -> Column:
    return F.contains(content, F.unhex(F.lit("00")))


def _paragraph(p: ElementTree.Element) -> str:
    """A paragraph's text without that of the boxes anchored in it."""
    parts, todo = [], [p]
    while todo:
        e = todo.pop()
        if e.tag == f"{W}t":
            parts.append(e.text or "")
        elif e.tag == f"{W}tab" and e is not p:
            parts.append("\t")
        elif e.tag in (f"{W}br", f"{W}cr"):
            parts.append("\n")
        if e.tag not in (f"{W}txbxContent", f"{W}pPr"):
            todo += reversed(e)
    return "".join(parts)


def _paragraphs(cell: ElementTree.Element) -> list[str]:
    out, todo = [], [cell]
    while todo:
        e = todo.pop()
        if e.tag == f"{W}p":
            out.append(_paragraph(e))
        else:
            todo += reversed(e)
    return out


def _body(root: ElementTree.Element) -> list[str]:
    out = []
    for e in root:
        if e.tag == f"{W}p":
            out.append(_paragraph(e))
        elif e.tag == f"{W}tbl":
            out += [" | ".join(" ".join(_paragraphs(c)).strip() for c in row.findall(f"{W}tc")) for row in e.findall(f"{W}tr")]
    return out


def docx(content: bytes) -> tuple[str | None, str | None, list[str]]:
    """Headers, body in its order with table rows as 'cell | cell', footers; (text, error, notices)."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            part = lambda n: ElementTree.fromstring(z.read(n))
            body = part("word/document.xml")
            raw = z.read("word/document.xml").decode("utf-8", "replace")
            lines = [x for n in sorted(names) if re.fullmatch(r"word/header\d*\.xml", n) for x in _body(part(n))]
            lines += _body(body.find(f"{W}body"))
            lines += [x for n in sorted(names) if re.fullmatch(r"word/footer\d*\.xml", n) for x in _body(part(n))]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError) as e:
        return None, f"not a readable docx: {e}", []
    found = {"docx_comments": "word/comments.xml" in names, "docx_tracked_changes": "<w:ins " in raw, "docx_tracked_deletions": "<w:del " in raw, "docx_text_boxes": "txbxContent" in raw}
    text = "\n".join(x for x in lines if x.strip())
    return (text, None, [k for k, there in found.items() if there]) if text else (None, "the document has no text", [])


def _reader(settings: pdf.Settings):
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for kinds, contents in batches:
            rows = []
            for kind, content in zip(kinds, contents):
                if content is None:
                    rows.append(pdf.Read())
                elif kind == "docx":
                    text, error, codes = docx(content)
                    rows.append(pdf.Read(text, error, [(c, MESSAGES[c], {}) for c in codes]))
                else:
                    rows.append(pdf.read(content, settings))
            yield pd.DataFrame([astuple(r) for r in rows], columns=[f.name for f in fields(pdf.Read)])

    return F.pandas_udf(read, pdf.READ_DDL)


def extracted(df: DataFrame, settings: pdf.Settings | None = None) -> DataFrame:
    """``files`` rows with ``text``, ``error``, ``notices``, ``pages`` (offsets in the text) and ``scanned``; files of other kinds and over the
    limits are errors. Files are read once: texts in SQL, the others in an Arrow UDF that sees nothing of the rest.

    A scanned PDF that a model has to read is neither text nor error: ``pdf.transcribed`` takes it from there.
    """
    kind, small = F.col("source_type"), F.octet_length("content") <= MOST_BYTES
    packed = small & kind.isin("docx", "pdf")
    out = df.withColumn("read_", _reader(settings or pdf.Settings())(F.when(packed, kind), F.when(packed, F.col("content"))))
    valid = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.when(small & (kind == "txt"), decoded(F.col("content"))).otherwise(F.col("read_.text"))
    long, blank = F.length(text) > MOST_CHARS, ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))
    why = (
        F.when(kind.isNull(), "this kind of file isn't supported")
        .when(~small, "it is larger than the limit")
        .when((kind == "txt") & has_nul(F.col("content")), "it has NUL bytes")
        .when((kind == "txt") & valid.isNull(), "it isn't UTF-8")
        .when(F.col("read_.error").isNotNull(), F.col("read_.error"))
        .when(long, "its text is longer than the limit")
        .when(blank & ~F.coalesce("read_.scanned", F.lit(False)), "it has no text")
    )
    return out.withColumn("error", why).select("path", "source_type", F.when(F.col("error").isNull(), text).alias("text"), "error", F.coalesce("read_.notices", none()).alias("notices"), F.coalesce("read_.pages", F.array().cast(pdf.PAGES_DDL)).alias("pages"), F.coalesce("read_.scanned", F.lit(False)).alias("scanned"))
