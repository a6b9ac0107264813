"""PDF files: which have text of their own, how the others are read, and the pages of both.

What touches the outside is a function that the caller gives: a converter, a renderer, a transcriber. Without one, and without
the library that would stand in for it, reading fails; it never gives empty text. Nothing that has ink is passed off as an empty page.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from importlib.util import find_spec

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.notices import notice
from ..operators import ocr
from ..types import MESSAGES, NOTICE_DDL

PAGES_DDL = "array<struct<page_number:int,start:int,end:int>>"
READ_DDL = f"struct<text:string,error:string,notices:array<{NOTICE_DDL}>,pages:{PAGES_DDL},scanned:boolean>"
ENGINES = ("none", "docling_tesseract", "llm_vision")
#: Between pages of a text.
BREAK = "\n\n"
#: Share of dark pixels from which a page isn't blank.
INK = 0.002


class Refused(ValueError):
    """An error of a document, not of the run."""


class ConversionFailed(Exception):
    """Raised by a converter that can't convert."""


@dataclass(frozen=True)
class Settings:
    """How PDF files are read. ``convert(content, ocr)`` gives a conversion service's answer as a dict, ``pages(content)`` a file's page texts."""

    engine: str = "none"
    force_ocr: bool = False
    least_chars: int = 100
    sampled: int = 8
    convert: Callable[[bytes, bool], dict] | None = None
    pages: Callable[[bytes], list[str]] | None = None


@dataclass
class Read:
    text: str | None = None
    error: str | None = None
    notices: list[tuple] = field(default_factory=list)
    pages: list[tuple[int, int, int]] = field(default_factory=list)
    scanned: bool = False


def sampled_pages(n: int, most: int) -> list[int]:
    """At most ``most`` evenly spaced pages of n."""
    if min(n, most) <= 1:
        return [0][: min(n, most)]
    return list(range(n)) if n <= most else sorted({round(i * (n - 1) / (most - 1)) for i in range(most)})


def has_text(text: str, least: int = 100) -> bool:
    """Whether embedded text is more than marks of layout."""
    return len(" ".join(re.sub(r"[#*_`>\-|:\[\](){}]+", " ", text).split())) >= least


def embedded(pages: list[str], settings: Settings) -> bool:
    """Whether the sampled pages have text enough."""
    return has_text("\n".join(pages[i] for i in sampled_pages(len(pages), settings.sampled)), settings.least_chars)


def page_texts(content: bytes) -> list[str]:
    """Each page's embedded text; needs pypdf, which fails loudly where it isn't installed."""
    if find_spec("pypdf") is None:
        raise RuntimeError("reading PDF needs pypdf, which isn't installed")
    import pypdf

    try:
        reader = pypdf.PdfReader(io.BytesIO(content))
        if reader.is_encrypted and not reader.decrypt(""):
            raise Refused("the PDF is encrypted")
    except pypdf.errors.PyPdfError as e:
        raise Refused("not a readable PDF") from e
    out = []
    for page in reader.pages:
        try:
            out.append(page.extract_text() or "")
        except Exception:  # one broken page doesn't hide the others
            out.append("")
    return out


def joined(pages: list[str]) -> tuple[str, list[tuple[int, int, int]]]:
    """The text of the pages, and where each is in it."""
    clean = [re.sub(r"\r\n?", "\n", p).replace("\0", "") for p in pages]
    ends = np.cumsum([len(p) for p in clean]) + len(BREAK) * np.arange(len(clean))
    return BREAK.join(clean), [(i, int(e) - len(p), int(e)) for i, (p, e) in enumerate(zip(clean, ends), 1)]


def picked(answer: dict) -> str:
    """The text in a conversion service's answer, whose form depends on its version: the first that isn't blank."""
    inner = answer.get("document")
    # Where the text may be.
    for part in (answer, inner if isinstance(inner, dict) else {}):
        for key in ("md_content", "markdown", "text_content", "text", "content"):
            if isinstance(part.get(key), str) and part[key].strip():
                return part[key].strip()
    raise ConversionFailed("the answer has no text")


def read(content: bytes, settings: Settings) -> Read:
    """A file's own text, by the converter or else page by page; of a file without, what the engine makes of it."""
    told = lambda code, **params: (code, MESSAGES[code].format(**params), params)
    try:
        if settings.engine not in ENGINES:
            raise ValueError(f"no such engine: {settings.engine}")
        local = settings.pages or page_texts
        pages = None if settings.force_ocr else local(content)
        if pages is not None and embedded(pages, settings):
            try:
                if settings.convert:
                    return Read(picked(settings.convert(content, False)), None, [told("pdf_no_page_mapping")])
                notices = []
            except ConversionFailed as e:
                notices = [told("pdf_docling_fallback", reason=str(e))]
            text, places = joined(pages)
            return Read(text, None, notices, places)
        if settings.engine == "none":
            raise Refused("OCR was asked for, but there is no engine" if settings.force_ocr else "it has no text of its own, and there is no OCR engine")
        if settings.engine == "llm_vision":
            return Read(scanned=True)
        if settings.convert is None:
            raise RuntimeError("the engine docling_tesseract needs a converter")
        try:
            return Read(picked(settings.convert(content, True)), None, [told("ocr_recognition_errors")])
        except ConversionFailed as e:
            raise Refused(f"OCR failed: {e}") from e
    except Refused as e:
        return Read(error=str(e))


# --- scanned pages


def dark_share(gray: np.ndarray) -> float:
    """The share of dark pixels of a page in shades of grey from 0 to 255."""
    return float((gray < 128).mean()) if gray.size else 0.0


def rendered(files: DataFrame, render: Callable[[bytes], list[tuple[bytes, float]]]) -> DataFrame:
    """(path, page_number, image, ink): a row for each page of each file; ``render`` gives a file's pages as images with their shares of dark pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                yield pd.DataFrame([(path, i, image, ink) for i, (image, ink) in enumerate(render(content), 1)], columns=["path", "page_number", "image", "ink"])

    return files.select("path", "content").mapInPandas(run, "path string, page_number int, image binary, ink double")


@dataclass(frozen=True)
class Profile:
    """A model that reads pages. What a profile leaves out it has from the one that it is based on."""

    name: str = ""
    model: str = ""
    dialect: str = "plain"
    api_base: str | None = None
    api_key: str | None = None
    prompt: str = ""
    fallback_prompt: str = ""
    max_tokens: int | None = None
    extra_body: dict | None = None


def profiles(listed: str | None, base: Profile) -> list[Profile]:
    """The profiles of a JSON list, based on ``base``; a key or a dialect that isn't known, or a name that comes twice, is refused."""
    if not (listed or "").strip():
        return []
    try:
        entries = json.loads(listed)
    except json.JSONDecodeError as e:
        raise ValueError("the profiles aren't JSON") from e
    if not isinstance(entries, list) or not all(isinstance(e, dict) for e in entries):
        raise ValueError("the profiles aren't a list of objects")
    out = []
    for entry in entries:
        if unknown := set(entry) - set(Profile.__dataclass_fields__):
            raise ValueError(f"no such key of a profile: {sorted(unknown)}")
        given = {k: v for k, v in entry.items() if v is not None}
        for key, value in given.items():
            kind = dict if key == "extra_body" else int if key == "max_tokens" else str
            if not isinstance(value, kind) or isinstance(value, bool) or key == "max_tokens" and value < 256:
                raise ValueError(f"not a {key}: {value!r}")
        if not 1 <= len(given.get("name", "")) <= 64 or not given.get("model"):
            raise ValueError("a profile needs a name and a model")
        out.append(replace(base, **given))
    if len({p.name for p in out}) < len(out):
        raise ValueError("two profiles have the same name")
    for p in out:
        if p.dialect not in ocr.DIALECTS:
            raise ValueError(f"no such dialect: {p.dialect}")
    return out


def chosen(listed: str | None, base: Profile, name: str | None = None) -> Profile:
    """The profile of a name, the first without one, ``base`` where none is listed; a name that isn't listed is refused, never replaced."""
    known = profiles(listed, base)
    if not name:
        return known[0] if known else base
    for p in known:
        if p.name == name:
            return p
    raise ValueError(f"no such profile: {name}")


def transcribed(pages: DataFrame, transcribe: Callable[[bytes, str], str], profile: Profile) -> DataFrame:
    """``pages`` (with image and ink) with the ``lines`` of each page and its ``page_error``.

    A page with ink of which nothing is read is asked about once more with the profile's other prompt; if there is still nothing, it
    is an error. Each page goes through both steps in one plan, so that what the model said isn't asked for again.
    """

    def ask(df: DataFrame, prompt: str, when: str | None, to: str) -> DataFrame:
        schema = T.StructType([*df.schema.fields, T.StructField(to, T.StringType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                wanted = b.column(when).to_pylist() if when else [True] * b.num_rows
                said = [transcribe(image, prompt) if w else None for image, w in zip(b.column("image").to_pylist(), wanted)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string())], schema.names)

        return df.mapInArrow(run, schema)

    blank = lambda c: ~F.exists(c, lambda x: x["text"].rlike(r"(?U)\S"))
    inked = F.coalesce(F.col("ink") > INK, F.lit(True))
    out = ocr.transcribed(ask(pages, profile.prompt, None, "raw_"), profile.dialect, "raw_", "lines").drop("raw_")
    out = out.withColumn("again_", blank("lines") & inked)
    if profile.fallback_prompt.strip():
        out = ocr.transcribed(ask(out, profile.fallback_prompt, "again_", "raw_"), profile.dialect, "raw_", "second_")
        out = out.withColumn("lines", F.when(F.col("again_"), F.col("second_")).otherwise(F.col("lines"))).drop("raw_", "second_")
    why = F.when(blank("lines") & inked, F.concat(F.lit("nothing was read on page "), F.col("page_number").cast("string"), F.lit(", which isn't blank")))
    return out.withColumn("page_error", why).drop("again_", "image")


def scans(pages: DataFrame, doc: str = "path") -> DataFrame:
    """(doc, text, pages, layout, error, notices) of ``transcribed`` pages: a document with a page that failed has no text."""
    failed = pages.groupBy(doc).agg(F.min_by("page_error", F.when(F.col("page_error").isNotNull(), F.col("page_number"))).alias("error"))
    put = ocr.assembled(pages, doc).join(failed, doc)
    error = F.coalesce("error", F.when(~F.col("text").rlike(r"(?U)\S"), "nothing was read"))
    out = put.withColumn("error", error)
    return out.withColumns({"text": F.when(F.col("error").isNull(), F.col("text")), "notices": F.when(F.col("error").isNull(), F.array(notice("ocr_recognition_errors"))).otherwise(F.array().cast(f"array<{NOTICE_DDL}>"))})
