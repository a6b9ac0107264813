"""Scanned documents as PDF files again, rebuilt from the redacted text: each line where it was read, on A4.

Nothing of the original page is in the file. What is drawn is checked for every redacted text; a file in which one is still
readable isn't given out. Drawn areas take the characters under them away, and are then painted.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ocr, validate

WIDTH, HEIGHT, UNITS = 595.28, 841.89, 1000
SIZES, SPACING, LEAST_WIDTH, LEAST_HEIGHT = (11.0, 10.0, 9.0, 8.0, 7.0, 6.0), 1.25, 30.0, 8.0
NOTE = "Rebuilt from redacted text; this isn't the original page."
AREAS_DDL = "array<struct<page_number:int,x0:double,y0:double,x1:double,y1:double>>"
# Widths of the standard font's characters in thousandths of its size; accented letters are as wide as plain ones.
WIDTHS = {
    character: width
    for characters, width in {
        " !,./:;I[\\]ft": 278, '"': 355, "#$0123456789?L_abdeghnopqu": 556, "%": 889, "&ABEKPSVXY": 667, "'": 191, "()-`r": 333, "*": 389, "+<=>~": 584, "@": 1015,
        "CDHNRUw": 722, "FTZß": 611, "GOQ": 778, "Jckszvxy": 500, "Mm": 833, "W": 944, "^": 469, "ijl": 222, "{}": 334, "|": 260,
    }.items()
    for character in characters
}


def advance(text: str, size: float) -> float:
    """How wide a text is."""
    return sum(WIDTHS.get(unicodedata.normalize("NFD", c)[0], 556) for c in text) * size / 1000


def wrapped(text: str, size: float, width: float) -> list[str]:
    """Lines of whole words; a word that is wider stands alone."""
    lines: list[str] = []
    for word in text.split():
        if lines and advance(f"{lines[-1]} {word}", size) <= width:
            lines[-1] += f" {word}"
        else:
            lines.append(word)
    return lines


def fitted(text: str, width: float, height: float) -> tuple[float, list[str]]:
    """The largest size at which a text's lines fit a box, or the smallest."""
    for size in SIZES:
        lines = wrapped(text, size, width)
        if size <= height and len(lines) * size * SPACING <= 1.2 * height:
            return size, lines
    return SIZES[-1], wrapped(text, SIZES[-1], width)


def _kept(text: str, x: float, base: float, size: float, areas: list[tuple]) -> str:
    """A line with blanks for the characters that touch an area."""
    out = []
    for c in text:
        end = x + advance(c, size)
        under = any(a[0] < end and x < a[2] and a[1] < HEIGHT - base + 0.25 * size and HEIGHT - base - size < a[3] for a in areas)
        out.append(" " if under else c)
        x = end
    return "".join(out)


def _shown(text: str, x: float, y: float, font: str, size: float) -> str:
    escaped = "".join(f"\\{c}" if c in "()\\" else c for c in text)
    return f"BT /{font} {size:g} Tf {x:.2f} {y:.2f} Td ({escaped}) Tj ET\n"


def sheet(lines: list[dict], n_pages: int, areas: list[dict]) -> tuple[bytes, str]:
    """A PDF file of the lines, and all text that is drawn in it."""
    pages, drawn = [], []
    for number in range(1, max([n_pages, *(x["page_number"] for x in lines)], default=0) + 1):
        boxes = [(a["x0"] * WIDTH, a["y0"] * HEIGHT, a["x1"] * WIDTH, a["y1"] * HEIGHT) for a in areas if a["page_number"] == number]
        ops = ["0.5 g\n" + _shown(NOTE, 24, HEIGHT - 16, "F2", 7) + "0 g\n"]
        for line in (x for x in lines if x["page_number"] == number):
            width, height = max((line["x2"] - line["x1"]) / UNITS * WIDTH, LEAST_WIDTH), max((line["y2"] - line["y1"]) / UNITS * HEIGHT, LEAST_HEIGHT)
            size, parts = fitted(line["text"], width, height)
            x, top = line["x1"] / UNITS * WIDTH, line["y1"] / UNITS * HEIGHT
            for i, part in enumerate(parts):
                base = HEIGHT - top - (i + 1) * size * SPACING + 0.2 * size
                part = _kept(part, x, base, size, boxes)
                drawn.append(part)
                ops.append(_shown(part, x, base, "F1", size))
        ops += [f"{a:.2f} {HEIGHT - d:.2f} {c - a:.2f} {d - b:.2f} re f\n" for a, b, c, d in boxes]
        pages.append("".join(ops).encode("latin-1", "replace"))
    fonts = [f"<< /Type /Font /Subtype /Type1 /BaseFont /{name} /Encoding /WinAnsiEncoding >>".encode() for name in ("Helvetica", "Helvetica-Oblique")]
    kids = " ".join(f"{5 + 2 * i} 0 R" for i in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode(), *fonts]
    for i, page in enumerate(pages):
        packed = zlib.compress(page)
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {WIDTH} {HEIGHT}] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents {6 + 2 * i} 0 R >>".encode())
        objects.append(f"<< /Length {len(packed)} /Filter /FlateDecode >>\nstream\n".encode() + packed + b"\nendstream")
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
    start = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010} 00000 n \n".encode() for p in places)
    out += f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode()
    return bytes(out), "\n".join(drawn)


def _sheets(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    listed = lambda x: [] if x is None else [dict(e) for e in x]
    for lines, n_pages, areas, _ in batches:
        yield pd.DataFrame([sheet(listed(x), int(n), listed(a)) if len(listed(x)) else (None, "") for x, n, a in zip(lines, n_pages, areas)], columns=["content", "drawn"])


def rebuilt(df: DataFrame, text: str = "text", applied: str = "applied", layout: str = "layout", pages: str = "pages", areas: str | None = None, to: str = "pdf") -> DataFrame:
    """``df`` with a PDF file of each document and ``pdf_error``: without a layout, or where a redacted text can still be read, there is none.

    ``areas`` names a column of areas with their pages, in shares of the page.
    """
    line = lambda x: F.struct(*(x[c] for c in ("page_number", "x1", "y1", "x2", "y2")), ocr.latin1(ocr.line_text(F.col(text), x, F.col(applied))).alias("text"))
    out = df.withColumn("lines_", F.transform(layout, line))
    make = F.pandas_udf(_sheets, "struct<content:binary,drawn:string>")
    # the lines are named twice, so that what computes them isn't moved into the arguments: Spark can't take lambdas within lambdas there
    out = out.withColumn("sheet_", make(F.col("lines_"), F.coalesce(F.size(pages), F.lit(0)), F.col(areas) if areas else F.lit(None).cast(AREAS_DDL), F.size("lines_")))
    left = F.exists(validate.needles(F.col(applied)), lambda n: validate.survives(F.col("sheet_.drawn"), n) | validate.survives(F.col("sheet_.drawn"), ocr.latin1(n)))
    why = F.when(F.col("sheet_.content").isNull(), "there is no layout").when(left, "a redacted text can still be read")
    return out.withColumn("pdf_error", why).withColumn(to, F.when(F.col("pdf_error").isNull(), F.col("sheet_.content"))).drop("lines_", "sheet_")
