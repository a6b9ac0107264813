"""Text functions as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import METADATA


def normalized(text: Column) -> Column:
    """White space collapsed, trimmed, case folded (ß as ss)."""
    return F.replace(F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " "))), F.lit("ß"), F.lit("ss"))


def metadata(**known: Column | str) -> Column:
    """The metadata struct with the given fields, the others null."""
    value = lambda k: known[k] if isinstance(known.get(k), Column) else F.lit(known.get(k))
    return F.struct(*(value(k).cast("string").alias(k) for k in METADATA))


FOUND = "array<struct<start:int,end:int,text:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: what a lambda refers to outside is computed anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blocks(items: Column) -> Column:
    """An array as arrays of about as many elements as there are arrays, so that a fold that copies what it has takes n ** 1.5 steps."""

    def cut(x: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(x))), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(x) - 1) / size), F.lit(0)).cast("int")), lambda i: F.slice(x, i * size + 1, size))

    return bound(items, cut)


def sums_before(numbers: Column) -> Column:
    """For each of some integers the sum of those before it."""

    def running(x: Column, start: Column) -> Column:
        return F.aggregate(x, F.array(start), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))

    def placed(parts: Column) -> Column:
        totals = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda a, v: a + v))
        return bound(running(totals, F.lit(0)), lambda at: F.flatten(F.transform(parts, lambda part, i: F.slice(running(part, F.get(at, i)), F.lit(1), F.size(part)))))

    return bound(blocks(numbers), placed)


def folded(items: Column, state: Column, step: Callable[[Column, Column], Column], out: Iterable[tuple[str, str]]) -> Column:
    """A fold that gives things out: ``step(state, item)`` is a struct of ``state`` and of an array for each
    (name, type) in ``out``.

    The result is the last state and all arrays put together. It goes block by block, so that no long array is copied for each item.
    """
    kinds = dict(out)

    def run(block: Column, first: Column) -> Column:
        begin = F.struct(first.alias("state"), *(F.array().cast(f"array<{kind}>").alias(name) for name, kind in kinds.items()))

        def one(acc: Column, item: Column) -> Column:
            return bound(step(acc["state"], item), lambda r: F.struct(r["state"].alias("state"), *(F.concat(acc[name], r[name]).alias(name) for name in kinds)))

        return F.aggregate(block, begin, one)

    def whole(parts: Column) -> Column:
        begin = F.struct(state.alias("state"), *(F.array().cast(f"array<array<{kind}>>").alias(name) for name, kind in kinds.items()))
        join = lambda acc, block: bound(run(block, acc["state"]), lambda r: F.struct(r["state"].alias("state"), *(F.concat(acc[name], F.array(r[name])).alias(name) for name in kinds)))
        return F.aggregate(parts, begin, join, lambda acc: F.struct(acc["state"].alias("state"), *(F.flatten(acc[name]).alias(name) for name in kinds)))

    return bound(blocks(items), whole)


def greatest_before(numbers: Column) -> Column:
    """For each of some integers the greatest of those before it, 0 at least."""
    out = folded(numbers, F.lit(0), lambda top, n: F.struct(F.greatest(top, n).alias("state"), F.array(top).alias("out")), [("out", "int")])
    return out["out"]


def cuttable(text: Column) -> Column:
    """A text as bytes in which each code point has the same place whatever comes before it; ``cut`` takes pieces of it."""
    return F.encode(text, "UTF-32")


def cut(bytes_: Column, start: Column, end: Column) -> Column:
    """The code points from start to before end of a text that is ``cuttable``."""
    return F.decode(F.substring(bytes_, start * 4 + 1, (end - start) * 4), "UTF-32")


def present(text: Column, anchor: str | tuple[str]) -> Column:
    """Whether an anchor is in a text; a literal comes in a tuple."""
    return F.contains(text, F.lit(anchor[0])) if isinstance(anchor, tuple) else text.rlike(anchor)


PIECES = "struct<gap:array<string>,whole:array<string>,part:array<string>>"


def pieces(text: Column, pattern: str, group: int = 0, anchor: str | tuple[str] = "") -> Column:
    """The text between matches (split), the matches, and a group of each; null where there is none.

    The pattern runs only where the anchor is, and again only where it matches at all.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    there = present(text, anchor) & text.rlike(pattern) if anchor else text.rlike(pattern)
    return F.when(there, F.struct(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), part.alias("part")))


def placed(found: Column) -> Column:
    """array<struct<start, end, text>> of ``pieces``: gaps and matches alternate, so that sums of their lengths give the code-point
    offsets. A group's span must end where the match ends; empty ones are left out."""

    def one(p: Column) -> Column:
        end = p["at"] + F.length(p["gap"]) + F.length(p["whole"])
        return F.struct((end - F.length(p["part"])).alias("start"), end.alias("end"), p["part"].alias("text"))

    gap, whole = F.slice(found["gap"], 1, F.size(found["whole"])), found["whole"]
    lengths = F.zip_with(gap, whole, lambda a, b: F.length(a) + F.length(b))
    spans = F.transform(F.arrays_zip(sums_before(lengths).alias("at"), gap.alias("gap"), whole.alias("whole"), found["part"].alias("part")), one)
    return F.filter(spans, lambda s: s["start"] < s["end"]).cast(FOUND)


def matches(text: Column, pattern: str, group: int = 0, anchor: str | tuple[str] = "") -> Column:
    """array<struct<start, end, text>> of the leftmost non-overlapping matches, without Python."""
    none = F.array().cast(FOUND)
    return bound(pieces(text, pattern, group, anchor), lambda p: F.when(p.isNull(), none).otherwise(placed(p)))


def content_digest(content: Column) -> Column:
    """SHA-256 of a file's bytes or a text, in lower-case hexadecimal digits."""
    return F.sha2(content.cast("binary"), 256)


def log_reference(value: Column) -> Column:
    """A short handle for log lines that doesn't lead back to the value."""
    return F.left(content_digest(value), F.lit(12))


def literal(term: str) -> str:
    """A term as a pattern."""
    return r"\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E"


def word_bounded(term: str) -> str:
    """A term, in any case, that no word character touches."""
    return rf"(?iuU)(?<!\w){literal(term)}(?!\w)"
