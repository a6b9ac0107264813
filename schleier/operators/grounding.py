"""Grounding: where in a text the mentions are that a model reported. Sequential by nature, so an Arrow UDF a document.

A mention is looked for exactly, then with any white space, then in any case; then with umlauts and digraphs
exchanged, then across hyphens at line ends; last without its leading words. Mentions other than names also cover
other cases of their text. The words of names of several words are looked for by themselves outside what is
covered. What can't be found gets a notice that names the type only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.notices import notice
from ..types import METADATA, SPAN_DDL

LEAST_MENTION, LEAST_TRIMMED, LEAST_FUZZY, LEAST_PART, CONFIDENCE = 2, 4, 5, 3, 0.9
# Words of names that say nothing by themselves.
TITLES = frozenset("herr herrn frau fräulein familie dr prof med phil dent rer nat dipl univ pd von van de zu der und".split())
# Umlauts and the digraphs that stand for them.
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue", "ß": "ss"}
EDGES = ".,;:()"
Place = tuple[int, int]


def bounded(text: str, place: Place) -> bool:
    """No letter or digit touches the place; an underscore may."""
    a, b = place
    return not (text[a - 1 : a].isalnum() or text[b : b + 1].isalnum())


@dataclass(frozen=True)
class Reading:
    """A way to read a mention: a pattern whose group 1 is the place, whether letters may touch it, and whether it only resembles the mention."""

    pattern: str
    any_case: bool = False
    whole: bool = False
    resembles: bool = False

    def places(self, text: str) -> list[Place]:
        found = (m.span(1) for m in re.finditer(self.pattern, text, re.I if self.any_case else 0))
        return [p for p in found if not self.whole or bounded(text, p)]


def exactly(needle: str) -> str:
    """Every occurrence, overlapping ones too."""
    return f"(?=({re.escape(needle)}))"


def spaced(words: list[str]) -> str:
    """The words with any white space between them."""
    return "(" + r"\s+".join(map(re.escape, words)) + ")"


def spelled(needle: str, **more: bool) -> Iterator[Reading]:
    """A spelling as it is, with other white space, and in another case."""
    yield Reading(exactly(needle), **more)
    if words := needle.split():
        yield Reading(spaced(words), **more)
        yield Reading(spaced(words), any_case=True, **more)


def readings(needle: str) -> Iterator[Reading]:
    """The ways to read a mention, the likeliest first."""
    yield from spelled(needle)
    to, back = needle, needle
    for umlaut, digraph in UMLAUTS.items():
        to, back = to.replace(umlaut, digraph), back.replace(digraph, umlaut)
    for other in dict.fromkeys((to, back)):
        if other != needle:
            yield from spelled(other, resembles=True)
    words = needle.split()
    if len(needle) >= LEAST_FUZZY:
        broken = (r"(?:-\s*)?".join(map(re.escape, w)) for w in words)
        yield Reading("(" + r"\s+".join(broken) + ")", whole=True, resembles=True)
    for k in range(1, len(words)):
        if len(rest := " ".join(words[k:])) < LEAST_TRIMMED:
            return
        yield from spelled(rest, whole=True, resembles=True)


def telling(words: list[str]) -> list[str]:
    """Words without edges of punctuation, titles left out."""
    return [c for w in words if (c := w.strip(EDGES)) and c.lower().strip(".") not in TITLES]


def tag_group(name: str) -> str:
    """What mentions of one person share: the name without titles, case folded."""
    return re.sub(r"\s+", " ", " ".join(telling(name.split())) or name).strip().casefold()


def ground(text: str, mentions: list[dict]) -> tuple[list[dict], list[str]]:
    """Spans in the order in which they are found, and the types of the mentions that weren't."""
    spans: list[dict] = []
    lost: list[str] = []
    seen: set[tuple[int, int, str]] = set()

    def add(place: Place, mention: dict, how: str | None) -> None:
        kind = mention["entity_type"]
        if (*place, kind) in seen:
            return
        seen.add((*place, kind))
        meta = dict.fromkeys(METADATA) | {"role": mention.get("role") or None, "grounding": how, "tag_group": tag_group(mention["text"]) if kind == "PERSON_NAME" else None}
        spans.append({"start": place[0], "end": place[1], "text": text[slice(*place)], "entity_type": kind, "confidence": CONFIDENCE, "detector": "llm", "ordinal": len(spans), "metadata": meta})

    for m in mentions:
        needle = (m["text"] or "").strip()
        if len(needle) < LEAST_MENTION:
            continue
        places, resembling = next(((found, r.resembles) for r in readings(needle) if (found := r.places(text))), ([], False))
        if not places:
            lost.append(m["entity_type"])
            continue
        if m["entity_type"] != "PERSON_NAME":
            places += [p for p in Reading(spaced(needle.split()), any_case=True, whole=True).places(text) if p not in places]
        for p in places:
            add(p, m, "partial" if resembling else None)
    covered = [(s["start"], s["end"]) for s in spans]
    for m in mentions:
        words = (m["text"] or "").split()
        if m["entity_type"] != "PERSON_NAME" or len(words) < 2:
            continue
        for word in telling(words):
            if len(word) < LEAST_PART:
                continue
            for p in Reading(exactly(word), whole=True).places(text):
                if not any(a <= p[0] and p[1] <= b for a, b in covered):
                    if (*p, "PERSON_NAME") not in seen:
                        covered.append(p)
                    add(p, m, "name_part")
    return spans, lost


def grounded(df: DataFrame, text: str = "text", mentions: str = "mentions", spans: str = "mention_spans", notices: str = "mention_notices") -> DataFrame:
    """``df`` with the spans of its mentions (array<struct<text, entity_type, role>>), and a notice for each that isn't in the text."""
    out = f"struct<spans:array<{SPAN_DDL}>,lost:array<string>>"

    @F.pandas_udf(out)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, lists, *_ in batches:
            rows = [ground(t or "", [dict(m) for m in (ms if ms is not None else [])]) for t, ms in zip(texts, lists)]
            yield pd.DataFrame({"spans": [r[0] for r in rows], "lost": [r[1] for r in rows]})

    lost = F.transform(F.col("grounded_.lost"), lambda k: notice("llm_mention_not_located", entity_type=k))
    # each is named twice, so that what computes it isn't moved into the arguments: Spark can't take lambdas within lambdas there
    return df.withColumn("grounded_", run(F.col(text), F.col(mentions), F.length(text), F.size(mentions))).withColumns({spans: F.col("grounded_.spans"), notices: lost}).drop("grounded_")
