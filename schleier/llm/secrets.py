"""Secret scans: fixed shapes, and an assignment-aware lexer.

Base spans, found in every text, leftmost and non-overlapping in each kind: ``assign`` (a telling name, a sign,
a value of 6 characters or more), ``access`` (AKIA and upper-case letters or digits, 20 characters or more) and
``hex`` (24 lower-case hexadecimal digits or more).

The lexer adds ``lex`` spans. It parses name-literal pairs of source and configuration syntax and has three states.

* *Seek*: to the next name with a sign (``name =``, ``"name":``, ``name :=``, ``name =>``, ``a.b["name"] =``, ``--name=``)
  or the next bracket. Open brackets and YAML's indentation tell the name that a pair lies under.
* *Value*: a quoted literal (with one or three quotes, closed or up to the end of its line or the text), a bare word, a
  constant's name, a list of literals, or a YAML block. It may follow on a later line, after comments.
* *Join*: literals and constants joined by a sign, or by standing side by side.

A pair whose value names an earlier pair gets that one's literals. A literal is scored by the words of the names that
it reaches, with the name that its pair lies under, and by its own shape. Literals scoring at least ``THRESHOLD``
that base spans don't cover become spans. Literals are searched for pairs in turn. No length is bounded, and each
state only moves on, so that lexing takes time in proportion to the text; a constant is followed once for each weight of the names
that are given it as a whole, and anew where it is joined with others.

Byte scans find the documents where anything can match; those alone are decoded. Positions are code points, end
exclusive. Null and empty texts have no spans; equal texts, ties and repeated rows have equal spans; an empty table
gives an empty one. New columns replace those of the same name; ``redact`` keeps all columns.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, table, utf8, words_of

KINDS = ("assign", "access", "hex", "lex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
IS_HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))

BLANK = re.compile(r"[ \t]*+")
NAME = r"[A-Za-z_][\w.-]*+"
#: A name with its sign, or a bracket. Possessive repeats never go back.
SEEK = re.compile(rf"""(?P<name>(?:(?<![\w.-])|(?<=[\s"'`]--)|(?<=[\s"'`]-)|(?<=\A--)|(?<=\A-))(?P<q>["'`]?)(?P<own>{NAME})(?P=q)(?P<items>(?:\[[ \t]*+["']?[\w.-]++["']?[ \t]*+\])*+))[ \t]*+(?P<sign>:=|=>|[=!]==?|=|:(?!:))|(?P<open>[({{\[])|(?P<close>[)}}\]])""")
CLOSES = {")": "(", "]": "[", "}": "{"}
#: Nothing but a comment up to the line's end, then empty lines, comments, and the next line's blanks.
BREAK = re.compile(r"""(?:(?:\#|//|--)[ \t][^\n]*+|\\)?\r?\n(?:[ \t]*+(?:(?:\#|//|--)[ \t][^\n]*+)?\r?\n)*+([ \t]*+)""")
QUOTED = re.compile(r""""[^"\\\n]*+(?:\\.[^"\\\n]*+)*+("?)|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+('?)|`[^`]*+(`?)""")
PREFIX = re.compile(r"""[rbfuRBFUL@$]{0,2}(?=["'`])""")
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>|&]++""")
#: A word of its own line.
ALONE = re.compile(r"""([^\s"'`,;(){}\[\]<>|&:]++)[ \t]*+(?:\r?\n|\Z)""")
SCALAR = re.compile(r"[|>][+-]?\d?[+-]?[ \t]*+(?:\#[^\n]*+)?\r?\n")
LINE = re.compile(r"([ \t]*+)([^\n]*+)(?:\n|\Z)")
JOIN = re.compile(r"""[ \t]*+(?:(?:\+|\.\.|&|\|\|)[ \t]*+(?:\\?\r?\n[ \t]*+)?|\.[ \t]++|\\\r?\n[ \t]*+)(?=["'`A-Za-z_])|[ \t]++(?=["'`])""")
WORD = re.compile(r"[A-Za-z_][\w.]*+")
BETWEEN = re.compile(r"[\s,]*+")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: Weight of a word, or of two words in a row, in a target's name.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.6, "api key": 1.0, "access key": 1.0, "private key": 1.0, "signing key": 0.9, "encryption key": 0.9, "license key": 0.8, "connection string": 0.8}
PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|-+|_+|none|null|nil|true|false|todo|changeme|example|placeholder|redacted|undefined|your[\w-]*|<.*|\$\{.*|\{\{.*|%\(.*|env\(.*|process\..*|os\.\w.*)$", re.I)
THRESHOLD = 0.5

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


#: Names that say nothing of their own, and last words of names that aren't of secrets but about them.
GENERIC = frozenset("value val data default content current string plain raw text".split())
ABOUT = frozenset("expiry expires expiration type url uri path file filename name length size count ttl endpoint hint policy pattern regex label field header".split())


def name_words(name: str) -> list[str]:
    return [w.lower() for w in PARTS.findall(name)]


def name_weight(name: str, under: str = "") -> float:
    """0 to 1: how sensitive a name is, as one under another; the last word of that and the first of this may be read together."""
    own = name_words(name)
    outer = name_words(under)
    if not own or all(w in GENERIC for w in own):
        own, outer = outer, []
    if own and own[-1] in ABOUT:
        return 0.0
    words = outer[-1:] + own
    pairs = [" ".join(p) for p in zip(words, words[1:])]
    every = [w for x in (*own, *pairs, "".join(own)) for w in (x, x.removesuffix("s"))]
    return max((SENSITIVE.get(w, 0.0) for w in every), default=0.0)


def literal_weight(text: str) -> float:
    """0 to 1: long, mixed and irregular literals are likelier secrets; placeholders and prose are none. Lines are read as one."""
    if "\n" in text:
        text = "".join(line.strip() for line in text.split("\n") if not line.strip().startswith("-----"))
    n = len(text)
    if n < 6 or PLACEHOLDER.match(text) or any(c.isspace() for c in text):
        return 0.0
    bits = -sum(k / n * math.log2(k / n) for k in Counter(text).values())
    classes = sum(bool(re.search(p, text)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.2 * min(n, 20) / 20 + 0.4 * min(bits, 4) / 4 + 0.15 * classes)


def reached(terms: list) -> list[tuple[int, int]]:
    """The literals of ``terms`` and of the constants in them, in order, each once."""
    seen, out, todo = set(), {}, terms[::-1]
    while todo:
        t = todo.pop()
        if isinstance(t, tuple):
            out.setdefault(t)
        elif id(t) not in seen:
            seen.add(id(t))
            todo += t[::-1]
    return list(out)


class Lexer:
    """The pairs of a text from ``low`` to ``high``, with the literals that each reaches."""

    def __init__(self, text: str) -> None:
        self.text, self.constants, self.found = text, {}, {}
        self.followed: set[tuple[int, float]] = set()
        self.lists: list[list] = []  # kept, so that what tells them apart stays theirs

    def literal(self, at: int, high: int) -> tuple[int, int, int] | None:
        """(start, end, where it goes on) of the inside of a quoted literal at a place."""
        at = m.end() if (m := PREFIX.match(self.text, at, high)) else at
        mark = self.text[at : at + 3]
        if at + 3 <= high and mark in ('"""', "'''"):
            end = self.text.find(mark, at + 3, high)
            return (at + 3, end, end + 3) if end >= 0 else (at + 3, high, high)
        if (m := QUOTED.match(self.text, at, high)) is None:
            return None
        return at + 1, m.end() - bool(m[1] or m[2] or m[3]), m.end()

    def block(self, at: int, high: int, indent: int) -> tuple[int, int]:
        """From the first to past the last character of the lines from a place on that are indented deeper, up to the first that
        holds more than a word, but for the lines around a key's."""
        first = last = at
        while at < high and (m := LINE.match(self.text, at, high)):
            body = m[2].rstrip()
            if body and (len(m[1]) <= indent or not body.startswith("-----") and len(body.split(None, 1)) > 1):
                break
            if body:
                first, last = (m.start(2) if first == last else first), m.start(2) + len(body)
            at = m.end()
        return first, last

    def value(self, at: int, high: int, indent: int, sign: str, weight: float) -> tuple[list[list], int]:
        """The joined terms of the value at a place (of a list: those of each item), and where the search goes on."""
        text = self.text
        at = BLANK.match(text, at, high).end()
        if m := BREAK.match(text, at, high):
            literal = self.literal(m.end(), high)
            if literal is None:
                alone = ALONE.match(text, m.end(), high)
                if sign == ":" and weight and alone and len(m[1]) > indent:
                    return [[alone.span(1)]], alone.end(1)
                return [], at
            at = m.end()
        elif sign == ":" and weight and (m := SCALAR.match(text, at, high)):
            a, b = self.block(m.end(), high, indent)
            return [[(a, b)]], b
        if at < high and text[at] in "[({":
            return self.items(at + 1, high), at
        terms: list = []
        while True:
            if literal := self.literal(at, high):
                a, b, at = literal
                terms.append((a, b))
                if "=" in text[a:b] or ":" in text[a:b]:
                    self.pairs(a, b)
            elif m := (WORD if terms else BARE).match(text, at, high):
                at = m.end()
                if at < high and text[at] in "([":
                    # what is called or indexed is no literal, but its literals are the value's
                    return [terms, *self.items(at + 1, high)], at
                if (known := self.constants.get(m[0])) is not None:
                    terms.append(known)
                elif not terms and not DOTTED.fullmatch(m[0]):
                    terms.append(m.span())
            else:
                break
            if (m := JOIN.match(text, at, high)) is None:
                break
            at = m.end()
        return [terms], at

    def items(self, at: int, high: int) -> list[list]:
        """The literals that follow one another from a place on."""
        out = []
        while literal := self.literal(BETWEEN.match(self.text, at, high).end(), high):
            out.append([literal[:2]])
            at = literal[2]
            if SIGN_AHEAD.match(self.text, at, high):
                return out[:-1]
        return out

    def pairs(self, low: int, high: int) -> None:
        """Notes the literals of all pairs that reach a sensitive name, with the highest of their scores."""
        text, at, indent, seen = self.text, low, 0, low
        # (bracket, or '' for a block of YAML; its indentation; the name it lies under), and the number of each bracket
        under: list[tuple[str, int, str]] = []
        held: Counter[str] = Counter()
        while m := SEEK.search(text, at, high):
            start, at = m.start(), m.end()
            if (new := text.rfind("\n", seen, start)) >= 0:
                indent = BLANK.match(text, new + 1, high).end() - new - 1
                while under and not under[-1][0] and under[-1][1] >= indent:
                    held[under.pop()[0]] -= 1
            seen = start
            if m["open"]:
                under.append((m["open"], 0, under[-1][2] if under else ""))
                held[m["open"]] += 1
                continue
            if m["close"]:
                if held[CLOSES[m["close"]]]:
                    kind = ""
                    while kind != CLOSES[m["close"]]:
                        kind = under.pop()[0]
                        held[kind] -= 1
                continue
            name = m["own"] + m["items"]
            weight = name_weight(name, under[-1][2] if under else "")
            groups, at = self.value(at, high, indent, m["sign"], weight)
            # an annotated name: the value comes after the next sign
            if m["sign"] == ":" and len(groups) == 1 and len(groups[0]) == 1 and (typed := ANNOTATED.match(text, m.end(), high)):
                groups, at = self.value(typed.end(), high, indent, "=", weight)
            if any(groups):
                self.constants[m["own"]] = [t for g in groups for t in g]
                self.lists.append(self.constants[m["own"]])
            elif at < high and text[at] in "[({":
                under.append((text[at], 0, name))
                held[text[at]] += 1
                at += 1
            elif m["sign"] == ":" and not groups:
                under.append(("", indent, name))
                held[""] += 1
            if weight:
                for terms in groups:
                    if len(terms) == 1 and isinstance(terms[0], list):
                        if (key := (id(terms[0]), weight)) in self.followed:
                            continue
                        self.followed.add(key)
                    literals = reached(terms)
                    score = weight * literal_weight("".join(text[a:b] for a, b in literals))
                    if score >= THRESHOLD:
                        for place in literals:
                            self.found[place] = max(score, self.found.get(place, 0.0))


DOTTED = re.compile(r"[A-Za-z_]\w*+(?:\.[A-Za-z_]\w*+)++")
SIGN_AHEAD = re.compile(r"\s*+(?:=>|[:=])")
#: A type between a name and the sign of its value.
ANNOTATED = re.compile(r"[ \t]*+[A-Za-z_][\w.]*+(?:\[[\w., |]*+\])?(?:[ \t]*+\|[ \t]*+[A-Za-z_][\w.]*+)*+[ \t]*+=(?!=)")


def lexed(text: str) -> list[tuple[int, int, float]]:
    """Literals that reach a sensitive name, with their scores. A literal that reaches it in several ways counts once."""
    lexer = Lexer(text)
    lexer.pairs(0, len(text))
    return [(a, b, s) for (a, b), s in lexer.found.items() if b > a]


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """All spans by start, then by kind as listed."""
    out = [("assign", *m.span(), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span(), 1.0) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span(), 1.0) for m in HEX.finditer(text)]
    covered = runs(out)
    starts = [a for a, _ in covered]
    out += [("lex", a, b, round(s, 4)) for a, b, s in lexed(text) if not ((k := bisect.bisect_right(starts, a)) and covered[k - 1][1] >= b)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def runs(found: list[tuple[str, int, int, float]]) -> list[tuple[int, int]]:
    """Runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for _, a, b, _ in sorted(found, key=lambda s: s[1:3]):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _rows_with(whole: bytes, offsets: np.ndarray, needle: bytes) -> set[int]:
    """Rows in which a needle begins; those where it crosses into the next row are harmless extra work."""
    at, out = whole.find(needle), set()
    while at >= 0:
        row = int(np.searchsorted(offsets, at, "right")) - 1
        out.add(row)
        at = whole.find(needle, max(at + 1, int(offsets[row + 1])))
    return out


def _found(column: pa.Array, use: Callable[[int, str, list], None]) -> int:
    """Calls ``use`` with each row that has spans, its text and the spans; the number of rows."""
    data, offsets = utf8(column)
    whole = data.tobytes()
    low = whole.lower()
    rows = set().union(*(_rows_with(low, offsets, k) for k in KEYS), _rows_with(whole, offsets, b"AKIA"))
    starts, ends, _ = words_of(data, offsets, IS_HEX)
    rows.update((np.searchsorted(offsets, starts[ends - starts >= 24], "right") - 1).tolist())
    # a pair needs a sign, and its name a sensitive word: each listed weight has one of these in it
    for k in (b"pass", b"pwd", b"secret", b"token", b"apikey", b"credential", b"bearer", b"auth", b"key", b"connection"):
        rows.update(_rows_with(low, offsets, k))
    for i in sorted(rows):
        doc = whole[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")
        if found := spans(doc):
            use(i, doc, found)
    return len(offsets) - 1


def scan(df: DataFrame, text: str = "text", found: str = "secret_spans") -> DataFrame:
    """``df`` with the spans of each text."""

    def start():
        def step(columns: list[pa.Array]) -> list[pa.Array]:
            of: dict[int, list] = {}
            n = _found(columns[0], lambda i, _, s: of.__setitem__(i, [dict(zip(("kind", "start", "end", "score"), x)) for x in s]))
            return [pa.array([of.get(i, []) for i in range(n)], ARROW)]

        return step

    return map_batches(df, [text], [T.StructField(found, SPANS)], start)


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with each run of overlapping or touching spans replaced by ``mark``; a text without spans, null too, stays as it is."""

    def start():
        def step(columns: list[pa.Array]) -> list[pa.Array]:
            of: dict[int, str] = {}

            def masked(i: int, doc: str, found: list) -> None:
                covered = runs(found)
                edges = [0, *(x for run in covered for x in run), len(doc)]
                of[i] = mark.join(doc[a:b] for a, b in zip(edges[::2], edges[1::2]))

            n = _found(columns[0], masked)
            if not of:
                return [columns[0]]
            changed = pa.array([i in of for i in range(n)])
            return [pc.replace_with_mask(columns[0], changed, pa.array([of[i] for i in sorted(of)], columns[0].type))]

        return step

    return map_batches(df, [text], [T.StructField(text, T.StringType())], start).select(*df.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the spans of every text of documents."""
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    of = lambda *kinds: F.filter("secret_spans", lambda s: s["kind"].isin(*kinds))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(listed(of(*KINDS[:3])), 256).alias("base_sha256"),
        listed(F.col("secret_spans")).alias("spans"),
    )
