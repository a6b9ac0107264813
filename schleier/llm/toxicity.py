"""Toxicity by a weighted finite-state pattern grammar whose insults are learned from labels.

*Grammar.* A clause (words between . ! ? ; : and line breaks) is read by the product of five transducers. Four forms
of clause match: an aimed insult (an insult and a target, in any order), name-calling (an insult without a target, whose
target is the reader), an aimed threat (a target at most six words before the threat or three after it), and mixtures.
An insult at most two words after a negation counts for less, and so does all of a clause with reported speech. Targets, negations and
reports alone, and threats that aim at nobody, match nothing and score nothing. A clause's score is the sum that its path gives
out, times the weight of the state that it ends in; documents are scored by their matching clauses alone: by the logarithm of
their total, and by their share of all clauses. A logistic curve makes a score from 0 to 1 of these.

*Learning.* Words, and word beginnings of 3 to 10 code points, that are significantly commoner in toxic documents
become insults, with their log-odds as weights, beside a short list of fixed seed words. What is telling only where
it comes twice has half its log-odds for each time. Of candidates that begin one another the most significant stays. Labels are learned from at most ``TRAIN_ROWS`` labelled documents (those whose
hashed ids come first); equal texts count once. Candidates are counted and tested in Spark in two halves, all that pass
the tests are kept (the sample's size bounds them), and the curve is fitted to documents scored by the other half's insults, so that it isn't fitted to what the insults were chosen by.

Scores depend on the text alone. Null and empty texts get the curve's value at zero; without labels, or with one
label only, the seeds and a fixed curve remain. Repeated ids with differing labels count as toxic if one is; null
ids and null labels aren't learned from. Ties and repeated rows get equal scores, an empty table an empty result. New columns
replace those of the same name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import SliceHash, fresh, map_batches, steps, stored, table, utf8, words_of
from .decontaminate import IS_WORD, LOWER

TRAIN_ROWS = 16_000
PREFIXES = range(3, 11)
#: Least support, least G-statistic and least log-odds of an insult.
LEAST_DOCS, LEAST_G, LEAST_ODDS = 5, 25.0, 2.0
CUT = 0.3

# Seed words of the grammar, by class.
INSULTS = ("idiot", "moron", "stupid", "dumb", "pathetic", "worthless", "disgusting", "scum", "trash", "loser", "clown", "dummkopf", "abschaum", "widerlich", "wertlos", "imbécile", "ordure", "minable", "estúpido", "escoria", "inútil")
THREATS = ("kill", "hurt", "destroy", "beat", "burn", "töte", "vernichte", "tuer", "détruire", "matar", "destruir")
TARGETS = ("you", "your", "yours", "yourself", "u", "du", "dich", "dein", "ihr", "euch", "tu", "toi", "vous", "ton", "votre", "tú", "vosotros", "usted", "ustedes")
NEGATIONS = ("not", "no", "never", "isn't", "aren't", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "ningún")
REPORTS = ("said", "says", "called", "wrote", "quoted", "reported", "sagte", "nannte", "schrieb", "dit", "appelé", "écrit", "dijo", "llamó", "escribió")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
CLASSES = range(6)
#: Marks a candidate that must come twice in a document.
TWICE = "\x02"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
IS_BREAK = np.isin(np.arange(256), np.frombuffer(b".!?;:\n\r", np.uint8))
#: The curve where nothing can be learned: a constant, log(1 + total of the matching clauses), their share of all.
PRIOR = (-3.5, 1.5, 0.5)


@dataclass(frozen=True)
class Transducer:
    """It starts in state 0. steps[state][class] = (next state, factor of an insult's weight, weight given out besides);
    ends[state] is the factor of what a clause that ends there has given out."""

    steps: tuple[tuple[tuple[int, float, float], ...], ...]
    ends: tuple[float, ...]


def machine(start, step, end=lambda state: 1.0) -> Transducer:
    """The transducer of the states that ``step(state, class) -> (state, factor, weight)`` reaches."""
    number, rows, todo = {start: 0}, [], [start]
    for state in todo:  # grows while it is read
        row = []
        for c in CLASSES:
            to, factor, weight = step(state, c)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append((number[to], factor, weight))
        rows.append(tuple(row))
    return Transducer(tuple(rows), tuple(end(s) for s in todo))


def compose(*machines: Transducer) -> Transducer:
    """The product: states are tuples of states, factors multiply, weights add up."""

    def step(states, c):
        moves = [m.steps[s][c] for m, s in zip(machines, states)]
        return tuple(m[0] for m in moves), math.prod(m[1] for m in moves), sum(m[2] for m in moves)

    return machine((0,) * len(machines), step, lambda states: math.prod(m.ends[s] for m, s in zip(machines, states)))


#: How far before and after a threat its target may be, and how far an insult's negation reaches.
BEFORE, AFTER, REACH = 6, 3, 2
AIMED, NEGATED, REPORTED, THREAT_WEIGHT = 1.3, 0.3, 0.5, 3.0
#: Insults give out their weights.
OF_INSULTS = machine(0, lambda s, c: (0, 1.0 if c == INSULT else 0.0, 0.0))
#: A clause with a target counts for more than one that calls names.
OF_TARGETS = machine(0, lambda s, c: (int(s or c == TARGET), 1.0, 0.0), lambda s: AIMED if s else 1.0)


def _threat(state: tuple[int, int], c: int) -> tuple[tuple[int, int], float, float]:
    """State: words that the last target still reaches on, and words that the last unaimed threat waits for one."""
    reach, wait = state
    if c == TARGET:
        return (BEFORE, 0), 1.0, THREAT_WEIGHT if wait else 0.0
    aimed = c == THREAT and reach > 0
    return (max(reach - 1, 0), AFTER if c == THREAT and not aimed else 0 if aimed else max(wait - 1, 0)), 1.0, THREAT_WEIGHT if aimed else 0.0


OF_THREATS = machine((0, 0), _threat)
#: Words that a negation still reaches.
OF_NEGATIONS = machine(0, lambda s, c: (REACH, 1.0, 0.0) if c == NEGATION else (max(s - 1, 0), NEGATED if s else 1.0, 0.0))
#: What is reported counts for less, whether the report comes before or after it.
OF_REPORTS = machine(0, lambda s, c: (int(s or c == REPORT), 1.0, 0.0), lambda s: REPORTED if s else 1.0)
GRAMMAR = compose(OF_INSULTS, OF_TARGETS, OF_THREATS, OF_NEGATIONS, OF_REPORTS)


def clause_scores(classes: list[int], weights: list[float], breaks: list[bool]) -> list[float]:
    """The score of each clause that matches; a clause begins at each word with a break before it."""
    out, state, score, steps, ends = [], 0, 0.0, GRAMMAR.steps, GRAMMAR.ends
    for c, w, b in zip(classes, weights, breaks):
        if b:
            if score:
                out.append(score * ends[state])
            state, score = 0, 0.0
        state, factor, weight = steps[state][c]
        score += w * factor + weight
    return out + [score * ends[state]] if score else out


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of U+00C0 to U+00DE lower-cased, in UTF-8."""
    out = LOWER[data]
    at = np.flatnonzero(out[:-1] == 0xC3) + 1 if len(out) else np.zeros(0, np.int64)
    at = at[(out[at] >= 0x80) & (out[at] <= 0x9E) & (out[at] != 0x97)]
    out[at] += 0x20
    return out


def lowered(text: str | None) -> str:
    return lower(np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)).tobytes().decode("utf-8")


class Lexicon:
    """Weights of words and of word beginnings, looked up by hashes of byte slices."""

    def __init__(self, insults: list[tuple[str, bool, float]]) -> None:
        weights = {(w, True): 3.0 for w in INSULTS}
        for text, whole, weight in insults:
            weights[text, whole] = max(weight, weights.get((text, whole), 0.0))
        fixed = [(w, c, x) for words, c, x in ((THREATS, THREAT, 0.0), (TARGETS, TARGET, 0.0), (NEGATIONS, NEGATION, 0.0), (REPORTS, REPORT, 0.0)) for w in words]
        whole = [(w, INSULT, x) for (w, full), x in weights.items() if full]
        seen = {w for w, *_ in whole}
        self.words = self._table(whole + [f for f in fixed if f[0] not in seen])
        by_length: dict[int, list[tuple[str, int, float]]] = {}
        for (w, full), x in weights.items():
            if not full:
                by_length.setdefault(len(w.encode()), []).append((w, INSULT, x))
        self.prefixes = {n: self._table(rows) for n, rows in by_length.items()}

    @staticmethod
    def _table(rows: list[tuple[str, int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = [w.encode() for w, *_ in rows]
        ends = np.cumsum([len(d) for d in data])
        h = SliceHash()(np.frombuffer(b"".join(data), np.uint8), ends - np.array([len(d) for d in data]), ends)
        order = np.argsort(h)
        return h[order], np.array([c for _, c, _ in rows], np.int8)[order], np.array([x for *_, x in rows])[order]

    def classify(self, hasher: SliceHash, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class and the weight of each word."""
        classes, weights = np.zeros(len(starts), np.int8), np.zeros(len(starts))
        if not len(starts):
            return classes, weights
        for length, (keys, kinds, values) in ((0, self.words), *self.prefixes.items()):
            on = np.flatnonzero(ends - starts >= length) if length else np.arange(len(starts))
            h = hasher.slices(starts[on], starts[on] + length if length else ends[on])
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            on, at = on[hit], at[hit]
            better = (values[at] > weights[on]) | (classes[on] == OTHER)
            classes[on[better]], weights[on[better]] = kinds[at[better]], values[at[better]]
        return classes, weights


def features(lexicon: Lexicon, hasher: SliceHash, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log(1 + the matching clauses' total) and their share of the clauses, for each text."""
    low = lower(data)
    starts, ends, counts = words_of(low, offsets, IS_WORD)
    hasher.load(low)
    classes, weights = lexicon.classify(hasher, low, starts, ends)
    out = np.zeros((len(counts), 2))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    hits = np.concatenate([[0], np.cumsum((classes == INSULT) | (classes == THREAT))])
    hits = hits[bounds[1:]] - hits[bounds[:-1]]
    for i in np.flatnonzero(hits).tolist():
        a, b = bounds[i], bounds[i + 1]
        text = low[offsets[i] : offsets[i + 1]]
        breaks = np.concatenate([[0], np.cumsum(IS_BREAK[text])])
        s, e = starts[a:b] - offsets[i], ends[a:b] - offsets[i]
        new = np.append(True, breaks[s[1:]] > breaks[e[:-1]])
        found = clause_scores(classes[a:b].tolist(), weights[a:b].tolist(), new.tolist())
        out[i] = math.log1p(sum(found)), len(found) / new.sum()
    return out


def _candidates(text: str) -> list[str]:
    """Words, marked by a final blank, and word beginnings; those that come twice once more with the mark TWICE."""
    words = Counter(WORD.findall(lowered(text)))
    out = Counter({w + " ": n for w, n in words.items() if len(w) >= 3})
    for w, n in words.items():
        for k in PREFIXES:
            if k > len(w):
                break
            out[w[:k]] += n
    return [*out, *(c + TWICE for c, n in out.items() if n > 1)]


def _tests(p, n, toxic: int, clean: int, log) -> tuple:
    """Log-odds and G-statistic of p toxic and n clean documents with a candidate; of numbers or columns. A count of 0 adds nothing to G."""
    share = toxic / (toxic + clean)
    odds = log((p + 0.5) / (toxic + 1)) - log((n + 0.5) / (clean + 1))
    # x log x is 0 at 0, as it is with a vanishing number instead
    return odds, 2 * (p * log((p + 1e-300) / ((p + n + 1e-300) * share)) + n * log((n + 1e-300) / ((p + n + 1e-300) * (1 - share))))


def chosen(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> list[tuple[str, bool, float]]:
    """Insults among (candidate, toxic documents, clean documents): the most significant, none the beginning of another.

    A candidate that must come twice has half its log-odds as weight.
    """
    if not toxic or not clean:
        return []
    found = []
    for text, p, n in rows:
        odds, g = _tests(p, n, toxic, clean, math.log)
        if p >= LEAST_DOCS and odds >= LEAST_ODDS and g >= LEAST_G:
            twice = text.endswith(TWICE)
            found.append((g, text.removesuffix(TWICE), odds / (1 + twice)))
    out: dict[str, float] = {}
    inner: set[str] = set()
    for _, text, weight in sorted(found, key=lambda x: (-round(x[0], 6), -len(x[1]), x[1])):
        word = text.rstrip(" ")
        begins = {word[:k] for k in range(1, len(word) + 1)}
        if word not in inner and not any(b in out or b + " " in out and b == word for b in begins):
            out[text] = round(weight, 4)
            inner |= begins
    return [(t.rstrip(" "), t.endswith(" "), w) for t, w in out.items()]


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method with a small ridge; weights of the features aren't negative."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.array(PRIOR, float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        r = np.array([0.01, 0.5, 0.5])
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(r), a.T @ (y - p) - r * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    w[1:] = np.maximum(w[1:], 0)
    return tuple(float(v) for v in w)


@dataclass
class Model:
    insults: list[tuple[str, bool, float]]
    curve: tuple[float, ...]


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The model of at most TRAIN_ROWS labelled documents that aren't held out."""
    ship(docs.sparkSession)
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(doc_id))
    known = known.groupBy(F.col(doc_id).alias("label_id")).agg(F.max(label).cast("int").alias("label"))
    # a bounded sample: its ids go to every task
    sample = known.orderBy(F.xxhash64("label_id"), "label_id").limit(TRAIN_ROWS)
    rows = docs.select(F.col(doc_id).alias("label_id"), F.col(text).alias("body")).join(F.broadcast(sample), "label_id")
    rows = rows.select("label", "body", F.pmod(F.xxhash64("body"), F.lit(2)).cast("int").alias("half")).dropDuplicates(["label", "body"])
    rows = stored(rows, "labelled")
    sizes = {(r["half"], r["label"]): r["n"] for r in rows.groupBy("half", "label").agg(F.count("*").alias("n")).collect()}
    fields = T.StructType([T.StructField("candidate", T.StringType())] + [T.StructField(c, T.LongType()) for c in ("p0", "n0", "p1", "n1")])

    def count(batches):
        for b in batches:
            tally = [Counter() for _ in range(4)]
            for y, t, h in zip(*(b.column(i).to_pylist() for i in range(3))):
                tally[2 * h + (y != 1)].update(_candidates(t))
            # a beginning that no toxic document here has can't be told yet: all go on
            every = list(set().union(*tally))
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([k[x] for x in every], pa.int64()) for k in tally)], fields.names)

    counted = rows.mapInArrow(count, fields).groupBy("candidate").agg(*(F.sum(c).alias(c) for c in fields.names[1:]))
    n = lambda h, y: sizes.get((h, y), 0)
    toxic, clean = [n(h, 1) for h in (0, 1)], [n(h, 0) for h in (0, 1)]
    if not sum(toxic) or not sum(clean):
        return Model([], PRIOR)

    def passes(p, m, t: int, c: int):
        odds, g = _tests(p, m, t, c, F.log) if t and c else (F.lit(0.0), F.lit(0.0))
        return (p >= LEAST_DOCS) & (odds >= LEAST_ODDS - 1e-6) & (g >= LEAST_G - 1e-6)

    p, m = F.col("p0") + F.col("p1"), F.col("n0") + F.col("n1")
    any_ = passes(p, m, sum(toxic), sum(clean)) | passes(F.col("p0"), F.col("n0"), toxic[0], clean[0]) | passes(F.col("p1"), F.col("n1"), toxic[1], clean[1])
    found = [tuple(r) for r in counted.where(any_).collect()]
    whole = chosen([(c, p0 + p1, n0 + n1) for c, p0, n0, p1, n1 in found], sum(toxic), sum(clean))
    halves = [chosen([(c, p0, n0) for c, p0, n0, _, _ in found], toxic[0], clean[0]), chosen([(c, p1, n1) for c, _, _, p1, n1 in found], toxic[1], clean[1])]
    shared = docs.sparkSession.sparkContext.broadcast(halves)
    out = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x1", "x2", "y")])

    def score(batches):
        hasher, lexicons = SliceHash(), [Lexicon(h) for h in shared.value]
        for b in batches:
            data, offsets = utf8(b.column(1))
            halves_ = np.array(b.column(2).to_pylist())
            x = np.zeros((b.num_rows, 2))
            for s, e in steps(offsets):
                both = [features(k, hasher, data[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s]) for k in lexicons]
                x[s:e] = np.where(halves_[s:e, None] == 0, both[1], both[0])
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(np.array(b.column(0).to_pylist(), float))], ["x1", "x2", "y"])

    table_ = np.array([tuple(r) for r in rows.mapInArrow(score, out).collect()], float).reshape(-1, 3)
    return Model(whole, fit(table_[:, :2], table_[:, 2] == 1))


def score(df: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """``df`` with each text's score."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the words of TRAIN_ROWS documents

    def start():
        hasher, lexicon, w = SliceHash(), Lexicon(shared.value.insults), shared.value.curve

        def step(columns: list[pa.Array]) -> list[pa.Array]:
            data, offsets = utf8(columns[0])
            x = np.concatenate([np.zeros((0, 2))] + [features(lexicon, hasher, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in steps(offsets)])
            return [pa.array(1 / (1 + np.exp(-(w[0] + x @ np.array(w[1:])))))]

        return step

    return map_batches(df, [text], [T.StructField(to, T.DoubleType())], start)


def clean(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``df`` that score under the cut, with its columns as they were."""
    (name,) = fresh(df, "toxicity")
    return score(df, model, text, name).where(F.col(name) < CUT).select(*df.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels"))).drop("text")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
