"""An interpolated modified Kneser-Ney model of trigrams, counted in Spark and kept as sorted hash arrays.

Tokens are runs of bytes other than blank and U+0009 to U+000D, A-Z lower-cased, and one end token for each text.
Before the first token there are start marks, which aren't tokens.

1. *Highest order.* Tasks hash, sort and count their n-grams; what goes through the shuffle is blobs of sorted hash
   fragments and counts, one for each of the hash's ranges. A range's blobs are merged and written as one file of
   sorted hashes and counts. Ranges are even whatever the words are, so no word is hot.
2. *Lower orders.* Another pass for each looks the counts of the next higher order up in those files. An occurrence of an
   n-gram that was counted c times is 1/c of a distinct one, so its shares add up to the number of distinct words before the
   n-gram's last words, and to the numbers of words after its first words that are seen once, twice and oftener. N-grams that
   begin with a start mark, which nothing comes before, keep their counts. The same blobs, merged the same way.
3. *Scores.* Workers map the files into memory, and look up each batch's hashes in order.

The files lie in the folder that all executors share and are read there in place; in a store that isn't a file
system a worker copies them to its own folder, maps them and unlinks them. A file is written under a name of its
own by each attempt, and only the names that successful tasks return are read, so lost executors do no harm. The names
are records of a manifest, which the driver writes row by row and workers map; neither it nor a task holds a list of them.

Ranges have about RANGE_BYTES of text each, so a worker's memory doesn't depend on the corpus. Within its range a hash has 40
bits, so that about one n-gram in a million shares its counts with another. Null and empty texts are one end token; without any
training text every token has the probability of an unknown word in an empty vocabulary, 1. Ties and repeated rows count each
time; empty tables give empty ones. New columns replace those of the same name.
"""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import SliceHash, map_batches, mix, shared_dir, steps, stored, table, utf8, words_of
from .decontaminate import LOWER

ORDER = 3
RANGE_BYTES = 16 << 20
#: Records that a task holds before it passes them on; bytes of text that it looks at at once.
HELD, STEP_BYTES = 1_000_000, 1 << 20
#: Bits of a hash within its range: the upper ones are an array that is searched, the lower ones one that is compared.
UPPER_BITS, LOWER_BITS = 32, 8
FRAGMENT = UPPER_BITS + LOWER_BITS
#: Files that a worker keeps mapped.
MAPPED = 512
U = np.uint64
END, START = U(0), U(2**64 - 1)
IS_TOKEN = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Of an n-gram: its occurrences, the distinct words before it (its occurrences, for the highest order and after a start mark), the
#: sum of these over its continuations, and how many of those have one, two or more.
COLUMNS = ("count", "kinds", "follows", "one", "two", "more")


# --- positions and n-grams


def positions(hasher: SliceHash, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place in its text) of each position, and the number of tokens in each text: a start mark at place 0, the words, the end."""
    low = LOWER[data]
    starts, ends, counts = words_of(low, offsets, IS_TOKEN)
    words = hasher(low, starts, ends)
    words[(words == END) | (words == START)] = U(1)
    sizes = counts + 2
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    out = np.zeros(len(place), np.uint64)
    inner = np.ones(len(out), bool)
    inner[first] = inner[first + sizes - 1] = False
    out[inner], out[first] = words, START
    return out, place, counts + 1


def grams(words: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words that end at each position, with start marks before the text."""
    out = np.full(len(words), n, np.uint64)
    with np.errstate(over="ignore"):
        for back in range(n - 1, -1, -1):
            word = words
            if back:
                word = np.empty_like(words)
                word[back:], word[:back] = words[:-back], START
                word[place < back] = START
            out = mix(out * U(0x9E3779B97F4A7C15) + word)
    return out


# --- blobs


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, which packs better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_planes(data: bytes, kind: str, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).reshape(-1).view(kind)


def pack(keys: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """Ascending fragments as 32-bit steps where these suffice, and columns: of one, counts of a byte with the larger ones apart; of
    several, their bytes by place, compressed."""
    step = np.diff(keys, prepend=U(0))
    narrow = not len(step) or int(step.max()) < 1 << 32
    head = bytes([narrow]) + len(keys).to_bytes(4, "little") + step.astype("<u4" if narrow else "<u8").tobytes()
    if len(columns) == 1:
        counts = columns[0].astype(np.int64)
        small = np.minimum(counts, 255).astype(np.uint8)
        return head + small.tobytes() + counts[small == 255].astype("<u8").tobytes()
    return head + pa.compress(b"".join(_planes(c.astype("<f8")) for c in columns), "zstd", asbytes=True)


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    n, kind = int.from_bytes(blob[1:5], "little"), "<u4" if blob[0] else "<u8"
    at = 5 + n * np.dtype(kind).itemsize
    keys = np.cumsum(np.frombuffer(blob, kind, n, 5), dtype=np.uint64)
    if columns == 1:
        counts = np.frombuffer(blob, np.uint8, n, at).astype(np.float64)
        counts[counts == 255] = np.frombuffer(blob, "<u8", offset=at + n)
        return [keys, counts]
    body = pa.decompress(blob[at:], 8 * n * columns, "zstd", asbytes=True)
    return [keys, *(_from_planes(body, "<f8", n, 8 * n * i) for i in range(columns))]


def merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Ascending keys, then the sums of their columns."""
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return [keys[at], *(np.add.reduceat(np.concatenate([p[i] for p in parts])[order], at) if len(at) else np.zeros(0) for i in range(1, len(parts[0])))]


def cuts(keys: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of ascending keys by their bits above ``shift``; ranges without keys are left out."""
    of = (keys >> U(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
    at = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    return list(zip(of[at].tolist(), at.tolist(), np.append(at[1:], len(of)).tolist()))


# --- files


def _write(folder: str, *arrays: np.ndarray) -> bytes:
    """A file of arrays, each from a multiple of 8 bytes on; its name."""
    name = uuid.uuid4()
    store, path = fs.FileSystem.from_uri(f"{folder}/{name.hex}")
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as f:
        for a in arrays:
            f.write(a.tobytes() + bytes(-a.nbytes % 8))
    return name.bytes


def _mapped(uri: str) -> mmap.mmap:
    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    with tempfile.NamedTemporaryFile() as f:  # the mapping outlives the name
        with store.open_input_stream(path) as source:
            while part := source.read(1 << 22):
                f.write(part)
        f.flush()
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


#: Of a range: its file's name, its n-grams, and those of them whose numbers don't all fit into a byte.
RECORD = np.dtype([("name", "S16"), ("pad", "u1"), ("n", "<u8"), ("large", "<u8")])


@dataclass(frozen=True)
class Table:
    """N-grams of one order: where their files are, and what sums over them give."""

    folder: str
    manifest: str
    bits: int
    columns: int
    tokens: int
    grams: int
    words: int
    discounts: tuple[float, float, float]
    #: Sum of the discounts over all n-grams, and of their kinds.
    discounted: float
    kinds: int


class Reader:
    """Looks n-grams up in the files of a table, which stay mapped."""

    def __init__(self, table: Table) -> None:
        self.table, self.open = table, OrderedDict()
        self.records = np.frombuffer(_mapped(f"{table.folder}/{table.manifest}"), RECORD)

    def _range(self, r: int) -> tuple | None:
        if r in self.open:
            self.open.move_to_end(r)
            return self.open[r]
        record = self.records[r]
        n, large, k = int(record["n"]), int(record["large"]), self.table.columns
        if not n:
            return None
        data = _mapped(f"{self.table.folder}/{uuid.UUID(bytes=bytes(record['name']).ljust(16, b'\0')).hex}")
        at, out = 0, []
        for kind, size in (("<u4", n), ("u1", n), *(("u1", n),) * k, ("<u8", large), *(("<i8", large),) * k):
            out.append(np.frombuffer(data, kind, size, at))
            at += out[-1].nbytes + -out[-1].nbytes % 8
        self.open[r] = (data, out[0], out[1], out[2 : 2 + k], out[2 + k], out[3 + k :])
        if len(self.open) > MAPPED:
            self.open.popitem(last=False)
        return self.open[r]

    def find(self, keys: np.ndarray) -> list[np.ndarray]:
        """The columns at each key, as integers; 0 where there is none."""
        bits = self.table.bits
        keys, back = np.unique(keys >> U(64 - bits - FRAGMENT), return_inverse=True)
        out = [np.zeros(len(keys), np.int64) for _ in range(self.table.columns)]
        for r, a, b in cuts(keys, FRAGMENT):
            if (held := self._range(r)) is None:
                continue
            data, upper, lower, small, large_keys, large = held
            fragment = keys[a:b] & U((1 << FRAGMENT) - 1)
            sought, rest = (fragment >> U(LOWER_BITS)).astype(np.uint32), fragment.astype(np.uint8)
            at = np.searchsorted(upper, sought)
            live, found = np.arange(b - a), []
            while len(live):
                # hardly two fragments of a range agree in their upper bits
                live = live[at[live] < len(upper)]
                live = live[upper[at[live]] == sought[live]]
                same = lower[at[live]] == rest[live]
                found.append(live[same])
                live = live[~same]
                at[live] += 1
            hit = np.concatenate(found) if found else live
            for o, c in zip(out, small):
                o[a + hit] = c[at[hit]]
            if len(large_keys):
                big = hit[small[0][at[hit]] == 255]
                place = np.searchsorted(large_keys, fragment[big])
                for o, c in zip(out, large):
                    o[a + big] = c[place]
            if hasattr(mmap, "MADV_DONTNEED"):
                data.madvise(mmap.MADV_DONTNEED)  # the pages stay in the machine's cache, not in the worker
        return [o[back] for o in out]


BLOB = T.StructType([T.StructField("range", T.LongType()), T.StructField("blob", T.BinaryType())])
SUMS = ("n", "large", "tokens", "words", "kinds", "n1", "n2", "n3", "n4", "more")
FILE = T.StructType([T.StructField("range", T.LongType()), T.StructField("name", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in SUMS)])


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and more, by the numbers of n-grams seen 1 to 4 times; each between 0 and its count."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(d, 0.0), k) for d, k in zip(raw, (1.0, 2.0, 3.0)))


def _table(docs: DataFrame, folder: str, bits: int, columns: int, records) -> Table:
    """The table of what ``records()`` gives of each batch of texts: hashes and columns that add up."""
    shift = 64 - bits - FRAGMENT

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, held, n = records(), [], 0

        def passed() -> pa.RecordBatch:
            keys, *sums = merged(held) if len(held) > 1 else held[0]
            parts = cuts(keys, FRAGMENT)
            rest = keys & U((1 << FRAGMENT) - 1)
            return pa.RecordBatch.from_arrays([pa.array([r for r, *_ in parts], pa.int64()), pa.array([pack(rest[a:b], [c[a:b] for c in sums]) for _, a, b in parts], pa.binary())], BLOB.names)

        for b in batches:
            data, offsets = utf8(b.column(0))
            for s, e in steps(offsets, STEP_BYTES):
                keys, *values = step(data[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s])
                # what a fragment can't tell is one n-gram
                held.append(merged([[keys >> U(shift), *values]]))
                n += len(held[-1][0])
                if n >= HELD:
                    yield passed()
                    held, n = [], 0
        if held:
            yield passed()

    def one(key: tuple, group: pa.Table) -> pa.Table:
        keys, *sums = merged([unpack(b, columns) for c in group.column("blob").chunks for b in c.to_pylist()])
        sums = [np.rint(c).astype(np.int64) for c in sums]
        counts, kinds = sums[0], sums[min(1, columns - 1)]
        large = np.logical_or.reduce([c >= 255 for c in sums])
        small = [np.where(large, 255, c).astype(np.uint8) for c in sums]
        name = _write(folder, (keys >> U(LOWER_BITS)).astype("<u4"), keys.astype(np.uint8), *small, keys[large], *(c[large] for c in sums))
        row = {"range": key[0].as_py(), "name": name, "n": len(keys), "large": int(large.sum()), "tokens": int(counts.sum()), "words": int((counts > 0).sum()), "kinds": int(kinds.sum()), "more": int((kinds >= 3).sum())}
        row |= {f"n{k}": int((kinds == k).sum()) for k in (1, 2, 3, 4)}
        return pa.Table.from_pylist([row], pa.schema([("range", pa.int64()), ("name", pa.binary()), *((c, pa.int64()) for c in SUMS)]))

    made = stored(docs.mapInArrow(blobs, BLOB).groupBy("range").applyInArrow(one, FILE), "files")
    total = made.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS)).first()
    d = discounts([total[f"n{k}"] for k in (1, 2, 3, 4)])
    discounted = d[0] * total["n1"] + d[1] * total["n2"] + d[2] * total["more"]
    return Table(folder, _manifest(made, folder, bits), bits, columns, total["tokens"], total["n"], total["words"], d, discounted, total["kinds"])


def _manifest(made: DataFrame, folder: str, bits: int) -> str:
    """A file with a record for each range, written as the rows come; ranges without n-grams are empty records."""
    name = f"manifest-{uuid.uuid4().hex}"
    store, path = fs.FileSystem.from_uri(f"{folder}/{name}")
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as f:
        at = 0
        for row in made.select("range", "name", "n", "large").orderBy("range").toLocalIterator():
            f.write(bytes(RECORD.itemsize * (row["range"] - at)))
            f.write(np.array([(bytes(row["name"]), 0, row["n"], row["large"])], RECORD).tobytes())
            at = row["range"] + 1
        f.write(bytes(RECORD.itemsize * ((1 << bits) - at)))
    return name


# --- the model


@dataclass(frozen=True)
class Model:
    """Tables of the orders from 1 on."""

    tables: tuple[Table, ...]

    @property
    def tokens(self) -> int:
        return self.tables[0].tokens

    @property
    def words(self) -> int:
        return self.tables[0].words


def train(df: DataFrame, text: str = "text", order: int = ORDER) -> Model:
    """The model of a table's texts; ``order`` is 2 at least."""
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(text).alias("body"))
    size = docs.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    bits = max(3, (int(size) // RANGE_BYTES).bit_length())
    folder = shared_dir(spark, "ngram")

    def highest():
        hasher = SliceHash()

        def step(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
            words, place, _ = positions(hasher, data, offsets)
            keys = grams(words, place, order)[place > 0]
            return [keys, np.ones(len(keys))]

        return step

    def lower(n: int, above: Table):
        def start():
            hasher, reader = SliceHash(), Reader(above)

            def step(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
                words, place, _ = positions(hasher, data, offsets)
                token = place > 0
                found = reader.find(grams(words, place, n + 1)[token])
                count, kinds = found[0], found[min(1, above.columns - 1)]
                share, weight = np.zeros(len(words)), np.zeros(len(words), np.int64)
                share[token], weight[token] = 1 / count, kinds
                # what follows a position is the next one, but not from one text to the next
                after, next_weight = np.append(share[1:], 0), np.append(weight[1:], 0)
                distinct = np.where(place >= n, share, token)
                return [grams(words, place, n), token.astype(np.float64), distinct, after * next_weight, *(np.where(t, after, 0) for t in (next_weight == 1, next_weight == 2, next_weight >= 3))]

            return step

        return start

    tables = [_table(docs, folder, bits, 1, highest)]
    for n in range(order - 1, 0, -1):
        tables.insert(0, _table(docs, folder, bits, len(COLUMNS), lower(n, tables[0])))
    return Model(tuple(tables))


FIELDS = [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")] + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens``, ``n_known``, ``base_score`` (add-one unigrams) and ``score`` (the model), both log10."""

    def start():
        hasher, readers = SliceHash(), [Reader(t) for t in model.tables]
        first = model.tables[0]
        unknown = (first.discounted / first.kinds if first.kinds else 1.0) / (first.words + 1)

        def step(columns: list[pa.Array]) -> list[pa.Array]:
            data, offsets = utf8(columns[0])
            parts = [some(data[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s]) for s, e in steps(offsets, STEP_BYTES)]
            return [pa.array(np.concatenate(x)) for x in zip(*parts)]

        def some(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
            words, place, counts = positions(hasher, data, offsets)
            token = np.flatnonzero(place > 0)
            held = readers[0].find(grams(words, place, 1))
            known = held[0][token]
            kinds = held[1][token]
            p = (kinds - np.array([0.0, *first.discounts])[np.minimum(kinds, 3)]) / max(first.kinds, 1) + unknown
            for n, (reader, t) in enumerate(zip(readers[1:], model.tables[1:]), 2):
                follows, one, two, more = (c[token - 1] for c in held[2:])
                held = reader.find(grams(words, place, n))
                kinds = held[min(1, t.columns - 1)][token]
                d = np.array([0.0, *t.discounts])
                left = d[1] * one + d[2] * two + d[3] * more
                p = np.where(follows > 0, (kinds - d[np.minimum(kinds, 3)] + left * p) / np.maximum(follows, 1), p)
            base = np.log10((known + 1) / (model.tokens + model.words + 1))
            at = np.cumsum(counts) - counts
            return [counts.astype(np.int64), *(np.add.reduceat(v, at) for v in ((known > 0).astype(np.int64), base, np.log10(p)))]

        return step

    return map_batches(df, [text], FIELDS, start)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every document scored by the model of those that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(~held_out()))
    out = score(docs, model).drop("text")
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
