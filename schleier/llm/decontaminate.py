"""Benchmark decontamination with an FM-index of each shard of the training texts.

A shard is an Arrow batch of documents. Its words (A-Z lower-cased; digits, letters and everything beyond ASCII)
become symbols: the rank of the word among the benchmark's, or a break. Runs of benchmark words shorter than any
window can't hold one and go; the rest, each run closed by a break of its own, is sorted by suffixes (prefix
doubling), and its Burrows-Wheeler transform is kept in a wavelet matrix of packed bits with popcount ranks. All
windows are searched backwards together; occurrences are located by stepping to sampled suffix positions, and
the words inside them merge into removal spans.

A window is 13 consecutive words of an item, or all of an item that has fewer. The benchmark is read in blocks of
a bounded number of words, longer items in pieces that overlap; each block is a pass over the batch that adds to the hits of the one before, so its
size isn't limited. Null and empty texts have no words and are never contaminated; items without words have no
windows; an item without id hits words but isn't listed; repeated items are listed once; repeated documents each
get the same result. New columns replace those of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SliceHash, fresh, map_batches, ragged, same_slices, table, utf8, words_of

WINDOW = 13
#: Words of the benchmark that one pass holds.
BLOCK_WORDS = 1 << 20
SAMPLE = 8
#: An item is contaminating a document if at least one in so many of the document's words are hit.
SHARE = 20

_byte = np.arange(256)
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
IS_WORD = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)


class Bits:
    """A bit vector with constant-time ranks."""

    def __init__(self, bits: np.ndarray) -> None:
        words = np.zeros(-(-(len(bits) + 1) // 64) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        words[: len(packed)] = packed
        self.words = words.view(np.uint64)
        counts = np.bitwise_count(self.words)
        self.before = np.cumsum(counts, dtype=np.int64) - counts

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.depth = max(1, int(n_symbols - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for d in range(self.depth - 1, -1, -1):
            bit = (symbols >> d) & 1 == 1
            self.levels.append((Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        # where each symbol's block begins on the lowest level
        start = np.zeros(1, np.int64)
        self.first = np.searchsorted(self._key(symbols), self._key(np.arange(n_symbols))) if len(symbols) else start.repeat(n_symbols)

    def _key(self, symbols: np.ndarray) -> np.ndarray:
        """The order of symbols on the lowest level: their bits reversed."""
        out = np.zeros(len(symbols), np.int64)
        for d in range(self.depth):
            out |= ((symbols.astype(np.int64) >> d) & 1) << (self.depth - 1 - d)
        return out

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of a symbol before i."""
        for d, (bits, zeros) in zip(range(self.depth - 1, -1, -1), self.levels):
            ones = bits.rank(i)
            i = np.where((symbol >> d) & 1 == 1, zeros + ones, i - ones)
        return i - self.first[symbol]

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for d, (bits, zeros) in zip(range(self.depth - 1, -1, -1), self.levels):
            ones, set_ = bits.rank(i), bits[i]
            out |= set_.astype(np.int64) << d
            i = np.where(set_, zeros + ones, i - ones)
        return out


def suffix_order(symbols: np.ndarray, n_symbols: int) -> np.ndarray:
    """The suffixes in order; symbol 0 ends a run, and an earlier end counts as the smaller."""
    n = len(symbols)
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + ends.sum() - 1)
    h, top = 1, int(ends.sum() + n_symbols)
    while True:
        # each round puts together as many ranks as a key holds
        each = max(2, 62 // (top + 2).bit_length())
        key = rank + 1
        for j in range(1, each):
            key *= top + 2
            if j * h < n:
                key[: n - j * h] += rank[j * h :] + 1
        h *= each
        order = np.argsort(key)
        new = np.empty(n, np.int64)
        new[0] = 0
        new[1:] = np.cumsum(key[order[1:]] != key[order[:-1]])
        if new[-1] == n - 1 or h > n:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        top = int(new[-1]) + 1


class FMIndex:
    """Counts and locates words' sequences in runs of symbols, each run closed by a 0."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.n = len(symbols)
        order = suffix_order(symbols, n_symbols)
        before = symbols[order - 1]  # of the first suffix: the last end
        self.bwt = WaveletMatrix(before, n_symbols)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols))])[:n_symbols]
        # positions that start a run can't be stepped over, so these are sampled too
        sampled = (order % SAMPLE == 0) | (before == 0)
        self.sampled, self.positions = Bits(sampled), order[sampled]

    def search(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row ranges of the patterns flat[start : start + length], whose symbols are over 0."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64)
        live = np.arange(len(starts))
        for t in range(int(lengths.max(initial=0))):
            live = live[(t < lengths[live]) & (low[live] < high[live]) | (t >= lengths[live])]
            go = live[t < lengths[live]]
            if not len(go):
                break
            c = flat[starts[go] + lengths[go] - 1 - t]
            low[go], high[go] = self.smaller[c] + self.bwt.rank(c, low[go]), self.smaller[c] + self.bwt.rank(c, high[go])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, out, walked = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            here = self.sampled[rows[live]]
            done = live[here]
            out[done] = self.positions[self.sampled.rank(rows[done])] + walked[done]
            live = live[~here]
            c = self.bwt[rows[live]]
            rows[live] = self.smaller[c] + self.bwt.rank(c, rows[live])
            walked[live] += 1
        return out


class Block:
    """The windows of some items: words as symbols, and where windows start in them."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        texts = [t.encode("utf-8", "replace") for _, t in items]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        data = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        starts, ends, counts = words_of(data, offsets, IS_WORD)
        self.hasher = SliceHash().load(data)
        self.vocabulary, symbols = np.unique(self.hasher.slices(starts, ends), return_inverse=True)
        self.word_starts, self.word_sizes = starts, ends - starts
        self.flat = symbols.astype(np.int32) + 1
        first = np.cumsum(counts) - counts
        windows = np.where(counts >= WINDOW, counts - WINDOW + 1, np.minimum(counts, 1))
        self.starts = ragged(first, windows)
        self.lengths = np.repeat(np.minimum(counts, WINDOW), windows)
        self.items = np.repeat(np.arange(len(items)), windows)
        self.item_ids = [i for i, _ in items]
        self.shortest = int(self.lengths.min(initial=WINDOW))

    def occurrences(self, shard: SliceHash, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first word and the window of each occurrence in the texts that ``shard`` has loaded; their words' bytes are compared."""
        words = shard.slices(starts, ends)
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.starts) or not len(words):
            return none
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        symbols = np.where(self.vocabulary[at] == words, at + 1, 0)
        # runs inside documents
        inside = symbols > 0
        doc_start = np.zeros(len(words) + 1, bool)
        doc_start[np.cumsum(counts) - counts] = True
        begin = inside & (np.append(True, ~inside[:-1]) | doc_start[:-1])
        end = inside & (np.append(~inside[1:], True) | doc_start[1:])
        run, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
        keep = stop - run >= self.shortest
        run, length = run[keep], (stop - run)[keep]
        if not len(run):
            return none
        # each run, then its end
        place = ragged(run, length + 1)
        text = np.zeros(len(place), np.int64)
        last = np.cumsum(length + 1) - 1
        real = np.ones(len(place), bool)
        real[last] = False
        text[real] = symbols[place[real]]
        index = FMIndex(text, len(self.vocabulary) + 1)
        low, high = index.search(self.flat, self.starts, self.lengths)
        found = np.flatnonzero(low < high)
        times = (high - low)[found]
        at, window = place[index.locate(ragged(low[found], times))], np.repeat(found, times)
        # equal hashes don't prove equal words: each word of each occurrence is compared, in parts
        right = np.ones(len(at), bool)
        for a in range(0, len(at), 1 << 16):
            n = self.lengths[window[a : a + (1 << 16)]]
            mine, its = ragged(at[a : a + (1 << 16)], n), ragged(self.starts[window[a : a + (1 << 16)]], n)
            same = (ends - starts)[mine] == self.word_sizes[its]
            same[same] = same_slices(shard, starts[mine[same]], self.hasher, self.word_starts[its[same]], self.word_sizes[its[same]])
            right[a : a + (1 << 16)] = np.logical_and.reduceat(same, np.cumsum(n) - n)
        return at[right], window[right]


def blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[Block]:
    """The benchmark's items, a bounded number of words at a time."""
    held: list[tuple[int | None, str]] = []
    size = 0
    for row in benchmark.select(item_id, text).where(F.col(text).isNotNull()).toLocalIterator():
        for piece in pieces(row[1]):
            n = len(piece) // 2 + 1
            if held and size + n > BLOCK_WORDS:
                yield Block(held)
                held, size = [], 0
            held.append((row[0], piece))
            size += n
    if held:
        yield Block(held)


def pieces(text: str) -> Iterator[str]:
    """A text, or if it may have more than BLOCK_WORDS words, pieces of it of so many, which share as many words as every window needs to be in one."""
    if len(text) // 2 + 1 <= BLOCK_WORDS:
        yield text
        return
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    starts, ends, _ = words_of(LOWER[data], np.array([0, len(data)]), IS_WORD)
    step = max(1, BLOCK_WORDS - WINDOW + 1)
    for a in range(0, max(1, len(starts) - WINDOW + 1), step):
        last = min(a + step + WINDOW - 1, len(starts))
        if last > a:
            yield data[starts[a] : ends[last - 1]].tobytes().decode("utf-8")


COLUMNS = ("n_words", "hit_words", "removal_spans", "hit_items")
SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def mark(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``df`` with ``n_words``, ``hit_words`` (first and past-the-last index of each run of hit words, one after the other),
    ``removal_spans`` (the same runs as code points of the text, end exclusive) and ``hit_items`` (ids, ascending)."""
    item_type = benchmark.schema[item_id].dataType
    fields = [T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.IntegerType())), T.StructField("removal_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))), T.StructField("hit_items", T.ArrayType(item_type))]
    from pyspark.sql.pandas.types import to_arrow_type

    item_arrow = pa.list_(to_arrow_type(item_type))
    sc = df.sparkSession.sparkContext
    first = True
    for block in (*blocks(benchmark, item_id, item_text), None):
        if block is None and not first:
            break
        shared = sc.broadcast(block or Block([]))  # at most BLOCK_WORDS words

        def start(shared=shared, first=first):
            hasher = SliceHash()

            def step(columns: list[pa.Array]) -> list[pa.Array]:
                block = shared.value
                data, offsets = utf8(columns[0])
                low = LOWER[data]
                starts, ends, counts = words_of(low, offsets, IS_WORD)
                at, window = block.occurrences(hasher.load(low), starts, ends, counts)
                n = len(counts)
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + block.lengths[window], -1)
                hit = np.cumsum(edge[:-1]) > 0
                bounds = np.concatenate([[0], np.cumsum(counts)])
                before = [None] * n if first else columns[1].to_pylist()
                listed = [None] * n if first else columns[2].to_pylist()
                spans_before = None if first else columns[3].to_pylist()
                rows = np.searchsorted(bounds, at, "right") - 1
                ranges, spans, items = [[]] * n, [[]] * n, [[]] * n
                if not first:
                    ranges, spans, items = before, spans_before, listed
                pairs = np.unique(rows * len(block.item_ids) + block.items[window]) if len(at) else np.zeros(0, np.int64)
                found: dict[int, set] = {}
                for p in pairs.tolist():
                    found.setdefault(p // len(block.item_ids), set()).add(block.item_ids[p % len(block.item_ids)])
                for i, ids in found.items():
                    mine = hit[bounds[i] : bounds[i + 1]].copy()
                    for a, b in zip((ranges[i] or [])[::2], (ranges[i] or [])[1::2]):
                        mine[a:b] = True
                    flips = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
                    ranges[i] = flips.tolist()
                    lead = np.concatenate([[0], np.cumsum((data[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80)])
                    s, e = starts[bounds[i] : bounds[i + 1]] - offsets[i], ends[bounds[i] : bounds[i + 1]] - offsets[i]
                    spans[i] = [{"start": a, "end": b} for a, b in zip(lead[s[flips[::2]]].tolist(), lead[e[flips[1::2] - 1]].tolist())]
                    items[i] = sorted((ids | set(items[i] or [])) - {None})
                return [pa.array(counts, pa.int64()), pa.array(ranges, pa.list_(pa.int32())), pa.array(spans, SPAN), pa.array(items, item_arrow)]

            return step

        df = map_batches(df, [text] if first else [text, "hit_words", "hit_items", "removal_spans"], fields, start)
        first = False
    return df


def judged(df: DataFrame) -> DataFrame:
    """``df`` of ``mark`` with ``n_hit`` and ``contaminated``."""
    total = F.aggregate(F.transform("hit_words", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    out = df.withColumn("n_hit", total)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text isn't contaminated, with its columns as they were."""
    kept = df.columns
    (body,) = fresh(df, "text_to_mark")
    # the text and the row travel together; clashing names stay out of the operator's way
    work = df.select(F.struct(*kept).alias("row_"), F.col(text).alias(body))
    return judged(mark(work, benchmark, body)).where(~F.col("contaminated")).select(*(F.col("row_").getField(c).alias(c) for c in kept))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every document against every item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judged(mark(docs, table(spark, sf_dir, "benchmark")).drop("text"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("hit_items", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"),
        "contaminated",
    )
