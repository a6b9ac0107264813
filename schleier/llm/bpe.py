"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, and decoding by offsets.

Pre-tokenisation follows the split pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

without a regular expression over the text. Each code point gets a symbol (its class, with one
code point of look-ahead folded in); each symbol is a function on the eight states of an automaton.
Composition of functions is associative, so prefixes are composed block by block for all blocks at
once (the few hundred functions that can arise are numbered, composition is a table), the blocks'
totals are scanned in turn, and a table says for state and symbol whether a piece starts there.

Pieces are looked up by a hash of their bytes in a direct-mapped cache, and compared with the cached
piece byte by byte; those it lacks are merged together, one leftmost lowest-ranked pair in each piece
a round. Ranks are those of the vocabulary file, pairs merge when the joined bytes are in it, and a
piece that is in it stays whole.

Each token's end is kept as the byte offset in the text, counted from its piece's place; decoding
must reach the same offsets, or the task fails.

Null and empty text give no ids and empty bytes; equal texts, repeated rows and ties give equal ids.
What isn't valid UTF-8 in a text is read as U+FFFD, as Python's and Spark's decoders do. An empty
table gives an empty one. New columns replace those of the same name; all others stay.
"""

from __future__ import annotations

import base64
import functools
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SliceHash, binary_column, keep, map_batches, ragged, same_slices, steps, utf8

K, LETTERS, DIGITS, OTHER, APOSTROPHE, MIDDLE, JOINED, SPACES = range(8)
LETTER, LETTER_1, LETTER_2, NUMBER, SIGN, QUOTE, SPACE_BEFORE, BLANK_BEFORE, BLANK = range(9)
BLOCK = 64
NONE = np.iinfo(np.int32).max
#: Longer pieces are merged one by one with a heap.
VECTOR_BYTES = 32
#: Slots of the piece cache; pieces and bytes of pieces kept before it starts anew.
SLOTS, KEPT_PIECES, KEPT_BYTES = 1 << 19, 1 << 19, 1 << 23


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a symbol, and whether a piece starts at it."""
    if symbol in (LETTER, LETTER_1, LETTER_2):
        if state in (LETTERS, JOINED):
            return LETTERS, False
        if state == MIDDLE or state == APOSTROPHE and symbol == LETTER_1:
            return K, False
        if state == APOSTROPHE and symbol == LETTER_2:
            return MIDDLE, False
        return LETTERS, True
    if symbol == NUMBER:
        return DIGITS, state not in (DIGITS, JOINED)
    if symbol == SIGN:
        return OTHER, state not in (OTHER, JOINED, APOSTROPHE)
    if symbol == QUOTE:
        return (OTHER, False) if state in (OTHER, JOINED, APOSTROPHE) else (APOSTROPHE, True)
    if symbol == SPACE_BEFORE:
        return JOINED, True
    if symbol == BLANK_BEFORE:
        return K, True
    return SPACES, state != SPACES


class Automaton:
    """The transition functions that symbols generate (the first code point of a text starts anew), numbered, with their compositions."""

    def __init__(self) -> None:
        plain = [tuple(_step(s, x)[0] for s in range(8)) for x in range(9)]
        first = [(_step(K, x)[0],) * 8 for x in range(9)]
        number: dict[tuple[int, ...], int] = {}
        for f in plain + first:
            number.setdefault(f, len(number))
        known = list(number)
        for f in known:  # grows while it is read
            for g in plain + first:
                h = tuple(g[f[s]] for s in range(8))
                if h not in number:
                    number[h] = len(number)
                    known.append(h)
        n = len(known)
        self.size = n
        self.of_symbol = np.array([number[f] for f in plain + first], np.int16)
        self.then = np.array([[number[tuple(g[f[s]] for s in range(8))] for g in known] for f in known], np.int16).ravel()
        self.apply = np.array(known, np.uint8).ravel()
        self.starts = np.array([[_step(s, x)[1] for x in range(9)] for s in range(8)], bool).ravel()

    def piece_starts(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pieces start; ``first``: positions of the texts' first code points."""
        n = len(symbols)
        if not n:
            return np.zeros(0, np.int64)
        blocks = -(-n // BLOCK)
        f = np.zeros(blocks * BLOCK, np.int16)
        f[:n] = self.of_symbol[symbols]
        f[first] = self.of_symbol[9 + symbols[first]]
        f = np.ascontiguousarray(f.reshape(blocks, BLOCK).T)
        for j in range(1, BLOCK):
            f[j] = self.then[f[j - 1].astype(np.int32) * self.size + f[j]]
        state, entry, table = K, np.empty(blocks, np.uint8), self.apply.tolist()
        for b, total in enumerate(f[BLOCK - 1].tolist()):
            entry[b] = state
            state = table[total * 8 + state]
        before = np.empty((BLOCK, blocks), np.uint8)
        before[0] = entry
        before[1:] = self.apply[f[:-1].astype(np.int32) * 8 + entry]
        before = before.T.reshape(-1)[:n]
        start = self.starts[before.astype(np.int16) * 9 + symbols]
        start[first] = True
        return np.flatnonzero(start)


@functools.cache
def code_point_classes() -> np.ndarray:
    """For each code point: 0 letter, 1 number, 2 other, 3 white space."""
    out = np.full(0x110000, 2, np.uint8)
    for low in (*range(0, 0xD800, 0x800), *range(0xE000, 0x110000, 0x1000)):
        high = min(low + (0x800 if low < 0xD800 else 0x1000), 0x110000)
        every = "".join(map(chr, range(low, high)))
        for k, pattern in ((0, r"\p{L}+"), (1, r"\p{N}+"), (3, r"\s+")):
            for m in regex.finditer(pattern, every):
                out[low + m.start() : low + m.end()] = k
    return out


class Encoder:
    """Encodes batches of texts by the ranks of a vocabulary file; one in each worker process."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.classes = code_point_classes()
        self.automaton, self.hash = Automaton(), SliceHash()
        top = max(ranks.values()) + 1
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        words = [b""] * top
        for token, i in ranks.items():
            words[i] = token
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(words), np.uint8)
        self.token_hashes = np.sort(self.hash(self.pool, self.begins, self.begins + self.lengths))
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.words = words
        keys = np.array([a << 32 | b for a, b, _ in pairs], np.uint64)
        self._hash_pairs(keys, np.array([r for *_, r in pairs], np.int32))
        self._clear()

    def _clear(self) -> None:
        self.slot_hash, self.slot_piece = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        # of each kept piece: its ids' place and number, its bytes' place and number; piece 0 is none
        self.piece_at, self.piece_len, self.text_at, self.text_len = (np.zeros(1, np.int64) for _ in range(4))
        self.kept = np.zeros(0, np.int32)
        self.texts, self.used = SliceHash().load(np.zeros(1 << 16, np.uint8)), 0

    def _keep(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> int:
        """Keeps pieces with their ids; the number of the first."""
        base, total = len(self.piece_at), int(lengths.sum())
        if self.used + total > self.texts.size:
            more = np.zeros(2 * (self.used + total), np.uint8)
            more[: self.used] = self.texts.bytes[: self.used]
            self.texts.load(more)
        self.texts.bytes[self.used : self.used + total] = data[ragged(starts, lengths)]
        self.text_at = np.concatenate([self.text_at, self.used + np.cumsum(lengths) - lengths])
        self.text_len = np.concatenate([self.text_len, lengths])
        self.piece_at = np.concatenate([self.piece_at, len(self.kept) + np.cumsum(counts) - counts])
        self.piece_len, self.kept = np.concatenate([self.piece_len, counts]), np.concatenate([self.kept, ids])
        self.used += total
        return base

    def _hash_pairs(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressing table of the pairs, at most a quarter full."""
        self.bits = max(4, int(len(keys) * 4 - 1).bit_length())
        self.pair_keys, self.pair_ranks = np.full(1 << self.bits, np.uint64(2**64 - 1)), np.full(1 << self.bits, NONE, np.int32)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):
            free = self.pair_keys[at] == np.uint64(2**64 - 1)
            take, one = np.unique(at[free], return_index=True)
            who = left[free][one]
            self.pair_keys[take], self.pair_ranks[take] = keys[who], values[who]
            rest = self.pair_keys[at] != keys[left]
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = self._slot(keys)
        found = self.pair_keys[at]
        out = np.where(found == keys, self.pair_ranks[at], NONE)
        on = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        while len(on):
            at[on] = (at[on] + 1) & ((1 << self.bits) - 1)
            found = self.pair_keys[at[on]]
            hit = found == keys[on]
            out[on[hit]] = self.pair_ranks[at[on[hit]]]
            on = on[~hit & (found != np.uint64(2**64 - 1))]
        return out

    def symbols(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        kind = self.classes[code]
        out = np.array([LETTER, NUMBER, SIGN, BLANK], np.uint8)[kind]
        n = len(code)
        last = np.zeros(n, bool)
        last[first[1:] - 1] = last[-1:] = True
        quotes = np.flatnonzero(code == 0x27)
        out[quotes] = QUOTE
        # letters that end a contraction matter after an apostrophe only
        at = quotes[~last[quotes]] + 1
        one = at[np.isin(code[at], [ord(c) for c in "stmd"])]
        out[one] = LETTER_1
        at = at[~last[at]]
        two = (code[at].astype(np.int64) << 16) | code[at + 1]
        out[at[np.isin(two, [ord(a) << 16 | ord(b) for a, b in ("re", "ve", "ll")])]] = LETTER_2
        blank = np.flatnonzero(kind == 3)
        follows = blank[~last[blank]]
        follows = follows[kind[follows + 1] != 3]
        out[follows] = np.where(code[follows] == 0x20, SPACE_BEFORE, BLANK_BEFORE)
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """Pairs in order of rank, then place, from a heap."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        version = [0] * n
        words, ranks = self.words, self.ranks
        get = lambda a, b: ranks.get(words[a] + words[b])
        heap = [(r, i, 0, 0) for i in range(n - 1) if (r := get(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, mine, its = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or version[i] != mine or version[j] != its:
                continue
            ids[i], ids[j] = r, -1
            version[i] += 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := get(ids[i], ids[k])) is not None:
                    heapq.heappush(heap, (r, i, version[i], version[k]))
            if (h := before[i]) >= 0 and (r := get(ids[h], ids[i])) is not None:
                heapq.heappush(heap, (r, h, version[h], version[i]))
        return [i for i in ids if i >= 0]

    def merge(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the pieces and their number in each."""
        n = len(starts)
        counts, parts, owners = np.zeros(n, np.int64), [], []
        low = 0
        for high in (8, 16, VECTOR_BYTES):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            low = high
            if not len(rows):
                continue
            at = starts[rows, None] + np.arange(high)
            tokens = self.byte_ids[data[np.minimum(at, len(data) - 1)]]
            tokens[np.arange(high) >= lengths[rows, None]] = -1
            rank = np.full(tokens.shape, NONE, np.int32)
            pair = tokens[:, 1:] >= 0
            rank[:, :-1][pair] = self.pair_rank(tokens[:, :-1][pair], tokens[:, 1:][pair])
            live, cols = np.arange(len(rows)), np.arange(high)
            t, r = tokens, rank
            while len(live):
                m = r.argmin(1)
                lowest = r[np.arange(len(m)), m]
                go = lowest < NONE
                if not go.all():
                    tokens[live[~go]] = t[~go]
                    live, t, r, m, lowest = live[go], t[go], r[go], m[go], lowest[go]
                    if not len(live):
                        break
                shift = np.minimum(cols + (cols > m[:, None]), high - 1)
                t, r = np.take_along_axis(t, shift, 1), np.take_along_axis(r, shift, 1)
                every = np.arange(len(m))
                t[:, -1], r[:, -1] = -1, NONE
                t[every, m], r[every, m] = lowest, NONE
                right = every[(m + 1 < high)]
                right = right[t[right, m[right] + 1] >= 0]
                r[right, m[right]] = self.pair_rank(t[right, m[right]], t[right, m[right] + 1])
                left = every[m > 0]
                r[left, m[left] - 1] = self.pair_rank(t[left, m[left] - 1], t[left, m[left]])
            there = tokens >= 0
            counts[rows] = there.sum(1)
            parts.append(tokens[there])
            owners.append(rows)
        for i in np.flatnonzero(lengths > VECTOR_BYTES).tolist():
            piece = data[starts[i] : starts[i] + lengths[i]].tobytes()
            ids = [self.ranks[piece]] if piece in self.ranks else self.merge_long(piece)
            counts[i] = len(ids)
            parts.append(np.array(ids, np.int32))
            owners.append(np.array([i]))
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        order = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        at = np.empty(n, np.int64)
        at[order] = np.cumsum(counts[order]) - counts[order]
        flat = flat[ragged(at, counts)]
        # a piece that is a token stays whole even where merging doesn't reach it
        begin = np.cumsum(counts) - counts
        known = self.token_hashes[np.minimum(np.searchsorted(self.token_hashes, hashes), len(self.token_hashes) - 1)] == hashes
        for i in np.flatnonzero((counts > 1) & (lengths <= VECTOR_BYTES) & known).tolist():
            whole = self.ranks.get(data[starts[i] : starts[i] + lengths[i]].tobytes())
            if whole is not None:
                flat[begin[i]] = whole
                flat[begin[i] + 1 : begin[i] + counts[i]] = -1
                counts[i] = 1
        return flat[flat >= 0], counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of the texts, the number of ids in each, and the offset in ``data`` at which each token's bytes end."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n, np.int64), np.zeros(0, np.int64)
        code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.searchsorted(lead, np.unique(offsets[:-1][np.diff(offsets) > 0]))
        begins = lead[self.automaton.piece_starts(self.symbols(code, first), first)]
        ends = np.append(begins[1:], len(data))
        sizes = ends - begins
        h = self.hash.load(data).slices(begins, ends)
        h[h == 0] = 1
        if len(self.piece_at) > KEPT_PIECES or self.used > KEPT_BYTES:
            self._clear()
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        piece = np.where(self.slot_hash[slot] == h, self.slot_piece[slot], 0)
        miss = np.flatnonzero(piece == 0)
        if len(miss):
            new, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            which = miss[one]
            base = self._keep(data, begins[which], sizes[which], *self.merge(data, begins[which], sizes[which], new))
            piece[miss] = base + back
            at = (new & np.uint64(SLOTS - 1)).astype(np.int64)
            self.slot_hash[at], self.slot_piece[at] = new, np.arange(base, base + len(new))
        # equal hashes don't prove equal bytes
        same = self.text_len[piece] == sizes
        same[same] = same_slices(self.hash, begins[same], self.texts, self.text_at[piece[same]], sizes[same])
        if len(wrong := np.flatnonzero(~same)):
            piece[wrong] = self._keep(data, begins[wrong], sizes[wrong], *self.merge(data, begins[wrong], sizes[wrong], h[wrong])) + np.arange(len(wrong))
        counts = self.piece_len[piece]
        flat = self.kept[ragged(self.piece_at[piece], counts)]
        total = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=total[1:])
        reached = np.cumsum(self.lengths[flat])
        before = np.append(0, reached)[total[:-1]]
        return flat, np.diff(total[np.searchsorted(begins, offsets)]), reached + np.repeat(begins - before, counts)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, and the byte offset at which each ends."""
        if len(ids) and (int(ids.max()) >= len(self.lengths) or int(ids.min()) < 0):
            raise ValueError("an id is not in the vocabulary")
        lengths = self.lengths[ids]
        return self.pool[ragged(self.begins[ids], lengths)], np.cumsum(lengths)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    keep(__name__, encoder.cache_clear)
    return Encoder(path)


def valid(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with U+FFFD for what isn't UTF-8; offsets follow."""
    try:
        data.tobytes().decode("utf-8")
        # a character may not reach over a text's end either
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        if not ((data[inner] & 0xC0) == 0x80).any():
            return data, offsets
    except UnicodeDecodeError:
        pass
    fixed = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(offsets, offsets[1:])]
    return np.frombuffer(b"".join(fixed), np.uint8), np.concatenate([[0], np.cumsum([len(f) for f in fixed])]).astype(np.int64)


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "token_ids", ends: str | None = "token_ends", decoded: str | None = None) -> DataFrame:
    """``df`` with the ids of each text and the byte offset in the text at which each token ends.

    Both are packed as little-endian unsigned 32-bit integers in a binary column; ``ends=None`` leaves the offsets out.
    ``decoded`` names a column for the bytes decoded from the ids in the same pass, as ``decode`` would, whose tokens
    must end at these offsets.
    """

    def start():
        enc = encoder(vocabulary)

        def step(columns: list[pa.Array]) -> list[pa.Array]:
            data, offsets = valid(*utf8(columns[0]))
            flat, counts, places, made, edges = [], [], [], [], [np.zeros(1, np.int64)]
            for a, b in steps(offsets):
                part = offsets[a : b + 1] - offsets[a]
                x, n, stops = enc.encode(data[offsets[a] : offsets[b]], part)
                flat.append(x.astype("<u4"))
                counts.append(n)
                if ends:
                    places.append((stops - np.repeat(part[:-1], n)).astype("<u4"))
                if decoded:
                    bytes_, reached = enc.decode(x)
                    if not np.array_equal(reached, stops):
                        raise ValueError("the decoded tokens don't end where the text's do")
                    made.append(bytes_)
                    edges.append(np.append(0, reached)[np.cumsum(n)] + edges[-1][-1])
            until = np.cumsum(np.concatenate(counts)) * 4
            out = [binary_column(np.concatenate(flat).view(np.uint8), until)]
            out += [binary_column(np.concatenate(places).view(np.uint8), until)] if ends else []
            return out + ([binary_column(np.concatenate(made), np.concatenate(edges[1:]))] if decoded else [])

        return step

    return map_batches(df, [text], [T.StructField(c, T.BinaryType()) for c in (ids, ends, decoded) if c], start)


def decode(df: DataFrame, vocabulary: str, ids: str = "token_ids", ends: str | None = None, decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes of the packed ids; with ``ends``, each token's bytes must end where the offset says."""

    def start():
        enc = encoder(vocabulary)

        def step(columns: list[pa.Array]) -> list[pa.Array]:
            data, offsets = utf8(columns[0])
            want = utf8(columns[1]) if ends else None
            out, until, total = [], [], 0
            for a, b in steps(offsets, 1 << 21):
                x = np.frombuffer(data[offsets[a] : offsets[b]].tobytes(), "<u4").astype(np.int64)
                made, stops = enc.decode(x)
                cut = (offsets[a : b + 1] - offsets[a]) // 4
                edges = np.concatenate([[0], stops])[cut]
                if want and len(x) and not np.array_equal(np.frombuffer(want[0][want[1][a] : want[1][b]].tobytes(), "<u4"), (stops - np.repeat(edges[:-1], np.diff(cut))).astype("<u4")):
                    raise ValueError("the retained offsets don't belong to these ids")
                out.append(made)
                until.append(edges[1:] + total)
                total += len(made)
            return [binary_column(np.concatenate(out), np.concatenate(until))]

        return step

    return map_batches(df, [ids] + ([ends] if ends else []), [T.StructField(decoded, T.BinaryType())], start)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every text of documents encoded and decoded again."""
    from .common import table

    vocabulary = default_vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, vocabulary, decoded="decoded")
    return out.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2("token_ends", 256).alias("ends_sha256"),
    )
