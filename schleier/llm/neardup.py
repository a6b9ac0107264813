"""Near-duplicates by BagMinHash signatures, bands, and verified multiset overlap.

Words are runs of digits, letters (A-Z lower-cased) and everything beyond ASCII; a text's bag is the multiset of
its shingles of five words (of all its words, if fewer). Two texts are linked if the weighted Jaccard similarity
of their bags is at least 0.8.

*Signature.* Each shingle of weight w owns a stack of Poisson processes over the weights (0, 1], (1, 2], (2, 4], ...
Their points have a time, a register and a weight in the layer; a bag has the points up to its own weight, and a
register holds its earliest time. Two bags agree in a register with the probability of their weighted Jaccard
similarity. Only points before a time at which, all but surely, every register has one are made; a bag with an
empty register is done again with twice the time. Times are integers, so they don't depend on what else is in a
batch.

*Bands.* 160 registers make 32 bands of 5; a pair at 0.8 misses all bands with a probability of 3e-6.

*Links.* Equal word sequences are one node; nodes with more copies have lower numbers. In each bucket of a band
every node is verified against the bucket's least node. Then, in buckets that still hold several components:
buckets of at most SMALL nodes have all pairs of different components verified. Larger ones that share nodes
make a family, and all pairs of different components of a family are compared in Python, a pair of blocks at once:
their sizes, then their registers' fingerprints (LEAST of 160 must agree; by the
exact sum a pair at 0.8 fails this with a probability of 2e-9), then their bags. Only links
that join components leave it, so its rows grow with the nodes, but its time with the square of a family.
Components are found in Spark; their class id is the least doc_id.

Texts without words are linked to equal texts only; null counts as empty. Repeated rows each get their class, ties too. A
null id is the greatest. Empty tables give empty ones. ``dedupe`` keeps all columns, whatever their names; ``classes`` gives its own only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import SliceHash, map_batches, mix, ragged, steps, stored, table, utf8, words_of
from .decontaminate import IS_WORD, LOWER
from .graph import components, spread

SHINGLE, REGISTERS, ROWS = 5, 160, 5
BANDS = REGISTERS // ROWS
TICKS = float(1 << 32)
NEVER = np.iinfo(np.int64).max
KEY_BITS = 52
#: Texts that are signed at once: each has over a thousand points, however short it is.
STEP_BYTES, STEP_ROWS = 1 << 19, 200
#: Nodes of a bucket whose pairs are all verified.
SMALL = 32
#: Registers, of 160, in which two nodes of a family agree at least if their bags are compared.
LEAST = 96
#: Pairs of one node that a task verifies.
DEALT = 4096
#: A family's nodes are compared in blocks of this many bytes, each node counted with NODE_BYTES more.
BLOCK_BYTES, NODE_BYTES = 4 << 20, 2048
U = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray, hasher: SliceHash) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (row, 52-bit hash, count), then starts and ends of the words and their number in each row."""
    low = LOWER[data]
    starts, ends, counts = words_of(low, offsets, IS_WORD)
    words = hasher(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    first = np.cumsum(counts) - counts
    at = ragged(first, n)
    rows = np.repeat(np.arange(len(counts)), n)
    size = np.minimum(counts, SHINGLE)[rows]
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(SHINGLE):
            on = size > j
            h = np.where(on, (h ^ words[np.minimum(at + j, len(words) - 1)]) * U(0x9E3779B97F4A7C15) + U(j + 1), h) if len(words) else h
    key = np.sort((rows.astype(np.uint64) << U(KEY_BITS)) | (mix(h) >> U(64 - KEY_BITS)))
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> U(KEY_BITS)).astype(np.int64), key & U((1 << KEY_BITS) - 1), times, (starts, ends), counts


def _uniform(seed: np.ndarray) -> np.ndarray:
    return ((seed >> U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def signatures(rows: np.ndarray, keys: np.ndarray, weights: np.ndarray, n_rows: int) -> np.ndarray:
    """n_rows x REGISTERS earliest times; NEVER throughout for a row without shingles."""
    layers = np.ceil(np.log2(weights)).astype(np.int64) + 1 if len(weights) else weights
    owner = np.repeat(np.arange(len(keys)), layers)
    layer = np.arange(len(owner)) - np.repeat(np.cumsum(layers) - layers, layers)
    base = np.where(layer == 0, 0, 1 << np.maximum(layer - 1, 0))
    width = np.where(layer == 0, 1, np.maximum(base, 1))
    with np.errstate(over="ignore"):
        seed = mix(keys[owner] * U(0xD1B54A32D192ED03) + mix(layer.astype(np.uint64) + U(77)))
    row, limit = rows[owner], weights[owner]
    total = np.bincount(rows, weights, n_rows)
    out = np.full((n_rows, REGISTERS), NEVER, np.int64)
    horizon = np.where(total > 0, (np.log(REGISTERS) + 6) * REGISTERS / np.maximum(total, 1), 0)
    todo = np.arange(len(owner))
    while len(todo):
        until = horizon[row[todo]]
        s, rate = seed[todo], width[todo].astype(np.float64)
        # the first point of most processes comes too late
        early = np.flatnonzero(_uniform(mix(s + U(1))) >= np.exp(-rate * until) * (1 - 1e-9))
        s, rate, until, mine = s[early], rate[early], until[early], todo[early]
        reached, made = np.zeros(len(mine), np.int64), np.zeros(len(mine), np.int64)
        while len(mine):
            left = rate * np.maximum(until - reached / TICKS, 0)
            n = np.ceil(left + 4 * np.sqrt(left)).astype(np.int64) + 2
            which = np.repeat(np.arange(len(mine)), n)
            begin = np.cumsum(n) - n
            number = np.arange(len(which)) - np.repeat(begin, n) + made[which] + 1
            with np.errstate(over="ignore"):
                point = s[which] + number.astype(np.uint64)
                gap = np.floor(-np.log(_uniform(mix(point))) * (TICKS / rate[which])).astype(np.int64)
                time = np.cumsum(gap)
                time += np.repeat(reached - (time[begin] - gap[begin]), n)
                where = mix(point ^ U(0xA5A5A5A5A5A5A5A5))
            keep = time <= until[which] * TICKS
            p = mine[which[keep]]
            register = ((where[keep] >> U(32)) * U(REGISTERS) >> U(32)).astype(np.int64)
            inside = base[p] + ((where[keep] & U(0xFFFFFFFF)).astype(np.float64) / TICKS) * width[p]
            within = inside < limit[p]
            np.minimum.at(out.reshape(-1), row[p[within]] * REGISTERS + register[within], time[keep][within])
            last = time[begin + n - 1]
            go = np.flatnonzero(last <= until * TICKS)
            mine, s, rate, until, made, reached = mine[go], s[go], rate[go], until[go], (made + n)[go], last[go]
        bare = (out == NEVER).any(1) & (total > 0)
        todo = np.flatnonzero(bare[row])
        horizon = np.where(bare, 2 * horizon, horizon)
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    s = signature.astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    h = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), s.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            h = mix(h * U(0x9E3779B97F4A7C15) + s[:, :, j])
    return h.view(np.int64)


def _words_key(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, raw: bytes, offsets: np.ndarray) -> list[bytes]:
    """A digest of each row's words; of its bytes where it has none."""
    lengths = ends - starts + 1
    joined = np.full(int(lengths.sum()), 32, np.uint8)
    put = ragged(np.cumsum(lengths) - lengths, lengths - 1)
    joined[put] = low[ragged(starts, lengths - 1)]
    whole, stop = joined.tobytes(), np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    digest = lambda b, kind: hashlib.blake2b(b, digest_size=16, person=kind).digest()
    return [digest(whole[a:b], b"words") if b > a else digest(raw[offsets[i] : offsets[i + 1]], b"bytes") for i, (a, b) in enumerate(zip(stop, stop[1:]))]


def sign(df: DataFrame, text: str, key: str = "text_key", bands: str = "bands", registers: str = "registers") -> DataFrame:
    """``df`` with a digest of each text's words, its band hashes (none for a text without words), and 16-bit fingerprints of its registers."""
    fields = [T.StructField(key, T.BinaryType()), T.StructField(bands, T.ArrayType(T.LongType())), T.StructField(registers, T.BinaryType())]

    def start():
        hasher = SliceHash()

        def step(columns: list[pa.Array]) -> list[pa.Array]:
            data, offsets = utf8(columns[0])
            keys, hashes, prints = [], [], []
            for a, b in steps(offsets, STEP_BYTES, STEP_ROWS):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                rows, found, times, (starts, ends), counts = shingles(part, at, hasher)
                signature = signatures(rows, found, times, b - a)
                made = band_hashes(signature)
                prints += [r.tobytes() for r in (mix(signature.view(np.uint64)) >> U(48)).astype("<u2")]
                hashes += [made[i] if counts[i] else made[i][:0] for i in range(b - a)]
                keys += _words_key(LOWER[part], starts, ends, counts, part.tobytes(), at)
            return [pa.array(keys, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(prints, pa.binary())]

        return step

    return map_batches(df, [text], fields, start)


def bags(df: DataFrame, text: str, bag: str = "bag") -> DataFrame:
    """``df`` with each text's bag: ascending 64-bit hashes of shingle and occurrence number, packed."""

    def start():
        hasher = SliceHash()

        def step(columns: list[pa.Array]) -> list[pa.Array]:
            data, offsets = utf8(columns[0])
            out = []
            for a, b in steps(offsets):
                rows, keys, times, *_ = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], hasher)
                number = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                with np.errstate(over="ignore"):
                    tagged = mix(np.repeat(keys, times) + number.astype(np.uint64) * U(1 << KEY_BITS))
                cut = np.searchsorted(np.repeat(rows, times), np.arange(b - a + 1))
                out += [np.sort(tagged[s:e]).tobytes() for s, e in zip(cut, cut[1:])]
            return [pa.array(out, pa.binary())]

        return step

    return map_batches(df, [text], [T.StructField(bag, T.BinaryType())], start)


def overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    """``df`` of pairs of bags with ``shared`` and ``joint``: sizes of the intersection and the union of the multisets."""

    def start():
        def step(columns: list[pa.Array]) -> list[pa.Array]:
            shared, joint = [], []
            for x, y in zip(columns[0], columns[1]):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.sort(np.concatenate([p, q]))
                n = int((both[1:] == both[:-1]).sum())
                shared.append(n)
                joint.append(len(p) + len(q) - n)
            return [pa.array(shared, pa.int64()), pa.array(joint, pa.int64())]

        return step

    return map_batches(df, [a, b], [T.StructField("shared", T.LongType()), T.StructField("joint", T.LongType())], start)


def joined(df: DataFrame) -> DataFrame:
    """Links (a, b) between the labels of each family of ``df`` (family, node, label, registers, bag): all pairs of nodes of different
    labels are compared, a pair of blocks at once; of the links that join the same labels, only some are given."""
    spark = df.sparkSession
    ship(spark)
    sizes = df.groupBy("family").agg(F.ceil(F.sum(F.octet_length("bag") + NODE_BYTES) / BLOCK_BYTES).cast("int").alias("blocks"))
    dealt = spread(df, sizes, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")

    def one(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, label, block = (table[c].to_numpy() for c in ("node", "label", "block"))
        prints = np.frombuffer(b"".join(table["registers"].to_pylist()), "<u2").reshape(-1, REGISTERS)
        held = [np.frombuffer(x, np.uint64) for x in table["bag"].to_pylist()]
        size = np.array([len(x) for x in held])
        within, found = bool((block == block[0]).all()), []
        root = label.copy()
        for x in range(len(node)):
            near = np.flatnonzero((root != root[x]) & (5 * np.minimum(size, size[x]) >= 4 * np.maximum(size, size[x])) & (within | (block > block[x])))
            near = near[near > x] if within else near
            near = near[np.count_nonzero(prints[near] == prints[x], axis=1) >= LEAST] if len(near) else near
            if not len(near):
                continue
            other = np.concatenate([held[y] for y in near])
            at = np.minimum(np.searchsorted(held[x], other), size[x] - 1)
            shared = np.add.reduceat((held[x][at] == other).astype(np.int64), np.cumsum(size[near]) - size[near])
            for y in near[5 * shared >= 4 * (size[near] + size[x] - shared)]:
                if root[y] != root[x]:
                    found.append((min(node[x], node[y]), max(node[x], node[y])))
                    root[root == root[y]] = root[x]
        return pa.table({c: pa.array([f[k] for f in found], pa.int64()) for k, c in enumerate("ab")})

    return dealt.groupBy("family", "i", "j").applyInArrow(one, "a long, b long")


def _exact(text):
    """A digest of the text as it is."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``df``: its id, its ``text_key`` and ``exact`` digest, ``class_id`` (the least id of its class), and
    ``class_number``, which tells classes apart whose least ids are the same, or null."""
    docs = df.select(F.col(doc_id).alias("id"), F.col(text).alias("body"), _exact(F.col(text)).alias("exact"))
    signed = stored(sign(docs, "body").drop("body"), "signed")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "exact")).alias("first")
    nodes = signed.groupBy("text_key").agg(first, F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("registers").alias("registers"))
    # in a node's number its copies come first, so that the least of a bucket is its most copied text
    number = F.monotonically_increasing_id() + F.shiftleft((1023 - F.least("copies", F.lit(1023))).cast("long"), 53)
    nodes = stored(nodes.select("text_key", F.col("first.id").alias("least"), F.col("first.exact").alias("exact"), "bands", "registers", number.alias("node")), "nodes")

    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    pivots = banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    # a bucket may hold a third of all nodes
    members = stored(spread(banded, pivots, "bucket").select("node", "bucket", "pivot", "n"), "members")
    pairs = stored(members.where("pivot <> node").groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.max("n").alias("n")), "pairs")
    wanted = members.select("node").distinct().join(nodes.select("node", F.col("exact").alias("wanted_exact"), "least"), "node")
    # the id and the digest name the row; of equal rows one is taken
    texts = docs.join(wanted, (F.col("exact") == F.col("wanted_exact")) & F.col("id").eqNullSafe(F.col("least")))
    bag = stored(bags(texts.groupBy("node").agg(F.first("body").alias("body")), "body").select("node", "bag"), "bags")

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b, n); an ``a`` with up to n pairs is dealt to a task for each DEALT of them."""
        parts = F.ceil(F.col("n") / DEALT).cast("int")
        dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), parts).cast("int"))
        bag_a = pairs.groupBy("a").agg(F.max("n").alias("n")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
        bag_a = bag_a.join(bag.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a")
        both = dealt.join(bag.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b").join(bag_a, ["a", "part"])
        return overlap(both, "bag_a", "bag_b").where("5 * shared >= 4 * joint").select("a", "b")

    links = stored(verified(pairs), "links")

    def mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
        """Members of buckets that hold several components, with their labels."""
        placed = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        several = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
        return spread(placed, several, "bucket").select(*members.columns, "label")

    labels = components(links)
    left = stored(mixed(members, labels), "mixed")
    small = left.where(F.col("n") <= SMALL)
    x, y = (small.select("bucket", F.col("node").alias(a), F.col("label").alias(f"of_{a}")) for a in "ab")
    crossing = x.join(y, "bucket").where("a < b and of_a <> of_b").select("a", "b").distinct()
    links = links.union(stored(verified(crossing.join(pairs, ["a", "b"], "left_anti").withColumn("n", F.lit(1))), "links"))
    labels = components(links)
    # a bucket of one component stays one
    large = stored(mixed(left.where(F.col("n") > SMALL).drop("label"), labels), "mixed")
    ends = large.where("pivot <> node").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    if not ends.isEmpty():
        families = components(ends).withColumnRenamed("label", "family")
        placed = large.select("node", "label").distinct().join(families, "node").join(nodes.select("node", "registers"), "node").join(bag, "node")
        links = links.union(stored(joined(placed), "links"))
        labels = components(links)
    # texts without a link are their own class; of the others, one class may have a third of all
    linked = nodes.select("node", "text_key", "least").join(labels, "node")
    named = linked.groupBy("label").agg(F.min("least").alias("class_id"))
    of_key = spread(linked.select("text_key", "label"), named, "label").select("text_key", "class_id", F.col("label").alias("class_number"))
    of_key = of_key.union(nodes.join(labels, "node", "left_anti").select("text_key", F.col("least").alias("class_id"), F.col("node").alias("class_number")))
    # a text with very many copies is a skewed key of narrow rows, which adaptive execution splits
    return signed.select("id", "text_key", "exact").join(of_key, "text_key").select(F.col("id").alias(doc_id), "text_key", "exact", "class_id", "class_number")


def dedupe(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of ``df``, that of the least id, with its columns as they were."""
    found = classes(df, doc_id, text).withColumnRenamed(doc_id, "id")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "text_key", "exact")
    keep = found.groupBy("class_number").agg(F.min(order).alias("kept")).select(F.col("kept.id").alias("kept_id"), F.col("kept.exact").alias("kept_exact"))
    rows = df.select(F.struct(*df.columns).alias("row_"), F.col(doc_id).alias("id"), _exact(F.col(text)).alias("exact"))
    kept = rows.join(keep, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("exact") == F.col("kept_exact")))
    first = F.row_number().over(Window.partitionBy("id", "exact").orderBy(F.lit(0)))
    return kept.withColumn("number_", first).where("number_ = 1").select(*(F.col("row_").getField(c).alias(c) for c in df.columns))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the class of every document."""
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
