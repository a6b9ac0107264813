"""ISO media containers: write payloads as tracks of 8-bit samples, and read containers without decoding them.

``write`` puts a payload (text as UTF-8, null counting as empty, padded with bytes 0 to a positive multiple of
64) into a movie with one sound track of raw 8-bit mono samples. An access unit is 64 samples; a chunk is 1,024
units, the first of which is a sync unit. Nothing in it depends on time or chance, so equal payloads give equal
containers, ties and repeated rows included.

``probe`` walks the nested boxes of any container, decodes each track's sample tables (sizes, chunks, decoding and
composition times, sync samples) and those of its fragments, and returns codec, duration, and the byte ranges and times of sync
samples. It reads box headers and tables only. A container that breaks off
or whose tables disagree gives an empty list of tracks and the reason in ``media_error``; a null container gives
an empty list and the reason 'null'. Ties and repeated rows give equal results, an empty table an empty one. New columns replace those
of the same name.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, table, utf8

UNIT, CHUNK_UNITS, RATE = 64, 1024, 8000
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)

TRACKS = T.ArrayType(
    T.StructType([
        T.StructField("track_id", T.LongType()), T.StructField("handler", T.StringType()), T.StructField("codec", T.StringType()),
        T.StructField("timescale", T.LongType()), T.StructField("duration", T.LongType()), T.StructField("samples", T.LongType()), T.StructField("bytes", T.LongType()),
        T.StructField("keyframes", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "end", "time")]))),
    ])
)


def box(kind: bytes, *parts: bytes) -> bytes:
    n = 8 + sum(map(len, parts))
    return b"".join([struct.pack(">I4s", n, kind) if n < 1 << 32 else struct.pack(">I4sQ", 1, kind, n + 8), *parts])


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def container(payload: bytes) -> bytes:
    """A movie with one sound track of ``payload``, whose length is a positive multiple of 64."""
    units, n = len(payload) // UNIT, len(payload)
    chunks = -(-units // CHUNK_UNITS)
    last = units - (chunks - 1) * CHUNK_UNITS
    runs = [(1, CHUNK_UNITS, 1)] if last == CHUNK_UNITS else [(1, CHUNK_UNITS, 1), (chunks, last, 1)] if chunks > 1 else [(1, last, 1)]
    wide = n >= 1 << 31
    times = struct.pack(">QQIQ" if wide else ">IIII", 0, 0, RATE, n)
    version = int(wide)

    def movie(at: int) -> bytes:
        places = (at + UNIT * CHUNK_UNITS * np.arange(chunks, dtype=np.int64)).astype(">i8" if wide else ">u4").tobytes()
        entry = box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
        tables = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, units, UNIT)),
            full_box(b"stss", struct.pack(">I", chunks), (1 + CHUNK_UNITS * np.arange(chunks, dtype=np.int64)).astype(">u4").tobytes()),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full_box(b"stsz", struct.pack(">II", UNIT, units)),
            full_box(b"co64" if wide else b"stco", struct.pack(">I", chunks), places),
        )
        info = box(b"minf", full_box(b"smhd", bytes(4)), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), tables)
        media = box(b"mdia", full_box(b"mdhd", times, struct.pack(">HH", 0x55C4, 0), version=version), full_box(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), info)
        track = full_box(b"tkhd", struct.pack(">QQIIQ" if wide else ">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, bytes(8), version=version, flags=3)
        return box(b"moov", full_box(b"mvhd", times, struct.pack(">IH10x", 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2), version=version), box(b"trak", track, media))

    kind = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomqt  ")
    header = 8 if n + 8 < 1 << 32 else 16
    size = len(movie(0))
    return b"".join([kind, movie(len(kind) + size + header), box(b"mdat", payload)])


def boxes(data: memoryview, at: int, end: int):
    """(kind, start of the content, its end) of the boxes from at to end."""
    while at < end:
        if end - at < 8:
            raise ValueError(f"a box header breaks off at {at}")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise ValueError(f"a box header breaks off at {at}")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if kind == b"uuid":
            head += 16
        if size < head or at + size > end:
            raise ValueError(f"box {kind.decode('latin-1')} at {at} has size {size}")
        yield kind, at + head, at + size
        at += size


def walk(data: memoryview, at: int, end: int, out: dict[bytes, list[tuple[int, int]]]) -> dict[bytes, list[tuple[int, int]]]:
    """The boxes of each kind below one box; tracks are left to a walk of their own."""
    for kind, a, b in boxes(data, at, end):
        out.setdefault(kind, []).append((a, b))
        if kind in CONTAINERS and kind != b"trak":
            walk(data, a, b, out)
    return out


def _table(data: memoryview, place: tuple[int, int], kind: str, columns: int = 1, skip: int = 4) -> np.ndarray:
    """The rows of a full box that has their number, then big-endian integers."""
    a, b = place
    (n,) = struct.unpack_from(">I", data, a + skip)
    width = np.dtype(kind).itemsize * columns
    if a + skip + 4 + n * width > b:
        raise ValueError("a sample table breaks off")
    return np.frombuffer(data, kind, n * columns, a + skip + 4).astype(np.int64).reshape(n, columns) if columns > 1 else np.frombuffer(data, kind, n, a + skip + 4).astype(np.int64)


def sample_table(data: memoryview, found: dict[bytes, list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Byte offset and size of each sample of a track."""
    a, _ = found[b"stsz"][0]
    size, n = struct.unpack_from(">II", data, a + 4)
    if n * size > len(data):
        raise ValueError("the samples are larger than the file")
    sizes = np.full(n, size, np.int64) if size else _table(data, found[b"stsz"][0], ">u4", skip=8)
    at = _table(data, found[b"co64"][0], ">u8") if b"co64" in found else _table(data, found[b"stco"][0], ">u4")
    runs = _table(data, found[b"stsc"][0], ">u4", 3)
    if not n:
        return sizes, sizes
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(at) + 1)))
    if len(per) != len(at) or per.sum() != n:
        raise ValueError("chunks and sizes disagree")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per) - per
    return np.repeat(at - before[first], per) + before, sizes


def sample_times(data: memoryview, found: dict[bytes, list[tuple[int, int]]], n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """When each sample is decoded and shown, and the sum of all durations, in the track's time scale."""
    runs = _table(data, found[b"stts"][0], ">u4", 2)
    if runs[:, 0].sum() != n:
        raise ValueError("times and sizes disagree")
    each = np.repeat(runs[:, 1], runs[:, 0])
    decoded = np.cumsum(each) - each
    shown = decoded
    if b"ctts" in found:
        a, _ = found[b"ctts"][0]
        runs = _table(data, found[b"ctts"][0], ">i4" if data[a] else ">u4", 2)
        times = runs[:, 0] & 0xFFFFFFFF
        if times.sum() != n:
            raise ValueError("composition times and sizes disagree")
        shown = decoded + np.repeat(runs[:, 1], times)
    return decoded, shown, int(each.sum())


#: A sample that needs others to be decoded.
NOT_SYNC = 0x10000


class Fields:
    """Big-endian 32-bit fields of a full box, one after the other."""

    def __init__(self, data: memoryview, place: tuple[int, int]) -> None:
        self.data, (self.at, self.end) = data, place
        self.version, self.flags = data[self.at], int.from_bytes(data[self.at + 1 : self.at + 4], "big")
        self.at += 4

    def take(self, kind: str = ">I", when: int = 0, other: int | None = None) -> int | None:
        """The next field; with ``when``, only if that flag is set, else ``other``."""
        if when and not self.flags & when:
            return other
        if self.at + struct.calcsize(kind) > self.end:
            raise ValueError("a fragment's box breaks off")
        (x,) = struct.unpack_from(kind, self.data, self.at)
        self.at += struct.calcsize(kind)
        return x


def fragments(data: memoryview, moof: int, found: dict[bytes, list[tuple[int, int]]], defaults: dict[int, tuple], known: dict[int, dict], reached: int) -> int:
    """Adds the samples of one track's part of a fragment that begins at ``moof`` to the track; ``reached`` is where the part before it ended."""
    head = Fields(data, found[b"tfhd"][0])
    number = head.take()
    if number not in known:
        raise ValueError(f"a fragment of track {number}, which isn't there")
    track, (duration, size, flags) = known[number], defaults.get(number, (0, 0, 0))
    base = head.take(">Q", 0x1, moof if head.flags & 0x20000 or not reached else reached)
    head.take(when=0x2)
    duration, size, flags = head.take(when=0x8, other=duration), head.take(when=0x10, other=size), head.take(when=0x20, other=flags)
    time = track["next"]
    if b"tfdt" in found:
        start = Fields(data, found[b"tfdt"][0])
        time = start.take(">Q" if start.version else ">I")
    at = base
    for place in found.get(b"trun", []):
        run = Fields(data, place)
        n = run.take()
        if not run.flags & 0x300 and n * max(size, 1) > len(data):
            raise ValueError("the samples are larger than the file")
        at = base + run.take(">i", 0x1, at - base)
        first = run.take(when=0x4)
        columns = [bit for bit in (0x100, 0x200, 0x400, 0x800) if run.flags & bit]
        if run.at + 4 * len(columns) * n > run.end:
            raise ValueError("a fragment's run breaks off")
        rows = np.frombuffer(data, ">u4", len(columns) * n, run.at).astype(np.int64).reshape(n, len(columns))
        column = lambda bit, other: rows[:, columns.index(bit)] if bit in columns else np.full(n, other, np.int64)
        durations, sizes, marks, late = column(0x100, duration), column(0x200, size), column(0x400, flags).copy(), column(0x800, 0)
        if n and first is not None:
            marks[0] = first
        if run.version:
            late = late.astype(np.uint32).view(np.int32).astype(np.int64)
        ends = at + np.cumsum(sizes)
        begins = time + np.cumsum(durations) - durations
        track["parts"].append((ends - sizes, sizes, begins + late, (marks & NOT_SYNC) == 0))
        at, time = int(ends[-1]) if n else at, time + int(durations.sum())
    track["next"] = time
    return at


def tracks(data: bytes) -> list[dict]:
    """Each track's codec, duration and sync samples; offsets, sizes and times of its samples as arrays."""
    view, known, defaults, start, end = memoryview(data), {}, {}, 0, 0
    for kind, a, b in boxes(view, 0, len(view)):
        start, end = end, b
        if kind == b"moov":
            for inner, c, d in boxes(view, a, b):
                if inner == b"trak":
                    track = _track(view, walk(view, c, d, {}))
                    known[track["track_id"]] = track
                elif inner == b"mvex":
                    for place in walk(view, c, d, {}).get(b"trex", []):
                        x = Fields(view, place)
                        number, _ = x.take(), x.take()
                        defaults[number] = (x.take(), x.take(), x.take())
        elif kind == b"moof":
            reached = 0
            for inner, c, d in boxes(view, a, b):
                if inner == b"traf":
                    found = walk(view, c, d, {})
                    if b"tfhd" not in found:
                        raise ValueError("a fragment lacks tfhd")
                    reached = fragments(view, start, found, defaults, known, reached)
    for t in known.values():
        at, sizes, shown, sync = (np.concatenate(x) for x in zip(*t.pop("parts")))
        t |= {"at": at, "sizes": sizes, "shown": shown, "sync": np.flatnonzero(sync), "duration": max(t["duration"], t.pop("next"))}
        if len(at) and (at.min() < 0 or (at + sizes).max() > len(view)):
            raise ValueError("a sample lies outside the file")
    return list(known.values())


def _track(view: memoryview, found: dict[bytes, list[tuple[int, int]]]) -> dict:
    try:
        m = found[b"mdhd"][0][0]
        scale, length = struct.unpack_from(">IQ", view, m + 20) if view[m] else struct.unpack_from(">II", view, m + 12)
        t = found[b"tkhd"][0][0]
        (number,) = struct.unpack_from(">I", view, t + (20 if view[t] else 12))
        h = found[b"hdlr"][0][0]
        entry = next(boxes(view, found[b"stsd"][0][0] + 8, found[b"stsd"][0][1]))[0]
        at, sizes = sample_table(view, found)
        _, shown, reached = sample_times(view, found, len(at))
        sync = np.ones(len(at), bool)
        if b"stss" in found:
            listed = _table(view, found[b"stss"][0], ">u4") - 1
            if len(listed) and (listed.min() < 0 or listed.max() >= len(at)):
                raise ValueError("a sync sample isn't there")
            sync[:] = False
            sync[listed] = True
    except KeyError as e:
        raise ValueError(f"a track lacks {e.args[0].decode('latin-1')}") from None
    return {"track_id": number, "handler": bytes(view[h + 8 : h + 12]).decode("latin-1"), "codec": entry.decode("latin-1"), "timescale": scale, "duration": length, "next": reached, "parts": [(at, sizes, shown, sync)]}


def write(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``df`` with each text in a container."""

    def start():
        def step(columns: list[pa.Array]) -> list[pa.Array]:
            data, offsets = utf8(columns[0])
            whole, at = data.tobytes(), offsets.tolist()
            return [pa.array([container(whole[a:e] + bytes(-(e - a) % UNIT or UNIT * (e == a))) for a, e in zip(at, at[1:])], pa.binary())]

        return step

    return map_batches(df, [text], [T.StructField(media, T.BinaryType())], start)


def probe(df: DataFrame, media: str = "media", payload: str | None = None) -> DataFrame:
    """``df`` with ``media_tracks`` and ``media_error``; ``payload`` names a column for the first track's sample bytes."""
    fields = [T.StructField("media_tracks", TRACKS), T.StructField("media_error", T.StringType())] + ([T.StructField(payload, T.BinaryType())] if payload else [])

    def start():
        def one(data: bytes | None) -> tuple[list[dict], str | None, bytes | None]:
            if data is None:
                return [], "null", None
            try:
                found = tracks(data)
            except (ValueError, struct.error, StopIteration) as e:
                return [], str(e) or "breaks off", None
            bytes_ = None
            if payload and found:
                at, sizes = found[0]["at"], found[0]["sizes"]
                # runs of samples that follow one another are read at once
                edge = np.flatnonzero(np.append(True, at[1:] != (at + sizes)[:-1])) if len(at) else np.zeros(0, int)
                stop = np.append(edge[1:], len(at)) - 1
                bytes_ = b"".join(data[a:b] for a, b in zip(at[edge].tolist(), (at + sizes)[stop].tolist())) if len(at) else b""
            rows = [{k: t[k] for k in ("track_id", "handler", "codec", "timescale", "duration")} | {"samples": len(t["at"]), "bytes": int(t["sizes"].sum()), "keyframes": [dict(zip(("start", "end", "time"), x)) for x in zip(t["at"][t["sync"]].tolist(), (t["at"] + t["sizes"])[t["sync"]].tolist(), t["shown"][t["sync"]].tolist())]} for t in found]
            return rows, None, bytes_

        kinds = _arrow_tracks()

        def step(columns: list[pa.Array]) -> list[pa.Array]:
            rows = [one(x.as_py()) for x in columns[0]]
            out = [pa.array([r[0] for r in rows], kinds), pa.array([r[1] for r in rows], pa.string())]
            return out + ([pa.array([r[2] for r in rows], pa.binary())] if payload else [])

        return step

    return map_batches(df, [media], fields, start)


def _arrow_tracks() -> pa.DataType:
    span = pa.struct([(c, pa.int64()) for c in ("start", "end", "time")])
    return pa.list_(pa.struct([("track_id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("bytes", pa.int64()), ("keyframes", pa.list_(span))]))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every text of documents stored in a container and read back; the feature is the track's description and its keyframes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = probe(write(docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))).drop("text"), payload="payload")
    t = F.element_at("media_tracks", 1)
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.to_json(F.struct(*(t[k].alias(k) for k in ("handler", "codec", "timescale", "duration", "samples", "bytes", "keyframes")))).alias("feature"),
    )
