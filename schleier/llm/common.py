"""Helpers the operators share: tables, column names, Arrow buffers as numpy arrays, vectorised hashes.

Every hash here is 64 bits wide and computed the same way in every process, so that results don't
depend on the worker that made them.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..shipping import ship

#: Bytes of text that one vectorised step holds; a longer document is a step of its own.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names starting with the given ones that ``df`` doesn't have (names differing by case clash)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The columns of ``df`` that an operator keeps when it adds ``names``: its own replace clashing ones."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir. Where that is unset, a local one if the
    master is local (tests), else an error: a folder of the driver's own machine is never used on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(spark, "_schleier_dir", None)
        if not base:
            base = spark._schleier_dir = tempfile.mkdtemp(prefix="schleier-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    spark._schleier_paths = [*getattr(spark, "_schleier_paths", ()), path]
    return path


def release(spark: SparkSession) -> int:
    """Deletes the folders that operators have made in this session; how many. What still reads from them can't be computed any more."""
    paths, spark._schleier_paths = getattr(spark, "_schleier_paths", []), []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, in the folder all executors share."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or shared_dir(spark, "checkpoint"))
    return df.checkpoint()


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again; unlike a checkpoint it is compressed and pruned by column."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and len + 1 offsets into them; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets, data = column.buffers()[1:3]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, limit: int = CHUNK_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row, and of at most ``rows`` rows."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, n, at + rows)
        yield at, end
        at = end


def binary_column(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of the values that end at the byte offsets ``ends``."""
    offsets = np.zeros(len(ends) + 1, np.int64)
    offsets[1:] = ends
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1, one range after the other."""
    if not len(starts) or not (total := int(lengths.sum())):
        return np.zeros(0, np.int64)
    out = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    out += np.arange(total)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64's)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class SliceHash:
    """64-bit hashes of many byte slices at once.

    A slice is read eight bytes at a time; each step goes through the finaliser, so that no ring's algebra
    (polynomials modulo 2^64 have colliding words of 1,024 bytes whatever the base) survives it. Its length is in the
    first step. Slices over LONG bytes are hashed by BLAKE2b. Operators whose results must be exact compare bytes too.
    """

    LONG, ROWS = 128, 1 << 17

    size = 0
    bytes = np.zeros(8, np.uint8)

    def load(self, data: np.ndarray) -> SliceHash:
        """Takes the buffer whose slices ``slices`` hashes."""
        self.size = len(data)
        self.bytes = np.zeros(len(data) + 8, np.uint8)
        self.bytes[: len(data)] = data
        # the eight bytes from each position on
        self.words = np.ndarray((len(data) + 1,), "<u8", self.bytes, strides=(1,))
        return self

    def __getstate__(self) -> np.ndarray:
        return self.bytes[: self.size]

    def __setstate__(self, data: np.ndarray) -> None:
        self.load(data)

    def block(self, at: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Eight bytes from each position, those from the ``rest``-th on as 0."""
        out = self.words[at]
        short = np.flatnonzero(rest < 8)
        out[short] &= MASKS[rest[short]]
        return out

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        for a in range(0, len(starts), self.ROWS):
            out[a : a + self.ROWS] = self._some(starts[a : a + self.ROWS], ends[a : a + self.ROWS])
        return out

    def _some(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        left = ends - starts
        h = mix(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03))
        long = np.flatnonzero(left > self.LONG)
        live = np.flatnonzero((left > 0) & (left <= self.LONG)) if len(long) else np.flatnonzero(left > 0)
        at, left = starts[live], left[live]
        with np.errstate(over="ignore"):
            while len(live):
                h[live] = mix((h[live] ^ self.block(at, left)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xA0761D6478BD642F))
                on = left > 8
                live, at, left = live[on], at[on] + 8, left[on] - 8
        for i in long.tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.bytes[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        return h

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.load(data).slices(starts, ends)


#: The first 0 to 7 bytes of eight.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)


def same_slices(a: SliceHash, a_starts: np.ndarray, b: SliceHash, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the slices of two loaded buffers have the same bytes."""
    out = np.ones(len(lengths), bool)
    live, x, y, left = np.arange(len(lengths)), a_starts, b_starts, lengths
    for _ in range(8):
        on = left > 0
        live, x, y, left = live[on], x[on], y[on], left[on]
        if not len(live):
            return out
        out[live] = a.block(x, left) == b.block(y, left)
        on = out[live]
        live, x, y, left = live[on], x[on] + 8, y[on] + 8, left[on] - 8
    for i, s, e, n in zip(live.tolist(), x.tolist(), y.tolist(), left.tolist()):
        out[i] = n <= 0 or a.bytes[s : s + n].tobytes() == b.bytes[e : e + n].tobytes()
    return out


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes with is_word[byte], cut at the rows' ends, and the number of words in each row."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = is_word[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    # a run that crosses into the next row is two words
    cut = np.unique(offsets[1:-1])
    if len(cut) and len(starts):
        at = np.searchsorted(starts, cut, "left") - 1
        crossed = cut[(at >= 0) & (ends[at] > cut)]
        if len(crossed):
            starts, ends = np.sort(np.concatenate([starts, crossed])), np.sort(np.concatenate([ends, crossed]))
    counts = np.diff(np.searchsorted(starts, offsets, "left"))
    return starts, ends, counts


def bound_batches(spark: SparkSession) -> None:
    """Sets the session to Arrow batches of few rows and few bytes, so that a worker's memory doesn't depend on the texts' lengths.

    The queries and the pipeline's stages call this. The operators don't: what a caller has set stays as it is.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = (spark.conf.get(key) or "").removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


#: By module, how to let go of what its operators keep in a worker from task to task.
_kept: dict[str, Callable[[], None]] = {}


def keep(module: str, let_go: Callable[[], None]) -> None:
    """Says how to let go of what the operators of ``module`` keep in this worker; done once another module's task begins in it."""
    _kept[module] = let_go


def begin(module: str) -> None:
    """A task of ``module`` begins in a worker that other stages may have used: what those keep goes."""
    if others := [m for m in _kept if m != module]:
        for m in others:
            _kept.pop(m)()
        trim()


def trim() -> None:
    """Gives freed memory back to the machine: a worker outlives its stage, and idle ones count beside the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, columns: list[str], fields: list[T.StructField], fn: Callable[[], Callable[[list[pa.Array]], list[pa.Array]]]) -> DataFrame:
    """``df`` with ``fields`` computed from ``columns``, a batch at a time, without moving rows.

    ``fn()`` is called once in a task and returns the function from the columns of a batch to the new ones.
    New columns replace those of the same name. A batch is as large as the session says: see ``bound_batches``.
    """
    keep = without(df, [f.name for f in fields])
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    ship(df.sparkSession)
    names, places = schema.names, [df.columns.index(c) for c in keep]
    inputs = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(fn.__module__)
        step, b = fn(), None
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(i) for i in places] + step([b.column(i) for i in inputs]), names)
        del step, b
        trim()

    return df.mapInArrow(run, schema)
