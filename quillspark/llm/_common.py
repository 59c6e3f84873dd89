"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; bounds a Python worker's memory.
STEP_BYTES = 1 << 19

#: glibc's, where there is one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: The mark that SentencePiece vocabularies have for a space.
SPACE = "▁"

MIX = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``, and it is an error if none is
    set there. Only in local mode, as in tests, a temporary folder takes its place.
    """
    where = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else ""
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="shared-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage now, Python's first, as that holds the JVM's: Spark deletes the shuffle files of finished jobs only then, which a roomy heap puts off for a whole run."""
    gc.collect()
    trim()
    spark.sparkContext._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again (columnar, compressed)."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote. Only for those whose every reader has been written out itself: a lost executor must not need them again."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_prefix(df: DataFrame, prefix: str) -> str:
    """A prefix that no column of ``df`` starts with, for columns that come and go; letter case doesn't count."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix = f"_{prefix}"
    return prefix


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values and their n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def spaced_words(texts: pa.Array, prefix: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Runs of spaces with the other characters behind them, as bytes, and how many each text has.

    The space mark counts as a space; ``prefix`` puts a space before each text that isn't empty.
    """
    flat, offsets = flat_text(pc.replace_substring(texts, SPACE, " "))
    some = offsets[:-1] < offsets[1:]
    if prefix:
        flat = np.insert(flat, offsets[:-1][some], 32)
        offsets = offsets + np.r_[0, np.cumsum(some)]
    space = flat == 32
    new = np.r_[True, ~space[:-1]][: len(flat)] & space
    new[offsets[:-1][some]] = True
    start = np.flatnonzero(new)
    at = np.r_[start, len(flat)].astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(flat))])
    return found, np.diff(np.searchsorted(start, offsets))


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer row comes alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def trim() -> None:
    """Gives memory that lies free back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


#: What this worker remembers between tasks, by owner: each has ``forget()``.
_kept: list = []


def tidy(batches: Iterator[pa.RecordBatch], mine: object = None) -> Iterator[pa.RecordBatch]:
    """The same batches; after each, memory that lies free goes back to the system, so that idle workers stay small.

    A reused worker first forgets what other operators remember: all code books but ``mine``.
    """
    for book in _kept:
        if book is not mine:
            book.forget()
    trim()
    for batch in batches:
        yield batch
        trim()


class CodeBook:
    """Numbers (such as token ids) of chunks of text that a worker met before.

    Beyond ``most`` chunks or ``most_bytes`` bytes of them, those that stood in one
    step alone are forgotten, or all if that isn't half. One that ``tidy`` is not
    given as its own is emptied.
    """

    def __init__(self, dtype: type = np.int32, most: int = 400_000, most_bytes: int = 16 << 20) -> None:
        self.dtype, self.most, self.most_bytes = dtype, most, most_bytes
        self.forget()
        _kept.append(self)

    def __len__(self) -> int:
        return len(self.code)

    def forget(self) -> None:
        self.code: defaultdict[bytes, int] = defaultdict()
        self.code.default_factory = self.code.__len__
        self.bytes = 0
        self.uses = np.zeros(0, np.int32)  # steps in which a chunk stood
        self.flat = np.zeros(0, self.dtype)
        self.at = np.zeros(1, np.int64)

    def _thin(self) -> None:
        names = list(self.code)
        keep = np.flatnonzero(self.uses[: len(names)] > 1)
        size = (self.at[1:] - self.at[:-1])[keep]
        flat = self.flat[ranges(self.at[keep], size)]
        self.forget()
        names = [names[k] for k in keep.tolist()]
        if 2 * len(names) <= self.most and 2 * (held := sum(map(len, names))) <= self.most_bytes:
            for w in names:
                self.code[w]  # takes the next number
            self.bytes, self.flat, self.at = held, flat, np.r_[0, np.cumsum(size)]
            self.uses = np.zeros(len(names), np.int32)

    def look_up(self, chunks: pa.Array, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all chunks in a row, and how many each has; ``encode`` gives them for new chunks."""
        if len(self.code) > self.most or self.bytes > self.most_bytes:
            self._thin()
        chunks = chunks.dictionary_encode()
        words, known = chunks.dictionary.to_pylist(), len(self.code)
        own = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        if len(self.code) > known:
            # numbers ascend by first place, and so do the new words here
            fresh = [words[k] for k in np.flatnonzero(own >= known).tolist()]
            numbers, sizes = encode(fresh)
            used = int(self.at[-1])
            if used + len(numbers) > len(self.flat):
                self.flat = np.r_[self.flat[:used], np.zeros(len(numbers) + used // 4, self.dtype)]
            self.flat[used : used + len(numbers)] = numbers
            self.at = np.r_[self.at, used + np.cumsum(sizes)]
            self.bytes += sum(map(len, fresh))
            if len(self.code) > len(self.uses):
                self.uses = np.r_[self.uses, np.zeros(len(self.code) + len(self.code) // 4 - len(self.uses), np.int32)]
        self.uses[own] += 1
        codes = own[chunks.indices.to_numpy()]
        start = self.at[codes]
        size = self.at[codes + 1] - start
        return self.flat[ranges(start, size)], size


def bitmap(keys: DataFrame, column: str, bits: int):
    """A broadcast bitmap of the low bits of a hash column: its size is fixed, whatever the rows; made of words that the cluster ORs together."""
    h = keys.select(F.col(column).bitwiseAND((1 << bits) - 1).alias("h"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(63).cast("int"))
    words = h.groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    del words
    trim()
    return keys.sparkSession.sparkContext.broadcast(out)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each range, one after another."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser for 64-bit sums."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def odd_powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def byte_values(seed: int) -> np.ndarray:
    """A 64-bit number for each byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(seed | 1) + MIX)


def null_safe_id(df: DataFrame, id_col: str) -> DataFrame:
    return df.withColumn("id", F.col(id_col).cast("long"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges(a, b)``; the component is its smallest id.

    Alternating large-star and small-star steps over a distributed edge table;
    each step groups by a vertex with pre-aggregated minima and joins that back. The
    edges of a vertex pass through one task as a stream of pairs, and are never
    gathered; nothing reaches the driver but two counts a round. Lineage is cut by
    checkpoints.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = checkpointed(e)
    before = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: neighbours above a vertex are tied to the smallest neighbour
        e = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: neighbours below a vertex, and itself, are tied to the smallest of them
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        tied = e.join(low, "a")
        e = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(tied.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        e = checkpointed(e)
        release(e.sparkSession)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003), F.count_distinct("a")).first())
        # a star forest has one edge for each vertex that is not a root, and no root hangs from another
        if now == before and now[0] == now[2]:
            break
        before = now
    roots = e.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component"))
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
