"""Helpers shared by the training-data operators.

* staged tables: lineage is cut with a table written in the folder that all
  executors share (``spark.checkpoint.dir``), never with ``localCheckpoint``;
* vectorised word splitting and hashing over UTF-8 bytes, so a Python worker
  touches each text with a few numpy passes and never loops over characters.
"""

from __future__ import annotations

import atexit
import ctypes
import ctypes.util
import hashlib
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STAGED: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables: ``spark.checkpoint.dir``. Where the session has
    none, a temporary one is made and set if Spark is local; on a cluster a folder
    of one machine would not do, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        own = spark.sparkContext.getCheckpointDir()
    return own


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/staged/{label}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def staged(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The copy lives until :func:`release` or the end of the driver: DataFrames
    that an operator returns may still read it lazily.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def staged_paths(spark: SparkSession) -> list[str]:
    return list(_STAGED.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, keep: Iterable[str] = ()) -> None:
    """Delete the staged tables of this application but those to ``keep``."""
    stay = set(keep)
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    _STAGED[spark.sparkContext.applicationId] = [p for p in paths if p in stay]
    for path in paths:
        if path not in stay:
            _delete(spark, path)


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _STAGED else None
    if spark is not None:
        try:
            release(spark)
        except Exception:  # the JVM may be gone already; nothing is lost but disk
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id's text leaves 1 modulo 3; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


# ---------------------------------------------------------------- numpy text

def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Bytes of words split at ASCII white space.
SPACE_WORDS = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words split at every ASCII character but letters and digits.
ALNUM_WORDS = ~byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


#: Slices over this many bytes are hashed one by one with BLAKE2b.
LONG_SLICE = 64


def bytes_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each slice ``data[start:end]`` of bytes: eight bytes at a time
    go through a nonlinear mixer, so equal sums of bytes or powers do not meet."""
    size = ends - starts
    if not len(size):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on

    def part(at, left):
        spare = (8 * (8 - np.clip(left, 1, 8))).astype(np.uint64)
        return (eight[at] << spare) >> spare

    with np.errstate(over="ignore"):
        h = mix64(np.where(size > 0, part(starts, size), np.uint64(0)) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        todo = np.flatnonzero((size > 8) & (size <= LONG_SLICE))
        for k in range(8, LONG_SLICE, 8):
            if not len(todo):
                break
            h[todo] = mix64(h[todo] * np.uint64(0xD6E8FEB86659FD93) + part(starts[todo] + k, size[todo] - k))
            todo = todo[size[todo] > k + 8]
        for i in np.flatnonzero(size > LONG_SLICE).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


class Words:
    """The words of many texts: byte ``starts``/``ends``, ``hash`` and ``first``
    (``first[i]:first[i+1]`` are the words of text ``i``)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray, lower: bool = True):
        self.raw, self.offsets = data, offsets
        if lower:
            data = LOWER[data]
        n = len(data)
        inside = word_byte[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        cut = offsets[(offsets > 0) & (offsets < n)]  # a word never spans two texts
        cut = cut[inside[cut] & inside[cut - 1]]
        begin[cut] = True
        stop[cut - 1] = True
        self.data = data
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hash = bytes_hash(data, self.starts, self.ends)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


_LIBC = ctypes.CDLL(ctypes.util.find_library("c") or None)


def give_back() -> None:
    """Return free memory to the system: idle workers share an executor's limit with its JVM."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def text_chunks(column: pa.Array, most_bytes: int = (1 << 20) - 1):
    """Slices of a string column of about ``most_bytes`` bytes (one longer text
    is a slice of its own): (first row, last row + 1, bytes, offsets). Null is
    an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most_bytes, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
    give_back()


def ragged_arange(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def bounded_sample(rows: DataFrame, most: int, longest: int) -> DataFrame:
    """At most ``most`` rows (doc_id, text, ...), none with a text over ``longest`` bytes,
    picked by a hash of id and text: what a driver may learn from."""
    few = rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    share = min(1.0, most / max(1, few.count()))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000))
    return few.where(draw < int(share * 1_000_000)).orderBy(draw, *few.columns).limit(most)


def clear_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, those that are missing as null strings; others,
    whatever their names, can then not clash."""
    return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])
