"""Shared pieces: written tables that cut lineage, and vectorised word hashing."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the word separator of every operator here.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  Where none is set, a local session gets a folder of its
    own; on a cluster that is an error, as executors would write to their own disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _sweep() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before
            return


atexit.register(_sweep)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


#: Spark's setting by which a query's shuffle files go when it ends, not when the driver collects its garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str, *, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, so a
    lost executor costs no recomputation of what came before.  With ``free`` the shuffle
    files of the write go as soon as it ends."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(_FREED, None)
    try:
        if free:
            spark.conf.set(_FREED, "true")
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*frames: DataFrame) -> None:
    """Delete the files of ``cut`` tables that nothing will read any more."""
    for frame in frames:
        _delete(frame.sparkSession, frame._written_to)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- word hashing

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, 9, 10, 11, 12, 13]] = True
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier and of its inverse, modulo 2**64."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        out = []
        for base in (_P, _P_INVERSE):
            a = np.empty(size, dtype=np.uint64)
            a[0] = 1
            done = 1
            while done < size:
                a[done : 2 * done] = a[:done] * np.uint64(pow(base, done, 1 << 64))
                done *= 2
            out.append(a)
        _powers[size] = (out[0], out[1])
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts: byte spans, 64-bit hashes, and each text's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        spaces = _SPACES[data]
        n = len(data)
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.ones(n, dtype=bool)
        if n:
            before[1:] = spaces[:-1]
        before |= edge[:n]
        after = np.ones(n, dtype=bool)
        if n:
            after[:-1] = spaces[1:]
        after |= edge[1:]
        inside = ~spaces
        self.data = data
        self.starts = np.flatnonzero(inside & before)
        self.ends = np.flatnonzero(inside & after) + 1
        #: Words of text i are those from bounds[i] to bounds[i + 1].
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        power, inverse = _power_tables(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)], out=total[1:])
        h = (total[self.ends] - total[self.starts]) * inverse[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64))

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def chained(h: np.ndarray, k: int, q: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hashes of every k consecutive values (len(h) - k + 1 of them), by doubling."""
    if len(h) < k:
        return np.empty(0, dtype=np.uint64)
    result, have = None, 0
    part, size = h, 1
    while True:
        if k & size:
            if result is None:
                result, have = part, size
            else:
                m = len(h) - (have + size) + 1
                result = result[:m] * np.uint64(pow(q, size, 1 << 64)) + part[have : have + m]
                have += size
        if have == k:
            return mix(result)
        m = len(part) - size
        part = part[:m] * np.uint64(pow(q, size, 1 << 64)) + part[size : size + m]
        size *= 2


def text_slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole texts in runs of about ``most`` bytes: first row, end row, bytes, offsets.

    Nulls count as empty.  A text longer than ``most`` comes alone.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        end = min(n, max(first + 1, end))
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


_SPACE_BYTE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(raw: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """A text's bytes in pieces that end at white space, so that no word is cut: each as short as
    that allows from ``most`` bytes on."""
    first = 0
    while first < len(raw):
        space = _SPACE_BYTE.search(raw, first + most) if first + most < len(raw) else None
        end = space.end() if space else len(raw)
        yield raw[first:end]
        first = end


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that columns of any name travel untouched; ``row.*`` brings them back."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def utf8(column: str = "text"):
    """The text with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))
