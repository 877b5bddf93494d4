"""What the training-data operators share: staged tables and whole-column text arithmetic.

The numpy helpers work on the UTF-8 bytes of a whole Arrow batch at once, so that
Python runs a few array operations per megabyte instead of a loop per word.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one array pass handles; a longer single document is a pass of its own.
CHUNK = 1 << 20

_STAGED: list[tuple[SparkSession, str, str | None]] = []
#: Stands in for an unset spark.checkpoint.dir, which a running session does not let us set.
_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir.

    Where that is unset and all tasks run in this process (tests), one temporary folder
    stands in for it; on a cluster it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(f"file://{tempfile.mkdtemp(prefix='tradewind-')}")
        found = _LOCAL[0]
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation. The
    tables go when the driver process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    dropped_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def dropped_at_exit(spark: SparkSession, path: str, table: str | None = None) -> None:
    """Delete the folder, and the table over it, when the driver process ends."""
    _STAGED.append((spark, path, table))


@atexit.register
def _drop_staged() -> None:
    for spark, path, table in _STAGED:
        try:
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: the folder's owner cleans up
            return


def passes(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each holds one row, or at most `limit` bytes of a
    string column or elements of a list column."""
    for batch in batches:
        values = batch.column(column)
        length = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
        sizes = pc.fill_null(length(values), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < len(sizes):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column, and len + 1 offsets. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = pc.fill_null(column.cast(pa.binary()) if pa.types.is_string(column.type) else column, b"")
    kind = np.int64 if pa.types.is_large_binary(raw.type) or pa.types.is_large_string(raw.type) else np.int32
    _, ends, data = raw.buffers()
    if len(raw) == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(len(raw) + 1, np.int64)
    offsets = np.frombuffer(ends, kind)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


_MULTIPLIER = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Base ** i and base ** -i modulo 2 ** 64 for i below n; kept and grown by doubling."""
    while len(_POWERS[0]) < n:
        m = len(_POWERS[0])
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.uint64(pow(base, m, 1 << 64))
            _POWERS[k] = np.concatenate([_POWERS[k], _POWERS[k] * step])
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A 64-bit value for each byte (or code point below 256).
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))


class Hashes:
    """Hashes of any substrings of one array, after a single cumulative sum."""

    def __init__(self, values: np.ndarray):
        powers, self.inverse = _powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(_MULTIPLIER))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, being runs of other bytes than space and 09 to 0D, A-Z as a-z.

    Returns start and end byte, document number and 64-bit hash of each word.
    """
    empty = np.zeros(0, np.int64)
    if not len(data):
        return empty, empty, empty, np.zeros(0, np.uint64)
    solid = ~_SPACE[data]
    begins, ends = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    begins[0], begins[1:-1] = solid[0], solid[1:] & ~solid[:-1]
    ends[-1], ends[1:-1] = solid[-1], ~solid[1:] & solid[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[solid[cuts] & solid[cuts - 1]]
    begins[cuts] = ends[cuts] = True
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
    docs = np.searchsorted(offsets, starts, "right") - 1
    return starts, stops, docs, Hashes(BYTE_VALUES[_LOWER[data]]).of(starts, stops)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values; n - 1 fewer than the values."""
    total = len(hashes) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:total].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(_MULTIPLIER) + hashes[k : k + total])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's LongType."""
    return x.astype(np.uint64, copy=False).view(np.int64)
