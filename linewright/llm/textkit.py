"""Helpers that the operators of this subpackage share: byte-level word scanning in numpy, batches of bounded size, scratch tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; longer texts are passed alone.
SLICE_BYTES = 1_000_000
_MULT = 0x9E3779B97F4A7C15
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_MULT))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64))):
            out = np.full(size, np.uint64(base))
            out[0] = 1
            _POWERS[k] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut record batches so that each holds at most `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, offsets = utf8(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    n = len(raw)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[raw] if lower else raw] * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(raw: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^ \\t-\\r]+ of all documents, and the first word of each document (with the total last). `apart`: another table of the bytes between words."""
    inside = ~apart[raw]
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = inside
    first = offsets[:-1][np.diff(offsets) > 0]
    starts_mask = inside & ~before[:-1]
    starts_mask[first] = inside[first]
    ends_mask = np.zeros(len(raw) + 1, bool)
    ends_mask[1:] = inside
    ends_mask[:-1] &= ~inside
    last = offsets[1:][np.diff(offsets) > 0]
    ends_mask[last] = inside[last - 1]
    starts, ends = np.flatnonzero(starts_mask), np.flatnonzero(ends_mask)
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `size` words, with the document of each; shorter documents give their whole sequence as one, empty ones nothing."""
    counts = np.diff(bounds)
    out = np.zeros(max(len(hashes) - size + 1, 0), np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD1342543DE82EF95) + hashes[k : k + len(out)]
    docs = np.repeat(np.arange(len(counts)), counts)
    whole = docs[: len(out)] == docs[size - 1 :][: len(out)]
    out, owner = mix(out[whole]), docs[: len(whole)][whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            at = np.minimum(bounds[short] + k, max(len(hashes) - 1, 0))
            extra = np.where(has, extra * np.uint64(0xD1342543DE82EF95) + hashes[at], extra)
        out = np.concatenate([out, mix(extra ^ np.uint64(_MULT))])
        owner = np.concatenate([owner, short])
    return out, owner


def remainder(column: str | Column, modulus: int) -> Column:
    """crc32 of an id as text, modulo a number; null for a null id."""
    column = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus))


#: Bytes of an Arrow batch between the JVM and Python; the session's own setting holds where it is smaller.
BATCH_BYTES = 4_000_000


def bounded(spark: SparkSession) -> None:
    """Let batches hold BATCH_BYTES at most, so that long texts do not fill an executor's memory; a longer row is alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # nobody has set it
        spark.conf.set(name, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shielded(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`docs` with all columns but those needed inside one, so that an operator's own columns clash with none; and what gives back the columns as they were."""
    rest = [c for c in docs.columns if c not in needed]
    packed = docs.select(*needed, F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)), F.lit(0).alias("end")).alias("__rest"))
    place = {c: f"__rest.c{k}" for k, c in enumerate(rest)}
    return packed, lambda out: out.select(*(F.col(place.get(c, c)).alias(c) for c in docs.columns))


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or where that is unset (as in tests) one under the warehouse."""
    bounded(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again: its lineage ends there."""
    path = scratch(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
