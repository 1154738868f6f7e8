"""What the operators of this package share: reading, byte-bounded slices of Arrow batches, word bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one NumPy step works on; a single longer text is a step of its own.
STEP_BYTES = 1 << 20


#: Rows of an Arrow batch: texts of a few thousand bytes make a few megabytes.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of BATCH_ROWS; a batch of long texts is still cut by slices()."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, column: str, step_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that `column` holds about step_bytes at most, at least one row each."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum([0 if v is None else v for v in pc.binary_length(batch.column(column)).to_pylist()])
        at, base = 0, 0
        while at < batch.num_rows:
            to = max(int(np.searchsorted(ends, base + step_bytes, "right")), at + 1)
            yield batch.slice(at, to - at)
            at, base = to, int(ends[to - 1])


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, one after another, and n + 1 bounds; null is empty."""
    filled = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(filled.type) or pa.types.is_large_binary(filled.type)
    bounds = np.frombuffer(filled.buffers()[1], dtype=np.int64 if wide else np.int32)
    bounds = bounds[filled.offset : filled.offset + len(filled) + 1].astype(np.int64)
    data = filled.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[bounds[0] : bounds[-1]], bounds - bounds[0]


#: Bytes that separate words: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in flat, and for each text the count of words before it (n + 1 values)."""
    if not len(flat):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(bounds), np.int64)
    inside = ~SPACE[flat]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = bounds[:-1][np.diff(bounds) > 0]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, bounds, "left")


_MIX = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64; a worker keeps what a step needs."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, STEP_BYTES + 1), base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if n <= 2 * STEP_BYTES:
            _POWERS[int(base)] = known
    return known[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def span_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of flat[start:end], equal for equal bytes whatever stands around them."""
    values = _MIX if not salt else mixed(_MIX + np.uint64(salt * 2654435761))
    up = powers(_BASE, len(flat) + 1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(values[flat] * up[:-1], out=sums[1:])
    down = powers(_INVERSE, len(flat) + 1)
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def run_hashes(words: np.ndarray, n: int, salt: int = 1) -> np.ndarray:
    """Hashes of n consecutive word hashes, one for each start (len(words) - n + 1)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    factor = np.uint64(0xC2B2AE3D27D4EB4F + 2 * salt)
    for k in range(n):
        out = out * factor + words[k : k + len(out)]
    return mixed(out)


def covered(n: int, starts: np.ndarray, lengths) -> np.ndarray:
    """Which of n places lie in [start, start + length)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + lengths, n), -1)
    return np.cumsum(step[:-1]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)
