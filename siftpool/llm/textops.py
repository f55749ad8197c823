"""Vectorised text helpers that run inside Arrow batches.

Everything works on the UTF-8 bytes of an Arrow string column, so a batch of
documents becomes a few numpy arrays: the bytes, the byte span of each word and
the range of words of each document. Nulls count as empty texts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Byte classes: words between white space, and words of letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BLOCK = 1 << 20  # bytes hashed at a time
_LONG = 1 << 16  # longer words are hashed one by one
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about max_bytes of text, to bound the memory of what follows."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + max_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each text begins (and the last ends)."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and where each text's words begin; words never cross texts."""
    if not len(buf):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offs), np.int64)
    inside = table[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offs[(offs > 0) & (offs < len(buf))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that any of their bits can serve as a hash."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _powers or len(_powers[base][0]) < n:
        inverse = np.uint64(pow(base, -1, 1 << 64))
        up, down = np.full(n, np.uint64(base)), np.full(n, inverse)
        up[0] = down[0] = 1
        _powers[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[base]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit polynomial hash of each word, from prefix sums over blocks of bytes."""
    base = _BASES[seed]
    out = np.zeros(len(starts), np.uint64)
    up, down = _tables(base, _BLOCK + _LONG + 1)
    sizes = ends - starts
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + _BLOCK, "right")))
        if sizes[i] > _LONG:
            out[i] = xxhash.xxh3_64_intdigest(buf[at : ends[i]].tobytes(), seed)
            i += 1
            continue
        part = buf[at : ends[j - 1]].astype(np.uint64)
        part += np.uint64(1)
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=prefix[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (prefix[e] - prefix[s]) * down[s]
        i = j
    for k in np.flatnonzero(sizes > _LONG):
        out[k] = xxhash.xxh3_64_intdigest(buf[starts[k] : ends[k]].tobytes(), seed)
    return mix(out + sizes.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def window_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Rabin-Karp hashes of every run of k values: sum of h[i+j] * c**(k-1-j) modulo 2**64.

    Runs of powers of two are joined to make k, so each value is touched about
    2*log2(k) times. The caller leaves out runs that cross texts.
    """
    if len(h) < k:
        return np.zeros(0, np.uint64)
    c, done, out, span, width = _BASES[seed], 0, None, h, 1
    while True:
        if k & width:
            if out is None:
                out = span
            else:  # what is there, then this span
                n = len(h) - done - width + 1
                out = out[:n] * np.uint64(pow(c, width, 1 << 64)) + span[done : done + n]
            done += width
        if done == k:
            return mix(out)
        n = len(span) - width
        span = span[:n] * np.uint64(pow(c, width, 1 << 64)) + span[width : width + n]
        width *= 2


def run_starts(bounds: np.ndarray, k: int) -> np.ndarray:
    """Indices of all values from which k values remain in their text; bounds: where each text's values begin."""
    room = np.maximum(np.diff(bounds) - k + 1, 0)
    shift = bounds[:-1] - np.concatenate(([0], np.cumsum(room)[:-1]))
    return np.arange(int(room.sum())) + np.repeat(shift, room)


def binary(parts: list[np.ndarray | bytes]) -> pa.Array:
    return pa.array([p if isinstance(p, bytes) else p.tobytes() for p in parts], pa.binary())


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; on one machine, one of our own where none is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or os.path.join(os.path.abspath(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")), "checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder once and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{os.urandom(8).hex()}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what written() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def parts_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal integer keys, across batches; only one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(cols[:, a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
