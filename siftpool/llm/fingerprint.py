"""Context-triggered piecewise hashing of texts, and likeness of two fingerprints by edit distance.

A rolling hash over seven bytes ends a chunk where its low bits are all ones;
how many bits that takes is a text's block size, the smallest that leaves at
most 64 chunks. Each chunk gives one character. A fingerprint has the
signatures for its block size and for twice that, so that two fingerprints can
be compared at the same, half or double size.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftpool.llm.textops import parts_for, slices, text_bytes

LENGTH = 64  # characters of a signature at most
WINDOW = 7
BUCKET_BYTES, RANGES = 16 << 20, 16384  # wanted size of a range of ids, and ranges at most
CHANCE = 0.25  # share of matching characters between unrelated signatures, about
SYMBOLS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def _rolling(buf: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each run of WINDOW bytes."""
    m = np.uint32(0x01000193)
    one = buf.astype(np.uint32) + np.uint32(1)
    two = one[:-1] * m + one[1:]
    four = two[:-2] * (m * m) + two[2:]
    h = four[:-3] * (m * m * m) + two[4:-1] * m + one[6:]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h ^ (h >> np.uint32(13))


def fingerprints(column: pa.Array) -> list[tuple[int, bytes, bytes]]:
    """(block exponent, signature, signature at the double size) of each text."""
    buf, offs = text_bytes(column)
    with np.errstate(over="ignore"):
        h = _rolling(buf) if len(buf) >= WINDOW else np.zeros(0, np.uint32)
    level = np.bitwise_count(h & ~(h + np.uint32(1)))  # trailing ones
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h, out=total[1:])
    out = []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        n = b - a - WINDOW + 1
        if n < 1:
            whole = xxhash.xxh64_intdigest(buf[a:b].tobytes())  # no window fits: all of a hash, so that only equal texts are equal
            sign = bytes(int(SYMBOLS[whole >> 6 * i & 63]) for i in range(11)) if b > a else b""
            out.append((0, sign, sign))
            continue
        own = level[a : a + n]
        ends = np.cumsum(np.bincount(own, minlength=33)[::-1])[::-1]  # chunk ends by block exponent
        k = int(np.argmax(ends < LENGTH))
        signs = []
        for e in (k, k + 1):
            cut = np.flatnonzero(own >= e) + 1
            if not len(cut) or cut[-1] < n:
                cut = np.append(cut, n)
            sums = np.diff(total[a + np.concatenate(([0], cut))])
            signs.append(SYMBOLS[((sums * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)).astype(np.int64)].tobytes())
        out.append((k, *signs))
    return out


def as_text(f: tuple[int, bytes, bytes]) -> str:
    return f"{1 << f[0]}:{f[1].decode()}:{f[2].decode()}"


def _common(pairs: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Length of the longest common subsequence of each pair of signatures, bit-parallel over all pairs."""
    n = len(pairs)
    a = np.zeros((n, LENGTH), np.uint8)
    b = np.zeros((n, LENGTH), np.uint8)
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)] = np.frombuffer(x, np.uint8)
        b[i, : len(y)] = np.frombuffer(y, np.uint8)
    rank = np.full(256, 64)
    rank[SYMBOLS] = np.arange(64)
    a, b = rank[a], rank[b]
    masks = np.zeros((n, 65), np.uint64)
    row = np.arange(n)
    for j in range(LENGTH):
        masks[row, a[:, j]] |= np.uint64(1 << j)
    masks[:, 64] = 0
    v = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(LENGTH):
        u = v & masks[row, b[:, j]]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


def likeness(left: list[tuple[int, bytes, bytes]], right: list[tuple[int, bytes, bytes]]) -> np.ndarray:
    """From 0 to 1 for each pair of fingerprints: 1 less the share of insertions and deletions between signatures of one block size, rescaled so that chance gives 0; 1 for equal fingerprints, 0 where no sizes are compatible."""
    pairs, owner = [], []
    out = np.zeros(len(left))
    for i, (x, y) in enumerate(zip(left, right)):
        if x == y:
            out[i] = 1
        elif x[0] == y[0]:
            pairs += [(x[1], y[1]), (x[2], y[2])]
            owner += [i, i]
        elif x[0] == y[0] + 1:
            pairs.append((x[1], y[2]))
            owner.append(i)
        elif y[0] == x[0] + 1:
            pairs.append((x[2], y[1]))
            owner.append(i)
    if pairs:
        size = np.array([len(x) + len(y) for x, y in pairs])
        share = 2 * _common(pairs) / np.maximum(size, 1)
        np.maximum.at(out, owner, np.maximum(0, (share - CHANCE) / (1 - CHANCE)))
    return np.minimum(out, 1)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one for each row of docs.

    The next row is that of the next smaller id, after the last the first; rows
    of one id follow by text, null ids come last. The edited text has its last
    third of code points replaced by as many of the next text's first. Rows are
    dealt to ranges of ids of about equal size; a range's first row is also sent
    to the range before it, so nothing is ordered in one task. Null texts count
    as empty; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size, ids = rows.agg(F.sum(F.octet_length("text")), F.count("id")).first()
    n = min(RANGES, max(2 * parts_for(spark), math.ceil((size or 0) / BUCKET_BYTES)), max(ids, 1))
    marks = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    rows = _ranged(rows, sorted({float(m) for m in marks or []}))
    first = sorted((r.bucket, r.top) for r in rows.groupBy("bucket").agg(F.max("id").alias("top")).collect())  # at most one for each mark
    tails = [(top, first[(i + 1) % len(first)][0]) for i, (_, top) in enumerate(first)]
    copied = rows
    if tails:
        sent = F.broadcast(spark.createDataFrame(tails, "top bigint, to int"))  # one row for each range
        extra = rows.join(sent, F.col("id").eqNullSafe(F.col("top"))).select("id", "text", F.col("to").alias("bucket"), F.lit(True).alias("tail"))
        copied = rows.withColumn("tail", F.lit(False)).unionByName(extra)
    else:
        copied = rows.withColumn("tail", F.lit(False))
    order = ["bucket", "tail", F.desc_nulls_last("id"), "text"]

    def run(batches):
        held = None  # the last row, which waits for its next
        bucket = None

        def work(texts: list[str], ids: list, tail: list[bool]):
            """Rows but the last, each with the row after it."""
            own = fingerprints(pa.array(texts, pa.string()))
            edited, size = [], []
            for x, y in zip(texts, texts[1:]):
                k = len(x) // 3
                edited.append(x[: len(x) - k] + y[:k])
                size.append(len(x))
            changed = []
            at = pa.RecordBatch.from_arrays([pa.array(edited, pa.string())], ["t"])
            for part in slices(at, "t"):
                changed += fingerprints(part.column("t"))
            keep = [i for i, t in enumerate(tail[:-1]) if not t]
            near, follow = likeness(own[:-1], changed), likeness(own[:-1], own[1:])
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in keep], pa.int64()), pa.array([size[i] for i in keep], pa.int64()), pa.array([hashlib.sha256(edited[i].encode()).hexdigest() for i in keep], pa.string()), pa.array([as_text(own[i]) for i in keep], pa.string()), pa.array([as_text(changed[i]) for i in keep], pa.string()), pa.array(near[keep]), pa.array(follow[keep])],
                ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                buckets = part.column("bucket").to_numpy()
                texts, ids, tail = (part.column(c).to_pylist() for c in ("text", "id", "tail"))
                cuts = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(texts)]
                for a, b in zip(cuts, cuts[1:]):
                    if held is not None and bucket == buckets[a]:
                        yield work([held[0], *texts[a:b]], [held[1], *ids[a:b]], [held[2], *tail[a:b]])
                    elif b - a > 1:
                        yield work(texts[a:b], ids[a:b], tail[a:b])
                    held, bucket = (texts[b - 1], ids[b - 1], tail[b - 1]), buckets[a]

    schema = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = copied.repartition(parts_for(spark), "bucket").sortWithinPartitions(*order).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def _ranged(rows: DataFrame, marks: list[float]) -> DataFrame:
    """rows with the number of marks below or at their id in bucket; null ids are in the first."""
    if not marks:
        return rows.withColumn("bucket", F.lit(0))
    from pyspark.ml.feature import Bucketizer

    cut = Bucketizer(splits=[-math.inf, *marks, math.inf], inputCol="at", outputCol="bucket")
    first = F.coalesce(F.col("id").cast("double"), F.lit(-math.inf))
    return cut.transform(rows.withColumn("at", first)).drop("at").withColumn("bucket", F.col("bucket").cast("int"))
