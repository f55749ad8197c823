"""Substring deduplication: every fixed-length window of words that occurs more than once, removed.

1. Documents are packed into chunks of bounded size, written once to the shared
   folder, so that a chunk is the same rows in the same order whenever it is
   read.
2. A task hashes every window of a chunk (Rabin-Karp over word hashes). Equal
   windows of a chunk are combined there; the distinct hashes go, in order, to
   buckets by their leading bits: a passage that a third of all documents share
   costs one value per chunk. A chunk's work depends on its own windows only,
   not on the number of buckets.
3. Each bucket counts in how many chunks a hash occurs and answers each chunk
   with one bit per hash.
4. Chunks put the bits to their windows and merge repeated windows into maximal
   intervals of words.

Chunks and buckets grow with the square root of the input, so that a chunk's part
of a bucket stays some dozens of hashes, but GROW times at most.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftpool.llm.textops import binary, grouped, parts_for, run_starts, slices, text_bytes, window_hashes, word_hashes, words, written

CHUNK_BYTES = 4 << 20  # of text, before it grows
BUCKET = 1 << 20  # windows of a bucket, before it grows
GROW = 16  # so many times at most; bounds a task's memory
ROWS = 10_000  # of a batch sent to buckets
RUN = 64  # hashes that a chunk should have in a bucket


def _growth(size: int) -> int:
    """How many times chunks and buckets grow for an input of so many bytes, a power of two."""
    hashes = CHUNK_BYTES * BUCKET / max(size, 1)  # of a chunk in a bucket
    return min(GROW, 1 << max(0, math.ceil(math.log2(RUN / hashes) / 2)))


def _packed(docs: DataFrame, text_col: str, chunk_bytes: int) -> DataFrame:
    """Rows (chunk, n_words, rows): documents with all their columns as compressed Arrow data."""

    def run(batches):
        task, held, size, k = TaskContext.get().partitionId(), [], 0, 0
        how = pa.ipc.IpcWriteOptions(compression="zstd")

        def out():
            nonlocal held, size, k
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=how) as to:
                to.write_table(table)
            n = sum(len(words(*text_bytes(c))[0]) for c in table.column(text_col).cast(pa.string()).chunks)
            k += 1
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + k - 1], pa.int64()), pa.array([n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "n_words", "rows"])

        for batch in batches:
            for part in slices(batch, text_col, chunk_bytes // 4):
                held.append(part)
                size += pc.sum(pc.binary_length(part.column(text_col))).as_py() or 0
                if size >= chunk_bytes or sum(x.num_rows for x in held) >= 1 << 17:
                    yield out()
        if held:
            yield out()

    return docs.mapInArrow(run, "chunk bigint, n_words bigint, rows binary")


class _Windows:
    """A chunk's documents, their words and the distinct hashes of their windows."""

    def __init__(self, rows: bytes, text_col: str, window: int):
        self.batch = pa.ipc.open_stream(rows).read_all().combine_chunks().to_batches()[0]
        self.buf, self.offs = text_bytes(self.batch.column(text_col))
        self.starts, self.ends, self.bounds = words(self.buf, self.offs)
        self.at = run_starts(self.bounds, window)
        w = window_hashes(word_hashes(self.buf, self.starts, self.ends), window)
        self.hashes, self.back, self.count = np.unique(w[self.at] if len(self.at) else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)

    def cuts(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that the hashes fall in, by their leading bits, and where each one's hashes begin, and the end."""
        own = self.hashes >> np.uint64(64 - bits) if bits else np.zeros(len(self.hashes), np.uint64)
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
        return own[first].astype(np.int64), np.append(first, len(own))


def remove_repeats(docs: DataFrame, text_col: str, window: int, schema: str, finish: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """finish(rows, bytes, word starts, word ends, words of each text, removed) of each chunk of docs, as one DataFrame."""
    spark = docs.sparkSession
    grow = _growth(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)
    packed = written(_packed(docs, text_col, CHUNK_BYTES * grow), "chunks")
    bits = max(0, math.ceil(math.log2(max(1, packed.agg(F.sum("n_words")).first()[0] or 0) / (BUCKET * grow))))

    def hashed(batches):
        for batch in batches:
            for chunk, rows in zip(batch.column("chunk").to_pylist(), batch.column("rows")):
                w = _Windows(rows.as_py(), text_col, window)
                full, cuts = w.cuts(bits)
                for i in range(0, len(full), ROWS):
                    j = min(i + ROWS, len(full))
                    yield pa.RecordBatch.from_arrays([pa.array(full[i:j]), pa.array(np.full(j - i, chunk), pa.int64()), binary([w.hashes[a:b] for a, b in zip(cuts[i:j], cuts[i + 1 : j + 1])])], ["bucket", "chunk", "hashes"])

    def counted(batches):
        for bucket in grouped(batches, ["bucket"]):
            blobs = [np.frombuffer(x.as_py(), np.uint64) for x in bucket.column("hashes")]
            both = np.concatenate(blobs)
            order = np.argsort(both)
            s = both[order]
            same = s[1:] == s[:-1]
            again = np.zeros(len(s), bool)
            again[order[1:][same]] = again[order[:-1][same]] = True
            ends = np.cumsum([len(x) for x in blobs])
            answer = [np.packbits(again[e - len(x) : e]) for x, e in zip(blobs, ends)]
            yield pa.RecordBatch.from_arrays([bucket.column("chunk").combine_chunks(), bucket.column("bucket").combine_chunks(), binary(answer)], ["chunk", "bucket", "data"])

    hashes = packed.select("chunk", "rows").mapInArrow(hashed, "bucket bigint, chunk bigint, hashes binary")
    answers = hashes.repartition(parts_for(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(counted, "chunk bigint, bucket bigint, data binary")

    def merged(batches):
        for chunk in grouped(batches, ["chunk"]):  # its documents first, then the answers of its buckets
            data = chunk.column("data")
            w = _Windows(data[0].as_py(), text_col, window)
            again = w.count > 1
            full, cuts = w.cuts(bits)
            for i, told in zip(np.searchsorted(full, chunk.column("bucket").to_numpy()[1:]), data[1:]):
                a, b = cuts[i], cuts[i + 1]
                again[a:b] |= np.unpackbits(np.frombuffer(told.as_py(), np.uint8), count=b - a).astype(bool)
            at = w.at[again[w.back]]
            edge = np.bincount(at, minlength=len(w.starts) + 1) - np.bincount(at + window, minlength=len(w.starts) + 1)
            yield finish(w.batch, w.buf, w.starts, w.ends, w.bounds, np.cumsum(edge)[:-1] > 0)

    rows = packed.select("chunk", F.lit(-1).cast("bigint").alias("bucket"), F.col("rows").alias("data")).unionByName(answers)
    return rows.repartition(parts_for(spark), "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(merged, schema)


def _spans(bounds: np.ndarray, removed: np.ndarray) -> Iterator[list[tuple[int, int]]]:
    """Each text's maximal runs of removed words, from 0."""
    first, last = removed.copy(), removed.copy()
    first[1:] &= ~removed[:-1]
    last[:-1] &= ~removed[1:]
    edges = bounds[(bounds > 0) & (bounds < len(removed))]
    first[edges] = removed[edges]
    last[edges - 1] = removed[edges - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    where = np.searchsorted(a, bounds)
    for k, (i, j) in enumerate(zip(where, where[1:])):
        yield [(int(x), int(y)) for x, y in zip(a[i:j] - bounds[k], b[i:j] - bounds[k])]


def without_repeats(docs: DataFrame, text_col: str = "text", window: int = 35, spans: str | None = None) -> DataFrame:
    """The rows of docs with the words of repeated windows cut out of their texts.

    A window is that many consecutive words of one text; a word goes if any
    window that covers it also begins anywhere else. What separates kept words
    stays as it is; the white space after removed words goes with them. All
    columns are returned, and with spans a column of that name: the removed
    intervals as array<struct<start, end>> of word numbers. Null texts stay
    null; texts without repeats stay as they are, to the byte. An empty table
    gives no rows.
    """
    target = docs.withColumn(text_col, F.col(text_col).cast("string"))
    if spans:
        target = target.withColumn(spans, F.lit(None).cast("array<struct<start:bigint,end:bigint>>"))

    def finish(batch, buf, starts, ends, bounds, removed):
        texts = batch.column(text_col).to_pylist()
        found = list(_spans(bounds, removed))
        _, offs = text_bytes(batch.column(text_col))
        for i, cut in enumerate(found):
            if cut:
                own, raw, at, keep = starts[bounds[i] : bounds[i + 1]], buf[offs[i] : offs[i + 1]].tobytes(), 0, []
                for a, b in cut:
                    keep.append(raw[at : own[a] - offs[i]])
                    at = own[b] - offs[i] if b < len(own) else len(raw)
                keep.append(raw[at:])
                texts[i] = b"".join(keep).decode("utf-8", "replace")
        cols = {n: batch.column(n) for n in batch.schema.names} | {text_col: pa.array(texts, pa.string())}
        if spans:
            cols[spans] = pa.array([[{"start": a, "end": b} for a, b in cut] for cut in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return remove_repeats(target, text_col, window, target.schema, finish)


def repeats_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """Rows (id_col, n_words, n_removed, kept_sha256): the kept words joined by one space, as SHA-256."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))

    def finish(batch, buf, starts, ends, bounds, removed):
        raw, digest = buf.tobytes(), []
        _, offs = text_bytes(batch.column("text"))
        gone = np.add.reduceat(np.append(removed, False).astype(np.int64), bounds[:-1]) * (np.diff(bounds) > 0) if batch.num_rows else []
        for i, n in enumerate(gone):
            own = raw[offs[i] : offs[i + 1]].split()
            if n:
                own = [w for w, r in zip(own, removed[bounds[i] : bounds[i + 1]].tolist()) if not r]
            digest.append(hashlib.sha256(b" ".join(own)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(bounds), pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])

    out = remove_repeats(rows, "text", window, "id bigint, n_words bigint, n_removed bigint, kept_sha256 string", finish)
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out
