"""Benchmark decontamination: which documents contain which short test items.

The search is by MinHash containment over partitions of equal size:

1. Items are partitioned by size: by the length of their shingles and by powers
   of two of their number of distinct shingles.
2. For each partition, documents are cut into tiles of as many shingles as its
   largest item has, and item and tile are sketched by the same MinHash
   functions. Jaccard similarities of an item with a document's tiles add up to
   at least share * low / (low + high), however its shingles are spread over the
   tiles, if the document holds the share of them; low and high are the
   partition's bounds. From that sum follows how many MinHash functions the
   partition needs, so that no function agrees with probability MISS at most.
3. Documents of which a sketch value is found in a bit map of the items' values
   go on, with those of their shingles that any item has; the values are joined
   with the items', and each pair is verified by exact shingle containment over
   the whole document.

Only bit maps of bounded size are sent to the tasks; items and hits are joined.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftpool.llm.textops import ALNUM, fresh, mix, slices, text_bytes, window_hashes, word_hashes, words, written

MISS = 1e-7  # chance that the search misses an item that a document holds
BLOCK_BYTES = 64 << 20  # of a bit map at most; with very many items it lets more values through, never fewer
_BITS = 64  # of a bit map for each value, while there is room
_TILES = 1 << 16  # shingles of the tiles that are hashed at a time


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of letters and digits, in lower case, and where each text's words begin."""
    buf, offs = text_bytes(pc.utf8_lower(pc.fill_null(column, "")))
    starts, ends, bounds = words(buf, offs, ALNUM)
    return word_hashes(buf, starts, ends), bounds


@dataclass(frozen=True)
class Partition:
    """Items of one shingle length, of low to high distinct shingles."""

    shingle: int
    low: int
    high: int
    share: float

    @property
    def functions(self) -> int:
        """How many MinHash functions keep the chance of a miss at MISS."""
        if self.high == 1:
            return 1  # a tile is one shingle, and equal or not
        return math.ceil(math.log(1 / MISS) * (self.low + self.high) / (self.share * self.low))

    def keys(self, tiles: np.ndarray) -> np.ndarray:
        """The sketch values of tiles, a column each of upper halves of shingle hashes; a row for each function."""
        out = np.empty((self.functions, tiles.shape[1]), np.uint64)
        for i, m in enumerate(_multipliers(self.functions)):
            out[i] = (tiles * m).min(axis=0)
        own = mix(np.arange(self.functions, dtype=np.uint64) + np.uint64(self.shingle << 40) + np.uint64(self.high.bit_length() << 48))
        return mix(out ^ own[:, None])


def _multipliers(n: int) -> np.ndarray:
    return (mix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _halves(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _slots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of a bit map that stand for each value, four arrays of them."""
    more = mix(keys)
    return [(x & np.uint64(bits - 1)).astype(np.int64) for x in (keys, keys >> np.uint64(32), more, more >> np.uint64(32))]


class BitMap:
    """Which values may be among some: never says no to one of them."""

    def __init__(self, keys: DataFrame, count: int):
        """keys: rows (key). The bits are set by an aggregation; BLOCK_BYTES at most come to the driver."""
        self.bits = bits = 1 << min(max(10, (_BITS * count - 1).bit_length()), (8 * BLOCK_BYTES).bit_length() - 1)

        def slots(batches):
            for batch in batches:
                for part in _slots(batch.column("key").to_numpy().view(np.uint64), bits):
                    yield pa.RecordBatch.from_arrays([pa.array(part >> 6), pa.array(part & 63)], ["word", "bit"])

        got = keys.mapInArrow(slots, "word bigint, bit bigint").groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, int(bit))")).alias("set")).toArrow()
        self.words = np.zeros(bits + 63 >> 6, np.uint64)
        self.words[got.column("word").to_numpy()] = got.column("set").to_numpy().view(np.uint64)

    def among(self, keys: np.ndarray) -> np.ndarray:
        """Places of the values that may be among them."""
        at = np.flatnonzero(self._set((keys & np.uint64(self.bits - 1)).astype(np.int64)))  # most go by their first bit
        for i in (1, 2, 3):
            at = at[self._set(_slots(keys[at], self.bits)[i])]
        return at

    def _set(self, slot: np.ndarray) -> np.ndarray:
        return (self.words[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _tiles(first: np.ndarray, last: np.ndarray, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tiles of high shingles in each range, and the range of each tile."""
    n = -(-(last - first) // high)
    row = np.repeat(np.arange(len(n)), n)
    start = first[row] + high * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    return start, np.minimum(start + high, last[row]), row


class Search:
    """Partitions and bit maps, as they are sent to the tasks."""

    def __init__(self, partitions: list[Partition], sketches: BitMap, shingles: BitMap):
        self.partitions, self.sketches, self.shingles = partitions, sketches, shingles

    def hits(self, column: pa.Array) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """Rows with sketch values of items, these values, and the rows' distinct shingles that items may have."""
        h, bounds = _hashed(column)
        rows, keys, runs = [], [], {}
        for p in self.partitions:
            if p.shingle not in runs:
                w = window_hashes(h, p.shingle)
                runs[p.shingle] = w, _halves(w), bounds[:-1], np.maximum(bounds[1:] - p.shingle + 1, bounds[:-1])
            _, half, first, last = runs[p.shingle]
            start, end, row = _tiles(first, last, p.high)
            step = max(1, _TILES // p.high)
            for i in range(0, len(start), step):
                at = np.minimum(start[i : i + step] + np.arange(p.high)[:, None], end[i : i + step] - 1)
                got = p.keys(half[at])
                hit = self.sketches.among(got.ravel())
                rows.append(row[i + hit % got.shape[1]])
                keys.append(got.ravel()[hit])
        both = np.unique(np.stack([np.concatenate(rows).astype(np.uint64), np.concatenate(keys)], axis=1), axis=0) if rows else np.zeros((0, 2), np.uint64)
        hit, cut = np.unique(both[:, 0], return_index=True)
        hit = hit.astype(np.int64).tolist()
        shingles = []
        for r in hit:
            own = np.concatenate([w[a[r] : b[r]] for w, _, a, b in runs.values()])
            shingles.append(np.unique(own[self.shingles.among(own)]))
        return hit, np.split(both[:, 1], cut[1:]) if hit else [], shingles


def _arrays(parts: list[np.ndarray]) -> pa.Array:
    """Values of each row as array<bigint>."""
    flat = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in parts]))), pa.int32()), pa.array(flat))


def _items(items: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Rows (item, item_id, shingle, n, set), written: items that have words, with a key of their own and their distinct shingles."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                h, bounds = _hashed(part.column("text"))
                k = np.minimum(np.diff(bounds), shingle)
                keep = np.flatnonzero(k)
                sets = [np.unique(window_hashes(h[bounds[i] : bounds[i + 1]], int(k[i]))) for i in keep]
                yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(keep)), pa.array(k[keep]), pa.array([len(s) for s in sets], pa.int64()), _arrays(sets)], ["item_id", "shingle", "n", "set"])

    rows = items.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(run, "item_id bigint, shingle bigint, n bigint, set array<bigint>").withColumn("item", F.monotonically_increasing_id()), "items")


def _searched(docs: DataFrame, items: DataFrame, share: float) -> DataFrame | None:
    """Rows (id, item_id, n_shingles, n_found) for rows of docs (id, text) and _items(); None without any item."""
    spark = docs.sparkSession
    size = F.length(F.bin("n"))  # 1 more than the power of two
    sizes = items.groupBy("shingle", size.alias("size")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("c"), F.sum("n").alias("n")).orderBy("shingle", "size").collect()
    if not sizes:
        return None
    partitions = [Partition(r.shingle, r.low, r.high, share) for r in sizes]
    of = {(r.shingle, r.size): p for r, p in zip(sizes, partitions)}

    def sketched(batches):
        for batch in batches:
            sets = [x.values.to_numpy().view(np.uint64) for x in batch.column("set")]
            keys = [of[k, len(s).bit_length()].keys(_halves(s)[:, None])[:, 0] for k, s in zip(batch.column("shingle").to_pylist(), sets)]
            yield pa.RecordBatch.from_arrays([batch.column("item"), _arrays(keys)], ["item", "keys"])

    keys = written(items.select("item", "shingle", "set").mapInArrow(sketched, "item bigint, keys array<bigint>").select("item", F.explode("keys").alias("key")), "item_keys")
    every = items.select(F.explode("set").alias("key"))
    sent = spark.sparkContext.broadcast(Search(partitions, BitMap(keys, sum(r.c * p.functions for r, p in zip(sizes, partitions))), BitMap(every, sum(r.n for r in sizes))))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows, found, shingles = sent.value.hits(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(rows, pa.int64())), _arrays(found), _arrays(shingles)], ["id", "keys", "shingles"])

    kind = docs.schema["id"].dataType.simpleString()
    hits = written(docs.mapInArrow(run, f"id {kind}, keys array<bigint>, shingles array<bigint>").withColumn("row", F.monotonically_increasing_id()), "hits")
    pairs = hits.select("row", F.explode("keys").alias("key")).join(keys, "key").select("row", "item").distinct()
    both = pairs.join(hits.drop("keys"), "row").join(items, "item")
    found = both.select("id", "item_id", F.col("n").alias("n_shingles"), F.size(F.array_intersect("set", "shingles")).cast("bigint").alias("n_found"))
    return found.where(F.col("n_found") >= share * F.col("n_shingles") - 1e-9)


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = 5, share: float = 0.8) -> DataFrame:
    """Rows (id_col, item_id, n_shingles, n_found, containment): documents that hold at least the share of an item's distinct word shingles.

    Words are runs of letters and digits in lower case. Items of fewer words
    than a shingle count as one shingle of all their words; items without words
    match nothing, nor do null or empty texts. Rows that repeat are reported
    each, as are null ids. Other columns are not read; an empty table on either
    side gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = _searched(rows, _items(items, item_id, item_text, shingle), share)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "id bigint, item_id bigint, n_shingles bigint, n_found bigint")
    return out.select(F.col("id").alias(id_col), F.col("item_id").alias(item_id), "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def without_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = 5, share: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item in the sense of contained_items(). Equal texts stay or go together."""
    digest = F.sha2(F.col(text_col).cast("string"), 256)
    found = _searched(docs.select(digest.alias("id"), F.col(text_col).cast("string").alias("text")), _items(items, item_id, item_text, shingle), share)
    if found is None:
        return docs
    name = fresh(docs, "digest")
    gone = written(found.select(F.col("id").alias(name)).distinct(), "contaminated")
    return docs.withColumn(name, digest).join(gone, name, "left_anti").drop(name)
