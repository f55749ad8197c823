"""Token packing: best-fit-decreasing rows for training, and lexical retrieval packing.

Both turn a text into its token ids and one end id, take whole windows off its
front, and pack what remains (its tail), cutting freely and losing nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftpool.llm.textops import binary, slices, text_bytes, written
from siftpool.llm.tokens import encoder

END = 0  # id after each document
BLOCK_TOKENS = 1 << 21  # packed together, at most about so many
TASKS = 1 << 14  # with more shards, a task packs several, one after another


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches with the ids of each of their texts, the end id included."""
    own = encoder(tokenizer)
    for batch in batches:
        for part in slices(batch, "text"):
            ids, at = own.encode(*text_bytes(part.column("text")))
            ids = np.insert(ids, at[1:], END)
            at = at + np.arange(len(at))
            yield part, [ids[a:b] for a, b in zip(at, at[1:])]


class _Capacities:
    """Open bins by room left, under a segment tree over room: the least room that fits is found in log(size) steps."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        at = room + self.leaves
        while at:
            self.any[at] += 1
            at //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """A bin of the least room of at least need, and that room; it is no longer open."""
        at = need + self.leaves
        if not self.any[at]:
            while at > 1 and (at & 1 or not self.any[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        room = at - self.leaves
        while at:
            self.any[at] -= 1
            at //= 2
        return self.bins[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[list[int], int]:
    """The bin of each length (all from 1 to size), and the number of bins. Longest first, each into the fullest bin that has room."""
    open_, out, n = _Capacities(size), [0] * len(lengths), 0
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        need = int(lengths[i])
        got = open_.take(need)
        if got is None:
            got, n = (n, size), n + 1
        out[i] = got[0]
        if got[1] > need:
            open_.put(got[1] - need, got[0])
    return out, n


def packed_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024) -> DataFrame:
    """Rows (sequence_id, n_tokens, input_ids, cu_seqlens, position_resets, doc_ids, doc_starts).

    input_ids is one row of the id matrix, size little-endian ids (16 bits wide
    where the vocabulary allows, else 32), padded with 0. cu_seqlens holds the
    cumulative lengths of the row's pieces from 0; positions restart at each of
    position_resets. doc_ids and doc_starts name each piece's document and the
    number of its ids before the piece. Documents are packed with others of the
    same task, in blocks of bounded size, without a shuffle. Null and empty
    texts are an end id; null ids stay null; repeated rows are packed each. An
    empty table gives no rows.
    """
    schema = "sequence_id bigint, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<bigint>, doc_starts array<bigint>"

    def run(batches):
        task, done = TaskContext.get().partitionId(), 0
        tails: list[tuple[int | None, int, np.ndarray]] = []

        def rows(seqs: list[list[tuple[int | None, int, np.ndarray]]]) -> pa.RecordBatch:
            nonlocal done
            cu = [np.concatenate(([0], np.cumsum([len(x) for _, _, x in s]))).astype(np.int32) for s in seqs]
            full = [np.concatenate([*(x for _, _, x in s), np.zeros(size - c[-1], s[0][2].dtype)]) for s, c in zip(seqs, cu)]
            done += len(seqs)
            return pa.RecordBatch.from_arrays(
                [pa.array((task << 32) + np.arange(done - len(seqs), done)), pa.array([c[-1] for c in cu], pa.int32()), binary(full), pa.array(cu, pa.list_(pa.int32())), pa.array([c[:-1] for c in cu], pa.list_(pa.int32())), pa.array([[d for d, _, _ in s] for s in seqs], pa.list_(pa.int64())), pa.array([[a for _, a, _ in s] for s in seqs], pa.list_(pa.int64()))],
                ["sequence_id", "n_tokens", "input_ids", "cu_seqlens", "position_resets", "doc_ids", "doc_starts"],
            )

        def flush():
            bins, n = best_fit_decreasing(np.array([len(x) for _, _, x in tails]), size)
            seqs: list[list] = [[] for _ in range(n)]
            for b, tail in zip(bins, tails):
                seqs[b].append(tail)
            tails.clear()
            return rows(seqs)

        waiting = 0
        for part, ids in _encoded(batches, tokenizer):
            whole = []
            for doc, x in zip(part.column("id").to_pylist(), ids):
                n = len(x) // size * size
                whole += [[(doc, a, x[a : a + size])] for a in range(0, n, size)]
                if n < len(x):
                    tails.append((doc, n, x[n:].copy()))
                    waiting += len(x) - n
            if whole:
                yield rows(whole)
            if waiting >= BLOCK_TOKENS:
                yield flush()
                waiting = 0
        if tails:
            yield flush()

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def _tokenized(docs: DataFrame, tokenizer: str, size: int) -> DataFrame:
    """Rows (id, n, whole, tail): the checksum of each whole window, and the ids after them. Besides, a row for each task: terms holds the number of its documents with each token id."""

    def run(batches):
        own = encoder(tokenizer)
        df = np.zeros(own.vocab_size, np.int64)
        for part, ids in _encoded(batches, tokenizer):
            whole, tails = [], []
            for x in ids:
                s = np.sort(x, kind="stable")
                df[s[np.append(True, s[1:] != s[:-1])]] += 1
                n = len(x) // size * size
                whole.append(np.array([_crc(x[a : a + size]) for a in range(0, n, size)], "<u4").tobytes())
                tails.append(x[n:].tobytes())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(whole, pa.binary()), pa.array(tails, pa.binary()), pa.nulls(len(ids), pa.list_(pa.int64()))], ["id", "n", "whole", "tail", "terms"])
        if df.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([df], pa.list_(pa.int64()))], ["id", "n", "whole", "tail", "terms"])

    return docs.mapInArrow(run, "id bigint, n bigint, whole binary, tail binary, terms array<bigint>")


class _Shard:
    """A BM25 inverted index over a block of tails."""

    K1, B = 1.2, 0.75
    COMMON = 8  # a token that more than one tail in so many holds has its weights as a row over all tails
    AHEAD = 256  # neighbours put in order at first

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n = len(tails)
        lens = np.array([len(t) for t in tails])
        pairs = np.repeat(np.arange(self.n, dtype=np.uint64), lens) | (np.concatenate(tails).astype(np.uint64) << np.uint64(32))
        keys, tf = np.unique(pairs, return_counts=True)
        term, self.doc = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        norm = self.K1 * (1 - self.B + self.B * lens / max(mean, 1e-9))
        self.weight = idf[term] * tf * (self.K1 + 1) / (tf + norm[self.doc])
        self.start = np.searchsorted(term, np.arange(len(idf) + 1))
        self.rows: dict[int, np.ndarray] = {}
        for t in np.flatnonzero(np.diff(self.start) * self.COMMON > self.n).tolist():
            self.rows[t] = np.zeros(self.n)
            self.rows[t][self.doc[self.start[t] : self.start[t + 1]]] = self.weight[self.start[t] : self.start[t + 1]]
        order = np.argsort(self.doc, kind="stable")
        at = np.searchsorted(self.doc[order], np.arange(self.n + 1))
        self.terms = [term[order[a:b]] for a, b in zip(at, at[1:])]

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """Unused tails that share any of the seed's distinct tokens, best first by the sum over all of them, ties by place."""
        score, spans = np.zeros(self.n), []
        for t in self.terms[seed].tolist():
            row = self.rows.get(t)
            if row is None:
                spans.append(slice(self.start[t], self.start[t + 1]))
            else:
                score += row
        if spans:
            score += np.bincount(np.concatenate([self.doc[x] for x in spans]), np.concatenate([self.weight[x] for x in spans]), self.n)
        score[used] = 0
        found, ahead = np.flatnonzero(score), self.AHEAD
        while len(found):
            own = score[found]
            best = own >= (np.partition(own, -ahead)[-ahead] if len(own) > ahead else 0)
            yield from found[best][np.argsort(-own[best], kind="stable")].tolist()
            found, ahead = found[~best], 8 * ahead


def _fill(tails: list[np.ndarray], shard: _Shard, size: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of (tail, start, length). A seed's best unused neighbours follow it; the last is cut, and its rest seeds the next window."""
    used = np.zeros(len(tails), bool)
    rest, place = None, 0
    while True:
        if rest is None:
            while place < len(tails) and used[place]:
                place += 1
            if place == len(tails):
                return
            rest = (place, 0)
        seed, at = rest
        used[seed], rest = True, None
        window, room = [(seed, at, len(tails[seed]) - at)], size - len(tails[seed]) + at
        queue = shard.neighbours(seed, used) if room else iter([])
        while room:
            j = next(queue, None)
            if j is None:  # no neighbour is left: the next unused tail seeds what remains
                while place < len(tails) and used[place]:
                    place += 1
                if place == len(tails):
                    break
                j, queue = place, iter([])
            if used[j]:
                continue
            used[j] = True
            n = min(room, len(tails[j]))
            window.append((j, 0, n))
            room -= n
            if n < len(tails[j]):
                rest = (j, n)
            elif not room:
                break
            else:
                queue = queue if j != place else shard.neighbours(j, used)
        yield window


def _deal(loads: dict[int, int], block: int) -> tuple[dict[int, tuple[int, int]], int]:
    """For each rarest token the first of its shards and their number, and the number of all shards.

    Tokens of less than a block, in order, share a shard until it has a block;
    each other token has shards of its own, of less than two blocks each.
    """
    out, shards, shared, room = {}, 0, -1, 0
    for token, load in sorted(loads.items()):
        if load >= block:
            out[token], shards = (shards, load // block), shards + load // block
            continue
        if room <= 0:
            shared, shards, room = shards, shards + 1, block
        out[token] = shared, 1
        room -= load
    return out, shards


def retrieval_packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024) -> DataFrame:
    """Rows (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset), one for each piece.

    Whole windows of a document are sequences of their own. Tails are dealt to
    shards by their rarest token, so that documents with common rare words meet;
    a token with too many tails for one shard has several, among which its tails
    are dealt by a hash. A shard has a BM25 inverted index with document
    frequencies of the whole corpus; a window begins with a seed and is filled
    with the seed's best unused neighbours, scored on all of the seed's distinct
    tokens. Only a shard's last window can be short; callers pad it. The result
    depends on the documents alone, not on files, partitions or tasks. Null and
    empty texts are an end id; null ids stay null; repeated rows are packed
    each. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = written(_tokenized(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")), tokenizer, size), "tokenized")
    terms = rows.where("n < 0").select(F.posexplode("terms").alias("term", "df")).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    df = {r.term: r.df for r in terms.collect()}  # one number for each id of the vocabulary
    rows = rows.where("n > 0").drop("terms")
    n_docs, tail_tokens = rows.agg(F.count("*"), F.sum(F.pmod("n", F.lit(size)))).first()
    vocab = max(df, default=0) + 1
    freq = np.array([df.get(i, 0) for i in range(vocab)], np.int64)
    idf = np.log1p((n_docs - freq + 0.5) / (freq + 0.5))
    mean = (tail_tokens or 0) / max(n_docs, 1)
    wide = encoder(tokenizer).dtype
    sent = spark.sparkContext.broadcast((freq, idf))

    def rarest(column: pa.Array) -> list[int]:
        freq, _ = sent.value
        tails = (np.frombuffer(t.as_py(), wide) for t in column)
        return [_rarest(ids, freq) if len(ids) else -1 for ids in tails]

    def loaded(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(rarest(batch.column("tail")), pa.int64()), batch.column("load")], ["rare", "load"])

    # One number for each id of the vocabulary. A window's checksum is held as four bytes.
    loads = rows.select("tail", (F.pmod("n", F.lit(size)) + 4 * F.floor(F.col("n") / size)).alias("load")).mapInArrow(loaded, "rare bigint, load bigint").groupBy("rare").agg(F.sum("load").alias("load"))
    places, shards = _deal({r.rare: r.load for r in loads.collect()}, BLOCK_TOKENS)
    dealt_to = spark.sparkContext.broadcast(places)

    def keyed(batches):
        places = dealt_to.value
        for batch in batches:
            rare, shard = rarest(batch.column("tail")), []
            for token, doc, tail in zip(rare, batch.column("id").to_pylist(), batch.column("tail")):
                first, n = places[token]
                shard.append(first if n == 1 else first + xxhash.xxh3_64_intdigest(tail.as_py(), (doc or 0) & (1 << 64) - 1) % n)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(rare, pa.int64()), *batch.columns], ["shard", "rare", *batch.schema.names])

    def packed(batches):
        _, idf = sent.value
        shard, seq, held, tokens = -1, 0, [], 0

        def flush():
            nonlocal seq, tokens
            out = []
            tails, owner = [], []
            for k, (doc, n, whole, tail) in enumerate(held):
                for i, crc in enumerate(np.frombuffer(whole, "<u4").tolist()):
                    out.append((doc, i * size, size, crc, n, (shard << 32) + seq, 0))
                    seq += 1
                if tail:
                    tails.append(np.frombuffer(tail, wide))
                    owner.append(k)
            if tails:
                for window in _fill(tails, _Shard(tails, idf, mean), size):
                    offset = 0
                    for t, a, n in window:
                        doc, total, _, _ = held[owner[t]]
                        out.append((doc, total - len(tails[t]) + a, n, _crc(tails[t][a : a + n]), total, (shard << 32) + seq, offset))
                        offset += n
                    seq += 1
            held.clear()
            tokens = 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for at, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "id", "n", "whole", "tail"))):
                if held and (at != shard or tokens >= 2 * BLOCK_TOKENS):
                    yield flush()
                if at != shard:
                    shard, seq = at, 0
                held.append(row)
                tokens += len(row[3]) // wide.itemsize + len(row[2])
        if held:
            yield flush()

    dealt = rows.mapInArrow(keyed, "shard bigint, rare bigint, id bigint, n bigint, whole binary, tail binary")
    dealt = dealt.repartitionById(min(max(shards, 1), TASKS), F.pmod("shard", F.lit(TASKS)).cast("int")).sortWithinPartitions("shard", "rare", "id", "n", "tail", "whole")
    out = dealt.mapInArrow(packed, "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def _rarest(ids: np.ndarray, freq: np.ndarray) -> int:
    f = freq[ids]
    return int(ids[f == f.min()].min())
