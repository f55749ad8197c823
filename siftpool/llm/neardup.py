"""MinHash near-duplicate detection with odd sketches and exact confirmation.

1. Each document becomes its set of word shingles, MinHash bands and an odd
   sketch: the samples folded into a parity bitmap.
2. Equal sets collapse into one class (an aggregation with partial results), so
   any number of copies costs one row per task from here on.
3. Classes are grouped by the smallest member that any of their bands' buckets
   has. In each group a few dozen leaders are compared with all members: a large
   group of copies becomes one part here, in time that grows with the group.
4. Pairs that share a band and are in different parts still are compared within
   the bucket of the first band that they share, first by odd sketches alone: XOR
   population counts reject pairs far below the threshold. Only members that have
   a likely partner take their full sets to the bucket.
5. Where more than CROWD members of a bucket are apart, as texts of one template
   that are similar but not linked, the bucket's members are dealt anew by their
   rarest shingles: with all shingles in one order, rare ones first, linked sets
   share one among the first (1 - t) n + 1 of each, and among the first
   (1 - 2t / (1 + t)) n + 1 of the smaller. What a template shares comes last in
   that order, so its texts meet only where more than the template is shared.

Links are confirmed on full sets. A comparison task gets one block of leaders and
one block of members, both of bounded size; pairs are never emitted, only links
that join two parts, or members with a likely partner.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftpool.llm.components import components
from siftpool.llm.textops import LOWER, binary, forget, grouped, mix, parts_for, slices, text_bytes, window_hashes, word_hashes, words, written

ROWS = 5  # MinHash samples of a band
BITS = 1024  # of an odd sketch
SLACK = 0.17  # six standard deviations of the sketches' estimate near the threshold
LEADERS = 64
BLOCK_BYTES = 4 << 20  # of sets in a block, unless a single set is larger
BLOCK_ROWS = 512  # sets in a block
CROWD = 256  # members of a bucket outside its largest part, beyond which they are dealt by rare shingles
SLOTS = 1 << 20  # counters of shingles, which give their order; any order is right
SKETCH_ROWS = 128, 4096  # odd sketches in a block: a sixteenth of the bucket within these bounds, so that small buckets spread and large ones are not sent too often


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles; shorter texts have one, empty ones none."""
    buf, offs = text_bytes(column)
    buf = LOWER[buf]
    starts, ends, bounds = words(buf, offs)
    h = word_hashes(buf, starts, ends)
    w = window_hashes(h, k)
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= k:
            yield np.unique(w[a : b - k + 1])
        elif b > a:
            yield mix(window_hashes(h[a:b], int(b - a), 1) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def bands_for(threshold: float, miss: float = 1e-7) -> int:
    """Bands needed so that a pair at the threshold shares none with probability miss at most."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**ROWS)))


def samples(hashes: np.ndarray, k: int) -> np.ndarray:
    """k MinHash samples of a set of 64-bit hashes."""
    mult = (mix(np.arange(1, k + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(k, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (x[None, i : i + 2048] * mult[:, None]).min(axis=1), out=low)
    return low


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples: each flips one bit."""
    at = mix(sample.astype(np.uint64) + (np.arange(len(sample), dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    bits = np.bincount(at.astype(np.int64), minlength=BITS) & 1
    return np.packbits(bits.astype(bool)).view(np.uint64)


def odd_likeness(apart: np.ndarray, k: int) -> np.ndarray:
    """Similarity estimated from XOR population counts of two odd sketches of k samples."""
    return 1 + BITS / (4 * k) * np.log(np.maximum(1 - 2 * apart / BITS, 1e-9))


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def sketched(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int) -> DataFrame:
    """Rows (id, n, digest, bands, odd), one for each document; digest is null for an empty set."""
    schema = "id bigint, n bigint, digest binary, bands array<bigint>, odd binary"

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                n, digest, keys, odd = [], [], [], []
                for s in shingle_sets(part.column("text"), k):
                    n.append(len(s))
                    if not len(s):
                        digest.append(None)
                        odd.append(None)
                        keys.append([])
                        continue
                    low = samples(s, bands * ROWS)
                    key = np.arange(1, bands + 1, dtype=np.uint64)
                    for col in low.reshape(bands, ROWS).T:
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + col)
                    digest.append(_digest(s))
                    odd.append(odd_sketch(low).tobytes())
                    keys.append(key.view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(odd, pa.binary())], ["id", "n", "digest", "bands", "odd"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _likely(n: np.ndarray, odd: np.ndarray, i: int, k: int, percent: int) -> np.ndarray:
    """Whether each row may be linked with row i, by sizes and odd sketches."""
    fits = 100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])
    return fits & (odd_likeness(np.bitwise_count(odd ^ odd[i]).sum(axis=1), k) >= percent / 100 - SLACK)


def _confirmed(k: int, percent: int):
    """Links (a, b) that join two parts, found in blocks of leaders and members."""

    def run(batches):
        for unit in grouped(batches, ["grp", "lead_block", "block"]):
            leads = unit.column("leads").to_numpy(zero_copy_only=False).astype(bool)
            n, part = unit.column("n").to_numpy(), unit.column("part").to_numpy()
            odd = np.frombuffer(b"".join(unit.column("odd").to_pylist()), np.uint64).reshape(len(n), -1)
            sets = np.array([None, *(np.frombuffer(x, np.uint64) for x in unit.column("hashes").to_pylist())], object)[1:]
            names, at = np.unique(part, return_inverse=True)
            out: list[tuple[int, int]] = []
            for i in np.flatnonzero(leads):
                near = np.flatnonzero(_likely(n, odd, i, k, percent) & (at != at[i]))
                if not len(near):
                    continue
                every = np.concatenate(sets[near])
                same = sets[i][np.minimum(np.searchsorted(sets[i], every), n[i] - 1)] == every
                both = np.add.reduceat(same, np.cumsum(n[near]) - n[near], dtype=np.int64)
                for j in near[100 * both >= percent * (n[i] + n[near] - both)]:
                    if at[j] != at[i]:
                        out.append((int(names[at[i]]), int(names[at[j]])))
                        at[at == at[j]] = at[i]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], ["a", "b"])

    return run


def _partnered(k: int, percent: int, banded: bool):
    """Rows (grp, node, part, n) with a likely partner in another part (with which they share no earlier band, if banded), found in blocks of leaders and members."""

    def run(batches):
        for unit in grouped(batches, ["grp", "lead_block", "block"]):
            n, part = unit.column("n").to_numpy(), unit.column("part").to_numpy()
            odd = np.frombuffer(b"".join(unit.column("odd").to_pylist()), np.uint64).reshape(len(n), -1)
            bands = unit.column("bands").combine_chunks().flatten().to_numpy().reshape(len(n), -1)[:, : int(unit.column("band")[0].as_py())] if banded else np.zeros((len(n), 0))
            hit = np.zeros(len(n), bool)
            for i in np.flatnonzero(unit.column("leads").to_numpy(zero_copy_only=False)):
                near = np.flatnonzero(_likely(n, odd, i, k, percent) & (part != part[i]))
                near = near[~(bands[near] == bands[i]).any(axis=1)]
                hit[near] = True
                hit[i] |= len(near) > 0
            yield from unit.select(["grp", "node", "part", "n"]).filter(pa.array(hit)).to_batches()

    return run


def _units(leaders: DataFrame, members: DataFrame) -> DataFrame:
    """Each leader block with each member block of its group: leaders and members have their number of blocks as lead_blocks and blocks."""

    def dealt(df: DataFrame, leads: bool) -> DataFrame:
        own = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        lead, block = (own(3, "lead_blocks"), every("blocks")) if leads else (every("lead_blocks"), own(2, "blocks"))
        return df.withColumns({"lead_block": lead, "block": block, "leads": F.lit(leads)}).drop("lead_blocks", "blocks")

    keys = ["grp", "lead_block", "block"]
    return dealt(leaders, True).unionByName(dealt(members, False)).repartition(parts_for(leaders.sparkSession), *keys).sortWithinPartitions(*keys)


def _blocks(rows: str, size: str | None = None) -> Column:
    """Number of blocks for so many sets of that size together, or odd sketches."""
    if size:
        by_rows, by_size = F.ceil(F.col(rows) / BLOCK_ROWS), F.ceil(F.col(size) / BLOCK_BYTES)
        return F.greatest(by_rows, by_size, F.lit(1)).cast("int")
    low, high = SKETCH_ROWS
    return F.ceil(F.col(rows) / F.greatest(F.lit(low), F.least(F.lit(high), F.col(rows) / 16))).cast("int")


def _facts(members: DataFrame, size: str | None) -> DataFrame:
    """Groups of several parts among members (grp, part, ...): the largest part, how many are apart from it, and numbers of blocks, written once; size: a column of the sizes of sets."""
    parts = members.groupBy("grp", "part").agg(F.count("*").alias("c"), F.sum(8 * F.col(size) + 200 if size else F.lit(0)).alias("bytes"))
    facts = parts.groupBy("grp").agg(F.max_by(F.struct("part", "c", "bytes"), F.struct("c", "part")).alias("most"), F.count("*").alias("parts"), F.sum("c").alias("c"), F.sum("bytes").alias("bytes")).where("parts > 1")
    facts = facts.withColumns({"largest": F.col("most.part"), "apart": F.col("c") - F.col("most.c"), "apart_bytes": F.col("bytes") - F.col("most.bytes")})
    return written(facts.select("grp", "largest", "apart", _blocks("c", size and "bytes").alias("blocks"), _blocks("apart", size and "apart_bytes").alias("lead_blocks")), "split")


def _split(members: DataFrame, size: str | None) -> DataFrame:
    """members of groups of several parts, with the group's largest part and its numbers of blocks.

    The groups are written, so that a join with a large one can be split.
    """
    return members.join(_facts(members, size).drop("apart"), "grp")


def _shingle_counts(sets: DataFrame) -> np.ndarray:
    """How often shingles of these sets fall to each of SLOTS counters."""
    ranges = 16
    width = SLOTS // ranges

    def counted(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in batch.column("hashes"):
                total += np.bincount((np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(44)).astype(np.int64), minlength=SLOTS)
        for r in range(ranges):
            at = np.flatnonzero(total[r * width : (r + 1) * width]).astype(np.int32)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), binary([at]), binary([total[r * width + at]])], ["r", "at", "c"])

    def added(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for r, at, c in zip(*(batch.column(x).to_pylist() for x in ("r", "at", "c"))):
                total[r * width + np.frombuffer(at, np.int32)] += np.frombuffer(c, np.int64)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.minimum(total[at], 2**31 - 1).astype(np.int32))], ["at", "c"])

    got = sets.select("hashes").mapInArrow(counted, "r int, at binary, c binary").repartition(ranges, "r").mapInArrow(added, "at bigint, c int").toPandas()  # SLOTS rows at most
    out = np.zeros(SLOTS, np.int32)
    out[got["at"].to_numpy(np.int64)] = got["c"].to_numpy()
    return out


def rare_prefixes(hashes: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The rarest shingles of a set that a linked set may share first, and how many of them count if the set is the smaller one."""
    n = len(hashes)
    order = np.lexsort((hashes, counts[(hashes >> np.uint64(44)).astype(np.int64)]))
    probe = n + (-percent * n // 100) + 1  # n - ceil(t n) + 1
    index = n + (-2 * percent * n // (100 + percent)) + 1
    return hashes[order[:probe]], index


def _by_rare_shingles(sets: DataFrame, crowd: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows (grp, node, part, n) with a likely partner in another part, for the nodes of crowd (node, part), in groups by a rare shingle."""
    own = written(sets.select("node", "n", "hashes").join(crowd, "node"), "crowd")
    sent = sets.sparkSession.sparkContext.broadcast(_shingle_counts(own))

    def keyed(batches):
        counts = sent.value
        for batch in batches:
            nodes, parts, keys, small = [], [], [], []
            for node, part, x in zip(batch.column("node").to_pylist(), batch.column("part").to_pylist(), batch.column("hashes")):
                first, index = rare_prefixes(np.frombuffer(x.as_buffer(), np.uint64), counts, percent)
                shared = np.flatnonzero(counts[(first >> np.uint64(44)).astype(np.int64)] > 1)
                nodes.append(np.full(len(shared), node))
                parts.append(np.full(len(shared), part))
                keys.append(first[shared].view(np.int64))
                small.append(shared < index)
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, nodes, parts, small)], ["grp", "node", "part", "index"])

    members = written(own.mapInArrow(keyed, "grp bigint, node bigint, part bigint, index boolean"), "keys")
    forget(own)
    met = members.groupBy("grp").agg(F.max("index").alias("any"), F.min("part").alias("a"), F.max("part").alias("b")).where("any and a < b").select("grp")
    members = written(members.join(met, "grp"), "members")
    counts = members.groupBy("grp", "part").agg(F.count("*").alias("c"), F.sum(F.col("index").cast("bigint")).alias("i"))
    facts = counts.groupBy("grp").agg(F.max_by(F.struct("part", "c", "i"), F.struct("c", "part")).alias("most"), F.sum("c").alias("c"), F.sum("i").alias("i"))
    facts = facts.select("grp", F.col("most.part").alias("largest"), "c", (F.col("c") - F.col("most.c")).alias("apart"), F.col("most.i").alias("inside"), (F.col("i") - F.col("most.i")).alias("outside"))
    told = members.join(written(facts, "facts"), "grp").join(classes.select("node", "n", "odd"), "node")
    # the smaller of a linked pair leads, by its index: if it is outside the largest part, against all; if inside, against those outside
    told = told.withColumns({"blocks": _blocks("c"), "lead_blocks": _blocks("outside")})
    columns = ["grp", "node", "part", "n", "odd", "blocks", "lead_blocks"]
    outside = _units(told.where("index and part != largest").select(columns), told.where("outside > 0").select(columns))
    other = told.where("inside > 0").withColumns({"grp": F.xxhash64("grp", F.lit(1)), "blocks": _blocks("apart"), "lead_blocks": _blocks("inside")})
    inside = _units(other.where("index and part = largest").select(columns), other.where("part != largest").select(columns))
    likely = [u.mapInArrow(_partnered(k, percent, False), "grp bigint, node bigint, part bigint, n bigint") for u in (outside, inside)]
    return likely[0].unionByName(likely[1])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Rows (id_col, n_shingles, component_id, kept), one for each row of docs.

    Documents are linked if 100 * |A and B| >= percent * |A or B| for their sets
    of lower-cased word shingles; component_id is the smallest id that links
    reach. Null and empty texts have no shingles and no links. Rows with a null
    id link nothing: their component is null and they are kept. Ids are meant to
    be unique; rows that repeat an id are reported each, by their own text, and
    different texts of one id are not linked by it. Other columns of docs are
    not read; an empty table gives no rows.
    """
    bands = bands_for(percent / 100)
    k = bands * ROWS
    rows = written(sketched(docs, id_col, text_col, shingle, bands), "sketches")
    known = rows.where("id is not null and digest is not null")
    classes = known.groupBy("digest").agg(F.min("id").alias("lowest"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    keys = classes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").select("key", "lead")
    buckets = written(keys.join(shared, "key"), "buckets")
    groups = buckets.groupBy("node").agg(F.min("lead").alias("grp"))

    wanted = groups.join(classes.select("node", "lowest", "digest", "n", "odd"), "node").withColumn("salt", F.pmod(F.xxhash64("node", F.lit(4)), F.lit(parts_for(docs.sparkSession))).cast("int"))
    dealt = wanted.groupBy("grp", "salt").agg(F.count("*").alias("m"), F.sum(8 * F.col("n") + 200).alias("bytes"))
    size = dealt.groupBy("grp").agg(F.sum("m").alias("m"), F.sum("bytes").alias("bytes"), F.collect_list("salt").alias("salts"))
    size = size.withColumns({"leading": F.least("m", F.lit(LEADERS)), "leading_bytes": F.col("bytes") * F.least(F.lit(1.0), LEADERS / F.col("m"))})
    size = size.select("grp", "m", _blocks("m", "bytes").alias("blocks"), _blocks("leading", "leading_bytes").alias("lead_blocks"), F.explode("salts").alias("salt"))
    wanted = wanted.join(size, ["grp", "salt"])  # before the sets, which are large
    sets = docs.select(F.col(id_col).cast("bigint").alias("lowest"), F.col(text_col).cast("string").alias("text")).join(wanted, "lowest")

    def full(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = list(shingle_sets(part.column("text"), shingle))
                same = [i for i, (s, d) in enumerate(zip(found, part.column("digest").to_pylist())) if _digest(s) == d]
                got = part.take(pa.array(same, pa.int64()))
                cols = ["node", "grp", "salt", "n", "odd", "m", "blocks", "lead_blocks"]
                yield pa.RecordBatch.from_arrays([*(got.column(c) for c in cols), binary([found[i] for i in same])], [*cols, "hashes"])

    sets = written(sets.mapInArrow(full, "node bigint, grp bigint, salt int, n bigint, odd binary, m bigint, blocks int, lead_blocks int, hashes binary"), "sets")
    # leaders against all; in groups of LEADERS or fewer, all are leaders
    leads = F.pmod(F.xxhash64("node"), F.col("m")) < LEADERS
    first = sets.select("grp", "node", F.col("node").alias("part"), "n", "odd", "hashes", "blocks", "lead_blocks", leads.alias("first"))
    units = _units(first.where("first").drop("first"), first.where("not first or lead_blocks > 1").drop("first"))  # a single leader block is in every unit itself
    links = written(units.mapInArrow(_confirmed(k, percent), "a bigint, b bigint"), "links")
    parts = components(links, "a", "b", "parts").withColumnRenamed("component", "part")
    forget(links)

    # in each bucket, what is in another part than the bucket's largest against the whole bucket
    placed = buckets.select("node", "key", "band").join(parts, "node", "left").select(F.col("key").alias("grp"), "band", "node", F.coalesce("part", "node").alias("part"))
    placed = written(placed, "placed")
    forget(buckets)
    told = written(placed.join(_facts(placed, None), "grp"), "told")
    forget(placed)
    crowd = written(told.where(F.col("apart") > CROWD).select("node", "part").distinct(), "crowded")
    told_small = told.where(F.col("apart") <= CROWD).drop("apart").join(classes.select("node", "n", "odd", "bands"), "node")
    likely = _units(told_small.where("part != largest").drop("largest"), told_small.drop("largest")).mapInArrow(_partnered(k, percent, True), "grp bigint, node bigint, part bigint, n bigint")
    if not crowd.isEmpty():
        likely = likely.unionByName(_by_rare_shingles(sets, crowd, classes, k, percent))
    likely = written(likely.distinct(), "likely")
    forget(told)
    told = _split(likely, "n").join(sets.select("node", "odd", "hashes"), "node")
    again = _units(told.where("part != largest").drop("largest"), told.drop("largest")).mapInArrow(_confirmed(k, percent), "a bigint, b bigint")
    joined = components(again, "a", "b", "joined")  # parts to the smallest of the parts that links reach
    own = parts.join(joined.withColumnRenamed("node", "part"), "part", "left").select("node", F.coalesce("component", "part").alias("component"))
    final = written(own.unionByName(joined.join(parts, "node", "left_anti")), "final")
    forget(sets)
    forget(likely)

    lowest = written(final.join(classes.select("node", "lowest"), "node").groupBy("component").agg(F.min("lowest").alias("component_id")), "lowest")
    named = classes.select("digest", "node", "lowest").join(final.join(lowest, "component").drop("component"), "node", "left").select("digest", F.coalesce("component_id", "lowest").alias("component_id"))
    told = known.join(named, "digest").select("id", "n", "component_id")
    alone = rows.where("id is null or digest is null").select("id", "n", F.col("id").alias("component_id"))
    return told.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
