"""Exact nearest references of all rows by pivots and balls, for reference sets of any size.

1. Rows and references go to the nearest of some pivots (picked from a bounded
   sample), are dealt to tasks by ranges of pivot and distance from it, and are cut
   there into balls: blocks of bounded size with a centre and a radius.
2. Centres, radii and counts of the references' balls (BALLS at most; beyond, balls
   hold more) are all that every task gets. A ball of rows needs a ball of
   references only if the triangle inequality leaves room below the distance within
   which k references certainly lie.
3. The references' balls that are needed are copied to the rows' balls, nearest
   first, and met one after another; each row keeps its k nearest, and balls that
   are too far for all rows by then are passed over.

Where every reference counts (a sum over all), blocks of rows meet all blocks of
references, and partial results are put together by block of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftpool.functions.frames import checkpointed, merged

BLOCK = 1024  # rows of a ball at most
BALLS = 1 << 18  # balls of references
PIVOTS, SAMPLE = 128, 4096
SLACK = 1e-7  # by which bounds have to hold, for distances rounded to nine places
_PAIRS = 1 << 21  # distances at a time


class Euclidean:
    """Distances of points of which each coordinate's difference is divided by a scale (1 if none is told)."""

    def __init__(self, scale: list[float] | None = None):
        self.scale = scale

    def _of(self, c: int) -> float:
        return 1.0 if self.scale is None else self.scale[c]

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """From each row of x to each of y; differences are taken first, so that equal ones stay equal."""
        total = np.zeros((len(x), len(y)))
        for c in range(x.shape[1]):
            one = (x[:, c, None] - y[None, :, c]) / self._of(c)
            total += one * one
        return np.sqrt(total)

    def widths(self, x: np.ndarray) -> np.ndarray:
        return np.array([np.ptp(x[:, c]) / self._of(c) for c in range(x.shape[1])])

    def centre(self, x: np.ndarray) -> np.ndarray:
        return x.mean(axis=0)


class Mixed:
    """The mean of scaled absolute differences, and of mismatches where the scale is None."""

    def __init__(self, scale: list[float | None]):
        self.scale = scale

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        total = np.zeros((len(x), len(y)))
        for c, s in enumerate(self.scale):
            a, b = x[:, c, None], y[None, :, c]
            total += a != b if s is None else np.abs(a - b) / s
        return total / len(self.scale)

    def widths(self, x: np.ndarray) -> np.ndarray:
        return np.array([float(np.ptp(x[:, c]) > 0) if s is None else np.ptp(x[:, c]) / s for c, s in enumerate(self.scale)])

    def centre(self, x: np.ndarray) -> np.ndarray:
        """Any point will do; of what can't be averaged, a middle value."""
        return np.array([np.sort(x[:, c])[len(x) // 2] if s is None else x[:, c].mean() for c, s in enumerate(self.scale)])


def tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pivots(points: DataFrame, metric: Euclidean | Mixed = Euclidean()) -> np.ndarray:
    """PIVOTS points, each the farthest from those before it, of SAMPLE points chosen by hash."""
    got = points.select("at").orderBy(F.xxhash64("at"), "at").limit(SAMPLE).collect()
    x = np.unique(np.array([r["at"] for r in got], float), axis=0)
    if len(x) <= PIVOTS:
        return x
    far, out = metric.apart(x, metric.centre(x)[None])[:, 0], []
    for _ in range(PIVOTS):
        out.append(int(np.argmax(far)))
        apart = metric.apart(x, x[out[-1]][None])[:, 0]
        far = apart if len(out) == 1 else np.minimum(far, apart)
    return x[out]


def _cut(x: np.ndarray, size: int, metric: Euclidean | Mixed) -> Iterator[np.ndarray]:
    """Indices of the rows of x in compact groups of size rows at most: halves along the widest coordinate."""
    left = [np.arange(len(x))]
    while left:
        own = left.pop()
        if len(own) <= size:
            yield own
            continue
        wide = int(np.argmax(metric.widths(x[own])))
        half = len(own) // 2
        order = np.argpartition(x[own, wide], half)
        left += [own[order[:half]], own[order[half:]]]


def balls(points: DataFrame, at: np.ndarray, size: int, metric: Euclidean | Mixed = Euclidean()) -> DataFrame:
    """Rows (ball, centre, radius, n, x, more), from rows (at array, more array): all points in balls of size points at most, written once."""
    width = at.shape[1]

    def placed(batches):
        for batch in batches:
            x = batch.column("at").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            cell, near = np.zeros(len(x), np.int32), np.full(len(x), np.inf)
            step = max(1, _PAIRS // max(1, len(at)))
            for i in range(0, len(x), step):
                apart = metric.apart(x[i : i + step], at)
                cell[i : i + step], near[i : i + step] = apart.argmin(axis=1), apart.min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("more"), pa.array(cell), pa.array(near)], ["at", "more", "cell", "near"])

    def packed(batches):
        held, rows, count = [], 0, 0
        task = TaskContext.get().partitionId()

        def told():
            nonlocal count
            got = pa.Table.from_batches(held).combine_chunks()
            x = got.column("at").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(got), width)
            more = got.column("more").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(got), -1)
            cells = got.column("cell").to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)]))
            for a, b in zip(edges, edges[1:]):
                for own in _cut(x[a:b], size, metric):
                    points = x[a:b][own]
                    centre = metric.centre(points)
                    radius = float(metric.apart(points, centre[None]).max())
                    yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + count]), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius]), pa.array([len(own)], pa.int64()), pa.array([points.tobytes()], pa.binary()), pa.array([more[a:b][own].tobytes()], pa.binary())], ["ball", "centre", "radius", "n", "x", "more"])
                    count += 1

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= 32 * size:
                yield from told()
                held, rows = [], 0
        if rows:
            yield from told()

    dealt = points.select("at", "more").mapInArrow(placed, "at array<double>, more array<double>, cell int, near double")
    dealt = dealt.repartitionByRange(tasks(points), "cell", "near", F.xxhash64("at", "more")).sortWithinPartitions("cell")
    return checkpointed(dealt.mapInArrow(packed, "ball bigint, centre array<double>, radius double, n bigint, x binary, more binary"))


def needed(own: DataFrame, met: DataFrame, k: int, metric: Euclidean | Mixed = Euclidean()) -> DataFrame:
    """Rows (ball, other, low): the balls of references that a ball of rows may need, with the least distance between them."""
    facts = met.select("ball", "centre", "radius", "n").toPandas()  # BALLS rows at most
    names, n = facts["ball"].to_numpy(np.int64), facts["n"].to_numpy(np.int64)
    centre, radius = np.array(facts["centre"].tolist(), float).reshape(len(facts), -1), facts["radius"].to_numpy(float)
    sent = own.sparkSession.sparkContext.broadcast((names, n, centre, radius))

    def run(batches):
        names, n, centre, radius = sent.value
        first = min(k, len(names)) - 1
        for batch in batches:
            mine, reach = np.array(batch.column("centre").to_pylist(), float), batch.column("radius").to_numpy()
            for i, ball in enumerate(batch.column("ball").to_pylist()):
                apart = metric.apart(centre, mine[i][None])[:, 0]
                high = apart + radius + reach[i]
                few = np.argpartition(high, first)[: first + 1]
                few = few[np.argsort(high[few])]
                enough = int(np.searchsorted(np.cumsum(n[few]), min(k, n.sum())))
                low = np.maximum(apart - radius - reach[i], 0)
                at = np.flatnonzero(low <= high[few[min(enough, first)]] * (1 + SLACK) + SLACK)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), ball)), pa.array(names[at]), pa.array(low[at])], ["ball", "other", "low"])

    return own.select("ball", "centre", "radius").mapInArrow(run, "ball bigint, other bigint, low double")


class _Best:
    """The k nearest references of each row of a ball so far: distances, then more values of the references; the first of these breaks ties if ordered."""

    def __init__(self, x: np.ndarray, k: int, width: int, ordered: bool, metric: Euclidean | Mixed = Euclidean()):
        self.x, self.k, self.ordered, self.metric = x, k, ordered, metric
        self.near = np.full((len(x), k), np.inf)
        self.more = np.full((len(x), k, width), np.nan)

    def meet(self, centre: np.ndarray, radius: float, x: np.ndarray, more: np.ndarray) -> None:
        low = self.metric.apart(self.x, centre[None])[:, 0] - radius
        rows = np.flatnonzero(low <= self.near[:, -1] * (1 + SLACK) + SLACK)
        step = max(1, _PAIRS // len(x))
        for i in range(0, len(rows), step):
            self._merge(rows[i : i + step], x, more)

    def _merge(self, rows: np.ndarray, x: np.ndarray, more: np.ndarray) -> None:
        near = self.metric.apart(self.x[rows], x)
        if self.ordered:
            near = np.round(near, 9)
        elif self.k == 1:
            j = near.argmin(axis=1)
            better = near[np.arange(len(rows)), j] < self.near[rows, 0]
            self.near[rows[better], 0] = near[better, j[better]]
            self.more[rows[better], 0] = more[j[better]]
            return
        worst = self.near[rows, -1]
        if self.k < len(x):
            worst = np.minimum(worst, np.partition(near, self.k - 1, axis=1)[:, self.k - 1])
        row, col = np.nonzero(near <= worst[:, None])  # with all ties
        old_row, old_col = np.nonzero(np.isfinite(self.near[rows]))
        at = np.concatenate((row, old_row))
        d = np.concatenate((near[row, col], self.near[rows][old_row, old_col]))
        m = np.concatenate((more[col], self.more[rows][old_row, old_col]))
        order = np.lexsort((m[:, 0], d, at)) if self.ordered else np.lexsort((d, at))
        at, d, m = at[order], d[order], m[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        kept = rank < self.k
        self.near[rows[at[kept]], rank[kept]] = d[kept]
        self.more[rows[at[kept]], rank[kept]] = m[kept]


def nearest(rows: DataFrame, at: list[Column], refs: DataFrame, ref_at: list[Column], k: int = 1, carry: tuple[str, ...] = (), ordered: bool = False, out: str = "near", metric: Euclidean | Mixed = Euclidean()) -> DataFrame:
    """rows with an array out of structs (d, carried columns as double) of the k nearest references, nearest first.

    Distance of the coordinates, which are never null, by the metric. carry
    names numeric columns of refs. With ordered, distances are rounded to nine
    places and ties go by the first carried column; otherwise any of the equally
    near. Fewer references than k give shorter arrays, none an empty one. Rows of
    equal coordinates are met once.
    """
    width = len(carry)
    rows = checkpointed(rows.withColumn("at__", F.array(*(c.cast("double") for c in at))))
    points = rows.select(F.col("at__").alias("at"), F.array(F.lit(0.0)).alias("more")).dropDuplicates(["at"])
    told = refs.select(F.array(*(c.cast("double") for c in ref_at)).alias("at"), F.array(*(F.col(c).cast("double") for c in carry), F.lit(0.0)).alias("more"))
    if k == 1 and not carry:
        told = told.dropDuplicates(["at"])
    told = checkpointed(told)
    count = told.count()
    kind = ", ".join(["d: double", *(f"{c}: double" for c in carry)])
    if not count:
        return rows.drop("at__").withColumn(out, F.array().cast(f"array<struct<{kind}>>"))
    centres = pivots(told, metric)
    met = balls(told, centres, max(BLOCK, -(-4 * count // BALLS)), metric)  # balls are half full at least, but for the last of a cell
    own = balls(points, centres, BLOCK, metric)
    pairs = needed(own, met, k, metric).withColumnRenamed("other", "met")
    others = met.select(F.col("ball").alias("met"), "centre", "radius", "x", "more")
    sent = merged(pairs, others, "met").drop("met")
    first = own.select("ball", F.lit(-1.0).alias("low"), "centre", "radius", "x", "more")
    both = first.unionByName(sent).repartition(tasks(rows), "ball").sortWithinPartitions("ball", "low")
    dim = len(at)

    def run(batches):
        ball, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column("x")[i].as_buffer()).reshape(-1, dim)
                more = np.frombuffer(batch.column("more")[i].as_buffer()).reshape(len(x), -1)
                if batch.column("ball")[i].as_py() != ball:
                    if best is not None:
                        yield ended(best)
                    ball, best = batch.column("ball")[i].as_py(), _Best(x, k, max(width, 1), ordered, metric)
                else:
                    best.meet(np.array(batch.column("centre")[i].as_py()), batch.column("radius")[i].as_py(), x, more[:, : max(width, 1)])
        if best is not None:
            yield ended(best)

    def ended(best):
        n = np.isfinite(best.near).sum(axis=1)
        kept = np.isfinite(best.near)
        offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
        values = [best.near[kept], *(best.more[:, :, c][kept] for c in range(width))]
        struct = pa.StructArray.from_arrays([pa.array(v, from_pandas=True) for v in values], ["d", *carry])
        places = pa.ListArray.from_arrays(pa.array(np.arange(len(best.x) + 1, dtype=np.int32) * dim), pa.array(best.x.reshape(-1)))
        return pa.RecordBatch.from_arrays([places, pa.ListArray.from_arrays(offsets, struct)], ["at__", out])

    got = both.mapInArrow(run, f"at__ array<double>, {out} array<struct<{kind}>>")
    return merged(rows, got, "at__").drop("at__")


def over_all(rows: DataFrame, own: list[Column], refs: DataFrame, ref_own: list[Column], kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], join: Callable[[np.ndarray, np.ndarray], np.ndarray], names: list[str], out: str, size: int = 16_384) -> DataFrame:
    """rows with a struct out of doubles: kernel(rows' values, references' values), a row of values for each row, over blocks of all references put together by join().

    For scores in which every reference counts. A block of rows meets a block of
    references in one task; nothing passes through the driver.
    """
    numbered = checkpointed(rows.withColumn("block_row__", F.monotonically_increasing_id()))

    def packed(df: DataFrame, values: list[Column], named: bool) -> DataFrame:
        cols = [F.array(*(c.cast("double") for c in values)).alias("v"), *([F.col("block_row__")] if named else [])]

        def run(batches):
            task, count = TaskContext.get().partitionId(), 0
            for batch in batches:
                for start in range(0, batch.num_rows, size):
                    part = batch.slice(start, size)
                    ids = part.column("block_row__").to_numpy().tobytes() if named else b""
                    yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + count]), pa.array([ids], pa.binary()), pa.array([part.column("v").flatten().to_numpy(zero_copy_only=False).tobytes()], pa.binary())], ["block", "ids", "v"])
                    count += 1

        return checkpointed(df.select(*cols).mapInArrow(run, "block bigint, ids binary, v binary"))

    a, b = packed(numbered, own, True), packed(refs, ref_own, False).select(F.col("v").alias("w"))
    wide, ref_wide = len(own), len(ref_own)

    def met(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column("v")[i].as_buffer()).reshape(-1, wide)
                y = np.frombuffer(batch.column("w")[i].as_buffer()).reshape(-1, ref_wide)
                step = max(1, _PAIRS // max(1, len(y)))
                got = np.concatenate([kernel(x[j : j + step], y) for j in range(0, len(x), step)]).reshape(len(x), len(names))
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), batch.column("ids").slice(i, 1), pa.array([got.tobytes()], pa.binary())], ["block", "ids", "v"])

    def joined(batches):
        block, ids, total = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                got = np.frombuffer(batch.column("v")[i].as_buffer()).reshape(-1, len(names))
                if batch.column("block")[i].as_py() == block:
                    total = join(total, got)
                    continue
                if block is not None:
                    yield told(ids, total)
                block, ids, total = batch.column("block")[i].as_py(), batch.column("ids")[i].as_py(), got
        if block is not None:
            yield told(ids, total)

    def told(ids, total):
        struct = pa.StructArray.from_arrays([pa.array(total[:, c]) for c in range(len(names))], names)
        return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), struct], ["block_row__", out])

    partial = a.crossJoin(b).mapInArrow(met, "block bigint, ids binary, v binary")  # blocks by blocks
    partial = partial.repartition(tasks(rows), "block").sortWithinPartitions("block")
    got = partial.mapInArrow(joined, f"block_row__ bigint, {out} struct<{', '.join(f'{n}: double' for n in names)}>")
    return merged(numbered, got, "block_row__").drop("block_row__")
