"""Sums of squared Gower distances from rows to clusters, without comparing rows with each other.

A squared Gower distance is a mean of scaled differences, squared, so it has
products of two columns' differences. Summed over a cluster's rows, each
product follows from a profile of the cluster:

* a number with itself: the count and the sums of values and squares;
* factors: counts of levels and of pairs of levels;
* a number and a factor: sums of the values below a row's, over all rows and
  over those of its level;
* two numbers x and z: |x - x'| |z - z'| is (x - x')(z - z') with the sign that
  tells whether the rows are in the same order in both, so sums of 1, z, x and
  xz over the rows below in x, below in z, and below in both are enough.

Rows are numbered once in the order of each number, and cut into strips of
equal size by these places; ties may stand in any order, as their difference is
0, so one value that many rows share is cut like any other. A step counts
tables of strips (one aggregation; what reaches the driver and the tasks is
bounded by TABLES), and a task adds to a strip what stands in it. Rows with
nulls are told apart by which columns they know, as that decides by how many
columns a distance is divided.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftpool.functions.frames import checkpointed, merged
from siftpool.operators.distance import Gower
from siftpool.operators.surrogates import placed

STRIP, STRIPS = 16_384, 64  # rows of a strip, which grows beyond so many strips
TABLES = 1 << 24  # numbers of all tables at most


def _below(key: np.ndarray, w: np.ndarray, orders: list[np.ndarray]) -> np.ndarray:
    """For each row the sum of w over earlier rows with a smaller key; orders: _orders(key)."""
    out = np.zeros_like(w)
    for bit, order in enumerate(orders):
        block, left = key[order] >> (bit + 1), (key[order] >> bit & 1) == 0
        cum = np.cumsum(np.where(left[:, None], w[order], 0.0), axis=0)
        first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        base = np.concatenate((np.zeros((1, w.shape[1])), cum))[np.repeat(first, np.diff(np.append(first, len(block))))]
        out[order[~left]] += (cum - base)[~left]
    return out


def _orders(key: np.ndarray) -> list[np.ndarray]:
    """For each bit of the key, the rows by the bits above it, each block in the order given."""
    return [np.argsort(key >> (bit + 1), kind="stable") for bit in range(int(key.max(initial=0)).bit_length())]


def _within(order: np.ndarray, group: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums of w over a row and those before it in its group; order: the rows by group."""
    cum = np.cumsum(w[order], axis=0)
    g = group[order]
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    base = np.concatenate((np.zeros((1, w.shape[1])), cum))[np.repeat(first, np.diff(np.append(first, len(g))))]
    out = np.empty_like(w)
    out[order] = cum - base
    return out


def matrix(batch: pa.RecordBatch | pa.Table, name: str, width: int) -> np.ndarray:
    """A column of arrays, all so wide, as rows."""
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))


class Stored:
    """Labels and sums of a batch that has them as columns. A kernel with whole set takes a partition at once instead, which is a strip."""

    whole = False

    def __init__(self, n: int, starts: int):
        self.n, self.starts = n, starts

    def __call__(self, group: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return matrix(group, "labels__", self.starts), matrix(group, "sums__", self.n * self.starts)


class Computed:
    def __init__(self, of: Callable, whole: bool):
        self.of, self.whole = of, whole

    def __call__(self, group: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return self.of(group)


def parts(batches: Iterable[pa.RecordBatch], whole: bool) -> Iterator[pa.Table]:
    held = (b for b in batches if b.num_rows)
    if not whole:
        yield from (pa.Table.from_batches([b]) for b in held)
    elif group := list(held):
        yield pa.Table.from_batches(group).combine_chunks()


def with_sums(frame: DataFrame, of: Stored | Computed) -> DataFrame:
    """frame with sums__, in its partitions."""
    if "sums__" in frame.columns:
        return frame

    def run(batches):
        for group in parts(batches, of.whole):
            yield from group.append_column("sums__", lists(of(group)[1])).to_batches()

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField("sums__", T.ArrayType(T.DoubleType()))]))


class GowerProfiles:
    """Profiles of clusters of rows under a fitted Gower distance; rows (the frame given, with columns of their own) is what sums() reads."""

    def __init__(self, rows: DataFrame, d: Gower):
        """rows have a unique row__ and the columns of the distance's space."""
        used = [(p, c) for p, c in zip(d.space.params, d.coordinates()) if not (p.numeric and d.spread[p.id] <= 0)]
        self.numbers = [k for k, (p, _) in enumerate(used) if p.numeric]
        self.factors = [k for k, (p, _) in enumerate(used) if not p.numeric]
        at = [F.nanvl(c, F.lit(None).cast("double")) for _, c in used]
        least = rows.agg(F.count("*").alias("n"), *(F.min(c).alias(f"m{k}") for k, c in enumerate(at)), *(F.collect_set(at[k]).alias(f"s{k}") for k in self.factors)).first()  # levels of a space
        self.levels = {k: sorted(least[f"s{k}"]) for k in self.factors}
        for k in self.numbers:
            at[k] = (at[k] - F.lit(least[f"m{k}"])) / F.lit(d.spread[used[k][0].id])
        for k in self.factors:
            at[k] = (F.array_position(F.array(*map(F.lit, self.levels[k])), at[k]) - 1).cast("double") if self.levels[k] else F.lit(None).cast("double")
        self.size = max(STRIP, math.ceil(least["n"] / STRIPS))
        self.strips = max(1, math.ceil(least["n"] / self.size))
        rows = rows.withColumns({f"at{k}__": c for k, c in enumerate(at)})
        known = F.lit(0)
        for k in range(len(at)):
            known = known + F.when(F.col(f"at{k}__").isNotNull(), 1 << k).otherwise(0)
        rows = rows.withColumn("known__", known)
        for k in self.numbers:
            rows = placed(rows, [f"at{k}__"]).withColumnRenamed("place", f"place{k}__")
        if len(self.numbers) == 1:  # each strip a partition, which later steps keep: they need no shuffle
            rows = rows.repartitionById(self.strips, F.expr(f"int(place{self.numbers[0]}__ div {self.size})"))
        self.rows, self.width = checkpointed(rows), len(at)
        self.patterns = sorted(r.known__ for r in self.rows.select("known__").distinct().collect())

    def shapes(self, clusters: int) -> dict[tuple, tuple[int, ...]]:
        """The tables of that many clusters and their shapes."""
        g, p, size = len(self.patterns) * clusters, self.strips, {k: max(1, len(v)) for k, v in self.levels.items()}
        out: dict[tuple, tuple[int, ...]] = {("all",): (g,)}
        out |= {("own", f): (g, 2) for f in self.numbers} | {("level", a): (size[a], g) for a in self.factors}
        out |= {("levels", a, b): (size[a], size[b], g) for a in self.factors for b in self.factors if a < b}
        out |= {("strip", f, a): (p, size[a], g, 2) for f in self.numbers for a in self.factors}
        return out | {("cell", f, h): (p, p, g, 4) for f in self.numbers for h in self.numbers if f < h}

    def fits(self, clusters: int) -> bool:
        """Whether the tables are within TABLES; they are larger only with very many levels or clusters."""
        return sum(math.prod(s) for s in self.shapes(clusters).values()) <= TABLES

    def sums(self, told: DataFrame, n: int, starts: int) -> DataFrame:
        """told (rows with labels__, a cluster below n for each start) with sums__: the sum of squared distances to each cluster of each start."""
        frame, of = self.summing(told, self.counted(told, n, starts)[0], n, starts)
        return with_sums(frame, of)

    def _reader(self, starts: int) -> Callable:
        numbers, patterns, width = self.numbers, np.array(self.patterns, np.int64), self.width

        def read(batch):
            column = lambda c, kind: batch.column(c).to_numpy(zero_copy_only=False).astype(kind)
            x = np.column_stack([column(f"at{k}__", float) for k in range(width)]) if width else np.zeros((batch.num_rows, 0))
            places = {k: column(f"place{k}__", np.int64) for k in numbers}
            return column("row__", np.int64), x, np.searchsorted(patterns, column("known__", np.int64)), matrix(batch, "labels__", starts), places

        return read

    def _own(self, told: DataFrame) -> DataFrame:
        moved = F.col("moved__") if "moved__" in told.columns else F.lit(0)
        return told.select("row__", "known__", F.col("labels__").cast("array<int>").alias("labels__"), moved.alias("moved__"), *(f"at{k}__" for k in range(self.width)), *(f"place{k}__" for k in self.numbers))

    def _views(self, clusters: int) -> Callable[[np.ndarray], dict[tuple, np.ndarray]]:
        shapes = self.shapes(clusters)

        def views(flat: np.ndarray) -> dict[tuple, np.ndarray]:
            out, at = {}, 0
            for name, shape in shapes.items():
                out[name] = flat[at : at + math.prod(shape)].reshape(shape)
                at += math.prod(shape)
            return out

        return views

    def counted(self, told: DataFrame, n: int, starts: int) -> tuple[np.ndarray, set[tuple[int, int]], int]:
        """All tables, which clusters of which starts have rows, and how many labels moved__ tells; one job."""
        clusters, size, factors = n * starts, self.size, self.factors
        read, views, total = self._reader(starts), self._views(n * starts), sum(math.prod(s) for s in self.shapes(n * starts).values())

        def run(batches):
            flat = np.zeros(total + 1)
            into = views(flat)
            for batch in batches:
                _, x, pattern, labels, places = read(batch)
                flat[total] += batch.column("moved__").to_numpy(zero_copy_only=False).sum()
                has = ~np.isnan(x)
                level = {a: np.where(has[:, a], x[:, a], 0).astype(int) for a in factors}
                for s in range(starts):
                    g = pattern * clusters + s * n + labels[:, s]
                    for name, table in into.items():
                        ok = np.flatnonzero(has[:, list(name[1:])].all(axis=1))
                        i, v = g[ok], x[ok]
                        if name[0] == "all":
                            np.add.at(table, i, 1.0)
                        elif name[0] == "own":
                            np.add.at(table, i, np.column_stack([v[:, name[1]], v[:, name[1]] ** 2]))
                        elif name[0] == "level":
                            np.add.at(table, (level[name[1]][ok], i), 1.0)
                        elif name[0] == "levels":
                            np.add.at(table, (level[name[1]][ok], level[name[2]][ok], i), 1.0)
                        elif name[0] == "strip":
                            np.add.at(table, (places[name[1]][ok] // size, level[name[2]][ok], i), np.column_stack([np.ones(len(ok)), v[:, name[1]]]))
                        else:
                            a, b = v[:, name[1]], v[:, name[2]]
                            np.add.at(table, (places[name[1]][ok] // size, places[name[2]][ok] // size, i), np.column_stack([np.ones(len(ok)), a, b, a * b]))
            slot = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(flat[slot])], ["slot", "v"])

        got = self._own(told).mapInArrow(run, "slot bigint, v double").groupBy("slot").agg(F.sum("v").alias("v")).toArrow()  # TABLES rows at most
        flat = np.zeros(total + 1)
        flat[got.column("slot").to_numpy()] = got.column("v").to_numpy()
        held = views(flat)[("all",)].reshape(-1, clusters).sum(axis=0)
        return flat[:total], {divmod(int(c), n) for c in np.flatnonzero(held)}, round(flat[total])

    def summing(self, told: DataFrame, flat: np.ndarray, n: int, starts: int) -> tuple[DataFrame, Stored | Computed]:
        """A frame, and what gives the labels and sums of its batches. With one number at most, the frame is told (rows in the partitions of self.rows), and no row is shuffled."""
        clusters, size, numbers, factors, patterns = n * starts, self.size, self.numbers, self.factors, np.array(self.patterns, np.int64)
        read, views, sent = self._reader(starts), self._views(clusters), told.sparkSession.sparkContext.broadcast(flat)
        names = [f"v{c}" for c in range(clusters)]
        schema = "row__ bigint, " + ", ".join(f"{c} double" for c in names)

        def weights(pattern: np.ndarray, q: int) -> np.ndarray:
            """1 by the squared number of columns that a row and those of pattern q know."""
            both = np.bitwise_count(patterns[pattern] & patterns[q]).astype(float)
            return np.where(both > 0, 1 / np.maximum(both, 1) ** 2, 0.0)

        def knows(q: int, *cols: int) -> bool:
            return all(patterns[q] >> k & 1 for k in cols)

        def result(row, out, kind):
            return kind.from_arrays([pa.array(row), *(pa.array(out[:, c]) for c in range(clusters))], ["row__", *names])

        def plain(table: dict[tuple, np.ndarray], x: np.ndarray, pattern: np.ndarray) -> np.ndarray:
            """What needs no order."""
            has, out = ~np.isnan(x), np.zeros((len(x), clusters))
            level = {a: np.where(has[:, a], x[:, a], 0).astype(int) for a in factors}
            for q in range(len(patterns)):
                g, total = slice(q * clusters, (q + 1) * clusters), np.zeros((len(x), clusters))
                every = table[("all",)][g]
                for f in numbers:
                    if knows(q, f):
                        v, (first, second) = np.where(has[:, f], x[:, f], 0)[:, None], table["own", f][g].T
                        total += np.where(has[:, f, None], every * v * v - 2 * v * first + second, 0.0)
                for i, a in enumerate(factors):
                    if not knows(q, a):
                        continue
                    alike = table["level", a][:, g][level[a]]
                    total += np.where(has[:, a, None], every - alike, 0.0)
                    for b in factors[i + 1 :]:
                        if knows(q, b):
                            unlike = every - alike - table["level", b][:, g][level[b]] + table["levels", a, b][:, :, g][level[a], level[b]]
                            total += 2 * np.where((has[:, a] & has[:, b])[:, None], unlike, 0.0)
                out += weights(pattern, q)[:, None] * total
            return out

        def ordered(f: int, table: dict[tuple, np.ndarray], x: np.ndarray, pattern: np.ndarray, labels: np.ndarray, places: dict[int, np.ndarray]) -> np.ndarray:
            """What the order of number f adds for one strip of it, whose rows all know it."""
            by = np.argsort(places[f], kind="stable")
            x, pattern, labels = x[by], pattern[by], labels[by]
            places = {k: v[by] for k, v in places.items()}
            p, has, out, v = int(places[f][0] // size), ~np.isnan(x), np.zeros((len(x), clusters)), x[:, f]
            level = {a: np.where(has[:, a], x[:, a], -1).astype(int) for a in factors}
            sorted_by = {a: np.argsort(level[a], kind="stable") for a in factors}
            pairs = []
            for h in numbers:
                if h == f:
                    continue
                at = np.flatnonzero(has[:, h])
                if f < h:  # rows of this strip by the other number; keys are places in this one
                    at = at[np.argsort(places[h][at], kind="stable")]
                    key = np.empty(len(at), np.int64)
                    key[np.argsort(places[f][at], kind="stable")] = np.arange(len(at))
                else:  # rows of this strip in its order; keys are strips of the other number
                    key = places[h][at] // size
                pairs.append((h, at, key, _orders(key)))
            for q in range(len(patterns)):
                if not knows(q, f):
                    continue
                weight = 2 * weights(pattern, q)
                for c in range(clusters):
                    s, k = divmod(c, n)
                    g, member = q * clusters + c, ((pattern == q) & (labels[:, s] == k)).astype(float)
                    for a in factors:
                        if not knows(q, a):
                            continue
                        t, w = table["strip", f, a][:, :, g], member[:, None] * np.column_stack([np.ones(len(v)), v])
                        low, high = t[:p].sum(axis=0), t.sum(axis=0)
                        below = low.sum(axis=0) + np.cumsum(w, axis=0)
                        every = v * (2 * below[:, 0] - high[:, 0].sum()) - (2 * below[:, 1] - high[:, 1].sum())
                        own, of = np.maximum(level[a], 0), _within(sorted_by[a], level[a], w)
                        below, high = low[own] + of, high[own]
                        alike = v * (2 * below[:, 0] - high[:, 0]) - (2 * below[:, 1] - high[:, 1])
                        out[:, c] += weight * np.where(has[:, a], every - alike, 0.0)
                    for h, at, key, orders in pairs:
                        if not knows(q, h) or not len(at):
                            continue
                        z = x[at, h]
                        a, b = (v[at], z) if f < h else (z, v[at])
                        w = member[at, None] * np.column_stack([np.ones(len(at)), a, b, a * b])
                        both = _below(key, w, orders) if w.any() else np.zeros_like(w)
                        if f < h:
                            t = table["cell", f, h][:, :, g]
                            low = t[:p].sum(axis=0)
                            both = both + (np.cumsum(low, axis=0) - low)[places[h][at] // size]
                            below = np.empty_like(w)
                            below[np.argsort(key, kind="stable")] = np.cumsum(w[np.argsort(key, kind="stable")], axis=0)
                            sign = t.sum(axis=(0, 1)) - 2 * (low.sum(axis=0) + below) + 4 * both
                        else:
                            below = table["cell", h, f][:, :p, g].sum(axis=(0, 1)) + np.cumsum(w, axis=0)
                            sign = 4 * both - 2 * below
                        out[at, c] += weight[at] * (a * b * sign[:, 0] - b * sign[:, 1] - a * sign[:, 2] + sign[:, 3])
            back = np.empty_like(out)
            back[by] = out
            return back

        if len(numbers) <= 1:

            def whole(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
                table = views(sent.value)
                _, x, pattern, labels, places = read(group)
                out = plain(table, x, pattern)
                if numbers and factors:
                    at = np.flatnonzero(~np.isnan(x[:, numbers[0]]))
                    if len(at):
                        out[at] += ordered(numbers[0], table, x[at], pattern[at], labels[at], {k: v[at] for k, v in places.items()})
                return labels, out

            return told, Computed(whole, bool(numbers))

        def unordered(batches):
            table = views(sent.value)
            for batch in batches:
                row, x, pattern, _, _ = read(batch)
                yield result(row, plain(table, x, pattern), pa.RecordBatch)

        def strip_of(f: int):
            def run(group: pa.Table) -> pa.Table:
                row, *rest = read(group)
                return result(row, ordered(f, views(sent.value), *rest), pa.Table)

            return run

        own = self._own(told)
        added = own.mapInArrow(unordered, schema)
        for f in numbers:
            strips_of = own.where(F.col(f"at{f}__").isNotNull()).withColumn("strip__", F.expr(f"place{f}__ div {size}"))
            added = added.unionByName(strips_of.groupBy("strip__").applyInArrow(strip_of(f), schema))
        added = added.groupBy("row__").agg(*(F.sum(c).alias(c) for c in names)).select("row__", F.array(*names).alias("sums__"))
        return checkpointed(merged(told, added, "row__")), Stored(n, starts)
