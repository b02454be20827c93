"""Co-moments of every two columns, in one scan.

Each task keeps, for every pair of columns and over the rows that have both values, their number,
means, squared deviations and product of deviations. Blocks of rows enter as matrix products of
values and of masks of what is there; blocks, and later the tasks' results, are merged by the
formulas of Chan, Golub and LeVeque. Nothing of this grows with the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.plans.shared import map_batches
from tallyscope.plans.table import Table, field

#: Values of the rows that are taken at once where there are groups (32 MB).
BLOCK_VALUES = 1 << 22
#: Deviations below this part of the squares that they come from are computed again, value by value.
DOUBTFUL = 1e-7
FACTS = ("n", "mean_a", "mean_b", "m2_a", "m2_b", "c")


class CoMoments:
    """n, mean, m2 and c of all pairs; ``mean[i, j]`` and ``m2[i, j]`` are those of column i beside j."""

    def __init__(self, n: np.ndarray, mean: np.ndarray, m2: np.ndarray, c: np.ndarray):
        self.n, self.mean, self.m2, self.c = n, mean, m2, c

    @classmethod
    def of(cls, x: np.ndarray) -> CoMoments:
        """Of the rows of ``x``; NaN stands for a missing value. Pairs with an infinite value get c NaN."""
        there = ~np.isnan(x)
        endless = np.isinf(x)
        plain = there & ~endless
        pivot = np.where(plain, x, 0).sum(0) / np.maximum(plain.sum(0), 1)
        y = np.where(plain, x - pivot, 0)
        m = there.astype(float)
        n = m.T @ m
        some = np.maximum(n, 1)
        s, q = y.T @ m, (y * y).T @ m
        mean, m2 = pivot[:, None] + s / some, q - s * s / some
        c = y.T @ y - s * s.T / some
        for i, j in np.argwhere((m2 <= DOUBTFUL * q) & (n > 0)):
            both = plain[:, i] & plain[:, j]
            if both.any():
                a, b = x[both, i], x[both, j]
                mean[i, j] = a[0] if a.min() == a.max() else a.mean()
                off = a - mean[i, j]
                m2[i, j] = off @ off
                c[i, j] = c[j, i] = off @ (b - b.mean())
        if endless.any():
            e = endless.astype(float)
            c[(e.T @ m + m.T @ e) > 0] = np.nan
        return cls(n, mean, m2, c)

    def add(self, other: CoMoments) -> None:
        total = self.n + other.n
        some = np.maximum(total, 1)
        apart = np.where((self.n > 0) & (other.n > 0), other.mean - self.mean, 0)
        weight = self.n * other.n / some
        self.m2 += other.m2 + apart * apart * weight
        self.c += other.c + apart * apart.T * weight
        self.mean = np.where(self.n > 0, self.mean + apart * other.n / some, other.mean)
        self.n = total

    def facts(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        return [self.n[a, b].astype(np.int64), self.mean[a, b], self.mean[b, a], self.m2[a, b], self.m2[b, a], self.c[a, b]]


def grouped(x: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """The facts of pairs (a, b) in each run of rows, as arrays of runs x pairs."""
    sizes = np.diff(np.append(starts, len(x)))

    def per_run(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, starts)

    there, endless = ~np.isnan(x), np.isinf(x)
    plain = there & ~endless
    pivot = per_run(np.where(plain, x, 0)) / np.maximum(per_run(plain.astype(float)), 1)
    y = np.where(plain, x - np.repeat(pivot, sizes, axis=0), 0)
    out = [np.zeros((len(starts), len(a)), np.int64 if f == "n" else float) for f in FACTS]
    for k, (i, j) in enumerate(zip(a, b)):
        both = there[:, i] & there[:, j]
        n = per_run(both.astype(float))
        some = np.maximum(n, 1)
        yi, yj = y[:, i] * both, y[:, j] * both
        si, sj = per_run(yi), per_run(yj)
        c = per_run(yi * yj) - si * sj / some
        out[0][:, k] = n
        for column, s, own, mean, m2 in ((i, si, yi, out[1], out[3]), (j, sj, yj, out[2], out[4])):
            mean[:, k] = pivot[:, column] + s / some
            m2[:, k] = np.maximum(per_run(own * own) - s * s / some, 0)
            low = np.minimum.reduceat(np.where(both, x[:, column], np.inf), starts)
            constant = low == np.maximum.reduceat(np.where(both, x[:, column], -np.inf), starts)
            mean[constant, k] = low[constant]
            m2[constant, k] = c[constant] = 0
        wrong = per_run((both & (endless[:, i] | endless[:, j])).astype(float)) > 0
        out[5][:, k] = np.where(wrong, np.nan, c)
    return out


def _codes(keys: list[pa.Array]) -> np.ndarray:
    codes = np.zeros(len(keys[0]), np.int64)
    for key in keys:
        found = key.dictionary_encode(null_encoding="encode")
        codes = codes * len(found.dictionary) + found.indices.to_numpy(zero_copy_only=False)
        codes = np.unique(codes, return_inverse=True)[1]
    return codes


def _blocks(batches: Iterator[pa.RecordBatch], values: int) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows * batch.num_columns >= values:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _numbers(part: pa.Table | pa.RecordBatch, first: int) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns[first:]])


def merged(partials: Column) -> Column:
    """One struct of ``FACTS`` from an array of them."""
    empty = F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(f) for f in FACTS[1:]])

    def merge(x: Column, y: Column) -> Column:
        n = x["n"] + y["n"]
        some = F.greatest(n, F.lit(1))
        both = (x["n"] > 0) & (y["n"] > 0)
        a = F.when(both, y["mean_a"] - x["mean_a"]).otherwise(0.0)
        b = F.when(both, y["mean_b"] - x["mean_b"]).otherwise(0.0)
        weight = x["n"] / some * y["n"]
        means = [
            F.when(x["n"] == 0, y[m]).otherwise(x[m] + d * (y["n"] / some)) for m, d in (("mean_a", a), ("mean_b", b))
        ]
        sums = [x[m] + y[m] + d * weight for m, d in (("m2_a", a * a), ("m2_b", b * b), ("c", a * b))]
        return F.struct(n.alias("n"), *[v.alias(f) for f, v in zip(FACTS[1:], [*means, *sums])])

    return F.aggregate(partials, empty, merge)


def comoments(t: Table, columns: Sequence[str]) -> DataFrame:
    """(keys, rows, position_a, position_b, n, mean_a, mean_b, m2_a, m2_b, c) for a before b."""
    n_keys = len(t.by)
    a, b = np.triu_indices(len(columns), 1)
    places = np.array([t.position[c] for c in columns], np.int32)
    facts = [T.StructField("rows", T.LongType()), T.StructField("position_a", T.IntegerType()), T.StructField("position_b", T.IntegerType())]
    facts += [T.StructField(f, T.LongType() if f == "n" else T.DoubleType()) for f in FACTS]
    names = [f"__key_{i}" for i in range(n_keys)]
    source = t.df.select(
        *[field(k).alias(name) for k, name in zip(t.by, names)],
        *[field(c).cast("double").alias(f"__value_{i}") for i, c in enumerate(columns)],
    )

    def packed(keys: list[pa.Array], rows: np.ndarray, found: list[np.ndarray]) -> pa.RecordBatch:
        runs = len(rows)
        arrays = [k.take(pa.array(np.repeat(np.arange(runs), len(a)))) for k in keys]
        arrays += [pa.array(np.repeat(rows, len(a))), pa.array(np.tile(places[a], runs)), pa.array(np.tile(places[b], runs))]
        arrays += [pa.array(f.ravel()) for f in found]
        return pa.RecordBatch.from_arrays(arrays, names=[*names, *(f.name for f in facts)])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = None, 0
        for batch in batches:
            rows += batch.num_rows
            found = CoMoments.of(_numbers(batch, 0))
            if total is None:
                total = found
            else:
                total.add(found)
        if total is not None:
            yield packed([], np.array([rows]), total.facts(a, b))

    def per_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, BLOCK_VALUES):
            keys = [c.combine_chunks() for c in block.columns[:n_keys]]
            codes = _codes(keys)
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            sizes = np.diff(np.append(starts, len(codes)))
            found = grouped(_numbers(block, n_keys)[order], starts, a, b)
            yield packed([k.take(pa.array(order[starts])) for k in keys], sizes, found)

    kept = T.StructType([*source.schema.fields[:n_keys], *facts])
    partials = map_batches(source, per_group if n_keys else whole, kept)
    return (
        partials.groupBy(*names, "position_a", "position_b")
        .agg(F.sum("rows").alias("rows"), merged(F.collect_list(F.struct(*FACTS))).alias("all"))
        .select(*[field(name).alias(k) for k, name in zip(t.by, names)], "rows", "position_a", "position_b", "all.*")
    )
