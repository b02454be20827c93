"""SimHash near-dedup with a hierarchical index in Gray order.

Two fingerprints of 64 bits with at most four differing bits differ in at most one bit of one of
three segments. So the index is kept three times, each time with another segment in front. It is
cut into tiles by the first bits (a range of Gray ranks), and a fingerprint is sent to its own tile
and those one bit away. In a tile, members stand by Gray rank; nodes above them hold the bits that
a group shares (a mask and a pattern). A search goes down from the top and adds up differences,
each bit once, where a node fixes it; too many of them prune the whole group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.tables import fresh, map_batches, on_workers, written

BITS = 64
#: Differences that still link two fingerprints.
DIFFERENCES = 4
#: Bits of the segments; four differences leave one segment with at most one.
SEGMENTS = (22, 21, 21)
#: Members that a tile has on average, if bits of the segment allow.
TILE = 500
#: Rows of a tile (its members and what is sent to it) that are searched for by one task; the
#: searches of a larger one are shared out, each part with all members, eight bytes each.
SEARCHES = 200_000
FANOUT = 16
#: Pairs of a fingerprint and a node that are tested at once; bounds memory.
PAIRS = 1 << 18
#: Shingles that are counted at once; bounds memory for very long texts.
SHINGLES = 1 << 15


def fingerprint(text: str, size: int = 4) -> int:
    """Majority of the bits of XXH64 (seed 42) over the word shingles, repeats included."""
    words = text.encode().lower().split()  # bytes: only A-Z and ASCII white space are meant
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - [len(w) + 1 for w in words]
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    first, last = starts[:n].tolist(), (ends[min(size, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, SHINGLES):
        part = zip(first[at : at + SHINGLES], last[at : at + SHINGLES])
        hashes = np.array([digest(joined[a:b], 42) for a, b in part], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_column: str = "text", size: int = 4, into: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint as a long (the unsigned value's bits); null is an empty text."""
    at = docs.columns.index(text_column)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", size) for t in batch.column(at)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found.view(np.int64))], names=[*batch.schema.names, into]
            )

    return map_batches(docs, add, T.StructType([*docs.schema.fields, T.StructField(into, T.LongType())]))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of a code in the reflected Gray sequence."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Hierarchy over codes in Gray order; finds codes close to others and joins them in classes."""

    def __init__(self, members: np.ndarray, others: np.ndarray, segment: int, asked: np.ndarray | None = None):
        """``asked``: codes to search for; all of them if None."""
        self.values = np.unique(np.concatenate([members, others]))
        self.asked = np.arange(len(self.values)) if asked is None else np.searchsorted(self.values, np.unique(asked))
        self.label = np.arange(len(self.values))
        members = np.unique(members)
        members = members[np.argsort(gray_rank(members))]
        self.place = np.searchsorted(self.values, members)
        self.front = np.uint64(((1 << segment) - 1) << (BITS - segment))
        full = ~np.uint64(0)
        pattern, mask = [members], [np.full(len(members), full)]
        low, high = members, members
        while len(low) > FANOUT:
            cuts = np.arange(0, len(low), FANOUT)
            low, high = np.bitwise_and.reduceat(low, cuts), np.bitwise_or.reduceat(high, cuts)
            pattern.append(low)
            mask.append(~(low ^ high))
        #: Bits that a node fixes and the one above it does not: they are added up on the way down.
        own = [m & ~np.repeat(up, FANOUT)[: len(m)] for m, up in zip(mask, mask[1:])] + [mask[-1]]
        self.pattern, self.own = pattern, own
        self._find_uniform()

    def _find_uniform(self) -> None:
        """The class of each node whose members are all in one, else -1."""
        low = high = self.label[self.place]
        self.uniform = [low]
        for _ in self.pattern[1:]:
            cuts = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.uniform.append(np.where(low == high, low, -1))

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while (apart := label[a] != label[b]).any():
            a, b = a[apart], b[apart]
            x, y = label[a], label[b]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while ((up := label[label]) != label).any():
                label[:] = up
        self._find_uniform()

    def _down(self, level: int, query: np.ndarray, node: np.ndarray, total: np.ndarray, front: np.ndarray) -> None:
        """Test pairs of a query and a node; total and front: differences so far, in all and in front."""
        if len(query) > PAIRS:
            for at in range(0, len(query), PAIRS):
                part = slice(at, at + PAIRS)
                self._down(level, query[part], node[part], total[part], front[part])
            return
        apart = self.uniform[level][node] != self.label[query]
        query, node, total, front = query[apart], node[apart], total[apart], front[apart]
        differ = (self.values[query] ^ self.pattern[level][node]) & self.own[level][node]
        total = total + np.bitwise_count(differ)
        front = front + np.bitwise_count(differ & self.front)
        near = (total <= DIFFERENCES) & (front <= 1)
        query, node, total, front = query[near], node[near], total[near], front[near]
        if not len(query):
            return
        if level == 0:
            self._join(query, self.place[node])
            return
        below = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        there = below < len(self.pattern[level - 1])
        wide = [np.repeat(x, FANOUT)[there] for x in (query, total, front)]
        self._down(level - 1, wide[0], below[there], wide[1], wide[2])

    def search(self) -> tuple[np.ndarray, np.ndarray]:
        """Every asked value against all members; the values that found others, and their classes' least."""
        top = len(self.pattern) - 1
        n = len(self.pattern[top])
        step = max(1, PAIRS // max(n, 1))
        for at in range(0, len(self.asked), step):
            query = np.repeat(self.asked[at : at + step], n)
            zeros = np.zeros(len(query), np.uint8)
            self._down(top, query, np.tile(np.arange(n), len(query) // max(n, 1)), zeros, zeros)
        moved = np.flatnonzero(self.label != np.arange(len(self.values)))
        return self.values[moved], self.values[self.label[moved]]


def _rotated(code: Column, by: int) -> Column:
    if by == 0:
        return code
    return F.shiftleft(code, by).bitwiseOR(F.shiftrightunsigned(code, BITS - by))


def _shared_out(sent: DataFrame) -> DataFrame:
    """``sent`` with ``share`` and ``asked``: tiles with more than ``SEARCHES`` rows in several shares.

    Only the large tiles come to the driver, at most one for each ``SEARCHES`` rows there are.
    """
    counts = sent.groupBy("order", "tile").agg(F.count("*").alias("n")).where(F.col("n") > SEARCHES)
    large = [(r.order, r.tile, -(-r.n // SEARCHES)) for r in counts.collect()]
    if not large:
        return sent.withColumns({"share": F.lit(0), "asked": F.lit(True)})
    shares = sent.sparkSession.createDataFrame(large, "order int, tile long, shares int")
    sent = sent.join(F.broadcast(shares), ["order", "tile"], "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    own = F.pmod(F.xxhash64("turned"), F.col("shares")).cast("int")
    every = F.when(F.col("member"), F.sequence(F.lit(0), F.col("shares") - 1)).otherwise(F.array(own))
    return sent.withColumn("own", own).withColumn("share", F.explode(every)).select(
        "order", "tile", "turned", "member", "share", (F.col("share") == F.col("own")).alias("asked")
    )


def links(codes: DataFrame) -> DataFrame:
    """(a, b): enough links between the distinct ``code`` values to tell who is connected."""
    codes = written(codes.select("code").distinct(), "codes")
    bits = min(max((codes.count() // TILE).bit_length(), 4), min(SEGMENTS))
    flips = [0] + [1 << k for k in range(bits)]
    sent = None
    for k, segment in enumerate(SEGMENTS):
        turned = _rotated(F.col("code"), sum(SEGMENTS[:k]))
        tile = F.shiftrightunsigned(turned, BITS - bits)
        # A pair whose tiles differ in one bit meets in the larger tile.
        tiles = F.filter(
            F.transform(F.array(*[F.lit(f).cast("long") for f in flips]), lambda f: F.col("tile").bitwiseXOR(f)),
            lambda t: t >= F.col("tile"),
        )
        part = (
            codes.select(turned.alias("turned"), tile.alias("tile"))
            .select("turned", F.col("tile").alias("home"), F.explode(tiles).alias("tile"))
            .select(F.lit(k).alias("order"), "tile", "turned", (F.col("home") == F.col("tile")).alias("member"))
        )
        sent = part if sent is None else sent.unionAll(part)
    sent = _shared_out(sent)

    def search(table: pa.Table) -> pa.Table:
        order = table["order"][0].as_py()
        turned = table["turned"].to_numpy().astype(np.int64).view(np.uint64)
        member, asked = (table[c].to_numpy(zero_copy_only=False) for c in ("member", "asked"))
        a, b = GrayIndex(turned[member], turned[~member], SEGMENTS[order], turned[asked]).search()
        back = sum(SEGMENTS[:order])
        if back:
            a, b = ((x >> np.uint64(back)) | (x << np.uint64(BITS - back)) for x in (a, b))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    on_workers(codes.sparkSession)
    return sent.groupBy("order", "tile", "share").applyInArrow(search, "a long, b long")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 24))).first())


def components(pairs: DataFrame) -> DataFrame:
    """(u, v): every node of the graph but the least of each component, and that least one.

    Rounds of two steps: each node hands its larger neighbours to its least neighbour, then its
    smaller ones. Only edges move; nothing is gathered by component.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = written(pairs.where("a <> b").select(u, v).distinct(), "edges")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        edges = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        handed = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(handed.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return edges


def _best(rows: DataFrame, best: Column) -> DataFrame:
    """code and the least ``best`` of all rows whose fingerprints are connected with it."""
    each = written(rows.groupBy("code").agg(F.min(best).alias("best")), "code-best")
    roots = components(links(rows))
    nodes = written(
        roots.select(F.col("u").alias("code"), F.col("v").alias("root"))
        .unionAll(roots.select(F.col("v").alias("code"), F.col("v").alias("root")).distinct()),
        "nodes",
    )
    whole = nodes.join(each, "code").groupBy("root").agg(F.min("best").alias("whole"))
    whole = written(whole, "component-best")
    linked = written(nodes.join(whole, "root").select("code", "whole"), "linked")
    return written(
        each.join(linked, "code", "left").select("code", F.coalesce("whole", "best").alias("best")), "best"
    )


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Documents are linked when their fingerprints differ in at most four bits; component_id is the
    least id that links reach. Texts without words (null, empty) have fingerprint zero and are
    linked like others; texts of fewer than four words are one shingle. Null ids do not count for
    component_id, which is null only where all are. An empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    rows = written(with_fingerprints(rows, into="code").drop("text"), "fingerprints")
    best = _best(rows, F.col("id"))
    return rows.join(best, "code").select(
        F.col("id").alias(id_column),
        F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"),
        F.col("best").alias("component_id"),
    )


def near_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with the least id of their component, one for each (null ids last)."""
    code, row = fresh(docs, "code"), fresh(docs, "row")
    rows = with_fingerprints(docs, text_column, into=code).withColumn(row, F.monotonically_increasing_id())
    rows = written(rows, "fingerprinted")
    key = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    best = _best(rows.select(F.col(code).alias("code"), F.col(row).alias("row"), F.col(f"`{id_column}`").alias("id")), key)
    kept = best.select(F.col("best.row").alias(row)).distinct()
    return rows.join(kept, row, "left_semi").drop(code, row)
