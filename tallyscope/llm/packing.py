"""Best-fit decreasing packing of tokenised documents.

Pieces of equal length are interchangeable, and so are open sequences with equal room. Best-fit
decreasing is therefore worked out on the counts of lengths (as many rows as a sequence has
tokens), with a segment tree over the rooms that finds the tightest open one; the pieces then look
their places up by their rank among those of their length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tallyscope.llm.bpe import load_ranks
from tallyscope.llm.tables import map_batches, written


class RoomTree:
    """Segment tree: which rooms 0..capacity have open sequences, and the smallest that is enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, room: int, is_open: bool) -> None:
        at = room + self.leaves
        self.any[at] = is_open
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """Climb until a right neighbour has an open room, then go down on its left side."""
        at = length + self.leaves
        if self.any[at]:
            return length
        while at > 1 and (at % 2 or not self.any[at + 1]):
            at //= 2
        if at <= 1:
            return None
        at += 1
        while at < self.leaves:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.leaves


@dataclass(frozen=True)
class Run:
    """``count`` pieces of one length from rank ``first`` on go, ``each`` to a sequence, to the
    sequences from ``sequence`` on, behind the ``offset`` tokens they hold."""

    length: int
    first: int
    count: int
    each: int
    sequence: int
    offset: int


def best_fit_plan(counts: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Best-fit decreasing for ``counts`` of lengths; the runs and the number of sequences.

    The same as placing the pieces one by one: after a piece is put into the tightest sequence,
    that sequence is the tightest still if another piece of the length fits.
    """
    tree, runs, opened = RoomTree(capacity), [], 0
    rooms: dict[int, list[tuple[int, int]]] = {}

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            rooms.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit")
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                first, n, room = opened, -(-left // each), capacity
                opened += n
            else:
                first, n = rooms[room].pop()
                if not rooms[room]:
                    tree.set(room, False)
                each = room // length
            full = min(n, left // each)
            if full:
                runs.append(Run(length, rank, full * each, each, first, capacity - room))
                leave(room - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and left:  # fewer pieces than one more sequence could take
                runs.append(Run(length, rank, left, left, first, capacity - room))
                leave(room - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            leave(room, first, n)
    return runs, opened


#: Texts with these go through the tokenizer file itself: controls, spaces and marks that
#: libraries may class differently, and all beyond the basic plane.
_RARE = re.compile("[\\0-\x08\x0e-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]|[^\\0-\uffff]")
_tokenizers: dict[int, Callable[[str], list[int]]] = {}


def _tokenizer(json_text: str, ranks: dict[bytes, int], pattern: str) -> Callable[[str], list[int]]:
    """A byte-level BPE; ordinary texts by the rank file of the same vocabulary, which is ten times
    as fast and gives the same ids. One in each Python worker."""
    key = zlib.crc32(json_text.encode())
    if key not in _tokenizers:
        full = Tokenizer.from_str(json_text)
        # Texts that spell a special token of the file get its id, as the tokenizer gives it.
        special = [token.content for token in full.get_added_tokens_decoder().values()]
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> list[int]:
            if _RARE.search(text) or any(s in text for s in special):
                return full.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _tokenizers.clear()
        _tokenizers[key] = encode
    return _tokenizers[key]


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str,
    pattern: str,
    capacity: int = 1024,
    end_id: int = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Tokenise and cut: id, piece, start, length, ids_crc32, part, place (and ids).

    A document's ids end with ``end_id``; one that is longer than ``capacity`` is cut so that all
    pieces but the first are full. ``place`` is the rank of a piece among those of its length in
    its task, ``part``. Null is an empty text, of one id.
    """
    context = docs.sparkSession.sparkContext
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = context.broadcast((f.read(), load_ranks(ranks_path), pattern))
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    fields = [("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("part", "int"), ("place", "long")]
    fields += [("ids", "binary")] if keep_ids else []
    schema = T.StructType([rows.schema["id"], *(T.StructField(n, T._parse_datatype_string(t)) for n, t in fields)])
    arrow = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = _tokenizer(*shared.value), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            of: list[int] = []
            columns: list[list] = [[] for _ in fields]
            for row, text in enumerate(batch.column(1)):
                ids = np.array(encode(text.as_py() or ""), "<u4").tobytes() + end
                total = len(ids) // 4
                starts = [0, *range(total % capacity or capacity, total, capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], total])):
                    own = ids[4 * a : 4 * b]
                    of.append(row)
                    for column, value in zip(columns, (k, a, b - a, zlib.crc32(own), part, seen[b - a], own)):
                        column.append(value)
                    seen[b - a] += 1
            out = [batch.column(0).take(pa.array(of, pa.int32()))]
            out += [pa.array(c, arrow[t]) for c, (_, t) in zip(columns, fields)]
            yield pa.RecordBatch.from_arrays(out, names=["id", *(n for n, _ in fields)])

    return map_batches(rows, cut, schema).withColumnRenamed("id", id_column)


def pack(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` with sequence_id and offset, packed by best-fit decreasing over the whole table.

    Sequences are gapless from 0, and each holds its pieces side by side from offset 0. Pieces of a
    length are ranked by task and place in it. Only the counts of lengths reach the driver, at most
    ``capacity`` rows; the plan sent back is bounded by them too. An empty table stays empty.
    """
    cut = written(cut, "pieces")
    spark = cut.sparkSession
    per_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = best_fit_plan(counts, capacity)
    runs.sort(key=lambda r: (r.length, r.first))
    plan = spark.sparkContext.broadcast(
        np.array([(r.length, r.first, r.each, r.sequence, r.offset) for r in runs], np.int64).reshape(-1, 5)
    )
    ranked = cut.join(starts, ["part", "length"]).withColumn("rank", F.col("before") + F.col("place"))
    ranked = ranked.drop("part", "place", "before").select(*[c for c in cut.columns if c not in ("part", "place")], "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, firsts, each, sequence, offset = plan.value.T
        keys = (lengths << 48) + firsts
        for batch in batches:
            length = batch["length"].to_numpy(zero_copy_only=False)
            rank = batch["rank"].to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            within = rank - firsts[at]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(sequence[at] + within // each[at]),
                    pa.array(offset[at] + within % each[at] * length),
                ],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    added = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return map_batches(ranked, place, T.StructType([*ranked.schema.fields[:-1], *added]))
