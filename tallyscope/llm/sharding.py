"""Sharding by a Feistel permutation of global row numbers, with cycle walking."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.tables import map_batches, written

#: Rounds of the network; four already make it a pseudo-random permutation.
ROUNDS = 6
#: Bytes a document takes beside its text.
OVERHEAD = 16


class Permutation:
    """A bijection of 0 .. size-1 that a seed names; ``forward`` and ``inverse`` take uint64 arrays."""

    def __init__(self, size: int, seed: int = 0):
        self.size = size
        self.half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        digest = hashlib.sha512(f"{seed}".encode()).digest()
        self.keys = np.frombuffer(digest, "<u8")[:ROUNDS]

    def _mixed(self, half: np.ndarray, key: np.uint64) -> np.ndarray:
        x = half ^ key
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & self.mask

    def _network(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in keys:
            left, right = right, left ^ self._mixed(right, key)
        return (right << np.uint64(self.half)) | left

    def _walked(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = self._network(np.asarray(x, np.uint64), keys)
        while (outside := np.flatnonzero(out >= self.size)).size:
            out[outside] = self._network(out[outside], keys)
        return out

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walked(x, self.keys)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._walked(x, self.keys[::-1])


def row_at(size: int, shards: int, shard: int, slot: int, seed: int = 0) -> int:
    """The global row number that stands at a slot of a shard, without reading any data."""
    return int(Permutation(size, seed).inverse(np.array([slot * shards + shard], np.uint64))[0])


def numbered(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``rows`` with a gapless ``row_number`` by ``order``, and their number; rows alike in it come in any order.

    Rows are range-partitioned and sorted; only the number of rows of each partition goes to the
    driver. The position in the input is the last key, so that equal rows do not pile up in a task.
    """
    spark = rows.sparkSession
    placed = (
        rows.withColumn("input_position", F.monotonically_increasing_id())
        .orderBy(*order, "input_position")
        .withColumn("place", F.monotonically_increasing_id())
        .drop("input_position")
    )
    placed = written(placed, "numbered")
    part = F.shiftright("place", 33)
    counts = sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for r in counts:
        starts.append((r.part, total))
        total += r.n
    offsets = spark.createDataFrame(starts, "part long, start long")
    return (
        placed.withColumn("part", part)
        .join(F.broadcast(offsets), "part")
        .withColumn("row_number", F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("part", "start", "place")
    ), total


def shard_rows(
    docs: DataFrame,
    shards: int,
    seed: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, row_number, position, shard, slot.

    Rows are numbered by id (nulls first), then checksum and size of the text; a keyed Feistel
    permutation of these numbers is the shuffled position, dealt round robin to ``shards``. So the
    counts of shards differ by one at most, every slot is computable (``row_at``), and the same
    table gives the same shards however its files are cut. Null text: size 16, checksum 0. Rows
    alike in id and text take their places in any order. An empty table gives an empty result.
    Texts do not leave the task that reads them.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    narrow = docs.select(
        F.col(f"`{id_column}`").alias("id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows, total = numbered(narrow, "id", "text_crc32", "size")
    permutation = Permutation(total, seed)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = permutation.forward(batch["row_number"].to_numpy(zero_copy_only=False).astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place.astype(np.int64))], names=[*batch.schema.names, "position"]
            )

    schema = T.StructType([*rows.schema.fields, T.StructField("position", T.LongType())])
    return map_batches(rows, positions, schema).select(
        F.col("id").alias(id_column), "size", "text_crc32", "row_number", "position",
        F.pmod("position", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"position DIV {int(shards)}").alias("slot"),
    )
