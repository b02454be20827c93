"""Merkle manifest of a dataset: one tree per source, and one over the roots of the sources.

A parent keeps a copy of its hash state before each child slot. Folding a changed child takes up the
state of its slot and reads the replacement and what stands right of it, nothing left of it. A task
holds the parents of one chunk (2187 neighbours of a tree, and the nodes above them) and those on
the way from there to the root, so trees of any size are built, and proofs folded, chunk by chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.sharding import numbered
from tallyscope.llm.tables import map_batches, written

#: Children of a parent.
RUN = 3
#: Levels of a tree that one task builds over a chunk of its nodes (3**7 = 2187 of them).
LEVELS = 7
#: Hex digits of a digest.
WIDTH = 64
#: Bytes of source names (their places beside them) that are broadcast; more are joined with salt.
BROADCAST_BYTES = 16 << 20
#: Rows of one Arrow batch that a task returns.
ROWS = 2048


class Parent:
    """A node over a run of digests that can be folded again for any one of them."""

    __slots__ = ("children", "digest", "states")

    def __init__(self, children: Sequence[bytes]):
        state = hashlib.sha256()
        self.children, self.states = children, []
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, replacement: bytes) -> bytes:
        """The digest with another child in ``slot``."""
        state = self.states[slot].copy()
        state.update(replacement)
        for right in self.children[slot + 1 :]:
            state.update(right)
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> bytes:
        return b"".join([*self.children[:slot], *self.children[slot + 1 :]])

    def step(self, slot: int) -> str:
        """This level of a proof as text: the slot, then the digests of the run."""
        return f"{slot}{b''.join(self.children).decode()}"


def read_step(step: str) -> tuple[Parent, int]:
    run = step[1:].encode()
    return Parent([run[i : i + WIDTH] for i in range(0, len(run), WIDTH)]), int(step[0])


def fold(leaf: str, proof: Sequence[str]) -> str:
    """The root that follows from a leaf and its proof."""
    node = leaf.encode()
    for parent, slot in map(read_step, proof):
        node = parent.fold(slot, node)
    return node.decode()


def parents_above(nodes: Sequence[bytes], chunk: int, height: int) -> list[list[Parent]]:
    """The ``height`` levels above a chunk; up to one node if it is a whole tree."""
    levels: list[list[Parent]] = []
    whole = chunk == 0 and len(nodes) < RUN**height
    while len(nodes) > 1 if whole else len(levels) < height:
        levels.append([Parent(nodes[i : i + RUN]) for i in range(0, len(nodes), RUN)])
        nodes = [p.digest for p in levels[-1]]
    return levels


def leaf_of(columns: Sequence[Column]) -> Column:
    """SHA-256 (hex) of the values, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(
        F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256
    )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of each (tree, chunk); they come sorted by it and by ``at``."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for key, members in groupby(rows, lambda r: r[:2]):
        yield key, list(members)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema
        )

    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield batch()
            held = []
    if held:
        yield batch()


def _dealt(nodes: DataFrame) -> DataFrame:
    """The rows of a chunk (and its path) in one task, in order."""
    return nodes.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "at")


def _up(nodes: DataFrame, height: int) -> DataFrame:
    """(tree, at, digest): one node for each chunk of ``nodes``."""
    schema = pa.schema([("tree", pa.string()), ("at", pa.int64()), ("digest", pa.string())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (tree, chunk), members in _chunks(batches):
                digests = [m[3].encode() for m in members]
                levels = parents_above(digests, chunk, height)
                yield tree, chunk, (levels[-1][0].digest if levels else digests[0]).decode()

        return _batches(rows(), schema)

    placed = nodes.select("tree", F.expr(f"at DIV {RUN**height}").alias("chunk"), "at", "digest")
    return map_batches(_dealt(placed), build, "tree string, at long, digest string")


def _built(leaves: DataFrame, height: int) -> list[DataFrame]:
    """Every round of nodes, the leaves first; the last has one node for each tree."""
    rounds = [leaves]
    while (rounds[-1].agg(F.max("at")).first()[0] or 0) > 0:
        rounds.append(written(_up(rounds[-1], height), "merkle-nodes"))
    return rounds


def _with_paths(nodes: DataFrame, above: DataFrame, height: int, extra: Sequence[str] = ()) -> DataFrame:
    """``nodes`` (tree, at, digest, ``extra``) beside the path of their chunk, which comes first."""
    placed = nodes.select(
        "tree", F.expr(f"at DIV {RUN**height}").alias("chunk"), "at", "digest",
        F.lit(None).cast("array<string>").alias("path"), *extra,
        F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"),
    )
    paths = above.select(
        "tree", F.col("at").alias("chunk"), F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("digest"),
        "path", *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in extra], "subroot", "root",
    )
    return _dealt(placed.unionByName(paths))


def _ways(levels: list[list[Parent]], index: int) -> Iterator[tuple[Parent, int]]:
    for parents in levels:
        index, slot = divmod(index, RUN)
        yield parents[index], slot


def _down(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """(tree, at, path, subroot, root): for each node the steps from it to the root."""
    schema = pa.schema(
        [("tree", pa.string()), ("at", pa.int64()), ("path", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())]
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (tree, chunk), (top, *members) in _chunks(batches):
                levels = parents_above([m[3].encode() for m in members], chunk, height)
                for index, member in enumerate(members):
                    own = [parent.step(slot) for parent, slot in _ways(levels, index)]
                    yield tree, member[2], own + top[4], top[-2], top[-1]

        return _batches(rows(), schema)

    return map_batches(
        _with_paths(nodes, above, height), walk, "tree string, at long, path array<string>, subroot string, root string"
    )


def _folded(leaves: DataFrame, above: DataFrame, height: int, proofs: bool) -> DataFrame:
    """Every leaf with its roots, its proof, and the root that its ``claimed`` leaf folds to."""
    id_type = leaves.schema["id"].dataType
    wanted = f"id {id_type.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    wanted += ", proof array<string>" if proofs else ""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema(
            [("id", first.schema.field("id").type), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
             ("proof_sha256", pa.string()), ("folded_root", pa.string())] + ([("proof", pa.list_(pa.string()))] if proofs else [])
        )

        def every() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        def rows() -> Iterator[tuple]:
            for (_, chunk), (top, *members) in _chunks(every()):
                levels = parents_above([m[3].encode() for m in members], chunk, height)
                above_chunk = [read_step(step) for step in top[4]]
                rest = b"".join(parent.siblings(slot) for parent, slot in above_chunk)
                for index, (_, _, _, leaf, _, own_id, claimed, _, _) in enumerate(members):
                    siblings, node = hashlib.sha256(), claimed.encode()
                    for parent, slot in _ways(levels, index):
                        siblings.update(parent.siblings(slot))
                        node = parent.fold(slot, node)
                    siblings.update(rest)
                    for parent, slot in above_chunk:
                        node = parent.fold(slot, node)
                    out = (own_id, leaf, top[-2], top[-1], siblings.hexdigest(), node.decode())
                    if proofs:
                        out += ([parent.step(slot) for parent, slot in _ways(levels, index)] + top[4],)
                    yield out

        yield from _batches(rows(), schema)

    return map_batches(_with_paths(leaves, above, height, ("id", "claimed")), walk, wanted)


def _beside(rows: DataFrame, trees: DataFrame) -> DataFrame:
    """``rows`` joined with one row per tree; a tree may hold most rows."""
    size = trees.agg(F.sum(F.octet_length("tree") + 16)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(trees), "tree")
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = trees.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod("row_number", F.lit(salts)).cast("int")).join(dealt, ["tree", "salt"]).drop("salt")


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_column: str = "doc_id",
    source_column: str = "source",
    claimed: dict[str, Column] | None = None,
    proofs: bool = False,
    height: int = LEVELS,
) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves hash the ``fields``. Per source they stand by id (nulls first; rows alike in it by leaf),
    every three neighbours have a parent, up to the source's ``subroot``; these stand by source (null
    first, then bytewise) under ``root`` in the same way. A single leaf or subroot is its own root.
    ``proof_sha256`` hashes the siblings on the way to the root. ``claimed`` has other values for
    some fields: ``folded_root`` is what the leaf of these values folds to with the siblings as they
    are, and ``verified`` says that it is the root. With ``proofs`` the column ``proof`` holds the
    steps, which ``fold`` takes. ``height``: levels that one task builds. Null fields count as ``-``, an empty table gives an empty result,
    other columns are not read. Texts do not leave the task that reads them.
    """
    claimed = claimed or {}
    here = [F.col(f"`{c}`") for c in fields]
    there = [claimed.get(c, F.col(f"`{c}`")) for c in fields]
    source = F.col(f"`{source_column}`").cast("string")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("tree"),
        F.col(f"`{id_column}`").alias("id"),
        leaf_of(here).alias("digest"),
        leaf_of(there).alias("claimed"),
    )
    rows, _ = numbered(written(leaves, "merkle-leaves"), "tree", "id", "digest")
    starts = written(rows.groupBy("tree").agg(F.min("row_number").alias("start")), "merkle-starts")
    rows = _beside(rows, starts).withColumn("at", F.col("row_number") - F.col("start")).drop("row_number", "start")
    rounds = _built(written(rows, "merkle-leaves"), height)
    sources, _ = numbered(rounds[-1].select("tree", "digest"), "tree")
    sources = written(sources.select("tree", "digest", F.col("row_number").alias("at")), "merkle-sources")
    tops = _built(sources.select(F.lit("").alias("tree"), "at", "digest"), height)
    paths = tops[-1].select(
        "tree", "at", F.array().cast("array<string>").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root")
    )
    for nodes in reversed(tops[:-1]):
        paths = _down(nodes, paths, height)
    paths = written(paths, "merkle-source-paths")
    # Each source's path goes on from its subroot.
    paths = paths.select("at", "path", "root").join(sources, "at").select(
        "tree", F.lit(0).cast("long").alias("at"), "path", F.col("digest").alias("subroot"), "root"
    )
    for nodes in reversed(rounds[1:-1]):
        paths = written(_down(nodes, paths, height), "merkle-paths")
    out = _folded(rounds[0], paths, height, proofs)
    return out.withColumnRenamed("id", id_column).withColumn("verified", F.col("folded_root") == F.col("root"))
