"""Ranked lexical search by a dual tree.

A hierarchy over the items of a block and one over the documents of a batch hold the greatest weight
and the greatest impact of each term below a node. The product of two nodes' maxima bounds every
score between them; where it is below the weakest kth score of the node's items, the pair of nodes,
with all items and documents below, is left out. What is left goes down both trees and is scored
exactly. All numbers are integers under 2**53, so sums of doubles are exact.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyscope.llm.tables import map_batches, written

#: Fixed value: a term is a run of ASCII letters, digits and bytes of other characters.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Bytes of a text whose terms are listed at once (up to the next break); bounds memory.
STRETCH = 1 << 20
#: Terms of all items of a block; a block's items go to every task, and documents are read once a block.
BLOCK_TERMS = 1 << 14
#: Documents of one tree, of one leaf, and children of a node.
BATCH, LEAF, FANOUT = 4096, 16, 8
#: Leaves that are scored before the kth score is looked at again.
STEP = 32
#: One in so many documents is searched first. The kth scores found there bound the final ones from
#: below, so that tasks need not return what cannot be among the first; every document is searched.
SEED_SHARE = 64


def counted(text: str | None) -> tuple[int, Counter]:
    """Number of terms, and how often each occurs; only A-Z is lower-cased."""
    data, counts, total, at = (text or "").encode(), Counter(), 0, 0
    while at < len(data):
        stop = BREAK.search(data, at + STRETCH)
        end = stop.start() if stop else len(data)
        found = TERM.findall(data[at:end].lower())
        total += len(found)
        counts.update(found)
        at = end
    return total, counts


def _levels(lows: list[np.ndarray], weights: list[np.ndarray]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Nodes of the item tree from the items up: (terms, greatest weights)."""
    levels = [list(zip(lows, weights))]
    while len(levels[-1]) > 1:
        below, above = levels[-1], []
        for at in range(0, len(below), FANOUT):
            terms, place = np.unique(np.concatenate([t for t, _ in below[at : at + FANOUT]]), return_inverse=True)
            most = np.zeros(len(terms))
            np.maximum.at(most, place, np.concatenate([w for _, w in below[at : at + FANOUT]]))
            above.append((terms, most))
        levels.append(above)
    return levels


class Documents:
    """Hierarchy over a batch of documents in sparse rows (``terms``, ``impacts``, cut at ``starts``)."""

    def __init__(self, terms: np.ndarray, impacts: np.ndarray, starts: np.ndarray, n_terms: int):
        n = len(starts) - 1
        sizes = np.diff(starts)
        # Documents with the same rare terms stand together (terms are numbered by rarity).
        rows = np.repeat(np.arange(n), sizes)
        inside = np.lexsort((terms, rows))
        terms, impacts = terms[inside], impacts[inside]
        first = np.where(sizes > 0, terms[np.minimum(starts[:-1], len(terms) - 1)], n_terms)
        second = np.where(sizes > 1, terms[np.minimum(starts[:-1] + 1, len(terms) - 1)], n_terms)
        self.order = np.lexsort((second, first))
        sizes = sizes[self.order]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(starts[:-1][self.order] - self.starts[:-1], sizes) + np.arange(len(terms))
        self.terms, self.impacts = terms[take], impacts[take]
        leaf = np.repeat(np.arange(n) // LEAF, sizes)
        most = np.zeros((-(-n // LEAF), n_terms))
        np.maximum.at(most, (leaf, self.terms), self.impacts)
        self.levels = [most]
        while len(self.levels[-1]) > 1:
            cuts = np.arange(0, len(self.levels[-1]), FANOUT)
            self.levels.append(np.maximum.reduceat(self.levels[-1], cuts, axis=0))

    def scores(self, leaves: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents (as given) of some leaves and their scores; ``weight``: one for each term."""
        n = len(self.starts) - 1
        docs = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        docs = docs[docs < n]
        sizes = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(sizes)
        entries = np.repeat(self.starts[docs] - (ends - sizes), sizes) + np.arange(ends[-1])
        worth = weight[self.terms[entries]] * self.impacts[entries]
        return self.order[docs], np.bincount(np.repeat(np.arange(len(docs)), sizes), worth, len(docs))


class Search:
    """The best documents of each item so far. ``items``: terms (numbered by rarity) and their weights."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], n_terms: int, k: int, seeds: np.ndarray):
        self.k, self.n_terms = k, n_terms
        # Items with the same rare terms stand together.
        self.order = sorted(range(len(items)), key=lambda i: sorted(items[i][0])[:2])
        self.levels = _levels([items[i][0] for i in self.order], [items[i][1].astype(float) for i in self.order])
        self.limit = np.asarray(seeds, float)[self.order]
        self.best = [(np.zeros(0), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in items]
        #: Pairs of an item and a document that were scored.
        self.scored = 0

    def _alive(self, tree: Documents) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each item the leaves that may hold one of its best documents, and the bounds of these."""
        limits = [self.limit]
        for _ in self.levels[1:]:
            limits.append(np.minimum.reduceat(limits[-1], np.arange(0, len(limits[-1]), FANOUT)))
        up, high = len(self.levels) - 1, len(tree.levels) - 1
        pairs = {i: np.arange(len(tree.levels[high])) for i in range(len(self.levels[up]))}
        while True:
            alive = {}
            for i, nodes in pairs.items():
                terms, weights = self.levels[up][i]
                bound = tree.levels[high][nodes[:, None], terms] @ weights
                fine = (bound >= limits[up][i]) & (bound > 0)
                if fine.any():
                    alive[i] = nodes[fine], bound[fine]
            if up == 0 and high == 0:
                return alive
            if high > 0:
                high -= 1
                for i, (nodes, _) in alive.items():
                    below = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    alive[i] = below[below < len(tree.levels[high])], None
            if up > 0:
                up -= 1
                alive = {
                    child: found
                    for i, found in alive.items()
                    for child in range(i * FANOUT, min((i + 1) * FANOUT, len(self.levels[up])))
                }
            pairs = {i: nodes for i, (nodes, _) in alive.items()}

    def add(self, tree: Documents, ids: np.ndarray, unknown: np.ndarray) -> None:
        """Search a batch; ``unknown``: ids that are null."""
        weight = np.zeros(self.n_terms)
        for i, (leaves, bounds) in self._alive(tree).items():
            terms, weights = self.levels[0][i]
            weight[terms] = weights
            first = np.argsort(-bounds, kind="stable")
            for at in range(0, len(first), STEP):
                part = first[at : at + STEP]
                part = part[bounds[part] >= self.limit[i]]
                if not len(part):
                    break
                docs, scores = tree.scores(leaves[part], weight)
                self.scored += len(docs)
                good = (scores >= self.limit[i]) & (scores > 0)
                if good.any():
                    docs = docs[good]
                    self._merge(i, scores[good], unknown[docs], ids[docs])
            weight[terms] = 0

    def _merge(self, i: int, *new: np.ndarray) -> None:
        score, unknown, ids = (np.concatenate(pair) for pair in zip(self.best[i], new))
        first = np.lexsort((ids, unknown, -score))[: self.k]
        self.best[i] = score[first], unknown[first], ids[first]
        if len(first) == self.k:
            self.limit[i] = max(self.limit[i], score[first[-1]])

    def found(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(item as given, scores, null ids, ids)"""
        for i, best in zip(self.order, self.best):
            yield i, *best


def impacts(count: np.ndarray, terms: np.ndarray, n: int, total: int) -> np.ndarray:
    """What one unit of weight is worth in a document of ``terms`` terms that holds a term ``count`` times."""
    m = 100 - 50 + (50 * terms.astype(np.int64) * n) // total
    return (1_000_000_000 * count.astype(np.int64)) // (1000 * count.astype(np.int64) + 20 * m)


def _tokenised(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, counts): documents with a term, and those of their terms that items hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, totals, terms, numbers = [], [], [], []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                total, counts = counted(text.as_py())
                if total:
                    known = [(vocabulary[t], c) for t, c in counts.items() if t in vocabulary]
                    ids.append(own)
                    totals.append(total)
                    terms.append([t for t, _ in known])
                    numbers.append([c for _, c in known])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(totals, pa.int64()),
                 pa.array(terms, pa.list_(pa.int32())), pa.array(numbers, pa.list_(pa.int64()))],
                names=["id", "n", "terms", "counts"],
            )

    return map_batches(docs, count, "id long, n long, terms array<int>, counts array<long>")


def _searched(docs: DataFrame, items: list, n_terms: int, rank: np.ndarray, n: int, total: int, k: int, seeds: dict) -> DataFrame:
    """(item, score, id): at most k documents of each item from every task."""
    start = np.array([seeds.get(number, 0) for number, _, _ in items], float)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Search([(terms, weights) for _, terms, weights in items], n_terms, k, start)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                lists = batch.column(2)
                cuts = lists.offsets.to_numpy().astype(np.int64)
                own = rank[lists.flatten().to_numpy()]
                counts = batch.column(3).flatten().to_numpy()
                sizes = np.diff(cuts)
                worth = impacts(counts, np.repeat(batch.column(1).to_numpy(), sizes), n, total)
                ids = batch.column(0)
                unknown = ids.is_null().to_numpy(zero_copy_only=False)
                tree = Documents(own, worth.astype(float), cuts - cuts[0], n_terms)
                best.add(tree, ids.fill_null(0).to_numpy(), unknown)
        for item, score, unknown, ids in best.found():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), items[item][0])), pa.array(score.astype(np.int64)), pa.array(ids, mask=unknown)],
                names=["item", "score", "id"],
            )

    return map_batches(docs, search, "item long, score long, id long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item, with their rank."""
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_items(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """item, ``rank`` (from 1), id, ``score``: the k best documents with a score above 0 of every item.

    A term's weight is floor(1000 ln((2N + 2) / (2df + 1))) for N documents with a term; a document's
    share of it grows with the term's count and falls with the document's length (``impacts``). An
    item's terms count once each. Equal scores go by id (null ids last); rows of documents that are
    alike each have a rank, items that are alike each have a list. Null and empty texts have no terms;
    an item without terms or matches has no row, and so have empty tables. Ids are integers. Items are
    taken in blocks of ``BLOCK_TERMS`` terms; other columns are not read.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [sorted(counted(text.as_py())[1]) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lists, pa.list_(pa.binary()))], names=["item", "terms"]
            )

    asked = written(
        items.select(
            F.monotonically_increasing_id().alias("item"), F.col(f"`{item_column}`").alias("own"), F.col(f"`{item_text_column}`").alias("text")
        ),
        "items",
    )
    terms = written(map_batches(asked.select("item", "text"), terms_of, "item long, terms array<binary>"), "item-terms")
    blocks = -(-(terms.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS)
    found = None
    for block in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).where(F.size("terms") > 0)
        own = [(r.item, [bytes(t) for t in r.terms]) for r in own.collect()]
        if not own:
            continue
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, each in own for t in each}))}
        counts = written(_tokenised(plain, vocabulary), "term-counts")
        n, total = counts.agg(F.count("*"), F.sum("n")).first()
        if not n:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[r.t] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        rank = np.argsort(np.argsort(df, kind="stable"), kind="stable")
        known = [(item, np.array([vocabulary[t] for t in each])) for item, each in own]
        known = [(item, rank[t], weight[t]) for item, t in known]
        args = (known, len(vocabulary), rank, n, total, k)
        used = counts.where(F.size("terms") > 0).select("id", "n", "terms", "counts")
        some = used.where(F.pmod(F.xxhash64("id", "n"), F.lit(SEED_SHARE)) == 0)
        seeds = _ranked(_searched(some, *args, {}), k).where(F.col("rank") == k).select("item", "score")
        part = written(_searched(used, *args, {r.item: r.score for r in seeds.collect()}), "found")
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], "item long, score long, id long")
    return _ranked(found, k).join(asked.select("item", "own"), "item").select(
        F.col("own").alias(item_column), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_column), "score"
    )
