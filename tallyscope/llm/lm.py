"""Scoring by context-tree weighting over bytes, beside a smoothed word model.

A byte is eight binary decisions. Each decision has Krichevsky-Trofimov estimates in the contexts
of none to ``DEPTH`` bytes before it, and the weights that the training texts give to the depths mix
them, as in context-tree weighting. Every context is in the tree, however rare.

The tree lives in Spark as its grams: a context of ``DEPTH`` bytes and the byte after it, with their
counts. Grams that share the last two bytes of their context stand in one partition, so each task
has whole subtrees: it sums their evidence from the deepest context up, of which only that of the
256 contexts of one byte goes to the driver, and then takes the mixed probabilities down to every
gram. Grams and words that make up at least a given fraction of all (so at most a given number)
are sent to the tasks that score; all others are counted for each text and meet their values in a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.tables import map_batches, written

#: Bytes of the longest contexts; those and the byte after them must fit into a long integer.
DEPTH = 4
#: Words with at least this fraction (one in ...) of all tokens are looked up in the tasks.
SHARE = 1_000_000
#: Grams with at least this fraction (one in ...) of all positions are looked up in the tasks.
GRAM_SHARE = 1 << 21
#: Bytes of text that a task counts at once; bounds memory.
BLOCK = 1_000_000
#: Grams that a task computes at once, if they end at a context of two bytes.
CHUNK = 1 << 16
#: Contexts whose decisions are computed at once.
ROWS = 2048
#: Marks the end of a text; no byte of UTF-8. Before a text stand as many zero bytes as the tree is deep.
END = b"\xff"
START = b"\0" * DEPTH


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series for x + 8, stepped back to x."""
    product = np.ones_like(x)
    for i in range(8):
        product = product * (x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def _bits(counts: np.ndarray) -> list[np.ndarray]:
    """Zeros and ones of each decision, for the eight levels: arrays (contexts, 2**level, 2)."""
    return [counts.reshape(len(counts), 1 << k, 2, -1).sum(-1) for k in range(8)]


def _evidence(bits: np.ndarray) -> np.ndarray:
    """Log probability of a decision's history under the Krichevsky-Trofimov estimator."""
    result = np.zeros(bits.shape[:-1])
    some = bits.sum(-1) > 0
    zeros, ones = bits[..., 0][some], bits[..., 1][some]
    result[some] = _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - np.log(np.pi)
    return result


def _next(bits: np.ndarray) -> np.ndarray:
    return (bits[..., 1] + 0.5) / (bits.sum(-1) + 1)


def _by_byte(ones: list[np.ndarray]) -> np.ndarray:
    """log10 probabilities of the 256 bytes from those of a one at each decision."""
    total = np.zeros((len(ones[0]), 1))
    for p in ones:
        total = np.stack([total + np.log10(1 - p), total + np.log10(p)], -1).reshape(len(p), -1)
    return total


class _Depth:
    """Contexts of one depth with the counts of the bytes after them."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int, shorter: _Depth | None):
        """``codes``: grams, the predicted byte lowest and the oldest highest."""
        contexts = codes >> 8 & ((1 << 8 * depth) - 1)
        self.contexts, self.row = np.unique(contexts, return_inverse=True)
        # The shorter context is the code without its highest byte; those of one byte are all there.
        above = self.contexts & ((1 << 8 * (depth - 1)) - 1)
        self.parent = above if shorter is None else np.searchsorted(shorter.contexts, above)
        self.parents = 256 if shorter is None else len(shorter.contexts)
        self.byte, self.count = codes & 255, counts
        self.order = np.argsort(self.row, kind="stable")
        self.starts = np.searchsorted(self.row[self.order], np.arange(len(self.contexts) + 1))

    def __len__(self) -> int:
        return len(self.contexts)

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Rows a..b, which grams are theirs, and their counts of the 256 bytes."""
        for a in range(0, len(self), ROWS):
            b = min(a + ROWS, len(self))
            part = self.order[self.starts[a] : self.starts[b]]
            dense = np.zeros((b - a, 256))
            np.add.at(dense, (self.row[part] - a, self.byte[part]), self.count[part])
            yield a, b, part, dense


def _levels(rows: int) -> list[np.ndarray]:
    return [np.zeros((rows, 1 << k)) for k in range(8)]


def _depths(codes: np.ndarray, counts: np.ndarray) -> list[_Depth]:
    """Depths 2, 3, ... of the subtrees that these grams make up."""
    depths: list[_Depth] = []
    for depth in range(2, DEPTH + 1):
        depths.append(_Depth(codes, counts, depth, depths[-1] if depths else None))
    return depths


def _weigh(depths: list[_Depth]) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
    """From the deepest contexts up: the sums of their log weighted probabilities for each context of
    one byte, and for each depth the weights of stopping there (none for the deepest)."""
    below, stops = None, []
    for depth in reversed(depths):
        up, stop = _levels(depth.parents), _levels(len(depth) if below else 0)
        for a, b, _, dense in depth.blocks():
            for k, bits in enumerate(_bits(dense)):
                weighted = own = _evidence(bits)
                if below:
                    stop[k][a:b] = _stop(own, below[k][a:b])
                    weighted = np.logaddexp(own, below[k][a:b]) - np.log(2)
                np.add.at(up[k], depth.parent[a:b], weighted)
        below = up
        stops.insert(0, stop)
    return below, stops


@dataclass
class _Down:
    """What comes down to the contexts of one depth: p = before + through * (what the next depth
    says), and the estimate of the deepest context on the way that has occurred."""

    before: list[np.ndarray]
    through: list[np.ndarray]
    here: list[np.ndarray]


def _from_root(counts: np.ndarray, split: list[np.ndarray]) -> _Down:
    """Depths 0 and 1: ``counts`` of bytes after each byte, ``split`` as ``_weigh`` sums it."""
    one, root, seen = _bits(counts), _bits(counts.sum(0, keepdims=True)), counts.sum(1, keepdims=True) > 0
    down = _Down([], [], [])
    for k in range(8):
        own = _evidence(one[k])
        parts = (np.logaddexp(own, split[k]) - np.log(2)).sum(0, keepdims=True)
        stop_root, stop_one = _stop(_evidence(root[k]), parts), _stop(own, split[k])
        here = np.where(seen, _next(one[k]), _next(root[k]))
        down.before.append(stop_root * _next(root[k]) + (1 - stop_root) * stop_one * here)
        down.through.append((1 - stop_root) * (1 - stop_one))
        down.here.append(here)
    return down


def _predict(codes: np.ndarray, counts: np.ndarray, down: _Down) -> np.ndarray:
    """log10 probability of the byte of each gram after its context.

    Where a context has not occurred in training, the deepest one that has takes its part.
    """
    depths = _depths(codes, counts)
    _, stops = _weigh(depths)
    result = np.zeros(len(codes))
    for i, depth in enumerate(depths):
        deepest = i == len(depths) - 1
        after = _Down(*(_levels(0 if deepest else len(depth)) for _ in range(3)))
        for a, b, part, dense in depth.blocks():
            up, seen, ones = depth.parent[a:b], dense.sum(1, keepdims=True) > 0, []
            for k, bits in enumerate(_bits(dense)):
                before, through = down.before[k][up], down.through[k][up]
                here = np.where(seen, _next(bits), down.here[k][up])
                if deepest:
                    ones.append(before + through * here)
                else:
                    stop = stops[i][k][a:b]
                    after.before[k][a:b] = before + through * stop * here
                    after.through[k][a:b] = through * (1 - stop)
                    after.here[k][a:b] = here
            if deepest:
                result[part] = _by_byte(ones)[depth.row[part] - a, depth.byte[part]]
        down = after
    return result


def _stop(own: np.ndarray, split: np.ndarray) -> np.ndarray:
    """Weight of stopping at a context: its own evidence against that of its parts together."""
    return 1 / (1 + np.exp(np.clip(split - own, -700, 700)))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts with what stands around them, and which bytes (after the first start) are predicted."""
    data = np.frombuffer(b"".join([START + t + END for t in texts]), np.uint8)
    ends = data == 255
    kept = ~ends[: -len(START)]
    for i in range(1, len(START)):
        kept &= ~ends[i : i - len(START)]
    return data, kept


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: only A-Z and ASCII white space are meant


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Texts in parts of about ``BLOCK`` bytes; null is an empty text."""
    for batch in batches:
        texts: list[bytes] = []
        size = start = 0
        for i, t in enumerate(batch.column(column).cast(pa.binary()).to_pylist()):
            texts.append(t or b"")
            size += len(texts[-1])
            if size >= BLOCK:
                yield batch.slice(start, i + 1 - start), texts
                texts, size, start = [], 0, i + 1
        if texts:
            yield batch.slice(start), texts


def _grams(data: np.ndarray) -> np.ndarray:
    """Each byte after the first start, with the ``DEPTH`` bytes before it in the higher bits."""
    grams = np.zeros(len(data) - DEPTH, np.int64)
    for i in range(DEPTH + 1):
        grams = grams << 8 | data[i : len(data) - DEPTH + i]
    return grams


def corpus_counts(rows: DataFrame) -> DataFrame:
    """(kind, item, code, n, present) of ``rows`` (trained, text): counts of words ("w"), grams ("g", by their
    code) and ends ("e"), ``n`` in the texts to learn from and ``present`` in all. Words of other texts
    are not counted.

    Each task counts its blocks first, and Spark combines them before the shuffle, so a frequent
    word costs one row for each block.
    """
    schema = "kind string, item binary, code long, n long, present long"
    names = ["kind", "item", "code", "n", "present"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in _blocks(batches, 1):
            trained = batch.column(0).to_pylist()
            words: Counter[bytes] = Counter()
            for text, learn in zip(block, trained):
                if learn:
                    words.update(_words(text))
            ends = sum(trained)
            n = pa.array([*words.values(), ends], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["w"] * len(words) + ["e"]), pa.array([*words, b""], pa.binary()),
                    pa.nulls(len(n), pa.int64()), n, n,
                ],
                names=names,
            )
            for learn in (True, False):
                texts = [text for text, known in zip(block, trained) if known == learn]
                if texts:
                    data, kept = _joined(texts)
                    codes, n = np.unique(_grams(data)[kept], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(["g"] * len(n)), pa.nulls(len(n), pa.binary()), pa.array(codes),
                            pa.array(n if learn else np.zeros(len(n), np.int64)), pa.array(n, pa.int64()),
                        ],
                        names=names,
                    )

    found = map_batches(rows.select("trained", "text"), count, schema)
    sums = [F.sum(c).alias(c) for c in ("n", "present")]
    return written(found.groupBy("kind", "item", "code").agg(*sums), "counts")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns (code, n, ...) in parts that hold all grams of their contexts of two bytes, in whose order they come."""
    held: list[list[np.ndarray]] = []
    size, wanted = 0, CHUNK
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size >= wanted:
            columns = [np.concatenate(c) for c in zip(*held)]
            pairs = columns[0] >> 8 & 0xFFFF
            cut = np.searchsorted(pairs, pairs[-1])
            if cut:
                yield tuple(c[:cut] for c in columns)
            held = [[c[cut:] for c in columns]]
            size -= cut
            wanted = max(CHUNK, 2 * size)
    if size:
        yield tuple(np.concatenate(c) for c in zip(*held))


def gram_scores(counts: DataFrame) -> DataFrame:
    """(code, present, score): the log10 probability of each gram of ``corpus_counts``.

    To the driver come 511 numbers for each of the 256 contexts of one byte.
    """
    spark = counts.sparkSession
    grams = counts.where("kind = 'g'").select("code", "n", "present")
    parts = spark.sparkContext.defaultParallelism + grams.count() // CHUNK
    pair = F.expr("shiftright(code, 8) & 65535")
    subtrees = grams.repartition(parts, pair).sortWithinPartitions(pair)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, n, _ in _whole(batches):
            split, _ = _weigh(_depths(codes, n))
            counted = np.zeros((256, 256))
            np.add.at(counted, (codes >> 8 & 255, codes & 255), n)
            values = np.concatenate([*split, counted], axis=1)
            present = np.unique(codes >> 8 & 255)
            yield pa.RecordBatch.from_arrays(
                [pa.array(present.astype(np.int32)), pa.array(list(values[present]), pa.list_(pa.float64()))],
                names=["context", "sums"],
            )

    sums = map_batches(subtrees, weigh, "context int, sums array<double>")
    table = sums.select("context", F.posexplode("sums")).groupBy("context", "pos").agg(F.sum("col").alias("sum")).toArrow()
    top = np.zeros((256, 511))
    top[table["context"].to_numpy(), table["pos"].to_numpy()] = table["sum"].to_numpy()
    split = [top[:, (1 << k) - 1 : (2 << k) - 1] for k in range(8)]
    down = spark.sparkContext.broadcast(_from_root(top[:, 255:], split))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, n, present in _whole(batches):
            columns = [pa.array(codes), pa.array(present), pa.array(_predict(codes, n, down.value))]
            yield pa.RecordBatch.from_arrays(columns, names=["code", "present", "score"])

    return written(map_batches(subtrees, predict, "code long, present long, score double"), "grams")


class Known:
    """Grams and words that are looked up in the tasks."""

    def __init__(self, words: pa.Table, grams: pa.Table):
        codes = grams["code"].to_numpy()
        self.shift = np.uint64(64 - max(len(codes).bit_length(), 1))
        buckets = self._bucket(codes)
        order = np.argsort(buckets, kind="stable")
        self.codes = np.append(codes[order], 1 << 62)
        self.scores = np.append(grams["score"].to_numpy()[order], 0).astype(np.float32)
        self.starts = np.searchsorted(buckets[order], np.arange((1 << 64 - int(self.shift)) + 1)).astype(np.int32)
        self.words = dict(zip(words["item"].to_pylist(), np.log10(words["n"].to_numpy() + 1.0).tolist()))

    def _bucket(self, codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _places(self, grams: np.ndarray) -> np.ndarray:
        """Where each gram is, or where some other one is; buckets hold one or two."""
        bucket = self._bucket(grams)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        open_ = np.flatnonzero((self.codes[at] != grams) & (at + 1 < end))
        while len(open_):
            at[open_] += 1
            here = at[open_]
            open_ = open_[(self.codes[here] != grams[open_]) & (here + 1 < end[open_])]
        return at

    def look_up(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text the sum of the scores of its known grams; text, code and number of the others."""
        data, kept = _joined(texts)
        grams = _grams(data)
        at = self._places(grams)
        found = kept & (self.codes[at] == grams)
        each = np.where(found, self.scores[at].astype(np.float64), 0)
        starts = np.cumsum([0] + [len(t) + DEPTH + 1 for t in texts[:-1]])
        sums = np.add.reduceat(each, np.minimum(starts, len(each) - 1))
        missing = np.flatnonzero(kept & ~found)
        text = np.searchsorted(starts, missing, "right") - 1
        # Texts of a block are fewer than its bytes, so both fit into a long integer.
        keys, times = np.unique(text << 40 | grams[missing], return_counts=True)
        return sums, keys >> 40, keys & ((1 << 40) - 1), times


def score_texts(docs: DataFrame, training: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, trained, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``training`` is true for the rows to learn from (null: false). Tokens are the words of the
    text in lower case (A-Z only) and one end. ``base_score`` adds log10((c + 1) / (N + V + 1)).
    ``score`` is the context tree's log10 probability of the text's bytes as they are, its end
    included; bits_per_byte is the same as code length. Null is an empty text: one token, the end.
    Without training rows the word model gives zero and the tree is uniform. Repeated rows are
    scored alike; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{id_column}`").alias("id"), F.coalesce(training, F.lit(False)).alias("trained"),
        F.col(f"`{text_column}`").alias("text"),
    )
    counts = corpus_counts(rows)
    words = counts.where("kind <> 'g'")
    total, distinct, ends = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)),
        F.count_if(F.col("n") > 0),
        F.coalesce(F.sum(F.when(F.col("kind") == "e", F.col("n"))), F.lit(0)),
    ).first()
    grams = gram_scores(counts)
    positions = grams.agg(F.coalesce(F.sum("present"), F.lit(0))).first()[0]
    frequent_word = (F.col("kind") == "w") & (F.col("n") * SHARE >= total)
    frequent_gram = F.col("present") * GRAM_SHARE >= positions
    known = spark.sparkContext.broadcast(
        Known(
            words.where(frequent_word).select("item", "n").toArrow(),
            grams.where(frequent_gram).select("code", "score").toArrow(),
        )
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = known.value.words
        for batch, block in _blocks(batches, 2):
            tokens, found, sums, rest, times, cuts = [], [], [], [], [], [0]
            for text in block:
                own = _words(text)
                total_log, seen = 0.0, 0
                for word, n in Counter(own).items():
                    log = frequent.get(word)
                    if log is None:
                        rest.append(word)
                        times.append(n)
                    else:
                        total_log += n * log
                        seen += n
                tokens.append(len(own) + 1)
                found.append(seen)
                sums.append(total_log)
                cuts.append(len(rest))
            others = pa.StructArray.from_arrays([pa.array(rest, pa.binary()), pa.array(times, pa.int64())], names=["item", "times"])
            scores, text_at, codes, n = known.value.look_up(block)
            gram_cuts = np.searchsorted(text_at, np.arange(len(block) + 1)).astype(np.int32)
            rare = pa.StructArray.from_arrays([pa.array(codes), pa.array(n, pa.int64())], names=["code", "times"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([len(t) for t in block], pa.int64()),
                    pa.array(tokens, pa.int64()), pa.array(found, pa.int64()), pa.array(sums, pa.float64()),
                    pa.array(scores), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), others),
                    pa.ListArray.from_arrays(pa.array(gram_cuts), rare),
                ],
                names=schema.names,
            )

    schema = T.StructType(
        [
            rows.schema["id"], rows.schema["trained"], T.StructField("size", T.LongType()),
            T.StructField("n_tokens", T.LongType()), T.StructField("seen", T.LongType()),
            T.StructField("logs", T.DoubleType()), T.StructField("score", T.DoubleType()),
            T.StructField("rest", T._parse_datatype_string("array<struct<item:binary,times:bigint>>")),
            T.StructField("grams", T._parse_datatype_string("array<struct<code:bigint,times:bigint>>")),
        ]
    )
    scored = written(map_batches(rows, score, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = scored.select("row", F.explode("rest").alias("r")).select("row", "r.item", "r.times")
    rare = words.where((F.col("kind") == "w") & ~frequent_word).select("item", "n")
    by_row = (
        rest.join(rare, "item")
        .groupBy("row")
        .agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    )
    grams_by_row = (
        scored.select("row", F.explode("grams").alias("g")).select("row", "g.code", "g.times")
        .join(grams.where(~frequent_gram).select("code", F.col("score").alias("each")), "code")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.col("each")).alias("more_score"))
    )
    end_log, each = float(np.log10(ends + 1.0)), float(np.log10(total + distinct + 1.0))
    zero = F.lit(0)
    score_of_text = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return (
        scored.drop("rest", "grams").join(by_row, "row", "left").join(grams_by_row, "row", "left").select(
            F.col("id").alias(id_column), "trained", "n_tokens",
            (F.col("seen") + F.coalesce("more", zero) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
            F.lit(int(total)).cast("long").alias("train_tokens"),
            (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + F.lit(end_log) - F.col("n_tokens") * F.lit(each)).alias("base_score"),
            score_of_text.alias("score"),
            (-score_of_text / F.log10(F.lit(2.0)) / (F.col("size") + 1)).alias("bits_per_byte"),
        )
    )
