"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Two networks read a window of bytes, one from either end; their states give every position
probabilities of the languages, and a document's are the mean over all its positions. The network
is trained on the driver by backpropagation through time, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.tables import map_batches, written

#: Bytes that are read together; a text of any length is a row of windows, the last one shorter.
WINDOW = 64
HIDDEN = 8
#: Bounds of the training sample: texts of each language, characters of a text, and the languages
#: from which on each has fewer texts; all are learned.
SAMPLE_ROWS = 240
SAMPLE_CHARS = 512
LANGUAGES = 200
STEPS = 260
BATCH = 128
#: Windows that a task reads at once; bounds memory.
WINDOWS = 8192
UNDETERMINED = "und"


@dataclass
class Weights:
    """Per direction: input[256, 3H] (the embedding of a byte, already multiplied), state[H, 3H];
    of the output: out[2H, languages] and bias. Gates stand in the order update, reset, new."""

    input: list[np.ndarray]
    state: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def all(self) -> list[np.ndarray]:
        return [*self.input, *self.state, self.out, self.bias]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(0))
    return e / e.sum(0)


def _read(table: np.ndarray, state: np.ndarray, data: np.ndarray, mask: np.ndarray | None, keep: list | None) -> list[np.ndarray]:
    """States (H, windows) after each row of ``data`` (time, windows); where mask is 0 they stay 0."""
    hidden = state.shape[0]
    across, columns = np.ascontiguousarray(state.T), np.ascontiguousarray(table.T)
    h = np.zeros((hidden, data.shape[1]), table.dtype)
    states = []
    for t, bytes_ in enumerate(data):
        x, u = columns.take(bytes_, 1), across @ h
        gates = _sigmoid(x[: 2 * hidden] + u[: 2 * hidden])
        update, reset = gates[:hidden], gates[hidden:]
        new = np.tanh(x[2 * hidden :] + reset * u[2 * hidden :])
        after = new + update * (h - new)
        if mask is not None:
            after *= mask[t]
        if keep is not None:
            keep.append((h, update, reset, new, u[2 * hidden :]))
        states.append(after)
        h = after
    return states


def _read_back(
    gradients: list[np.ndarray], kept: list, state: np.ndarray, data: np.ndarray, mask: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Backpropagation through time: gradients of the input table and the state matrix."""
    hidden = state.shape[0]
    d_table, d_state = np.zeros((256, 3 * hidden), state.dtype), np.zeros_like(state)
    flow = np.zeros_like(gradients[0])
    for t in range(len(data) - 1, -1, -1):
        h, update, reset, new, u = kept[t]
        d = (gradients[t] + flow) * mask[t]
        d_new = d * (1 - update) * (1 - new * new)
        d_update = d * (h - new) * update * (1 - update)
        d_reset = d_new * u * reset * (1 - reset)
        inputs = np.concatenate([d_update, d_reset, d_new])
        np.add.at(d_table, data[t], inputs.T)
        inner = np.concatenate([d_update, d_reset, d_new * reset])
        d_state += h @ inner.T
        flow = d * update + state @ inner
    return d_table, d_state


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as columns (time, windows), their lengths, and the text each belongs to."""
    sizes = np.array([len(t) for t in texts], np.int64)
    each = -(-sizes // WINDOW)
    of = np.repeat(np.arange(len(texts)), each)
    data = np.zeros((int(each.sum()), WINDOW), np.uint8)
    starts = np.cumsum(each) - each
    flat = data.ravel()
    for text, start in zip(texts, (starts * WINDOW).tolist()):
        flat[start : start + len(text)] = np.frombuffer(text, np.uint8)
    lengths = np.full(len(of), WINDOW)
    some = each > 0
    lengths[(starts + each - 1)[some]] = (sizes - (each - 1) * WINDOW)[some]
    return data.T, lengths, of


class Model:
    """A trained network. ``positions`` labels every byte; ``documents`` pools whole texts."""

    def __init__(self, languages: list[str], weights: Weights):
        self.languages, self.weights = languages, weights

    def _probabilities(self, data: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
        """(languages, windows) for each time step."""
        w = self.weights
        full = lengths.min(initial=WINDOW) == WINDOW
        mask = None if full else (np.arange(len(data))[:, None] < lengths).astype(np.float32)
        ahead = _read(w.input[0], w.state[0], data, mask, None)
        behind = _read(w.input[1], w.state[1], data[::-1], None if full else mask[::-1], None)[::-1]
        hidden = len(w.state[0])
        first, second = np.ascontiguousarray(w.out[:hidden].T), np.ascontiguousarray(w.out[hidden:].T)
        for t in range(len(data)):
            scores = first @ ahead[t] + second @ behind[t] + w.bias[:, None]
            p = _softmax(scores)
            yield p if full else p * mask[t]

    def positions(self, text: bytes) -> np.ndarray:
        """(bytes, languages): probabilities at every position of a text."""
        data, lengths, _ = _windows([text])
        if not len(lengths):
            return np.zeros((0, len(self.languages)), np.float32)
        return np.stack(list(self._probabilities(data, lengths)), 0).transpose(2, 0, 1).reshape(-1, len(self.languages))[: len(text)]

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): mean of the probabilities at all positions; zeros for empty texts.

        Windows that are full and those that are not are read apart, as only these need a mask."""
        data, lengths, of = _windows(texts)
        total = np.zeros((len(self.languages), data.shape[1]), np.float32)
        for chosen in (np.flatnonzero(lengths == WINDOW), np.flatnonzero(lengths < WINDOW)):
            for at in range(0, len(chosen), WINDOWS):
                part = chosen[at : at + WINDOWS]
                own = np.zeros((len(self.languages), len(part)), np.float32)
                for p in self._probabilities(np.ascontiguousarray(data[:, part]), lengths[part]):
                    own += p
                total[:, part] = own
        out = np.stack([np.bincount(of, row, len(texts)) for row in total], 1)
        return out / np.maximum([[len(t)] for t in texts], 1)


def train(texts: list[bytes], labels: list[str], seed: int = 0, steps: int = STEPS) -> Model:
    """Fit by Adam on windows, the same number of each language in a step as far as that goes."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    data, lengths, of = _windows(texts)
    long_enough = lengths >= 16
    data, lengths = data[:, long_enough], lengths[long_enough]
    label = np.array([languages.index(x) for x in labels])[of[long_enough]]
    k = len(languages)

    def matrix(a: int, b: int, scale: float) -> np.ndarray:
        return (rng.standard_normal((a, b)) * scale).astype(np.float32)

    w = Weights(
        [matrix(256, 3 * HIDDEN, 0.5) for _ in range(2)], [matrix(HIDDEN, 3 * HIDDEN, HIDDEN**-0.5) for _ in range(2)],
        matrix(2 * HIDDEN, k, 0.3), np.zeros(k, np.float32),
    )
    if k < 2 or not len(label):
        return Model(languages, w)
    pools = [np.flatnonzero(label == i) for i in range(k)]
    pools = [p for p in pools if len(p)]
    first, second = [np.zeros_like(x) for x in w.all()], [np.zeros_like(x) for x in w.all()]
    for step in range(1, steps + 1):
        chosen = np.array([rng.choice(pools[i % len(pools)]) for i in rng.integers(0, len(pools), BATCH)])
        x, mask = data[:, chosen], (np.arange(WINDOW)[:, None] < lengths[chosen]).astype(np.float32)
        kept: tuple[list, list] = ([], [])
        ahead = _read(w.input[0], w.state[0], x, mask, kept[0])
        behind = _read(w.input[1], w.state[1], x[::-1], mask[::-1], kept[1])
        both = [np.concatenate([a, b]) for a, b in zip(ahead, behind[::-1])]
        wanted = np.eye(k, dtype=np.float32)[label[chosen]].T
        d_out, d_bias, back = np.zeros_like(w.out), np.zeros_like(w.bias), []
        for t, h in enumerate(both):
            d = (_softmax(w.out.T @ h + w.bias[:, None]) - wanted) * mask[t] / mask.sum()
            d_out += h @ d.T
            d_bias += d.sum(1)
            back.append(w.out @ d)
        g0 = _read_back([b[:HIDDEN] for b in back], kept[0], w.state[0], x, mask)
        g1 = _read_back([b[HIDDEN:] for b in back][::-1], kept[1], w.state[1], x[::-1], mask[::-1])
        rate = 0.03 * min(1.0, 2 * (1 - step / (steps + 1)))
        for value, gradient, m, v in zip(w.all(), [g0[0], g1[0], g0[1], g1[1], d_out, d_bias], first, second):
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient * gradient - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(languages, w)


def sampled(docs: DataFrame, text_column: str, label_column: str) -> tuple[list[bytes], list[str]]:
    """A bounded sample of labelled rows: a stretch of characters from anywhere in each text.

    Of every label the distinct texts with the least hashes, however often each is repeated:
    ``SAMPLE_ROWS`` for up to ``LANGUAGES`` labels, fewer of each (one at least) beyond. Texts are
    cut to their number in each task before they are shuffled by label.
    """
    text, label = F.col(f"`{text_column}`"), F.col(f"`{label_column}`")
    rows = docs.select(text.alias("text"), label.alias("label")).where("label IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    distinct = written(rows.select("label", "hash").distinct(), "labelled")
    n = distinct.select("label").distinct().count()
    if not n:
        return [], []
    each = max(1, min(SAMPLE_ROWS, SAMPLE_ROWS * LANGUAGES // n))
    place = F.row_number().over(Window.partitionBy("label").orderBy("hash"))
    least = distinct.withColumn("place", place).where(F.col("place") <= each).select("label", "hash")
    start = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1)))
    stretch = F.substr("text", (start + 1).cast("int"), F.lit(SAMPLE_CHARS))
    chosen = rows.join(F.broadcast(least), ["label", "hash"]).groupBy("label", "hash").agg(F.min(stretch).alias("text"))
    found = sorted((r.label, r.text) for r in chosen.select("label", "text").collect())
    return [x.encode() for _, x in found], [x for x, _ in found]


def with_language(
    docs: DataFrame,
    training: Column,
    text_column: str = "text",
    label_column: str = "lang",
    into: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """``docs`` with the predicted language and its pooled probability.

    Learns from rows where ``training`` holds (null: not) and the label is not null; a prediction
    reads the text only, all of it. Null texts and texts without a letter are ``und`` with score 0,
    as are all if there is nothing to learn from. Repeated rows get the same prediction; the
    columns of ``docs`` pass, and an empty table stays empty. Only hashes of labelled rows are shuffled.
    """
    texts, labels = sampled(docs.where(F.coalesce(training, F.lit(False))), text_column, label_column)
    shared = docs.sparkSession.sparkContext.broadcast(train(texts, labels) if labels else None)
    at = docs.columns.index(text_column)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found: list[str] = []
            scores: list[float] = []
            block: list[str] = []
            size = 0

            def flush() -> None:
                readable = [i for i, t in enumerate(block) if model is not None and any(map(str.isalpha, t))]
                pooled = model.documents([block[i].encode() for i in readable]) if readable else []
                names, best = [UNDETERMINED] * len(block), [0.0] * len(block)
                for i, p in zip(readable, pooled):
                    names[i], best[i] = model.languages[int(p.argmax())], min(1.0, float(p.max()))
                found.extend(names)
                scores.extend(best)

            for text in batch.column(at):
                block.append(text.as_py() or "")
                size += len(block[-1])
                if size >= 1_000_000:
                    flush()
                    block, size = [], 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names, *into],
            )

    added = [T.StructField(into[0], T.StringType()), T.StructField(into[1], T.DoubleType())]
    return map_batches(docs, predict, T.StructType([*docs.schema.fields, *added]))
