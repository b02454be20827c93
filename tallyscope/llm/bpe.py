"""Byte-level BPE by prefix dynamic programming.

In an encoding, every prefix of the bytes has exactly one valid last token: the one that ends there
and stands validly after the last token of what comes before it. Two tokens stand validly side by
side when no merge crosses the border between them before both are complete. So the table of last
tokens gives the encoding of every prefix; bytes can be appended, and after an edit only the
entries near it are computed again.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.tables import map_batches

#: Unicode's White_Space, as in a character class.
SPACES = "\t-\r \x85\xa0  -     　"
#: Entries of a cache of encoded words in a Python worker; it starts anew when full. Speed only.
CACHED = 300_000
#: Before a word that stands without a space before it; a lone surrogate, so in no text.
MARK = "\ud800"
#: Longer words are not cached.
CACHED_LENGTH = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """BPE over the ranks of byte strings; all single bytes must have one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._packed = {rank: rank.to_bytes(4, "little") for rank in self.bytes_of}
        self.longest = max(map(len, ranks))
        #: Every suffix of a token, with its rank if it is one that merges reach, else -1.
        self.suffixes = {token[i:]: -1 for token in ranks for i in range(len(token))}
        self._spines: dict[int, tuple[list[int], list[int]]] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._valid: dict[int, bool] = {}
        for token, rank in ranks.items():
            if self.halves(rank) is not None:
                self.suffixes[token] = rank

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; () for a byte, None if merges never reach it."""
        if token not in self._halves:
            parts = [self.ranks[bytes([b])] for b in self.bytes_of[token]]
            found: tuple[int, int] | tuple[()] | None = ()
            while len(parts) > 1:
                merged = [
                    (self.ranks.get(self.bytes_of[a] + self.bytes_of[b], 1 << 62), i)
                    for i, (a, b) in enumerate(zip(parts, parts[1:]))
                ]
                rank, i = min(merged)
                if rank == 1 << 62:
                    found = None
                    break
                found = (parts[i], parts[i + 1])
                parts[i : i + 2] = [rank]
            self._halves[token] = found
        return self._halves[token]

    def spines(self, token: int) -> tuple[list[int], list[int]]:
        """Tokens that end, and that begin, this one while it is built; itself first."""
        if token not in self._spines:
            both = []
            for side in (1, 0):
                spine = [token]
                while half := self.halves(spine[-1]):
                    spine.append(half[side])
                both.append(spine)
            self._spines[token] = both[0], both[1]
        return self._spines[token]

    def valid(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens together are encoded as just these two.

        Walk back in time: on either side of the border stand the last pieces built there. A merge
        across it happens if its rank comes before those that replace the two pieces; on equal
        ranks the merge further left goes first.
        """
        ends, begins = self.spines(left)[0], self.spines(right)[1]
        i = j = 0
        after_left = after_right = 1 << 62
        fine = True
        while True:
            a, b = ends[i], begins[j]
            across = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if across is not None and across < after_left and across <= after_right:
                fine = False
                break
            # The later of the two pieces is taken apart first.
            if a > b and i + 1 < len(ends) or j + 1 == len(begins):
                if i + 1 == len(ends):
                    break
                after_left, i = a, i + 1
            else:
                after_right, j = b, j + 1
        if len(self._valid) >= 500_000:
            self._valid.clear()
        self._valid[left << 32 | right] = fine
        return fine

    def extend(self, data: bytes, last: list[int], until: Callable[[int], bool] | None = None) -> None:
        """Fill in the last tokens of the prefixes of ``data`` that ``last`` does not have yet.

        ``last[i]`` belongs to the prefix of i bytes, ``last[0]`` is -1.
        """
        suffixes, known = self.suffixes.get, self._valid.get
        for end in range(len(last), len(data) + 1):
            start = end
            while True:
                start -= 1
                token = suffixes(data[start:end])
                if token < 0:
                    continue
                before = last[start]
                if before < 0:
                    break
                fine = known(before << 32 | token)
                if fine or fine is None and self.valid(before, token):
                    break
            last.append(token)
            if until is not None and until(end):
                return

    def back(self, data: bytes, last: list[int]) -> list[int]:
        ids, end = [], len(data)
        while end:
            ids.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return ids[::-1]

    def encode(self, data: bytes) -> list[int]:
        """The ids of one word; a word that is a token as a whole is that token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        last = [-1]
        self.extend(data, last)
        return self.back(data, last)

    def encode_all(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """The ids of many words, as little-endian 32-bit integers.

        In sorted order a word is the one before with other bytes appended to a common prefix, whose
        last tokens are known.
        """
        suffixes, known, packed = self.suffixes.get, self._valid.get, self._packed
        data, last, ids = b"", [-1], [b""]
        found = {}
        for word in sorted(words):
            whole = self.ranks.get(word)
            if whole is not None:
                found[word] = packed[whole]
                continue
            if len(word) > CACHED_LENGTH:
                found[word] = b"".join(map(packed.__getitem__, self.encode(word)))
                continue
            keep = 0
            for a, b in zip(data, word):
                if a != b:
                    break
                keep += 1
            del last[keep + 1 :], ids[keep + 1 :]
            data = word
            for end in range(keep + 1, len(word) + 1):
                start = end
                while True:
                    start -= 1
                    token = suffixes(word[start:end])
                    if token < 0:
                        continue
                    before = last[start]
                    if before < 0:
                        break
                    fine = known(before << 32 | token)
                    if fine or fine is None and self.valid(before, token):
                        break
                last.append(token)
                ids.append(ids[start] + packed[token])
            found[word] = ids[-1]
        return found

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Growing:
    """The encoding of one word that changes: appends and edits compute only what they touch."""

    def __init__(self, encoder: Encoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, b"", [-1]
        self.computed = 0
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        before = len(self.last)
        self.encoder.extend(self.data, self.last)
        self.computed += len(self.last) - before

    def edit(self, start: int, stop: int, put: bytes) -> None:
        """Replace the bytes start..stop. Entries after it are reused once as many in a row as the
        longest token agree with the old ones, as later ones depend on nothing else."""
        old, shift = self.last, len(put) - (stop - start)
        self.data = self.data[:start] + put + self.data[stop:]
        self.last = old[: start + 1]
        agree = 0

        def same(end: int) -> bool:
            nonlocal agree
            if end < start + len(put):
                return False
            agree = agree + 1 if self.last[end] == old[end - shift] else 0
            return agree >= self.encoder.longest

        before = len(self.last)
        self.encoder.extend(self.data, self.last, same)
        self.computed += len(self.last) - before
        self.last += old[len(self.last) - shift :]

    def ids(self) -> list[int]:
        whole = self.encoder.ranks.get(self.data)
        return [whole] if whole is not None else self.encoder.back(self.data, self.last)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """The matches of a pre-tokenisation pattern, with white space as Unicode has it."""
    own = pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"\S", f"[^{SPACES}]").replace(r"\s", f"[{SPACES}]")
    return regex.compile(own).findall


class WordEncoder:
    """Whole texts by their space-delimited words, each encoded once and remembered for a while.

    No match of a byte-level pattern goes on from visible characters into white space, so a word
    with the white space before it can be encoded alone; nor does one go on from a letter to a
    comma or full stop. ``encode_all`` gives the ids of many such words as little-endian 32-bit
    integers. Memory: the cache and a block of texts.
    """

    _runs = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
    _odd = re.compile(f" [{SPACES}]|[{SPACES}] ")
    _stopped = re.compile(r"[^\W\d_][,.]\Z").search
    #: Characters of texts that are looked up together.
    block = 1_000_000

    def __init__(self, encode_all: Callable[[list[str]], dict[str, bytes]]):
        self.encode_all = encode_all
        self.cache: dict[str, bytes] = {}
        self.stops = {c: encode_all([c])[c] for c in ",."}

    def __call__(self, texts: Iterable[str]) -> Iterator[bytes]:
        block: list[str] = []
        size = 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= self.block:
                yield from self._encoded(block)
                block, size = [], 0
        yield from self._encoded(block)

    def _words(self, text: str) -> list[str]:
        """A word that a single space precedes is written without it, any other with a mark."""
        if self._odd.search(text):
            return [MARK + w for w in self._runs.findall(text)]
        words = text.split(" ")
        words[0] = MARK + words[0]
        return words

    def _encoded(self, texts: list[str]) -> list[bytes]:
        words = [self._words(t) if t else [] for t in texts]
        if len(self.cache) >= CACHED:
            self.cache.clear()
        cache = self.cache
        missing = set().union(*words).difference(cache)
        stopped = [w for w in missing if self._stopped(w)]
        missing.difference_update(stopped)
        missing.update({w[:-1] for w in stopped}.difference(cache))
        plain = {w: w[1:] if w[:1] == MARK else " " + w for w in missing}
        found = self.encode_all(list(plain.values()))
        new = {w: found[p] for w, p in plain.items()}
        cache.update(new)
        for w in stopped:
            cache[w] = cache[w[:-1]] + self.stops[w[-1]]
        out = [b"".join(map(cache.__getitem__, w)) for w in words]
        for w in new:
            if len(w) > CACHED_LENGTH:
                del cache[w]
        return out


_encoders: dict[int, tuple[Encoder, WordEncoder]] = {}


def _in_worker(ranks: dict[bytes, int], pattern: str, key: int) -> tuple[Encoder, WordEncoder]:
    """One encoder for each vocabulary in a Python worker, with what it has remembered."""
    if key not in _encoders:
        _encoders.clear()
        encoder, words = Encoder(ranks), splitter(pattern)

        def encode_all(texts: list[str]) -> dict[str, bytes]:
            split = {t: words(t) for t in texts}
            ids = encoder.encode_all({w.encode() for ws in split.values() for w in ws})
            return {t: b"".join([ids[w.encode()] for w in ws]) for t, ws in split.items()}

        _encoders[key] = encoder, WordEncoder(encode_all)
    return _encoders[key]


def encode_texts(
    docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """id and ``ids``: the whole text's ids as little-endian unsigned 32-bit integers (binary).

    Each match of ``pattern`` is encoded by itself; special tokens do not exist, their strings are
    plain text. Null is an empty text and gives no ids. Rows are independent (no shuffle), so
    repeated rows give repeated results and an empty table an empty one. The vocabulary file is
    read on the driver and sent along (its size does not depend on the data).
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    key = hash((ranks_path, pattern))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, words = _in_worker(ranks.value, pattern, key)
        for batch in batches:
            ids = list(words(t.as_py() or "" for t in batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("ids", T.BinaryType())])
    return map_batches(rows, encode, schema).withColumnRenamed("id", id_column)


def decode_ids(encoded: DataFrame, ranks_path: str, ids_column: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with a binary column of the bytes that its ids stand for; null ids give null."""
    ranks = encoded.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    at = encoded.columns.index(ids_column)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(ranks.value.values()) + 1
        table: list[bytes | None] = [None] * size
        for token, rank in ranks.value.items():
            table[rank] = token
        for batch in batches:
            texts = [
                None if x is None else b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist()))
                for x in batch.column(at).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, into]
            )

    schema = T.StructType([*encoded.schema.fields, T.StructField(into, T.BinaryType())])
    return map_batches(encoded, decode, schema)
