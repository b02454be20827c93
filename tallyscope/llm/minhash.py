"""Near-dedup by b-bit MinHash.

Minima of 768 hashes over a document's word shingles are kept twice: half of them in bands, whose
equality gives candidates, and all as four low bits each, packed. The share of equal low bits, corrected for chance
collisions, estimates a candidate's similarity; what may reach the limit is confirmed on the full sets.

Equal sets are one class from the start. A bucket (documents with an equal band) never lists its
pairs: its members are compared with the one that meets most others in all its buckets, in a family of
copies the original, and in a second turn with a few others. Documents of buckets that this leaves in
several components are joined exactly, by the rarest part of their sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyscope.llm.simhash import components
from tallyscope.llm.tables import map_batches, written

#: Words of a shingle, and the percentage of similarity that links.
WORDS = 5
LEAST = 85
#: Hashes; half of their minima are cut into bands.
MINIMA = 768
#: A pair at the limit may miss in all bands with this probability (at 0.85: 48 bands of eight, 2e-7),
MISSED = 2e-6
#: and its estimate be so many standard deviations too low (6e-8).
DEVIATIONS = 5.3
#: Low bits that are kept of each minimum, and the longs that hold them.
LOW = 4
PACKED = MINIMA * LOW // 64
#: Shingles that are hashed at once; bounds memory.
SHINGLES = 1 << 9
#: Bits of the filter that tells tasks whose full sets are asked for (16 MB).
FILTER_BITS = 1 << 27
#: A key with fewer rows is never split.
HOT = 1000
#: Members of a bucket that all others are compared with in the second turn.
HUBS = 2
#: Turns in which the best pair between two components is confirmed before all others are.
PICKS = 2

_draw = np.random.default_rng(13)
_SALT = _draw.integers(0, 1 << 32, MINIMA, np.uint32)[:, None]
_FACTOR = _draw.integers(0, 1 << 32, MINIMA, np.uint32)[:, None] | np.uint32(1)
_PLACES = _draw.integers(0, 1 << 63, 64, np.uint64) << np.uint64(1) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, size: int = WORDS) -> np.ndarray:
    """The set of word shingles as sorted 64-bit hashes; fewer words are one shingle, none are none."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space are meant
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), size)] if words else [], np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += each[k : k + n] * _PLACES[k]
    found = np.sort(_mixed(total))
    return found[np.append(True, found[1:] != found[:-1])]


def minima(hashes: np.ndarray) -> np.ndarray:
    """Of hashes over the upper half of each shingle's; halves are enough for candidates."""
    least = np.full(MINIMA, ~np.uint32(0))
    upper = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(upper), SHINGLES):
        part = upper[None, at : at + SHINGLES] ^ _SALT
        part *= _FACTOR
        np.minimum(least, part.min(1), out=least)
    return least


def band_rows(similarity: float) -> int:
    """Minima of a band: as many as still find nearly all pairs at a similarity."""
    fine = [r for r in (8, 6, 4, 3, 2) if (1 - similarity**r) ** (MINIMA // 2 // r) <= MISSED]
    return fine[0] if fine else 1


def signature(hashes: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band, then the packed low bits of the minima, as signed longs."""
    least = minima(hashes)
    bands = least[: MINIMA // 2].reshape(-1, rows)
    keys = [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(bands)]
    low = (_mixed(least.astype(np.uint64)) & np.uint64((1 << LOW) - 1)).reshape(PACKED, -1)
    packed = np.bitwise_or.reduce(low << (np.arange(low.shape[1], dtype=np.uint64) * np.uint64(LOW)), axis=1)
    return np.concatenate([np.array(keys, np.uint64), packed]).view(np.int64)


def enough_matches(similarity: float) -> int:
    """Equal low bits of the minima from which a pair may have this similarity, chance collisions included."""
    chance = 1 / (1 << LOW)
    p = chance + (1 - chance) * similarity
    return int(MINIMA * p - DEVIATIONS * (MINIMA * p * (1 - p)) ** 0.5)


def matches(a: Column, b: Column) -> Column:
    """Minima whose low bits are equal."""

    def unequal(x: Column) -> Column:
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    counts = F.zip_with(a, b, lambda x, y: unequal(x.bitwiseXOR(y)))
    return MINIMA - F.aggregate(counts, F.lit(0), lambda n, c: n + c)


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _with_signatures(plain: DataFrame, words: int, least: int) -> DataFrame:
    """id, text_key, n, digest of the set, bits (band keys and packed low bits; none for an empty set)."""
    band = band_rows(least / 100)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bits = [], [], []
            for text in batch.column(2):
                own = shingle_hashes(text.as_py(), words)
                sizes.append(len(own))
                digests.append(_digest(own))
                bits.append(signature(own, band) if len(own) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(bits, pa.list_(pa.int64()))],
                names=["id", "text_key", "n", "digest", "bits"],
            )

    kind = plain.schema["id"].dataType.simpleString()
    return map_batches(plain, add, f"id {kind}, text_key binary, n long, digest binary, bits array<long>")


def _joined(many: DataFrame, one: DataFrame, key: str, by: str, sizes: DataFrame) -> DataFrame:
    """Inner join; ``sizes`` (key, size) says how many rows of ``many`` a key has.

    Keys with more rows than a task's share, of which there are at most as many as tasks, are spread by
    a hash of ``by``, and their rows of ``one`` repeated.
    """
    tasks = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total, most = sizes.agg(F.sum("size"), F.max("size")).first()
    share = max(HOT, (total or 0) // tasks)
    if (most or 0) <= share:
        return many.join(one, key)
    hot = sizes.where(F.col("size") > share).select(key, F.ceil(F.col("size") / share).cast("int").alias("shares"))
    known = F.broadcast(many.sparkSession.createDataFrame([tuple(r) for r in hot.collect()], hot.schema))
    dealt = many.join(known, key, "left").withColumn("salt", F.pmod(F.xxhash64(by), F.coalesce("shares", F.lit(1))).cast("int"))
    repeated = one.join(known, key, "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))
    )
    return dealt.drop("shares").join(repeated.drop("shares"), [key, "salt"]).drop("salt")


def _beside_pairs(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """The written ``pairs`` (a, b, ...) with the columns of ``facts`` (row, ...) for both, named a_ and b_."""
    sizes = {end: pairs.groupBy(end).agg(F.count("*").alias("size")) for end in ("a", "b")}
    for end, other in (("b", "a"), ("a", "b")):
        own = facts.select(*[F.col(c).alias(end if c == "row" else f"{end}_{c}") for c in facts.columns])
        pairs = _joined(pairs, own, end, other, sizes[end])
    return pairs


def _long_enough(a: Column | str, b: Column | str, least: int) -> Column:
    """Sets of these sizes can be similar at all."""
    return 100 * F.least(a, b) >= least * F.greatest(a, b)


class _Links:
    """Links between sets, and the components they make so far."""

    def __init__(self, plain: DataFrame, sets: DataFrame, words: int, least: int):
        self.plain, self.sets, self.words, self.least = plain, sets, words, least
        self.full: DataFrame | None = None
        self.links: DataFrame | None = None
        #: row, root for rows that have links.
        self.roots: DataFrame | None = None

    def full_sets(self, rows: DataFrame) -> DataFrame:
        """(row, hashes): the full sets of ``rows`` (row), made again from their texts.

        A filter of fixed size tells tasks which documents are asked for, so texts are not shuffled
        and only these are hashed. Sets that were made before are taken from their table.
        """
        need = rows.select("row").distinct()
        if self.full is not None:
            need = need.join(self.full.select("row"), "row", "left_anti")
        need = written(self.sets.select("row", "digest", "rep").join(need, "row", "left_semi"), "needed")
        if need.isEmpty():
            return self.full if self.full is not None else need.select("row", F.array().cast("array<long>").alias("hashes"))
        place = F.pmod(F.xxhash64("text_key", "id"), F.lit(FILTER_BITS))
        places = need.select(F.col("rep.text_key").alias("text_key"), F.col("rep.id").alias("id")).select(place.alias("p"))
        parts = places.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")
        )
        asked = {r.bucket: bytes(r.bits) for r in parts.collect()}
        words = self.words

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done: set[bytes] = set()
            for batch in batches:
                digests, sets = [], []
                for bucket, bit, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    bits = asked.get(bucket)
                    if bits is None or not bits[bit // 8] >> bit % 8 & 1:
                        continue
                    own = shingle_hashes(text.as_py(), words)
                    digest = _digest(own)
                    if digest not in done:
                        done.add(digest)
                        digests.append(digest)
                        sets.append(own.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["digest", "hashes"]
                )

        texts = self.plain.where(F.col("text").isNotNull()).withColumn("p", place)
        texts = texts.select(F.bitmap_bucket_number("p").alias("bucket"), F.bitmap_bit_position("p").alias("bit"), "text")
        made = map_batches(texts, make, "digest binary, hashes array<long>")
        # Rows alike in id and text make one set in several tasks.
        made = made.join(need.select("row", "digest"), "digest").groupBy("row").agg(F.first("hashes").alias("hashes"))
        made = written(made, "full-sets")
        self.full = made if self.full is None else self.full.unionAll(made)
        return self.full

    def with_roots(self, rows: DataFrame, row: str = "row", root: str = "root") -> DataFrame:
        if self.roots is None:
            return rows.withColumn(root, F.col(row))
        known = self.roots.select(F.col("row").alias(row), F.col("root").alias(root))
        return rows.join(known, row, "left").withColumn(root, F.coalesce(root, row))

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose estimated similarity may reach the limit, with ``found`` matches."""
        both = _beside_pairs(pairs, self.sets.select("row", "n", "low"))
        both = both.where(_long_enough("a_n", "b_n", self.least)).withColumn("found", matches(F.col("a_low"), F.col("b_low")))
        return both.where(F.col("found") >= enough_matches(self.least / 100)).select("a", "b", "found")

    def confirm(self, pairs: DataFrame) -> None:
        """Compare the full sets of the pairs (a, b), and join the components of those that are similar."""
        full = self.full_sets(pairs.select(F.explode(F.array("a", "b")).alias("row")))
        common = F.size(F.array_intersect("a_hashes", "b_hashes"))
        alike = 100 * common >= self.least * (F.size("a_hashes") + F.size("b_hashes") - common)
        more = written(_beside_pairs(pairs.select("a", "b"), full).where(alike).select("a", "b"), "links")
        if more.isEmpty():
            return
        self.links = more if self.links is None else self.links.unionAll(more)
        ends = components(self.links)
        nodes = ends.select(F.col("u").alias("row"), F.col("v").alias("root"))
        self.roots = written(nodes.unionAll(ends.select(F.col("v").alias("row"), F.col("v").alias("root")).distinct()), "roots")


def _star(links: _Links, members: DataFrame, sizes: DataFrame, order: Column, hubs: int) -> None:
    """Compare the members (key, row, root) of each bucket with the first few, if of another component."""
    first = members.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy(order, "row"))).where(F.col("place") <= hubs)
    first = written(first.select("key", F.col("row").alias("a"), F.col("root").alias("a_root")), "hubs")
    pairs = _joined(members.select("key", "row", "root"), first, "key", "row", sizes).where("root <> a_root")
    pairs = written(pairs.select(F.least("a", "row").alias("a"), F.greatest("a", "row").alias("b")).distinct(), "pairs")
    pairs = written(links.likely(pairs), "likely")
    if not pairs.isEmpty():
        links.confirm(pairs)


def _apart(links: _Links, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of buckets that are in several components, and the sizes of these buckets."""
    now = written(links.with_roots(members.select("key", "row")), "labelled")
    split = now.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("x"), F.max("root").alias("y"))
    split = written(split.where("x < y").select("key", "size"), "split")
    return written(_joined(now, split.select("key"), "key", "row", split), "apart"), split


def _by_prefix(links: _Links, rows: DataFrame) -> DataFrame:
    """(a, b, found): every likely pair of ``rows`` (row, root) of two components, without the bands.

    Similar sets share one of their rarest shingles: of n, all but 85 % and one more. Shingles that all
    members of a family have are common, so they are in no such prefix.
    """
    full = links.full_sets(rows)
    sets = full.join(rows, "row").withColumn("n", F.size("hashes"))
    tokens = written(sets.select("row", "n", F.explode("hashes").alias("h")), "tokens")
    counts = written(tokens.groupBy("h").agg(F.count("*").alias("size")).where("size > 1"), "token-counts")
    own = W.partitionBy("row")
    ranked = _joined(tokens, counts, "h", "row", counts).select(
        "row", "n", "h",
        F.row_number().over(own.orderBy("size", "h")).alias("place"),
        F.count("*").over(own).alias("shared"),
    )
    # Shingles of one set only stand first, and can be left out.
    prefix = F.col("n") - F.ceil(F.col("n") * links.least / 100) + 1
    kept = ranked.where(F.col("place") <= prefix - (F.col("n") - F.col("shared"))).select("row", "h")
    kept = kept.join(rows, "row").join(links.sets.select("row", "n", "low"), "row")
    kept = written(kept, "prefixes")
    sizes = written(kept.groupBy("h").agg(F.count("*").alias("size")), "prefix-counts")
    other = kept.select("h", *[F.col(c).alias(f"b_{c}") for c in ("row", "root", "n", "low")])
    pairs = _joined(kept, other, "h", "row", sizes)
    found = matches(F.col("low"), F.col("b_low"))
    pairs = pairs.where((F.col("row") < F.col("b_row")) & (F.col("root") != F.col("b_root")) & _long_enough("n", "b_n", links.least))
    pairs = pairs.where(found >= enough_matches(links.least / 100))
    return pairs.select(F.col("row").alias("a"), F.col("b_row").alias("b"), found.alias("found")).distinct()


def _linked(links: _Links) -> None:
    """Link all similar sets."""
    members = links.sets.select("row", F.explode("keys").alias("key"))
    sizes = written(members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    members = written(_joined(members, sizes, "key", "row", sizes), "members")
    met = written(members.groupBy("row").agg(F.sum("size").alias("met")), "met")
    named = written(members.join(met, "row").withColumn("root", F.col("row")), "members")
    _star(links, named, sizes, F.col("met").desc(), 1)
    # Buckets of two are done.
    apart, sizes = _apart(links, members.where("size > 2"))
    if apart.isEmpty():
        return
    _star(links, apart, sizes, F.xxhash64("row", "key"), HUBS)
    apart, _ = _apart(links, apart)
    if apart.isEmpty():
        return
    pairs = written(_by_prefix(links, apart.select("row", "root").distinct()), "likely")
    for turn in range(PICKS + 1):
        now = links.with_roots(links.with_roots(pairs, "a", "a_root"), "b", "b_root").where("a_root <> b_root")
        now = written(now, "pending")
        if now.isEmpty():
            return
        if turn == PICKS:
            links.confirm(now)
            return
        # One pair of a document and a component first: it may spare the others.
        best = now.groupBy("a", "b_root").agg(F.max_by("b", F.struct("found", "b")).alias("b"))
        best = written(best.select("a", "b"), "picks")
        links.confirm(best)
        pairs = now.select("a", "b", "found").join(best, ["a", "b"], "left_anti")


def similar_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = WORDS,
    least: int = LEAST,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``, ``kept``.

    A set holds a text's distinct shingles of ``words`` words (A-Z in lower case); a text of fewer words
    is one shingle. Sets are linked when they share at least ``least`` of 100 shingles of both together;
    component_id is the least id that links reach. Null and empty texts and those without words have
    no shingles and are linked with nothing. Null ids do not count for component_id, which is null only
    where all are, and are not kept. Rows alike in id and text are all kept or not. An empty table
    gives an empty result; other columns are not read. Texts do not leave the tasks that read them.
    """
    text = F.col(f"`{text_column}`")
    plain = docs.select(
        F.col(f"`{id_column}`").alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("text_key"), text.alias("text")
    )
    rows = written(_with_signatures(plain, words, least), "signatures")
    sets = rows.where("n > 0").groupBy("digest").agg(
        F.count("*").alias("size"), F.min("id").alias("best"), F.min(F.struct("text_key", "id")).alias("rep"),
        F.first("n").alias("n"), F.first("bits").alias("bits"),
    )
    sets = sets.select(
        F.monotonically_increasing_id().alias("row"), "digest", "size", "best", "rep", "n",
        F.slice("bits", 1, F.size("bits") - PACKED).alias("keys"), F.slice("bits", -PACKED, PACKED).alias("low"),
    )
    sets = written(sets, "sets")
    links = _Links(plain, sets, words, least)
    _linked(links)
    named = links.with_roots(sets.select("row", "digest", "size", "best"))
    whole = written(named.groupBy("root").agg(F.min("best").alias("whole"), F.count("*").alias("size")), "component-best")
    named = _joined(named.drop("size"), whole.drop("size"), "root", "row", whole).select("row", "whole")
    named = written(sets.select("row", "digest", "size").join(named, "row").drop("row"), "classes")
    some = _joined(rows.where("n > 0").select("id", "n", "digest"), named.drop("size"), "digest", "id", named).select("id", "n", "whole")
    none = rows.where("n = 0").select("id", "n", F.col("id").alias("whole"))
    return some.unionAll(none).select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.col("whole").alias("component_id"),
        F.coalesce(F.col("id") == F.col("whole"), F.lit(False)).alias("kept"),
    )
