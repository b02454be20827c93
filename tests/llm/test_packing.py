import random
from collections import Counter

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tallyscope.llm import bpe, packing

ARGS = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def one_by_one(lengths, capacity):
    """Best-fit decreasing, a piece at a time: the tightest room, the first such sequence."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [(room, i) for i, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits)[1]] -= length
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(60))
def test_plan_like_one_by_one(seed):
    draw = random.Random(seed)
    capacity = draw.choice([10, 16, 33, 100])
    lengths = [draw.randint(1, capacity) for _ in range(draw.randint(0, 120))]
    runs, opened = packing.best_fit_plan(Counter(lengths), capacity)
    held, seen = Counter(), Counter()
    for r in runs:
        assert r.first == seen[r.length]
        seen[r.length] += r.count
        for k in range(r.count):
            sequence, place = r.sequence + k // r.each, r.offset + k % r.each * r.length
            assert held[sequence] == place  # behind what is there already
            held[sequence] += r.length
    assert seen == Counter(lengths)
    assert sorted(capacity - held[i] for i in range(opened)) == one_by_one(lengths, capacity)


def test_tree_finds_the_tightest_room():
    tree = packing.RoomTree(100)
    for room in (7, 20, 90):
        tree.set(room, True)
    assert [tree.tightest(x) for x in (1, 7, 8, 21, 91)] == [7, 7, 20, 90, None]
    tree.set(20, False)
    assert tree.tightest(8) == 90


def test_plan_size_does_not_grow_with_the_table():
    draw = random.Random(0)
    counts = {n: draw.randint(1, 50) for n in range(1, 1025)}
    small, _ = packing.best_fit_plan(counts, 1024)
    large, _ = packing.best_fit_plan({n: c * 1_000_000 for n, c in counts.items()}, 1024)
    assert len(large) < 20_000 and len(small) < 20_000


def test_a_piece_that_does_not_fit():
    with pytest.raises(ValueError):
        packing.best_fit_plan({11: 1}, 10)


def test_odd_texts_like_the_tokenizer_file():
    encode = packing._tokenizer(open(ARGS[0], encoding="utf-8").read(), bpe.load_ranks(ARGS[1]), ARGS[2])
    full = Tokenizer.from_file(ARGS[0])
    draw = random.Random(1)
    letters = "ab  \n\t \x1c\x85\xa0　éßñ漢字😀'st'll 12٣!?#̀\0aaa"
    for text in ("<|endoftext|>", "a <|endoftext|>b", "<|endoftext|"):
        assert encode(text) == full.encode(text, add_special_tokens=False).ids
    for _ in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 30)))
        assert encode(text) == full.encode(text, add_special_tokens=False).ids, repr(text)


def test_edges(spark):
    rows = [(1, None, 7), (1, None, 7), (None, "", 7), (2, "word " * 5000, 7), (3, "<|endoftext|>", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int").withColumnRenamed("part", "length")
    out = packing.pack(packing.pieces(df, *ARGS)).collect()
    sizes = {}
    for r in out:
        sizes.setdefault(r.doc_id, []).append(r.length)
    assert sizes[1] == [1, 1] and sizes[None] == [1] and sum(sizes[2]) == 5002 and sizes[3] == [2]  # the id of the special token, and the end
    ends = Counter()
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 1024 and set(ends) == set(range(len(ends)))
    assert packing.pack(packing.pieces(df.limit(0), *ARGS)).collect() == []
    assert "ids" in packing.pieces(df, *ARGS, keep_ids=True).columns
