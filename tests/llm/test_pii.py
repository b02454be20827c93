import random
import re
import time

from tallyscope.llm import pii

#: The fixed patterns as they are given; the library has them in linear form.
GIVEN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, (name, pattern) in enumerate(GIVEN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {
                "email": True,
                "ip": name == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[name]
            if fine:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def listed(spans):
    return ",".join(f"{GIVEN[kind][0]}:{a}:{b}" for a, kind, b in spans)


def spans_of(rows):
    return {r.doc_id: [(s.start, s.kind, s.stop) for s in r.spans] for r in rows}


def test_fixed_kinds_like_the_given_patterns(spark):
    draw = random.Random(3)
    letters = "ab@..--++ 0123456789%_()é😀\n"
    texts = {i: "".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for i in range(1500)}
    texts |= {
        5000: "1.2.3.4.5.6.7.8 a@b.c_d@e.f a@b.c@d.e 256.1.1.1 001.02.3.4 0255.1.1.1",
        5001: "4111111111111111 4111-1111 1111 1111 +1 (743) 555-3824 +1-2",
        5002: "7" * 40_000, 5003: "a" * 40_000, 5004: "1." * 20_000, 5005: "@" * 1000 + ".a" * 20_000,
        5006: "+1" * 20_000, 5007: "+1" + "(" * 40_000, 5008: "a@b.co " * 2000, 5009: "",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = spans_of(pii.find_pii(df).collect())
    assert found == {i: brute(t) for i, t in texts.items()}


def test_contexts_give_unknown_identifiers_away(spark):
    rows = [(i, f"please note account number AC{100000 + 7 * i} thanks") for i in range(5)]
    rows += [(100 + i, f"please note account number {10 + i}.{i}.3.4 thanks") for i in range(120)]
    rows += [(400, "order 123456789 x"), (401, None), (402, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [s.kind for s in r.all_spans] for r in pii.find_pii(df).collect()}
    assert all(found[i] == [4] for i in range(5)) and all(found[100 + i] == [1] for i in range(120))
    assert found[400] == found[401] == found[402] == []
    redacted = {r.doc_id: r.text for r in pii.redact_pii(df).collect()}
    assert redacted[0] == "please note account number <ID> thanks"
    assert redacted[100] == "please note account number <IP> thanks"
    assert (redacted[400], redacted[401], redacted[402]) == ("order 123456789 x", None, "")


def test_overlapping_spans_are_replaced_together(spark):
    text = "x +378282246310005 y a@b.co"  # a phone number and, from the next digit on, a card
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    out = pii.redact_pii(df).first().text
    assert out == "x <PHONE> y <EMAIL>"


def test_extra_columns_repeats_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string, row string, spans int, kind int, marks int, payload int"
    rows = [(None, "a@b.co", "r", 1, 2, 3, 4), (None, "a@b.co", "r", 1, 2, 3, 4), (3, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    out = pii.redact_pii(df)
    assert out.columns == df.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, [
        r if r.text is None else type(r)(**{**r.asDict(), "text": "<EMAIL>"}) for r in df.collect()
    ]))
    assert pii.find_pii(df).count() == 3
    assert pii.find_pii(df.limit(0)).collect() == [] and pii.redact_pii(df.limit(0)).collect() == []


def test_unseen_identifiers_of_several_shapes(spark):
    """Recall and false finds: five unseen beside sixty known in each context, and a context that
    surrounds known and unknown numbers as often as any other does."""
    shapes = [
        "AC{:06d}", "EMP-{:04d}", "{:03d}-45-6789", "AB/12/{:04d}", "X.{:03d}.77.Q1", "k_{:05d}_z9", "DE12ABCD{:04d}",
    ]
    rows, unseen = [], set()
    for k, shape in enumerate(shapes):
        for i in range(65):
            value = shape.format(10 + 7 * i) if i < 5 else f"{10 + i}.{k}.3.4"
            rows.append((len(rows), f"please give item{'abcdefg'[k]} number {value} thanks"))
            if i < 5:
                unseen.add(len(rows) - 1)
    plain = range(len(rows), len(rows) + 300)
    for i in plain:
        value = f"{i % 200}.9.{i % 7}.{i % 250}" if i % 3 else f"{700000 + i}"
        rows.append((i, f"some of it {value} and more"))
    found = {r.doc_id: (len(r.all_spans), len(r.spans)) for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = {i for i in unseen if found[i][0] != 1}
    false = {i for i in found if i not in unseen and found[i][0] != found[i][1]}
    assert (missed, false) == (set(), set())


def test_what_is_found_gives_more_contexts_away(spark):
    """The input that the evidence was first tested with (60 known), and a second context of what is found."""
    rows = [(i, f"please note account number AC{100000 + 7 * i} thanks") for i in range(5)]
    rows += [(100 + i, f"please note account number {10 + i}.{i}.3.4 thanks") for i in range(60)]
    rows += [(300 + i, f"see the file of AC{100000 + 7 * i} there") for i in range(5)]
    rows += [(320 + i, f"see the file of {20 + i}.{i}.5.6 there") for i in range(20)]
    rows += [(380, "see the file of Z-998877 there")]
    rows += [(400 + i, f"order {123456789 + i} x") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [s.kind for s in r.all_spans] for r in pii.find_pii(df).collect()}
    assert all(found[i] == [4] for i in range(5)) and all(found[100 + i] == [1] for i in range(60))
    assert found[380] == [4] and all(found[400 + i] == [] for i in range(40))


def test_many_spans_in_one_text(spark):
    """Time grows with the text: 200,000 spans in one row, of all kinds, overlapping and unknown ones."""
    draw = random.Random(7)
    kinds = ["a@b.co", "10.2.3.4", "4111111111111111", "+1 (743) 555-3824", "AC123456", "+378282246310005", "é😀 x"]
    text = " ".join(draw.choice(kinds) for _ in range(330_000))
    df = spark.createDataFrame([(1, text), (2, text[:3000])], "doc_id long, text string")
    start = time.time()
    found = spans_of(pii.find_pii(df).collect())
    assert time.time() - start < 60
    assert found == {1: brute(text), 2: brute(text[:3000])} and len(found[1]) > 200_000
    start = time.time()
    redacted = {r.doc_id: r.text for r in pii.redact_pii(df).collect()}
    assert time.time() - start < 60
    for i, whole in ((1, text), (2, text[:3000])):
        out, at = [], 0
        for a, kind, b in found[i]:
            if a >= at:
                out += [whole[at:a], f"<{pii.NAMES[kind].upper()}>"]
            at = max(at, b)
        assert redacted[i] == "".join(out) + whole[at:]


def test_rounds_go_on_until_nothing_is_found(spark):
    """A chain of contexts: each has 24 known identifiers, the unknown one of the context before, and one
    more, which it gives away only once the other is known."""
    rows = [f"plain order {900000 + i} paid" for i in range(300)]
    rows += [f"the seed number {10 + i}.{i}.3.4 here" for i in range(30)] + ["the seed number Q1000 here"]
    for link in range(5):
        values = [f"{10 + i}.{i}.5.{link}" for i in range(24)] + [f"Q{1000 + link}", f"Q{1001 + link}"]
        rows += [f"our item {'abcdefg'[link]}word {v} there" for v in values]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = pii.discovered(pii.base_spans(df, "doc_id", "text")).collect()
    assert {(r.value, r["round"]) for r in found} == {(f"Q{1000 + i}", i + 1) for i in range(6)}
