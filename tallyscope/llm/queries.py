"""The registered queries of this subpackage, each over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm import bpe, chat, exact, language, lexical, lm, merkle, minhash, packing, pii, quality, sharding, simhash


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from the formatted conversations, plus one that says control strings."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    done = chat.conversations_of_trees(chat.threads(turns.unionByName(extra)))
    back = done.select(
        F.col("tree").alias("conv_id"), "formatted",
        chat.turns_of(F.col("formatted")).alias("turns"),
        F.array_join(chat.texts_under(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
    )
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(text, '([\[<])(\\*)(/?INST\]|/?s>)', '\1\\\2\3', 'g') AS body,
         regexp_replace(role, '([\[<])(\\*)(/?INST\]|/?s>)', '\1\\\2\3', 'g') AS head FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    sum(length('[INST]' || head || '[/INST]' || body || '</s>')) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""


def _remainder(of: int) -> Column:
    """crc32 of the id as text, modulo a number (a null id as an empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those of other remainders than 2."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = _remainder(4) == 2
    return language.with_language(docs, ~held_out).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(n) for n in pii.NAMES])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ","
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    found = pii.find_pii(_documents(spark, sf_dir))

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(i).alias(f"n_{k.name}") for i, k in enumerate(pii.KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(_listed("spans"), 256).alias("base_sha256"), _listed("all_spans").alias("spans")
    )


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, learned from those of other remainders than 2."""
    return lm.score_texts(_documents(spark, sf_dir), _remainder(7) != 2).select(
        "doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to 40 shards by the permutation of their row numbers."""
    return sharding.shard_rows(_documents(spark, sf_dir), 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in sequences of 1024 tokens."""
    return packing.pack(
        packing.pieces(
            _documents(spark, sf_dir),
            public_tokenizers.path("byte_bpe_50k.json"),
            public_tokenizers.path("byte_bpe_50k.tiktoken"),
            public_tokenizers.PATTERN,
        )
    )


def op8_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of what they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_texts(_documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    return bpe.decode_ids(encoded, ranks).select(
        "doc_id",
        F.expr("octet_length(ids) DIV 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document and whether the rules keep it."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    m = quality.quality_rules(docs).drop("text")
    base = (F.col("m.n_words") < 50) | (100 * F.col("m.n_repeat_words") > 50 * F.col("m.n_words"))
    return m.select(
        "doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words",
        base.alias("base_failed"), (~base & F.col("passed")).alias("kept"),
    )


OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, [x FOR x IN regexp_split_to_array(text, '[ \t-\r]+') IF x <> ''] AS words,
    [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^ \t-\r]')] AS lines FROM d),
tri AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM tri),
cov AS (
  SELECT doc_id, sum(least(3, coalesce(nxt - i, 3))) AS n_repeat_words FROM (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM win WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[ \t-\r]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(len([x FOR x IN words IF lower(x) IN (STOP)]) AS BIGINT) AS n_stop_words
  FROM w LEFT JOIN cov ON w.doc_id IS NOT DISTINCT FROM cov.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND RULES AS kept FROM b
"""


def _rules_in_sql() -> str:
    ratios = {
        "mean_word_chars": "word_chars / n_words",
        "symbols_per_word": "n_symbols / n_words",
        "stop_words_per_word": "n_stop_words / n_words",
        "dup_lines_per_line": "n_dup_lines / n_lines",
        "repeat_words_per_word": "n_repeat_words / n_words",
    }
    tests = []
    for rule in quality.RULES:
        value = ratios[rule.measure]
        tests += [f"{value} >= {rule.least}"] if rule.least is not None else []
        tests += [f"{value} <= {rule.most}"] if rule.most is not None else []
    return " AND ".join(tests)


OP9_SQL = OP9_SQL.replace("STOP", ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))).replace(
    "RULES", _rules_in_sql()
)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents."""
    return exact.duplicate_groups(_documents(spark, sf_dir))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    regexp_replace(coalesce(text, ''), '[ \t-\r]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""



def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return lexical.search_items(_documents(spark, sf_dir), items, 50)


OP11_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
d AS (SELECT r, doc_id, len(terms) AS n FROM words WHERE len(terms) > 0),
total AS (SELECT count(*) AS n_docs, sum(n) AS n_terms FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM words) GROUP BY r, term),
items AS (
  SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms FROM benchmark),
asked AS (SELECT q, item_id, unnest(terms) AS term FROM items),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf CROSS JOIN total WHERE term IN (SELECT term FROM asked) GROUP BY term, n_docs),
scored AS (
  SELECT q, item_id, r, doc_id, CAST(sum(w * (1000000000 * tf // (
    1000 * tf + 20 * (100 - 50 + CAST(50 * n * n_docs // n_terms AS BIGINT))))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN d USING (r) CROSS JOIN total
  GROUP BY q, item_id, r, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; for ids with an even checksum a text without line ends is folded."""
    docs = _documents(spark, sf_dir)
    tampered = F.when(_remainder(2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.manifest(docs, claimed={"text": tampered}).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )


#: The checksum is computed bit by bit; trees grow level by level, and proofs are folded step by step.
OP12_SQL = r"""
WITH RECURSIVE
bits(i, c, k) AS (
  SELECT i, i, 0 FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
ids AS (SELECT DISTINCT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS s FROM documents),
crc(doc_id, s, k, c) AS (
  SELECT doc_id, s, 0, CAST(4294967295 AS BIGINT) FROM ids
  UNION ALL
  SELECT doc_id, s, crc.k + 1, xor(crc.c >> 8, b.c) FROM crc
  JOIN (SELECT i, c FROM bits WHERE k = 8) b ON b.i = xor(crc.c & 255, ascii(substr(s, crc.k + 1, 1)))
  WHERE crc.k < length(s)),
even AS (SELECT doc_id, xor(c, 4294967295) % 2 = 0 AS tampered FROM crc WHERE k = length(s)),
d AS (
  SELECT d.doc_id, coalesce('=' || source, '') AS tree,
    HEAD || coalesce(strlen(text) || ':' || text, '-') AS whole,
    CASE WHEN tampered THEN HEAD || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')
      ELSE HEAD || coalesce(strlen(text) || ':' || text, '-') END AS other
  FROM documents d JOIN even e ON d.doc_id IS NOT DISTINCT FROM e.doc_id),
l AS (
  SELECT row_number() OVER () AS r, doc_id, tree, sha256(whole) AS leaf, sha256(other) AS claimed FROM d),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY tree) AS n FROM l),
up(tree, lvl, i, n, h) AS (
  SELECT tree, 0, i, n, leaf FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM up
  WHERE n > 1 GROUP BY tree, lvl, i // 3, n),
subs AS (
  SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top(lvl, i, n, h) AS (
  SELECT 0, i, n, subroot FROM subs
  UNION ALL
  SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top
  WHERE n > 1 GROUP BY lvl, i // 3, n),
runs AS (SELECT tree, lvl, i // 3 AS up, list(h ORDER BY i) AS run FROM up WHERE n > 1 GROUP BY tree, lvl, i // 3),
top_runs AS (SELECT lvl, i // 3 AS up, list(h ORDER BY i) AS run FROM top WHERE n > 1 GROUP BY lvl, i // 3),
steps AS (
  SELECT r, lvl, (leaves.i // CAST(power(3, lvl) AS BIGINT)) % 3 AS slot, run FROM leaves JOIN runs
    ON leaves.tree = runs.tree AND up = leaves.i // CAST(power(3, lvl + 1) AS BIGINT)
  UNION ALL
  SELECT r, 1000 + lvl, (subs.i // CAST(power(3, lvl) AS BIGINT)) % 3, run FROM leaves
    JOIN subs ON leaves.tree = subs.tree
    JOIN top_runs ON up = subs.i // CAST(power(3, lvl + 1) AS BIGINT)),
numbered AS (
  SELECT r, row_number() OVER (PARTITION BY r ORDER BY lvl) AS k,
    array_to_string(run[1:slot], '') AS before, array_to_string(run[slot + 2:], '') AS after FROM steps),
proofs AS (SELECT r, max(k) AS steps, sha256(string_agg(before || after, '' ORDER BY k)) AS proof FROM numbered GROUP BY r),
fold(r, k, h) AS (
  SELECT r, 0, claimed FROM leaves
  UNION ALL
  SELECT fold.r, fold.k + 1, sha256(before || h || after) FROM fold
  JOIN numbered ON numbered.r = fold.r AND numbered.k = fold.k + 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM leaves JOIN subs ON leaves.tree = subs.tree CROSS JOIN (SELECT h AS root FROM top WHERE n = 1)
LEFT JOIN proofs ON proofs.r = leaves.r JOIN fold f ON f.r = leaves.r AND f.k = coalesce(steps, 0)
"""
OP12_SQL = OP12_SQL.replace(
    "HEAD",
    " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("d.doc_id", "source", "lang", "n_chars")),
)


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document by shingles of five words at a similarity of 0.85."""
    return minhash.similar_groups(_documents(spark, sf_dir))


OP13_SQL = r"""
WITH RECURSIVE
w AS (
  SELECT row_number() OVER () AS r, doc_id, [x FOR x IN regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+') IF x <> ''] AS words
  FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (
  SELECT a.r AS a, b.r AS b, count(*) AS n_both FROM s a JOIN s b ON a.shingle = b.shingle AND a.r < b.r GROUP BY a.r, b.r),
links AS (
  SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(r, t) AS (SELECT r, r FROM w UNION SELECT reach.r, edges.b FROM reach JOIN edges ON edges.a = reach.t),
best AS (SELECT reach.r, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = reach.t GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(doc_id = component_id, false) AS kept
FROM w JOIN best ON best.r = w.r LEFT JOIN n ON n.r = w.r
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_language_id": op2_language_id,
    "op3_pii": op3_pii,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_context_tree": op5_context_tree,
    "op6_feistel_shards": op6_feistel_shards,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_prefix_bpe": op8_prefix_bpe,
    "op9_quality_rules": op9_quality_rules,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_minhash_near_dedup": op13_minhash_near_dedup,
}
SQL: dict[str, str] = {
    "op1_chat_formatting": OP1_SQL,
    "op9_quality_rules": OP9_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_minhash_near_dedup": OP13_SQL,
}
