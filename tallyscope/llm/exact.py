"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts, an external sort places equal texts side
by side, and comparisons of neighbours (whole texts) find the groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyscope.llm.tables import fresh, written

#: Characters of a text that splitters hold; texts alike in them are told apart by hash.
LEAD = 64
#: The characters that do not count, space and U+0009 to U+000D.
IGNORED = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), IGNORED, "")


def _hot_hashes(rows: DataFrame, total: int) -> list[int]:
    """Hashes of texts with more rows than a task should get; at most as many as there are partitions."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy("hash").agg(F.count("*").alias("n"))
    return [r.hash for r in counts.where(F.col("n") >= max(2, -(-total // tasks))).collect()]


def _sorted_groups(docs: DataFrame, id_column: str, text_column: str, payload: bool) -> DataFrame:
    """Neighbours compared: each row with the best of its (text, salt) and their number.

    Salt is zero but for hot texts, whose rows are spread over many splitters.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col(f"`{text_column}`")
    # The text is shuffled once, as it is; keys are made before, the normalised text again after.
    kept = docs.columns if payload else [text_column]
    rows = docs.select(
        F.col(f"`{id_column}`").alias("id"),
        F.length(F.coalesce(text, F.lit(""))).alias("points"),
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        normalised(text).alias("norm"),
    )
    rows = rows.select(
        "id", "points", "row", F.substring("norm", 1, LEAD).alias("lead"), F.xxhash64("norm").alias("hash")
    )
    hot = _hot_hashes(docs.select(F.xxhash64(normalised(text)).alias("hash")), docs.count())
    if hot:
        known = spark.createDataFrame([(h,) for h in hot], "hash long")
        rows = (
            rows.join(F.broadcast(known.withColumn("is_hot", F.lit(True))), "hash", "left")
            .withColumn("hot", F.coalesce("is_hot", F.lit(False)))
            .withColumn(
                "salt",
                F.when(F.col("hot"), F.pmod(F.xxhash64("id", "points"), F.lit(tasks)).cast("int"))
                .otherwise(0),
            )
            .drop("is_hot")
        )
    else:
        rows = rows.withColumns({"hot": F.lit(False), "salt": F.lit(0)})
    order = [F.col("points").desc(), F.col("id").asc_nulls_last()]
    # The sort goes by lead, hash and whole text, so neighbours with equal keys are compared in full.
    # A constant salt must not be a key: Spark drops it from the window, and deals the rows out again.
    keys = ["lead", "hash", "salt"] if hot else ["lead", "hash"]
    group = W.partitionBy(*keys, "norm").orderBy(*order)
    everything = group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        rows.repartitionByRange(*keys)
        .withColumn("norm", normalised(F.col(f"row.`{text_column}`")))
        .withColumns(
            {
                "best": F.first("id").over(everything),
                "size": F.count(F.lit(1)).over(everything),
                "rank": F.row_number().over(group),
            }
        )
        .withColumn("digest", F.sha2("norm", 256))
        .drop("norm", "lead", "hash", *([] if payload else ["row"]))
    )


def duplicate_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space (``IGNORED``); null counts as empty. Of equal
    texts the row with the most code points stays, then the smallest id; a null id comes last. Of
    rows that are alike in id and text one is kept. Empty texts are a group like others. An empty
    table gives an empty result. Other columns are not read.
    """
    found = written(_sorted_groups(docs, id_column, text_column, payload=False), "exact")
    cold = found.where(~F.col("hot")).select(
        "id", F.col("best").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("rank") == 1).alias("kept"), "digest",
    )
    # The parts of a hot text meet by digest: one row per salt, never the rows themselves.
    parts = found.where(F.col("hot") & (F.col("rank") == 1))
    group = W.partitionBy("digest").orderBy(F.col("points").desc(), F.col("id").asc_nulls_last())
    everything = group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    joined = parts.select(
        "digest", "salt",
        F.first("id").over(everything).alias("keep_id"),
        F.sum("size").over(everything).alias("group_size"),
        (F.row_number().over(group) == 1).alias("wins"),
    )
    hot = (
        found.where("hot")
        .join(joined, ["digest", "salt"])
        .select("id", "keep_id", "group_size", (F.col("wins") & (F.col("rank") == 1)).alias("kept"), "digest")
    )
    return cold.unionByName(hot).select(
        F.col("id").alias(id_column), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``duplicate_groups`` keeps, with all their columns."""
    found = _sorted_groups(docs, id_column, text_column, payload=True).where("rank = 1")
    found = written(found.select("row", "hot", "digest", "points", "id"), "exact-kept")
    group = W.partitionBy("digest").orderBy(F.col("points").desc(), F.col("id").asc_nulls_last())
    best = fresh(docs, "rank")
    hot = found.where("hot").withColumn(best, F.row_number().over(group)).where(F.col(best) == 1)
    return found.where("NOT hot").select("row.*").unionByName(hot.select("row.*"))
