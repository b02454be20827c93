"""Chat formatting: root-to-leaf paths of reply trees become conversations.

Ancestors are found by self-joins that double the distance each time, so a path of n messages
takes log2(n) rounds. Branches are ranked by score, and the chosen paths are unfolded by the same
distances, largest first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyscope.llm.tables import written

#: The template: [INST]role[/INST]text</s> for each turn. Fixed values of a well-known chat format.
OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
#: Control strings inside a text get a backslash after their first character, those that have
#: backslashes there one more; so no text holds a control string, and nothing is ambiguous.
_CONTROL = "([\\[<])(\\\\*)(/?INST\\]|/?s>)"
_ESCAPED = "([\\[<])\\\\(\\\\*)(/?INST\\]|/?s>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, "$1\\\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the ancestors at distance 1, 2, 4, ..., and of the whole way up for each message.

    Each round joins the table with itself: who stands as far above the one found so far.
    """
    count = nodes.count()
    level = written(
        nodes.select(
            "tree", "id", F.col("parent").alias("up"),
            F.col("score").alias("total"), F.lit(1).alias("length"), F.col("id").alias("top"),
        ),
        "chat-up",
    )
    levels, ended = [], []
    while True:
        live = level.where("up IS NOT NULL")
        levels.append(live.select("tree", "id", "up"))
        if (1 << (len(levels) - 1)) > count or live.isEmpty():
            break
        # Those at the top of their way are only looked up from now on.
        known = level
        for part in ended:
            known = known.unionAll(part)
        above = known.select(
            "tree", F.col("id").alias("up"), F.col("up").alias("further"), F.col("total").alias("more"),
            F.col("length").alias("longer"), F.col("top").alias("higher"),
        ).alias("above")
        ended.append(level.where("up IS NULL"))
        level = written(
            live.alias("here").join(
                above,
                (F.col("here.up") == F.col("above.up")) & F.col("here.tree").eqNullSafe(F.col("above.tree")),
            ).select(
                "here.tree", "id", F.col("further").alias("up"), (F.col("total") + F.col("more")).alias("total"),
                (F.col("length") + F.col("longer")).alias("length"), F.col("higher").alias("top"),
            ),
            "chat-up",
        )
    # Whoever still has someone above after more steps than there are messages stands on a circle.
    ways = level.where("up IS NULL")
    for part in ended:
        ways = ways.unionAll(part)
    return levels[:-1], ways


def conversations_of_trees(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """Format reply trees: one row per chosen root-to-leaf path.

    ``messages`` has tree, id, parent, role, text (strings) and score (double); other columns are
    not read. Result: tree, root, leaf, branch (rank from 1), score, n_turns, formatted, loss_spans
    (array of start and length in code points of ``formatted``: the texts of assistant turns).

    The score of a path is the sum of its messages' scores, null as 0; the ``branches`` best leaves
    of a root stay (None: all), the smaller leaf id first among equals. A null tree is a tree; null
    role or text is empty; a message without a known parent is a root; rows without id are left
    out, as they cannot be replied to; of rows with the same tree and id the one with the smallest
    (parent, role, text) counts; messages on a circle have no root and come in no path. An empty
    table gives an empty result.
    """
    first = F.min(F.struct("parent", "role", "text", "score"))
    kept = messages.where("id IS NOT NULL").groupBy("tree", "id").agg(first.alias("m"))
    rows = written(
        kept.select(
            "tree", "id", "m.parent", F.coalesce("m.role", F.lit("")).alias("role"),
            F.coalesce("m.text", F.lit("")).alias("text"),
            F.coalesce(F.col("m.score").cast("double"), F.lit(0.0)).alias("score"),
        ),
        "chat-messages",
    )
    known = rows.select(F.col("tree").alias("k_tree"), F.col("id").alias("k_id"))
    is_parent = F.col("tree").eqNullSafe(F.col("k_tree")) & (F.col("parent") == F.col("k_id"))
    nodes = rows.select("tree", "id", "parent", "score").join(known, is_parent, "left").select(
        "tree", "id", F.col("k_id").alias("parent"), "score"
    )
    levels, ways = _jumps(nodes)
    replied = rows.select(F.col("tree").alias("k_tree"), F.col("parent").alias("k_id")).distinct()
    is_replied = F.col("tree").eqNullSafe(F.col("k_tree")) & (F.col("id") == F.col("k_id"))
    leaves = ways.join(replied, is_replied, "left_anti")
    rank = F.row_number().over(W.partitionBy("tree", "top").orderBy(F.col("total").desc(), "id"))
    if branches is None:
        leaves = leaves.withColumn("branch", rank)
    else:
        leaves = leaves.withColumn("branch", rank).where(F.col("branch") <= branches)
    path = leaves.select(
        "tree", F.col("id").alias("leaf"), F.col("top").alias("root"), "branch", F.col("total").alias("path_score"),
        F.col("length").alias("turn"), F.col("id").alias("node"),
    )
    for k in reversed(range(len(levels))):
        jump = levels[k].select(F.col("tree").alias("j_tree"), F.col("id").alias("j_id"), "up")
        here = F.col("tree").eqNullSafe(F.col("j_tree")) & (F.col("node") == F.col("j_id"))
        both = F.array(
            F.struct(F.col("node"), F.col("turn")),
            F.struct(F.col("up").alias("node"), (F.col("turn") - (1 << k)).alias("turn")),
        )
        path = (
            path.join(jump, here, "left")
            .withColumn("step", F.explode(both))
            .where("step.node IS NOT NULL")
            .select("tree", "leaf", "root", "branch", "path_score", "step.turn", "step.node")
        )
    said = rows.select(F.col("tree").alias("k_tree"), F.col("id").alias("k_id"), "role", "text")
    here = F.col("tree").eqNullSafe(F.col("k_tree")) & (F.col("node") == F.col("k_id"))
    turns = path.join(said, here).withColumns(
        {
            "head": F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(CLOSE)),
            "body": escaped(F.col("text")),
        }
    )
    one = W.partitionBy("tree", "leaf").orderBy("turn")
    turns = turns.withColumns({"piece": F.concat("head", "body", F.lit(END))}).withColumn(
        "start",
        F.sum(F.length("piece")).over(one.rowsBetween(W.unboundedPreceding, W.currentRow))
        - F.length("body") - len(END),
    )
    span = F.when(
        F.col("role") == "assistant",
        F.struct(F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("length")),
    )
    return (
        turns.groupBy("tree", "leaf")
        .agg(
            F.first("root").alias("root"), F.first("branch").alias("branch"),
            F.first("path_score").alias("score"), F.count("*").alias("n_turns"),
            F.sort_array(F.collect_list(F.struct("turn", "piece", span.alias("span")))).alias("t"),
        )
        .select(
            "tree", "root", "leaf", "branch", "score", "n_turns",
            F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
            F.filter(F.transform("t", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_spans"),
        )
    )


def turns_of(formatted: Column) -> Column:
    """Read a conversation back: array of (role, text), exactly as they went in."""
    pieces = F.split(formatted, END, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), CLOSE, 1)).alias("role"),
            unescaped(F.substr(p, F.locate(CLOSE, p) + len(CLOSE))).alias("text"),
        ),
    )


def texts_under(formatted: Column, spans: Column) -> Column:
    """The texts that a loss mask covers, unescaped, in order."""
    return F.transform(spans, lambda s: unescaped(F.substr(formatted, s["start"].cast("int") + 1, s["length"].cast("int"))))


def threads(turns: DataFrame) -> DataFrame:
    """Messages of plain conversations (conv_id, turn, role, text): each row replies to the one before.

    Rows go by turn (null first), then role and text; a null conv_id is a conversation.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select(
        F.col("conv_id").alias("tree"), F.row_number().over(order).alias("id"), "role", "text"
    ).select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
