"""Chat formatting of reply trees, in DataFrame functions alone.

Messages name their parent. Self-joins that double their reach enumerate the nodes of
every root-to-leaf path, branches are ranked by their messages' scores, and each chosen
path becomes one conversation in a template.

Template, per turn: `<s>`, role, `[INST]`, text, `</s>`. Inside roles and texts `&`, `<`
and `[` are written `&0`, `&1` and `&2`, so no control string can occur there and the
texts can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgauge.llm.store import written

BEGIN, MIDDLE, END = "<s>", "[INST]", "</s>"
ESCAPES = [("&", "&0"), ("<", "&1"), ("[", "&2")]
#: Partial rankings per tree, so that the leaves of one tree do not all meet in one task.
PARTS = 64


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def tree_paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up) of every node on each root-to-leaf path; `up` counts from the leaf.

    `messages` has tree, node, parent. A parent that is null or not in the tree makes its
    node a root; of a repeated node's parents the smallest counts. Nodes on a circle of
    parents, and those whose ancestors lead to one, have no root and so no path; a row
    without a tree or a node is in no tree. Rows grow with the paths' length alone; the
    joins double the reach, so there are as many as the depth has binary digits.
    """
    named = messages.where("tree is not null and node is not null")
    nodes = written(named.groupBy("tree", "node").agg(F.min("parent").alias("parent")), "nodes")
    parents = nodes.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    parents = written(parents, "parents")
    up = nodes.join(parents.withColumnRenamed("node", "parent"), ["tree", "parent"])
    up = up.join(nodes.select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_semi")
    up = written(up.select("tree", "node", F.col("parent").alias("to")), "up")
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    reaches = []
    while 1 << len(reaches) <= largest and not up.isEmpty():
        reaches.append(up)
        twice = up.join(up.select("tree", F.col("node").alias("to"), F.col("to").alias("next")), ["tree", "to"])
        up = written(twice.select("tree", "node", F.col("next").alias("to")), "up")
    # Who has an ancestor further off than the tree has nodes hangs on a circle.
    leaves = nodes.join(parents, ["tree", "node"], "left_anti").join(up, ["tree", "node"], "left_anti")
    paths = written(
        leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths"
    )
    for power, up in enumerate(reaches):
        further = paths.join(up, ["tree", "node"])
        further = further.select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + (1 << power)).alias("up"))
        paths = written(paths.unionByName(further), "paths")
    return paths


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, node, up, rank) of the `branches` best paths of each tree.

    A path's score is the sum of its messages' scores (null counts as 0); of equal scores
    the smaller leaf comes first.
    """
    paths = tree_paths(messages)
    scores = messages.select("tree", "node", F.coalesce("score", F.lit(0)).cast("double").alias("score"))
    scores = scores.groupBy("tree", "node").agg(F.max("score").alias("score"))
    total = paths.join(scores, ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
    total = written(total, "branches")
    best = [F.desc("score"), F.asc("leaf")]
    part = total.withColumn("part", F.pmod(F.xxhash64("leaf"), F.lit(PARTS)))
    ahead = part.withColumn("rank", F.row_number().over(Window.partitionBy("tree", "part").orderBy(*best)))
    ahead = ahead.where(F.col("rank") <= branches)
    chosen = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(*best)))
    chosen = written(chosen.where(F.col("rank") <= branches).select("tree", "leaf", "rank"), "chosen")
    return paths.join(chosen, ["tree", "leaf"])


def format_paths(messages: DataFrame, branches: int = 1, trained: str = "assistant") -> DataFrame:
    """One row per chosen path: tree, leaf, rank, formatted, segments.

    `messages` has tree, node, parent, role, text, score. `segments` are the pieces of
    `formatted` in order, each with its flag in the loss mask: the texts of the trained
    role. Null roles and texts count as empty; of repeated nodes one is used; no messages
    give no rows.
    """
    said = messages.select(
        "tree",
        "node",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).groupBy("tree", "node").agg(F.min(F.struct("role", "text")).alias("said"))
    turns = best_paths(messages, branches).join(said, ["tree", "node"])
    rows = turns.groupBy("tree", "leaf", "rank").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "said"))).alias("turns")
    )

    def pieces(turn: Column) -> Column:
        role, text = turn["said"]["role"], turn["said"]["text"]
        return F.array(
            F.struct(F.concat(F.lit(BEGIN), escaped(role), F.lit(MIDDLE)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(text).alias("text"), (role == trained).alias("loss")),
            F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
        )

    rows = rows.withColumn("segments", F.flatten(F.transform("turns", pieces)))
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return rows.select("tree", "leaf", "rank", formatted.alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """Array of (role, text), read back from a formatted conversation."""
    whole = F.split(formatted, END)
    turns = F.slice(whole, 1, F.size(whole) - 1)

    def parts(turn: Column) -> Column:
        role = F.substring_index(turn, MIDDLE, 1)
        text = F.substr(turn, F.char_length(role) + F.lit(len(MIDDLE) + 1))
        return F.struct(
            unescaped(F.substr(role, F.lit(len(BEGIN) + 1))).alias("role"), unescaped(text).alias("text")
        )

    return F.transform(turns, parts)


def as_trees(conversations: DataFrame) -> DataFrame:
    """Linear conversations (rows by turn) as reply trees in which each turn answers the last."""
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(tree.alias("tree"), "turn", "role", "text")
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select("tree", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digests(conversations: DataFrame) -> DataFrame:
    """Figures of all conversations and of one that consists of control strings."""
    hard = conversations.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(hard)
    messages = written(as_trees(rows), "messages")
    made = written(format_paths(messages), "formatted")
    turns = read_turns(F.col("formatted"))
    loss = unescaped(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    read = made.select("tree", "formatted", turns.alias("turns"), loss.alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.when(F.col("tree") != "", F.col("tree").cast("long")).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = """
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), coded AS (
  SELECT *, length(replace(replace(replace(role, '&', '&0'), '<', '&1'), '[', '&2'))
    + length(replace(replace(replace(text, '&', '&0'), '<', '&1'), '[', '&2')) AS chars
  FROM every
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(13 + chars)::BIGINT AS formatted_chars
FROM coded GROUP BY conv_id
"""
