"""Chat formatting of reply trees; DataFrame functions only.

Messages form trees by ``parent_id``.  The pairs (message, ancestor 2**k above) are
joined with themselves again and again, carrying the sum of the scores between them: after as many joins as
the logarithm of the depth every message knows its path's mean score, at one row a message.  Branches are
ranked by it (then by the smaller leaf); only the paths of chosen leaves are enumerated, by the same pairs, and
each is formatted as one conversation, in time linear in its text.

The template writes ``<|start|>role<|sep|>text<|end|>`` for each turn.  Inside roles and
texts a backslash is doubled and a backslash is put after the first character of
every control string, so none of them survives there; ``unescape`` removes them.

Edges: null role or text counts as empty; null scores as 0; a parent that doesn't
exist makes its message a root; paths that run into a cycle have no root and are left out;
rows with a null tree_id or node_id are left out; equal node ids in a tree count once
(smallest role, text first); extra columns are not read; a conversation is one row, and so is held by one task; an
empty table gives no conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, fixed

#: Control strings that may not survive inside a text (fixed values).
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_FIND = r"(<(?=\||s>|/s>|<SYS>>|</SYS>>)|\[(?=INST\]|/INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _FIND, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """tree_id, node_id, above (the ancestor 2**k above) for each k; and tree_id, node_id, mean_score of every leaf's path.

    nodes: tree_id, node_id, parent_id, score.  What hangs on a cycle has no path.
    """
    own = nodes.select("tree_id", "node_id", "parent_id", "score")
    known = own.select("tree_id", F.col("node_id").alias("parent_id")).withColumn("above", F.col("parent_id"))
    now = cut(own.join(known, ["tree_id", "parent_id"], "left").select("tree_id", "node_id", "above", F.col("score").alias("s"), F.lit(1).cast("long").alias("n")), "reply-jumps")
    levels, nodes_in_all = [now], now.count()
    parents = now.filter("above IS NOT NULL").select("tree_id", F.col("above").alias("node_id")).distinct()
    while not now.filter("above IS NOT NULL").isEmpty() and 2 ** (len(levels) - 1) <= nodes_in_all:
        higher = now.select("tree_id", F.col("node_id").alias("above"), F.col("above").alias("higher"), F.col("s").alias("hs"), F.col("n").alias("hn"))
        going = now.filter("above IS NOT NULL").join(higher, ["tree_id", "above"]).select(
            "tree_id", "node_id", F.col("higher").alias("above"), (F.col("s") + F.col("hs")).alias("s"), (F.col("n") + F.col("hn")).alias("n")
        )
        now = cut(now.filter("above IS NULL").unionByName(going), "reply-jumps")
        levels.append(now)
    leaves = now.filter("above IS NULL").join(parents, ["tree_id", "node_id"], "left_anti")
    return [x.filter("above IS NOT NULL").select("tree_id", "node_id", "above") for x in levels[:-1]], leaves.select("tree_id", "node_id", (F.col("s") / F.col("n")).alias("mean_score"))


def paths(levels: list[DataFrame], leaves: DataFrame) -> DataFrame:
    """tree_id, leaf, node_id, up (steps above the leaf) for every message on the paths of ``leaves`` (tree_id, leaf)."""
    members = leaves.select("tree_id", "leaf", F.col("leaf").alias("node_id"), F.lit(0).cast("long").alias("up"))
    for k, pairs in enumerate(levels):
        more = members.join(pairs, ["tree_id", "node_id"]).select("tree_id", "leaf", F.col("above").alias("node_id"), (F.col("up") + 2**k).alias("up"))
        members = cut(members.unionByName(more), "reply-paths")
    return members


def format_trees(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """One row per chosen path: tree_id, leaf, rank, mean_score, n_turns, formatted, loss_mask.

    nodes: tree_id, node_id, parent_id, role, text, score.  loss_mask: (start, length)
    of every assistant text in ``formatted``, in code points from 0.  branches: how many
    paths of each tree are kept, best first; None for all.
    """
    nodes = nodes.filter(F.col("tree_id").isNotNull() & F.col("node_id").isNotNull()).groupBy("tree_id", "node_id").agg(
        F.min(
            F.struct(
                F.coalesce("role", F.lit("")).alias("role"),
                F.coalesce("text", F.lit("")).alias("text"),
                "parent_id",
                F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
            )
        ).alias("m")
    ).select("tree_id", "node_id", "m.*")
    levels, leaves = jumps(nodes)
    ranked = leaves.withColumnRenamed("node_id", "leaf").withColumn("rank", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("mean_score"), "leaf")))
    if branches is not None:
        ranked = ranked.filter(F.col("rank") <= branches)
    ranked = cut(ranked, "reply-leaves")
    text, role = escape(F.col("text")), escape(F.col("role"))
    told = nodes.select("tree_id", "node_id", (F.col("role") == "assistant").alias("mask"), F.concat(F.lit("<|start|>"), role, F.lit("<|sep|>")).alias("head"), text.alias("text"))
    turns = paths(levels, ranked).join(told, ["tree_id", "node_id"])
    # Where each turn starts: a running sum along the path.
    before = Window.partitionBy("tree_id", "leaf").orderBy(F.desc("up"))
    size = F.length("head") + F.length("text") + len("<|end|>")
    placed = turns.withColumn("start", F.sum(size).over(before) - size + F.length("head"))
    whole = placed.groupBy("tree_id", "leaf").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("down"), F.concat("head", "text", F.lit("<|end|>")).alias("turn"), "mask", F.col("start").cast("int").alias("start"), F.length("text").alias("length")))).alias("turns")
    )
    spans = F.transform(F.filter("turns", lambda t: t["mask"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return whole.join(ranked, ["tree_id", "leaf"]).select(
        "tree_id",
        "leaf",
        "rank",
        "mean_score",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        spans.alias("loss_mask"),
    )


def parse(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    parts = F.filter(F.split(formatted, r"<\|start\|>", -1), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(p, "<|sep|>", 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(p, "<|sep|>", -1), "<|end|>", 1)).alias("text"),
        ),
    )


def with_loss_text(df: DataFrame, name: str = "loss") -> DataFrame:
    """``df`` (with formatted, loss_mask) and all text under the loss mask, unescaped.

    Four bytes a code point make every span a range of bytes, so that none is searched from the start.
    """
    wide = fixed(df, __wide=F.encode("formatted", "UTF-32"))
    part = lambda s: unescape(F.decode(F.substring("__wide", 4 * s["start"] + 1, 4 * s["length"]), "UTF-32"))
    return wide.withColumn(name, F.array_join(F.transform("loss_mask", part), "")).drop("__wide")
