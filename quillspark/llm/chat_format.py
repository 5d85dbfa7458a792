"""Reply trees formatted as conversations, with DataFrame functions only.

Messages of a conversation form trees by their parent ids.  Iterative self-joins by pointer doubling enumerate
the root-to-leaf paths: in round k a message learns its 2^k-th ancestor, its depth and the score of its path, so
a chain of n messages takes log2(n) rounds over rows of ids only.  Leaves are ranked by path score, and the jump
tables walked back mark the messages of the chosen paths; texts are joined in once, at the end.

Template: ``<|turn|>role\\nbody<|end|>\\n``.  In roles and bodies ``\\`` becomes ``\\z``, ``<`` ``\\l`` and ``[`` ``\\b``
(in roles a line break ``\\n``), so no control string of this template, nor ``</s>`` or ``[INST]`` of others, occurs
inside a text, and unescaping is exact.  ``loss`` has one entry for each turn: where its body starts (code points,
from 0) and how many of it are trained on, none but for turns of the trained role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

TURN, END = "<|turn|>", "<|end|>\n"


def _swap(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape(text: Column) -> Column:
    return _swap(text, [("\\", "\\z"), ("<", "\\l"), ("[", "\\b")])


def unescape(text: Column) -> Column:
    return _swap(text, [("\\b", "["), ("\\l", "<"), ("\\z", "\\")])


def chosen_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """(conv, leaf, node, depth) for the ``best`` paths of each conv; messages: conv, id, parent, score, keys not null.

    A message without a parent in its conversation is a root.  Ties of score go to the least leaf id; a null
    score is 0.  Messages in or below a cycle are on no path from a root and are left out.
    """
    known = messages.select("conv", F.col("id").alias("anc"))
    edges = messages.filter("parent IS NOT NULL").select("conv", "id", F.col("parent").alias("anc")).join(known, ["conv", "anc"], "left_semi")
    own = messages.select("conv", "id", F.coalesce("score", F.lit(0.0)).alias("total"))
    state = own.join(edges, ["conv", "id"], "left").select("conv", "id", "anc", F.col("anc").isNotNull().cast("int").alias("depth"), "total")
    state = materialise(state, "paths")
    jumps, left = [], state.filter("anc IS NOT NULL").count()
    while left:
        jumps.append(state.filter("anc IS NOT NULL").select("conv", F.col("id").alias("node"), "anc"))
        up = state.select("conv", F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        moved = state.filter("anc IS NOT NULL").join(up, ["conv", "anc"])
        moved = moved.select("conv", "id", F.col("anc2").alias("anc"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("total") + F.col("total2")).alias("total"))
        state = materialise(state.filter("anc IS NULL").unionByName(moved), "paths")
        now = state.filter("anc IS NOT NULL").count()
        if now == left:
            break  # only cycles and what hangs on them is left
        left = now
    rooted = state.filter("anc IS NULL").select("conv", "id", "depth", "total")
    parents = edges.select("conv", F.col("anc").alias("id")).distinct()
    leaves = rooted.join(parents, ["conv", "id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("total").desc(), "id"))
    chosen = leaves.withColumn("rank", rank).filter(F.col("rank") <= best)
    marked = chosen.select("conv", F.col("id").alias("leaf"), F.col("id").alias("node"))
    for jump in reversed(jumps):
        marked = materialise(marked, "marked")  # read twice below: else the plan would double each round
        marked = marked.unionByName(marked.join(jump, ["conv", "node"]).select("conv", "leaf", F.col("anc").alias("node")))
    return marked.join(rooted.select("conv", F.col("id").alias("node"), "depth"), ["conv", "node"])


def format_paths(messages: DataFrame, best: int = 1, trained_role: str = "assistant", conv_col: str = "conv_id", id_col: str = "msg_id", parent_col: str = "parent_id", role_col: str = "role", text_col: str = "text", score_col: str | None = None) -> DataFrame:
    """(conv_id, leaf_id, formatted, loss array<struct<start:long, length:long>>), one row for each chosen path.

    Null texts and roles are empty; a null conversation id is a conversation of its own.  Of rows that repeat an
    id in a conversation, the least (role, text, parent, score) counts; rows with a null message id are left out.
    The unit of output is a conversation, so one conversation's turns meet in one task, sorted.
    """
    conv = F.col(conv_col).cast("long")
    m = messages.select(
        F.coalesce(F.concat(F.lit("c"), conv.cast("string")), F.lit("")).alias("conv"), F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.col(parent_col).cast("long").alias("parent"), (F.col(score_col).cast("double") if score_col else F.lit(0.0)).alias("score"), conv.alias("conv_id"),
    ).filter("id IS NOT NULL")
    ids = m.groupBy("conv", "id").agg(F.min(F.struct("role", "text", "parent", "score", "conv_id")).alias("r")).select("conv", "id", "r.*")
    paths = chosen_paths(materialise(ids.select("conv", "id", "parent", "score"), "messages"), best)
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n"))
    texts = ids.select("conv", F.col("id").alias("node"), "conv_id", F.concat(F.lit(TURN), role, F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == trained_role).alias("trained"))
    turns = paths.join(texts, ["conv", "node"])
    size = F.length("head") + F.length("body") + len(END)
    before = F.coalesce(F.sum(size.cast("long")).over(Window.partitionBy("conv", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.select(
        "conv", "leaf", "conv_id", "depth", F.concat("head", "body", F.lit(END)).alias("piece"), (before + F.length("head")).alias("start"),
        F.when(F.col("trained"), F.length("body")).otherwise(0).cast("long").alias("length"),
    )
    rows = turns.groupBy("conv", "leaf").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("depth", "piece", "start", "length"))).alias("t"))
    return rows.select("conv_id", F.col("leaf").alias("leaf_id"), F.array_join(F.col("t.piece"), "").alias("formatted"), F.arrays_zip(F.col("t.start").alias("start"), F.col("t.length").alias("length")).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, leaf_id, turns array<struct<role, text>>, loss_text) from what ``format_paths`` returns."""
    parts = F.split(F.col("formatted"), "<\\|end\\|>\n")
    parts = F.slice(parts, 1, F.size(parts) - 1)
    line = lambda p: F.locate("\n", p)
    role = lambda p: unescape(F.replace(p.substr(F.lit(len(TURN) + 1), line(p) - len(TURN) - 1), F.lit("\\n"), F.lit("\n")))
    body = lambda p: p.substr(line(p) + 1, F.length(p))
    turns = F.transform(parts, lambda p: F.struct(role(p).alias("role"), unescape(body(p)).alias("text")))
    under = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", "leaf_id", "formatted", turns.alias("turns"), F.array_join(under, "").alias("loss_text"))


def linear(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows by turn as chains: each message replies to the one before it.

    Null turns come first; equal turns are ordered by role and text, and repeated rows stay.
    """
    c = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    c = c.withColumn("msg_id", number)
    return c.select("conv_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text")
