"""Reply trees to conversations: enumerate, rank and format root-to-leaf paths.

A tree's messages point to their parents. Self-joins double the reach of every
leaf's path in each round (a path of n messages needs log2(n) rounds), branches are
ranked by score, and each chosen path becomes one conversation string with a loss
mask over the assistant's texts. DataFrame functions only.

Template: ``<|begin|>`` then, for each turn, ``<|turn|>ROLE<|text|>TEXT<|end|>``.
Inside roles and texts ``&`` is written ``&amp;`` and ``<`` is written ``&lt;``, so no
text can hold a control string, and reading back is exact.

Defined results
    * null text or role: empty string. Null tree id: a tree of its own.
    * a message whose parent is null or missing is a root; one in a cycle of parents has no root and is left out.
    * null score counts as 0; equal scores rank by leaf id. Repeated message ids within a tree: one of them (smallest role, text) stays.
    * equal turns of a plain conversation go by role, then text; null turns come first.
    * very long texts are formatted whole. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clusterloom.llm.common import cut

BEGIN, TURN, TEXT, END = "<|begin|>", "<|turn|>", "<|text|>", "<|end|>"


def escape(c: Column) -> Column:
    """No control string is left in the result."""
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c: Column) -> Column:
    """What :func:`escape` was given."""
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def linear_tree(turns: DataFrame, *, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """Messages of plain conversations: each turn replies to the one before it."""
    w = Window.partitionBy(conv_col).orderBy(F.col(turn_col).asc_nulls_first(), F.col(role_col), F.col(text_col))
    return turns.select(F.col(conv_col).alias("tree_id"), F.row_number().over(w).cast("long").alias("msg_id"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).select(
        "tree_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score")
    )


def enumerate_paths(nodes: DataFrame) -> DataFrame:
    """``tree, leaf, node, up``: each leaf's path to its root; ``up`` counts steps from the leaf.

    ``nodes`` has ``tree, node, parent`` with one row per message; parents exist or are null.
    """
    leaves = nodes.join(nodes.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti")
    reach = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    hop = nodes.where("parent is not null").select("tree", "node", F.col("parent").alias("above"))
    most = nodes.groupBy("tree").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]  # one number: the largest tree
    step = 1
    while step < most:
        above = hop.select("tree", "node", "above")
        more = reach.join(above, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + step).alias("up"))
        reach = reach.unionByName(more)
        step *= 2
        if step < most:
            far = above.select("tree", F.col("node").alias("above"), F.col("above").alias("above2"))
            hop = hop.join(far, ["tree", "above"]).select("tree", "node", F.col("above2").alias("above"))
            hop, reach = cut(hop, "chat-hop"), cut(reach, "chat-reach")
            if hop.isEmpty():
                break
    return reach


def format_paths(messages: DataFrame, *, top: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """``tree_id, leaf_id, rank, path_score, n_turns, formatted, loss_spans`` of the chosen paths.

    ``messages`` has ``tree_id, msg_id, parent_id, role, text`` and perhaps ``score``. A path's
    score is the sum of its messages' scores; the ``top`` best paths of a tree stay (None: all).
    ``loss_spans`` are code-point ranges of ``formatted``, ends exclusive.
    """
    score = F.col("score").cast("double") if "score" in messages.columns else F.lit(0.0)
    m = messages.select(
        F.coalesce(F.col("tree_id").cast("string"), F.lit("\u0000")).alias("tree"), F.col("tree_id"), F.col("msg_id").alias("node"), F.col("parent_id").alias("parent"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(score, F.lit(0.0)).alias("score"),
    ).where("node is not null")
    first = Window.partitionBy("tree", "node").orderBy("role", "text", F.col("parent").asc_nulls_first())
    m = cut(m.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"), "chat-messages")
    there = m.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_there"))
    nodes = m.select("tree", "node", "parent").join(there, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("_there"), F.col("parent")).alias("parent"))
    paths = enumerate_paths(cut(nodes, "chat-nodes"))

    on_path = paths.join(m.select("tree", "node", "score"), ["tree", "node"])
    scored = on_path.groupBy("tree", "leaf").agg(F.sum("score").alias("path_score"), F.count(F.lit(1)).alias("n_turns"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)

    rows = paths.join(ranked, ["tree", "leaf"]).join(m.drop("score", "parent"), ["tree", "node"])
    seg = rows.withColumn("_role", escape(F.col("role"))).withColumn("_text", escape(F.col("text"))).withColumn("at", F.col("n_turns") - F.col("up"))
    seg = seg.withColumn("_seg", F.concat(F.lit(TURN), "_role", F.lit(TEXT), "_text", F.lit(END)))
    upto = Window.partitionBy("tree", "leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.length("_seg")).over(upto) + len(BEGIN) - len(END)
    seg = seg.withColumn("_stop", stop.cast("long")).withColumn("_start", (F.col("_stop") - F.length("_text")).cast("long"))
    mask = F.when((F.col("role") == loss_role), F.struct(F.col("_start").alias("start"), F.col("_stop").alias("end")))
    turn = F.struct("at", F.col("_seg").alias("seg"), mask.alias("loss"))
    out = seg.groupBy("tree", "leaf").agg(F.first("tree_id").alias("tree_id"), F.first("rank").alias("rank"), F.first("path_score").alias("path_score"), F.first("n_turns").alias("n_turns"), F.sort_array(F.collect_list(turn)).alias("turns"))
    return out.select(
        "tree_id", F.col("leaf").alias("leaf_id"), "rank", "path_score", "n_turns",
        F.concat(F.lit(BEGIN), F.array_join(F.transform("turns", lambda t: t["seg"]), "")).alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["loss"]), lambda x: x.isNotNull()).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The ``role, text`` pairs that a formatted string holds."""
    pieces = F.split(formatted, r"<\|turn\|>")
    pieces = F.slice(pieces, F.lit(2), F.size(pieces))
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(p, TEXT, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text"),
        ),
    )


def op10_chat(spark, sf_dir):
    """All conversations and one of control strings only, formatted and read back."""
    from clusterloom.llm.common import table

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    done = format_paths(linear_tree(turns.unionByName(odd)))
    back = done.withColumn("turns", read_turns(F.col("formatted")))
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.expr("array_join(transform(loss_spans, s -> substring(formatted, cast(s.start + 1 as int), cast(s.end - s.start as int))), '')")
    back = back.withColumn("_loss", unescape(masked))
    return back.select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(plain.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(role, '&', '&amp;'), '<', '&lt;') AS er, replace(replace(text, '&', '&amp;'), '<', '&lt;') AS et FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, 9 + sum(23 + length(er) + length(et)) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
