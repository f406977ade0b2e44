"""Chat formatting: reply trees, with DataFrame functions only.

``reply_paths`` enumerates all root-to-leaf paths by iterative self-joins: a table of jumps (a node's
2^k-th ancestor) is joined with itself to double k, and the paths found so far with the jumps to
double their reach, so a tree of depth d takes log2(d) rounds and every (leaf, ancestor) pair is made
once. ``rank_paths`` ranks the branches of each tree by their mean score. ``format_paths`` renders
each chosen path as one conversation with a loss mask; ``parse_turns`` and ``loss_text`` read it back.

Template, per turn: ``<s>[INST]`` role, line feed, text, ``[/INST]</s>`` and a line feed. Inside texts
and roles a backslash is doubled and the four control strings get one after their first character, so
none can occur there and the rewriting can be undone; in roles a line feed becomes ``\\n``.

Defined cases: a null text or role is empty; rows of one conversation at the same turn follow each
other by role and text; repeated rows are turns like others; a null conversation id is one
conversation of its own; a parent that does not exist makes its child a root; nodes on a cycle, and
those that hang on one, are on no path; an empty table gives an empty result. Other columns are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

# fixed values: the control strings of the template
OPEN, CLOSE = "<s>[INST]", "[/INST]</s>\n"
_CONTROL = r"([<\[])(?=/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(?=/?(?:s>|INST\]))"


def escape(c):
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescape(c):
    return F.replace(F.regexp_replace(c, _ESCAPED, "$1"), F.lit("\\\\"), F.lit("\\"))


def escape_role(c):
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c):
    plain = F.regexp_replace(c, _ESCAPED, "$1")
    parts = F.transform(F.split(plain, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def reply_paths(nodes: DataFrame, label: str = "reply-paths") -> DataFrame:
    """(tree, leaf, node, up): the nodes of every root-to-leaf path; ``up`` counts from the leaf.

    ``nodes``: (tree, node, parent), (tree, node) unique, parent null at a root.
    """
    ids = nodes.select("tree", "node", "parent")
    known = ids.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    links = ids.where("parent is not null").join(known, ["tree", "parent"]).select("tree", "node", "parent")
    links = materialize(links, label)
    leaves = ids.join(links.select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti")
    paths = materialize(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), label)
    most = ids.count()
    jumps, step = links.withColumnRenamed("parent", "far"), 1
    while step <= most and not jumps.isEmpty():
        longer = paths.join(jumps, ["tree", "node"]).select("tree", "leaf", F.col("far").alias("node"), (F.col("up") + step).alias("up"))
        paths = materialize(paths.union(longer), label)
        onward = jumps.select("tree", F.col("node").alias("far"), F.col("far").alias("farther"))
        jumps = materialize(jumps.join(onward, ["tree", "far"]).select("tree", "node", F.col("farther").alias("far")), label)
        step *= 2
    if not jumps.isEmpty():  # a cycle: only leaves whose walk ends at a root have paths
        ended = paths.join(links, ["tree", "node"], "left_anti").select("tree", "leaf").distinct()
        paths = paths.join(ended, ["tree", "leaf"], "left_semi")
    return paths


def rank_paths(paths: DataFrame, scores: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, score, rank): the ``keep`` best branches of each tree by mean score, ties by leaf.

    The window keeps at most ``keep`` rows of a tree in each task before it shuffles.
    """
    scored = paths.join(scores, ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    w = W.partitionBy("tree").orderBy(F.col("score").desc_nulls_last(), F.col("leaf"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def format_paths(paths: DataFrame, turns: DataFrame) -> DataFrame:
    """(tree, leaf, formatted, loss): ``loss`` holds (start, length) in code points of ``formatted``.

    ``turns``: (tree, node, role, text). A conversation is one string, so its turns meet in one row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = turns.select("tree", "node", F.concat(F.lit(OPEN), escape_role(role), F.lit("\n")).alias("head"), escape(text).alias("body"), (role == "assistant").alias("learn"))
    grouped = paths.join(told, ["tree", "node"]).groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "head", "body", "learn"))).alias("turns"))
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)).cast("long").alias("at"),
            F.when(t["learn"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(t["head"])).cast("long").alias("start"), F.length(t["body"]).cast("long").alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return grouped.select("tree", "leaf", F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"), spans["spans"].alias("loss"))


def parse_turns(formatted):
    """Array of (role, text), read back from a formatted conversation."""
    parts = F.split(formatted, r"\[/INST\]</s>\n")
    bodies = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p)))
    head = lambda p: F.substring_index(p, "\n", 1)
    return F.transform(bodies, lambda p: F.struct(unescape_role(head(p)).alias("role"), unescape(F.substring(p, F.length(head(p)) + 2, F.length(p))).alias("text")))


def loss_text(formatted, loss):
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def chains(df: DataFrame, tree: str, turn: str) -> DataFrame:
    """Linear conversations as reply trees: each row replies to the one before it."""
    rows = df.select(F.col(tree).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("null")).alias("tree"), F.col(turn).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    at = F.row_number().over(W.partitionBy("tree").orderBy("turn", "role", "text"))
    numbered = rows.withColumn("node", at.cast("long"))
    return numbered.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(1.0))


def conversations_formatted(df: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(tree id, formatted, loss): every conversation's best branch as one formatted string."""
    nodes = materialize(chains(df, tree, turn), "reply-nodes")
    paths = reply_paths(nodes)
    best = rank_paths(paths, nodes.select("tree", "node", "score")).select("tree", "leaf")
    done = format_paths(paths.join(best, ["tree", "leaf"], "left_semi"), nodes.select("tree", "node", "role", "text"))
    ids = nodes.where("parent is null").select("tree", F.col("id").alias(tree))
    return done.join(ids, "tree").select(tree, "formatted", "loss")


def op4_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = conversations_formatted(rows)
    read = out.select("conv_id", "formatted", parse_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("learnt"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, 9 + length(role) + 1 + length(text) + 12 + length(regexp_replace(text, '[^\\]', '', 'g')) + len(regexp_extract_all(text, '</?s>|\[/?INST\]')) AS size FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
