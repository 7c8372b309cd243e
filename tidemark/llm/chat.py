r"""Chat formatting of reply trees (operator 12), with DataFrame functions only.

Messages point to what they reply to. Iterative self-joins double the distance that each message's pointer reaches,
and add up depths, scores and lengths on the way; once no pointer is left, each message knows its place in
every path through it. Leaves are ranked by the mean score of their paths, and only the chosen ones' paths are
expanded, by the same pointers from the longest to the shortest: each distance is a sum of them in one way.

A turn is ``<turn ROLE>``, a line break, its text, a line break, ``</turn>`` and a line break; roles are URL-encoded. In
texts ``<turn`` and ``</turn`` get a backslash before them, or one more if there are some, so neither stands in a text as it
stands in a mark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, small, table
from tidemark.operators.ordered import RN, beside, in_ranges, ranked

END = "\n</turn>\n"
HEAD = r"^<turn [^\n>]*>\n"
#: Roles whose texts are learned from.
LEARNED = ("assistant",)
#: Messages that a task orders, and parts in which a tree's leaves are ranked first.
ROWS_PER_RANGE, PARTS = 200_000, 64


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)(\\*+</?turn)", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)\\(\\*+</?turn)", "$1")


def _nodes(messages: DataFrame, learned: Sequence[str]) -> DataFrame:
    """(tree, node, up, score, head, body, loss), written: node numbers messages in order of (tree, id); up is the node that one replies to."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    held = materialise(messages.select("tree", "id", "parent", text("role").alias("role"), text("text").alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    ranges = max(held.sparkSession.sparkContext.defaultParallelism, -(-held.count() // ROWS_PER_RANGE))
    placed = in_ranges(held, [F.asc_nulls_first("tree"), F.asc_nulls_first("id")], ranges).withColumnRenamed("__place", "node")
    first = placed.where("id is not null").groupBy("tree", "id").agg(F.min("node").alias("up")).withColumnRenamed("id", "parent")
    links = beside(placed.where("parent is not null").select("tree", "parent", "node"), small(materialise(first)), ["tree", "parent"]).select("node", "up")
    nodes = placed.join(small(materialise(links)), "node", "left")
    head = F.concat(F.lit("<turn "), F.url_encode("role"), F.lit(">\n"))
    return materialise(nodes.select("tree", "node", "up", "score", head.alias("head"), escaped(F.col("text")).alias("body"), F.col("role").isin(list(learned)).alias("loss")))


def _doubled(nodes: DataFrame) -> list[DataFrame]:
    """(node, up, depth, end, total) with pointers over 1, 2, 4 ... messages; in the last, every path is summed up to its root but for messages in circles."""
    size = F.length("head") + F.length("body") + F.lit(len(END))
    rounds = [nodes.select("node", "up", F.lit(1).cast("long").alias("depth"), size.cast("long").alias("end"), F.col("score").alias("total"))]
    n = nodes.count()
    while 1 << len(rounds) <= 2 * n and rounds[-1].where("up is not null").limit(1).count():
        now = rounds[-1]
        beyond = small(now.select(F.col("node").alias("up"), F.col("up").alias("next"), *[F.col(c).alias(f"up_{c}") for c in ("depth", "end", "total")]))
        further = now.where("up is not null").join(beyond, "up").select("node", F.col("next").alias("up"), *[(F.col(c) + F.col(f"up_{c}")).alias(c) for c in ("depth", "end", "total")])
        rounds.append(materialise(now.where("up is null").unionByName(further)))
    return rounds


def _chosen(nodes: DataFrame, summed: DataFrame, branches: int) -> DataFrame:
    """(tree, node, branch, score): the best leaves of each tree. A tree's leaves are ranked in parts first, so that no task holds all leaves of a hot one."""
    replied = nodes.where("up is not null").select(F.col("up").alias("node")).distinct()
    ends = summed.where("up is null").select("node", (F.col("total") / F.col("depth")).alias("score"))
    leaves = nodes.select("tree", "node").join(ends, "node").join(replied, "node", "left_anti")
    best = [F.desc("score"), F.asc("node")]
    few = leaves.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS))).withColumn("n", F.row_number().over(Window.partitionBy("tree", "part").orderBy(*best))).where(F.col("n") <= branches)
    return few.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(*best)).cast("long")).where(F.col("branch") <= branches).select("tree", "node", "branch", "score")


def format_trees(messages: DataFrame, branches: int = 1, learned: Sequence[str] = LEARNED) -> DataFrame:
    """The ``branches`` best root-to-leaf paths of each tree, one row each: tree, branch, score, formatted, mask.

    ``messages``: tree, id, parent, role, text, score; other columns are left out. A message without a parent, or whose parent isn't
    there, is a root; a tree may have several. Of repeated ids the first takes the replies, the others are leaves. A null tree is a tree,
    a null id a leaf; a null role or text is empty, a null score zero. A branch's score is the mean of its messages' scores; of equal ones the
    first leaf in order of id is the best. Messages in a circle of replies are in no path. ``mask`` has, for each turn in order, [start, end) of its text as
    code points of ``formatted``, and whether it is learned from. A path is one row, so a very long conversation is one long text.
    """
    nodes = _nodes(messages, learned)
    rounds = _doubled(nodes)
    chosen = materialise(_chosen(nodes, rounds[-1], branches))
    paths = chosen.select(F.col("node").alias("path"), "node")
    for pointers in reversed(rounds):
        ahead = small(pointers.where("up is not null").select("node", "up"))
        paths = materialise(paths.unionByName(paths.join(ahead, "node").select("path", F.col("up").alias("node"))))
    places = rounds[-1].where("up is null").select("node", "depth", "end")
    end = F.col("end") - len(END)
    turn = F.struct("depth", F.concat("head", "body", F.lit(END)).alias("text"), F.struct((end - F.length("body")).alias("start"), end.alias("end"), "loss").alias("span"))
    turns = paths.join(places, "node").join(nodes.select("node", "head", "body", "loss"), "node").select("path", turn.alias("turn"))
    whole = turns.groupBy("path").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    named = whole.join(chosen.withColumnRenamed("node", "path"), "path")
    return named.select("tree", "branch", "score", F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("formatted"), F.transform("turns", lambda t: t["span"]).alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` (of format_trees) with what can be read from its texts and masks alone: turns (role, text) and learned, all text under the mask, unescaped.

    Marks are found in the texts; the mask is applied within the turn it falls into, so a long conversation is read once.
    """
    marked = F.split("formatted", END, -1)
    parts = F.slice(marked, F.lit(1), F.size(marked) - 1)
    head = lambda x: F.regexp_extract(x, HEAD, 0)
    role = lambda x: F.url_decode(F.regexp_extract(x, r"^<turn ([^\n>]*)>", 1))
    read = F.transform(parts, lambda x: F.struct(role(x).alias("role"), unescaped(F.substr(x, F.length(head(x)) + 1)).alias("text")))
    # Where a turn begins: at the end of the mark after the text before it.
    begins = F.transform("mask", lambda m, i: F.when(i == 0, 0).otherwise(F.get("mask", i - 1)["end"] + len(END)))
    under = F.filter(F.arrays_zip(parts.alias("part"), "mask", begins.alias("begin")), lambda x: x["mask"]["loss"])
    learned = F.transform(under, lambda x: unescaped(F.substr(x["part"], (x["mask"]["start"] - x["begin"] + 1).cast("int"), (x["mask"]["end"] - x["mask"]["start"]).cast("int"))))
    return formatted.withColumn("turns", read).withColumn("learned", F.array_join(learned, ""))


def as_chain(conversations: DataFrame) -> DataFrame:
    """Conversations as trees without branches: each turn replies to the one before. Turns of one number stand in the order of role and digest of text; null comes first."""
    held = materialise(conversations.select("conv_id", "turn", "role", "text"))
    ranges = max(held.sparkSession.sparkContext.defaultParallelism, -(-held.count() // ROWS_PER_RANGE))
    order = [F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first(F.sha2("text", 256))]
    return ranked(held, ["conv_id"], order, ranges).select(F.col("conv_id").alias("tree"), F.col(RN).alias("id"), F.when(F.col(RN) > 0, F.col(RN) - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op12_reply_tree_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from its formatted text; see ``format_trees``.

    Conversation -7 has two turns that hold control strings.
    """
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"))
    found = read_back(format_trees(as_chain(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = {
    "op12_reply_tree_formatting": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM (VALUES (0), (1)) v(i)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, length('<turn ') + length(url_encode(role)) + 2 + length(regexp_replace(text, '(\\*</?turn)', '\\\1', 'g')) + 9 AS size FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""
}
