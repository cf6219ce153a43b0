"""Reply trees to formatted conversations.

Messages form trees (each names the message it replies to). Self-joins double the reach of a jump table until it spans the
deepest path, so a path of d messages takes about log2(d) joins. Every leaf ends one path; the score of a path is the sum
of its messages' scores, and the best ``branches`` paths of each conversation are kept. The kept leaves are expanded, again by
doubling, to (leaf, message) rows, joined with the texts and formatted as one conversation each.

Template, one turn per line block::

    ### Role: text </turn>\\n

Texts and roles are escaped, so neither mark can be forged: ``\\`` becomes ``\\\\``, ``###`` becomes ``\\h``, ``</turn>`` becomes ``\\e`` and, in
roles only, ``:`` becomes ``\\c``. A text under the loss mask is that of an assistant, without its mark and the blank before the end mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.staging import staged

# The marks of the template.
OPEN, END, ASSISTANT = "### ", " </turn>\n", "assistant"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("###"), F.lit("\\h"))
    return F.replace(text, F.lit("</turn>"), F.lit("\\e"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape(text: Column) -> Column:
    """Inverse of both; pairs of backslashes are set aside first, so what follows one is never read as a code."""
    parts = F.split(text, F.lit("\\\\\\\\"), -1)
    plain = lambda p: F.replace(F.replace(F.replace(p, F.lit("\\h"), F.lit("###")), F.lit("\\e"), F.lit("</turn>")), F.lit("\\c"), F.lit(":"))
    return F.array_join(F.transform(parts, plain), "\\")


def root_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, branch, depth, node) rows of the best paths.

    ``messages``: tree, node, parent (null at a root), score. Nodes are unique within a tree. A parent that does not exist makes
    its message a root. Branches are ranked by the sum of scores along the path (null counts 0), ties by the smaller leaf. A ring of
    replies has no leaf and no root; its messages are in no path. ``branches=None`` keeps all paths.
    """
    # depth and path score by pointer doubling: (node, up, dist, total) where total covers the dist nodes below `up`
    known = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    base = messages.join(known, (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("n")), "left").select(
        "tree", "node", F.col("n").alias("up"), F.lit(1).alias("dist"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total")
    )
    jump = staged(base, "jump")
    levels = [jump]
    going = jump.where(F.col("up").isNotNull()).count()
    while going:
        above = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("dist").alias("d2"), F.col("total").alias("s2"))
        open_, ended = jump.where(F.col("up").isNotNull()), jump.where(F.col("up").isNull())
        longer = open_.join(above, (F.col("tree") == F.col("t")) & (F.col("up") == F.col("n")), "left").select(
            "tree", "node", F.col("up2").alias("up"), (F.col("dist") + F.coalesce("d2", F.lit(0))).alias("dist"), (F.col("total") + F.coalesce("s2", F.lit(0.0))).alias("total")
        )
        jump = staged(longer.unionByName(ended), "jump")
        levels.append(jump)
        before, going = going, jump.where(F.col("up").isNotNull()).count()
        if going == before:  # a doubling that ends no path: only rings are left
            break
    parents = messages.select("tree", F.col("parent").alias("node")).where("node is not null").distinct()
    leaves = jump.where(F.col("up").isNull()).join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "dist", "total")
    leaves = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf")))
    if branches is not None:
        leaves = leaves.where(F.col("branch") <= branches)
    rows = leaves.select("tree", "leaf", "branch", F.col("dist").alias("depth"), F.col("leaf").alias("node"))
    # a leaf's path is itself and, for each row so far, the node 2^k further up, from the longest jump to the shortest
    for table in reversed(levels[:-1]):
        step = table.where(F.col("up").isNotNull()).select(F.col("tree").alias("t"), F.col("node").alias("n"), "up", "dist")
        met = rows.join(step, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n")), "left")
        pair = F.array(F.struct("depth", "node"), F.struct((F.col("depth") - F.col("dist")).alias("depth"), F.col("up").alias("node")))
        both = F.filter(pair, lambda x: x["node"].isNotNull())
        rows = met.select("tree", "leaf", "branch", F.inline(both))
    return rows


def format_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """One row per kept path: tree, branch, leaf, n_turns, formatted, loss_spans (array of start, length in code points, from 0).

    ``messages``: tree, node, parent, score, role, text. Null role or text counts as empty. A path of one message is formatted too;
    an empty table gives no rows. Extra columns are not read.
    """
    messages = messages.select("tree", "node", "parent", "score", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    paths = root_paths(messages.select("tree", "node", "parent", "score"), branches)
    turns = paths.join(messages.select("tree", "node", "role", "text"), ["tree", "node"]).select(
        "tree",
        "leaf",
        "branch",
        F.struct(
            "depth",
            F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(": ")).alias("head"),
            escape(F.col("text")).alias("body"),
            (F.col("role") == ASSISTANT).alias("loss"),
        ).alias("turn"),
    )
    grouped = turns.groupBy("tree", "leaf", "branch").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    length = lambda t: F.length(t["head"]) + F.length(t["body"]) + len(END)
    ends = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + length(t)).alias("at"),
            F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )["spans"]
    return grouped.select(
        "tree",
        "leaf",
        "branch",
        F.size("turns").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        ends.alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """Turns of a formatted conversation as an array of (role, text), marks taken off and escapes undone."""
    blocks = F.filter(F.split(formatted, F.lit(r" </turn>\n"), -1), lambda b: F.length(b) > 0)

    def turn(block):
        # what stands before the first ": " is the role: a role holds no colon
        head = F.substring_index(block, ":", 1)
        return F.struct(
            unescape(head.substr(F.lit(len(OPEN) + 1), F.length(head))).alias("role"),
            unescape(block.substr(F.length(head) + 3, F.length(block))).alias("text"),
        )

    return F.transform(blocks, turn)


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, cut out of the formatted string and unescaped, in order."""
    return F.transform(spans, lambda s: unescape(formatted.substr(s["start"] + 1, s["length"])))
