"""Chat formatting of reply trees, in DataFrame functions alone.

Messages form trees by their parents. Iterative self-joins double the length of every message's path to the root (so their number grows
with the logarithm of the depth), adding up scores. The leaves of a tree rank their branches by the sum of scores from the root (ties: the smaller leaf);
the chosen leaves mark their paths by walking the doubled links from the longest to the shortest; and each chosen path becomes
one conversation.

A turn is ``### Role:\\n`` text ``\\n</turn>\\n``. Inside roles and texts, ``\\`` becomes ``\\b``, a ``#`` that two more follow ``\\h``, and ``</turn>`` ``\\l/turn>`` (in roles
``:`` becomes ``\\c`` as well), so that no marker occurs inside them and unescaping gives back exactly what was escaped. ``spans`` are the stretches under the loss mask
(code points of the formatted text, end exclusive): the texts of assistant turns.

Joins are on (tree, message), never on trees alone: a tree of many messages is spread over tasks until its path is formatted, which needs one row by its nature.

Nulls and edges: null text and null roles are empty. A parent that is null or missing makes a root. Cycles have no leaf and are left out. Repeated rows (same tree and message) count once
in ``best_paths``: the first by parent, role and text; ``linear`` numbers rows, so that there repeated ones stay. Null trees and messages are left out by ``best_paths``; ``linear`` keeps null conversations as one.
Extra columns play no role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import materialise

END = "</turn>"


def escape(x: Column) -> Column:
    x = F.replace(x, F.lit("\\"), F.lit("\\b"))
    x = F.regexp_replace(x, F.lit("#(?=##)"), F.lit("\\\\h"))
    return F.replace(x, F.lit(END), F.lit("\\l" + END[1:]))


def unescape(x: Column) -> Column:
    """Every backslash of an escaped text starts an escape, and only ``\\b`` yields backslashes; so it is undone last."""
    for code, char in (("\\c", ":"), ("\\h", "#"), ("\\l", "<"), ("\\b", "\\")):
        x = F.replace(x, F.lit(code), F.lit(char))
    return x


def best_paths(messages: DataFrame, n_best: int = 1) -> DataFrame:
    """(tree, leaf, branch, at, role, text): the messages of each chosen path, at = 0, 1, ... from the root. messages: tree, id, parent, role, text, score."""
    order = F.struct(F.col("parent").isNull(), "parent", "role", "text")
    m = messages.where("tree IS NOT NULL AND id IS NOT NULL").groupBy("tree", "id").agg(F.min_by(F.struct("parent", "role", "text", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")), order).alias("m"))
    m = materialise(m.select("tree", "id", "m.*"), "messages")
    ids = m.select("tree", F.col("id").alias("parent"), F.lit(True).alias("known"))
    links = m.join(ids, ["tree", "parent"], "left").select("tree", "id", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("sum"))
    links = materialise(links, "links0")
    # Messages whose path has reached the root are finished; each level joins those that are still on their way.
    finished, live = [links.where("up IS NULL")], links.where("up IS NOT NULL")
    levels = []
    reach = m.count()
    while not live.isEmpty():
        if 1 << len(levels) > reach:  # longer than any path: only cycles are left
            break
        levels.append(live)
        known = live
        for x in finished:
            known = known.unionByName(x)
        known = known.select("tree", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("sum").alias("sum2"))
        far = live.join(known, ["tree", "up"]).select("tree", "id", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("sum") + F.col("sum2")).alias("sum"))
        far = materialise(far, f"links{len(levels)}")
        finished.append(far.where("up IS NULL"))
        live = far.where("up IS NOT NULL")
    top = finished[0]
    for x in finished[1:]:
        top = top.unionByName(x)
    parents = links.where("up IS NOT NULL").select("tree", F.col("up").alias("id")).distinct()
    leaves = top.join(parents, ["tree", "id"], "left_anti")
    best = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.col("sum").desc(), "id"))).where(F.col("branch") <= n_best)
    marked = best.select("tree", F.col("id").alias("leaf"), "branch", "id", (F.col("steps") - 1).alias("at"))
    for k in range(len(levels) - 1, -1, -1):
        jump = levels[k].select("tree", "id", "up")
        # Written at each step: the plan would double with every level otherwise.
        marked = materialise(marked.unionByName(marked.join(jump, ["tree", "id"]).select("tree", "leaf", "branch", F.col("up").alias("id"), (F.col("at") - (1 << k)).alias("at"))), f"marked{k}")
    return marked.join(m.select("tree", "id", "role", "text"), ["tree", "id"]).drop("id")


def formatted(turns: DataFrame, key: list[str], loss_role: str = "assistant") -> DataFrame:
    """key, n_turns, formatted, spans: one row for each conversation. turns: key, at, role, text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit("### "), F.replace(escape(role), F.lit(":"), F.lit("\\c")), F.lit(":\n"))
    turn = F.struct("at", head.alias("head"), escape(text).alias("body"), (role == loss_role).alias("loss"))
    rows = turns.groupBy(*key).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    tail = f"\n{END}\n"
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc, t):
        s = acc["at"] + F.length(t["head"])
        e = s + F.length(t["body"])
        return F.struct((e + len(tail)).alias("at"), F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct(s.alias("start"), e.alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    return rows.select(*key, F.size("turns").cast("long").alias("n_turns"), whole.alias("formatted"), F.aggregate("turns", start, step, lambda a: a["spans"]).alias("spans"))


def parsed(text: Column) -> Column:
    """array<struct<role, text>> of a formatted text: its turns, unescaped."""
    tail = f"\n{END}\n"
    parts = F.split(text, F.lit(tail))
    parts = F.slice(parts, 1, F.size(parts) - 1)
    body = lambda x: F.substring(x, F.instr(x, F.lit(":\n")) + 2, F.length(x))
    return F.transform(parts, lambda x: F.struct(unescape(F.substring(F.substring_index(x, ":\n", 1), 5, F.length(x))).alias("role"), unescape(body(x)).alias("text")))


def masked(text: Column, spans: Column) -> Column:
    """The unescaped text under the mask, stretches joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def linear(conversations: DataFrame) -> DataFrame:
    """Messages of reply trees that are chains: each row replies to the one before it in its conversation, by turn, role and text."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.withColumn("id", F.row_number().over(order).cast("long"))
    return rows.select(F.struct(F.coalesce("conv_id", F.lit(0).cast("long")).alias("conv_id"), F.col("conv_id").isNull().alias("none")).alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
