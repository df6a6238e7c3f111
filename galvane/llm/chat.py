"""Chat formatting: reply trees, in DataFrame functions alone.

Messages name the message that they answer. Self-joins by jump pointers, twice as long each round,
list the ancestors of every leaf; a leaf's path is a branch. Branches of a conversation are ranked by
the sum of their messages' scores, and each chosen one is formatted as one conversation.

A turn is written <turn role="...">text</turn> and a line end. In texts & and < become &amp; and
&lt;, in roles the quote too, so no text can hold a mark, and reading back is exact.

Defined results: a null text or role is empty; a message whose parent is null, missing or itself is
a root; scores that are null count 0; of branches that score the same the one with the smaller
leaf goes first; messages with one id in one conversation count once; messages in a ring of
answers, and those that hang off one, have no root and no path and are left out; messages without a
conv_id are one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from galvane.llm.common import written


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def plain(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def role_escaped(role: Column) -> Column:
    return F.replace(escaped(role), F.lit('"'), F.lit("&quot;"))


def role_plain(role: Column) -> Column:
    return plain(F.replace(role, F.lit("&quot;"), F.lit('"')))


def branches(messages: DataFrame, keep: int | None = None) -> DataFrame:
    """conv_id, leaf, branch (rank from 1) and, by step from the leaf, node: paths root to leaf.

    messages: conv_id, node, parent, score, each (conv_id, node) once.
    """
    messages = messages.withColumn("conv_id", F.struct("conv_id"))  # a struct that holds null joins with its like
    known = messages.select("conv_id", F.col("node").alias("parent"))
    hop = messages.where("parent is not null and parent <> node").select("conv_id", "node", "parent").join(known, ["conv_id", "parent"], "left_semi")
    hop = written(hop.select("conv_id", "node", F.col("parent").alias("up")), "hops")
    inner = hop.select("conv_id", F.col("up").alias("node")).distinct()
    leaves = messages.join(inner, ["conv_id", "node"], "left_anti")
    paths = leaves.select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("step"))
    longest = messages.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    jumps = [hop]
    while not jumps[-1].isEmpty():  # rounds: the logarithm of the longest path
        if 1 << len(jumps) - 1 >= longest:  # who still goes on, after more steps than there are messages, goes round
            paths = paths.join(jumps[-1].select("conv_id", F.col("node").alias("leaf")), ["conv_id", "leaf"], "left_anti")
            break
        after = jumps[-1].select("conv_id", F.col("node").alias("up"), F.col("up").alias("top"))
        jumps.append(written(jumps[-1].join(after, ["conv_id", "up"]).select("conv_id", "node", F.col("top").alias("up")), "jumps"))
    reach = 1
    for jump in jumps[:-1]:
        far = paths.join(jump, ["conv_id", "node"]).select("conv_id", "leaf", F.col("up").alias("node"), (F.col("step") + reach).alias("step"))
        paths = written(paths.unionByName(far), "paths")
        reach *= 2
    total = paths.join(messages.select("conv_id", "node", F.coalesce("score", F.lit(0.0)).alias("s")), ["conv_id", "node"])
    ranked = total.groupBy("conv_id", "leaf").agg(F.sum("s").alias("total")).withColumn("branch", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("total"), "leaf")))
    if keep is not None:
        ranked = ranked.where(F.col("branch") <= keep)
    return paths.join(ranked.drop("total"), ["conv_id", "leaf"]).withColumn("conv_id", F.col("conv_id.conv_id"))


def formatted(messages: DataFrame, keep: int | None = None, learn: str = "assistant") -> DataFrame:
    """conv_id, branch, formatted, loss: one row for each chosen branch.

    messages: conv_id, node, parent, score, role, text. loss: (start, length), in code points from
    0, of the texts by the role to be learnt, as they stand in formatted.
    """
    once = messages.withColumn("conv_id", F.struct("conv_id")).withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    once = once.groupBy("conv_id", "node").agg(F.min(F.struct("parent", "score", "role", "text")).alias("m")).select("conv_id", "node", "m.*")
    path = branches(once.select("conv_id", "node", "parent", "score"), keep)
    turn = path.join(once.select("conv_id", "node", "role", "text"), ["conv_id", "node"]).select(
        "conv_id", "branch", F.struct((-F.col("step")).alias("at"), F.concat(F.lit('<turn role="'), role_escaped(F.col("role")), F.lit('">')).alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == learn).alias("learn")).alias("t")
    )
    foot = "</turn>\n"
    all_ = turn.groupBy("conv_id", "branch").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    size = lambda t: F.length(t["head"]) + F.length(t["body"]) + len(foot)
    marks = F.aggregate(
        "ts",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("out")),
        lambda acc, t: F.struct((acc["at"] + size(t)).cast("long").alias("at"), F.when(t["learn"], F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(t["head"])).cast("long").alias("start"), F.length(t["body"]).cast("long").alias("length"))))).otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"],
    )
    return all_.select("conv_id.conv_id", "branch", F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(foot))), "").alias("formatted"), marks.alias("loss"))


def read_back(rows: DataFrame) -> DataFrame:
    """rows with turns (role, text) and learnt, the text under the loss mask, from formatted alone."""
    pieces = F.filter(F.split("formatted", "</turn>\n", -1), lambda x: x != "")
    turns = F.transform(pieces, lambda x: F.struct(role_plain(F.substring_index(F.substring(x, F.lit(13), F.length(x)), '">', 1)).alias("role"), plain(F.substring(x, F.instr(x, '">') + 2, F.length(x))).alias("text")))
    learnt = F.array_join(F.transform("loss", lambda m: plain(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
    return rows.select("*", turns.alias("turns"), learnt.alias("learnt"))


def chains(conversations: DataFrame) -> DataFrame:
    """messages of conversations that are plain sequences: each turn answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def digest(conversations: DataFrame) -> DataFrame:
    """The columns of the query, read back from the formatted conversations."""
    rows = read_back(formatted(chains(conversations)))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
