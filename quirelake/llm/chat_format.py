"""Chat formatting: reply trees to conversations, one text for each chosen root-to-leaf path.

Messages point at the message they reply to. Self-joins that double the reach each round (pointer
jumping) give every message its depth and the sum of scores on its path; leaves are ranked
within their conversation, and going back down the same pointers marks the messages of the chosen
paths, so a path of n messages needs about log2(n) joins and no driver loop over rows. All conversations
go through these rounds, as narrow rows (four numbers, no text) keyed by a message's own number. Every
round is staged in the shared folder, so plans don't double, and only messages still short of their root join.

A turn is written "### <role>: <text></turn>\\n". In roles and texts the backslash, "<" and "#" (in
roles also ":") are replaced by \\b, \\l, \\h and \\c, so no control string can occur inside one and
the original is read back exactly. The loss mask is a list of (start, length) in code points of the
formatted text, one for each assistant text. DataFrame functions only.

Cases: null text or role counts as empty; a null conv_id is a conversation of its own. Rows equal in
everything, or with one msg, are separate turns that follow each other. A message whose parent is missing is a
root; messages on a cycle of replies, and those that reply to one, are on no path. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import staged

END = "</turn>\n"
#: Fixed values of the template: character and code.
CODES = [("\\", "\\b"), ("<", "\\l"), ("#", "\\h")]


def escape(c: Column, role: bool = False) -> Column:
    for plain, code in CODES + [(":", "\\c")] * role:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column, role: bool = False) -> Column:
    for plain, code in reversed(CODES + [(":", "\\c")] * role):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def linear_tree(conversations: DataFrame) -> DataFrame:
    """Messages of conversations stored as rows by turn: each replies to the row before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order)
    return conversations.select("conv_id", n.alias("msg"), F.nullif(n - 1, F.lit(0)).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def numbered(messages: DataFrame) -> DataFrame:
    """messages with node, a number of its own for every row; kept, so that it stays the same."""
    return messages if "node" in messages.columns else staged(messages.withColumn("node", F.monotonically_increasing_id()), "messages")


def paths(messages: DataFrame, per_conversation: int = 1) -> DataFrame:
    """(conv, branch, depth, msg, node) of the best per_conversation branches of every conversation.

    messages: conv_id, msg, parent (null at a root), score, and node if they are numbered. A branch is a leaf's path; the score
    of a branch is the sum of its messages', ties go to the deeper, then to the smaller leaf. Rows with one msg follow each other,
    the first replies to the parent, and what replies to msg replies to the last of them.
    """
    own = numbered(messages.select(*[c for c in ("node", "conv_id", "msg", "parent", "score") if c in messages.columns]))
    copies = Window.partitionBy("conv_id", "msg").orderBy("node")
    nodes = own.select("node", F.col("conv_id").alias("conv"), "msg", "parent", F.coalesce("score", F.lit(0.0)).alias("score"), F.lag("node").over(copies).alias("before"), F.lead("node").over(copies).isNull().alias("last"))
    heads = nodes.filter("last").select(F.col("conv").alias("_c"), F.col("msg").alias("_m"), F.col("node").alias("_up"))
    met = F.col("conv").eqNullSafe(F.col("_c")) & F.col("before").isNull() & (F.col("parent") == F.col("_m"))
    nodes = staged(nodes.join(heads, met, "left").select("conv", "msg", "node", F.coalesce("before", "_up").alias("up"), "score"), "nodes")
    #: In round k a message knows its 2**k-th ancestor and joins that one's row, for twice the reach, until all are at their roots.
    hops = []
    hop = nodes.select("node", "up", F.col("score").alias("total"), F.lit(1).alias("depth"))
    most = nodes.groupBy("conv").count().agg(F.max("count")).first()[0] or 1
    for _ in range(max(1, (most - 1).bit_length() + 1)):  # those still short of a root then reply to each other in a circle
        still = hop.filter("up is not null")
        hops.append(still.select("node", F.col("up").alias("to")))
        far = hop.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("total").alias("_t"), F.col("depth").alias("_d"))
        next_ = still.join(far, "up").select("node", F.col("_up").alias("up"), (F.col("total") + F.col("_t")).alias("total"), (F.col("depth") + F.col("_d")).alias("depth"))
        hop = staged(next_.unionByName(hop.filter("up is null")), "hop")
        if hop.filter("up is not null").isEmpty():
            break
    done = hop.filter("up is null").select("node", "total", "depth")
    replied = nodes.filter("up is not null").select(F.col("up").alias("node")).distinct()
    leaves = nodes.select("conv", "msg", "node").join(replied, "node", "left_anti").join(done, "node")
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("total"), F.desc("depth"), "msg", "node"))
    on = staged(leaves.withColumn("branch", rank).filter(F.col("branch") <= per_conversation).select("conv", "branch", "node", "depth"), "paths")
    for k in reversed(range(len(hops))):
        above = on.join(hops[k], "node").select("conv", "branch", F.col("to").alias("node"), F.col("depth") - 2**k)
        on = staged(on.union(above), "paths")
    return on.join(nodes.select("node", "msg"), "node").select("conv", "branch", "depth", "msg", "node")


def format_paths(messages: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row for each chosen path: conv_id, branch, formatted, mask (start and length in code points)."""
    if "node" in messages.columns:
        full = messages.select("node", "role", "text").join(chosen, "node")
    else:  # rows with one msg are told apart by their order
        places = chosen.withColumn("_copy", F.row_number().over(Window.partitionBy("conv", "branch", "msg").orderBy("depth")))
        copies = messages.withColumn("_copy", F.row_number().over(Window.partitionBy("conv_id", "msg").orderBy("role", "text")))
        copies = copies.select(F.col("conv_id").alias("_c"), F.col("msg").alias("_m"), F.col("_copy").alias("_k"), "role", "text")
        full = places.join(copies, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("msg") == F.col("_m")) & (F.col("_copy") == F.col("_k")))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(F.col("depth"), F.concat(F.lit("### "), escape(role, role=True), F.lit(": ")).alias("head"), escape(text).alias("body"), (role == "assistant").alias("loss"))
    rows = full.groupBy("conv", "branch").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask"))

    def add(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["head"])
        own = F.array(F.struct(start.alias("start"), F.length(t["body"]).alias("length")))
        return F.struct((start + F.length(t["body"]) + len(END)).alias("at"), F.when(t["loss"], F.concat(acc["mask"], own)).otherwise(acc["mask"]).alias("mask"))

    return rows.select(F.col("conv").alias("conv_id"), "branch", whole.alias("formatted"), F.aggregate("turns", zero, add)["mask"].alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns (role, text) and loss_texts, both taken from the text and the mask alone."""
    parts = F.filter(F.split(F.col("formatted"), END), lambda x: x != "")

    def turn(x: Column) -> Column:
        cut = F.instr(x, F.lit(": "))
        return F.struct(unescape(F.substr(x, F.lit(5), cut - 5), role=True).alias("role"), unescape(F.substr(x, cut + 2)).alias("text"))

    loss = F.transform("mask", lambda m: unescape(F.substr(F.col("formatted"), m["start"] + 1, m["length"])))
    return formatted.withColumns({"turns": F.transform(parts, turn), "loss_texts": loss})


def digest(conversations: DataFrame) -> DataFrame:
    """The digest columns of every conversation, read back from its formatted text."""
    messages = numbered(linear_tree(conversations))
    out = read_back(format_paths(messages, paths(messages)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
