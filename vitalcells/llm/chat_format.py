"""Conversations from trees of replies, formatted with a chat template.

Every path from a root to a leaf is one conversation. Ancestors 1, 2, 4, ... steps up come from
repeated self-joins; each leaf then meets all its ancestors by the binary digits of their distance, so
a path of n messages takes about 2 log n joins. The paths of a tree are ranked by their mean score,
and the best ones are formatted.

The template writes a turn as `### role:`, the text and `</turn>`, each on a line of its own. Inside
roles and texts the characters those marks are made of are written as a backslash and a letter, so no
text can close or open a turn, and reading back is exact. Everything is DataFrame work.

Defined results: a null role or text is an empty one; rows without a conversation id are one
conversation with a null id; rows of the same turn (repeated rows too) follow each other by role and
text, null turns come last. A parent that is null or not in the tree makes a root; messages that are
their own ancestors have no root and are left out.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalcells.llm.scratch import Scratch

OPEN, CLOSE = "### ", "</turn>\n"
ASSISTANT = "assistant"
#: Characters of the marks, and what stands for them inside texts. The first must stay first.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"), ("\n", "\\n"))


def _replaced(column: Column, pairs) -> Column:
    for old, new in pairs:
        column = F.replace(column, F.lit(old), F.lit(new))
    return column


def escaped(column: Column, pairs=ESCAPES) -> Column:
    return _replaced(column, pairs)


def unescaped(column: Column, pairs=ESCAPES) -> Column:
    return _replaced(column, [(new, old) for old, new in reversed(pairs)])


def ancestors(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """Each leaf with itself and every message above it: tree, leaf, message, distance."""
    known = messages.select("tree", F.col("message").alias("parent"))
    links = messages.select("tree", "message", "parent").join(known, ["tree", "parent"], "left_semi")
    up = [scratch.write(links.select("tree", "message", F.col("parent").alias("above")), "up")]
    # A path is no longer than its tree is large; more steps up only turn in circles.
    largest = messages.groupBy("tree").count().agg(F.max("count").alias("n")).first().n or 0
    while 2 ** len(up) < largest:
        last = up[-1]
        next_ = last.join(last.select("tree", F.col("message").alias("above"),
                                      F.col("above").alias("further")), ["tree", "above"])
        up.append(scratch.write(next_.select("tree", "message", F.col("further").alias("above")), "up"))
        if up[-1].isEmpty():
            up.pop()
            break
    parents = up[0].select("tree", F.col("above").alias("message"))
    leaves = messages.join(parents, ["tree", "message"], "left_anti")
    found = leaves.select("tree", F.col("message").alias("leaf"), "message", F.lit(0).alias("distance"))
    for k in range(len(up) - 1, -1, -1):
        step = up[k].select("tree", "message", "above")
        found = found.union(
            found.join(step, ["tree", "message"])
            .select("tree", "leaf", F.col("above").alias("message"), F.col("distance") + 2 ** k))
        if k % 4 == 0 and k:
            found = scratch.write(found, "paths")
    return found


def paths(messages: DataFrame, scratch: Scratch, best: int | None = None) -> DataFrame:
    """Root-to-leaf paths of each tree as turns in order, ranked by mean score.

    messages: tree, message, parent, role, text, score. With `best`, only that many paths a tree.
    """
    above = ancestors(messages, scratch)
    details = messages.select("tree", "message", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))
    rows = scratch.write(above.join(details.select("tree", "message", "score"), ["tree", "message"]), "paths")
    order = Window.partitionBy("tree").orderBy(F.desc("mean_score"), "leaf")
    ranked = (rows.groupBy("tree", "leaf").agg(F.avg("score").alias("mean_score"))
              .withColumn("rank", F.row_number().over(order)))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    chosen = rows.drop("score").join(ranked, ["tree", "leaf"])
    turn = F.struct((-F.col("distance")).alias("at"), "role", "text")
    return (chosen.join(details.drop("score"), ["tree", "message"])
            .groupBy("tree", "leaf", "rank", "mean_score")
            .agg(F.array_sort(F.collect_list(turn)).alias("turns")))


def formatted(turns: DataFrame) -> DataFrame:
    """Adds `formatted` and `loss_spans` (start and length in characters of the assistant's texts)."""
    def head(t):
        return F.concat(F.lit(OPEN), escaped(F.coalesce(t["role"], F.lit("")), ROLE_ESCAPES), F.lit(":\n"))

    def body(t):
        return escaped(F.coalesce(t["text"], F.lit("")))

    parts = F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), body(t).alias("body"),
        F.coalesce(t["role"] == ASSISTANT, F.lit(False)).alias("counts")))
    whole = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n" + CLOSE))), "")
    start = F.struct(F.lit(1).cast("long").alias("at"),
                     F.expr("cast(array() as array<struct<start:bigint,size:bigint>>)").alias("spans"))

    def step(done, p):
        begin, size = done["at"] + F.length(p["head"]), F.length(p["body"]).cast("long")
        span = F.array(F.struct(begin.alias("start"), size.alias("size")))
        return F.struct((begin + size + len("\n" + CLOSE)).alias("at"),
                        F.when(p["counts"], F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    return (turns.withColumn("parts", parts).withColumn("formatted", whole)
            .withColumn("loss_spans", F.aggregate("parts", start, step)["spans"]).drop("parts"))


def read_back(chats: DataFrame) -> DataFrame:
    """Adds `read_turns` (role and text) and `loss_text`, both from the formatted text alone."""
    pieces = F.split("formatted", F.lit("</turn>\n"))
    closed = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(p):
        at = F.instr(p, ":\n")
        role = F.substring(p, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        text = F.substring(p, at + 2, F.length(p) - at - 2)
        return F.struct(unescaped(role, ROLE_ESCAPES).alias("role"), unescaped(text).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescaped(
        F.substring(F.col("formatted"), s["start"].cast("int"), s["size"].cast("int"))))
    return (chats.withColumn("read_turns", F.transform(closed, turn))
            .withColumn("loss_text", F.array_join(loss, "")))


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Turns of each conversation as a tree in which each one replies to the one before."""
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    return (conversations.select(tree.alias("tree"), "turn", "role", "text")
            .withColumn("message", F.row_number().over(order).cast("long"))
            .select("tree", "message", (F.col("message") - 1).alias("parent"), "role", "text",
                    F.lit(0.0).alias("score")))


def format_conversations(conversations: DataFrame, best: int | None = None) -> DataFrame:
    """Formatted conversations: conv_id, turns, formatted, loss_spans."""
    scratch = Scratch(conversations.sparkSession, "chat")
    messages = scratch.write(conversation_messages(conversations), "messages")
    chosen = paths(messages, scratch, best)
    conv_id = F.when(F.col("tree") != "", F.col("tree")).cast("long").alias("conv_id")
    return formatted(chosen).select(conv_id, "rank", "turns", "formatted", "loss_spans")


def digests(chats: DataFrame) -> DataFrame:
    """Counts and digests read back from the formatted texts."""
    lines = F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_back(chats).select(
        "conv_id", F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
