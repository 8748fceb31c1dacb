"""Chat formatting of reply trees (operator 6); DataFrame functions only.

Messages (conv_id, msg_id, parent_id, role, text, score) form trees. Self-joins double the steps upwards, so each message
knows its ancestors 1, 2, 4, ... steps above; going up from the leaves by these jumps lists every branch's messages, in as
many rounds as the binary digits of the greatest depth. A message leaves the rounds when it has no ancestor so far up, and
paths are rows of identifiers, as many as the branches have messages. Branches are ranked within a conversation by their
mean score; each chosen branch becomes one formatted string with the character spans that carry loss. Texts are joined to
the chosen branches only.

Template: each turn is ``<s>``, role, newline, text, ``</s>``. Control strings (``<s> </s> [INST] [/INST] <<SYS>>
<</SYS>>``) inside a text or role get one backslash after their first character, and those that have backslashes there
get one more, so that reading back removes exactly one. Backslashes and newlines of a role are written ``\\\\`` and ``\\n``.

Nulls, ties: null text or role is empty; null score is 0. A message whose parent is missing is a root. Messages in a
cycle have no root and are left out. Equal scores: the branch with the smaller leaf id first. In ``linear`` rows of one
turn are ordered by role, then text, and repeated rows are turns of their own. Null conversation ids are one conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import cut

#: Where a backslash goes: after the first character of a control string, and of one that has backslashes there.
ESCAPE = r"(?<=<)(?=\\*(?:/?s>|</?SYS>>))|(?<=\[)(?=\\*/?INST\])"
UNESCAPE = r"(?<=<)\\(?=\\*(?:/?s>|</?SYS>>))|(?<=\[)\\(?=\\*/?INST\])"


def escaped(text):
    return F.regexp_replace(text, ESCAPE, r"\\")


def unescaped(text):
    return F.regexp_replace(text, UNESCAPE, "")


def linear(rows: DataFrame) -> DataFrame:
    """Messages of conversations whose rows (conv_id, turn, role, text) follow one another: trees of one branch."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    own = F.row_number().over(order).cast("long")
    return rows.select("conv_id", own.alias("msg_id"), F.nullif(own - 1, F.lit(0)).alias("parent_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0.0).alias("score"))


def same(conversation: str, message: str, other: str = "m"):
    """Join condition: the conversation ``c`` (null is one too) and its message ``other``."""
    return F.col(conversation).eqNullSafe(F.col("c")) & (F.col(message) == F.col(other))


def steps(messages: DataFrame) -> DataFrame:
    """(conv_id, leaf_id, up, node): for every leaf the messages of its branch, ``up`` steps above it."""
    nodes = messages.select("conv_id", "msg_id", "parent_id")
    most = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    parents = nodes.select(F.col("conv_id").alias("c"), F.col("msg_id").alias("m"))
    # jumps[k]: messages and what stands 2^k above them; a message with no such ancestor is in it no more
    jumps = [cut(nodes.where("parent_id is not null").join(parents, same("conv_id", "parent_id"), "left_semi").select("conv_id", "msg_id", F.col("parent_id").alias("above")), "jumps")]
    while not (ended := jumps[-1].isEmpty()) and 1 << (len(jumps) - 1) < most:
        upper = jumps[-1].select(F.col("conv_id").alias("c"), F.col("msg_id").alias("m"), F.col("above").alias("next"))
        jumps.append(cut(jumps[-1].join(upper, same("conv_id", "above")).select("conv_id", "msg_id", F.col("next").alias("above")), "jumps"))
    last = jumps.pop()
    inner = nodes.where("parent_id is not null").select(F.col("conv_id").alias("c"), F.col("parent_id").alias("m")).distinct()
    leaves = nodes.join(inner, same("conv_id", "msg_id"), "left_anti")
    if not ended:  # as many steps up as the largest conversation has messages: these stand in a circle, or below one
        leaves = leaves.join(last.select(F.col("conv_id").alias("c"), F.col("msg_id").alias("m")), same("conv_id", "msg_id"), "left_anti")
    found = cut(leaves.select("conv_id", F.col("msg_id").alias("leaf_id"), F.lit(0).cast("long").alias("up"), F.col("msg_id").alias("node")), "steps")
    # a distance is a sum of distinct powers of two, so taking the greatest jumps first meets each ancestor once
    for k in reversed(range(len(jumps))):
        jump = jumps[k].select(F.col("conv_id").alias("c"), F.col("msg_id").alias("m"), "above")
        more = found.join(jump, same("conv_id", "node")).select("conv_id", "leaf_id", (F.col("up") + (1 << k)).alias("up"), F.col("above").alias("node"))
        found = found.unionByName(cut(more, "steps"))
    return found


def branches(messages: DataFrame) -> DataFrame:
    """(conv_id, leaf_id, path): the message ids from root to leaf, for every leaf."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "node")))
    return steps(messages).groupBy("conv_id", "leaf_id").agg(ordered.alias("path")).select("conv_id", "leaf_id", F.col("path.node").alias("path"))


def formatted(messages: DataFrame, top: int = 1) -> DataFrame:
    """(conv_id, leaf_id, rank, formatted, loss_spans) of the ``top`` branches of each conversation."""
    messages = cut(messages, "messages")
    walked = steps(messages)
    scores = messages.select(F.col("conv_id").alias("c"), F.col("msg_id").alias("m"), F.coalesce("score", F.lit(0.0)).alias("score"))
    means = walked.join(scores, same("conv_id", "node")).groupBy("conv_id", "leaf_id").agg(F.avg("score").alias("score"))
    ranked = means.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf_id"))).where(F.col("rank") <= top)
    chosen = ranked.select(F.col("conv_id").alias("c"), F.col("leaf_id").alias("m"), "rank")
    taken = walked.join(chosen, same("conv_id", "leaf_id")).select("conv_id", "leaf_id", "rank", (-F.col("up")).alias("at"), "node")
    own = messages.select(F.col("conv_id").alias("c"), F.col("msg_id").alias("m"), "role", "text")
    joined = taken.join(own, same("conv_id", "node"))
    role = F.regexp_replace(F.regexp_replace(F.coalesce("role", F.lit("")), r"\\", r"\\\\"), "\n", r"\\n")
    turn = F.struct("at", escaped(role).alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("text"), (F.col("role") == "assistant").alias("loss"))
    whole = joined.groupBy("conv_id", "leaf_id", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    text = F.expr("array_join(transform(turns, t -> concat('<s>', t.role, '\\n', t.text, '</s>')), '')")
    spans = F.expr("""aggregate(turns, named_struct('at', 0, 'spans', cast(array() as array<struct<begin: int, end: int>>)), (a, t) -> named_struct(
        'at', a.at + length(t.role) + length(t.text) + 8,
        'spans', IF(t.loss, concat(a.spans, array(named_struct('begin', a.at + 4 + length(t.role), 'end', a.at + 4 + length(t.role) + length(t.text)))), a.spans)), a -> a.spans)""")
    return whole.select("conv_id", "leaf_id", "rank", text.alias("formatted"), spans.alias("loss_spans"))


def read_back(output: DataFrame) -> DataFrame:
    """The turns (role, text) and the text under the loss mask, from formatted strings."""
    raw = F.regexp_extract_all("formatted", F.lit(r"(?s)<s>(.*?)</s>"), F.lit(1))
    turns = F.transform(raw, lambda t: F.struct(F.regexp_replace(F.regexp_replace(unescaped(F.regexp_extract(t, r"\A([^\n]*)\n", 1)), r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), r"\\\\", r"\\").alias("role"), unescaped(F.regexp_extract(t, r"(?s)\A[^\n]*\n(.*)\z", 1)).alias("text")))
    # a span that ends within a turn is one turn's whole text, so each is unescaped by itself
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring("formatted", s["begin"] + 1, s["end"] - s["begin"]))), "")
    return output.select("conv_id", "leaf_id", "rank", "formatted", turns.alias("turns"), loss.alias("loss"))


def report(rows: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from its formatted string."""
    back = read_back(formatted(linear(rows)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
