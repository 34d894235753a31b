"""Chat formatting by quotation linking, in DataFrame operations only.

A line's quote level is the number of ``>`` in front of it. Consecutive lines of
one level above 0 form a quoted passage. A message's own text is what stands at
level 0, without the line that introduces a quotation; passages are without it, too.
Passages, their paragraphs and their lines are normalised (lower case, white space
folded) and hashed, and joined within the conversation with the hashes of earlier
messages' own texts: the whole, each paragraph, each line. A passage comes from the
message that its whole text is found in; else, if parts of at least half its length
are found, from the latest of their messages. A passage of introductions only is none.

A message replies to the latest message that one of its level-1 passages comes
from; of several messages with the same text the earliest is the source. Without
a linked passage it opens a thread. Threads are followed by doubling, so a long
chain takes few rounds. ``(conv_id, thread, turn)`` is the reply order: threads by
their first turn, and no message before the one it answers.

Only messages that quote are exploded into ordered lines; originals are reduced
to one row for each hash before the join; no conversation is gathered in one task.

Defined results: a null text has no own text ("") and quotes nothing; rows with a
null conv_id or turn stand for themselves (thread = turn) and are neither quoted
nor linked; of fully repeated rows one stays; rows that share conv_id and turn are
all kept and answered as one; a very long text is one row until it is split into its
lines; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, written

MARKS = r"^(?:[ \t]*>)+"
INTRODUCTION = r"^On .* wrote:[ \t]*$"
MAX_ROUNDS = 64


def _level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _digest(text: Column) -> Column:
    return F.sha2(_normal(text), 256)


def _own_text(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    own = F.filter(lines, lambda x: ~x.rlike(MARKS) & ~x.rlike(INTRODUCTION))
    return F.trim(F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", ""))


def passages(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, level, passage)`` of each quoted passage of ``messages`` (with ``key`` for each row)."""
    quoting = messages.where(F.col("text").rlike(r"(?m)" + MARKS))
    lines = quoting.select("key", "conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("p", "line"))
    levels = lines.withColumn("level", _level(F.col("line"))).withColumn("line", F.regexp_replace("line", MARKS, ""))
    by_message = Window.partitionBy("key").orderBy("p")
    turned = levels.withColumn("new", (F.col("level") != F.coalesce(F.lag("level").over(by_message), F.lit(-1))).cast("int"))
    runs = turned.withColumn("run", F.sum("new").over(by_message)).where("level > 0")
    said = runs.where(~F.ltrim("line").rlike(INTRODUCTION))
    joined = said.groupBy("key", "run").agg(F.first("conv_id").alias("conv_id"), F.first("turn").alias("turn"), F.first("level").alias("level"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "line"))), lambda x: x["line"]), "\n").alias("passage"))
    return joined.where(_normal(F.col("passage")) != "")


def _parts(passage: Column) -> Column:
    """The whole of a passage, its paragraphs and their lines, by the paragraph's place (-1 for the whole)."""
    filled = lambda parts: F.filter(parts, lambda x: _normal(x) != "")
    part = lambda kind, place, x: F.struct(F.lit(kind).alias("kind"), place.alias("place"), _digest(x).alias("digest"), F.length(_normal(x)).alias("weight"))
    paragraphs = filled(F.split(passage, r"\n[ \t]*\n", -1))
    lines = F.flatten(F.transform(paragraphs, lambda x, i: F.transform(filled(F.split(x, "\n", -1)), lambda y: part("line", i, y))))
    return F.concat(F.array(part("whole", F.lit(-1), passage)), F.transform(paragraphs, lambda x, i: part("paragraph", i, x)), lines)


def sources(quoted: DataFrame, origin: DataFrame) -> DataFrame:
    """``(key, conv_id, turn, level, source)`` of each passage: the turn it comes from, or null."""
    parts = quoted.select("key", "run", "conv_id", "turn", "level", F.explode(_parts(F.col("passage"))).alias("part")).select("key", "run", "conv_id", "turn", "level", "part.*")
    found = parts.join(origin, ["conv_id", "digest"], "left").withColumn("source", F.when(F.col("source_turn") < F.col("turn"), F.col("source_turn")))
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    weight, source = F.col("weight"), F.col("source")
    places = found.groupBy("key", "run", "conv_id", "turn", "level", "place").agg(F.max(of("whole", source)).alias("whole"), F.max(of("paragraph", source)).alias("paragraph"), F.max(of("line", source)).alias("line"), F.sum(of("line", weight)).alias("total"), F.sum(of("line", F.when(source.isNotNull(), weight))).alias("covered"))
    judged = places.withColumn("covered", F.when(F.col("paragraph").isNotNull(), F.col("total")).otherwise(F.col("covered")))
    runs = judged.groupBy("key", "run", "conv_id", "turn", "level").agg(F.max("whole").alias("whole"), F.max(F.coalesce("paragraph", "line")).alias("part"), F.sum("total").alias("total"), F.sum("covered").alias("covered"))
    return runs.select("key", "conv_id", "turn", "level", F.coalesce("whole", F.when(2 * F.col("covered") >= F.col("total"), F.col("part"))).alias("source"))


def originals(messages: DataFrame) -> DataFrame:
    """``(conv_id, digest, source_turn)``: the earliest message with each own text, paragraph or line."""
    whole = F.array(F.col("body"))
    parts = F.array_union(F.array_union(whole, F.split("body", r"\n[ \t]*\n")), F.split("body", "\n"))
    units = F.array_distinct(F.transform(F.filter(parts, lambda x: _normal(x) != ""), _digest))
    return messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", F.explode(units).alias("digest")).groupBy("conv_id", "digest").agg(F.min("turn").alias("source_turn"))


def _threads(replies: DataFrame) -> DataFrame:
    """First turn and distance for each ``(conv_id, turn, reply_to)``, by doubling."""
    at = written(replies.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")))
    for _ in range(MAX_ROUNDS):
        up = at.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("further"), F.col("depth").alias("more"))
        if at.join(up, ["conv_id", "thread"], "left_semi").isEmpty():
            return at
        at = written(at.join(up, ["conv_id", "thread"], "left").select("conv_id", "turn", F.coalesce("further", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    raise RuntimeError("threads did not settle")


def threads(conversations: DataFrame) -> DataFrame:
    """Every message without its quotations, with what it answers and its place in the reply order."""
    own = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role"), F.col("text")).distinct()
    messages = own.withColumn("key", F.sha2(F.concat_ws("\x00", *(F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in ("conv_id", "turn", "role", "text"))), 256)).withColumn("body", _own_text(F.col("text")))
    linked = sources(passages(messages), originals(messages))
    per_message = written(linked.groupBy("key", "conv_id", "turn").agg(F.count("*").alias("n_quotes"), F.count("source").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("source"))).alias("reply_to")))
    replies = per_message.where(F.col("reply_to").isNotNull()).groupBy("conv_id", "turn").agg(F.max("reply_to").alias("reply_to"))
    found = settled(lambda: _threads(replies))
    out = messages.join(per_message.select("key", "n_quotes", "n_linked"), "key", "left").join(replies, ["conv_id", "turn"], "left").join(found, ["conv_id", "turn"], "left")
    zero = F.lit(0).cast("long")
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("body"))
    return out.select("conv_id", F.coalesce("thread", "turn").alias("thread"), "turn", "role", "reply_to", F.coalesce("depth", zero).alias("depth"), F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"), F.col("body").alias("text"), formatted.alias("formatted"))


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """The messages of ``threads`` in reply order, range-partitioned by conversation, thread and turn."""
    return threads(conversations).orderBy("conv_id", "thread", "turn")
