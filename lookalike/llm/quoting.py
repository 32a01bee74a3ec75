"""Conversations without quotations, in the order of replies.

A line that begins with ``>`` marks, with or without spaces between them, quotes at the level of their
number. A passage is a run of lines of one level between blank lines, so a quoted paragraph whose lines a
mail program broke anew is the same passage still. Passages and their single lines, for quotes of a part,
are normalised (lower case, one space for white space, no edges) and hashed; each is joined, inside its
conversation, to the latest earlier message whose own text has that passage or line. A message answers the
message that most of its level-one passages come from, then most of its level-one lines, the latest of
those if some are equal; if no level-one quote is found it answers the one its deeper quotes lead to, and
else nothing. Quoted lines are taken out, with a line in front of them that only announces a quote.

The reply order of a conversation is that of the messages' paths, a path being the turns from the message
that opens the thread down to the message itself. Paths are found by pointer doubling, so the number of
joins is the logarithm of the longest thread, and only messages that answer another take part. Passages and
lines that no message quotes are dropped before the join, and repeats of one in a message count once.

Everything is DataFrame operations. Defined results: null and empty texts give an empty text; messages
are told apart by conversation and turn, so rows that share both share their place; a null conv_id or
turn makes no link and a path of its own turn; quotes of later messages, or found nowhere, are taken out
and link nothing; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

QUOTE = r"^[ \t]*>"
MARKS = r"^[ \t]*((?:>[ \t]*)+)"
#: A line that announces a quote: it ends with a colon after a word for writing.
ANNOUNCES = r"(?i)\b(wrote|writes|said|schrieb|a écrit|escribió)\b.{0,80}:\s*$"


def normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[\s\x{A0}]+", " ")))


def level(line: Column) -> Column:
    """Number of quotation marks in front of a line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), r"[ \t]", ""))


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")


def body(text: str) -> Column:
    """The text without quoted lines and their announcements."""
    lines = _lines(text)
    is_quote = lambda x: F.coalesce(x, F.lit("")).rlike(QUOTE)
    own = F.filter(lines, lambda x, i: ~is_quote(x) & ~(x.rlike(ANNOUNCES) & is_quote(F.get(lines, i + 1))))
    return F.when(F.col(text).contains(">"), F.trim(F.concat_ws("\n", own))).otherwise(F.coalesce(F.col(text), F.lit("")))


def units(text: str) -> Column:
    """(level, h, whole) of each passage of the text (whole) and of each of its lines; level 0 is its own text."""
    once = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)  # noqa: E731  (array(x) with a transform over it evaluates x once)
    tagged = F.transform(_lines(text), lambda x: F.struct(level(x).alias("level"), normal(F.regexp_replace(x, MARKS, "")).alias("norm")))

    def starts(lines: Column) -> Column:
        at = lambda i: F.get(lines, i)
        new = lambda i: (i == 0) | (at(i)["norm"] == "") | (at(i - 1)["norm"] == "") | (at(i)["level"] != at(i - 1)["level"])
        return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), new)

    def passages(lines: Column, first: Column) -> Column:
        run = lambda i, k: F.slice(lines, i + 1, F.coalesce(F.get(first, k + 1), F.size(lines)) - i)
        return F.transform(first, lambda i, k: F.struct(F.get(lines, i)["level"].alias("level"), F.array_join(F.transform(run(i, k), lambda x: x["norm"]), " ").alias("norm")))

    def hashes(found: Column, whole: bool) -> Column:
        return F.transform(F.filter(found, lambda x: x["norm"] != ""), lambda x: F.struct(x["level"].alias("level"), F.xxhash64(x["norm"]).alias("h"), F.lit(whole).alias("whole")))

    return once(tagged, lambda lines: F.concat(hashes(once(starts(lines), lambda first: passages(lines, first)), True), hashes(lines, False)))


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn) of the messages that answer another."""
    rows = messages.where("conv_id is not null and turn is not null")
    quoted = rows.where(F.col("text").contains(">")).select("conv_id", "turn", F.inline(F.filter(units("text"), lambda u: u["level"] > 0)))
    quoted = cut(quoted.groupBy("conv_id", "turn", "level", "h").agg(F.max("whole").alias("whole")))
    wanted = quoted.select("conv_id", "h").distinct()
    own = rows.select("conv_id", "turn", F.inline(F.filter(units("text"), lambda u: u["level"] == 0)))
    own = own.select("conv_id", "turn", "h").distinct().join(wanted, ["conv_id", "h"], "left_semi")
    # the latest earlier message with the passage or line: a running maximum over the messages that have or quote it
    marked = own.select("conv_id", "h", "turn", F.col("turn").alias("source"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("boolean").alias("whole")).unionByName(quoted.withColumn("source", F.lit(None).cast("long")))
    earlier = W.partitionBy("conv_id", "h").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    found = marked.withColumn("source", F.max("source").over(earlier)).where("level is not null and source is not null")
    votes = found.groupBy("conv_id", "turn", "source").agg(F.min("level").alias("level"), F.count("*").alias("n"), F.sum((F.col("level") == 1).cast("int")).alias("direct"), F.sum(((F.col("level") == 1) & F.col("whole")).cast("int")).alias("passages"))
    best = votes.groupBy("conv_id", "turn").agg(F.max_by("source", F.struct("passages", "direct", -F.col("level"), "n", "source")).alias("parent_turn"))
    return best


def paths(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, path) of the messages that answer another: turns from the thread's first message."""
    now = cut(parents.select("conv_id", "turn", F.col("parent_turn").alias("above"), F.array("turn").alias("path")))
    while now.where("above is not null").limit(1).count():
        up = now.select("conv_id", F.col("turn").alias("above"), F.col("above").alias("above2"), F.col("path").alias("path2"))
        # a message above that answers nothing itself is the thread's first
        now = cut(
            now.join(up, ["conv_id", "above"], "left").select(
                "conv_id",
                "turn",
                F.col("above2").alias("above"),
                F.when(F.col("above").isNull(), F.col("path")).otherwise(F.concat(F.coalesce("path2", F.array("above")), "path")).alias("path"),
            )
        )
    return now.select("conv_id", "turn", "path")


def unquoted(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parent_turn, path, n_quoted, text) of every message; sorting by conv_id and
    path gives the conversations in reply order."""
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    parents = cut(links(rows))
    placed = parents.join(paths(parents), ["conv_id", "turn"])
    n_quoted = F.when(F.col("text").contains(">"), F.size(F.filter(_lines("text"), lambda x: x.rlike(QUOTE)))).otherwise(0)
    out = rows.join(placed, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "parent_turn", F.coalesce("path", F.array("turn")).alias("path"), n_quoted.cast("long").alias("n_quoted"), body("text").alias("text"))


def reply_order(messages: DataFrame) -> DataFrame:
    """``unquoted`` rows range-sorted by conversation and path, for writing in reading order."""
    rows = unquoted(messages)
    return rows.repartitionByRange("conv_id", "path").sortWithinPartitions("conv_id", "path")
