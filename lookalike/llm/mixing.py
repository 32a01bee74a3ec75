"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1]. Integrated, the schedule gives the
source's cumulative demand for words, D_s(t), with D_s(1) its target. The documents of a source stand
in a fixed pseudo-random order and, repeated up to three times, form a tape of words; the copy that
begins at offset x of the tape is needed at the time t where D_s(t) = x, which is its training
position. Copies that begin at or after the target are not taken; the one the target falls into
gives only its leading words. Sorting all copies by position gives the training order.

Everything is DataFrame operations. Tape offsets need a running sum per source; as a source may hold
a third of all rows, the sum is taken in two levels, over about sqrt(rows) buckets of a source and
inside each bucket, so that no task orders a whole source.

Defined results: null text or text without words has size 0 and takes nothing; a null source is a
source, the last in order; rows equal in all columns are separate documents; an empty table gives an
empty result; further columns pass through ``mix`` untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, words

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
#: A source's weight runs linearly from 1 - r to 1 + r over training time, with r in [-MAX_RAMP, MAX_RAMP].
MAX_RAMP = 0.5


def targets(per_source: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Add ``target`` to (source, source_size): shares of the sum of all sizes by the weights 1, 2, 3,
    repeating in order of source, null last, where no target is above ``max_repeats`` times its size.

    Sharing out the excess again and again ends at a common level L with target = min(cap, weight * L).
    In order of cap / weight the capped sources come first, so running sums find L without a loop. The
    unpartitioned windows run over one row per source, after aggregation.
    """
    order = F.col("source").asc_nulls_last()
    fill = W.orderBy((F.col("_cap") / F.col("_w")).asc(), order)
    before, rest = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(W.orderBy(order)) - 1) % len(WEIGHTS) + 1).cast("int"))
    return (
        per_source.withColumn("_w", weight.cast("double"))
        .withColumn("_cap", F.lit(float(max_repeats)) * F.col("source_size"))
        .withColumn("_level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest))
        .withColumn("_free", F.when(F.col("_cap") > F.col("_w") * F.col("_level"), F.col("_level")))
        .withColumn("target", F.least("_cap", F.coalesce(F.col("_w") * F.first("_free", ignorenulls=True).over(fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.col("_cap"))))
        .drop("_w", "_cap", "_level", "_free")
    )


def _tape(docs: DataFrame) -> DataFrame:
    """Add _size, _offset (the words of the source's tape before the document), source_size, target.

    Documents are dealt once, by source and hash bucket; the bucket sums are joined on the same keys.
    """
    n_buckets = math.ceil(math.sqrt(max(1, docs.count())))
    dealt = (
        docs.withColumn("_h", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))))
        .withColumn("_size", n_words("text"))
        .withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
        .withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / 2.0**32 * n_buckets).cast("long"))
    )
    sums = dealt.groupBy("_s", "_b").agg(F.first("source").alias("source"), F.sum("_size").alias("_sum"))
    per_source = targets(sums.groupBy("_s").agg(F.first("source").alias("source"), F.sum("_sum").alias("source_size")))
    earlier = W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("source", "_sum").join(per_source.drop("source"), "_s")
    inner = W.partitionBy("_s", "_b").orderBy("_h", "doc_id", "_size").rowsBetween(W.unboundedPreceding, -1)
    dealt = dealt.withColumn("_in", F.coalesce(F.sum("_size").over(inner), F.lit(0)))
    return dealt.join(sums, ["_s", "_b"]).withColumn("_offset", F.col("_before") + F.col("_in"))


def _taken(epoch: Column) -> Column:
    """Words that the given copy of a document gives: those of the tape before the rounded target."""
    start = F.col("_offset") + epoch * F.col("source_size")
    return F.greatest(F.lit(0), F.least(F.col("_size"), F.round("target").cast("long") - start))


def position(share: Column, ramp: Column) -> Column:
    """Training time at which a source has used ``share`` of its target, where its weight runs
    linearly from 1 - ramp to 1 + ramp: the inverse of D(t) = (1 - ramp) t + ramp t^2 on [0, 1]."""
    a = F.lit(1.0) - ramp
    return F.when(F.abs(ramp) < 1e-9, share).otherwise((-a + F.sqrt(a * a + 4.0 * ramp * share)) / (2.0 * ramp))


def _copies(tape: DataFrame, max_ramp: float) -> DataFrame:
    """Add ``_copies``: (take, at, epoch) of every copy taken of a document, at being its training position."""
    # the name of a source is hashed without the mark that _tape puts in front
    pct = F.pmod(F.xxhash64(F.when(F.col("_s") != "", F.substring("_s", 2, 1 << 30))), F.lit(201)).cast("double") / 100.0 - 1.0

    def copy(epoch: Column) -> Column:
        share = (F.col("_offset") + epoch * F.col("source_size")) / F.greatest(F.col("target"), F.lit(1.0))
        return F.struct(_taken(epoch).alias("take"), position(F.least(share, F.lit(1.0)), pct * max_ramp).alias("at"), epoch.alias("epoch"))

    every = F.array(*[copy(F.lit(epoch)) for epoch in range(MAX_REPEATS)])
    return tape.withColumn("_copies", F.filter(every, lambda x: x["take"] > 0))


def takings(docs: DataFrame, max_ramp: float = MAX_RAMP) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document, in order of the training position of
    its first copy, documents without one last; taken is the sum over the copies that ``mix`` deals."""
    rows = _copies(_tape(docs.select("doc_id", "text", "source")), max_ramp)
    taken = F.aggregate("_copies", F.lit(0).cast("long"), lambda n, x: n + x["take"])
    first = F.coalesce(F.get("_copies", F.lit(0))["at"], F.lit(2.0))  # positions are at most 1
    rows = rows.select("doc_id", F.col("_size").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", taken.alias("taken"), first.alias("_first"), "_h")
    return rows.repartitionByRange("_first", "_h").sortWithinPartitions("_first", "_h").drop("_first", "_h")


def mix(docs: DataFrame, max_ramp: float = MAX_RAMP, position_column: str | None = None) -> DataFrame:
    """The mixed documents in training order, with the columns of ``docs``: one row for every copy
    taken. Each source's schedule is a ramp in [-max_ramp, max_ramp] set by a hash of its name, so
    some sources come early and others late, while every target is met at the end. A table written and
    read again loses the order of its rows; ``position_column`` names a further column that keeps it."""
    columns = docs.columns
    # other columns ride along in a struct, so none can clash with a name used here
    own = _tape(docs.select("doc_id", "text", "source", F.struct(*[c for c in columns if c != "text"]).alias("_row")))
    copies = _copies(own, max_ramp).withColumn("_copy", F.explode("_copies")).withColumns({"_take": F.col("_copy")["take"], "_at": F.col("_copy")["at"], "_epoch": F.col("_copy")["epoch"]}).drop("_copies", "_copy")
    whole = F.col("_take") == F.col("_size")
    head = F.concat_ws(" ", F.slice(words("text"), F.lit(1), F.col("_take").cast("int")))
    copies = copies.withColumn("_text", F.when(whole, F.col("text")).otherwise(head))
    copies = copies.repartitionByRange("_at", "_h", "_epoch").sortWithinPartitions("_at", "_h", "_epoch")
    value = {c: F.col("_row")[c] for c in columns if c != "text"} | {"text": F.col("_text")}
    if "n_chars" in columns:
        value["n_chars"] = F.when(whole, F.col("_row")["n_chars"]).otherwise(F.length("_text").cast("long"))
    placed = [] if position_column is None else [F.col("_at").alias(position_column)]
    return copies.select(*[value[c].alias(c) for c in columns], *placed)
