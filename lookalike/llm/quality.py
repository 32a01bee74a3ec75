"""Quality rules and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into buckets, whose number grows with the corpus, so that a bucket has as
many different n-grams in a large corpus as in a small one. Two multinomials over the buckets are
counted: the raw corpus, from every document, and the trusted target, from every labelled document of
quality 1. A document's score is its mean, over its n-grams, of log p_target - log p_raw; documents
under the threshold are dropped. Ordinary text scores near 0 in either model and stays; text made of
n-grams that trusted documents never have scores far below.

Labels of the held-out fold (crc32 of doc_id modulo 5 is 0) are never used, so the verdicts can be measured on them.

Only DataFrame functions run. Weights are rounded to 1 / UNITS. Up to MAX_TABLE buckets they are one array of
bytes, a scalar subquery inside the sum over the n-grams of a row, so no row carries it and a document is scored
where it is read; beyond, no task holds all weights, and each document's counts of buckets are
joined to the weights by bucket. Counts over the corpus are partial sums by bucket. As buckets grow with the
corpus, few n-grams of a task share one, so the sums' shuffle is several times the text in a large corpus; it
is made in up to ROUNDS rounds of documents, whose shuffle files never lie on disk together.

Defined results: null or empty texts have no words, so all measures are 0 and base_failed is true; a
text with fewer than five words has no window; with no trusted label all weights are 0, and the base
rules alone decide; rows equal in all columns count as often as they occur; a null doc_id is never a
trusted document; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stage_table import discard
from .common import clean_cut, cut, held_out, row_id, words

#: Buckets are a power of two, at least LEAST_BUCKETS, with at most BUCKET_BYTES bytes of text for each.
LEAST_BUCKETS, BUCKET_BYTES = 1 << 17, 512
#: Most buckets whose weights, a byte each, are sent to every task as one array.
MAX_TABLE = 1 << 24
#: N-grams are shuffled in rounds of documents, one for each ROUND_BYTES of text, at most ROUNDS.
ROUNDS, ROUND_BYTES = 8, 1 << 26
#: Buckets of one piece of that array while it is put together.
PIECE = 1 << 12
#: Steps of a weight of 1; weights lie between -127 and 127 steps.
UNITS = 16
#: Neighbouring ids of trusted documents that share a row, a bit each.
WORD_IDS = 64
#: Most such rows that are broadcast; beyond, the documents are joined to them by shuffles.
MAX_MARKS = 1 << 20
#: Mean log ratio under which a document is dropped.
THRESHOLD = -0.2
#: Added to a bucket's count in the target model and to the count that the corpus model expects there, so
#: that a bucket seen in few documents has a small weight.
SMOOTHING = 0.5
WINDOW = 5


def pairs(hashes: Column) -> Column:
    """Hashes of a document's pairs of neighbouring words, from its word hashes."""
    most = F.greatest(F.size(hashes) - 1, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), most), F.slice(hashes, F.lit(2), most), lambda a, b: F.xxhash64(a, b))


def n_buckets(docs: DataFrame) -> int:
    return extent(docs)[0]


def extent(docs: DataFrame) -> tuple[int, int, int]:
    """Buckets, rounds, and tasks of a round."""
    found = docs.select(F.octet_length("text").alias("size"), F.spark_partition_id().alias("part")).agg(F.sum("size").alias("size"), F.max("part").alias("last")).first()
    size, n = found["size"] or 0, LEAST_BUCKETS
    while n * BUCKET_BYTES < size:
        n *= 2
    rounds = max(1, min(ROUNDS, -(-size // ROUND_BYTES)))
    return n, rounds, -(-((found["last"] or 0) + 1) // rounds)


def dealt(docs: DataFrame, rounds: int, tasks: int) -> list[DataFrame]:
    """The documents in so many parts, each row in one. A part has fewer tasks, not smaller ones, so that as many
    n-grams meet in a task as if all were read at once."""
    if rounds == 1:
        return [docs]
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds))
    return [docs.where(part == i).coalesce(tasks) for i in range(rounds)]


def bucket(gram: Column, n: int) -> Column:
    return F.pmod(gram, F.lit(n).cast("long"))


def hashed(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """The columns, and ``h``, the hashes of the document's words."""
    return docs.select(*columns, F.transform(words("text"), lambda w: F.xxhash64(w)).alias("h"))


def trusted(labels: DataFrame) -> DataFrame:
    """(_word, _bits) of the trusted documents, none of the held-out fold: a bit for each doc_id, WORD_IDS neighbouring ids a row."""
    doc_id = F.col("doc_id").cast("long")
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(doc_id, F.lit(WORD_IDS)).cast("int"))
    return good.groupBy(F.call_function("shiftright", doc_id, F.lit(6)).alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def marked(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The documents, and ``good``, 1 for those of ``marks``, a written table of trusted(), else 0."""
    doc_id = F.col("doc_id").cast("long")
    few = marks.count() <= MAX_MARKS
    # null ids are in no word; by their texts they don't meet in one task
    word = F.coalesce(F.call_function("shiftright", doc_id, F.lit(6)), F.xxhash64("text"))
    rows = docs.select("doc_id", "text", word.alias("_word")).join(F.broadcast(marks) if few else marks, "_word", "left")
    return rows.select("doc_id", "text", F.coalesce(F.getbit("_bits", F.pmod(doc_id, F.lit(WORD_IDS)).cast("int")), F.lit(0)).cast("long").alias("good"))


def bucket_counts(docs: DataFrame, labels: DataFrame, n: int, rounds: int = 1, tasks: int = 1) -> DataFrame:
    """(bucket, raw, good) of each bucket that occurs: its n-grams in all and in trusted documents. Each round
    adds its documents to the table of the rounds before, and its shuffle files go before the next."""
    marks, counts = cut(trusted(labels)), None
    for part in dealt(docs, rounds, tasks):
        grams = hashed(marked(part, marks), "good").select("good", F.explode(F.concat("h", pairs(F.col("h")))).alias("gram"))
        grams = grams.select(bucket(F.col("gram"), n).alias("bucket"), F.lit(1).cast("long").alias("raw"), "good")
        before = counts
        counts = clean_cut((grams if before is None else grams.unionAll(before)).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")))
        if before is not None:
            discard(before)
    return counts


def weights(docs: DataFrame, labels: DataFrame, n: int, rounds: int = 1, tasks: int = 1) -> DataFrame:
    """(bucket, w) of each bucket that occurs: its log ratio in steps of 1 / UNITS."""
    counts = bucket_counts(docs, labels, n, rounds, tasks)
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).first()
    n_raw, n_good = total["raw"] or 0, total["good"] or 0
    expected = F.col("raw") * (n_good / max(n_raw, 1))
    ratio = F.log((F.col("good") + SMOOTHING) / (expected + SMOOTHING)) if n_good else F.lit(0.0)
    return counts.select("bucket", F.greatest(F.lit(-127), F.least(F.lit(127), F.round(ratio * UNITS))).cast("tinyint").alias("w"))


def table(weights_: DataFrame, n: int) -> DataFrame:
    """One row, one array of n weights; 0 for buckets that don't occur."""
    dense = weights_.sparkSession.range(0, n, 1, 8).select(F.col("id").alias("bucket")).join(weights_, "bucket", "left").select("bucket", F.coalesce("w", F.lit(0).cast("tinyint")).alias("w"))
    pieces = dense.groupBy((F.col("bucket") / PIECE).cast("long").alias("piece")).agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "w"))), lambda x: x["w"]).alias("ws"))
    return pieces.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("piece", "ws"))), lambda x: x["ws"])).alias("weights"))


def llr(grams: Column, weights_: Column, n: int) -> Column:
    """Mean weight of the n-grams, 0 if there are none. The sum is of whole steps, so its order doesn't matter."""
    total = F.aggregate(grams, F.lit(0), lambda s, g: s + F.get(weights_, bucket(g, n).cast("int")))
    return F.when(F.size(grams) > 0, total / (UNITS * F.size(grams))).otherwise(0.0)


def joined_llr(docs: DataFrame, weights_: DataFrame, n: int, rounds: int = 1, tasks: int = 1) -> DataFrame:
    """(_k, llr) of every document with a word; equal rows add the same n-grams, which leaves the mean."""
    return reduce(DataFrame.unionAll, [clean_cut(part_llr(part, weights_, n)) for part in dealt(docs, rounds, tasks)])


def part_llr(docs: DataFrame, weights_: DataFrame, n: int) -> DataFrame:
    grams = hashed(docs, row_id("doc_id", "text").alias("_k")).select("_k", F.explode(F.concat("h", pairs(F.col("h")))).alias("gram")).select("_k", bucket(F.col("gram"), n).alias("bucket"))
    grams = grams.groupBy("_k", "bucket").agg(F.count("*").alias("n"))
    return grams.join(weights_, "bucket").groupBy("_k").agg((F.sum(F.col("n") * F.col("w")) / (UNITS * F.sum("n"))).alias("llr"))


def n_repeat_words(hashes: Column, pairs_: Column) -> Column:
    """Words that lie in a window of five words found twice or more in the text.

    The windows' hashes are compared as a set first; only a text with a repeat sorts them. The repeated
    windows' starts, in order, cover min(5, distance to the next start) words each.
    """
    n = F.size(hashes) - (WINDOW - 1)
    part = lambda x, first: F.slice(x, F.lit(first), F.greatest(n, F.lit(0)))
    grams = F.zip_with(F.zip_with(part(pairs_, 1), part(pairs_, 3), lambda a, b: F.xxhash64(a, b)), part(hashes, 5), lambda a, b: F.xxhash64(a, b))

    def covered(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.element_at(F.transform(F.array(ordered), words_of), 1)

    def words_of(ordered: Column) -> Column:
        same = lambda a, b: F.get(ordered, a)["g"].eqNullSafe(F.get(ordered, b)["g"])
        hits = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda k: ((k > 0) & same(k - 1, k)) | same(k, k + 1))
        starts = F.sort_array(F.transform(hits, lambda k: F.get(ordered, k)["i"]))
        state = F.aggregate(starts, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")), lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")))
        return state["n"]

    # array(x) with a transform over it evaluates x once
    found = F.element_at(F.transform(F.array(grams), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g))), 1)
    return F.when(n < 2, F.lit(0).cast("long")).otherwise(found)


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def measures(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept)."""
    n, rounds, tasks = extent(docs)
    by_bucket = weights(docs, labels, n, rounds, tasks)
    small = n <= MAX_TABLE
    symbols = F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long")
    rows = docs.select("doc_id", symbols.alias("n_symbols"), n_dup_lines(F.col("text")).alias("n_dup_lines"), words("text").alias("w"), *([] if small else [row_id("doc_id", "text").alias("_k")]))
    columns = ["doc_id", "n_symbols", "n_dup_lines", *([] if small else ["_k"])]
    rows = rows.select(*columns, F.length(F.array_join("w", "")).cast("long").alias("word_chars"), F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    if small:
        # used once, as h is, so the optimiser puts the subquery where it is used and no row carries the array
        rows = rows.withColumn("_table", table(by_bucket, n).scalar())

    def measured(h: Column, p: Column) -> Column:
        score = [llr(F.concat(h, p), F.col("_table"), n).alias("llr")] if small else []
        return F.struct(F.size(h).cast("long").alias("n_words"), n_repeat_words(h, p).alias("n_repeat_words"), *score)

    # array(x) with a transform over it evaluates x once
    once = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    rows = rows.select(*columns, "word_chars", once(F.col("h"), lambda h: once(pairs(h), lambda p: measured(h, p))).alias("_m")).select(*columns, "word_chars", "_m.*")
    if not small:
        rows = rows.join(joined_llr(docs, by_bucket, n, rounds, tasks), "_k", "left").withColumn("llr", F.coalesce("llr", F.lit(0.0)))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"))
