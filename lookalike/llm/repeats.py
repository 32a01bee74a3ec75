"""Removing passages that an earlier document already has, by seed and extend.

A window is 50 consecutive words. Winnowing marks seeds: of the 43 runs of 8 words in a window the one
with the smallest hash, the first of equal ones, is its anchor, so equal windows have equal anchors, and
neighbouring windows mostly share theirs. Documents are joined on anchors: each occurrence of one meets that in
the document with the smallest doc_id, its representative, and both carry the words of the windows that hold the
anchor. The match is extended from the anchor to both sides as far as the words agree; a maximal repeat of 50
words or more is cut out of the later document. As every occurrence meets one other, a passage in thousands of
documents makes as many pairs as it has occurrences there.

Windows of a document that its representative lacks may stand in another earlier document. Any document that
has such a window lacks it in the representative too, so these windows alone, by their hashes, are compared with
each other; so are all windows of an anchor that the representative has with several surroundings. No link is lost.

A text whose words all equal those of a text with a smaller doc_id is settled by its SHA-256 and takes
no further part, so groups of copies add one text to the join. Rows of hot anchors and windows stay spread: the
few rows they are joined with are broadcast.

Defined results: null or empty texts have no words; texts of fewer than 50 words lose nothing; a repeat
inside one document stays; rows equal in all columns have equal results, and rows that share a doc_id
don't remove each other's words; a null doc_id is neither smaller nor greater than any, so its row loses
and removes nothing; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .common import cut, fresh, hot_join, row_id

WINDOW = 50
SEED = 8


def anchors(part: textscan.Slice, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``seed`` words; for each window of the slice, in order: the word it begins at, and
    the word its anchor begins at."""
    hashes = textscan.runs(part.hashes, seed)
    n = len(part.hashes) - window + 1
    if n <= 0:
        return hashes, np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(len(hashes))
    need, have = window - seed + 1, 1
    while have < need:  # the first smallest of twice as many runs each time
        step = min(have, need - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(hashes[left] <= hashes[right], left, right)
        have += step
    doc = part.doc_of_word()
    begin = np.flatnonzero(doc[:n] == doc[window - 1 :])
    return hashes, begin, at[begin]


def joined(part: textscan.Slice, keep: np.ndarray) -> list[bytes]:
    """Each row's kept words joined by one space."""
    doc = part.doc_of_word()
    at = np.flatnonzero(keep)
    marks = np.zeros(len(part.data) + 1, np.int8)
    np.add.at(marks, part.starts[at], 1)
    np.add.at(marks, part.ends[at], -1)
    chosen = np.cumsum(marks[:-1]).astype(bool)
    data = part.data
    if len(at) > 1:
        gap = part.ends[at[:-1]][doc[at[:-1]] == doc[at[1:]]]
        chosen[gap] = True
        data = data.copy()
        data[gap] = 0x20
    sums = np.concatenate([[0], np.cumsum(chosen)])
    out = data[chosen].tobytes()
    first = np.concatenate([part.starts, [len(part.data)]])[part.first]
    cuts = sums[first]
    return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textscan.slices(batch.column("text")):
            n, size = part.hi - part.lo, np.diff(part.first)
            sha = [hashlib.sha256(x).digest() for x in joined(part, np.ones(len(part.hashes), bool))]
            hashes, begin, at = anchors(part)
            new = np.diff(at, prepend=-1) != 0
            least, doc = hashes[at[new]], part.doc_of_word()[at[new]]
            order = np.lexsort((least, doc))
            least, doc = least[order], doc[order]
            new = np.ones(len(least), bool)
            new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
            rows = batch.slice(part.lo, n)
            yield pa.RecordBatch.from_arrays([rows.column("rid"), rows.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(sha, pa.binary()), _lists(least[new], doc[new], n)], ["rid", "doc_id", "n_words", "sha", "anchors"])


def _binary(values: np.ndarray, begin: np.ndarray, length: np.ndarray) -> pa.Array:
    """values[begin : begin + length] as bytes, for each begin."""
    offsets = np.concatenate([[0], np.cumsum(length)])
    flat = values[np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], length)]
    return pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer((offsets * 8).astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The occurrences of shared anchors with the words of the windows that hold them. Those of a document that
    have the same words around them are one row. ``lead``: the one row of an anchor's representative, without
    words if those differ between its occurrences; then these have rows of their own as well."""
    for batch in batches:
        for part in textscan.slices(batch.column("text")):
            rows = batch.slice(part.lo, part.hi - part.lo)
            own = rows.column("anchors")
            entry = own.flatten()
            owner = np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy())).astype(np.uint64)
            keys = textscan.paired(owner, entry.field("a").to_numpy().view(np.uint64))
            order = np.argsort(keys)
            keys, leads, many = keys[order], entry.field("lead").to_numpy(zero_copy_only=False).astype(bool)[order], entry.field("m").to_numpy()[order]
            hashes, begin, at = anchors(part)
            first = np.flatnonzero(np.diff(at, prepend=-1))  # a run of windows for each occurrence
            last = np.append(first[1:], len(at)) - 1
            s0, s1, at = begin[first], begin[last], at[first]
            doc = part.doc_of_word()[at]
            key = textscan.paired(doc.astype(np.uint64), hashes[at])
            place = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            hit = np.flatnonzero(keys[place] == key) if len(keys) else np.zeros(0, np.int64)
            s0, s1, at, doc, place, key = s0[hit], s1[hit], at[hit], doc[hit], place[hit], key[hit]
            if not len(hit):
                continue
            window = textscan.runs(part.hashes, WINDOW)
            around = textscan.paired(textscan.paired(window[s0], window[s1]), (at - s0 + 64 * (s1 - s0)).astype(np.uint64))
            order = np.lexsort((s0, around, key))
            s0, s1, at, doc, place, key, around = (x[order] for x in (s0, s1, at, doc, place, key, around))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (around[1:] != around[:-1])
            top = np.flatnonzero(new)
            again = np.ones(len(top), bool)
            again[1:] = key[top[1:]] != key[top[:-1]]  # first distinct surroundings of the anchor in the document
            group = np.cumsum(again) - 1
            several = np.bincount(group)[group] > 1
            lead = leads[place[top]]
            begins = pa.ListArray.from_arrays(pa.array(np.append(top, len(key)).astype(np.int32)), pa.array((s0 - part.first[:-1][doc]).astype(np.int32)))
            d = doc[top]
            a = hashes[at[top]].view(np.int64)
            words = _binary(part.hashes, s0[top], s1[top] + WINDOW - s0[top])

            def made(keep, is_lead, without):
                take = pa.array(np.flatnonzero(keep))
                ids = pa.array(d[keep])
                blank = pa.array(without[keep])
                around_ = words.take(take)
                return pa.RecordBatch.from_arrays(
                    [pa.array(a[keep]), pa.array(np.full(len(take), is_lead)), pa.array(many[place[top]][keep]), rows.column("rid").take(ids), rows.column("doc_id").take(ids), begins.take(take), pa.array((at - s0)[top][keep].astype(np.int32)), pa.compute.if_else(blank, pa.scalar(None, pa.binary()), around_)],
                    ["a", "lead", "m", "rid", "doc_id", "at", "left", "words"],
                )

            yield made(lead & again, True, several)
            yield made(~lead | several, False, np.zeros(len(top), bool))


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal repeats (at: the words they begin at; n: their length), and windows that are not in any, with
    their hash ``h``, of occurrences that have met their representative's."""
    for batch in batches:
        out: dict[str, list] = {x: [] for x in ("row", "h", "at", "n")}
        mine, other, lefts, lefts2, begins = (batch.column(x).to_pylist() for x in ("words", "words2", "left", "left2", "at"))
        for row, (x, y, left, left2, at) in enumerate(zip(mine, other, lefts, lefts2, begins, strict=True)):
            x = np.frombuffer(x, np.uint64)
            n, at, lo, hi = len(x) - WINDOW + 1, np.array(at), 0, 0  # windows lo to hi of n are repeated
            if y is not None:
                y = np.frombuffer(y, np.uint64)
                most = min(left, left2)
                apart = np.flatnonzero(x[left - most : left] != y[left2 - most : left2])
                begin = left - most + apart[-1] + 1 if len(apart) else left - most
                most = min(len(x) - left, len(y) - left2)
                apart = np.flatnonzero(x[left : left + most] != y[left2 : left2 + most])
                end = left + (apart[0] if len(apart) else most)
                if end - begin >= WINDOW:
                    lo, hi = begin, end - WINDOW + 1
                    out["row"].append(row), out["h"].append(None), out["at"].append(at + begin), out["n"].append(end - begin)
            if hi - lo < n:
                for k, h in enumerate(textscan.runs(x, WINDOW).view(np.int64).tolist()):
                    if not lo <= k < hi:
                        out["row"].append(row), out["h"].append(h), out["at"].append(at + k), out["n"].append(WINDOW)
        take = pa.array(out["row"], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("rid").take(take), batch.column("doc_id").take(take), batch.column("least").take(take), pa.array(out["h"], pa.int64()), pa.array(out["at"], pa.list_(pa.int32())), pa.array(out["n"], pa.int32())], ["rid", "doc_id", "least", "h", "at", "n"])


def covered(n: int, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Flags of the words that spans of the given lengths cover."""
    marks = np.bincount(begin, minlength=n + 1) - np.bincount(begin + length, minlength=n + 1)
    return np.cumsum(marks)[:n] > 0


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their repeats, of rows that carry them as lists of begins and a length."""
    for batch in batches:
        for part in textscan.slices(batch.column("text")):
            n, size = part.hi - part.lo, np.diff(part.first)
            own = batch.column("spans").slice(part.lo, n)
            spans = own.flatten()
            lists = spans.field("at")
            times = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.repeat(np.arange(n), np.diff(own.offsets.to_numpy())), times)
            begin = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + part.first[doc]
            gone = covered(len(part.hashes), begin, np.repeat(spans.field("n").to_numpy(zero_copy_only=False), times).astype(np.int64))
            texts = joined(part, ~gone)
            lost = np.add.reduceat(np.append(gone, False).astype(np.int64), part.first[:-1]) * (size > 0)
            yield pa.RecordBatch.from_arrays([batch.column("rid").slice(part.lo, n), pa.array(lost), pa.array([x.decode("utf-8", "replace") for x in texts], pa.string())], ["rid", "n_removed", "kept"])


def _matches(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles of all rows; the rows that are the first of their text; (rid, kept text, n_removed) of
    the rows that lose some but not all of their words to other texts."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", row_id("doc_id", "text").alias("rid"))
    profile = cut(rows.mapInArrow(_profile, f"rid binary, doc_id {kind}, n_words long, sha binary, anchors array<long>"))
    long = profile.where(F.col("n_words") >= WINDOW)
    first = long.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null")
    # copies leave here; doc_id is a key of the join, so a large group of copies is spread
    unique = long.join(first, ["sha", "doc_id"], "left_semi")
    held = cut(unique.select("rid", "doc_id", F.explode("anchors").alias("a")))
    leads = held.groupBy("a").agg(F.min(F.struct("doc_id", "rid")).alias("rep"), F.max("doc_id").alias("most"), F.count("*").alias("m"))
    leads = cut(leads.where("rep.doc_id < most").select("a", F.col("rep.rid").alias("rep"), "m"))
    seeds = hot_join(held, leads, "a", "m").groupBy("rid").agg(F.collect_set(F.struct("a", (F.col("rid") == F.col("rep")).alias("lead"), "m")).alias("anchors"))
    texts = cut(rows.join(seeds, "rid").dropDuplicates(["rid"]))
    met = cut(texts.mapInArrow(_occurrences, f"a long, lead boolean, m long, rid binary, doc_id {kind}, at array<int>, left int, words binary"))
    reps = met.where("lead").select("a", "m", F.col("doc_id").alias("least"), F.col("left").alias("left2"), F.col("words").alias("words2"))
    pairs = hot_join(met.where("not lead").drop("m"), reps, "a", "m")
    spans = cut(pairs.select("rid", "doc_id", "least", "at", "left", "words", "left2", "words2").mapInArrow(_extended, f"rid binary, doc_id {kind}, least {kind}, h long, at array<int>, n int"))
    # a row of the representative's own doc_id loses nothing to it
    found = spans.where("h is null and doc_id > least").select("rid", "at", "n")
    open_ = spans.where("h is not null").drop("least")
    earliest = cut(open_.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("m")).where("least < most").select("h", "least", "m"))
    more = hot_join(open_, earliest, "h", "m").where(F.col("doc_id") > F.col("least")).select("rid", "at", "n")
    hits = found.unionByName(more).groupBy("rid").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    cuts = texts.select("rid", "text").join(hits, "rid").mapInArrow(_without, "rid binary, n_removed long, kept string")
    return profile, first, cuts


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    profile, first, cuts = _matches(docs)
    cuts = cuts.select("rid", "n_removed", F.sha2("kept", 256).alias("cut_sha"))
    rows = profile.select("rid", "doc_id", "n_words", "sha")
    rows = rows.join(first.withColumn("leads", F.lit(True)), ["sha", "doc_id"], "left").join(cuts, "rid", "left")
    copy = (F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull() & F.col("leads").isNull()
    return rows.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated passages; documents that lose all words go. Texts that lose
    nothing are left as they are, white space included; n_chars follows where it is a column."""
    profile, first, cuts = _matches(docs)
    state = profile.where((F.col("n_words") < WINDOW) | F.col("doc_id").isNull()).select("rid").unionByName(profile.join(first, ["sha", "doc_id"], "left_semi").select("rid")).distinct()
    state = state.join(cuts, "rid", "left").select("rid", "kept")
    rid, kept = fresh(docs, "rid"), fresh(docs, "kept")
    rows = docs.withColumn(rid, row_id("doc_id", "text")).join(state.withColumnsRenamed({"rid": rid, "kept": kept}), rid).where(F.col(kept).isNull() | (F.col(kept) != ""))
    changed = {"text": F.coalesce(kept, "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(kept).isNotNull(), F.length(kept).cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumns(changed).select(*docs.columns)
