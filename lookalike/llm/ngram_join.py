"""N-gram Jaccard join with vertical partitioning.

A document's set holds the hashes of its distinct five-word shingles. The global order of n-grams is the
order of their hashes, which is cut into fragments of equal width; each fragment is a task that sees one
segment of every set. Documents with equal sets are one class from the start.

0. N-grams that very many rows of a task hold are counted while the sets are made. The most frequent, a
   bounded number, are known to be shared; they stay with their classes, last in the order, and enter no
   fragment, so that none has much more than its part of the rows.
1. Each fragment finds its n-grams that two or more classes hold. A linked pair's classes each hold at
   least 80% of n-grams that others hold too, so the rest of the classes leave here; a passage that many
   documents share makes no pairs of documents that differ in the rest.
2. The classes left are ordered by how many classes hold an n-gram, rarest first, unshared ones ahead of
   all. Linked classes share an n-gram in their first n - ceil(0.8 n) + 1; these make an inverted index.
3. In each list of the index all classes are first compared with one leader, that whose n-grams are held
   most widely, as the text that others were copied from is. Pairs inside one component then need no
   comparison, as only components are asked for; of the others, every class outside the list's largest
   component is compared with the classes of other components. In a long list not all of those pairs are
   made: of two linked classes that share nothing outside the leader, neither has a smaller overlap with
   the leader than the link takes, and any others share an n-gram that the leader lacks. Sizes and
   overlaps find the first kind, an index of n-grams outside the leader the second, whose lists get a
   leader of their own first. No link is lost.
4. A pair's overlap is counted in each fragment of the order separately, and summed per pair.

Hashes have 64 bits. Rows of a list whose n-gram is hot are joined with its leader by broadcast, and a task
emits each class once, so copies add no more than one row for each task. Defined results: null or empty texts
have the empty set, link with nothing, and are
components of their own; texts of one to four words have one shingle, the whole text; rows equal in all
columns, and rows of one doc_id, are linked as any other; a row with a null doc_id takes part under no
id and keeps a null component; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from . import textscan
from .common import cut, fresh, hot_join, row_id

WIDTH = 5
#: Share of the union, in percent, from which two sets link.
PERCENT = 80
#: N-grams of one fragment, on average, at most.
FRAGMENT = 1_500_000
#: Fragments in which the overlap of a pair is counted.
PAIR_FRAGMENTS = 4
#: In lists of up to so many classes, all pairs of different components are compared.
SHORT_LIST = 64
#: A task reports n-grams that so many of its sets hold, beyond what is usual for a cell of its counters.
TASK_HOT, CELLS = 64, 1 << 19
#: Most n-grams that are sent to every task as hot.
MAX_HOT = 1 << 20
#: Number of classes that a hot n-gram is said to be held by.
MANY = (1 << 31) - 1


def shingle_sets(part: textscan.Slice, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the slice's rows, ordered by row and hash, and their rows."""
    hashes, begin, doc = textscan.grams(part, width)
    size = np.diff(part.first)
    for n in range(1, width):
        short = np.flatnonzero(size == n)
        if len(short):
            hashes = np.concatenate([hashes, textscan.mixed(textscan.runs(part.hashes, n)[part.first[short]], n)])
            doc = np.concatenate([doc, short])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], doc[new]


class Leads:
    """The first row of each class that a task meets."""

    def __init__(self):
        self.met: set[int] = set()

    def __call__(self, signatures: np.ndarray) -> np.ndarray:
        own = np.zeros(len(signatures), bool)
        values, at = np.unique(signatures, return_index=True)
        for value, i in zip(values.tolist(), at.tolist(), strict=True):
            if value not in self.met:
                self.met.add(value)
                own[i] = True
        return own


class Frequent:
    """N-grams that many of a task's classes hold, with their numbers from when they were noticed on."""

    def __init__(self):
        self.cells, self.total = np.zeros(CELLS, np.int64), 0
        self.grams, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, hashes: np.ndarray) -> None:
        if not len(hashes):
            return
        cell = (hashes % np.uint64(CELLS)).astype(np.int64)
        self.cells += np.bincount(cell, minlength=CELLS)
        self.total += len(hashes)
        often = hashes[self.cells[cell] > TASK_HOT + 4 * self.total // CELLS]
        if len(often):
            grams, counts = np.unique(often, return_counts=True)
            self.grams, at = np.unique(np.concatenate([self.grams, grams]), return_inverse=True)
            self.counts = np.bincount(at, np.concatenate([self.counts, counts])).astype(np.int64)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        keep = self.counts >= TASK_HOT // 2
        return self.grams[keep], self.counts[keep]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _signatures(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two set hashes for each row."""
    size = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(size)])
    total = lambda x: np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
    one, two = total(textscan.mixed(hashes, 3)), total(textscan.mixed(hashes, 5))
    return size, textscan.mixed(one[first[1:]] - one[first[:-1]] + size.astype(np.uint64), 7), two[first[1:]] - two[first[:-1]]


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document; and, without rid, a row for each frequent n-gram, with its number."""
    names, frequent, lead = ["rid", "doc_id", "n", "c", "c2"], Frequent(), Leads()
    kinds = None
    for batch in batches:
        kinds = [batch.schema.field(x).type for x in names[:2]]
        for part in textscan.slices(batch.column("text"), lower=True):
            n = part.hi - part.lo
            hashes, doc = shingle_sets(part)
            size, one, two = _signatures(hashes, doc, n)
            frequent.add(hashes[lead(one)[doc]])
            rows = batch.slice(part.lo, n)
            yield pa.RecordBatch.from_arrays([rows.column("rid"), rows.column("doc_id"), pa.array(size.astype(np.int64)), _signed(one), _signed(two)], names)
    grams, counts = frequent.rows()
    if len(grams):
        none = [pa.nulls(len(grams), kind) for kind in kinds]
        yield pa.RecordBatch.from_arrays([*none, pa.array(counts), _signed(grams), _signed(np.zeros(len(grams), np.uint64))], names)


def _fragment_rows(rows: list, f: int, classes: np.ndarray, hashes: np.ndarray, hot: bool) -> None:
    """One row of a fragment; ``classes`` has the class of each n-gram, those of a class side by side."""
    edges = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1], [True]]))
    rows.append((f, hot, classes[edges[:-1]].tobytes(), np.diff(edges).astype(np.uint32).tobytes(), hashes.tobytes()))


def _segments(n_fragments: int, hot):
    """For each slice and fragment one row: classes, their counts, and n-grams by class. Hot n-grams are in
    rows of their own, which any fragment may pass on."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, lead, frequent = np.uint64((1 << 64) // n_fragments + 1), Leads(), hot.value
        for batch in batches:
            for part in textscan.slices(batch.column("text"), lower=True):
                hashes, doc = shingle_sets(part)
                _, one, _ = _signatures(hashes, doc, part.hi - part.lo)
                own = lead(one)
                hashes, doc = hashes[own[doc]], doc[own[doc]]
                rows = []
                if len(frequent) and len(hashes):
                    known = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
                    if known.any():
                        _fragment_rows(rows, int(one[doc[known][0]] % np.uint64(n_fragments)), one[doc[known]], hashes[known], True)
                        hashes, doc = hashes[~known], doc[~known]
                at = (hashes // width).astype(np.int64)
                order = np.argsort(at, kind="stable")
                hashes, doc, at = hashes[order], doc[order], at[order]
                edges = np.flatnonzero(np.diff(at, prepend=-1, append=-1)) if len(at) else np.zeros(1, int)
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    _fragment_rows(rows, int(at[lo]), one[doc[lo:hi]], hashes[lo:hi], False)
                if rows:
                    f, known, c, k, h = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(known), pa.array(c, pa.binary()), pa.array(k, pa.binary()), pa.array(h, pa.binary())], ["f", "hot", "classes", "counts", "grams"])

    return emit


def _read(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    join = lambda name: b"".join(group.column(name).to_pylist())
    return np.frombuffer(join("grams"), np.uint64), np.repeat(np.frombuffer(join("classes"), np.uint64), np.frombuffer(join("counts"), np.uint32))


def _by_class(h: np.ndarray, c: np.ndarray, held: np.ndarray) -> pa.Table:
    """One row for each class, of n-grams that are ordered by class."""
    edges = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1], [True]])) if len(c) else np.zeros(1, int)
    pieces = list(zip(edges[:-1], edges[1:], strict=True))
    return pa.table({"c": _signed(c[edges[:-1]]), "h": pa.array([h[a:b].tobytes() for a, b in pieces], pa.binary()), "held": pa.array([held[a:b].tobytes() for a, b in pieces], pa.binary())})


def _shared(group: pa.Table) -> pa.Table:
    """The fragment's n-grams that two or more classes hold: for each class its n-grams and in how many
    classes they are."""
    known = group.column("hot").to_numpy().astype(bool)
    passed, group = group.filter(pa.array(known)), group.filter(pa.array(~known))
    h, c = _read(group)
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    h, c = h[new], c[new]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
    count = np.diff(np.append(first, len(h)))
    held = np.repeat(count, count)
    h, c, held = h[held > 1], c[held > 1], held[held > 1].astype(np.uint32)
    order = np.lexsort((h, c))
    out = [_by_class(h[order], c[order], held[order])]
    if passed.num_rows:
        h, c = _read(passed)
        order = np.lexsort((h, c))
        h, c = h[order], c[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        out.append(_by_class(h[new], c[new], np.full(np.count_nonzero(new), MANY, np.uint32)))
    return pa.concat_tables(out)


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class: how widely its n-grams are held, its prefix, and its segments by fragment."""
    for batch in batches:
        out: dict[str, list] = {x: [] for x in ("k", "rank", "prefix", "segments")}
        for n, pieces in zip(batch.column("n").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
            h = np.frombuffer(b"".join(x["h"] for x in pieces), np.uint64)
            held = np.frombuffer(b"".join(x["held"] for x in pieces), np.uint32)
            out["k"].append(len(h))
            order = np.lexsort((h, held))
            length = n - -(-PERCENT * n // 100) + 1 - (n - len(h))
            out["rank"].append(float(np.log(held).sum() / n))
            out["prefix"].append(h[order[: max(0, length)]].view(np.int64))
            h = np.sort(h)
            cuts = np.searchsorted(h, [np.uint64((i << 64) // PAIR_FRAGMENTS) for i in range(1, PAIR_FRAGMENTS)])
            out["segments"].append([x.tobytes() for x in np.split(h, cuts)])
        yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("n"), pa.array(out["k"], pa.int64()), pa.array(out["rank"], pa.float64()), pa.array(out["prefix"], pa.list_(pa.int64())), pa.array(out["segments"], pa.list_(pa.binary()))], ["c", "n", "k", "rank", "prefix", "segments"])


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("both"), pa.array(counts, pa.int64())], ["a", "b", "both", "part"])


def _beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlap of a with b in a fragment, and the n-grams of b there that a lacks."""
    for batch in batches:
        parts, beyond = [], []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            more = np.setdiff1d(np.frombuffer(y, np.uint64), np.frombuffer(x, np.uint64), assume_unique=True)
            parts.append(len(y) // 8 - len(more))
            beyond.append(more.view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(parts, pa.int64()), pa.array(beyond, pa.list_(pa.int64()))], ["a", "b", "part", "beyond"])


def _by_fragment(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) with their segments x and y in each fragment."""
    left = segments.select(F.col("c").alias("a"), "f", F.col("s").alias("x"))
    right = segments.select(F.col("c").alias("b"), "f", F.col("s").alias("y"))
    parts = pairs.withColumn("f", F.explode(F.array(*[F.lit(i) for i in range(PAIR_FRAGMENTS)])))
    return parts.join(right, ["b", "f"]).join(left, ["a", "f"])


def _linked(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """The pairs (a, b, both: sum of their sizes) whose overlap, summed over fragments, makes a link."""
    parts = _by_fragment(pairs, segments).select("a", "b", "both", "x", "y").mapInArrow(_overlap, "a long, b long, both long, part long")
    both = parts.groupBy("a", "b", "both").agg(F.sum("part").alias("overlap"))
    return both.where((100 + PERCENT) * F.col("overlap") >= PERCENT * F.col("both")).select("a", "b")


def _stars(lists: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Leaders of the lists of two classes or more, and the pairs (a, b, both) of leaders and other members.
    ``lists`` is a written table (key, c, n, k, rank)."""
    leaders = lists.groupBy(key).agg(F.max(F.struct("rank", "c", "n", "k")).alias("lead"), F.count("*").alias("m")).where("m > 1")
    leaders = cut(leaders)
    star = hot_join(lists, leaders, key, "m").where((F.col("c") != F.col("lead.c")) & _possible(F.col("n"), F.col("k"), F.col("lead.n"), F.col("lead.k")))
    return leaders, _pairs(star.select(F.col("c").alias("a"), F.col("lead.c").alias("b"), (F.col("n") + F.col("lead.n")).alias("both")))


def _open(lists: DataFrame, key: str, label: DataFrame, leaders: DataFrame) -> DataFrame:
    """Members of the lists with more than one component: (key, c, n, k, component, size, top, lead)."""
    member = cut(lists.drop("rank").join(label, "c", "left").withColumn("component", F.coalesce("component", "c")))
    counted = member.groupBy(key, "component").agg(F.count("*").alias("m"))
    largest = counted.groupBy(key).agg(F.max(F.struct("m", "component")).alias("top"), F.count("*").alias("several"), F.sum("m").alias("size")).where("several > 1")
    largest = cut(largest.join(leaders, key).select(key, "size", F.col("top.component").alias("top"), F.col("lead.c").alias("lead")))
    return cut(hot_join(member, largest, key, "size"))


def _second(names) -> list:
    return [F.col(x).alias(f"{x}2") for x in names]


def _apart():
    return (F.col("component") != F.col("component2")) & _possible(F.col("n"), F.col("k"), F.col("n2"), F.col("k2"))


def _pair(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("c").alias("a"), F.col("c2").alias("b"), (F.col("n") + F.col("n2")).alias("both"))


def _across(open_: DataFrame, key: str) -> DataFrame:
    """Pairs of the lists' members that are in different components, but for pairs inside the largest."""
    other = open_.select(key, *_second(["c", "n", "k", "component"]))
    return _pair(open_.where("component <> top").join(other, key).where(_apart()))


def _long_list_pairs(rows: DataFrame, segments: DataFrame, found: DataFrame, tested: DataFrame, ranks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links, and pairs that may link, among ``rows`` (h, c, n, k, component, top, lead) of long lists."""
    stars = rows.where("c <> lead").select(F.col("lead").alias("a"), F.col("c").alias("b")).distinct()
    parts = cut(_by_fragment(stars, segments).select("a", "b", "x", "y").mapInArrow(_beyond, "a long, b long, part long, beyond array<long>"))
    overlap = parts.groupBy(F.col("a").alias("lead"), F.col("b").alias("c")).agg(F.sum("part").alias("o"))
    rows = cut(rows.join(overlap, ["lead", "c"], "left").withColumn("o", F.coalesce("o", "k")))
    within = (100 + PERCENT) * F.least("o", "o2") >= PERCENT * (F.col("n") + F.col("n2"))
    inside = _pair(rows.where("component <> top").join(rows.select("h", *_second(["c", "n", "k", "component", "o"])), "h").where(_apart() & within))
    # lists by leader and n-gram outside it; only what a second class holds there matters
    extra = parts.select("a", F.col("b").alias("c"), F.explode("beyond").alias("g")).select(F.xxhash64("a", "g").alias("h"), "c")
    facts = rows.groupBy("c").agg(F.first("n").alias("n"), F.first("k").alias("k"))
    extra = cut(extra.join(facts, "c").join(ranks, "c"))
    leaders, more = _stars(extra, "h")
    more = cut(more.join(tested, ["a", "b"], "left_anti"))
    links = cut(_linked(more, segments))
    label = components(found.union(links)).withColumnsRenamed({"node": "c"})
    return links, inside.union(_across(_open(extra, "h", label, leaders), "h"))


def _possible(n1, k1, n2, k2):
    """Whether sizes n and counts k of n-grams that other classes hold allow a link."""
    most = F.least(k1, k2)
    return (100 * F.least(n1, n2) >= PERCENT * F.greatest(n1, n2)) & ((100 + PERCENT) * most >= PERCENT * (n1 + n2))


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "both").distinct()


def class_links(docs: DataFrame, profile: DataFrame) -> DataFrame:
    """(a, b): links between classes, enough of them to give all components."""
    sizes = profile.where("rid is not null and n > 0").groupBy("c").agg(F.first("n").alias("n"))
    total = profile.where("rid is not null").agg(F.sum("n")).first()[0] or 0
    n_fragments = max(32, -(-total // FRAGMENT))
    # MAX_HOT numbers at most go to the driver and to every task
    frequent = profile.where("rid is null").groupBy("c").agg(F.sum("n").alias("m")).orderBy(F.desc("m"), "c").limit(MAX_HOT).select("c").toArrow().column("c").to_numpy()
    hot = docs.sparkSession.sparkContext.broadcast(np.sort(frequent.astype(np.int64).view(np.uint64)))
    emitted = docs.select("text").mapInArrow(_segments(n_fragments, hot), "f int, hot boolean, classes binary, counts binary, grams binary")
    shared = emitted.groupBy("f").applyInArrow(_shared, "c long, h binary, held binary")
    # a set: the hot n-grams of a class come from every task that has it
    held = shared.groupBy("c").agg(F.collect_set(F.struct("h", "held")).alias("pieces")).join(sizes, "c")
    k = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["h"])) / 8
    left = cut(held.where(100 * k >= PERCENT * F.col("n")).mapInArrow(_ordered, "c long, n long, k long, rank double, prefix array<long>, segments array<binary>"))
    segments = left.select("c", F.posexplode("segments").alias("f", "s"))
    lists = cut(left.select("c", "n", "k", "rank", F.explode("prefix").alias("h")))
    leaders, pairs = _stars(lists, "h")
    tested = cut(pairs)
    found = cut(_linked(tested, segments))
    label = components(found).withColumnsRenamed({"node": "c"})
    open_ = _open(lists, "h", label, leaders)
    rest = _across(open_.where(F.col("size") <= SHORT_LIST), "h")
    long = open_.where(F.col("size") > SHORT_LIST).drop("size")
    if not long.limit(1).count():
        return found.union(_linked(cut(_pairs(rest).join(tested, ["a", "b"], "left_anti")), segments))
    links, more = _long_list_pairs(long, segments, found, tested, left.select("c", "rank"))
    return found.union(links).union(_linked(cut(_pairs(rest.union(more)).join(tested, ["a", "b"], "left_anti")), segments))


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles of all rows, and (c, first) of each class: the first row of its component, as a struct
    of the doc_id and the row's hash."""
    rows = docs.select(row_id("doc_id", "text").alias("rid"), "doc_id", "text")
    profile = cut(rows.mapInArrow(_profile, f"rid binary, doc_id {dict(docs.dtypes)['doc_id']}, n long, c long, c2 long"))
    label = components(class_links(docs, profile)).select(F.col("node").alias("c"), "component")
    profile = profile.where("rid is not null")
    # one row per class first: a large group of copies is a minimum here, not a group in one task
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid")).alias("first")
    classes = profile.where("n > 0").groupBy("c", "c2").agg(first)
    classes = classes.join(label, "c", "left").withColumn("component", F.coalesce("component", "c"))
    least = classes.groupBy("component").agg(F.min("first").alias("first"))
    return profile, classes.drop("first").join(least, "component").select("c", "first")


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; component_id is the smallest doc_id that
    links reach, the document's own included."""
    profile, first = _components(docs)
    rows = profile.join(first, "c", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("first.doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that with the smallest doc_id; rows with empty sets stay,
    and rows that are equal in doc_id and text are one."""
    profile, first = _components(docs)
    rid = fresh(docs, "rid")
    keep = first.select(F.col("first.rid").alias(rid)).union(profile.where("n = 0").select("rid")).distinct()
    return docs.withColumn(rid, row_id("doc_id", "text")).join(keep, rid, "left_semi").dropDuplicates([rid]).drop(rid)
