"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Examples are labelled rows outside the held-out fold. All their words are indexed. A word's weight in a text is
(1 + log tf) * idf * relevance: inverse document frequencies are counted over all documents, and the relevance
is 1, plus, for words that toxic examples have more often than clean ones, the root of the likelihood-ratio
statistic as far as it exceeds what the most extreme of so many words reaches by chance. Without the last
factor neighbours are texts of one subject, and the few words that make a text toxic have no say.

Unit vectors of the examples stand in an inverted index whose postings are cut into blocks of examples, each
run of postings with its largest weight. A search sums those maxima to bound each block, opens the blocks with
the highest bounds, and then every other block whose bound reaches the k-th similarity found: the k
similarities found are exactly the largest. The words that most examples have are a matrix instead, whose products
with a text are summed before and added to the bounds. Neighbours vote with weights that grow as their distance falls,
drawn towards the share of toxic rows among the examples. A logistic curve, fitted to the examples' votes on
each other, makes the vote a calibrated score; the neighbours are its evidence.

Bounds: at most MAX_EXAMPLES examples, those with the smallest hashes of doc_id, make the model, so it is small
whatever the input. All documents are scored, each alone; nothing but the counts of examples' words is shuffled.

Defined results: null and empty texts, and texts that share no word with an example, get the score of a vote
without neighbours; labels that are null or whose document is missing are ignored, and a doc_id labelled twice
counts as toxic if either label is; rows equal in doc_id and text are one example, rows that share only a
doc_id are examples each; without toxic or without clean examples every score is the share of toxic examples,
or 0 if there are none at all; a null doc_id is scored and not held out; equal similarities are taken in order
of doc_id; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .common import held_out

MAX_EXAMPLES = 4_000
#: Scores that a worker remembers, by digests of the texts' words; many texts are copies.
REMEMBER = 50_000
K = 16
BLOCK = 64
#: Blocks that a search opens first.
OPEN_FIRST = 6
#: Terms that most examples have, so many at most, are held as a matrix instead of postings: texts are multiplied
#: with it many at a time, and its products enter the bounds of blocks as they are.
DENSE = 512
#: Weight of the prior in a vote, in units of a neighbour's weight.
PRIOR_WEIGHT = 0.25

#: Words are runs of ASCII letters, digits and any other characters of more than one byte.
SEPARATORS = np.array([not (chr(i).isalnum() or i >= 128) for i in range(256)])


def _scan(column: pa.Array):
    return textscan.slices(column, lower=True, separators=SEPARATORS)


def relevance(term: np.ndarray, example: np.ndarray, labels: np.ndarray, n_terms: int) -> np.ndarray:
    """Factor of each term, from the (term, example) pairs that occur."""
    n1, n2 = float(labels.sum()), float(len(labels) - labels.sum())
    if not n1 or not n2:
        return np.ones(n_terms)
    k1 = np.bincount(term, labels[example], n_terms)
    k2 = np.bincount(term, minlength=n_terms) - k1
    share = (k1 + k2) / (n1 + n2)

    def cell(k, expected):
        return k * np.log(np.maximum(k, 1e-300) / np.maximum(expected, 1e-300))

    statistic = 2 * (cell(k1, n1 * share) + cell(k2, n2 * share) + cell(n1 - k1, n1 * (1 - share)) + cell(n2 - k2, n2 * (1 - share)))
    root = np.sqrt(np.maximum(statistic, 0)) * (k1 * n2 > k2 * n1)
    return 1 + np.maximum(0, root - np.sqrt(2 * np.log(max(2, n_terms))))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count of them) for each start, one after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


class Index:
    """Block-max inverted index over unit vectors, and votes of its examples.

    ``example``, ``term`` and ``weight`` are the non-zero entries, ``words`` the hashes of the terms in order,
    ``factor`` their idf times relevance."""

    def __init__(self, words: np.ndarray, factor: np.ndarray, labels: np.ndarray, ids: np.ndarray, example: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self.words, self.factor, self.n_terms = words, factor, max(1, len(words))
        self.prior = float(labels.mean()) if len(labels) else 0.0
        # examples with the same strongest word stand together, so that block maxima differ
        lead = np.full(len(labels), -1, np.int32)
        order = np.lexsort((weight, example))
        lead[example[order]] = term[order]
        order = np.lexsort((ids, lead))
        place = np.argsort(order).astype(np.int32)
        self.labels, self.ids, example = labels[order].astype(np.float64), ids[order], place[example]
        self.n_blocks = max(1, -(-len(self.labels) // BLOCK))
        many = np.bincount(term, minlength=self.n_terms)
        often = np.argsort(-many, kind="stable")[:DENSE]
        often = np.sort(often[many[often] > BLOCK])
        self.dense_row = np.full(self.n_terms, -1, np.int32)
        self.dense_row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.n_blocks * BLOCK))
        full = self.dense_row[term] >= 0
        self.dense[self.dense_row[term[full]], example[full]] = weight[full]
        entries = example, term, weight
        example, term, weight = example[~full], term[~full], weight[~full]
        order = np.lexsort((example, term))
        example, term, weight = example[order], term[order], weight[order]
        self.post_example, self.post_weight = example.astype(np.int32), weight
        block = example // BLOCK
        start = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, np.int64)
        self.run_block, self.run_start = block[start].astype(np.int32), np.append(start, len(term)).astype(np.int32)
        self.run_most = np.maximum.reduceat(weight, start) if len(start) else np.zeros(0)
        self.run_of_term = np.searchsorted(term[start], np.arange(self.n_terms + 1)).astype(np.int32)
        self.curve = np.array([0.0, 1.0])
        self._calibrate(*entries)

    def products(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """What the matrix's terms add to the similarity of n texts and all examples."""
        full = self.dense_row[term] >= 0
        texts = np.zeros((n, len(self.dense)))
        texts[row[full], self.dense_row[term[full]]] = weight[full]
        return texts @ self.dense

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int = K, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar examples with a similarity above 0, and their similarities."""
        scores = (self.products(np.zeros(len(terms), np.int64), terms, weights, 1)[0] if base is None else base).copy()
        bounds = scores.reshape(self.n_blocks, BLOCK).max(axis=1)
        first = self.run_of_term[terms]
        count = self.run_of_term[terms + 1] - first
        runs = ranges(first, count)
        block, by = self.run_block[runs], np.repeat(weights, count)
        bounds += np.bincount(block, by * self.run_most[runs], self.n_blocks)
        open_, to_open = np.zeros(self.n_blocks, bool), bounds > 0
        if self.n_blocks > 2 * OPEN_FIRST:
            to_open &= bounds >= np.partition(bounds, -OPEN_FIRST)[-OPEN_FIRST]
        while to_open.any():
            open_ |= to_open
            own = np.flatnonzero(to_open[block])
            start = self.run_start[runs[own]]
            size = self.run_start[runs[own] + 1] - start
            at = ranges(start, size)
            scores += np.bincount(self.post_example[at], self.post_weight[at] * np.repeat(by[own], size), len(scores))
            # sums so far are below the similarities, so the k-th largest is so too
            worst = max(0.0, np.partition(scores, -k)[-k]) if len(scores) >= k else 0.0
            to_open = ~open_ & (bounds > 0) & (bounds >= worst - 1e-9)
        near = np.flatnonzero(scores > 0)
        if len(near) > k:
            near = near[scores[near] >= np.partition(scores[near], -k)[-k]]
        top = near[np.lexsort((self.ids[near], -scores[near]))[:k]]
        return top, scores[top]

    def vote(self, terms: np.ndarray, weights: np.ndarray, without: int = -1, base: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """Distance-weighted vote, the neighbours and their similarities; ``without``: an example without a say."""
        at, near = self.search(terms, weights, K + (without >= 0), base)
        if without >= 0:
            at, near = at[at != without][:K], near[at != without][:K]
        w = near / (1.02 - np.minimum(near, 1.0))
        return float((w @ self.labels[at] + PRIOR_WEIGHT * self.prior) / (w.sum() + PRIOR_WEIGHT)), at, near

    @staticmethod
    def _features(vote) -> np.ndarray:
        vote = np.clip(vote, 1e-3, 1 - 1e-3)
        return np.stack([np.ones_like(vote), np.log(vote / (1 - vote))], axis=-1)

    def _calibrate(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression with a small ridge, by Newton steps, over votes of all other examples."""
        if len(np.unique(self.labels)) < 2:
            return
        order = np.lexsort((term, example))
        example, term, weight = example[order], term[order], weight[order]
        votes = []
        for lo in range(0, len(self.labels), 256):
            cuts = np.searchsorted(example, np.arange(lo, min(lo + 256, len(self.labels)) + 1))
            own = slice(cuts[0], cuts[-1])
            bases = self.products(example[own] - lo, term[own], weight[own], len(cuts) - 1)
            votes += [self.vote(term[a:b], weight[a:b], lo + i, bases[i])[0] for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        votes = np.array(votes)
        x, beta = self._features(votes), np.array([0.0, 1.0])
        ridge, centre = np.diag([0.1, 1.0]), beta.copy()
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (self.labels - p) - ridge @ (beta - centre))
            beta = beta + step
            if np.abs(step).max() < 1e-9:
                break
        self.curve = beta

    def scores(self, row: np.ndarray, term: np.ndarray, count: np.ndarray, n: int, known: dict) -> list:
        """(score, ids of the neighbours, their similarities) of n texts by their indexed words and counts, in
        order of row; ``known`` has results by digests of words and counts."""
        cuts = np.searchsorted(row, np.arange(n + 1))
        keys = [hashlib.blake2b(term[a:b].tobytes() + count[a:b].tobytes(), digest_size=16).digest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        fresh = list({k: i for i, k in enumerate(keys) if k not in known}.values())
        weight = (1 + np.log(count)) * self.factor[term]
        weight /= np.maximum(np.sqrt(np.bincount(row, weight**2, n)), 1e-300)[row]
        for lo in range(0, len(fresh), 256):
            some = np.array(fresh[lo : lo + 256])
            of = np.repeat(np.arange(len(some)), cuts[some + 1] - cuts[some])
            at = ranges(cuts[some], cuts[some + 1] - cuts[some])
            bases = self.products(of, term[at], weight[at], len(some))
            for i, base in zip(some.tolist(), bases, strict=True):
                own = slice(cuts[i], cuts[i + 1])
                known[keys[i]] = self._scored(*self.vote(term[own], weight[own], base=base))
        return [known[k] for k in keys]

    def _scored(self, vote: float, at: np.ndarray, near: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        if not 0 < self.prior < 1:
            return self.prior, self.ids[at], near
        return float(1 / (1 + np.exp(-np.clip(self._features(vote) @ self.curve, -30, 30)))), self.ids[at], near


def _found(part: textscan.Slice, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, indexed words and counts of the words in a slice, ordered by row and word."""
    at = np.minimum(np.searchsorted(words, part.hashes), max(0, len(words) - 1))
    hit = np.flatnonzero(words[at] == part.hashes) if len(words) else np.zeros(0, np.int64)
    pair, count = np.unique(part.doc_of_word()[hit] * max(1, len(words)) + at[hit], return_counts=True)
    return pair // max(1, len(words)), pair % max(1, len(words)), count


def _example_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct words and their counts."""
    for batch in batches:
        for part in _scan(batch.column("text")):
            rows = batch.slice(part.lo, part.hi - part.lo)
            pieces = [np.unique(part.hashes[a:b], return_counts=True) for a, b in zip(part.first[:-1], part.first[1:], strict=True)]
            words, counts = (pa.array([x[k].view(np.int64) for x in pieces], pa.list_(pa.int64())) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("toxic"), words, counts], ["doc_id", "toxic", "words", "counts"])


def _word_counts(shipped):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shipped.value
        total, n = np.zeros(len(words), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for part in _scan(batch.column("text")):
                total += np.bincount(_found(part, words)[1], minlength=len(words))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1), pa.int32()), pa.array(np.append(total[hit], n), pa.int64())], ["term", "df"])

    return count


def _scorer(shipped):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = shipped.value, {}
        for batch in batches:
            if len(known) > REMEMBER:
                known.clear()
            for part in _scan(batch.column("text")):
                n = part.hi - part.lo
                made = index.scores(*_found(part, index.words), n, known)
                rows = batch.slice(part.lo, n)
                columns = [c for c in rows.schema.names if c != "text"]
                scores, ids, near = zip(*made, strict=True) if made else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in columns), pa.array(scores, pa.float64()), pa.array(ids, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.float64()))],
                    [*columns, "score", "neighbours", "similarities"],
                )

    return score


def examples(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of at most MAX_EXAMPLES labelled rows outside the held-out fold."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
    return rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_EXAMPLES)


def fit(docs: DataFrame, labels: DataFrame) -> Index:
    """The index; what reaches the driver is the words of at most MAX_EXAMPLES texts, and a count for each."""
    # examples() has at most MAX_EXAMPLES rows of two numbers, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(examples(labels)), "doc_id").dropDuplicates(["doc_id", "text"])
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.md5("text")).limit(MAX_EXAMPLES)
    found = rows.mapInArrow(_example_words, "doc_id long, toxic int, words array<long>, counts array<long>").toArrow().sort_by("doc_id")
    flat = lambda name: found.column(name).combine_chunks()
    ids, marks, lists = flat("doc_id").to_numpy(), flat("toxic").to_numpy().astype(np.int64), flat("words")
    example = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
    words, term = np.unique(lists.flatten().to_numpy().view(np.uint64), return_inverse=True)
    counts = flat("counts").flatten().to_numpy().astype(np.float64)
    del found, lists
    pa.default_memory_pool().release_unused()  # the driver keeps the index alone
    example, term = example.astype(np.int32), term.astype(np.int32)
    shipped = docs.sparkSession.sparkContext.broadcast(words)
    df, n_docs = np.zeros(len(words)), 0
    got = docs.select("text").mapInArrow(_word_counts(shipped), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    at, n = got.column("term").to_numpy(), got.column("df").to_numpy()
    n_docs = n[at < 0].sum()
    df[at[at >= 0]] = n[at >= 0]
    factor = (np.log((1 + n_docs) / (1 + df)) + 1) * relevance(term, example, marks, len(words))
    weight = np.log(counts, out=counts)
    weight += 1
    weight *= factor[term]
    norm = np.sqrt(np.bincount(example, weight**2, len(ids)))
    weight /= np.maximum(norm, 1e-300)[example]
    shipped.destroy()
    return Index(words, factor, marks, ids.astype(np.int64), example, term, weight)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, neighbours, similarities) of every document."""
    index = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(index), "doc_id long, score double, neighbours array<long>, similarities array<double>")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "similarities")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic; columns and kept rows are unchanged."""
    index = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return docs.mapInArrow(lambda batches: _kept(index, batches), docs.schema)


def _kept(index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    score = _scorer(index)
    for batch in batches:
        text = pa.RecordBatch.from_arrays([batch.column("text")], ["text"])
        scores = np.concatenate([b.column("score").to_numpy() for b in score(iter([text]))] or [np.zeros(0)])
        yield batch.filter(pa.array(scores < 0.5))
