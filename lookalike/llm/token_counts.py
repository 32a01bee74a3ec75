"""Edit-aware token counts.

A document's pre-tokens are the leaves of a segment tree that sums characters and tokens. An edit
replaces a span of characters: the tree is descended to the first leaf whose match could depend on the
span, pre-tokens are read again from there until a boundary of the old text is met behind the span, and
only those pre-tokens are encoded; the sums above the leaves that changed are updated. The pattern looks
at most one character past a pre-token's end, plus one where white space gives back a character, and
never behind its start, so a boundary met behind the span proves that the rest is unchanged.

Leaves stand in blocks, so that an edit moves few of them; block sums are the tree's lowest level.

``trees`` gives a table of every document's leaves, to be written; ``edited`` joins a table of edits to it
and gives the table as it is then, to be written for the next edits. Documents without edits are neither
read into trees nor encoded. ``edited_counts`` counts before and after edits that a function finds.

Defined results: null and empty texts have no tokens and no pre-tokens; edits that touch or meet are
applied as they come, from the last to the first; overlapping edits, and leaves that are not those of their
text, are an error; rows equal in all columns have equal results; edits go to every row with their doc_id,
and those of no row, or without doc_id, begin or end, do nothing; a null replacement is an empty one; a
null text is an empty one once edited; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Leaves of a block, about; a block splits at twice as many.
BLOCK = 64
#: So many edits at most are made one by one, each in a time that grows with the text's length at a low rate.
FEW_EDITS = 16
#: Distinct pre-tokens whose counts a worker remembers.
REMEMBER = 500_000

Edit = tuple[int, int, str]


def default_vocabulary() -> tuple[str, str]:
    """The public byte-level vocabulary's rank file, and its pre-token pattern."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


class Counter:
    """Number of tokens of a pre-token."""

    def __init__(self, ranks_: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def __call__(self, pre_token: str) -> int:
        n = self.known.get(pre_token)
        if n is None:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            n = self.known[pre_token] = len(self.encoding.encode_ordinary(pre_token))
        return n

    def pre_tokens(self, text: str) -> list[str]:
        return self.pattern.findall(text)


class Tree:
    """Pre-tokens of one text with sums over blocks of them."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter, self.encoded = text, counter, 0
        leaves = self._leaves(counter.pre_tokens(text))
        self.blocks = [leaves[i : i + BLOCK] for i in range(0, len(leaves), BLOCK)] or [[]]
        self._build()

    @classmethod
    def restore(cls, text: str, chars: list[int], tokens: list[int], counter: Counter) -> Tree:
        """The tree of a text from its kept leaves; nothing is encoded."""
        if len(chars) != len(tokens) or sum(chars) != len(text):
            raise ValueError("the leaves are not those of the text")
        tree = cls("", counter)
        leaves = list(zip(chars, tokens, strict=True))
        tree.text, tree.blocks = text, [leaves[i : i + BLOCK] for i in range(0, len(leaves), BLOCK)] or [[]]
        tree._build()
        return tree

    def kept(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves."""
        leaves = [x for block in self.blocks for x in block]
        return [n for n, _ in leaves], [n for _, n in leaves]

    def _leaves(self, pre_tokens: list[str]) -> list[tuple[int, int]]:
        self.encoded += len(pre_tokens)
        count = self.counter
        return [(len(p), count(p)) for p in pre_tokens]

    def _build(self) -> None:
        self.size = 1
        while self.size < len(self.blocks):
            self.size *= 2
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, block in enumerate(self.blocks, self.size):
            self.chars[i], self.tokens[i] = sum(x[0] for x in block), sum(x[1] for x in block)
        for i in range(self.size - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _update(self, k: int) -> None:
        i, block = k + self.size, self.blocks[k]
        self.chars[i], self.tokens[i] = sum(x[0] for x in block), sum(x[1] for x in block)
        while i := i // 2:
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_pre_tokens(self) -> int:
        return sum(map(len, self.blocks))

    def _find(self, at: int) -> tuple[int, int, int]:
        """Block, leaf and start of the leaf that holds character ``at``, or the end."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if at - start >= self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        block = min(i - self.size, len(self.blocks) - 1)
        leaves = self.blocks[block]
        for k, (n, _) in enumerate(leaves):
            if at < start + n:
                return block, k, start
            start += n
        return block, len(leaves), start

    def edit(self, begin: int, end: int, new: str) -> None:
        """Replace characters begin to end by ``new``."""
        if not 0 <= begin <= end <= len(self.text):
            raise ValueError(f"span {begin}:{end} is outside a text of {len(self.text)} characters")
        # leaves that end at begin - 2 or before cannot see the span
        block, leaf, start = self._find(max(0, begin - 2))
        text = self.text[:begin] + new + self.text[end:]
        shift, new_end = len(new) - (end - begin), begin + len(new)
        b, k, old = block, leaf, start  # walks the old leaves, as far as the new ones have come
        fresh, at, match = [], start, self.counter.pattern.match
        while at < len(text):
            while b < len(self.blocks) and old + shift < at:
                if k == len(self.blocks[b]):
                    b, k = b + 1, 0
                    continue
                old += self.blocks[b][k][0]
                k += 1
            if at >= new_end and old >= end and old + shift == at:
                break
            found = match(text, at)
            fresh.append(found[0])
            at = found.end()
        else:
            b, k = len(self.blocks), 0
        if b < len(self.blocks):
            leaves = self.blocks[block][:leaf] + self._leaves(fresh) + self.blocks[b][k:]
            last = b + 1
        else:
            leaves, last = self.blocks[block][:leaf] + self._leaves(fresh), len(self.blocks)
        self.text = text
        if last == block + 1 and 0 < len(leaves) <= 2 * BLOCK:
            self.blocks[block] = leaves
            self._update(block)
        else:
            self.blocks[block:last] = [leaves[i : i + BLOCK] for i in range(0, len(leaves), BLOCK)]
            self.blocks = self.blocks or [[]]
            self._build()

    def apply(self, edits: list[Edit]) -> None:
        """Apply edits of the text as it is. A few are made one by one; many in one pass over the leaves."""
        edits = sorted(edits)
        for (_, end, _), (begin, _, _) in zip(edits, edits[1:], strict=False):
            if end > begin:
                raise ValueError("edits overlap")
        if len(edits) <= FEW_EDITS:
            for begin, end, new in reversed(edits):
                self.edit(begin, end, new)
        else:
            self._pass(edits)

    def _pass(self, edits: list[Edit]) -> None:
        """All edits from left to right: the text is joined once, leaves that no edit can reach are kept, and
        block sums and the tree above them are made once."""
        if not all(0 <= begin <= end <= len(self.text) for begin, end, _ in edits):
            raise ValueError(f"a span is outside a text of {len(self.text)} characters")
        pieces, done = [], 0
        for begin, end, new in edits:
            pieces += [self.text[done:begin], new]
            done = end
        text = "".join([*pieces, self.text[done:]])
        old, out, match = [x for b in self.blocks for x in b], [], self.counter.pattern.match
        k = start = shift = at = i = 0  # old leaf and its start; the new text is ahead by shift at it
        while i < len(edits):
            # leaves that end at begin - 2 or before cannot see the span
            while k < len(old) and start + old[k][0] <= max(0, edits[i][0] - 2):
                out.append(old[k])
                start += old[k][0]
                k += 1
            at, fresh, first = start + shift, [], i
            while at < len(text):
                while i < len(edits) and edits[i][0] + shift <= at + 2:  # the edits that the place has come to
                    shift += len(edits[i][2]) - (edits[i][1] - edits[i][0])
                    i += 1
                behind = edits[i - 1][1] + shift if i else 0
                while k < len(old) and start + shift < at:
                    start += old[k][0]
                    k += 1
                # a leaf may begin well before its edit: nothing is kept until an edit of this round is behind
                if i > first and at >= behind and start + shift == at and start >= edits[i - 1][1]:
                    break
                found = match(text, at)
                fresh.append(found[0])
                at = found.end()
            else:
                k, i = len(old), len(edits)
            out += self._leaves(fresh)
        out += old[k:]
        self.text = text
        self.blocks = [out[j : j + BLOCK] for j in range(0, len(out), BLOCK)] or [[]]
        self._build()


_DIGITS = regex.compile(r"\d(?:[ -]?\d){6,}")


def cleaning_edits(text: str) -> list[Edit]:
    """Edits of a cleaning pass: lines that equal an earlier line go, with their line ends, and runs of
    seven or more digits become ``<number>``."""
    edits, seen, at = [], set(), 0
    for line in text.splitlines(keepends=True) if "\n" in text else [text]:
        key = line.rstrip("\r\n")
        if key.strip() and key in seen:
            edits.append((at, at + len(line), ""))
        else:
            seen.add(key)
            edits.extend((at + m.start(), at + m.end(), "<number>") for m in _DIGITS.finditer(line))
        at += len(line)
    return edits


@functools.lru_cache(2)
def _counter(ranks: bytes, pattern: str) -> Counter:
    return Counter(ranks, pattern)


def _ranks(docs: DataFrame, vocabulary: tuple[str, str] | None):
    """The ranks, broadcast, and the pattern; ranks have a fixed size whatever the input."""
    path, pattern = vocabulary or default_vocabulary()
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read()), pattern


_INTS = pa.list_(pa.int32())
_KEPT = ["doc_id", "text", "chars", "tokens", "n_tokens", "n_encoded"]


def _kept_schema(docs: DataFrame) -> str:
    return f"doc_id {dict(docs.dtypes)['doc_id']}, text string, chars array<int>, tokens array<int>, n_tokens long, n_encoded long"


def trees(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, text, chars, tokens, n_tokens, n_encoded) of every document: the characters and tokens of its
    pre-tokens in order, its tokens in all, and the pre-tokens that were encoded, here all."""
    ranks, pattern = _ranks(docs, vocabulary)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(ranks.value, pattern)
        for batch in batches:
            made = [Tree(text.as_py() or "", counter) for text in batch.column("text")]
            chars, tokens = zip(*(t.kept() for t in made), strict=True) if made else ((), ())
            sums = [pa.array(x, pa.int64()) for x in ([t.n_tokens for t in made], [t.encoded for t in made])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(chars, _INTS), pa.array(tokens, _INTS), *sums], _KEPT)

    return docs.select("doc_id", "text").mapInArrow(build, _kept_schema(docs))


def edited(kept: DataFrame, edits: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """The rows of ``trees`` after edits (doc_id, begin, end, new) of the texts as they stand in ``kept``;
    n_encoded is the number of pre-tokens encoded again, 0 for a document without edits.

    A document's edits are gathered beside its text; as they don't overlap, the text bounds them. Rows
    without doc_id, which have no edits, are left out of the join, so they don't meet in one task."""
    ranks, pattern = _ranks(kept, vocabulary)
    rows = kept.select("doc_id", "text", "chars", "tokens", "n_tokens").withColumn("n_encoded", F.lit(0).cast("long"))
    usable = edits.where("doc_id is not null and begin is not null and end is not null")
    span = F.struct(F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"), F.coalesce("new", F.lit("")).alias("new"))
    gathered = usable.groupBy("doc_id").agg(F.collect_list(span).alias("_edits"))
    joined = rows.where("doc_id is not null").join(gathered, "doc_id", "left")

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(ranks.value, pattern)
        for batch in batches:
            rows = []
            for text, chars, tokens, own in zip(*(batch.column(name) for name in ("text", "chars", "tokens", "_edits")), strict=True):
                tree = Tree.restore(text.as_py() or "", chars.as_py(), tokens.as_py(), counter)
                tree.apply([(e["begin"], e["end"], e["new"]) for e in own.as_py()])
                rows.append((tree.text, *tree.kept(), tree.n_tokens, tree.encoded))
            kinds = pa.string(), _INTS, _INTS, pa.int64(), pa.int64()
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], _KEPT)

    changed = joined.where("_edits is not null").mapInArrow(change, _kept_schema(kept))
    same = joined.where("_edits is null").drop("_edits").unionByName(rows.where("doc_id is null"))
    return changed.unionByName(same)


def edited_counts(docs: DataFrame, edits: Callable[[str], list[Edit]] = cleaning_edits, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Token counts of every document before and after its edits: (doc_id, n_tokens, n_pre_tokens,
    n_edits, n_tokens_after, n_pre_tokens_after, n_encoded), the last being the number of pre-tokens that
    were encoded again. The ranks, of a fixed size whatever the input, are broadcast."""
    ranks, pattern = _ranks(docs, vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(ranks.value, pattern)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                tree = Tree(text.as_py() or "", counter)
                before = tree.n_tokens, tree.n_pre_tokens
                own = edits(tree.text)
                tree.encoded = 0
                tree.apply(own)
                rows.append((*before, len(own), tree.n_tokens, tree.n_pre_tokens, tree.encoded))
            columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_tokens", "n_pre_tokens", "n_edits", "n_tokens_after", "n_pre_tokens_after", "n_encoded"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_tokens long, n_pre_tokens long, n_edits long, n_tokens_after long, n_pre_tokens_after long, n_encoded long")
