"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A model file gives pieces with log scores. Their UTF-8 bytes make a double-array trie. The best
segmentation of a text maximises the sum of its pieces' scores; a character that no piece covers is
spelt by byte pieces, at a penalty below the least score. White space is written as the marker U+2581,
with one in front of the text, and no piece has a marker after another character, so the best path of
a text is made of the best paths of its runs "markers, then other characters". A run is segmented once as
long as a worker remembers it, and all new runs step through the trie together, as array operations.

Decoding joins the pieces' bytes, turns byte pieces back into bytes and markers into spaces, and drops
the space in front; invalid UTF-8 becomes U+FFFD. Decoding an encoding gives back every text that has
no marker of its own; ``exact`` is false for the others, whose markers come back as spaces.

Defined results: null and empty texts have no ids; texts of any length are encoded whole; equal scores
are settled in favour of the longest last piece; rows equal in all columns have equal results; an empty
table gives an empty result; further columns pass through.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

MARK = "▁"
MARK_BYTES = MARK.encode()
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
#: Texts are encoded in groups of about so many bytes.
GROUP_BYTES = 1 << 20
#: Runs of so many bytes or more are searched one by one, byte by byte.
LONG_RUN = 512
#: Distinct runs, and pieces in them, that a worker remembers from group to group.
REMEMBER_RUNS, REMEMBER_PIECES = 400_000, 4_000_000


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """Fields of a protocol-buffer message: number, wire type, value."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield tag >> 3, kind, value


def read_pieces(data: bytes) -> list[tuple[bytes, float, int]]:
    """(bytes, score, type) of each piece of a model file, in order of id."""
    out = []
    for number, _, value in _fields(data):
        if number == 1:
            own = {n: v for n, _, v in _fields(value)}
            out.append((own.get(1, b""), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
    return out


class Trie:
    """Double-array trie over byte strings: the child of state s by byte b is base[s] + b, if check of
    that is s. value is the id of the string that ends in a state, or -1."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        keys = sorted(keys)
        self.base, self.check, self.value = [0], [0], [-1]
        used = bytearray(b"\1")  # cells that are taken; the arrays grow with it
        pending, low = [(0, 0, len(keys), 0)], 1
        while pending:
            state, lo, hi, depth = pending.pop()
            if lo < hi and len(keys[lo][0]) == depth:
                self.value[state] = keys[lo][1]
                lo += 1
            if lo == hi:
                continue
            children, start = [], lo
            for i in range(lo + 1, hi + 1):
                if i == hi or keys[i][0][depth] != keys[start][0][depth]:
                    children.append((keys[start][0][depth], start, i))
                    start = i
            while low < len(used) and used[low]:
                low += 1
            base = self._fit(used, low, [c[0] for c in children])
            more = base + 257 - len(used)
            if more > 0:
                used.extend(bytes(more))
                self.base.extend([0] * more)
                self.check.extend([-1] * more)
                self.value.extend([-1] * more)
            self.base[state] = base
            for c, a, b in children:
                used[base + c] = 1
                self.check[base + c] = state
                pending.append((base + c, a, b, depth + 1))
        pad = [0] * 256  # a step may look past the last cell
        self.base, self.check, self.value = (np.array([*x, *(v + d for v in pad)], np.int32) for x, d in ((self.base, 0), (self.check, -1), (self.value, -1)))

    @staticmethod
    def _fit(used: bytearray, low: int, labels: list[int]) -> int:
        """The first base from which all labels fall on free cells."""
        first, rest = labels[0], labels[1:]
        at = max(low, first + 1)
        while True:
            at = used.find(0, at)
            if at < 0:
                return max(len(used), first + 1) - first
            base = at - first
            if all(base + c >= len(used) or not used[base + c] for c in rest):
                return base
            at += 1

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Child states; -1 where there is none."""
        to = self.base[states] + symbols
        return np.where((self.check[to] == states) & (to > 0), to, -1)

    def find(self, key: bytes) -> int:
        state = 0
        for byte in key:
            state = int(self.step(np.array([state]), np.array([byte]))[0])
            if state < 0:
                return -1
        return int(self.value[state])


class Numbers(dict):
    """Numbers keys as they are asked for first; ``fresh`` has those that are new."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.fresh.append(key)
        return n


class Model:
    """Pieces, their trie, and encoding and decoding with them."""

    def __init__(self, data: bytes):
        self.pieces = read_pieces(data)
        self.scores = np.array([p[1] for p in self.pieces], np.float64)
        kinds = [p[2] for p in self.pieces]
        plain = [(p, i) for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)]
        # a marker inside a piece would tie runs together; cut() relies on there being none
        whole = [p for p, _ in plain if MARK_BYTES in p.lstrip(MARK_BYTES) and MARK in p.decode().lstrip(MARK)]
        if whole:
            raise ValueError(f"pieces hold a marker after another character: {whole[:3]}")
        self.trie = Trie(plain)
        self.bytes = np.full(256, kinds.index(UNKNOWN) if UNKNOWN in kinds else 0, np.int32)
        for i, (p, _, kind) in enumerate(self.pieces):
            if kind == BYTE:
                self.bytes[int(p[1:-1], 16)] = i
        self.unknown = min((self.scores[i] for i, k in enumerate(kinds) if k == NORMAL), default=0.0) - UNKNOWN_PENALTY
        text = [bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p for p, _, k in self.pieces]
        self.text = text
        self.split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self._forget()

    # -- encoding ---------------------------------------------------------------------------------

    def runs(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best path of each run data[first : first + size], one run after the other, and their
        numbers."""
        n, longest = len(first), int(size.max(initial=0))
        padded = np.concatenate([data, np.zeros(longest + 1, np.uint8)])
        text = padded[first[:, None] + np.arange(longest + 1)]
        text[np.arange(longest + 1) >= size[:, None]] = 0
        head = (text & 0xC0) != 0x80
        best = np.full((n, longest + 1), -np.inf)
        best[:, 0] = 0.0
        from_, piece = np.zeros((n, longest + 1), np.int32), np.full((n, longest + 1), -1, np.int32)
        for i in range(longest):
            row = np.flatnonzero((size > i) & head[:, i] & (best[:, i] > -np.inf))
            start_score = best[row, i]
            width = np.where(text[row, i] < 0x80, 1, np.where(text[row, i] < 0xE0, 2, np.where(text[row, i] < 0xF0, 3, 4)))
            state, at, alive, lone = np.zeros(len(row), np.int32), i, np.arange(len(row)), np.zeros(len(row), bool)
            while len(alive) and at < longest:
                inside = size[row[alive]] > at
                alive, state = alive[inside], state[inside]
                state = self.trie.step(state, text[row[alive], at].astype(np.int32))
                alive, state = alive[state >= 0], state[state >= 0]
                at += 1
                value = self.trie.value[state]
                hit = value >= 0
                own, value = alive[hit], value[hit]
                lone[own[width[own] == at - i]] = True
                score = start_score[own] + self.scores[value]
                better = score > best[row[own], at]
                own, value, score = own[better], value[better], score[better]
                best[row[own], at], from_[row[own], at], piece[row[own], at] = score, i, value
            rest = np.flatnonzero(~lone)
            end = np.minimum(i + width[rest], size[row[rest]])
            score = start_score[rest] + self.unknown
            better = score > best[row[rest], end]
            rest, end, score = rest[better], end[better], score[better]
            best[row[rest], end], from_[row[rest], end], piece[row[rest], end] = score, i, -1
        # walk all paths back together, one piece of each in a round
        at, row, steps = size.astype(np.int64), np.arange(n), []
        while len(row := row[at[row] > 0]):
            begin = from_[row, at[row]]
            steps.append((row, begin, at[row], piece[row, at[row]]))
            at[row] = begin
        if not steps:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        row, begin, end, value = (np.concatenate([s[k] for s in steps[::-1]]) for k in range(4))
        spelt = value < 0
        times = np.where(spelt, end - begin, 1)
        ids = np.repeat(value, times)
        row_of = np.repeat(row, times)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin, times)
        gap = np.flatnonzero(ids < 0)
        ids[gap] = self.bytes[text[row_of[gap], place[gap]]]
        order = np.argsort(row_of, kind="stable")
        return ids[order], np.bincount(row_of, minlength=n)

    def long_run(self, data: bytes) -> np.ndarray:
        """Ids of the best path of one long run; the same as ``runs`` gives, without arrays for each byte."""
        base, check, value = (x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value))
        scores, n = self.scores.tolist(), len(data)
        best, begin, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here == -np.inf:  # inside a character
                continue
            first = data[i]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            state, at, lone = 0, i, False
            while at < n:
                to = base[state] + data[at]
                if check[to] != state or to == 0:
                    break
                state, at = to, at + 1
                own = value[state]
                if own >= 0:
                    lone = lone or at - i == width
                    if here + scores[own] > best[at]:
                        best[at], begin[at], piece[at] = here + scores[own], i, own
            if not lone:
                at = min(i + width, n)
                if here + self.unknown > best[at]:
                    best[at], begin[at], piece[at] = here + self.unknown, i, -1
        ids, at = [], n
        while at > 0:
            i = begin[at]
            ids += [piece[at]] if piece[at] >= 0 else self.bytes[np.frombuffer(data[i:at], np.uint8)].tolist()[::-1]
            at = i
        return np.array(ids[::-1], np.int32)

    def _forget(self) -> None:
        self.known, self.flat = Numbers(), np.zeros(0, np.int32)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        """Find the best paths of the runs that are new."""
        fresh = [r.encode("utf-8", "surrogatepass") for r in self.known.fresh]
        self.known.fresh.clear()
        size = np.array([len(x) for x in fresh], np.int64)
        order = np.argsort(size, kind="stable")
        begin, count, parts, at, lo = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64), [self.flat], len(self.flat), 0
        while lo < len(order) and size[order[lo]] < LONG_RUN:  # runs of like length together, and a bounded table for each group
            hi = lo + 1
            while hi < len(order) and size[order[hi]] < LONG_RUN and (hi - lo + 1) * (size[order[hi]] + 1) <= 1 << 19 and size[order[hi]] <= 1.3 * size[order[lo]] + 2:
                hi += 1
            group = order[lo:hi]
            data = np.frombuffer(b"".join([fresh[i] for i in group]), np.uint8)
            ids, n = self.runs(data, np.cumsum(size[group]) - size[group], size[group])
            begin[group], count[group] = at + np.cumsum(n) - n, n
            parts.append(ids)
            at, lo = at + len(ids), hi
        for i in order[lo:]:
            ids = self.long_run(fresh[i])
            begin[i], count[i] = at, len(ids)
            parts.append(ids)
            at += len(ids)
        self.flat = np.concatenate(parts)
        self.begin, self.count = np.concatenate([self.begin, begin]), np.concatenate([self.count, count])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.known) > REMEMBER_RUNS or len(self.flat) > REMEMBER_PIECES:
            self._forget()
        number, split = self.known.__getitem__, self.split
        lists = [np.array([number(r) for r in split(MARK + text.replace(" ", MARK))] if text else [], np.int64) for text in texts]
        if self.known.fresh:
            self._learn()
        out = []
        for r in lists:
            times = self.count[r]
            ends = np.cumsum(times)
            out.append(self.flat[np.repeat(self.begin[r] - (ends - times), times) + np.arange(ends[-1] if len(ends) else 0)])
        return out

    # -- decoding ---------------------------------------------------------------------------------

    def decode(self, ids) -> str:
        """The text of some ids; ids out of range raise IndexError."""
        text = b"".join([self.text[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


@functools.lru_cache(2)
def _model(data: bytes) -> Model:
    return Model(data)


def _shipped(model_file) -> Model:
    """The model of a broadcast file; workers keep two, by their bytes."""
    return _model(model_file.value)


def _ship(spark, path: str):
    """The bytes of a model file, of a fixed size whatever the input, for all tasks."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    lo = size = 0
    lengths = pa.compute.binary_length(batch.column("text")).fill_null(0).to_numpy()
    for i, n in enumerate(lengths):
        if size and size + n > GROUP_BYTES:
            yield batch.slice(lo, i - lo)
            lo, size = i, 0
        size += n
    if lo < batch.num_rows:
        yield batch.slice(lo)


def _encoder(model_file):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _shipped(model_file)
        for batch in batches:
            for part in _groups(batch):
                texts = [x or "" for x in part.column("text").to_pylist()]
                ids = model.encode(texts)
                exact = [model.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                rest = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(exact)], [*rest, "ids", "exact"])

    return encode


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), model_file: str | None = None) -> DataFrame:
    """The columns ``keep``, ids array<int> and exact (whether decoding gives back the text) of every
    document."""
    shipped = _ship(docs.sparkSession, model_file or default_model())
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "ids array<int>", "exact boolean"])
    return docs.select(*keep, "text").mapInArrow(_encoder(shipped), schema)


def decode(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id and text of rows with ``ids``."""
    shipped = _ship(encoded.sparkSession, model_file or default_model())

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _shipped(shipped)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([model.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(texts, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def ids_digest(ids) -> str:
    """sha256 of ids as little-endian 32-bit numbers."""
    return hashlib.sha256(np.asarray(ids, "<i4").tobytes()).hexdigest()
