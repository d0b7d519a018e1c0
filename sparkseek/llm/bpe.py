"""Byte-level BPE: encoding by segment trees of pair ranks, and decoding."""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import column, mapped, private, slices, text_buffer

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How text is split before the merges; no merge crosses a split.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of more bytes get a tree of their own instead of a row in a batch of trees.
LONG = 2048
#: Leaves that one batch of trees may have.
BATCH = 1 << 19
INF = np.int64(1) << 62
BITS = 21
#: Distinct pieces that a worker remembers.
REMEMBERED = 300_000


class Vocabulary:
    """Token bytes by rank, and the rank of each pair of tokens whose bytes on end are a token."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = pattern
        self.size = max(ranks.values()) + 1
        of = [b""] * self.size
        for token, rank in ranks.items():
            of[rank] = token
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.lengths = np.array([len(t) for t in of], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.data = np.frombuffer(b"".join(of), np.uint8)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << BITS | b] = rank
        self._hashed(pairs)

    def _hashed(self, pairs: dict[int, int]) -> None:
        """An open-addressed table with linear probing, so that many pairs are looked up at once."""
        self.bits = max(4, (4 * len(pairs)).bit_length())
        keys, values = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[free[first]]
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, at = keys[left], values[left], (at[left] + ~free[left]) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for none; b = -1 stands for no neighbour."""
        keys = a << BITS | np.maximum(b, 0)
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        out[(b < 0) | (a < 0)] = -1
        return out

    def rank_one(self, a: int, b: int) -> int:
        key, mask = a << BITS | b, (1 << self.bits) - 1
        at = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while (found := self.keys[at]) != -1:
            if found == key:
                return int(self.values[at])
            at = (at + 1) & mask
        return -1


def merge_batch(vocabulary: Vocabulary, pieces: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of pieces of at most n bytes (a power of two), on end, and the number for each piece.

    Row i of the tree array is the tree of piece i: leaf p holds rank * n + p for the pair that begins at byte p, so
    the root is the leftmost pair of least rank. A merge changes three leaves and what is above them.
    """
    w = len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, w)
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    row = np.repeat(np.arange(w), lengths)
    col = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    token = np.full((w, n), -1, np.int64)
    token[row, col] = vocabulary.byte_ids[raw]
    after = np.tile(np.arange(1, n + 1), (w, 1))
    after[np.arange(n)[None, :] >= lengths[:, None] - 1] = -1
    before = np.tile(np.arange(-1, n - 1), (w, 1))
    tree = np.full((w, 2 * n), INF, np.int64)
    left, right = token[:, :-1].ravel(), token[:, 1:].ravel()
    rank = np.full((w, n), -1, np.int64)
    rank[:, : n - 1] = vocabulary.rank(left, right).reshape(w, n - 1)
    tree[:, n:] = np.where(rank >= 0, rank * n + np.arange(n), INF)
    at = n
    while at > 1:
        tree[:, at // 2 : at] = np.minimum(tree[:, at : 2 * at : 2], tree[:, at + 1 : 2 * at : 2])
        at //= 2
    flat, tok, nxt, prv = tree.ravel(), token.ravel(), after.ravel(), before.ravel()
    live = np.flatnonzero(tree[:, 1] < INF)

    def put(rows: np.ndarray, pos: np.ndarray, value: np.ndarray) -> None:
        base, node = rows * (2 * n), pos + n
        flat[base + node] = value
        node = node >> 1
        for _ in range(n.bit_length() - 1):
            under = base + 2 * node
            flat[base + node] = np.minimum(flat[under], flat[under + 1])
            node >>= 1

    def key(rows: np.ndarray, pos: np.ndarray) -> np.ndarray:
        b = nxt[rows * n + pos]
        r = vocabulary.rank(tok[rows * n + pos], np.where(b >= 0, tok[rows * n + np.maximum(b, 0)], -1))
        return np.where(r >= 0, r * n + pos, INF)

    while len(live):
        root = flat[live * (2 * n) + 1]
        pos = root % n
        here = live * n + pos
        gone = nxt[here]
        tok[here] = root // n
        beyond = nxt[live * n + gone]
        nxt[here] = beyond
        has = beyond >= 0
        prv[live[has] * n + beyond[has]] = pos[has]
        tok[live * n + gone] = -1
        put(live, gone, np.full(len(live), INF))
        put(live, pos, key(live, pos))
        back = prv[here]
        has = back >= 0
        put(live[has], back[has], key(live[has], back[has]))
        live = live[flat[live * (2 * n) + 1] < INF]
    out = token >= 0
    return token[out], out.sum(1)


def merge_long(vocabulary: Vocabulary, piece: bytes) -> np.ndarray:
    """The same for one piece of any length."""
    size = len(piece)
    n = 1 << max(1, (size - 1).bit_length())
    token = vocabulary.byte_ids[np.frombuffer(piece, np.uint8)]
    none = int(INF)
    leaves = np.full(n, INF, np.int64)
    rank = vocabulary.rank(token[:-1], token[1:])
    leaves[: size - 1] = np.where(rank >= 0, rank * n + np.arange(size - 1), INF)
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    tree = np.concatenate([np.array([INF]), *levels[::-1]]).tolist()
    tok, nxt, prv = token.tolist(), [*range(1, size), -1], [-1, *range(size - 1)]

    def put(pos: int, value: int) -> None:
        node = pos + n
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            best = a if a < b else b
            if tree[node] == best:
                break
            tree[node] = best
            node >>= 1

    def key(pos: int) -> int:
        b = nxt[pos]
        r = vocabulary.rank_one(tok[pos], tok[b]) if b >= 0 else -1
        return r * n + pos if r >= 0 else none

    while tree[1] < none:
        r, pos = divmod(tree[1], n)
        gone = nxt[pos]
        tok[pos], tok[gone], nxt[pos] = r, -1, nxt[gone]
        if nxt[pos] >= 0:
            prv[nxt[pos]] = pos
        put(gone, none)
        put(pos, key(pos))
        if prv[pos] >= 0:
            put(prv[pos], key(prv[pos]))
    return np.array([t for t in tok if t >= 0], np.int64)


def encode_pieces(vocabulary: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, where those of each piece begin, how many there are), by length classes of powers of two."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begin, number = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
    parts, at = [], 0
    kinds = np.where(lengths > LONG, 0, 1 << np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64))
    for kind in np.unique(kinds):
        own = np.flatnonzero(kinds == kind)
        if kind == 0:
            for i in own:
                got = merge_long(vocabulary, pieces[i])
                begin[i], number[i] = at, len(got)
                parts.append(got)
                at += len(got)
            continue
        for some in np.array_split(own, -(-len(own) * int(kind) // BATCH)):
            got, n = merge_batch(vocabulary, [pieces[i] for i in some], int(kind))
            begin[some], number[some] = at + np.cumsum(n) - n, n
            parts.append(got)
            at += len(got)
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)).astype(np.int32), begin, number


def gather(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the ranges [begin, begin + size), on end."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)


class Encoder:
    """Encodes texts; pieces seen before aren't merged again, until the memory for them is full."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.find = vocabulary, regex.compile(vocabulary.pattern).findall
        self.forget()

    def forget(self) -> None:
        self.seen: defaultdict[str, int] = defaultdict(count().__next__)
        self.tokens, self.begin, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts on end, and where each text's begin (one more entry than texts)."""
        if len(self.seen) > REMEMBERED or len(self.tokens) > 8 * REMEMBERED:
            self.forget()
        number = self.seen.__getitem__
        which = [np.array([*map(number, self.find(t))], np.int32) if t else np.zeros(0, np.int32) for t in texts]
        every = np.concatenate(which) if which else np.zeros(0, np.int32)
        new = [p.encode() for p in islice(self.seen, len(self.begin), None)]
        if new:
            tokens, begin, n = encode_pieces(self.vocabulary, new)
            self.begin = np.concatenate([self.begin, begin + len(self.tokens)])
            self.tokens, self.count = np.concatenate([self.tokens, tokens]), np.concatenate([self.count, n])
        sizes = self.count[every]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.tokens[gather(self.begin[every], sizes)], ends[np.concatenate([[0], np.cumsum([*map(len, which)])]).astype(np.int64)]


def encode_texts(vocabulary: Vocabulary, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return Encoder(vocabulary)(texts)


def decode_tokens(vocabulary: Vocabulary, tokens: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts on end, and where each begins."""
    sizes = vocabulary.lengths[tokens]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return vocabulary.data[gather(vocabulary.starts[tokens], sizes)], ends[off]


def _shared(docs: DataFrame, vocabulary: Vocabulary) -> Broadcast:
    """The vocabulary on every worker; its size doesn't depend on the data."""
    return docs.sparkSession.sparkContext.broadcast(vocabulary)


def encode(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """The columns `keep` of docs (all of them by default), with tokens array<int>, n_tokens and round_trip.

    round_trip says whether the tokens decode to the very bytes of the text. Whole texts are encoded. A null text has
    null tokens, count and round_trip; an empty text an empty array, 0 and true. Rows aren't touched otherwise: repeated
    rows and null ids are encoded like any other. Columns of docs by these three names are replaced. An empty table
    gives an empty result.

    Equal pieces of a batch are merged once. Nothing is shuffled.
    """
    new = ["tokens", "n_tokens", "round_trip"]
    kept = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in new]
    (source,) = private(docs, "source")
    shared = _shared(docs, Vocabulary(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        encoder = Encoder(vocabulary)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for lo, hi in slices(texts, 4 << 20):
                some = texts.slice(lo, hi - lo)
                tokens, off = encoder(some.to_pylist())
                null = np.asarray(some.is_null())
                data, ends = text_buffer(some)
                back, back_ends = decode_tokens(vocabulary, tokens, off)
                same = np.diff(ends) == np.diff(back_ends)
                if len(data) == len(back) and same.all():
                    wrong = np.flatnonzero(data != back)
                    same[np.searchsorted(ends, wrong, side="right") - 1] = False
                else:
                    same &= np.array([np.array_equal(data[a:b], back[c:d]) for a, b, c, d in zip(ends, ends[1:], back_ends, back_ends[1:])], bool)
                mask = pa.array(null) if null.any() else None
                offsets = pa.array(off.astype(np.int32), mask=np.append(null, False) if null.any() else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)],
                        pa.ListArray.from_arrays(offsets, pa.array(tokens)),
                        pa.array(np.diff(off).astype(np.int32), mask=mask and null),
                        pa.array(same, mask=mask and null),
                    ],
                    names=[*kept, *new],
                )

    chosen = docs.select(*[column(c) for c in kept], column(text_col).alias(source))
    schema = docs.select(*[column(c) for c in kept], F.lit(None).cast("array<int>").alias("tokens"), F.lit(None).cast("int").alias("n_tokens"), F.lit(None).cast("boolean").alias("round_trip")).schema
    return mapped(chosen, run, schema)


def decode(rows: DataFrame, tokens_col: str = "tokens", path: str = VOCABULARY) -> DataFrame:
    """rows with the column decoded: the text of the tokens, with U+FFFD for bytes that aren't UTF-8.

    Null tokens give null, an empty array an empty text. A null token or one out of the vocabulary adds nothing.
    A column `decoded` of rows is replaced.
    """
    kept = [c for c in rows.columns if c.lower() != "decoded"]
    (source,) = private(rows, "source")
    shared = _shared(rows, Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            out = []
            for ids in batch.column(batch.num_columns - 1).to_pylist():
                if ids is None:
                    out.append(None)
                    continue
                known = np.array([t for t in ids if t is not None and 0 <= t < vocabulary.size], np.int64)
                out.append(decode_tokens(vocabulary, known, np.array([0, len(known)]))[0].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], names=[*kept, "decoded"])

    chosen = rows.select(*[column(c) for c in kept], column(tokens_col).alias(source))
    return mapped(chosen, run, rows.select(*[column(c) for c in kept], F.lit(None).cast("string").alias("decoded")).schema)
