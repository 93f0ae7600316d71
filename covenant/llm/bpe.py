"""Operator 2: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Texts are cut by a pre-token pattern. Each pre-token starts as a linked list of
bytes. A bucket per merge rank holds the list positions whose pair has that
rank; a bitmap over the ranks, with a bitmap over its words above it, finds the
lowest non-empty rank by find-first-set. Positions whose pair has changed since
are stale and skipped. A merge costs a constant number of bucket and bitmap
steps, so a pre-token of n bytes takes time about linear in n. Short pre-tokens
share a queue, which spares them most of the bitmap steps.

Encoded pre-tokens are kept in a bounded table per task, as words repeat.

Defined cases: a null or empty text has no ids and decodes to no bytes; any
text round-trips; unknown ids on decoding raise an error.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import islice
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from covenant.llm.common import int_lists, text_chunks
from covenant.llm.pretokens import Splitter

CACHE_ENTRIES, GROUP_BYTES, GROUP_TEXT = 300_000, 1 << 17, 1 << 20


class Codec:
    """Encoder and decoder for one rank file.

    The bitmap has two levels of about sqrt(ranks) bits a word, so a step on
    either level is one operation on a short integer.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_entries: int = CACHE_ENTRIES):
        self.ranks = ranks
        self.pieces = {i: b for b, i in ranks.items()}
        self.split = Splitter(pattern)
        size = max(ranks.values(), default=0) + 1
        self.width = isqrt(size) + 1
        self.bit = [1 << i for i in range(self.width)]
        self.word_of = [r // self.width for r in range(size)]   # place of each rank in the bitmap
        self.bit_of = [self.bit[r % self.width] for r in range(size)]
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.pairs = [[ranks.get(bytes([a, b])) for b in range(256)] for a in range(256)]
        self.buckets: list[list[int] | None] = [None] * size    # all empty between calls
        self.words = [0] * self.width                           # all zero between pre-tokens
        self.cache: dict[str, bytes] = {}
        self.known: set[str] = set()                            # of the table, those that came up again
        self.cache_entries = cache_entries

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as in ``encode_raw``. All share one queue: their bytes stand side by side, parted by stops."""
        get, width, bit, word_of, bit_of = self.ranks.get, self.width, self.bit, self.word_of, self.bit_of
        words, buckets, pairs = self.words, self.buckets, self.pairs
        top = 0                                                 # the upper level: words that are not zero
        data = b"\0".join(pieces) + b"\0"
        n = len(data)
        stop = bytearray(n)                                     # stop[-1] also ends the first one on the left
        nxt, prv = list(range(1, n + 1)), list(range(-1, n))    # linked list of symbols
        ids = list(map(self.byte_ids.__getitem__, data))        # of the symbol that begins here
        rank_at: list[int | None] = [None] * n                  # of the pair that begins here
        i = 0
        for piece in pieces:
            for i, a, b in zip(range(i, n), piece, piece[1:]):
                r = pairs[a][b]
                if r is not None:
                    rank_at[i] = r
                    if buckets[r] is not None:
                        buckets[r].append(i)
                    else:
                        buckets[r] = [i]
                        h = word_of[r]
                        words[h] |= bit_of[r]
                        top |= bit[h]
            i += 2 if len(piece) > 1 else len(piece)            # the last byte, then the stop
            stop[i] = 1
            i += 1
        while top:
            h = (top & -top).bit_length() - 1                   # find first set, level by level
            word = words[h]
            rank = h * width + (word & -word).bit_length() - 1
            words[h] = word = word & (word - 1)
            if not word:
                top ^= bit[h]
            positions = buckets[rank]
            buckets[rank] = None
            if len(positions) > 1:
                positions.sort()                                # leftmost first
            for done, i in enumerate(positions):
                if rank_at[i] != rank:                          # stale
                    continue
                j = nxt[i]
                nxt[i] = k = nxt[j]
                prv[k] = i
                ids[i] = lowest = rank
                rank_at[j] = None
                if stop[k]:
                    rank_at[i] = None
                else:
                    rank_at[i] = r = get(data[i:nxt[k]])
                    if r is not None:
                        if buckets[r] is not None:
                            buckets[r].append(i)
                        else:
                            buckets[r] = [i]
                            h = word_of[r]
                            words[h] |= bit_of[r]
                            top |= bit[h]
                        if r < lowest:
                            lowest = r
                p = prv[i]
                if not stop[p]:
                    rank_at[p] = r = get(data[p:k])
                    if r is not None:
                        if buckets[r] is not None:
                            buckets[r].append(p)
                        else:
                            buckets[r] = [p]
                            h = word_of[r]
                            words[h] |= bit_of[r]
                            top |= bit[h]
                        if r < lowest:
                            lowest = r
                if lowest < rank and done + 1 < len(positions):  # a lower rank came up: it goes first
                    buckets[rank] = (buckets[rank] or []) + positions[done + 1:]
                    h = word_of[rank]
                    words[h] |= bit_of[rank]
                    top |= bit[h]
                    break
        found, cuts, i = [], [0], 0
        for _ in pieces:
            while not stop[i]:
                found.append(ids[i])
                i = nxt[i]
            cuts.append(4 * len(found))
            i += 1
        raw = np.array(found, "<i4").tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def learn(self, words: list[str]) -> None:
        """Put the ids of new pre-tokens into the table, in groups of bounded size."""
        group, size = [], 0
        for w in words:
            piece = w.encode()
            whole = self.ranks.get(piece)
            if whole is not None:
                self.cache[w] = whole.to_bytes(4, "little")
                continue
            group.append((w, piece))
            size += len(piece)
            if size > GROUP_BYTES:
                self.cache.update(zip((g[0] for g in group), self.merge([g[1] for g in group])))
                group, size = [], 0
        if group:
            self.cache.update(zip((g[0] for g in group), self.merge([g[1] for g in group])))

    def encode_raw(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        words = [self.split(t or "") for t in texts]
        if len(self.cache) > self.cache_entries:
            self.keep_known()
        every = set().union(*words)
        known = every.intersection(self.cache)
        self.known |= known
        self.learn(list(every - known))
        get = self.cache.__getitem__
        return [b"".join(map(get, w)) for w in words]

    def keep_known(self) -> None:
        """Forget pre-tokens that came up in one group of texts only; keep a bounded number of the others."""
        if len(self.known) > self.cache_entries // 3:
            self.known = set(islice(self.known, self.cache_entries // 3))
        self.cache = {w: self.cache[w] for w in self.known if w in self.cache}
        self.known = set()

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [np.frombuffer(x, "<i4").tolist() for x in self.encode_raw(texts)]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def _list_chunks(batches, column: str, limit: int = 1 << 20):
    """Slices of the batches with at most ``limit`` list entries (or one row)."""
    for b in batches:
        lists = b.column(column)
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends, i = np.cumsum(size, dtype=np.int64), 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, side="right")))
            yield b.slice(i, j - i)
            i = j


def _schema(df: DataFrame, name: str, kind, without: str | None) -> StructType:
    if name in df.columns:
        raise ValueError(f"column {name} is already there")
    return StructType([*(f for f in df.schema.fields if f.name != without), StructField(name, kind)])


def _replaced(b: pa.RecordBatch, name: str, values: pa.Array, without: str | None) -> pa.RecordBatch:
    names = [n for n in b.schema.names if n != without]
    return pa.RecordBatch.from_arrays([*(b.column(n) for n in names), values], names=[*names, name])


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids",
           keep_text: bool = True) -> DataFrame:
    """The columns of ``df`` and ``ids`` (array<int>). ``vocabulary`` is a path that every executor can open."""
    without = None if keep_text else text

    def run(batches):
        c = codec(vocabulary, pattern)
        try:
            for b in text_chunks(batches, text, GROUP_TEXT):      # longer runs of texts share a queue
                found = c.encode_raw(b.column(text).to_pylist())
                sizes = np.array([len(x) // 4 for x in found], np.int64)
                flat = np.frombuffer(b"".join(found), "<i4")
                yield _replaced(b, ids, int_lists(flat, sizes, pa.int32()), without)
        finally:
            c.keep_known()              # a worker process outlives its tasks

    return df.mapInArrow(run, _schema(df, ids, ArrayType(IntegerType()), without))


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", decoded: str = "decoded",
           keep_ids: bool = True) -> DataFrame:
    """The columns of ``df`` and ``decoded`` (binary: the bytes the ids stand for, none for null)."""
    without = None if keep_ids else ids

    def run(batches):
        c = codec(vocabulary, pattern)
        for b in _list_chunks(batches, ids):
            lists = b.column(ids)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes, dtype=np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)   # skips null lists
            out = [c.decode(flat[e - n:e].tolist()) for n, e in zip(sizes, ends)]
            yield _replaced(b, decoded, pa.array(out, pa.binary()), without)

    return df.mapInArrow(run, _schema(df, decoded, BinaryType(), without))
