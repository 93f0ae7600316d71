"""Operator 7: token counts by rank-synchronous array merging.

Pre-tokens of a batch of texts are held as one ragged integer array (all
symbols in a row, each with the number of its sequence). In every round each
sequence finds the lowest rank among its adjacent pairs and merges all its
pairs of that rank at once; sequences without a mergeable pair leave with their
count of surviving symbols. A merged pair's rank is always below that of any
pair made from its result, so merging all occurrences at once gives the same
symbols as merging them one at a time.

The vocabulary is a byte-level BPE file in the JSON form of the ``tokenizers``
library. Special strings inside a text count as one token each, as that
library does by default; no begin or end tokens, truncation or padding.

Defined cases: a null or empty text has 0 tokens.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from covenant.llm.common import text_chunks
from covenant.llm.pretokens import Splitter

CACHE_ENTRIES, GROUP_TEXT = 300_000, 1 << 20
NO_RANK = np.int32(2**31 - 1)
#: Fixed value: the split pattern of byte-level vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is
    printable Latin-1, else the next free code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Merges:
    """Pair ranks of a vocabulary file, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pre = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        vocab = model["vocab"]
        self.byte_ids = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.base = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)     # by rank
        added = [t for t in spec.get("added_tokens") or []]
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added):
            raise ValueError(f"{path} has special tokens with word or strip rules")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NO_RANK)


def count_symbols(pieces: list[bytes], merges: Merges) -> np.ndarray:
    """Symbols left of each piece after all merges."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    out = sizes.copy()
    seq = np.repeat(np.arange(len(pieces)), sizes)
    sym = merges.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    if len(sym) < 2 or not len(merges.key):
        return out
    rank = np.full(len(sym), NO_RANK)                    # of the pair that begins here
    rank[:-1] = np.where(seq[1:] == seq[:-1], merges.ranks(sym[:-1], sym[1:]), NO_RANK)
    while len(sym):
        starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
        lengths = np.diff(np.append(starts, len(seq)))
        lowest = np.minimum.reduceat(rank, starts)
        live = lowest < NO_RANK
        out[seq[starts]] = lengths
        if not live.all():                               # finished sequences leave
            stay = np.repeat(live, lengths)
            sym, seq, rank = sym[stay], seq[stay], rank[stay]
            lengths, lowest = lengths[live], lowest[live]
            if not len(sym):
                break
        hit = rank == np.repeat(lowest, lengths)
        at = np.arange(len(hit))
        run = at - np.maximum.accumulate(np.where(hit, -1, at)) - 1    # place within a run of overlapping pairs
        hit &= run % 2 == 0
        sym[hit] = merges.merged[rank[hit]]
        keep = np.ones(len(sym), bool)
        keep[1:] = ~hit[:-1]
        hit, sym, seq, rank = hit[keep], sym[keep], seq[keep], rank[keep]
        changed = np.flatnonzero(hit)
        changed = np.union1d(changed, changed[changed > 0] - 1)
        rank[changed] = NO_RANK
        changed = changed[changed + 1 < len(seq)]
        changed = changed[seq[changed] == seq[changed + 1]]
        rank[changed] = merges.ranks(sym[changed], sym[changed + 1])
    return out


class Counter:
    """Token counts of texts, with a bounded table of pre-token counts."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        self.merges = Merges(path)
        self.split = Splitter(PATTERN)
        self.cache: dict[str, int] = {}
        self.cache_entries = cache_entries

    def counts(self, texts: list[str | None]) -> list[int]:
        special, out, words = self.merges.special, [], []
        for t in texts:
            parts = special.split(t) if t and special else [t or ""]
            out.append(len(parts) - 1)
            words.append([w for p in parts for w in self.split(p)] if len(parts) > 1 else self.split(parts[0]))
        cache = self.cache
        if len(cache) > self.cache_entries:
            cache.clear()
        new = list(set().union(*words).difference(cache))
        if new:
            cache.update(zip(new, count_symbols([w.encode() for w in new], self.merges).tolist()))
        return [n + sum(map(cache.__getitem__, w)) for n, w in zip(out, words)]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, vocabulary: str, text: str = "text", name: str = "n_tokens",
                 keep_text: bool = True) -> DataFrame:
    """The columns of ``df`` and the number of tokens of each whole text. ``vocabulary`` is a
    path that every executor can open."""
    if name in df.columns:
        raise ValueError(f"column {name} is already there")
    fields = [f for f in df.schema.fields if keep_text or f.name != text]

    def run(batches):
        c = counter(vocabulary)
        try:
            for b in text_chunks(batches, text, GROUP_TEXT):
                n = pa.array(c.counts(b.column(text).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), n],
                                                 names=[*(f.name for f in fields), name])
        finally:
            c.cache.clear()             # a worker process outlives its tasks

    return df.mapInArrow(run, StructType([*fields, StructField(name, LongType())]))
