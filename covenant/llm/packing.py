"""Operator 12: packing by balanced attention cost.

Every document becomes the ids of a ``tokenizers`` vocabulary and one end id.
It is cut at multiples of the sequence length; whole lengths are sequences of
their own, and what remains (at most one short piece of a document) is dealt
into blocks of about ``block_tokens`` ids. In a block the number of sequences is
the least that holds its ids. Pieces go, longest first, each to the sequence of
lowest cost that has room for it; the cost of a piece of n ids is linear plus
quadratic, 6 * hidden * n + n * n, the ratio of dense to attention work of a
layer of that width. Pieces that no sequence can take whole are cut and fill
what room there is, lowest cost first. So a block pads less than one sequence.

The short pieces are stored with a running number before they are dealt, so a
task that runs again deals them alike, and neither a common id nor copies make
a large block. Blocks are independent; no list of documents leaves them.

Ids come from the library. Its patterns never span a space, so texts are cut at
spaces and line ends and a bounded table keeps the ids of words seen before.

Defined cases: a null or empty text is its end id alone; repeated rows and rows
with a null id are documents of their own; a very long text is encoded in parts
of bounded size; an empty table gives no rows; columns other than doc_id and
text are ignored; equal lengths go by id, then by stored order.
"""

from __future__ import annotations

import heapq
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.llm.common import batch_of, stored, text_chunks
from covenant.llm.tokencount import byte_symbols

CAPACITY, HIDDEN = 4096, 4096
BLOCK_TOKENS, BLOCK_ROWS = 1 << 21, 1 << 17
TABLE_BYTES, ENTRY_BYTES, PART_CHARS = 64 << 20, 170, 1 << 20
OUT_BYTES = 8 << 20
_SPACE = re.compile(r"[ \t\n\r]+")
#: Characters that every Unicode normal form and both lower-casings agree on; their pre-tokens, and the space between words.
_PLAIN = re.compile(r"[ -~À-ÖØ-öø-ÿ]*")
_PRE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]| |'(?:s|t|re|ve|m|ll|d)|[^a-zß-öø-ÿ0-9 ]+")
_GAP = b"\xff" * 4                       # stands for a space among ids


class Table:
    """Ids of strings seen before, bounded in bytes: when half of the bound is full, the strings
    that have not been asked for since the last time are dropped."""

    def __init__(self, limit: int):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.limit, self.size = limit // 2, 0

    def look_up(self, keys: list[str], make: Callable[[list[str]], Iterable[bytes]]) -> bytes:
        """The ids of all keys, joined."""
        if self.size > self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        young = self.young
        missing = set(keys).difference(young)
        if missing:
            self.size += ENTRY_BYTES * len(missing) + 3 * sum(map(len, missing))
            if self.old:
                again = [k for k in missing if k in self.old]
                young.update(zip(again, map(self.old.__getitem__, again)))
                missing.difference_update(again)
            new = list(missing)
            young.update(zip(new, make(new)))
        return b"".join(map(young.__getitem__, keys))


class Encoder:
    """Texts to ids (little-endian unsigned 32-bit) by a ``tokenizers`` file that drops white space."""

    def __init__(self, path: str, table_bytes: int = TABLE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        if any(re.search(r"[ \t\n\r]", s) for s in special) or self._ids("a b") != self._ids("a") + self._ids("b"):
            raise ValueError(f"{path} does not drop white space; its texts cannot be cut there")
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        # words go to the model directly only if the file's steps before it are the ones that _PRE repeats
        probe = "It's \"A1b22\", ÀÉß-ÿ!? they'll_x' 'Re're"
        self.direct = False
        self.words, self.pre = Table(table_bytes), Table(table_bytes // 2)
        plain = probe.split()
        self.direct = self._direct(plain) == [self._ids(w) for w in plain]

    def _ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pre_tokens(self, new: list[str]) -> Iterator[bytes]:
        cut = self.model.tokenize
        for p in new:
            if p == " ":
                yield _GAP
            else:
                yield array("I", [t.id for t in cut(p if p.isascii() else "".join(map(_SYMBOLS.__getitem__, p.encode())))]).tobytes()

    def _direct(self, words: list[str]) -> list[bytes]:
        """Ids of plain words: they are cut into pre-tokens together, which the model then cuts into ids."""
        flat = _PRE.findall(" ".join(words).lower())
        return self.pre.look_up(flat, self._pre_tokens).split(_GAP)

    def _encoded(self, words: list[str]) -> Iterable[bytes]:
        joined = " ".join(words)
        if self.direct and _PLAIN.fullmatch(joined) and not self.special.search(joined):
            return self._direct(words)
        plain = [self.direct and bool(_PLAIN.fullmatch(w)) and not self.special.search(w) for w in words]
        known = iter(self._direct([w for w, p in zip(words, plain) if p]))
        return [next(known) if p else self._ids(w) for w, p in zip(words, plain)]

    def parts(self, text: str) -> Iterator[str]:
        """Parts of a text of about PART_CHARS, cut at spaces."""
        i = 0
        while i < len(text):
            j = i + PART_CHARS
            cut = _SPACE.search(text, j) if j < len(text) else None
            j = cut.end() if cut else len(text)
            yield text[i:j]
            i = j

    def encode(self, text: str | None) -> bytes:
        return b"".join([self.words.look_up(_words(part), self._encoded) for part in self.parts(text or "")])


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The encoder of a worker process, which runs one task after another; its tables are bounded."""
    return Encoder(path)


def _words(text: str) -> list[str]:
    """Cut at white space; the four controls that only Python counts as such stay inside words."""
    return [w for w in _SPACE.split(text) if w] if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()


_SYMBOLS = byte_symbols()


def cost(n, hidden: int = HIDDEN):
    """Cost of attending over one piece of n ids: linear plus quadratic."""
    return 6 * hidden * n + n * n


def assign(lengths: np.ndarray, capacity: int = CAPACITY, hidden: int = HIDDEN) -> list[tuple[int, int, int, int, int]]:
    """(row, start in the row, length, sequence, offset) of every piece, for rows in descending length,
    none longer than ``capacity``. Sequences are as few as hold all ids."""
    n = -(-int(lengths.sum()) // capacity)
    out, left = [], []
    room = [capacity] * n
    open_ = [(0, s) for s in range(n)]                   # a heap of (cost, sequence); a sorted list is one
    aside: dict[int, list[tuple[int, int]]] = {}         # sequences too full for the present length, by their room
    at = capacity
    for row, size in enumerate(lengths.tolist()):
        while at > size:                                 # lengths fall, so each is put back once per piece it takes
            at -= 1
            for item in aside.pop(at, ()):
                heapq.heappush(open_, item)
        while open_ and room[open_[0][1]] < size:
            item = heapq.heappop(open_)
            aside.setdefault(room[item[1]], []).append(item)
        if not open_:
            left.append((row, size))
            continue
        c, s = open_[0]
        out.append((row, 0, size, s, capacity - room[s]))
        room[s] -= size
        heapq.heapreplace(open_, (c + cost(size, hidden), s))
    open_ = [x for x in [*open_, *(x for xs in aside.values() for x in xs)] if room[x[1]]]
    heapq.heapify(open_)
    for row, size in left:                               # cut, lowest cost first
        start = 0
        while start < size:
            c, s = heapq.heappop(open_)
            take = min(size - start, room[s])
            out.append((row, start, take, s, capacity - room[s]))
            room[s] -= take
            start += take
            if room[s]:
                heapq.heappush(open_, (c + cost(take, hidden), s))
    return out


_PIECE = "doc_id bigint, start bigint, ids binary, doc_tokens bigint"


def _cutter(vocabulary: str, end_id: int, capacity: int):
    def run(batches):
        encoder, end, step = encoder_of(vocabulary), np.array([end_id], "<u4").tobytes(), 4 * capacity
        part, number = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []

        def flush():
            nonlocal number
            numbers = np.arange(number, number + len(rows))
            number += len(rows)
            doc, start, ids, total = zip(*rows)
            rows.clear()
            return batch_of({"doc_id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()),
                             "ids": pa.array(ids, pa.binary()), "doc_tokens": pa.array(total, pa.int64()),
                             "full": pa.array([len(x) == step for x in ids]),
                             "part": pa.array(np.full(len(numbers), part, np.int32)), "number": pa.array(numbers)})

        for b in text_chunks(batches):
            held = 0
            for doc, text in zip(b.column("doc_id").cast(pa.int64()).to_pylist(), b.column("text").to_pylist()):
                ids = encoder.encode(text) + end
                for i in range(0, len(ids), step):
                    rows.append((doc, i // 4, ids[i:i + step], len(ids) // 4))
                    held += len(rows[-1][2])
                    if held > OUT_BYTES:
                        yield flush()
                        held = 0
            if rows:
                yield flush()
    return run


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Documents as stored pieces of at most ``capacity`` ids; ``full`` ones fill a sequence."""
    cut = docs.select("doc_id", "text").mapInArrow(
        _cutter(vocabulary, end_id, capacity), _PIECE + ", full boolean, part int, number bigint")
    return stored(cut, "pieces")


def _packer(capacity: int, hidden: int):
    def run(key, table):
        block = key[0].as_py()
        table = table.combine_chunks()
        size = np.array([len(x) // 4 for x in table.column("ids").to_pylist()], np.int64)
        order = table.select(["doc_id", "start", "part", "number"]).append_column("size", pa.array(size))
        order = pc.sort_indices(order, [("size", "descending"), *((c, "ascending") for c in ("doc_id", "start", "part", "number"))])
        table = table.take(order)
        ids, first = table.column("ids").to_pylist(), table.column("start").to_pylist()
        rows = assign(size[order.to_numpy()], capacity, hidden)
        at = pa.array([r[0] for r in rows], pa.int64())
        return pa.table({
            "doc_id": table.column("doc_id").take(at),
            "start": pa.array([first[r] + s for r, s, *_ in rows], pa.int64()),
            "length": pa.array([n for _, _, n, _, _ in rows], pa.int64()),
            "ids": pa.array([ids[r][4 * s:4 * (s + n)] for r, s, n, _, _ in rows], pa.binary()),
            "doc_tokens": table.column("doc_tokens").take(at),
            "sequence_id": pa.array([(block << 32) + q for *_, q, _ in rows], pa.int64()),
            "offset": pa.array([o for *_, o in rows], pa.int64())})
    return run


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, hidden: int = HIDDEN,
         block_tokens: int = BLOCK_TOKENS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per piece of the documents (doc_id, text): doc_id, start (ids of the document before it),
    length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset in the sequence."""
    cut = pieces(docs, vocabulary, end_id, capacity)
    short = cut.where("not full")
    total = short.agg(F.count("*").alias("rows"), F.sum(F.octet_length("ids") / 4).alias("ids")).first()
    blocks = max(1, -(-int(total.ids or 0) // block_tokens), -(-total.rows // block_rows))
    dealt = short.withColumn("block", F.pmod(F.xxhash64("part", "number"), F.lit(blocks)))
    fields = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    packed = (dealt.select("block", "doc_id", "start", "ids", "doc_tokens", "part", "number")
              .groupBy("block").applyInArrow(_packer(capacity, hidden), fields))
    # sequences of one whole piece are numbered by their stored place, above all blocks
    whole = cut.where("full").select(
        "doc_id", "start", F.lit(capacity).cast("long").alias("length"), "ids", "doc_tokens",
        (F.lit(1 << 62) + F.col("part") * F.lit(1 << 38) + F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(packed)
