"""Operator 6: document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (the parts between line breaks). Each
paragraph is hashed to a wide vector, and the fingerprint is the sum of these
vectors: 32 lanes modulo 2**32 hashed from the whole paragraph decide equality,
and 512 lanes modulo 2**32, sums of +1/-1 vectors hashed from the paragraph's
windows of two words, give a likeness (the cosine of the two multisets of
windows, estimated with a standard error of about 0.04). Sums do not depend on
order, and a paragraph is inserted or deleted by adding or subtracting its vector.

A word is a run of characters between spaces, or one character of a script that
writes none. A window is a word and the one before it in the paragraph (none
for the first), and counts once in a paragraph, so that repeated phrases don't
outweigh the rest; in a paragraph of more than 65,536 words it counts once in
each run of that length. In a paragraph of fewer than four words the characters
stand for words.

Defined cases: a null text is the empty text, whose fingerprint is that of one
empty paragraph; equal texts have equal fingerprints; two texts without any
word are alike (1.0), one without and one with are not (0.0). A very long text
is worked on in runs of paragraphs of bounded length. A table without rows gives
none, repeated rows each give theirs; ``fingerprints`` replaces a column of the
name it writes and keeps all others, ``edit_fingerprints`` returns its own only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from xxhash import xxh3_64_intdigest

from covenant.llm.common import batch_of, text_chunks

EQUAL_LANES, SIGN_LANES = 32, 512
RUN_WORDS = 1 << 16
# scripts that write no spaces: Thai, Lao, Myanmar, Khmer, kana, Han
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_alone = re.compile(f"[{_ALONE}]").search
_cut = re.compile(f"[{_ALONE}]|[^{_ALONE}]+").findall
_WIDTH = EQUAL_LANES * 4 + SIGN_LANES * 4
_STEP = 0x9E3779B97F4A7C15
_LANES = np.arange(1, SIGN_LANES // 64 + 1, dtype=np.uint64) * np.uint64(_STEP)


class _Hashes(dict):
    """Hashes of words; a bounded table of those met last."""

    def __missing__(self, word: str) -> int:
        found = xxh3_64_intdigest(word.encode())
        if len(word) <= 32:
            if len(self) >= 200_000:
                self.clear()
            self[word] = found
        return found


_hash_of = _Hashes().__getitem__


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(paragraph: str) -> list[str]:
    words = paragraph.split()
    if not paragraph.isascii() and _alone(paragraph):
        words = [part for w in words for part in _cut(w)]
    return words


def _runs(paragraphs: Iterable[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Words and where the paragraphs start among them, in runs of about ``RUN_WORDS`` words."""
    words: list[str] = []
    starts: list[int] = []
    for p in paragraphs:
        found = _words(p)
        if 0 < len(found) < 4:
            found = [c for c in p if not c.isspace()]
        for at in range(0, len(found), RUN_WORDS):
            starts.append(len(words))
            words += found[at:at + RUN_WORDS]
            if len(words) >= RUN_WORDS:
                yield words, starts
                words, starts = [], []
    if words:
        yield words, starts


def _windows(paragraphs: Iterable[str]) -> np.ndarray:
    """Hashes of the windows of each paragraph, once each."""
    found = [np.zeros(0, np.uint64)]
    for words, starts in _runs(paragraphs):
        own = np.fromiter(map(_hash_of, words), np.uint64, len(words))
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[starts] = 0
        window = _mixed(_mixed(own + np.uint64(_STEP)) + before)
        number = np.zeros(len(own), np.int32)
        number[starts] = 1
        number = np.cumsum(number)
        order = np.lexsort((window, number))
        window, number = window[order], number[order]
        again = (window[1:] == window[:-1]) & (number[1:] == number[:-1])
        found.append(window[np.concatenate(([True], ~again))])
    return np.concatenate(found)


def _signs(windows: np.ndarray) -> np.ndarray:
    """The sum of the +1/-1 vectors of the windows."""
    total = np.zeros(SIGN_LANES, np.int64)
    for at in range(0, len(windows), 4096):
        some = windows[at:at + 4096]
        bits = np.empty((-(-len(some) // 128) * 128, SIGN_LANES // 64), np.uint64)
        bits[len(some):] = 0
        bits[:len(some)] = _mixed(some[:, None] + _LANES)
        ones = np.unpackbits(bits.view(np.uint8), axis=1).reshape(-1, 128, SIGN_LANES).sum(axis=1, dtype=np.uint8)    # at most 128 in each
        total += 2 * ones.sum(axis=0, dtype=np.int64) - len(some)
    return total


def _wide(paragraphs: list[str]) -> np.ndarray:
    """The sum of the vectors that decide equality."""
    if not paragraphs:
        return np.zeros(EQUAL_LANES, np.uint32)
    raw = [p.encode() for p in paragraphs]
    wide = b"".join(hashlib.blake2b(p, digest_size=64, salt=s).digest() for p in raw for s in (b"0", b"1"))
    return np.frombuffer(wide, "<u4").reshape(-1, EQUAL_LANES).sum(axis=0, dtype=np.uint32)


class Fingerprint:
    """A mutable multiset hash."""

    __slots__ = ("equal", "sign")

    def __init__(self, equal: np.ndarray | None = None, sign: np.ndarray | None = None):
        self.equal = np.zeros(EQUAL_LANES, np.uint32) if equal is None else equal
        self.sign = np.zeros(SIGN_LANES, np.uint32) if sign is None else sign

    @classmethod
    def of(cls, text: str | None) -> Fingerprint:
        return cls().add((text or "").split("\n"))

    def copy(self) -> Fingerprint:
        return Fingerprint(self.equal.copy(), self.sign.copy())

    def add(self, paragraphs: Iterable[str]) -> Fingerprint:
        return self.change([], paragraphs)

    def remove(self, paragraphs: Iterable[str]) -> Fingerprint:
        return self.change(paragraphs, [])

    def change(self, gone: Iterable[str], new: Iterable[str]) -> Fingerprint:
        """Delete paragraphs and insert others. A window of both cancels out before its vector is made."""
        gone, new = list(gone), list(new)
        self.equal = self.equal + _wide(new) - _wide(gone)
        less, more = _windows(gone), _windows(new)
        if len(less) and len(more):
            each, at = np.unique(np.concatenate((less, more)), return_inverse=True)
            counts = np.bincount(at[len(less):], minlength=len(each)) - np.bincount(at[:len(less)], minlength=len(each))
            more, less = (np.repeat(each, np.maximum(by * counts, 0)) for by in (1, -1))
        self.sign = self.sign + (_signs(more) - _signs(less)).astype(np.uint32)
        return self

    def edited(self, old: str, new: str) -> Fingerprint:
        """The fingerprint of ``new`` from that of ``old``: only paragraphs in which they differ are hashed."""
        a, b = old.split("\n"), new.split("\n")
        head, most = 0, min(len(a), len(b))
        while head < most and a[head] == b[head]:
            head += 1
        tail = 0
        while tail < most - head and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        return self.copy().change(a[head:len(a) - tail], b[head:len(b) - tail])

    def __str__(self) -> str:
        return (self.equal.astype("<u4").tobytes() + self.sign.astype("<u4").tobytes()).hex()

    @classmethod
    def parse(cls, value: str) -> Fingerprint:
        raw = bytes.fromhex(value)
        if len(raw) != _WIDTH:
            raise ValueError("not a fingerprint")
        return cls(np.frombuffer(raw[:EQUAL_LANES * 4], "<u4").astype(np.uint32),
                   np.frombuffer(raw[EQUAL_LANES * 4:], "<u4").astype(np.uint32))

    def likeness(self, other: Fingerprint) -> float:
        if (self.equal == other.equal).all() and (self.sign == other.sign).all():
            return 1.0
        a, b = (x.sign.astype(np.int32).astype(np.float64) for x in (self, other))
        norm = float(np.sqrt((a @ a) * (b @ b)))
        if norm == 0.0:
            return float(not (a.any() or b.any()))
        return min(1.0, max(0.0, float(a @ b) / norm))


def fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """All columns of ``df`` and the fingerprint of each text, as hex; it replaces a column of that name."""
    if name == text:
        raise ValueError("the fingerprint would replace the text it is made from")
    df = df.drop(name)

    def run(batches):
        for b in text_chunks(batches, text):
            found = pa.array([str(Fingerprint.of(t)) for t in b.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, StringType())]))


def _edit(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, text, following text) of rows sorted by slice and doc_id; a row that
    only looks ahead is followed up by nothing itself."""
    last = None
    for b in text_chunks(batches):
        for row in zip(*(b.column(c).to_pylist() for c in ("slice", "doc_id", "text", "ahead"))):
            if last is not None:
                if last[0] == row[0]:
                    yield last[1], last[2], row[2]
                elif not last[3]:
                    yield last[1], last[2], None
            last = None if row[3] else row
    if last is not None:
        yield last[1], last[2], None


def _edit_rows(batches):
    rows: list[tuple] = []
    known: tuple[str, Fingerprint] | None = None

    def flush():
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        out = batch_of({n: pa.array(c, k) for n, c, k in zip(names, zip(*rows), kinds)})
        rows.clear()
        return out

    for doc_id, text, following in _neighbours(batches):
        if following is None:
            raise ValueError("a slice ends without the row that follows it")
        own = known[1] if known and known[0] is text else Fingerprint.of(text)
        then = Fingerprint.of(following)
        new = _edit(text, following)
        changed = own.edited(text, new)
        rows.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), str(own), str(changed),
                     own.likeness(changed), own.likeness(then)))
        known = (following, then)
        if len(rows) >= 256:
            yield flush()
    if rows:
        yield flush()


def edit_fingerprints(docs: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """For every row (doc_id, text): the fingerprints of the text and of the text whose
    last half is replaced by the start of the next one in order of doc_id (after the last,
    the first), and their likeness.

    Rows are dealt into slices of neighbouring ids by cut points, then sorted within slices,
    so each text is shuffled once. The first row of a slice is also dealt to the slice
    before it, so only one row per slice is sent twice. Cut points and first rows
    number as many as slices; the texts are never collected. Rows with equal ids are
    ordered by text; null ids come first.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = keyed.count()
    if total == 0:
        return spark.createDataFrame([], "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
                                         "edited_fingerprint string, near_edited double, near_next double")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = -(-total // slice_rows) if slice_rows else 4 * parts
    at = [(i + 1) / slices for i in range(slices - 1)]
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", at, 100 * slices).alias("c")).first().c or [])) if at else []
    keyed = keyed.withColumn("slice", _slice_of("doc_id", cuts))
    firsts = (keyed.groupBy("slice").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("f"))
              .select("slice", "f.doc_id").orderBy("slice").collect())
    # the slice before each (the last, for the first slice): its rows with the first id look ahead
    before = [(firsts[i - 1].slice, f.slice, f.doc_id) for i, f in enumerate(firsts)]
    ahead = spark.createDataFrame(before, "to int, slice int, doc_id bigint")
    first_rows = (keyed.join(F.broadcast(ahead.withColumnRenamed("doc_id", "first_id")), "slice")
                  .where(F.col("doc_id").eqNullSafe(F.col("first_id")))
                  .groupBy("slice", "to", "doc_id").agg(F.min("text").alias("text"))
                  .select(F.col("to").alias("slice"), "doc_id", "text", F.lit(True).alias("ahead")))
    own = keyed.select("slice", "doc_id", "text", F.lit(False).alias("ahead"))
    dealt = own.unionByName(first_rows).repartition("slice")
    # a row that looks ahead comes last in its slice, also where the ring closes
    return (dealt.sortWithinPartitions("slice", "ahead", F.col("doc_id").asc_nulls_first(), "text")
            .mapInArrow(_edit_rows, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
                                    "edited_fingerprint string, near_edited double, near_next double"))


def _slice_of(column: str, cuts: list[int]):
    """Number of cut points not above the value (0 for null), as a balanced tree of comparisons."""
    def tree(lo: int, hi: int):
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"if({column} < {cuts[mid]}L, {tree(lo, mid)}, {tree(mid + 1, hi)})"
    return F.expr(f"if({column} is null, 0, {tree(0, len(cuts))})").cast("int")
