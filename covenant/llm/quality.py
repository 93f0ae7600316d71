"""Operator 9: document quality by a linear-chain conditional random field over lines.

Every line gets binned surface features (length, letter, capital, digit,
punctuation and symbol shares, word lengths, repeated words, repeated lines)
of its own and of the lines before and after it. A two-label linear-chain CRF
scores the sequence of lines; the forward-backward marginals of "good",
weighted by line length, average to the score of the document.

Labels exist for documents only, so each line of a labelled document is
trained with the document's label. Training uses a bounded sample:
at most ``per_class`` documents of each label, and of each at most
``PIECES`` pieces of ``PIECE`` lines, spread evenly. Scoring reads every line
of every text.

Defined cases: a null or empty text is one empty line; without any label every
document scores 0.5, with labels of one class only it scores that class; a
very long text is scored whole, in one step of its own; rows that repeat an id
are scored each; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covenant.llm.common import batch_of, text_chunks, utf8
from covenant.llm.minhash import mix, shingle_sets

PER_CLASS, PIECE, PIECES = 1500, 64, 8
CUTS = (0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98, 0.995)     # quantiles that part the bins of a feature
BINS = len(CUTS) + 1


def _class_table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


_UPPER = _class_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER + _class_table("abcdefghijklmnopqrstuvwxyz")
_LETTER[128:] = 1
_DIGIT, _SPACE, _STOP = _class_table("0123456789"), _class_table(" \t\r"), _class_table(".,;:!?'\"()-")
_HARD = _class_table("!?")
_SYMBOL = 1 - np.minimum(1, _LETTER + _DIGIT + _SPACE + _STOP + _class_table("\n"))
_END = _class_table(".!?:\"'")
FEATURES = 12


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line, bytes of each line, number of lines of each text)."""
    breaks = np.flatnonzero(data == 10)
    # a line begins where a text begins and after every line break
    starts = np.concatenate((offsets[:-1], breaks + 1))
    doc = np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1))
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    last = np.append(doc[1:] != doc[:-1], True)
    ends = np.where(last, offsets[1:][doc], np.append(starts[1:], 0) - 1)
    size = ends - starts

    def total(table):
        sums = np.concatenate(([0], np.cumsum(table[data])))
        return (sums[ends] - sums[starts]).astype(np.float64)

    letters, upper, digits = total(_LETTER), total(_UPPER), total(_DIGIT)
    stops, hard, symbols = total(_STOP), total(_HARD), total(_SYMBOL)
    n = np.maximum(size, 1)
    # words of each line; a text that holds only this line's bytes
    cuts = np.concatenate((starts, offsets[-1:]))
    h, distinct = shingle_sets(data, cuts, 1)
    spaces = total(_SPACE)
    words = np.maximum(spaces + 1, distinct)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h))))
    at = np.concatenate(([0], np.cumsum(distinct)))
    key = mix((sums[at[1:]] - sums[at[:-1]]) ^ doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + size.astype(np.uint64)
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    ended = np.zeros(len(size))
    began = np.zeros(len(size))
    some = size > 0
    ended[some] = _END[data[ends[some] - 1]]
    began[some] = _UPPER[data[starts[some]]]
    x = np.stack([
        np.log1p(size), letters / n, upper / np.maximum(letters, 1), digits / n, stops / n, hard / n, symbols / n,
        letters / words, 1 - distinct / words, np.where(size > 0, np.minimum(times[back] - 1, 4), 0), ended, began], axis=1)
    return x, size, np.bincount(doc, minlength=len(offsets) - 1)


@dataclass
class Crf:
    edges: list[np.ndarray]             # bin edges by feature
    w: np.ndarray                       # (3, FEATURES, BINS): weight for "good" of a bin of the line before, own, after
    bias: float
    stay: np.ndarray                    # (2, 2) transition scores
    constant: float | None = None       # the score when there was nothing to learn from

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def emissions(self, bins: np.ndarray, counts: np.ndarray) -> np.ndarray:
        own = self.w[:, np.arange(FEATURES), bins].sum(axis=2)          # (3, lines)
        first = np.zeros(len(bins), bool)
        first[(np.cumsum(counts) - counts)[counts > 0]] = True
        out = own[1] + self.bias
        out[1:] += np.where(first[1:], 0, own[0][:-1])                  # of the line before
        out[:-1] += np.where(first[1:], 0, own[2][1:])                  # of the line after
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        x, size, counts = line_features(data, offsets)
        p, _, _ = marginals(self.emissions(self.binned(x), counts), counts, self.stay)
        doc = np.repeat(np.arange(n), counts)
        weight = size + 1.0
        return np.bincount(doc, weight * p, n) / np.bincount(doc, weight, n)


def marginals(score: np.ndarray, counts: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(good) by line, expected transitions (2, 2), log partition by sequence); forward-backward
    over all sequences side by side, longest first, one step per line number."""
    order = np.argsort(-counts, kind="stable")
    at = (np.cumsum(counts) - counts)[order]
    longest = int(counts.max(initial=0))
    live = [int(np.searchsorted(-counts[order], -t, side="left")) for t in range(longest)]     # sequences longer than t
    e = np.zeros((len(score), 2))
    e[:, 1] = score
    fwd, bwd = np.zeros_like(e), np.zeros_like(e)
    norm = np.zeros(len(score))
    step = np.exp(stay)
    for t in range(longest):
        rows = at[:live[t]] + t
        a = np.exp(e[rows] - e[rows].max(axis=1, keepdims=True))
        if t:
            a = a * (fwd[rows - 1] @ step)
        norm[rows] = a.sum(axis=1)
        fwd[rows] = a / norm[rows][:, None]
    pairs = np.zeros((2, 2))
    for t in range(longest - 1, -1, -1):
        rows = at[:live[t]] + t
        bwd[rows] = 1.0
        if t + 1 < longest and live[t + 1]:
            r = at[:live[t + 1]] + t
            a = np.exp(e[r + 1] - e[r + 1].max(axis=1, keepdims=True)) * bwd[r + 1] / norm[r + 1][:, None]
            bwd[r] = a @ step.T
            pairs += np.einsum("ni,ij,nj->ij", fwd[r], step, a)
    post = fwd * bwd
    p = post[:, 1] / post.sum(axis=1)
    log_z = np.bincount(np.repeat(np.arange(len(counts)), counts), np.log(norm) + e.max(axis=1), len(counts))
    return p, pairs, log_z


def fit_crf(x: np.ndarray, counts: np.ndarray, label: np.ndarray, steps: int = 150, rate: float = 0.1,
            penalty: float = 1e-3) -> Crf:
    """A CRF for sequences of lines that all carry the label (0/1) of their sequence; both labels weigh the same."""
    if not len(counts) or len(set(label.tolist())) < 2:
        return Crf([], np.zeros((3, FEATURES, BINS)), 0.0, np.zeros((2, 2)), float(label[0]) if len(label) else 0.5)
    edges = [np.unique(np.quantile(x[:, f], CUTS)) for f in range(FEATURES)]
    model = Crf(edges, np.zeros((3, FEATURES, BINS)), 0.0, np.zeros((2, 2)))
    bins = model.binned(x)
    seq = np.repeat(np.arange(len(counts)), counts)
    y = label[seq].astype(np.float64)
    weight = np.where(label == 1, 0.5 / (label == 1).sum(), 0.5 / (label == 0).sum())
    # sequences of one label are run together, so that their weight scales both gradients
    sides = [(np.flatnonzero(label == v), v) for v in (0, 1)]
    first = np.zeros(len(seq), bool)
    first[np.cumsum(counts) - counts] = True
    cell = np.arange(FEATURES) * BINS + bins
    moment = [np.zeros(3 * FEATURES * BINS + 1 + 4) for _ in range(2)]
    flat = np.zeros_like(moment[0])
    for t in range(1, steps + 1):
        model.w, model.bias = flat[:-5].reshape(3, FEATURES, BINS), float(flat[-5])
        model.stay = flat[-4:].reshape(2, 2)
        emission = model.emissions(bins, counts)
        diff, trans = np.zeros(len(seq)), np.zeros((2, 2))
        for ids, v in sides:
            mine = np.flatnonzero(label[seq] == v)
            p, pairs, _ = marginals(emission[mine], counts[ids], model.stay)
            diff[mine] = (y[mine] - p) * weight[ids[0]]
            seen = np.zeros((2, 2))
            seen[v, v] = (counts[ids] - 1).sum()
            trans += (seen - pairs) * weight[ids[0]]
        size = FEATURES * BINS
        before = np.where(first[1:], 0, diff[1:])           # line i + 1 reads the bins of line i
        after = np.where(first[1:], 0, diff[:-1])
        grads = [np.bincount(cell[:-1].ravel(), np.repeat(before, FEATURES), size),
                 np.bincount(cell.ravel(), np.repeat(diff, FEATURES), size),
                 np.bincount(cell[1:].ravel(), np.repeat(after, FEATURES), size)]
        g = np.concatenate([*grads, [diff.sum()], trans.ravel()]) - penalty * flat
        moment[0] = 0.9 * moment[0] + 0.1 * g
        moment[1] = 0.99 * moment[1] + 0.01 * g * g
        flat = flat + rate * (moment[0] / (1 - 0.9 ** t)) / (np.sqrt(moment[1] / (1 - 0.99 ** t)) + 1e-8)
    model.w, model.bias = flat[:-5].reshape(3, FEATURES, BINS).copy(), float(flat[-5])
    model.stay = flat[-4:].reshape(2, 2).copy()
    return model


def _pieces(n: int) -> list[tuple[int, int]]:
    """Pieces of at most PIECE lines of n, at most PIECES of them, spread evenly."""
    every = -(-n // PIECE)
    picks = range(every) if every <= PIECES else [i * (every - 1) // (PIECES - 1) for i in range(PIECES)]
    return [(i * PIECE, min(n, (i + 1) * PIECE)) for i in picks]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Crf:
    """A CRF from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality 0/1; others ignored), of at most
    ``per_class`` documents of each label, chosen by a hash of the id. Of rows that repeat an id the
    smallest text counts, of labels that repeat one the lower."""
    marks = (labels.where("doc_id is not null and quality in (0, 1)")
             .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")))
    sizes = {r.quality: r["count"] for r in marks.groupBy("quality").count().collect()}
    if not sizes:
        return fit_crf(np.zeros((0, FEATURES)), np.zeros(0, int), np.zeros(0, int))
    spare = per_class + 6 * per_class ** 0.5
    share = F.coalesce(*(F.when(F.col("quality") == k, F.lit(min(1.0, spare / n))) for k, n in sizes.items()))
    at = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 30))
    drawn = (marks.where(at < share * (1 << 30))
             .withColumn("n", F.row_number().over(Window.partitionBy("quality").orderBy(at, "doc_id")))
             .where(F.col("n") <= per_class).drop("n"))

    def vectors(batches):
        for b in text_chunks(batches):
            x, _, counts = line_features(*utf8(b.column("text")))
            at, marks_, rows, sizes_ = np.cumsum(counts) - counts, b.column("quality").to_pylist(), [], []
            for s, n, mark in zip(at, counts, marks_):
                rows += [(mark, x[s + i:s + j].astype(np.float32).tobytes()) for i, j in _pieces(int(n))]
            yield batch_of({"quality": pa.array([r[0] for r in rows], pa.int32()), "x": pa.array([r[1] for r in rows], pa.binary())})

    # the drawn labels number at most 2 * per_class, whatever the input, and each has one text
    found = (docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
             .groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("quality", "text")
             .mapInArrow(vectors, "quality int, x binary").collect())
    found.sort(key=lambda r: (r.quality, bytes(r.x)))
    x = np.frombuffer(b"".join(r.x for r in found), np.float32).reshape(-1, FEATURES).astype(np.float64)
    counts = np.array([len(r.x) // (4 * FEATURES) for r in found], np.int64)
    return fit_crf(x, counts, np.array([r.quality for r in found]))


def score(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id and score (0 to 1, higher is better) for every row of (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)      # weights of fixed number

    def run(batches):
        for b in text_chunks(batches):
            yield batch_of({"doc_id": b.column("doc_id").cast(pa.int64()),
                            "score": pa.array(np.clip(held.value.score(*utf8(b.column("text"))), 0, 1))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def keep(docs: DataFrame, model: Crf, cut: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``cut`` or more. Only texts go
    to Python and only scores come back."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(text: pa.Array) -> pa.Array:
        parts = [held.value.score(*utf8(b.column("text"))) for b in text_chunks([batch_of({"text": text})])]
        return pa.array(np.clip(np.concatenate(parts or [np.zeros(0)]), 0, 1))

    return docs.where(scores("text") >= cut)
