"""Operator 8: language identification by hierarchical discrimination.

Features are hashed counts of byte 1-, 2- and 3-grams of the lower-cased text
with everything that is not a letter read as a space, damped by a square root
and scaled to length one. A linear support vector machine per language family
(one against the rest) picks the family; within it, one-versus-one machines
between its languages vote, ties going to the larger sum of margins.

Machines are fitted on a bounded sample of labelled rows (at most
``per_language`` different texts of each language and ``most`` in all, chosen by
a hash of the text), because some thousands of whole texts settle 2,049 weights. Prediction reads every
whole text; language labels, sources and ids are never features.

Defined cases: a null text or one without a letter is ``und`` with score 0; if
no labelled rows exist, every text is ``und``; with one learned language every
text with a letter gets it; a text that is repeated within a language is learned
once, and each of its rows gets the same prediction; a very long text is read
whole, in one step of its own; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covenant.llm.common import batch_of, text_chunks

BUCKETS = 2048
PER_LANGUAGE, MOST_TEXTS = 1500, 24_000
#: Families of some languages by ISO 639-1 code; any other code is its own family.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv", "celtic": "br cy ga gd", "uralic": "et fi hu",
    "indic": "bn gu hi mr ne pa si ur", "turkic": "az kk ky tr tt uz", "semitic": "am ar he mt",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_letter = regex.compile(r"\p{L}").search
_ASCII = np.arange(256, dtype=np.uint8)
_ASCII[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]


def _hash(code: np.ndarray) -> np.ndarray:
    return (code * np.uint32(2654435761) >> np.uint32(32 - 11)).astype(np.int64)


def features(texts: list[str | None]) -> np.ndarray:
    """One float32 row of BUCKETS + 1 values per text; the last one is the constant."""
    raw = [(t or "").lower().encode() for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = _ASCII[np.frombuffer(b"".join(raw), np.uint8)].astype(np.uint32)
    doc = np.repeat(np.arange(len(raw)), sizes)
    out = np.zeros(len(raw) * BUCKETS, np.float32)
    code = np.zeros(len(data), np.uint32)
    for n in (1, 2, 3):
        # the n-gram that ends at each byte, if it lies within one text; runs of spaces say nothing
        use = np.ones(len(data), bool)
        if n == 1:
            code = data
        else:
            code = np.concatenate((np.zeros(1, np.uint32), code))[:len(data)] * np.uint32(257) + data
            use[:n - 1] = False
            use[n - 1:] = doc[n - 1:] == doc[:max(len(doc) - n + 1, 0)]
            use[1:] &= (data[1:] != 32) | (data[:-1] != 32)
        bucket = _hash(code[use] + np.uint32(n * 0x1000193))
        out += np.bincount(doc[use] * BUCKETS + bucket, minlength=len(out)).astype(np.float32)
    x = np.sqrt(out.reshape(len(raw), BUCKETS))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
    return np.hstack([x, np.ones((len(raw), 1), np.float32)])


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 120) -> np.ndarray:
    """Weights of a linear machine (squared hinge loss, classes weighted equally), by accelerated gradient steps."""
    side = np.where(y, 1.0, -1.0).astype(np.float32)
    weight = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1)).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    ahead, rate = w.copy(), np.float32(1 / (2 * 2.0 + penalty))     # rows have squared length 2
    for t in range(steps):
        slack = np.maximum(0, 1 - side * (x @ ahead))
        grad = penalty * ahead - 2 * (x.T @ (weight * side * slack))
        new = ahead - rate * grad
        ahead = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return w


@dataclass
class Model:
    families: dict[str, list[str]] = field(default_factory=dict)      # family -> its learned languages
    of_family: dict[str, np.ndarray] = field(default_factory=dict)
    of_pair: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        x = features(texts)
        names = sorted(self.families)
        labels, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not names or not texts:
            return labels, scores
        if len(names) > 1:
            margin = np.stack([x @ self.of_family[f] for f in names], axis=1)
            best = margin.argmax(axis=1)
            rest = np.partition(margin, -2, axis=1)[:, -2]
            sure = 1 / (1 + np.exp(-2 * (margin.max(axis=1) - rest)))
        else:
            best, sure = np.zeros(len(texts), int), np.ones(len(texts))
        for i, name in enumerate(names):
            rows = np.flatnonzero(best == i)
            langs = self.families[name]
            votes, sums = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
            for a, b in combinations(range(len(langs)), 2):
                m = x[rows] @ self.of_pair[langs[a], langs[b]]
                votes[:, a] += m >= 0
                votes[:, b] += m < 0
                sums[:, a] += m
                sums[:, b] -= m
            order = votes + 0.5 * np.tanh(sums / (1 + len(langs)))      # votes first, then margins
            pick = order.argmax(axis=1)
            own = sums[np.arange(len(rows)), pick] / max(len(langs) - 1, 1)
            inner = 1 / (1 + np.exp(-4 * own)) if len(langs) > 1 else np.ones(len(rows))
            for r, p, s in zip(rows, pick, inner):
                if texts[r] is not None and _letter(texts[r]):
                    labels[r], scores[r] = langs[p], float(sure[r] * s)
        return labels, scores


def sample(labelled: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST_TEXTS) -> DataFrame:
    """(lang, text): the different texts with the smallest hashes of each language, at most ``per_language``
    of each and ``most`` in all (but one of each language at least)."""
    rows = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    # copies fold before the shuffle, which moves a language and a hash for each different text
    sizes = {r.lang: r["count"] for r in rows.select("lang", "h").distinct().groupBy("lang").count().collect()}
    each = max(1, min(per_language, most // max(len(sizes), 1)))
    # a draw with six standard deviations to spare leaves few rows, of which the first ``each`` stay
    share = labelled.sparkSession.createDataFrame(
        [(k, min(1.0, (each + 6 * each ** 0.5) / n)) for k, n in sizes.items()], "lang string, share double")
    drawn = (rows.join(F.broadcast(share), "lang")
             .where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
             .groupBy("lang", "h").agg(F.min("text").alias("text")))
    first = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("h"), F.lit(1 << 30)), "h")
    return drawn.withColumn("n", F.row_number().over(first)).where(F.col("n") <= each).select("lang", "text")


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST_TEXTS) -> Model:
    """A model from (text, lang) rows; the driver gets features of ``sample`` only."""

    def vectors(batches):
        for b in text_chunks(batches):
            x = features(b.column("text").to_pylist()).astype(np.float16)
            yield batch_of({"lang": b.column("lang"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    found = sample(labelled, per_language, most).mapInArrow(vectors, "lang string, x binary").collect()
    if not found:
        return Model()
    found.sort(key=lambda r: (r.lang, bytes(r.x)))
    x = np.frombuffer(b"".join(r.x for r in found), np.float16).reshape(len(found), -1).astype(np.float32)
    lang = np.array([r.lang for r in found])
    family = np.array([FAMILY.get(v, v) for v in lang])
    model = Model({f: sorted(set(lang[family == f])) for f in sorted(set(family))})
    if len(model.families) > 1:
        model.of_family = {f: fit_svm(x, family == f) for f in model.families}
    for langs in model.families.values():
        for a, b in combinations(langs, 2):
            two = (lang == a) | (lang == b)
            model.of_pair[a, b] = fit_svm(x[two], lang[two] == a)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)      # a few weight vectors of fixed length

    def run(batches):
        for b in text_chunks(batches):
            labels, scores = held.value.predict(b.column("text").to_pylist())
            yield batch_of({"doc_id": b.column("doc_id").cast(pa.int64()), "lang_pred": pa.array(labels, pa.string()),
                            "score": pa.array(scores, pa.float64())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
