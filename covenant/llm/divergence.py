"""Operator 11: audit of how the sources of a language differ, by count-level bitmaps.

Terms are runs of letters and non-ASCII characters, A-Z lower-cased. A language
keeps the terms that at least ``min_docs`` of its documents hold. Every group
(lang, source) gives each kept term a smoothed share p in parts of 10**9, and
two shares p, q differ by f = floor((p - q)**2 / (p + q)).

Share and difference depend on counts only. So for every group and every count
that occurs in it the kept terms with that count are stored as a bitmap, cut
into words of 64 term numbers. AND and popcount of two groups' bitmaps give the
number of terms in each joint cell (a, b) of counts, which is multiplied by
f(p_a, q_b); cells where a count is zero follow by complement: terms at count a
less those met at any count of the other group. Terms are numbered inside
blocks of about ``block_terms``; a block holds the bitmaps of all groups of its
language, and its sums add up with those of other blocks.

Term counts are gathered in the tasks that read the texts, in bounded tables,
before any shuffle. All arithmetic is exact: 64-bit where the values are bounded
by it, decimal for shares.

Defined cases: null text, lang and source are ''; a group without kept terms has
the share of count 0 everywhere; a language without kept terms has values 0;
repeated rows are documents of their own; very long texts are counted in parts;
an empty table gives no rows; columns other than text, lang, source are ignored;
equal values are ranked by item.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covenant.llm.common import batch_of, stored, text_chunks, utf8

MIN_DOCS, TOP_TERMS, SCALE = 10, 10, 1_000_000_000
BLOCK_TERMS, TABLE_BYTES, PART_BYTES, TILE = 1024, 48 << 20, 1 << 20, 1 << 21
ENTRY_BYTES = 230                       # of a term in both tables of counts, but for its characters
#: Letters stay (A-Z lower-cased), as do the bytes of all characters beyond ASCII; the rest separates terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _parts(text: bytes):
    """Parts of a text of about PART_BYTES, cut between terms."""
    i = 0
    while i < len(text):
        j = text.find(b" ", i + PART_BYTES)
        j = len(text) if j < 0 else j
        yield text[i:j]
        i = j


def _counted(batches):
    """Rows (lang, source, term, n, docs), summed over as many texts as a bounded table holds."""
    tables: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def flush():
        for (lang, source), (n, docs) in tables.items():
            terms = list(n)
            for i in range(0, len(terms), 1 << 15):
                some = terms[i:i + (1 << 15)]
                yield batch_of({"lang": pa.array([lang] * len(some), pa.string()), "source": pa.array([source] * len(some), pa.string()),
                                "term": pa.array(some, pa.binary()).cast(pa.string()),
                                "n": pa.array([n[t] for t in some], pa.int64()), "docs": pa.array([docs[t] for t in some], pa.int64())})
        tables.clear()

    for b in text_chunks(batches):
        data, offsets = utf8(b.column("text"))
        data = data.tobytes().translate(_TERM_BYTES)
        for i, group in enumerate(zip(b.column("lang").to_pylist(), b.column("source").to_pylist())):
            n, docs = tables.setdefault(group, (Counter(), Counter()))
            text, seen, before = data[offsets[i]:offsets[i + 1]], set(), len(n)
            for part in _parts(text):
                terms = part.split()
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            size += ENTRY_BYTES * (len(n) - before) + (sum(map(len, seen)) if len(n) > before else 0)
            if size > TABLE_BYTES:
                yield from flush()
                size = 0
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group, in parts to be summed."""
    return docs.select("lang", "source", "text").mapInArrow(
        _counted, "lang string, source string, term string, n bigint, docs bigint")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)); null where there are no terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    part = F.call_function("div", wide(F.lit(SCALE)) * wide(n + 2), wide(total + 2 * terms))
    return F.when(terms > 0, 1 + part.cast("long"))


def difference(p, q):
    """floor((p - q)**2 / (p + q)) for arrays of shares."""
    return (p - q) * (p - q) // (p + q)


def pair_sums(source: np.ndarray, word: np.ndarray, bits: np.ndarray, p: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Sums of ``difference`` over a block's terms for every two groups.

    One bitmap row per (group, count, word): ``source`` is the group's number, ``p`` the share of the
    count; ``zero`` has each group's share of count 0. A block's terms are those of any bitmap.
    """
    groups = len(zero)
    out = np.zeros((groups, groups), np.int64)
    f00 = difference(zero[:, None], zero[None, :])
    order = np.lexsort((p, source, word))
    source, word, bits, p = source[order], word[order], bits[order], p[order]
    cuts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1], [True]))) if len(word) else np.zeros(1, np.int64)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        b, s, q = bits[lo:hi], source[lo:hi], p[lo:hi]
        n_terms = int(np.bitwise_count(np.bitwise_or.reduce(b)))
        n_row = np.bitwise_count(b).astype(np.int64)
        met = np.zeros((len(b), groups), np.int64)           # terms of a row that another group has at any count
        step = max(1, TILE // len(b))
        for i in range(0, len(b), step):
            cells = np.bitwise_count(b[i:i + step, None] & b[None, :])
            x, y = np.nonzero(cells)
            n = cells[x, y].astype(np.int64)
            x += i
            np.add.at(met, (x, s[y]), n)
            np.add.at(out, (s[x], s[y]), n * difference(q[x], q[y]))
        alone = (n_row[:, None] - met) * difference(q[:, None], zero[None, :])
        one_side = np.zeros_like(out)
        np.add.at(one_side, s, alone)
        n_group, both = np.zeros(groups, np.int64), np.zeros_like(out)
        np.add.at(n_group, s, n_row)
        np.add.at(both, s, met)
        neither = n_terms - n_group[:, None] - n_group[None, :] + both
        out += one_side + one_side.T + neither * f00
    return out


def _block_pairs(key, table):
    """Sums of a block for every two sources: rows without a word name the groups, the others are bitmaps."""
    names = table.column("source").to_pylist()
    word = table.column("word").to_pandas()
    group = word.isna().to_numpy()
    p = table.column("p").fill_null(1).to_numpy()
    number = {s: i for i, s in enumerate(sorted(s for s, g in zip(names, group) if g))}
    zero = np.ones(len(number), np.int64)
    at = np.array([number[s] for s in names], np.int64)
    zero[at[group]] = p[group]
    rows = ~group
    bits = table.column("bits").fill_null(0).to_numpy().view(np.uint64)
    sums = pair_sums(at[rows], word[rows].to_numpy(np.int64), bits[rows], p[rows], zero)
    x, y = np.nonzero(~np.eye(len(number), dtype=bool))
    names = np.array(list(number), object)
    return pa.table({"lang": pa.array([key[0].as_py()] * len(x), pa.string()), "source": pa.array(names[x], pa.string()),
                     "item": pa.array(names[y], pa.string()), "value": pa.array(sums[x, y], pa.int64())})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: every other source of the language and the sum of
    differences over kept terms. Part ``term``: the ``top_terms`` kept terms whose share in the group exceeds
    that in the language by the largest difference."""
    text = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    by_term = Window.partitionBy("lang", "term")
    counts = (term_counts(text).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
              .withColumn("docs", F.sum("docs").over(by_term)).where(F.col("docs") >= min_docs))
    counts = stored(counts.withColumn("n_lang", F.sum("n").over(by_term)).drop("docs"), "kept-terms")

    # one row per language and per group: read from two columns, then small
    per_lang = counts.groupBy("lang", "term").agg(F.max("n_lang").alias("n")).groupBy("lang").agg(
        F.count("*").alias("terms"), F.sum("n").alias("total_lang"))
    per_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (text.select("lang", "source").groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one")
              .join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left").na.fill(0)
              .withColumn("blocks", F.greatest(F.ceil(F.col("terms") / block_terms), F.lit(1)))
              .withColumn("zero", share(F.lit(0), F.col("total"), F.col("terms"))))
    groups = stored(groups, "groups")

    shares = stored(
        counts.join(groups, ["lang", "source"])
        .select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
                share(F.col("n_lang"), F.col("total_lang"), F.col("terms")).alias("q"),
                F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")), "shares")
    numbered = (shares.groupBy("lang", "block", "term").agg(F.lit(1).alias("one"))
                .select("lang", "block", "term",
                        (F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1).alias("number")))
    bitmaps = (shares.join(numbered, ["lang", "block", "term"])
               .groupBy("lang", "block", "source", "p", F.shiftright("number", 6).alias("word"))
               .agg(F.bit_or(F.expr("shiftleft(1L, number & 63)")).alias("bits")))
    every = groups.select("lang", F.explode(F.expr("sequence(0L, cast(blocks as bigint) - 1)")).alias("block"), "source",
                          F.col("zero").alias("p"), F.lit(None).cast("int").alias("word"), F.lit(None).cast("long").alias("bits"))
    pairs = (bitmaps.unionByName(every).groupBy("lang", "block")
             .applyInArrow(_block_pairs, "lang string, source string, item string, value bigint")
             .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))

    over = (shares.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value")))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = [part.withColumn("rank", place).where(limit).withColumn("part", F.lit(name))
              for name, part, limit in (("pair", pairs, "true"), ("term", over, f"rank <= {top_terms}"))]
    return ranked[0].unionByName(ranked[1]).select("lang", "source", "part", "item", "value", "rank")
