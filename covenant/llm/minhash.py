"""Operator 1: MinHash near-duplicates.

A text's set holds its distinct k-word shingles (words are runs of
non-white-space bytes, A-Z lower-cased). Each set gets many universal hash
minima (multiply-shift), cut into bands; texts that agree on a whole band share
a bucket and are candidates. Links are confirmed by the exact Jaccard similarity
of the full sets, where need be after a check of the similarity estimated from
the signatures (with six standard deviations to spare). Linked texts form components by alternating
large-star and small-star.

Within a band bucket no all-pairs list is made. Equal sets are folded into one
representative first. Then every member is compared with its bucket's pivot,
on the full sets. Members linked to the pivot are one component. A link that
involves another member must show in the differences from the pivot: the two
share so many of them that a join on a few, the rarest first, finds the pair. So
no link between components is lost, and the work follows the number of members
and not its square.

Defined cases: a null or blank text has an empty set and links with nothing; a
text of fewer than k words is one shingle; rows with a null id are returned
unlinked (component null, kept true); rows that share an id are one document;
extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.llm.common import batch_of, int_lists, stored, text_chunks, utf8
from covenant.llm.components import components

HASHES, ROWS_PER_BAND = 128, 4
_P = np.uint64(0x9E3779B97F4A7C15)          # odd, so it has an inverse modulo 2**64
_Q = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _P)
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: np.uint64, n: int) -> np.ndarray:
    size = 1 << max(16, int(n).bit_length())
    return _powers(int(base), size)[:n]


_P_INV, _Q_INV = (np.uint64(pow(int(p), -1, 1 << 64)) for p in (_P, _Q))


def _window_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base, inverse) -> np.ndarray:
    """Polynomial hash modulo 2**64 of values[s:e] for every s, e, by prefix sums."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return (total[ends] - total[starts]) * powers(inverse, len(values) + 1)[starts]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one text after another, and their numbers."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    word = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], word[:-1])) & ~edge[:-1]
    after = np.concatenate((word[1:], [False])) & ~edge[1:]
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    words = mix(_window_sums(_BYTE[data], starts, ends, _P, _P_INV) + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets)                   # first word of each text
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n), n_words)
    at = np.arange(len(words))
    stop = np.minimum(at + k, first[1:][doc])
    use = (stop - at == k) | (at == first[:-1][doc])           # whole windows, and a short text as one
    at, stop, doc = at[use], stop[use], doc[use]
    h = mix(_window_sums(words, at, stop, _Q, _Q_INV) + (stop - at).astype(np.uint64))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=n)


@lru_cache(maxsize=2)
def _universal(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return (rng.integers(0, 1 << 63, hashes, np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 1 << 63, hashes, np.uint64))


def signatures(h: np.ndarray, counts: np.ndarray, hashes: int) -> np.ndarray:
    """uint32 minima, one row per text (all ones for an empty set)."""
    out = np.full((len(counts), hashes), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(counts)
    if len(full):
        at = (np.cumsum(counts) - counts)[full]
        a, b = _universal(hashes)
        for j in range(hashes):
            out[full, j] = np.minimum.reduceat(((h * a[j] + b[j]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per text and band; the band's number is part of the key."""
    n, hashes = sig.shape
    parts = sig.reshape(n, hashes // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, hashes // rows + 1, dtype=np.uint64) * _Q, parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * _P + parts[:, :, r])
    return key.view(np.int64)


def _sketcher(k: int, hashes: int, rows: int):
    def run(batches):
        for b in text_chunks(batches):
            h, counts = shingle_sets(*utf8(b.column("text")), k)
            sig = signatures(h, counts, hashes)
            keys = band_keys(sig, rows)
            at = np.concatenate(([0], np.cumsum(counts)))
            sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(s))))) for s in (1, 2)]
            yield batch_of({
                "doc_id": b.column("doc_id").cast(pa.int64()), "n_shingles": pa.array(counts.astype(np.int64)),
                **{f"set{i}": pa.array((s[at[1:]] - s[at[:-1]]).view(np.int64)) for i, s in enumerate(sums)},
                "bands": int_lists(keys.ravel(), np.full(len(keys), keys.shape[1]), pa.int64()),
                "sig": int_lists(sig.ravel().view(np.int32), np.full(len(sig), hashes), pa.int32())})
    return run


def sketch(docs: DataFrame, k: int = 5, hashes: int = HASHES, rows: int = ROWS_PER_BAND) -> DataFrame:
    """Per row: doc_id, n_shingles, a 128-bit fingerprint of the set (set0, set1), band keys, signature."""
    return docs.select("doc_id", "text").mapInArrow(
        _sketcher(k, hashes, rows),
        "doc_id bigint, n_shingles bigint, set0 bigint, set1 bigint, bands array<bigint>, sig array<int>")


def _set_maker(k: int):
    def run(batches):
        for b in text_chunks(batches):
            h, counts = shingle_sets(*utf8(b.column("text")), k)
            yield batch_of({"doc_id": b.column("doc_id").cast(pa.int64()),
                            "shingles": int_lists(h.view(np.int64), counts, pa.int64())})
    return run


def _star(band: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every member x of a bucket against the bucket's pivot p: sizes, the shingles that only
    x (``more``) and that only p has (``less``), and whether the two are linked.

    The pivot is the member that shares buckets with most others: of copies edited at random, the
    one that is nearest to all.
    """
    degree = band.groupBy("id").agg(F.sum("members").alias("degree"))
    central = F.max_by(F.col("id"), F.struct("degree", -F.col("id")))
    pivot = band.join(degree, "id").groupBy("band").agg(central.alias("p"))
    pairs = band.join(pivot, "band").where("id != p").select("p", F.col("id").alias("x")).distinct()
    x = sets.select(F.col("doc_id").alias("x"), F.col("shingles").alias("set_x"))
    p = sets.select(F.col("doc_id").alias("p"), F.col("shingles").alias("set_p"))
    return (pairs.join(x, "x").join(p, "p")
            .select("p", "x", F.size("set_p").cast("long").alias("n_p"), F.size("set_x").cast("long").alias("n_x"),
                    F.array_sort(F.array_except("set_x", "set_p")).alias("more"),
                    F.array_sort(F.array_except("set_p", "set_x")).alias("less"))
            .withColumns({"v": F.size("more"), "m": F.size("less")})
            .withColumn("linked", 100 * (F.col("n_x") - F.col("v")) >= percent * (F.col("n_p") + F.col("v"))))


def _beside_pivot(star: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) among members of one bucket that are not both linked to its pivot and
    that the links to pivots do not connect already. ``known`` has those components (node, component).

    With m and v the numbers of shingles that only the pivot and only a member has, s and x have
    n_p - m_s - m_x + (common differences) shingles in common, so a link needs at least
    T = ceil(percent (n_s + n_x) / (100 + percent)) - n_p + m_s + m_x common differences. If s is
    not linked to the pivot, T is positive, and it is bounded from below by numbers of s alone and
    of x alone. Differences that only one member has are left out. Of the others, put in one order,
    rarest first, two lists that have T in common agree on one of their first (length - bound + 1)
    entries; a join on these finds the pair. Where they agree, the entries before and after still
    must allow for T. Entries on which only members of one component agree are left out, too: a
    second large family in a bucket is connected by the pivots of its other buckets, and its
    members need not meet one another here.
    """
    p = percent
    numbers = ["p", "x", "n_p", "n_x", "m", "v", "linked", "c"]
    star = (star.join(known.select(F.col("node").alias("x"), "component"), "x", "left")
            .withColumn("c", F.coalesce("component", "x")))
    open_ = star.where("not linked").groupBy("p").agg(F.lit(1).alias("open"))
    each = star.join(open_, "p").select(*numbers, F.explode(F.concat("more", "less")).alias("entry"))
    common = (each.groupBy("p", "entry").agg(F.count("*").alias("f"), F.min("c").alias("low"), F.max("c").alias("high"))
              .where("low < high").drop("low", "high"))
    own = F.when(F.col("linked"), F.expr(f"floor((100 * m + {p} * v) / (100 + {p})) + 1")) \
        .otherwise(F.expr(f"greatest(1, ceil(({p} * n_x - 100 * n_p + (100 + {p}) * m) / 100))"))
    lists = (each.join(common, ["p", "entry"]).groupBy(*numbers)
             .agg(F.array_sort(F.collect_list(F.struct("f", "entry"))).alias("all"))
             .withColumn("u", F.size("all"))
             .withColumn("all", F.slice("all.entry", 1, F.greatest(F.col("u") - own + 1, F.lit(0)).cast("int"))))
    member = stored(lists, "lists").select(*numbers, "u", F.posexplode("all").alias("at", "entry"))
    loose = member.where("not linked").select(
        "p", "entry", F.col("x").alias("s"), F.col("c").alias("c_s"), F.col("n_x").alias("n_s"), F.col("m").alias("m_s"),
        F.col("u").alias("u_s"), F.col("at").alias("at_s"))
    needed = f"ceil({p} * (n_s + n_x) / (100 + {p})) - n_p + m_s + m"
    near = F.expr(f"c_s != c and (linked or s < x) and 100 * least(n_s, n_x) >= {p} * greatest(n_s, n_x)"
                  f" and {needed} <= least(at_s, at) + least(u_s - at_s, u - at)")
    return (loose.join(member, ["p", "entry"]).where(near)
            .select(F.col("s").alias("a"), F.col("x").alias("b")).distinct())


def _by_signature(pairs: DataFrame, sigs: DataFrame, percent: int, hashes: int) -> DataFrame:
    """Pairs whose estimated similarity is at least the threshold less six standard deviations."""
    t = percent / 100
    least = int(np.floor((t - 6 * (t * (1 - t) / hashes) ** 0.5) * hashes))
    a = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"))
    b = sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"))
    same = F.expr("aggregate(zip_with(sig_a, sig_b, (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x)")
    return pairs.join(b, "b").join(a, "a").where(same >= max(least, 1)).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * |A and B| >= percent * |A or B| on the full sets."""
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return (pairs.join(b, "b").join(a, "a").withColumn("both", both)
            .where(100 * F.col("both") >= percent * (F.size("set_a") + F.size("set_b") - F.col("both")))
            .select(F.col("a").alias("u"), F.col("b").alias("v")))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, hashes: int = HASHES,
                    rows: int = ROWS_PER_BAND) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    With 32 bands of 4 rows a pair at similarity 0.8 shares no band with
    probability 5e-8.
    """
    rows_ = stored(sketch(docs, k, hashes, rows), "sketch")
    group = ["n_shingles", "set0", "set1"]
    filled = rows_.where("n_shingles > 0 and doc_id is not null")
    classes = stored(filled.groupBy(*group).agg(F.min("doc_id").alias("id")), "classes")
    # one row per id and set; an id that stands for several texts keeps each of its sets
    reps = (filled.join(classes, group).where("doc_id = id")
            .select("id", *group, "bands", "sig").dropDuplicates(["id", *group]))
    band = reps.select(F.explode("bands").alias("band"), "id")
    shared = band.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    band = stored(band.join(shared, "band"), "bands")           # only buckets that hold more than one
    in_buckets = band.select(F.col("id").alias("doc_id")).distinct()
    # repeated rows once; an id that stands for several texts has several sets and links by any of them
    sets = stored(docs.select("doc_id", "text").join(in_buckets, "doc_id", "left_semi")
                  .dropDuplicates(["doc_id", "text"])
                  .mapInArrow(_set_maker(k), "doc_id bigint, shingles array<bigint>"), "sets")
    star = stored(_star(band, sets, percent), "star")
    sigs = reps.select("id", "sig")
    known = stored(components(star.where("linked").select(F.col("p").alias("u"), F.col("x").alias("v"))), "by-pivot")
    beside = stored(_confirmed(_by_signature(_beside_pivot(star, known, percent), sigs, percent, hashes), sets, percent), "beside")
    # an id with several sets connects their classes
    by_hash = F.xxhash64(*group)
    several = filled.groupBy("doc_id").agg(F.min(by_hash).alias("low"), F.max(by_hash).alias("high")).where("low < high").select("doc_id")
    own = (filled.join(several, "doc_id", "left_semi").join(classes, group).where("doc_id != id")
           .select(F.col("doc_id").alias("u"), F.col("id").alias("v")).distinct())
    beside = beside.unionByName(own)
    label = known.select(F.col("node").alias("id"), "component")
    joined = components(_between(beside, label)).select(F.col("node").alias("component"), F.col("component").alias("last"))
    # every node of a link: its component by pivots, and what that one is joined with
    nodes = label.select("id").unionByName(beside.select(F.col("u").alias("id"))).unionByName(beside.select(F.col("v").alias("id"))).distinct()
    labels = (nodes.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
              .join(joined, "component", "left").select("id", F.coalesce("last", "component").alias("component")))
    of_class = (classes.join(labels, "id", "left")
                .select(*group, F.coalesce("component", "id").alias("component")))
    return (rows_.join(of_class, group, "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _between(links: DataFrame, label: DataFrame) -> DataFrame:
    """Links (u, v) as links of the components that their ends belong to."""
    for end in ("u", "v"):
        mine = label.select(F.col("id").alias(end), "component")
        links = links.join(mine, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    return links.select("u", "v")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``near_duplicates`` keeps: of each group the
    rows of the smallest id (equal rows of that id once), and rows that belong to no group."""
    found = stored(near_duplicates(docs, **options), "near-duplicates")
    gone = found.where("not kept").select("doc_id")
    repeated = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    once = docs.join(gone.unionByName(repeated).distinct(), "doc_id", "left_anti").select(*docs.columns)
    # only rows of ids that occur again are compared by their texts
    again = (docs.join(repeated, "doc_id", "left_semi").join(gone, "doc_id", "left_anti").select(*docs.columns)
             .dropDuplicates(["doc_id", "text"]))
    return once.unionByName(again)
