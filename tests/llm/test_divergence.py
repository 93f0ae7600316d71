"""The audit of sources against a plain version that looks at every term of every two groups."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from covenant.llm import divergence

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, min_docs=10, top=10):
    n, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        n[lang, source].update(terms)
        held[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in held[lang].items() if d >= min_docs]

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            parts = {"pair": [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s],
                     "term": [(-f(p[s][t], q[t]), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(items) if part == "pair" or i < top]
    return sorted(out)


def make(rng, n):
    words = ["Wort", "wort", "É", "é", "x", "漢字", "a b", "ab", "Abc", "zeta", "don't", "_u_", "\U0001f600", "\u0080"] + [f"w{c}" for c in "abcdefghijkl"]
    docs = []
    for i in range(n):
        source = rng.choice(["hot"] * 6 + ["s1", "s2", "s10", None, "é"])
        docs.append((" ".join(rng.choices(words, k=rng.choice([0, 2, 30]))), rng.choice(["en", "en", "de", None]), source))
    return docs + [(None, "en", "s1"), ("", "en", "only empty"), ("few words here", "xx", "a"), (None, "xx", "b"), ("Q " * 5000, "de", "s1")]


def test_equals_the_plain_version(spark):
    docs = make(random.Random(4), 260)
    df = spark.createDataFrame([(t, l, s, 0, "x", 1) for t, l, s in docs + docs[:40]],
                               "text string, lang string, source string, term int, p string, docs int").repartition(5)
    for block_terms in (1024, 4):
        got = sorted(tuple(r) for r in divergence.audit(df, block_terms=block_terms).collect())
        assert got == plain(docs + docs[:40])
    got = sorted(tuple(r) for r in divergence.audit(df, min_docs=1, top_terms=2).collect())
    assert got == plain(docs + docs[:40], 1, 2)


def test_small_tables_and_long_texts_change_nothing(spark, monkeypatch):
    docs = make(random.Random(9), 60)

    def count(batches):
        import pyarrow as pa
        table = pa.table({"lang": [d[1] or "" for d in docs], "source": [d[2] or "" for d in docs], "text": [d[0] for d in docs]})
        return [r for b in divergence._counted(table.to_batches()) for r in b.to_pylist()]

    def summed(rows):
        out = defaultdict(lambda: [0, 0])
        for r in rows:
            key = r["lang"], r["source"], r["term"]
            out[key] = [out[key][0] + r["n"], out[key][1] + r["docs"]]
        return dict(out)

    once = count(docs)
    monkeypatch.setattr(divergence, "TABLE_BYTES", 2000)
    monkeypatch.setattr(divergence, "PART_BYTES", 7)
    parts = count(docs)
    assert len(parts) > len(once) and summed(parts) == summed(once)


def test_empty_table_and_table_without_terms(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(empty).count() == 0
    none = spark.createDataFrame([("12 34", "en", "a"), (None, "en", "b"), ("x", None, None)], empty.schema)
    assert sorted(tuple(r) for r in divergence.audit(none).collect()) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_cells_from_bitmaps_equal_counting():
    rng = np.random.default_rng(7)
    for groups, terms, levels in ((3, 200, 4), (6, 64, 60), (2, 5, 1), (4, 130, 300)):
        counts = rng.integers(0, levels + 1, (groups, terms)) * (rng.random((groups, terms)) < 0.6)
        counts = counts[:, counts.any(axis=0)]
        p = 1 + 10**9 * (counts + 2) // (counts.sum(axis=1) + 2 * counts.shape[1])[:, None]
        zero = 1 + 10**9 * 2 // (counts.sum(axis=1) + 2 * counts.shape[1])
        rows = [(g, w, sum(1 << i for i, c in enumerate(counts[g, w * 64:w * 64 + 64]) if c == level), int(p[g][counts[g] == level][0]))
                for g in range(groups) for w in range(-(-counts.shape[1] // 64)) for level in set(counts[g, w * 64:w * 64 + 64]) - {0}]
        s, w, b, q = (np.array(x) for x in zip(*rows))
        got = divergence.pair_sums(s, w, np.array([r[2] for r in rows], np.uint64), q.astype(np.int64), zero)
        for a in range(groups):
            for c in range(groups):
                assert a == c or got[a, c] == sum((int(x) - int(y)) ** 2 // (int(x) + int(y)) for x, y in zip(p[a], p[c]))


def test_shares_stay_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    n, total, terms = 7 * 10**17, 9 * 10**18, 10**9
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms))).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * terms)
