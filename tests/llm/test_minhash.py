"""Near-duplicates and components against brute force."""

import random
import re

import numpy as np
import pytest

from covenant.llm import minhash
from covenant.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text, k):
    w = WORD.findall((text or "").encode().translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def brute(rows, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r for r in minhash.near_duplicates(df, **kw).collect()}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("k", [2, 5])
def test_against_brute_force(spark, k):
    rng = random.Random(k)
    rows = []
    for g in range(12):                                  # groups of copies, near copies and copies of those
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 30, 120]))]
        for _ in range(rng.choice([1, 2, 6])):
            rows.append(edited(rng, base, rng.choice([0, 1, 2, 4])))
    rows += ["", "   \t", None, "one", "ONE", "one two", "One  Two", "x" * 50_000, "tie tie tie tie", rows[0]]
    rows = list(enumerate(rows))
    got = run(spark, rows, k=k)
    want = brute(rows, k)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(shingles(dict(rows)[i], k)) for i, r in got.items())
    assert all(r.kept == (i == want[i]) for i, r in got.items())


def test_large_group_of_near_copies_stays_whole(spark):
    """Many different near copies of one text, and a chain in which only neighbours are alike."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, edited(rng, base, 6)) for i in range(250)]
    words = [f"c{i}" for i in range(100)]
    for i in range(40):
        rows.append((1000 + i, " ".join(words)))
        for j in range(5):
            words[(i * 5 + j) % 100] = f"d{i}-{j}"
    assert {i: r.component_id for i, r in run(spark, rows, k=2).items()} == brute(rows, 2)


def families(n):
    """Two families of near copies that share about half of their shingles, so that some buckets hold both."""
    rng = random.Random(11)
    shared = [f"w{i}" for i in range(130)]
    bases = [shared + [f"{f}{i}" for i in range(50)] for f in "ab"]
    return [(i, edited(rng, bases[i % 2], 3)) for i in range(2 * n)]


def test_two_families_in_one_bucket_stay_linear(spark, monkeypatch):
    met, beside = [], minhash._beside_pivot

    def counted(*args):
        out = beside(*args).cache()
        met.append(out.count())
        return out

    monkeypatch.setattr(minhash, "_beside_pivot", counted)
    for n in (40, 120):
        rows = families(n)
        assert {i: r.component_id for i, r in run(spark, rows, k=2).items()} == brute(rows, 2)
    assert met[1] <= 2 * 120 and met[0] <= 2 * 40


def test_an_id_with_several_texts_links_by_each(spark):
    a, b = [" ".join(f"{x}{i}" for i in range(40)) for x in "ab"]
    rows = [(5, a), (5, b), (6, a + " end"), (7, b + " end"), (4, b), (9, "else where")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(df, k=2).collect()}
    assert got == {(4, 4), (5, 4), (6, 4), (7, 4), (9, 9)}
    rows = [(5, a), (5, b), (5, b), (6, a + " end"), (7, b + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(df, k=2).collect()} == {5}
    assert sorted(tuple(r) for r in minhash.deduplicated(df, k=2).collect()) == [(5, a), (5, b)]


def test_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "a b c", 1, "x"), (4, "a b c", 2, "x"), (4, "a b c", 2, "x"), (3, "a b  c", 3, "y")],
                               "doc_id long, text string, n_shingles int, kept string")
    rows = sorted(minhash.near_duplicates(df, k=2).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, r.component_id, r.kept) for r in rows] == [(3, 3, True), (4, 3, False), (4, 3, False), (None, None, True)]
    kept = minhash.deduplicated(df, k=2)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3]
    assert minhash.near_duplicates(df.limit(0)).count() == 0 and minhash.deduplicated(df.limit(0)).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[1000:])
    sig = minhash.signatures(np.concatenate([a, b]), np.array([2000, 2000]), 128)
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.15


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert components(df.limit(0)).count() == 0
