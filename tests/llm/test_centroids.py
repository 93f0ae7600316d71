"""Centroid clustering against a plain version with Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from covenant.llm import centroids

SCHEMA = "vec_id bigint, embedding array<double>, cluster string, distance int"


def plain(rows, k, rounds, dims, scale=1024, seed="3"):
    kept = [(i, [math.floor(x * scale) if abs(x) < 1e300 else int(x) * scale for x in v], v) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2])
    c = [r[1] for r in sorted(kept, key=key)[:k]]
    dist = lambda v, x: sum((a - b) ** 2 for a, b in zip(v, x))
    near = lambda v: min(range(len(c)), key=lambda j: (dist(v, c[j]), j))
    for _ in range(rounds):
        of = [near(v) for _, v, _ in kept]
        c = [[sum(col) // of.count(j) for col in zip(*(v for (_, v, _), o in zip(kept, of) if o == j))] if j in of else c[j] for j in range(len(c))]
    found = [(i, near(v), dist(v, c[near(v)])) for i, v, _ in kept]
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    part = {j: sum(d for _, o, d in found if o == j) if all(d < 1 << 63 for _, o, d in found if o == j) else None for j in range(len(c))}
    total = None if any(fits(part[o]) is None for _, o, _ in found) else fits(sum(d for *_, d in found))
    return [(i, o, fits(d), fits(part[o]), total, hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for i, o, d in found]


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(4)
    return sorted((tuple(r) for r in centroids.cluster(df, **options).collect()), key=repr)


def test_equals_the_plain_version(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(i % 5, 0.4) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, [1.0, -0.5, 0.25, 0.0, -2.0, 3.0]) for i in range(200)]            # copies
    rows += [(2000, None), (2001, [1.0] * 5), (2002, [1.0] * 7), (2003, [None] + [1.0] * 5), (2004, [float("nan")] + [0.0] * 5),
             (2005, [float("inf")] + [0.0] * 5), (2006, []), (None, [0.5] * 6), (None, [0.5] * 6), (3, [9.0] * 6), (3, [9.0] * 6)]
    for options in (dict(k=8, rounds=10), dict(k=3, rounds=1), dict(k=8, rounds=0)):
        assert run(spark, rows, dims=6, **options) == sorted(plain(rows, dims=6, **options), key=repr)


def test_ties_and_equal_starts(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)] + [(100, [0.5, 0.0])]
    want = sorted(plain(rows, 8, 3, 2), key=repr)
    assert run(spark, rows, k=8, rounds=3, dims=2) == want
    assert len({r[1] for r in want}) < 8                        # equal starts: the larger numbers stay empty


@pytest.mark.parametrize("size", [2.0**20, 1e12, 1e30, 1.7e308])
def test_large_components_stay_exact(spark, size):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * size, rng.random()]) for i in range(60)]
    assert run(spark, rows, k=4, rounds=4, dims=2) == sorted(plain(rows, 4, 4, 2), key=repr)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 2.0])]
    assert run(spark, rows, dims=2) == sorted(plain(rows, 8, 10, 2), key=repr)
    assert run(spark, [], dims=2) == [] == run(spark, [(1, None)], dims=2)


def test_limbs_add_up():
    rng = random.Random(1)
    for _ in range(2000):
        v = rng.randint(-2**rng.randrange(1, 200), 2**rng.randrange(1, 200))
        parts = centroids.limbs(v)
        assert sum(x << (32 * i) for i, x in enumerate(parts)) == v and all(abs(x) <= 1 << 32 for x in parts)


def test_blocks_hold_only_integers_that_occur():
    import pyarrow as pa
    x = np.random.default_rng(2).normal(0, 0.01, (5000, 3)).astype(np.float32)
    batch = pa.record_batch({"vec_id": pa.array(range(5000)), "vector": pa.array(x.tolist(), pa.list_(pa.float32()))})
    rows = [r for b in centroids._blocker(3, 1024)([batch]) for r in b.to_pylist()]
    assert [len(r["ids"]) for r in rows] == [4096, 904]
    for r, part in zip(rows, (x[:4096], x[4096:])):
        block = centroids.Block(r)
        whole = np.floor(part.astype(float) * 1024).astype(int)
        assert r["sizes"] == [len(set(whole[:, d])) for d in range(3)]
        cluster, distance = block.nearest([[0, 0, 0], [5, 5, 5]])
        d = np.stack([(whole ** 2).sum(axis=1), ((whole - 5) ** 2).sum(axis=1)], axis=1)
        assert (cluster == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
