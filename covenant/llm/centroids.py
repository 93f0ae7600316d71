"""Operator 13: centroid clustering by scalar lookup tables.

Components become integers, floor(scale * x). Vectors are stored once in blocks
of up to ``BLOCK`` rows, each dimension as the integers that occur in the block
and a 16-bit code per vector. In every round a block tabulates the squared
difference between each occurring integer and the same dimension of each
centroid; the distance of a vector is the sum of table rows picked by its codes.

A round sends centroids to the tasks and gets back, summed in Spark, the number
and the component sums of each cluster: at most k * dims * limbs rows, whatever
the input. Sums are cut into limbs of 32 bits, so that they stay exact for any
finite input; blocks whose integers would overflow 64-bit distances are computed
with Python integers instead.

Defined cases: a null array, one of another length, or one with a null or
non-finite component is left out; ties go to the smaller number; an empty
cluster keeps its centroid; with fewer than k vectors there are as many
centroids as vectors; repeated rows and rows with a null id are vectors of their
own (a null id is drawn last as a start); a distance or sum beyond 64 bits is
null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.llm.common import batch_of, stored

BLOCK, SAFE, LIMB = 4096, 1 << 27, 32
_BLOCK_FIELDS = "ids array<bigint>, codes binary, sizes array<int>, small binary, wide string"


def _integer(x: float, scale: int) -> int:
    """floor(scale * x) for any finite x, where the product of doubles may overflow."""
    n, d = float(x).as_integer_ratio()
    return n * scale // d


def _rows_of(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that are kept, and their components as doubles."""
    offsets = column.offsets.to_numpy()
    keep = (np.diff(offsets) == dims) & column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(keep)
    flat = column.values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    x = flat[offsets[:-1][rows][:, None] + np.arange(dims)]
    good = np.isfinite(x).all(axis=1)
    return rows[good], x[good]


def _blocker(dims: int, scale: int):
    def run(batches):
        for b in batches:
            rows, x = _rows_of(b.column("vector"), dims)
            ids = b.column("vec_id").cast(pa.int64())
            for i in range(0, len(rows), BLOCK):
                part = x[i:i + BLOCK]
                with np.errstate(over="ignore"):
                    whole = np.floor(part * scale)
                safe = bool((np.abs(whole) <= SAFE).all())
                values, codes = zip(*(np.unique(whole[:, d] if safe else part[:, d], return_inverse=True) for d in range(dims)))
                wide = None if safe else json.dumps([str(_integer(v, scale)) for vs in values for v in vs])
                yield batch_of({
                    "ids": pa.array([ids.take(pa.array(rows[i:i + BLOCK]))], pa.list_(pa.int64())),
                    "codes": pa.array([np.stack(codes).astype(np.uint16).tobytes()], pa.binary()),
                    "sizes": pa.array([[len(v) for v in values]], pa.list_(pa.int32())),
                    "small": pa.array([np.concatenate(values).astype(np.int64).tobytes() if safe else None], pa.binary()),
                    "wide": pa.array([wide], pa.string())})
    return run


class Block:
    """A stored block: per dimension the occurring integers, and codes of the vectors."""

    def __init__(self, row: dict):
        sizes = np.array(row["sizes"])
        self.ids, self.dims = row["ids"], len(sizes)
        self.codes = np.frombuffer(row["codes"], np.uint16).reshape(self.dims, -1)
        self.values = (np.frombuffer(row["small"], np.int64) if row["wide"] is None
                       else np.array([int(v) for v in json.loads(row["wide"])], object))
        self.starts = np.concatenate(([0], np.cumsum(sizes)))

    def nearest(self, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Cluster (the smallest number among the nearest) and squared distance of every vector."""
        safe = self.values.dtype != object and all(abs(c) <= SAFE for row in centroids for c in row)
        kind = np.int64 if safe else object
        c = np.array(centroids, dtype=kind)
        total = np.zeros((self.codes.shape[1], len(centroids)), kind)
        for d in range(self.dims):
            occurring = self.values[self.starts[d]:self.starts[d + 1]].astype(kind)
            table = (occurring[:, None] - c[None, :, d]) ** 2
            total += table[self.codes[d]]
        cluster = total.argmin(axis=1)
        return cluster, total[np.arange(len(total)), cluster]

    def sums(self, cluster: np.ndarray, k: int) -> tuple[np.ndarray, list[list[int]]]:
        """Members and component sums of every cluster."""
        x = np.stack([self.values[self.starts[d]:self.starts[d + 1]][self.codes[d]] for d in range(self.dims)], axis=1)
        return (np.bincount(cluster, minlength=k), [[int(v) for v in x[cluster == j].sum(axis=0)] for j in range(k)])


def limbs(value: int) -> list[int]:
    """value = sum of limb[i] * 2**(32 i); all but the last are at least 0."""
    out = []
    while not -(1 << LIMB) <= value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def _summer(centroids: list[list[int]]):
    def run(batches):
        k, count, total = len(centroids), None, None
        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                n, s = block.sums(block.nearest(centroids)[0], k)
                count = n if count is None else count + n
                total = s if total is None else [[x + y for x, y in zip(p, q)] for p, q in zip(total, s)]
        if count is not None:
            rows = [(j, d, i, v) for j in range(k) if count[j] for d, x in enumerate([int(count[j]), *total[j]])
                    for i, v in enumerate(limbs(x))]
            yield batch_of({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(
                (("cluster", pa.int32()), ("dim", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())))})
    return run


def _assigner(centroids: list[list[int]]):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                cluster, distance = block.nearest(centroids)
                fits = [int(d) if d < 1 << 63 else None for d in distance.tolist()]
                yield batch_of({"vec_id": pa.array(block.ids, pa.int64()), "cluster": pa.array(cluster.astype(np.int32)),
                                "distance": pa.array(fits, pa.int64())})
    return run


def _moved(blocks: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after a round: floor of the mean of the members; empty ones stay."""
    rows = (blocks.mapInArrow(_summer(centroids), "cluster int, dim int, limb int, value bigint")
            .groupBy("cluster", "dim", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect())
    sums: dict[tuple[int, int], int] = {}
    for r in rows:                          # at most centroids * (dimensions + 1) * limbs of them
        sums[r.cluster, r.dim] = sums.get((r.cluster, r.dim), 0) + (int(r.value) << (LIMB * r.limb))
    return [[sums[j, d + 1] // sums[j, 0] for d in range(len(c))] if (j, 0) in sums else c for j, c in enumerate(centroids)]


def cluster(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64,
            scale: int = 1024, seed: str = "3") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every kept vector.
    Starts are the k kept vectors with the smallest hash of ``seed:vec_id``."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
    blocks = stored(rows.mapInArrow(_blocker(dims, scale), _BLOCK_FIELDS), "vector-blocks")
    kept = rows.where((F.size("vector") == dims) & F.forall(
        "vector", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x)))
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    starts = kept.orderBy(draw.asc_nulls_last(), "vector").limit(k).collect()
    centroids = [[_integer(x, scale) for x in r.vector] for r in starts]
    if not centroids:
        return rows.where("false").selectExpr(
            "cast(vec_id as bigint) vec_id", "0 cluster", "0L distance", "0L cluster_inertia", "0L inertia", "'' centroid_sha256")
    for _ in range(rounds):
        centroids = _moved(blocks, centroids)
    found = stored(blocks.mapInArrow(_assigner(centroids), "vec_id bigint, cluster int, distance bigint"), "assigned")
    # a sum is null where any distance is, or where it does not fit
    whole = lambda rs: sum(rs) if all(r is not None for r in rs) and sum(rs) < 1 << 63 else None
    wide = F.col("distance").cast("decimal(38,0)")
    per = {r.cluster: None if r.lost else int(r.value) for r in found.groupBy("cluster").agg(
        F.sum(wide).alias("value"), F.max(F.col("distance").isNull()).alias("lost")).collect()}     # k rows at most
    total = whole(list(per.values()))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    stats = found.sparkSession.createDataFrame(
        [(j, whole([v]), total, digest[j]) for j, v in per.items()],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return (found.join(F.broadcast(stats), "cluster")
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
