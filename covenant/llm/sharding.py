"""Operator 4: consistent-hash ring with virtual nodes and bounded loads.

The ring has 2**14 cells. Each shard owns several virtual nodes, each in a
cell; a row's cell is the hash of its text, so copies start at the same place,
and its home is the owner of the next virtual node clockwise. A shard takes
rows up to its bound; rows that overflow continue clockwise to the next shard
with room. With no slack the bounds add up to the number of rows and differ by
at most one, so shard sizes do, too. With slack, fewer rows leave their home.

Only counts by cell (2**14 at most) reach the driver, which shares out whole
cells and parts of cells. A row finds its place from its rank within its cell:
a cell's rows are dealt into about sqrt(rows) sized buckets by hash, counted,
and numbered within buckets, so a cell with a third of all rows is many small
groups. All of it is DataFrame operations.

Defined cases: a null text counts as no bytes (size 1) and as a text of its
own for the ring; repeated rows take one slot each; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL_BITS = 14
CELLS = 1 << CELL_BITS


@dataclass(frozen=True)
class Ring:
    shards: int = 16
    virtual: int = 64

    def owners(self) -> list[list[int]]:
        """For each cell, the shards in the order in which they follow clockwise."""
        taken: dict[int, int] = {}
        for shard in range(self.shards):
            for v in range(self.virtual):
                at = int.from_bytes(blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big") % CELLS
                while at in taken:                      # next free cell
                    at = (at + 1) % CELLS
                taken[at] = shard
        marks = sorted(taken)
        follow: dict[int, list[int]] = {}               # by virtual node: distinct shards from it on
        for i, mark in enumerate(marks):
            order = dict.fromkeys(taken[m] for m in marks[i:] + marks[:i])
            follow[mark] = list(order)
        out, i = [], 0
        for cell in range(CELLS):
            while i < len(marks) and marks[i] < cell:
                i += 1
            out.append(follow[marks[i % len(marks)]])
        return out

    def bounds(self, rows: int, slack: float = 0.0) -> list[int]:
        if slack > 0:
            return [-int(-(rows * (1 + slack)) // self.shards)] * self.shards
        return [rows // self.shards + (s < rows % self.shards) for s in range(self.shards)]

    def share_out(self, counts: dict[int, int], slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
        """(cell, first rank, rank after the last, shard, slot of the first) of every piece."""
        owners, room = self.owners(), self.bounds(sum(counts.values()), slack)
        used, begin, out = [0] * self.shards, dict.fromkeys(counts, 0), []
        for turn in range(self.shards):                 # homes first, then one shard further each turn
            for cell in sorted(counts):
                left = counts[cell] - begin[cell]
                shard = owners[cell][turn]
                take = min(left, room[shard] - used[shard])
                if take > 0:
                    out.append((cell, begin[cell], begin[cell] + take, shard, used[shard]))
                    begin[cell] += take
                    used[shard] += take
        return out


def shard(docs: DataFrame, ring: Ring = Ring(), slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, home (bool: the shard that the ring names first)."""
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("key"))
    rows = rows.withColumn("cell", F.shiftrightunsigned("key", 64 - CELL_BITS).cast("int"))
    counts = {r.cell: r["count"] for r in rows.groupBy("cell").count().collect()}
    total = sum(counts.values())
    pieces = ring.share_out(counts, slack)
    owners = ring.owners()
    plan = spark.createDataFrame([(*p, p[3] == owners[p[0]][0]) for p in pieces],
                                 "cell int, first long, stop long, shard int, slot0 long, home boolean")
    per = max(64, int(total ** 0.5))
    buckets = spark.createDataFrame([(c, -(-n // per)) for c, n in counts.items()], "cell int, buckets long")
    rows = (rows.join(F.broadcast(buckets), "cell")
            .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key", F.lit("bucket")), "buckets")).drop("buckets"))
    before = (rows.groupBy("cell", "bucket").agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("cell").orderBy("bucket")) - F.col("n"))
              .select("cell", "bucket", "before"))
    own = Window.partitionBy("cell", "bucket").orderBy("key", "doc_id", "text_crc32", "size")
    ranked = (rows.withColumn("i", F.row_number().over(own)).join(before, ["cell", "bucket"])
              .withColumn("rank", F.col("before") + F.col("i") - 1))
    return (ranked.join(F.broadcast(plan), "cell").where("rank >= first and rank < stop")
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"), "home"))
