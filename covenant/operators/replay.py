"""Replays: events applied in order to a small state per key, in bounded blocks.

An event is a function on a finite set of states, so a run of events is one,
too. Events are numbered per key, every ``BLOCK`` consecutive ones form a
block, every ``BLOCK`` blocks a section. Blocks are folded side by side, a
section composes its blocks' functions, and a key walks its sections from its
start state; going back down, each section, block and event gets the state
that enters it. No list holds more than ``BLOCK`` entries but that of a key's
sections, which has one entry for every BLOCK * BLOCK events of that key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.session import materialize

BLOCK = 256


def plain_keys(df: DataFrame, columns: list[str], prefix: str, nullable: list[bool] | None = None) -> tuple[DataFrame, list[str]]:
    """Columns without nulls that agree exactly where the given ones agree null-safely, and their names.
    ``nullable``: as in the schema of the frame that they are to meet, if it is another one.

    Spark joins on ``eqNullSafe`` by expressions over the columns, so rows that a window has just partitioned by
    them would be shuffled and sorted again; plain columns serve window and join alike."""
    names, out = [], {}
    for i, f in enumerate(df.schema[c] for c in columns):
        kind, key = f.dataType, F.col(f.name)
        if not (nullable[i] if nullable else f.nullable):
            parts = [key]
        elif isinstance(kind, (T.NumericType, T.StringType)):
            parts = [F.coalesce(key, F.lit(0).cast(kind)), key.isNull()]
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            parts = [F.coalesce(key, F.lit("1970-01-01").cast(kind)), key.isNull()]
        else:
            parts = [F.struct(key)]
        for n, c in enumerate(parts):
            names.append(f"{prefix}{i}_{n}")
            out[names[-1]] = c
    return df.withColumns(out), names


def exact_rank(df: DataFrame, part: str | list[str], order: list, bucket: Column, name: str,
               start: DataFrame | None = None) -> DataFrame:
    """Exact ``row_number`` over ``part`` ordered by ``order``, computed per bucket.

    ``bucket`` must be a monotone coarsening of the first ordering column.
    rank = rows of the same ``part`` in earlier buckets + rank inside the bucket.
    The window over bucket counts sees one row per (part, bucket). Null keys and
    null ordering values (which sort first) are values like any other.
    ``start`` (the columns of ``part`` and ``start``) gives the number that a part's ranks go on from, else 0;
    it meets the counts, so the rows themselves are shuffled once.
    """
    parts = [part] if isinstance(part, str) else part
    b, keys = plain_keys(df.withColumn("_bk", bucket), parts, "_k")
    b, at = plain_keys(b, ["_bk"], "_b")
    counts = b.groupBy(*keys, *at, "_bk").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*keys, *at, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    if start is not None:
        like = plain_keys(start, parts, "_k", nullable=[df.schema[p].nullable for p in parts])[0].withColumnRenamed("start", "_start")
        before = before.join(like.select(*keys, "_start"), keys, "left").select(
            *keys, *at, (F.col("_before") + F.coalesce("_start", F.lit(0))).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*keys, *at).orderBy(*order))
    return (b.withColumn("_r", inner).join(before, [*keys, *at])
            .withColumn(name, (F.col("_before") + F.col("_r")).cast("int"))
            .select(*df.columns, name))


#: Rows of one part that go to one range; the rows of a part with more are dealt by bucket, too.
HEAVY = 500_000
#: Pairs of a heavy part and a bucket that are sent to every task.
SENT = 500_000


def heavy_parts(df: DataFrame, part: str, groups: int = 1 << 16) -> DataFrame | None:
    """The values of ``part`` (null is one) with more than ``HEAVY`` rows, or None. Hash groups are counted first, so
    values are counted one by one only where a group has so many rows; the driver gets numbers of groups."""
    values = df.select(part, F.pmod(F.xxhash64(part), F.lit(groups)).cast("int").alias("_g"))
    full = [r[0] for r in values.groupBy("_g").count().where(F.col("count") > HEAVY).select("_g").collect()]
    if not full:
        return None
    some = values if len(full) == groups else values.where(F.col("_g").isin(full))
    found = materialize(some.groupBy(part).count().where(F.col("count") > HEAVY).select(F.col(part).alias("_heavy"), F.lit(True).alias("_is")))
    return None if found.isEmpty() else found


def dealt_rank(df: DataFrame, part: str, order: list[str], bucket: Column, name: str, digests: list[str]) -> DataFrame:
    """``exact_rank`` that leaves the rows in ranges of ``part``, so that a sort by ``part`` shuffles them no more.

    The rows are shuffled once, without counts beside them. The rows of a heavy part are dealt by ``bucket``, too, and
    ranked in each; the result then has the column ``_slice`` (the bucket; null in other parts), and a sort has to name
    it, descending, after ``part``. ``digests`` are text columns of hexadecimal digits, which travel as bytes; other
    text in them travels as it is.
    """
    heavy, rest = heavy_parts(df, part), [F.col(c) for c in df.columns]
    packed = df
    for i, c in enumerate(digests):
        packed = packed.withColumn(f"_x{i}", F.unhex(c)).withColumn(f"_x{i}", F.when(F.lower(F.hex(f"_x{i}")) == F.col(c), F.col(f"_x{i}"))) \
            .withColumn(c, F.when(F.col(f"_x{i}").isNull(), F.col(c)))
        rest[df.columns.index(c)] = F.coalesce(c, F.lower(F.hex(f"_x{i}"))).alias(c)
    row = F.row_number()
    if heavy is None:
        dealt = packed.repartitionByRange(part).withColumn(name, row.over(Window.partitionBy(part).orderBy(*order)))
        return dealt.select(*rest, name)
    is_heavy = F.col(part).eqNullSafe(F.col("_heavy"))
    counts = df.withColumn("_bk", bucket).join(F.broadcast(heavy), is_heavy, "left_semi").groupBy(part, "_bk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(part).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    before = materialize(counts.select(F.col(part).alias("_heavy"), "_bk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    if before.count() <= SENT:
        before = F.broadcast(before)
    dealt = (packed.join(F.broadcast(heavy), is_heavy, "left").withColumn("_slice", F.when(F.col("_is"), bucket)).drop("_heavy", "_is")
             .repartitionByRange(part, F.desc("_slice")).withColumn("_r", row.over(Window.partitionBy(part, "_slice").orderBy(*order)))
             .join(before, is_heavy & F.col("_slice").eqNullSafe(F.col("_bk")), "left"))
    return dealt.select(*rest, (F.coalesce("_before", F.lit(0)) + F.col("_r")).cast("int").alias(name), "_slice")


def range_rank(df: DataFrame, part: list[str], order: list, name: str) -> DataFrame:
    """Exact ``row_number`` over ``part`` (may be empty) ordered by ``order``, for values of any kind.

    One sort over ranges that Spark samples from the data: a row's number is the number of rows in earlier
    ranges plus its place in its own, less the rows before its ``part``. No window sees rows, and rows that
    share a part, or a prefix of the order, spread over as many ranges as they need; only rows that agree in
    part and order stay together. The sorted rows are written once, as another sample would cut other ranges.
    Nulls come first and are values like any other.
    """
    placed = materialize(df.orderBy(*part, *order).withColumn("_m", F.monotonically_increasing_id()))
    at = F.shiftright("_m", 33)
    # one row per range, at most as many as there are shuffle partitions
    ranges = placed.groupBy(at.alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    before = ranges.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    numbered = (placed.withColumn("_range", at).join(F.broadcast(before), "_range")
                .withColumn("_all", F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1))
    if not part:
        return numbered.select(*df.columns, F.col("_all").alias(name))
    first = numbered.groupBy(*[F.col(p).alias(f"_k{i}") for i, p in enumerate(part)]).agg(F.min("_all").alias("_first"))
    on = F.lit(True)
    for i, p in enumerate(part):
        on = on & F.col(p).eqNullSafe(F.col(f"_k{i}"))
    return numbered.join(first, on).select(*df.columns, (F.col("_all") - F.col("_first") + 1).cast("int").alias(name))


def minute_bucket(col) -> Column:
    """Minute of a wall-clock timestamp as a sortable value; independent of the session time zone."""
    c = F.col(col) if isinstance(col, str) else col
    return F.date_trunc("minute", c.cast("timestamp_ntz"))


def _running(xs: str, enter: Column, apply: Callable, state: str) -> Column:
    """The states that enter each element of ``xs``, from ``enter`` on."""
    none = F.expr(f"cast(array() as array<{state}>)")
    init = F.struct(enter.alias("e"), none.alias("out"))
    return F.aggregate(xs, init, lambda a, x: F.struct(apply(a.getField("e"), x).alias("e"),
                                                      F.concat(a.getField("out"), F.array(a.getField("e"))).alias("out"))) \
        .getField("out")


class Replay:
    """Events of ``key`` in ``order`` as blocks of at most ``BLOCK``.

    ``identity`` is the function that changes nothing (an array with one result
    per state), ``step(state, event)`` applies an event, ``then(state, fn)`` a function, and
    ``counted(event)`` says which events ``final`` counts.
    """

    def __init__(self, events: DataFrame, key: str, order: list[str], bucket: Column, fields: list[str],
                 identity: Column, step: Callable, then: Callable, counted: Callable = lambda x: F.lit(True)):
        self.key, self.identity, self.step, self.then = key, identity, step, then
        numbered = exact_rank(events, key, order, bucket, "_i")
        self.blocks = (numbered.withColumn("_blk", F.expr(f"(_i - 1) div {BLOCK}"))
                       .groupBy(key, "_blk").agg(F.array_sort(F.collect_list(F.struct("_i", *fields))).alias("xs"))
                       .withColumn("fn", F.aggregate("xs", identity, lambda f, x: F.transform(f, lambda e: step(e, x))))
                       .withColumn("n", F.size(F.filter("xs", counted)).cast("bigint")))

    def _compose(self, rows: str) -> Column:
        return F.aggregate(rows, self.identity,
                           lambda f, x: F.transform(f, lambda e: self.then(e, x.getField("fn"))))

    def sections(self) -> DataFrame:
        return (self.blocks.withColumn("_sec", F.expr(f"_blk div {BLOCK}"))
                .groupBy(self.key, "_sec").agg(F.array_sort(F.collect_list(F.struct("_blk", "fn"))).alias("bs"),
                                             F.sum("n").alias("n"))
                .withColumn("fn", self._compose("bs")))

    def per_key(self, sections: DataFrame) -> DataFrame:
        return sections.groupBy(self.key).agg(F.array_sort(F.collect_list(F.struct("_sec", "fn"))).alias("ss"),
                                              F.sum("n").alias("n"))

    def final(self, start: Column) -> DataFrame:
        """(key, state, n): the state after all events and the events counted; ``start`` is the same for all keys."""
        return self.per_key(self.sections()).select(
            self.key, F.aggregate("ss", start, lambda e, s: self.then(e, s.getField("fn"))).alias("state"), "n")

    def states(self, state: str, start: Column, starts: DataFrame | None = None) -> DataFrame:
        """(key, x, enter): every event (struct of its fields) and the state before it.

        ``state`` is the state's SQL type; ``start`` a column over the key and the columns of ``starts``.
        """
        def then(e, x):
            return self.then(e, x.getField("fn"))

        sections = self.sections()
        keys = self.per_key(sections)
        if starts is not None:
            keys = keys.join(starts, self.key)
        into = keys.select(self.key, F.explode(F.arrays_zip(
            F.transform("ss", lambda s: s.getField("_sec")).alias("_sec"),
            _running("ss", start, then, state).alias("enter"))).alias("z")).select(self.key, "z._sec", "z.enter")
        into = (sections.select(self.key, "_sec", "bs").join(into, [self.key, "_sec"])
                .select(self.key, F.explode(F.arrays_zip(
                    F.transform("bs", lambda b: b.getField("_blk")).alias("_blk"),
                    _running("bs", F.col("enter"), then, state).alias("enter"))).alias("z"))
                .select(self.key, "z._blk", "z.enter"))
        return (self.blocks.select(self.key, "_blk", "xs").join(into, [self.key, "_blk"])
                .select(self.key, F.explode(F.arrays_zip(
                    F.col("xs").alias("x"), _running("xs", F.col("enter"), self.step, state).alias("enter"))).alias("z"))
                .select(self.key, "z.x", "z.enter"))
