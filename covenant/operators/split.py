"""Stratified split, class-balanced sample, export records.

Exact per-label quotas without ranking a whole label in one task
-----------------------------------------------------------------
A label can hold most of the contracts, so ``row_number`` over
``partitionBy(label)`` would sort that label in a single task. Instead each row
gets a seeded key ``md5(seed|title)``; a histogram of the key's hex prefix per
label (at most 16^4 buckets per label, a small aggregate) gives, through a
window over the histogram, the bucket where each label's quota is reached.
Rows below that bucket are in, rows above are out, and only the boundary
bucket (about rows/65536 of a label) is ranked exactly. The per-label boundary
table has one row per label, so broadcasting it is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covenant import schemas as S
from covenant.functions import text as X
from covenant.session import materialize

BUCKET_HEX = 4  # 65,536 buckets per group


def seeded_key(seed: int, col: str = "title") -> F.Column:
    """md5 of ``seed|title`` (hex), the deterministic shuffle order."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(col)))


def smallest_per_group(df: DataFrame, group: str, key: str, tie: str, quotas,
                       flag: str = "picked") -> DataFrame:
    """Flag, per ``group``, the ``quota`` rows with the smallest (key, tie).

    ``quotas`` is a DataFrame (group, quota) with one row per group, or a
    function from the per-group counts (group, n) to such a DataFrame; the
    counts then come from the same histogram pass. Exact; no task ranks more
    than one histogram bucket of one group. ``df`` is scanned more than once:
    pass a materialised frame.
    """
    b = df.withColumn("_b", F.substring(F.col(key), 1, BUCKET_HEX))
    hist = b.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    if callable(quotas):
        quotas = quotas(hist.groupBy(group).agg(F.sum("_n").alias("n")))
    w = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy(group)
    # A quota above the group size takes the whole group.
    hist = (hist.withColumn("_cum", F.sum("_n").over(w)).withColumn("_tot", F.sum("_n").over(total))
            .join(quotas.select(group, "quota"), group)
            .withColumn("quota", F.least(F.col("quota").cast("long"), F.col("_tot"))))
    boundary = hist.where((F.col("_cum") - F.col("_n") < F.col("quota")) & (F.col("_cum") >= F.col("quota"))) \
        .select(group, F.col("_b").alias("_bb"), (F.col("quota") - (F.col("_cum") - F.col("_n"))).alias("_need"))
    # One row per group (bounded by the number of groups): computed once,
    # then broadcast to both branches below.
    boundary = materialize(boundary)
    j = b.join(F.broadcast(boundary), group, "left")
    # Rows outside the boundary bucket are decided by a narrow broadcast join;
    # only the boundary bucket (about 1/65536 of a group) is shuffled and ranked.
    rest = j.where(F.col("_bb").isNull() | (F.col("_b") != F.col("_bb"))) \
        .withColumn(flag, F.coalesce(F.col("_b") < F.col("_bb"), F.lit(False)))
    at = j.where(F.col("_b") == F.col("_bb"))
    rank = F.row_number().over(Window.partitionBy(group, "_b").orderBy(key, tie))
    at = at.withColumn(flag, rank <= F.col("_need"))
    return rest.unionByName(at).drop("_b", "_bb", "_need")


def largest_remainder_quotas(counts: DataFrame, test_fraction: float = 0.2, label: str = "risk_label",
                             n: str = "n") -> DataFrame:
    """Exact test quotas per label: ceil(N*f) test rows shared out by largest remainder.

    Integer arithmetic only; remainder ties go to labels in Low, Medium, High
    order. ``counts`` has one row per label, so the windows here are tiny.
    """
    num, den = _fraction(test_fraction)
    total = Window.partitionBy(F.lit(1))
    c = counts.select(F.col(label).alias("risk_label"), F.col(n).cast("long").alias("n_label"))
    c = c.withColumn("n_all", F.sum("n_label").over(total))
    c = c.withColumn("n_test", F.expr(f"(n_all * {num} + {den - 1}) div {den}"))
    c = c.withColumn("base", F.expr("(n_label * n_test) div n_all"))
    c = c.withColumn("rem", F.col("n_label") * F.col("n_test") - F.col("base") * F.col("n_all"))
    c = c.withColumn("left", F.col("n_test") - F.sum("base").over(total))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("rem"), X.label_id("risk_label"))
    c = c.withColumn("rk", F.row_number().over(order))
    return c.select(F.col("risk_label").alias(label), "n_label",
                    (F.col("base") + F.when(F.col("rk") <= F.col("left"), 1).otherwise(0)).alias("quota"))


def split_quotas(risk: DataFrame, test_fraction: float = 0.2) -> DataFrame:
    """W4 quotas from the label counts of ``risk``."""
    counts = risk.groupBy("risk_label").agg(F.count(F.lit(1)).alias("n"))
    return largest_remainder_quotas(counts, test_fraction)


def _fraction(f: float) -> tuple[int, int]:
    from fractions import Fraction
    fr = Fraction(str(f))
    return fr.numerator, fr.denominator


def stratified_split(risk: DataFrame, test_fraction: float = 0.2, seed: int = S.SPLIT_SEED) -> DataFrame:
    """Every contract with ``split`` = 'train' or 'test', exact per-label quotas.

    Label counts, quotas and the boundary all come from one histogram pass.
    """
    keyed = risk.withColumn("_key", seeded_key(seed))
    flagged = smallest_per_group(keyed, "risk_label", "_key", "title",
                                 lambda counts: largest_remainder_quotas(counts, test_fraction), flag="_test")
    return flagged.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test", "_key")


def class_balanced_sample(df: DataFrame, per_class: int, seed: int = S.SAMPLE_SEED,
                          label: str = "risk_label") -> DataFrame:
    """W3 + U1: min(per_class, size) rows per label, seeded; one pass for all labels."""
    keyed = df.withColumn("_key", seeded_key(seed))
    flagged = smallest_per_group(keyed, label, "_key", "title",
                                 lambda counts: counts.select(label, F.least("n", F.lit(per_class)).alias("quota")),
                                 flag="_pick")
    return flagged.where("_pick").drop("_pick", "_key")


def split_gate(split: DataFrame, expected: DataFrame) -> DataFrame:
    """Test-label counts against a given table (risk_label, quota); ``ok`` per label."""
    actual = split.where(F.col("split") == "test").groupBy("risk_label").agg(F.count(F.lit(1)).alias("actual"))
    e = expected.select("risk_label", F.col("quota").alias("expected"))
    j = e.join(actual, "risk_label", "full_outer")
    return j.select("risk_label", F.coalesce("expected", F.lit(0)).alias("expected"),
                    F.coalesce("actual", F.lit(0)).alias("actual"),
                    (F.coalesce("expected", F.lit(0)) == F.coalesce("actual", F.lit(0))).alias("ok"))


def gated_split(split: DataFrame, expected: dict[str, int]) -> DataFrame:
    """A17 in job mode: ``split`` itself, or an error that names the labels whose counts differ."""
    table = split.sparkSession.createDataFrame(list(expected.items()), "risk_label string, quota long")
    bad = split_gate(split, table).where(~F.col("ok")).collect()          # at most one row per label
    if bad:
        raise ValueError("test split differs from the expected one: " + ", ".join(
            f"{r.risk_label} {r.actual} instead of {r.expected}" for r in sorted(bad, key=str)))
    return split


def clause_gate(risk: DataFrame, first_risk_answers: DataFrame) -> DataFrame:
    """Exported clause count per contract against its risk score."""
    n = first_risk_answers.groupBy("title").agg(F.count(F.lit(1)).alias("n_clauses"))
    j = risk.select("title", "risk_score").join(n, "title", "left")
    nc = F.coalesce(F.col("n_clauses"), F.lit(0)).cast("int")
    return j.select("title", "risk_score", nc.alias("n_clauses"), (nc == F.col("risk_score")).alias("ok"))


def split_disjoint(split: DataFrame, risk: DataFrame) -> DataFrame:
    """Train and test partition the input (overlap and missing are 0)."""
    train = split.where(F.col("split") == "train").select("title")
    test = split.where(F.col("split") == "test").select("title")
    overlap = train.intersect(test).select(F.count(F.lit(1)).alias("n_overlap"))
    missing = risk.select("title").exceptAll(train.unionByName(test)).select(F.count(F.lit(1)).alias("n_missing"))
    sizes = split.groupBy().agg(F.count_if(F.col("split") == "train").alias("n_train"),
                                F.count_if(F.col("split") == "test").alias("n_test"))
    return sizes.select("n_train", "n_test", overlap.scalar().alias("n_overlap"),
                        missing.scalar().alias("n_missing"))


SAFE_RUN = r"[^A-Za-z0-9._-]+"


def safe_base(col) -> F.Column:
    """W5 base: runs outside [A-Za-z0-9._-] -> '_', strip '._-', cut to 80, blank -> 'contract'."""
    c = F.regexp_replace(F.col(col) if isinstance(col, str) else col, SAFE_RUN, "_")
    c = F.regexp_replace(c, r"^[._-]+|[._-]+$", "")
    c = F.substring(c, 1, S.SAFE_ID_MAX)
    return F.when(c == "", F.lit("contract")).otherwise(c)


def settle(names: DataFrame) -> DataFrame:
    """(name, value) of (name, up, f0, f1): the value of a name is f0 or f1, as the value of ``up`` is 0 or 1, and
    f0 where ``up`` is no name itself.

    Pointer doubling: a round puts the function of ``up`` into that of the name and goes on to the ``up`` of
    that, so a chain of n names is settled in about log2(n) rounds.
    """
    known = names.select(F.col("name").alias("up"), F.lit(True).alias("_known"))
    t = materialize(names.join(known, "up", "left")
                    .select("name", F.when(F.col("_known"), F.col("up")).alias("up"), "f0", "f1"))
    while not t.where("up is not null").isEmpty():
        above = t.select(F.col("name").alias("up"), F.col("up").alias("_up"), F.col("f0").alias("_g0"), F.col("f1").alias("_g1"))

        def after(g: str, f: str):
            return F.when(F.col(g).isNull(), F.col(f)).when(F.col(g) == 1, F.col("f1")).otherwise(F.col("f0")).alias(f)

        t = materialize(t.join(above, "up", "left").select("name", F.col("_up").alias("up"), after("_g0", "f0"), after("_g1", "f1")))
    return t.select("name", F.col("f0").alias("value"))


def safe_ids(df: DataFrame, title: str, order: str) -> DataFrame:
    """Unique ids. In input order, a row gets its base, or the first of ``base_2``, ``base_3``, … that no
    earlier row has.

    The last ``_k`` of an id tells its base, so an id can be wanted twice only
    as another base's own name (titles ``a``, ``a``, ``a_2``). Repeats are
    numbered by an exact rank; for the few bases that look like another base
    with a number, the order of the two decides: the base's rows skip the number
    when the other name came first, and the other name counts as given away when
    they reached the number first. That depends on whether the base's own name
    was given away, so each base is decided for both cases and the chains of
    names are settled by pointer doubling.
    """
    from covenant.operators.replay import range_rank

    b = range_rank(df.withColumn("_base", safe_base(title)), ["_base"], [order], "_rn")
    bases = b.groupBy("_base").agg(F.min(order).alias("_first"))
    # contested names: base + "_" + number, where that base has rows
    named = bases.select(F.col("_base").alias("_name"), "_first",
                         F.regexp_extract("_base", r"^(.+)_([1-9][0-9]{0,8})$", 1).alias("_of"),
                         F.regexp_extract("_base", r"^(.+)_([1-9][0-9]{0,8})$", 2).alias("_k"))
    named = named.where("_of != ''").withColumn("_k", F.col("_k").cast("int")).where("_k > 1")
    contested = named.join(bases.select(F.col("_base").alias("_of")), "_of")
    places = Window.partitionBy("_of").orderBy("_k")
    contested = materialize(contested.withColumn("_i", F.row_number().over(places)))
    # the order of the rows that may reach a contested number: each one before may have been skipped
    reach = contested.select("_of", "_k", "_first", F.explode(
        F.sequence(F.greatest(F.col("_k") - F.col("_i") - 1, F.lit(1)), F.col("_k"))).alias("_rn"))
    at = b.select(F.col("_base").alias("_of"), "_rn", F.col(order).alias("_at"))
    reach = materialize(reach.join(at, ["_of", "_rn"], "left").groupBy("_of", "_k").agg(
        F.first("_first").alias("_first"),
        F.array_sort(F.collect_list(F.struct("_rn", "_at"))).alias("_rows")))
    lists = reach.groupBy("_of").agg(F.array_sort(F.collect_list(F.struct("_k", "_first", "_rows"))).alias("_c"))
    state = "struct<gone:int,skip:array<int>,lost:array<int>>"

    def decide(a, c):
        # the row that reaches number k, if there is one, comes before or after the first row of that name
        rank = c.getField("_k") - a.getField("gone")
        row = F.get(F.filter(c.getField("_rows"), lambda r: r.getField("_rn") == rank), 0).getField("_at")
        ours = F.coalesce(row < c.getField("_first"), F.lit(False))
        theirs = F.coalesce(row > c.getField("_first"), F.lit(False))
        return F.struct((a.getField("gone") + theirs.cast("int")).alias("gone"),
                        F.concat(a.getField("skip"), F.when(theirs, F.array(c.getField("_k"))).otherwise(F.array().cast("array<int>"))).alias("skip"),
                        F.concat(a.getField("lost"), F.when(ours, F.array(c.getField("_k"))).otherwise(F.array().cast("array<int>"))).alias("lost"))

    none = F.array().cast("array<int>")
    starts = [F.struct(F.lit(gone).alias("gone"), none.alias("skip"), none.alias("lost")).cast(state) for gone in (0, 1)]
    both = materialize(lists.select("_of", *[F.aggregate("_c", start, decide).alias(f"_d{n}") for n, start in enumerate(starts)]))
    # whether a name is lost, as a function of whether the base that wants it is lost itself
    names = contested.select("_of", "_k", F.lit(0).alias("f0"), F.lit(0).alias("f1"))
    for n in (0, 1):
        names = names.unionByName(both.select("_of", F.explode(f"_d{n}.lost").alias("_k"),
                                              F.lit(1 - n).alias("f0"), F.lit(n).alias("f1")))
    names = names.groupBy("_of", "_k").agg(F.max("f0").alias("f0"), F.max("f1").alias("f1"))
    lost = materialize(settle(names.select(F.concat_ws("_", "_of", "_k").alias("name"), F.col("_of").alias("up"), "f0", "f1"))
                       .where("value = 1").select(F.col("name").alias("_of")))
    decided = (both.join(lost.withColumn("_l", F.lit(1)), "_of", "left")
               .select("_of", F.when(F.col("_l") == 1, F.col("_d1")).otherwise(F.col("_d0")).alias("_d")))
    b = (b.join(decided.select(F.col("_of").alias("_base"), F.col("_d.skip").alias("_skip")), "_base", "left")
         .join(lost.select(F.col("_of").alias("_base"), F.lit(1).alias("_l")), "_base", "left"))
    k = F.aggregate(F.coalesce("_skip", none), F.col("_rn") + F.coalesce("_l", F.lit(0)),
                    lambda n, x: n + (x <= n).cast("int"))
    return (b.withColumn("_k", k)
            .withColumn("safe_id", F.when(F.col("_k") == 1, F.col("_base")).otherwise(F.concat_ws("_", "_base", "_k")))
            .select(*df.columns, "safe_id"))


def of_picked(df: DataFrame, picked: DataFrame) -> DataFrame:
    """Rows whose title is in the (small) sample, as an IN-subquery.

    Catalyst pushes the predicate through projections and the explode down
    to the scan before turning it into a broadcast semi join, so only the
    sampled documents are exploded.
    """
    return df.where(F.col("title").isin(picked.select("title")))


def picked_rows(qa_flags: DataFrame, picked: DataFrame) -> DataFrame:
    """All QA rows of the sampled contracts; one semi join, pushed to the scan."""
    return of_picked(qa_flags, picked)


def export_records(picked: DataFrame, qa: DataFrame, sampled: bool = True) -> DataFrame:
    """One export record per contract (score, label, clauses in fixed order, text).

    With a small sample the QA rows are restricted to it first, so first
    answers and contexts are computed for the sampled contracts only.
    """
    from covenant.operators.risk import first_answers, first_context

    sub = of_picked(qa, picked) if sampled else qa
    order = F.array_position(F.array(*[F.lit(c) for c in S.RISK_CLAUSES]), F.col("clause"))
    cl = (first_answers(sub, risk_only=True).groupBy("title")
          .agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "clause", "snippet"))).alias("cl")))
    rec = picked.join(cl, "title", "left").join(first_context(sub), "title", "left")
    clauses = F.coalesce(F.col("cl"), F.array().cast("array<struct<o:int,clause:string,snippet:string>>"))
    return rec.select(
        "title", "split", "risk_score", "risk_label",
        F.map_from_arrays(F.transform(clauses, lambda e: e.getField("clause")),
                          F.transform(clauses, lambda e: e.getField("snippet"))).alias("clauses"),
        F.col("risk_text").alias("model_input"),
        F.col("context").alias("text"),
    )
