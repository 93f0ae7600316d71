"""Contract-risk build: QA rows -> one risk row per contract.

Covers P1–P3, A1–A9, J1–J3 of SURVEY §2. The reference builds a wide
pivot, sums ten columns, runs a per-group Python loop for the text and joins
the two. Here score and text come out of one aggregation keyed by title.

Scale notes
- The 20-word cut (F1) runs before any shuffle, so only short snippets move.
- The large ``context`` column is never selected on this path; Parquet
  column pruning keeps it out of the scan.
- A title may hold a large share of all rows. The text is therefore built in
  two phases: first per (title, row_ord block) — bounded lists, sorted
  locally — then the per-block strings are joined in block order. Each
  phase's aggregate is partial/final, so map-side combine happens before the
  shuffle, and no task ever sorts one unbounded list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant import schemas as S
from covenant.functions import text as X
from covenant.session import materialize

# Rows per ordered block in the two-phase text build.
TEXT_BLOCK_ROWS = 4096


def flag_rows(qa: DataFrame) -> DataFrame:
    """P1 + P2 + F1: title, row_ord, has_clause, clause, snippet (first answer, 20 words).

    Rows with a null title are dropped, as the reference's group operations do.
    """
    return qa.where(F.col("title").isNotNull()).select(
        "title",
        "row_ord",
        X.has_clause("answers").alias("has_clause"),
        X.clause_name("question").alias("clause"),
        X.first_words(F.try_element_at(F.col("answers.text"), F.lit(1))).alias("snippet"),
    )


def risk_clause_filter(df: DataFrame, col: str = "clause") -> DataFrame:
    """Keep the ten risk clauses (applied before any shuffle)."""
    return df.where(F.col(col).isin(S.RISK_CLAUSES))


def contract_risk(qa: DataFrame, block_rows: int = TEXT_BLOCK_ROWS) -> DataFrame:
    """A3 + A4 + J1 + F2: title, risk_score, risk_text, risk_label.

    Contracts with no risk clause keep score 0; contracts with no answered row
    get text ''. Score counts distinct risk clauses; the text keeps every
    answered row (duplicates included) in row order.
    """
    f = flag_rows(qa)
    risk_hit = F.when(F.col("has_clause") & F.col("clause").isin(S.RISK_CLAUSES), F.col("clause"))
    # Phase 1: bounded blocks of rows; map-side partial aggregation first.
    blocks = (f.groupBy("title", F.floor(F.col("row_ord") / block_rows).alias("blk"))
              .agg(F.array_sort(F.collect_list(F.when(F.col("has_clause"),
                                                      F.struct("row_ord", "snippet")))).alias("parts"),
                   F.collect_set(risk_hit).alias("hits")))
    blocks = blocks.select(
        "title", "blk", "hits",
        F.when(F.size("parts") > 0,
               F.array_join(F.transform("parts", lambda p: p.getField("snippet")), " ")).alias("block_text"),
    )
    # Phase 2: one row per title; at most ceil(rows/block_rows) block strings
    # and at most ten clause names per title.
    per_title = (blocks.groupBy("title")
                 .agg(F.array_sort(F.collect_list(F.when(F.col("block_text").isNotNull(),
                                                         F.struct("blk", "block_text")))).alias("blocks"),
                      F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits")))
    score = F.size("hits").cast("int")
    text = F.coalesce(F.array_join(F.transform("blocks", lambda b: b.getField("block_text")), " "), F.lit(""))
    return per_title.select(
        "title",
        score.alias("risk_score"),
        text.alias("risk_text"),
        X.risk_label(score).alias("risk_label"),
    )


def _first_per_clause(df: DataFrame, col: str) -> DataFrame:
    """Keep, per clause, the entry with the smallest row_ord (array sorted first)."""
    df = df.withColumn(col, F.array_sort(col))
    return df.withColumn(col, F.filter(col, lambda x, i: (i == 0) | (
        F.element_at(F.col(col), i).getField("clause") != x.getField("clause"))))


def contract_risk_with_firsts(qa: DataFrame, block_rows: int = TEXT_BLOCK_ROWS) -> DataFrame:
    """``contract_risk`` plus ``firsts``: per clause the snippet of its first answered row.

    Same single pass as the flagship: each (title, block) keeps at most one
    entry per clause (41 here), and each title at most one per clause after
    merging its blocks. Used where both the risk row and the clause snippets
    are needed, so the QA rows are exploded and shuffled once.
    """
    f = flag_rows(qa)
    risk_hit = F.when(F.col("has_clause") & F.col("clause").isin(S.RISK_CLAUSES), F.col("clause"))
    answered = F.when(F.col("has_clause"), F.struct("clause", "row_ord", "snippet"))
    blocks = (f.groupBy("title", F.floor(F.col("row_ord") / block_rows).alias("blk"))
              .agg(F.array_sort(F.collect_list(F.when(F.col("has_clause"),
                                                      F.struct("row_ord", "snippet")))).alias("parts"),
                   F.collect_set(risk_hit).alias("hits"),
                   F.collect_list(answered).alias("fa")))
    blocks = _first_per_clause(blocks, "fa").select(
        "title", "blk", "hits", "fa",
        F.when(F.size("parts") > 0,
               F.array_join(F.transform("parts", lambda p: p.getField("snippet")), " ")).alias("block_text"))
    per_title = (blocks.groupBy("title")
                 .agg(F.array_sort(F.collect_list(F.when(F.col("block_text").isNotNull(),
                                                         F.struct("blk", "block_text")))).alias("blocks"),
                      F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
                      F.flatten(F.collect_list("fa")).alias("fa")))
    per_title = _first_per_clause(per_title, "fa")
    score = F.size("hits").cast("int")
    text = F.coalesce(F.array_join(F.transform("blocks", lambda b: b.getField("block_text")), " "), F.lit(""))
    return per_title.select(
        "title", score.alias("risk_score"), text.alias("risk_text"), X.risk_label(score).alias("risk_label"),
        F.transform("fa", lambda x: F.struct(x.getField("clause").alias("clause"),
                                             x.getField("snippet").alias("snippet"))).alias("firsts"))


def score_join_text(qa: DataFrame) -> DataFrame:
    """Title, risk_score, risk_text (one pass; no join needed)."""
    return contract_risk(qa).select("title", "risk_score", "risk_text")


def clause_matrix(qa: DataFrame, clause_values: list[str] | None = None) -> DataFrame:
    """A1: title x clause boolean max, missing -> False (wide).

    Passing ``clause_values`` avoids the extra job Spark runs to find the
    pivot values. Column names are clause names (P2 renaming applied).
    """
    f = flag_rows(qa).select("title", "clause", "has_clause")
    g = f.groupBy("title")
    p = g.pivot("clause", clause_values) if clause_values is not None else g.pivot("clause")
    wide = p.agg(F.max("has_clause"))
    cols = [c for c in wide.columns if c != "title"]
    return wide.fillna(False, subset=cols)


def matrix_shape(qa: DataFrame) -> DataFrame:
    """A2: number of contracts and clause columns of the matrix."""
    f = flag_rows(qa).select("title", "clause")
    return f.agg(F.count_distinct("title").alias("n_contracts"),
                 F.count_distinct("clause").alias("n_clauses"))


def first_context(qa: DataFrame) -> DataFrame:
    """A5: first non-null context per title in row order.

    Rows of a title repeat its context, so they are first folded by a hash aggregate whose
    key is the context; only its few rows are sorted for ``min_by``.
    """
    each = (qa.where(F.col("title").isNotNull() & F.col("context").isNotNull())
            .groupBy("title", "context").agg(F.min("row_ord").alias("row_ord")))
    return each.groupBy("title").agg(F.min_by("context", "row_ord").alias("context"))


def score_join_context(qa: DataFrame) -> DataFrame:
    """Score left-joined with the first context."""
    return contract_risk(qa).select("title", "risk_score").join(first_context(qa), "title", "left")


def first_answers(qa: DataFrame, risk_only: bool = False) -> DataFrame:
    """Per (title, clause): snippet of the first answered row in row order (S11 input)."""
    f = flag_rows(qa).where(F.col("has_clause"))
    if risk_only:
        f = risk_clause_filter(f)
    return (f.groupBy("title", "clause")
            .agg(F.min_by("snippet", "row_ord").alias("snippet")))


def score_distribution(risk: DataFrame) -> DataFrame:
    """Contracts per risk score."""
    return risk.groupBy("risk_score").agg(F.count(F.lit(1)).alias("n")).orderBy("risk_score")


def label_distribution(risk: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Contracts per label (optionally per split too)."""
    keys = (by or []) + ["risk_label"]
    return risk.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


#: Bits of a double that each pass of the selection tells apart, from the top.
RADIX_SHIFTS = (51, 38, 25, 12, 0)


def values_at(values: DataFrame, ranks: list[int]) -> dict[int, float]:
    """The values at the given ranks (from 0) of (x, n, k): a value, how often it occurs, and its bits as a
    number of the same order.

    A pass counts the values whose leading bits a wanted rank shares by their next 13 bits, so a pass returns
    at most 8,192 counts for each open rank, whatever the values are, and five passes end it. A rank is
    settled as soon as its part holds one value only.
    """
    found: dict[int, float] = {}
    at: dict[int, tuple[int, int | None]] = {r: (0, None) for r in ranks}      # rows before the part, its leading bits
    width = 0
    for shift in RADIX_SHIFTS:
        wanted = sorted({p for _, p in at.values() if p is not None})
        rows = values.where(F.shiftright("k", shift + width).isin(wanted)) if wanted else values
        parts = sorted(tuple(r) for r in rows.groupBy(F.shiftright("k", shift).alias("p"))
                       .agg(F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect())
        for r, (before, prefix) in list(at.items()):
            for p, n, lo, hi in parts:
                if prefix is not None and p >> width != prefix:
                    continue
                if r < before + n:
                    at[r] = (before, p)
                    if lo == hi or shift == 0 or lo != lo:      # NaN has one pattern of bits
                        found[r] = lo
                        del at[r]
                    break
                before += n
        if not at:
            break
        width = shift - RADIX_SHIFTS[min(RADIX_SHIFTS.index(shift) + 1, len(RADIX_SHIFTS) - 1)]
    return found


def describe(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles (linear between ranks), max of one column.

    Rows are folded to counts by value; quartiles come from counts by leading bits (``values_at``), so neither
    skewed nor widely spread values gather in one task. Nulls are left out, NaN counts as the largest value.
    """
    bits = F.expr("cast(java_method('java.lang.Double', 'doubleToLongBits', x) as bigint)")
    values = materialize(
        df.select(F.col(col).cast("double").alias("x")).where("x is not null").groupBy("x").agg(F.count("*").alias("n"))
        .withColumn("bits", bits)
        .select("x", "n", F.when(F.col("bits") < 0, F.col("bits").bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(F.col("bits")).alias("k")))
    t = values.agg(F.sum("n").alias("n"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"),
                   F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    total = t.n or 0
    schema = "column string, count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double"
    if not total:
        return df.sparkSession.createDataFrame([(col, 0, *[None] * 7)], schema)
    places = [(total - 1) * q for q in (0.25, 0.5, 0.75)]
    x = values_at(values, sorted({r for h in places for r in (int(h), min(int(h) + 1, total - 1))}))
    quartiles = [x[int(h)] + (x[min(int(h) + 1, total - 1)] - x[int(h)]) * (h - int(h)) for h in places]
    squares = values.agg(F.sum(F.col("n") * (F.col("x") - F.lit(t.mean)) ** 2).alias("s")).first().s
    std = (squares / (total - 1)) ** 0.5 if total > 1 else None
    return df.sparkSession.createDataFrame([(col, total, t.mean, std, t.lo, *quartiles, t.hi)], schema)


def token_lengths(risk: DataFrame) -> DataFrame:
    """Token count (F17, with special tokens) per contract's risk text."""
    return risk.select("title", X.token_count("risk_text").alias("n_tokens"))


def over_budget_count(risk: DataFrame, max_len: int = S.MAX_TOKENS) -> DataFrame:
    """Contracts whose risk text exceeds the token budget."""
    t = token_lengths(risk)
    return t.agg(F.count_if(F.col("n_tokens") > max_len).alias("n_over_budget"),
                 F.count(F.lit(1)).alias("n_contracts"))
