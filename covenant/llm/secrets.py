"""Operator 10: secret scans with a trigram inverted index.

Each rule is a regular expression with optional conditions on its match. Its
Boolean trigram query comes from the expression itself (``trigrams``). The
index holds postings (trigram, text) for the trigrams that any rule asks for;
postings of a text are intersected per clause, and only candidate texts are
verified with the rule's expression. Rules without a mandatory trigram scan
every text. All of it is DataFrame operations: matches and the pieces between
them come from one pattern, and running sums of their lengths give positions
in code points.

A text is known by its id and 128 bits of hash, so repeated rows and null ids
are no special case.

Defined cases: a null or empty text has no span; repeated rows get the same
answer each; overlapping spans of different rules are all reported; when
spans are blanked out, overlapping ones are joined into one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covenant.llm.trigrams import clauses


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str                # in the common subset of Java's and Python's syntax
    least: int = 0              # least length of ``group``
    group: int = 0
    base: bool = False

    @cached_property
    def query(self) -> list[list[str]] | None:
        return clauses(self.pattern)


#: The three base kinds.
BASE = [
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16, 0, True),
    Rule("hex", r"[0-9a-f]{32,}", 32, 0, True),     # runs of 32 and more are the runs that are kept
]
#: A key from its first line to its END line, over at most 200 hyphens. Without one, over the lines of base64 that follow,
#: also with escaped line breaks, and the word of base64 letters on the next line, which may be the end of the key. Lines
#: parted by a space or indented by spaces are taken one by one, 200 at most: Java's expressions recurse there. RE2, which
#: DuckDB uses, takes nested repetitions up to a product of 1,000, hence 16 as 4 times 4.
_LINE = r"(?:[\x20\t]*[\r\n]+|\x20+|(?:\\[nr])+)[\x20\t]*"
_BASE64 = "A-Za-z0-9+/="
_PRIVATE_KEY = (r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
                r"(?:[^-]*(?:-[^-]+){0,200}-{5,}END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
                rf"|(?:{_LINE}(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset):[^\r\n\\]*){{0,6}}"
                rf"(?:{_LINE}{f'[{_BASE64}]{{4}}' * 3}[{_BASE64}]{{4,}}(?:[{_BASE64}\t\r\n\\]*[{_BASE64}])?){{1,200}}"
                rf"(?:{_LINE}[{_BASE64}]{{1,15}})?)?")
#: Formats of further credentials.
MORE = [
    Rule("private_key", _PRIVATE_KEY),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("basic_auth", r"[a-z]{3,8}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
]
RULES = BASE + MORE
_KEY = ["doc_id", "k1", "k2"]


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit("second")).alias("k2"), *columns)


def _same_text(a: str, b: str) -> Column:
    return F.expr(f"{a}.doc_id <=> {b}.doc_id and {a}.k1 = {b}.k1 and {a}.k2 = {b}.k2")


def postings(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The inverted index (gram, doc_id, k1, k2) for the trigrams that the rules ask for."""
    grams = sorted({g for r in rules for c in r.query or () for g in c})
    held = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("low"), g))
    return (_keyed(docs, F.lower("text").alias("low")).where("low is not null")
            .select(*_KEY, F.explode(held).alias("gram")))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, k1, k2, kinds): texts that hold all trigrams of a clause, and of which rules."""
    parts = [(r.kind, n, i, g) for r in rules for n, c in enumerate(r.query or ()) for i, g in enumerate(c)]
    sizes = {(r.kind, n): len(c) for r in rules for n, c in enumerate(r.query or ())}
    asked = index.sparkSession.createDataFrame([(*p, (1 << sizes[p[:2]]) - 1) for p in parts],
                                               "kind string, clause int, bit int, gram string, whole long")
    found = (index.join(F.broadcast(asked), "gram")          # as many rows as the rules have trigrams
             .groupBy(*_KEY, "kind", "clause", "whole")
             .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("have")).where("have = whole"))
    return found.groupBy(*_KEY).agg(F.collect_set("kind").alias("kinds"))


def _matches(rule: Rule) -> Column:
    """Array of (kind, i, gap, length, ok) of the rule's matches in ``text``; gap: characters since the last one."""
    p = F.lit(rule.pattern)
    hits = F.regexp_extract_all("text", p, 0)
    inner = F.regexp_extract_all("text", p, rule.group) if rule.group else hits
    parts = F.arrays_zip(F.split("text", rule.pattern, -1).alias("gap"), hits.alias("hit"), inner.alias("part"))
    found = F.filter(parts, lambda m: m.hit.isNotNull())         # without the piece after the last match
    return F.transform(found, lambda m, i: F.struct(
        F.lit(rule.kind).alias("kind"), i.alias("i"), F.length(m.gap).alias("gap"),
        F.length(m.hit).alias("length"), (F.length(m.part) >= rule.least).alias("ok")))


def find(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, k1, k2, kind, start, end) of every kept match, once for repeated rows; code points, end exclusive."""
    indexed = [r for r in rules if r.query is not None]
    texts = _keyed(docs, "text").where("text is not null and text != ''")
    if indexed:
        likely = candidates(postings(docs, indexed), indexed)
        texts = (texts.alias("t").join(likely.alias("c"), _same_text("t", "c"), "left")
                 .select("t.doc_id", "t.k1", "t.k2", "t.text", "c.kinds"))
    none = F.expr("cast(array() as array<struct<kind:string,i:int,gap:int,length:int,ok:boolean>>)")
    per_rule = []
    for r in rules:
        asked = F.col("text").rlike(r.pattern)
        if r.query is not None:                                  # verified in candidates only
            asked = F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)) & asked
        per_rule.append(F.when(asked, _matches(r)).otherwise(none))
    one = (texts.select(*_KEY, F.explode(F.concat(*per_rule)).alias("m"))
           .select(*_KEY, "m.kind", "m.i", "m.gap", "m.length", "m.ok")
           .groupBy(*_KEY, "kind", "i").agg(F.min("gap").alias("gap"), F.min("length").alias("length"), F.min("ok").alias("ok")))
    upto = Window.partitionBy(*_KEY, "kind").orderBy("i")
    return (one.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(upto)).where("ok")
            .select(*_KEY, "kind", (F.col("end") - F.col("length")).alias("start"), "end"))


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Per row of ``docs``: doc_id and spans of all kinds (array of start, rank, kind, end, by start
    and then in the order of the rules)."""
    rank = F.coalesce(*(F.when(F.col("kind") == r.kind, F.lit(i)) for i, r in enumerate(rules)))
    per = (find(docs, rules).withColumn("rank", rank).groupBy(*_KEY)
           .agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("spans")))
    rows = _keyed(docs)
    kind = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
    return (rows.alias("r").join(per.alias("s"), _same_text("r", "s"), "left")
            .select("r.doc_id", F.coalesce("s.spans", F.expr(f"cast(array() as {kind})")).alias("spans")))


def _joined(spans: DataFrame) -> DataFrame:
    """Spans of each text with overlapping and touching ones made one."""
    before = Window.partitionBy(*_KEY).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*_KEY).orderBy("start", "end")
    return (spans.withColumn("reach", F.max("end").over(before))
            .withColumn("run", F.count_if(F.col("reach").isNull() | (F.col("start") > F.col("reach"))).over(upto))
            .groupBy(*_KEY, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")))


def redact(docs: DataFrame, rules: list[Rule] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` in ``text`` (and ``n_chars``, where there is one, set anew)."""
    per = (_joined(find(docs, rules)).groupBy(*_KEY)
           .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cut")))
    # what lies before the first span, between spans, and after the last one
    pieces = F.expr("""transform(sequence(0, size(s.cut)), i -> substring(d.text,
        cast(if(i = 0, 0, s.cut[i - 1].end) + 1 as int),
        cast(if(i = size(s.cut), length(d.text), get(s.cut, i).start) - if(i = 0, 0, s.cut[i - 1].end) as int)))""")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({"__k1": F.xxhash64(text), "__k2": F.xxhash64(text, F.lit("second"))})
    same = F.expr("d.doc_id <=> s.doc_id and d.__k1 = s.k1 and d.__k2 = s.k2")
    hit = F.col("s.cut").isNotNull()
    new = {"text": F.when(hit, F.array_join(pieces, mark)).otherwise(F.col("d.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length(new["text"]).cast("long")).otherwise(F.col("d.n_chars"))
    return (keyed.alias("d").join(per.alias("s"), same, "left")
            .select(*(new[c].alias(c) if c in new else F.col(f"d.{c}") for c in docs.columns)))
