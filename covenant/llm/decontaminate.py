"""Operator 5: benchmark decontamination by template canonicalisation.

In texts and benchmark items, numbers, units after numbers, and names
(capitalised words within a sentence) become typed placeholders; other words
are lower-cased. That is one form; in a second one, capitalised words at the start
of a text, line or sentence are names as well, and names that follow each other
are one slot with the value of the first. In both forms, the windows of template
words at every position of an item are hash-joined with all windows of the
texts. At the first window of each run of hits the whole item is laid along the
text: equal template words count, and the slots must agree, that is, equal values
in the item stand at equal values in the text and the other way round; each slot
value that breaks this counts as a mismatch. An item's share is that of its words
that match, in the better form at the best place. So a question asked anew with
other names, of one word or several, and other numbers is found, too.

A window has the least words that count as a share of the item, but not fewer
than ``LEAST_WORDS`` and not more than ``WINDOW``: any run of so many words is found.

All of it is DataFrame operations. Items are broadcast in blocks of at most
``BLOCK_WORDS`` words, however many blocks that takes; a hit carries
along the words at its place within the same stage, so texts are never shuffled.

Defined cases: null and empty texts hold no item; items of fewer than
``LEAST_WORDS`` words match nothing, as a few common words are no evidence,
nor do runs of fewer words; rows are judged one by one, so repeated rows and ids get the same answer each; extra columns are
kept by ``clean`` and ignored by ``contamination``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.llm.common import stored

WINDOW, LEAST_WORDS, LEAST_SHARE = 8, 5, 0.4
BLOCK_WORDS = 200_000
NAME, NUMBER, UNIT, START = "\ue001", "\ue002", "\ue003", "\ue004"
#: Words and signs that count as a unit when they follow a number.
UNITS = ("km|m|cm|mm|mi|miles?|ft|feet|inch(?:es)?|kg|g|mg|lbs?|pounds?|oz|tons?|l|ml|liters?|litres?|gallons?|"
         "s|sec(?:onds?)?|min(?:utes?)?|h|hrs?|hours?|days?|weeks?|months?|years?|%|percent|dollars?|euros?|cents?|usd|eur|€|\\$")
_NAME = r"\p{Lu}(?<=[\p{L}\p{N},]\x20\p{Lu})(?=\p{L}*\p{Ll})[\p{L}\p{M}]+"
_NUMBER = rf"\p{{Nd}}(?<![\p{{L}}\p{{N}}]\p{{Nd}})\p{{Nd}}*(?:[.,]\p{{Nd}}+)*(?=(?:{UNITS})?(?![\p{{L}}\p{{N}}]))"
_START = rf"\p{{Lu}}(?<![\p{{L}}\p{{M}}\p{{N}}{NAME}]\p{{Lu}})(?=\p{{L}}*\p{{Ll}})[\p{{L}}\p{{M}}]+"
_WORD = rf"{NUMBER}[\p{{Nd}}.,]+|{UNIT}\S+|[\p{{L}}\p{{M}}\p{{N}}{NAME}{START}]+"


def words(text: Column) -> Column:
    """Lower-cased words of a text; slot values, and capitalised words elsewhere, carry the mark of their type in front."""
    t = F.regexp_replace(text, _NAME, NAME + "$0")
    t = F.regexp_replace(t, _START, START + "$0")
    t = F.regexp_replace(t, rf"(?i){_NUMBER}", f" {NUMBER}$0 ")
    t = F.regexp_replace(t, rf"(?i)({NUMBER}[\p{{Nd}}.,]+ ) ?({UNITS})(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2 ")
    return F.regexp_extract_all(F.lower(t), F.lit(_WORD), 0)


def _kind(word: str) -> str:
    """SQL for the template word: the mark of a slot, or the word itself."""
    return f"if({word} < '{NAME}', {word}, if(substr({word}, 1, 1) in ('{NAME}', '{NUMBER}', '{UNIT}'), substr({word}, 1, 1), {word}))"


def _plain(word: str) -> str:
    """SQL for a word in the first form: a word that starts a sentence is no name."""
    return f"if({word} < '{NAME}' or substr({word}, 1, 1) != '{START}', {word}, substr({word}, 2))"


def _named(word: str) -> str:
    """SQL for a word in the second form: it is one."""
    return f"if({word} < '{NAME}' or substr({word}, 1, 1) != '{START}', {word}, concat('{NAME}', substr({word}, 2)))"


def _one_slot(words_: str) -> Column:
    """Words without those names that follow a name."""
    name = f"({{0}} >= '{NAME}' and substr({{0}}, 1, 1) in ('{NAME}', '{START}'))"
    return F.expr(f"filter({words_}, (v, i) -> not ({name.format('v')} and i > 0 and {name.format(f'get({words_}, i - 1)')}))")


def _hashes(words_: str, form) -> Column:
    """Hashes of the template words."""
    return F.expr(f"transform(transform({words_}, w -> {form('w')}), w -> xxhash64({_kind('w')}))")


def _with_windows(df: DataFrame, name: str, sizes: list[int]) -> DataFrame:
    """``df`` with ``h``: hashes of the windows of each size of the array ``name``, by position, as many as it has
    elements (the last ones of each size are of no window); each from those of its two parts."""
    def over(width: int) -> Column:
        nonlocal df
        if width == 1:
            return F.col(name)
        if f"__{width}" not in df.columns:
            first = 1 << (width - 1).bit_length() - 1
            parts = over(first), over(width - first)
            rest = F.slice(parts[1], F.lit(first + 1), F.size(parts[1]))
            df = df.withColumn(f"__{width}", F.zip_with(parts[0], rest, lambda x, y: F.xxhash64(x, y)))
        return F.col(f"__{width}")

    made = [over(w) for w in sizes]
    return df.withColumn("h", F.concat(*made)).drop(*(f"__{w}" for w in range(2, max(sizes) + 1)))


def item_table(benchmark: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """key, item_id, second (which form), item (words), their number n, window size; items too short to tell are left out."""
    raw = benchmark.select("item_id", words(F.coalesce("text", F.lit(""))).alias("w"))
    forms = [raw.select("item_id", F.lit(False).alias("second"), F.expr(f"transform(w, w -> {_plain('w')})").alias("item")),
             raw.withColumn("c", _one_slot("w"))
             .select("item_id", F.lit(True).alias("second"), F.expr(f"transform(c, w -> {_named('w')})").alias("item"))]
    return (forms[0].unionByName(forms[1]).withColumn("n", F.size("item")).where(F.col("n") >= LEAST_WORDS)
            .withColumn("width", F.least("n", F.lit(WINDOW), F.greatest(F.lit(LEAST_WORDS), F.ceil(F.col("n") * least_share).cast("int"))))
            .distinct().withColumn("key", F.xxhash64("item_id", "second", "item")))


def _anchors(items: DataFrame, sizes: list[int]) -> DataFrame:
    """(h, key, second, at, before) of the windows at every position; before: hash of the template word in front."""
    hashed = _with_windows(items.withColumn("t", _hashes("item", lambda w: w)), "t", sizes)
    width = F.get(F.array(*map(F.lit, sizes)), F.floor(F.col("pos") / F.col("n")).cast("int"))
    return (hashed.select("key", "second", "width", "n", "t", F.posexplode_outer("h").alias("pos", "h"))
            .withColumn("at", F.expr("pos % n")).where((F.col("width") == width) & (F.col("at") + F.col("width") <= F.col("n")))
            .select("h", "key", "second", "at", F.expr("get(t, at - 1)").alias("before")))


def _share() -> Column:
    """Share of the item's words that match those of ``laid``, the text's words at its place, less broken slots."""
    same = f"filter(zip_with(item, laid, (x, y) -> struct(x, y)), p -> {_kind('p.x')} = {_kind('p.y')})"
    slots = f"filter(same, p -> {_kind('p.x')} != p.x)"
    # how often one value stands at several others, in either direction
    broken = ("2 * size(array_distinct(slots)) - size(array_distinct(transform(slots, p -> p.x)))"
              " - size(array_distinct(transform(slots, p -> p.y)))")
    return F.expr(f"transform(array({same}), same -> transform(array({slots}), slots -> "
                  f"greatest(size(same) - ({broken}), 0))[0])[0] / n")


def hits(docs: DataFrame, benchmark: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, text_hash, item_id, share) of every text and item with a common window."""
    items = stored(item_table(benchmark, least_share), "items")
    totals = items.groupBy("width").agg(F.sum("n").alias("words")).collect()
    if not totals:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, text_hash bigint, item_id bigint, share double")
    sizes, blocks = sorted(r.width for r in totals), -(-sum(r.words for r in totals) // BLOCK_WORDS)
    text = (docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
            .withColumn("c", _one_slot("w"))
            # both forms in one array, apart by an element that no template word has
            .withColumn("t", F.concat(_hashes("w", _plain), F.array(F.lit(0).cast("long")), _hashes("c", _named))))
    # outer: for posexplode, the optimizer infers a filter on the array's size and pushes it down to the scan, with all
    # that makes the array written out in it again and again
    places = (_with_windows(text, "t", sizes)
              .select("doc_id", "text_hash", "w", "c", "t", F.posexplode_outer("h").alias("pos", "h")))
    out = None
    for block in range(blocks):
        part = items.where(F.pmod(F.col("key"), F.lit(blocks)) == block)
        # equal words in front: the window before this one has a hit at the same place
        first = places.join(F.broadcast(_anchors(part, sizes)), "h").withColumn("pos", F.expr("pos % size(t)")).where(
            "second = (pos > size(w)) and not (before is not null and before <=> get(t, pos - 1))")
        laid = (f"if(second, transform(sequence(0, n - 1), i -> {_named('get(c, pos - size(w) - 1 - at + i)')}),"
                f" transform(sequence(0, n - 1), i -> {_plain('get(w, pos - at + i)')}))")
        found = (first.join(F.broadcast(part.select("key", "item_id", "item", "n")), "key")
                 .select("doc_id", "text_hash", "item_id", "item", "n", F.expr(laid).alias("laid"))
                 .select("doc_id", "text_hash", "item_id", _share().alias("share"))
                 .groupBy("doc_id", "text_hash", "item_id").agg(F.max("share").alias("share")))
        out = found if out is None else out.unionByName(found)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """Per row of ``docs``: doc_id, items (ids found, ascending), best_share, contaminated."""
    per_text = (hits(docs, benchmark, least_share).where(F.col("share") >= least_share)
                .groupBy("doc_id", "text_hash")
                .agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("share").alias("best_share")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    joined = rows.alias("r").join(per_text.alias("p"), F.expr("r.doc_id <=> p.doc_id and r.text_hash = p.text_hash"), "left")
    return joined.select("r.doc_id", F.coalesce("p.items", F.expr("cast(array() as array<bigint>)")).alias("items"),
                         F.coalesce("p.best_share", F.lit(0.0)).alias("best_share"),
                         F.col("p.items").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    bad = hits(docs, benchmark, least_share).where(F.col("share") >= least_share).select("doc_id", "text_hash").distinct()
    return docs.alias("d").join(bad.alias("b"), F.expr("d.doc_id <=> b.doc_id and xxhash64(d.text) = b.text_hash"), "left_anti")
