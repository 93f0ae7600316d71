"""subword tokens by greedy longest match over a vocabulary table.

Words (``functions.text.tokens``) are cut from the left: the longest piece of
the vocabulary that starts here is taken, pieces inside a word carry the prefix
``##``. A word that cannot be cut to its end, or has more than ``max_word``
characters, is one unknown token.

The work is two joins. Every different word is cut once: its substrings meet
the vocabulary in a hash join on the piece, the longest piece at each place is
kept, and one walk over the places gives the ids. Texts then meet the cuts of
their words. Texts are folded by hash first and words within a text next, so
copies and frequent words are not repeated in the shuffle; of a text only the
words that can reach the ``max_len`` ids keep their places.

Defined cases: a null text reads as an empty one; repeated keys get a row each;
of several ids for one piece the smallest counts; null or empty pieces are
ignored; an empty vocabulary makes every word unknown; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant import schemas as S
from covenant.functions import text as X

PREFIX = "##"
START, END, PAD, UNKNOWN = 101, 102, 0, 100


def cut_words(words: DataFrame, vocabulary: DataFrame, unknown: int = UNKNOWN, max_word: int = 100) -> DataFrame:
    """(word, ids) for every different ``word``. ``vocabulary``: (token, id)."""
    words = words.select("word").distinct()
    v = (vocabulary.where("token is not null and token != '' and id is not null")
         .groupBy("token").agg(F.min("id").cast("int").alias("id")))
    inside = F.col("token").startswith(PREFIX) & (F.length("token") > len(PREFIX))
    # a piece that begins with the prefix also stands for itself at the start of a word
    pieces = v.select("id", F.lit(False).alias("first"), F.expr(f"substr(token, {len(PREFIX) + 1})").alias("piece")).where(inside) \
        .unionByName(v.select("id", F.lit(True).alias("first"), F.col("token").alias("piece")))
    most = pieces.agg(F.max(F.length("piece"))).first()[0] or 1
    at = (words.where(F.length("word") <= max_word)
          .select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
          .select("word", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.length("word") - F.col("at") + 1))).alias("n"))
          .withColumns({"first": F.col("at") == 1, "piece": F.expr("substr(word, at, n)")}))
    best = (at.join(pieces, ["first", "piece"]).groupBy("word", "at").agg(F.max(F.struct("n", "id")).alias("b"))
            .groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("at", "b"))).alias("steps")))

    def step(state, _):
        b = F.try_element_at("steps", state.getField("at"))
        return F.when(b.isNull(), state).otherwise(F.struct(
            (state.getField("at") + b.getField("n")).alias("at"),
            F.concat(state.getField("ids"), F.array(b.getField("id"))).alias("ids")))

    walk = F.aggregate(F.sequence(F.lit(1), F.length("word")),
                       F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("ids")), step)
    done = (best.withColumn("w", walk).where(F.col("w.at") == F.length("word") + 1)
            .select("word", F.col("w.ids").alias("ids")))
    return words.join(done, "word", "left").select("word", F.coalesce("ids", F.array(F.lit(unknown))).alias("ids"))


def _framed(ids: Column, n: Column, max_len: int) -> Column:
    body = F.concat(F.array(F.lit(START)), F.slice(ids, 1, max_len - X.SPECIAL_TOKENS), F.array(F.lit(END)))
    pad = F.array_repeat(F.lit(PAD), F.greatest(F.lit(max_len) - F.size(body), F.lit(0)))
    return F.struct(n.alias("n_tokens"), (n >= max_len).alias("truncated"), F.concat(body, pad).alias("input_ids"),
                    F.concat(F.array_repeat(F.lit(1), F.size(body)), F.transform(pad, lambda _: F.lit(0))).alias("attention_mask"))


def subword_budget(df: DataFrame, key: str, text: str, vocabulary: DataFrame, max_len: int = S.MAX_TOKENS,
                   unknown: int = UNKNOWN) -> DataFrame:
    """(key, n_tokens, truncated, input_ids, attention_mask) for every row of ``df``: ids between the two special
    ones, cut to ``max_len`` and padded with 0; ``n_tokens`` counts the whole text with the special tokens."""
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")) \
        .withColumn("h", F.sha2("text", 256))
    each = (rows.groupBy("h").agg(F.first("text").alias("text"))
            .select("h", F.posexplode(X.tokens("text")).alias("at", "word")))
    # every word is at least one id, so words beyond the budget only count
    place = F.when(F.col("at") < max_len - X.SPECIAL_TOKENS, F.col("at"))
    of_text = each.groupBy("h", "word").agg(F.count("*").alias("n"), F.collect_list(place).alias("places"))
    cuts = cut_words(each.select("word"), vocabulary, unknown)
    found = (of_text.join(cuts, "word")
             .select("h", (F.col("n") * F.size("ids")).alias("n"),
                     F.transform("places", lambda p: F.struct(p.alias("at"), F.col("ids").alias("ids"))).alias("placed"))
             .groupBy("h").agg(F.sum("n").alias("n"), F.array_sort(F.flatten(F.collect_list("placed"))).alias("placed")))
    framed = _framed(F.flatten(F.coalesce("placed.ids", F.array().cast("array<array<int>>"))),
                     (F.coalesce("n", F.lit(0)) + X.SPECIAL_TOKENS).cast("int"), max_len)
    return (rows.drop("text").join(found, "h", "left").select(F.col("key").alias(key), framed.alias("b"))
            .select(key, "b.*"))
