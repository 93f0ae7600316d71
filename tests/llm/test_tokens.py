"""BPE encoding and token counts against the tokenizer libraries."""

import random

import pytest
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from covenant.llm import bpe, tokencount

RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


def odd_texts():
    rng = random.Random(3)
    chars = " \n\t\r\x1c\x85\u00a0\u3000abcABC0123éßñ漢字한\U0001f600\u0558\U00033000.,'s!?_-<|>"
    out = ["", " ", "\n\n a", "a" * 3000, "ab" * 2500, " " * 2000, "don't I'LL we're it\u2019s", "0" * 999 + " ½²٣",
           "".join(rng.choice("abcdefghij") for _ in range(20_000)), "x<|endoftext|>y <|endoftext|><|endoftext|>"]
    return out + ["".join(rng.choice(chars) for _ in range(rng.randrange(80))) for _ in range(3000)]


def test_encode_as_the_library_does():
    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, P.PATTERN, cache_entries=500)
    texts = odd_texts()
    got = codec.encode(texts)
    assert got == [library.encode_ordinary(t) for t in texts]
    assert [codec.decode(i).decode() for i in got] == texts


def test_lower_ranks_that_come_up_late_go_first():
    """Ranks that no training would give: a merge makes a pair of lower rank than its own."""
    rng = random.Random(1)
    for _ in range(200):
        pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 4))) for _ in range(12)}
        order = list(pieces)
        rng.shuffle(order)
        ranks = {bytes([b]): 500 + b for b in range(256)} | {p: i for i, p in enumerate(order)}
        library = tiktoken.Encoding("x", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(5)]
        assert bpe.Codec(ranks, r"[\s\S]+").encode(texts) == [library.encode_ordinary(t) for t in texts]


def test_tables_round_trip(spark):
    texts = [None, *odd_texts()[:60], "repeat", "repeat"]
    df = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    ids = bpe.encode(df, RANKS, P.PATTERN)
    out = {r.doc_id: r for r in bpe.decode(ids, RANKS, P.PATTERN).collect()}
    assert len(out) == len(texts) and all(bytes(out[i].decoded).decode() == (t or "") for i, t in enumerate(texts))
    assert out[0].ids == [] and out[3].n_tokens == "keep"
    assert bpe.encode(df.limit(0), RANKS, P.PATTERN, keep_text=False).columns == ["doc_id", "n_tokens", "ids"]
    assert bpe.decode(spark.createDataFrame([(1, None)], "a int, ids array<int>"), RANKS, P.PATTERN).first().decoded == b""
    with pytest.raises(ValueError):
        bpe.encode(df.withColumn("ids", F.lit(1)), RANKS, P.PATTERN)


def test_counts_as_the_library_gives_them(spark):
    library = Tokenizer.from_file(JSON)
    texts = odd_texts()
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert tokencount.Counter(JSON, cache_entries=700).counts(texts) == want
    df = spark.createDataFrame([(0, None, 7), *((i + 1, t, 7) for i, t in enumerate(texts[:300]))], "doc_id long, text string, n int")
    out = {r.doc_id: r for r in tokencount.token_counts(df, JSON, keep_text=False).collect()}
    assert [out[i].n_tokens for i in range(301)] == [0, *want[:300]] and out[5].n == 7
    assert tokencount.token_counts(df.limit(0), JSON).count() == 0
    with pytest.raises(ValueError):
        tokencount.token_counts(df, JSON, name="n")
