"""Packing against the library's ids, a plain search for the sequence of each piece, and the laws of a packing."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from covenant.llm import packing, queries

JSON = P.path("word_bpe_49k.json")


def library_ids(texts):
    t = Tokenizer.from_file(JSON)
    return [e.ids + [2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def odd_texts():
    rng = random.Random(12)
    chars = " \n\t\r\x1c\x85 　abcABC0123éßÀ×ªº²ñ́Σİ漢字한가\U0001f600.,'s!?_-<|>’ͅ"
    out = ["", " ", "\n\n a", "a" * 3000, " " * 2000, "don't I'LL we're it’s THEY'VE'D", "0" * 99 + " ½²٣", "ΑΣ ΑΣΑ Σ",
           "x<|endoftext|>y <|startoftext|><|endoftext|> <|ENDOFTEXT|>", "é ́e", "'s's ''t 'S"]
    return out + ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(3000)]


def test_ids_are_the_librarys():
    texts = odd_texts()
    encoder = packing.Encoder(JSON, table_bytes=20_000)          # the table is emptied many times
    assert encoder.direct
    assert [ids_of(encoder.encode(t)) + [2] for t in texts] == library_ids(texts)


def test_very_long_texts_are_encoded_in_parts(monkeypatch):
    monkeypatch.setattr(packing, "PART_CHARS", 100)
    text = " ".join(odd_texts())
    encoder = packing.Encoder(JSON)
    assert len(list(encoder.parts(text))) > 100 and "".join(encoder.parts(text)) == text
    assert ids_of(encoder.encode(text)) + [2] == library_ids([text])[0]


def test_a_vocabulary_that_keeps_spaces_is_refused():
    with pytest.raises(ValueError):
        packing.Encoder(P.path("byte_bpe_50k.json"))


def plain_assign(lengths, capacity, hidden):
    """Every piece looks at every sequence."""
    n = -(-sum(lengths) // capacity)
    room, spent, out, left = [capacity] * n, [0] * n, [], []

    def put(row, start, size, s):
        out.append((row, start, size, s, capacity - room[s]))
        room[s] -= size
        spent[s] += 6 * hidden * size + size * size

    for row, size in enumerate(lengths):
        fits = [(spent[s], s) for s in range(n) if room[s] >= size]
        if fits:
            put(row, 0, size, min(fits)[1])
        else:
            left.append((row, size))
    for row, size in left:
        start = 0
        while start < size:
            s = min((spent[s], s) for s in range(n) if room[s])[1]
            take = min(size - start, room[s])
            put(row, start, take, s)
            start += take
    return out


def test_assignment_is_that_of_a_plain_search():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.choice([4, 17, 64])
        lengths = sorted((rng.choice([rng.randint(1, capacity), rng.randint(1, 3), capacity]) for _ in range(rng.randrange(60))), reverse=True)
        hidden = rng.choice([1, 16])
        assert packing.assign(np.array(lengths, np.int64), capacity, hidden) == plain_assign(lengths, capacity, hidden)


def test_costs_are_nearer_than_in_given_order():
    rng = random.Random(8)
    lengths = sorted((rng.randint(1, 1500) for _ in range(3000)), reverse=True)

    def spread(rows):
        spent = defaultdict(int)
        for _, _, size, s, _ in rows:
            spent[s] += packing.cost(size)
        return np.std(sorted(spent.values())[1:])                # without the sequence that is not full

    balanced = spread(packing.assign(np.array(lengths), 4096))
    rows, used = [], 0
    for i, size in enumerate(lengths):                           # one after another, cut where a sequence ends
        while size:
            take = min(size, 4096 - used % 4096)
            rows.append((i, 0, take, used // 4096, 0))
            used, size = used + take, size - take
    assert balanced < spread(rows) / 2


def check_packing(docs, rows, capacity):
    """Each id in one piece, in order; sequences gapless and not too long; returns padding."""
    want = sorted((d, tuple(i)) for (d, _), i in zip(docs, library_ids([t for _, t in docs])))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4 > 0
        by_doc[r.doc_id, r.doc_tokens].append((r.start, ids_of(r.ids)))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    got = []
    for (d, n), parts in by_doc.items():
        parts.sort()
        copies = sum(s == 0 for s, _ in parts)                   # repeated rows: all starts occur as often
        for c in range(copies):
            ids = [i for s, p in parts[c::copies] for i in p]
            assert len(ids) == n
            got.append((d, tuple(ids)))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return sum(capacity - sum(n for _, n in p) for p in by_sequence.values())


def test_packing_of_documents(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices(["alpha", "beta", "it's", "12", "é,"], k=rng.choice([0, 3, 40, 400])))) for i in range(300)]
    docs += [(900, ""), (901, "word " * 1500), (902, "a")]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in docs], "doc_id int, text string, ids string, block int, part string").repartition(7)
    rows = packing.pack(df, JSON, 2, capacity=64, hidden=16, block_tokens=1000).collect()
    blocks = {r.sequence_id >> 32 for r in rows if r.sequence_id < 1 << 61}
    assert len(blocks) > 3
    assert check_packing(docs, rows, 64) < 64 * len(blocks)      # less than a sequence for every block
    whole = [r for r in rows if r.sequence_id >= 1 << 61]
    assert whole and all(r.length == 64 for r in whole) and len({r.sequence_id for r in whole}) == len(whole)


def test_odd_rows(spark):
    docs = [(1, None), (None, "b c"), (None, "b c d"), (2, "same text"), (2, "same text"), (3, "\t ")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = packing.pack(df, JSON, 2, capacity=8).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens, r.length) for r in rows if r.doc_id != 2 and r.start == 0 and r.length == r.doc_tokens) \
        == [(0, 3, 3), (0, 4, 4), (1, 1, 1), (3, 1, 1)]
    assert sum(r.length for r in rows) == 3 + 4 + 1 + 1 + 3 + 3
    assert packing.pack(df.where("false"), JSON, 2).count() == 0


def test_query_columns_and_checksums(spark):
    got = queries.op12_cost_packing(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint",
                                "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    ids = dict(zip((d.doc_id for d in docs), library_ids([d.text for d in docs])))
    rows = got.collect()
    for r in rows:
        piece = ids[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    assert len({r.sequence_id for r in rows}) <= -(-sum(map(len, ids.values())) // 4096) + 1
