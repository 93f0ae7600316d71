"""Algebra of the multiset hash and the edit query against a plain version."""

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from covenant.llm import fingerprint as G
from covenant.llm.fingerprint import Fingerprint as Fp

lines = st.lists(st.text(alphabet="ab .é\u3000", max_size=8), max_size=8)


@settings(max_examples=200, deadline=None)
@given(lines, lines, st.randoms())
def test_sums_do_not_depend_on_order_and_undo(a, b, rng):
    mixed = a + b
    rng.shuffle(mixed)
    both = Fp().add(a).add(b)
    assert str(both) == str(Fp().add(mixed)) and str(both.copy().remove(b)) == str(Fp().add(a))
    assert str(Fp.parse(str(both))) == str(both)
    old, new = "\n".join(a), "\n".join(b)
    assert str(Fp.of(old).edited(old, new)) == str(Fp.of(new))
    assert 0.0 <= Fp.of(old).likeness(Fp.of(new)) <= 1.0 and Fp.of(old).likeness(Fp.of(old)) == 1.0


def test_different_multisets_differ():
    texts = ["", "\n", "a", "a\na", "a\nb", "a\nb\nb", "ab", "a b", "b\na\nb\na"]
    assert len({str(Fp.of(t)) for t in texts}) == len(texts) and str(Fp.of("a\nb\nb")) == str(Fp.of("b\na\nb"))


def test_signs_against_one_window_at_a_time():
    """The vectorised sums against windows of words found by plain loops."""
    def plain_signs(paragraphs):
        total = [0] * G.SIGN_LANES
        for p in paragraphs:
            words = G._words(p)
            if len(words) < 4:
                words = [c for c in p if not c.isspace()]
            for run in (words[i:i + G.RUN_WORDS] for i in range(0, len(words), G.RUN_WORDS)):
                for before, own in {(run[i - 1] if i else None, w) for i, w in enumerate(run)}:
                    mask = (1 << 64) - 1

                    def mixed(x):
                        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
                        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
                        return x ^ x >> 31

                    h = 0 if before is None else G.xxh3_64_intdigest(before.encode())
                    w = mixed(mixed(G.xxh3_64_intdigest(own.encode()) + G._STEP & mask) + h & mask)
                    for i in range(G.SIGN_LANES // 64):
                        raw = mixed(w + (i + 1) * G._STEP & mask).to_bytes(8, "little")
                        for n, byte in enumerate(raw):
                            for bit in range(8):
                                total[i * 64 + n * 8 + bit] += 1 if byte >> 7 - bit & 1 else -1
        return total

    rng = random.Random(5)
    for _ in range(30):
        ps = [" ".join(rng.choice(["a", "b", "word", "\u6f22\u5b57", "x" * 40, "\u0e01\u0e02"]) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(8))]
        assert G._signs(G._windows(ps)).tolist() == plain_signs(ps)
    whole = G.RUN_WORDS
    try:
        G.RUN_WORDS = 5         # runs that end inside and between paragraphs
        ps = ["a b c d e f g a b c d", "a b", "", "q w e r t", "a b c d e f"]
        assert G._signs(G._windows(ps)).tolist() == plain_signs(ps)
    finally:
        G.RUN_WORDS = whole


def test_edited_texts_are_nearer_than_the_next_ones():
    import duckdb
    rows = duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()
    texts = [t or "" for t, in rows]
    found = [Fp.of(t) for t in texts]
    worse = low = 0
    for n, t in enumerate(texts):
        u = texts[(n + 1) % len(texts)]
        near = found[n].likeness(found[n].edited(t, G._edit(t, u)))
        worse += near <= found[n].likeness(found[(n + 1) % len(texts)]) and t != u
        low += near < 0.2
    assert worse <= len(texts) / 1000 and low <= len(texts) / 100


def test_likeness_follows_shared_sentences():
    rng = random.Random(1)
    s = [f"Sentence {rng.randrange(10**9)}." for _ in range(400)]
    half = Fp.of(" ".join(s[:200])).likeness(Fp.of(" ".join(s[100:300])))
    assert 0.25 < half < 0.75 and Fp.of(" ".join(s[:200])).likeness(Fp.of(" ".join(s[200:]))) < 0.35


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for n, (i, t) in enumerate(rows):
        t, u = t or "", rows[(n + 1) % len(rows)][1] or ""
        new = t[:len(t) - len(t) // 2] + u[:len(t) // 2]
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), str(Fp.of(t)), str(Fp.of(new)),
                    Fp.of(t).likeness(Fp.of(new)), Fp.of(t).likeness(Fp.of(u))))
    return sorted(out, key=str)


def test_edit_query_against_a_plain_version(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(10**6), "\n".join("Word é\U0001f600. " * rng.randrange(6) for _ in range(rng.randrange(6)))) for _ in range(300)]
    rows += [(5, None), (5, ""), (5, "x\ny"), (None, "null id"), (2, "long " * 30_000)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, fingerprint string")
    for size in (None, 1, 40, 10**6):
        got = sorted((tuple(r) for r in G.edit_fingerprints(df, size).collect()), key=str)
        assert got == plain(rows)
    for few in (rows[:1], rows[:2], []):
        df = spark.createDataFrame(few, "doc_id long, text string")
        assert sorted((tuple(r) for r in G.edit_fingerprints(df).collect()), key=str) == plain(few)


def test_column_of_fingerprints(spark):
    df = spark.createDataFrame([(1, "a\nb", 2), (2, "b\na", 3), (3, None, 4)], "doc_id long, text string, x int")
    out = {r.doc_id: r.fingerprint for r in G.fingerprints(df).collect()}
    assert out[1] == out[2] == str(Fp.of("a\nb")) and out[3] == str(Fp.of(""))
    again = G.fingerprints(df.withColumn("fingerprint", df.x)).collect()
    assert {r.doc_id: (r.fingerprint, r.x) for r in again} == {i: (out[i], i + 1) for i in out}


def test_likeness_of_lines_repeated_more_than_two_to_the_fifteen_times():
    text = "spam.\n" * 40_000
    own = Fp.of(text)
    half = own.edited(text, text[:len(text) // 2] + "".join(f"Line {i}.\n" for i in range(20_000)))
    # windows of "spam." and of "Line" have the same counts in the edited text: a cosine of about 0.7
    assert 0.55 < own.likeness(half) < 0.85 and own.likeness(Fp.of("spam.\n" * 30_000)) > 0.99
    assert str(Fp.parse(str(own))) == str(own) and Fp.parse(str(own)).likeness(half) == own.likeness(half)
