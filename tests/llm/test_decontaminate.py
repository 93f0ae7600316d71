"""Leaks, re-parameterised questions and clean texts."""

from covenant.llm import decontaminate as D

ITEMS = [
    (1, "Yesterday the tall farmer Anna sold 12 km of rope and then Anna bought 30 apples for 12 coins at the market."),
    (2, "Water boils at one hundred degrees when the pressure of the air around it equals that at sea level."),
    (3, "yes it is"),
    (4, "a short phrase here now"),
    (5, None),
    (2, "Water boils at one hundred degrees when the pressure of the air around it equals that at sea level."),
]


def run(spark, texts, items=ITEMS, **kw):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return docs, bench, {r.doc_id: r for r in D.contamination(docs, bench, **kw).collect()}


def test_leaks_and_clean_texts(spark):
    water = ITEMS[1][1]
    asked_anew = ITEMS[0][1].replace("Anna", "Peter").replace("12", "7").replace("30", "4,5")
    broken = ITEMS[0][1].replace("Anna", "Peter", 1).replace("12", "7", 1)
    texts = ["before. " + water + " after", water.upper().replace(" ", "  "), "Intro: " + asked_anew, broken,
             "Water boils. The air of the sea is at level with one hundred others.", "yes it is, yes it is",
             "see: A short phrase, here now!", None, "", "water " * 5000, (water + " ") * 300]
    _, _, got = run(spark, texts)
    found = {i: list(r["items"]) for i, r in got.items()}
    assert found == {0: [2], 1: [2], 2: [1], 3: [1], 4: [], 5: [], 6: [4], 7: [], 8: [], 9: [], 10: [2]}
    assert got[2].best_share > got[3].best_share         # the slots of the third text agree, those of the fourth do not
    assert [got[i].contaminated for i in range(11)] == [bool(found[i]) for i in range(11)]


def test_part_of_an_item_and_threshold(spark):
    words = ITEMS[1][1].split()
    texts = [" ".join(words[:12]), " ".join(words[4:14]), " ".join(words[:5])]
    _, _, got = run(spark, texts)
    assert got[0].contaminated and not got[2].contaminated
    _, _, strict = run(spark, texts, least_share=0.9)
    assert not any(r.contaminated for r in strict.values())


def test_clean_keeps_rows_and_columns(spark):
    docs, bench, _ = run(spark, [ITEMS[1][1], "fine", None, "fine"])
    docs = docs.unionByName(docs.limit(0)).unionByName(spark.createDataFrame([(None, "fine", "n"), (None, ITEMS[0][1], "n")], docs.schema))
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect() if r.text) == [(-1, "fine"), (1, "fine"), (3, "fine")]
    assert kept.count() == 4
    empty = bench.limit(0)
    assert D.clean(docs, empty).count() == 6 and D.contamination(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in D.contamination(docs, empty).collect())


def test_blocks_of_items_cover_all(spark, monkeypatch):
    letters = "abcdefghijklmnopqrstuvwxyzäöüß"
    items = [(i, " ".join(f"w{letters[i]}{letters[j]}" for j in range(20))) for i in range(30)]
    texts = [f"lead in {t} lead out" for _, t in items] + ["nothing of the kind is in here at all, or is it"]
    monkeypatch.setattr(D, "BLOCK_WORDS", 100)
    _, _, got = run(spark, texts, items)
    assert all(list(got[i]["items"]) == [i] for i in range(30)) and not got[30].contaminated


def test_names_at_sentence_starts_and_of_other_lengths(spark):
    items = [(1, "Anna has 12 red apples and 5 pears. Anna eats 3 of them."),
             (2, "When the ship of Maria left port, it held 40 crates of tea for the shop.")]
    texts = ["Tom has 7 red apples and 9 pears. Tom eats 2 of them.",
             "Solve this.\nMary Ann Lee has 7 red apples and 9 pears. Mary Ann Lee eats 2 of them.",
             "we know that Tom has 7 red apples and 9 pears. Tom eats 2 of them.",
             "When the ship of Peter van Dyke left port, it held 30 crates of tea for the shop.",
             "When the ship of Peter Paul Smith left port, it held 30 crates of tea for the shop.",
             "Tom sees 7 green leaves but no pears. Tom paints all of them."]
    _, _, got = run(spark, texts, items)
    assert [list(got[i]["items"]) for i in range(6)] == [[1], [1], [1], [2], [2], []]
    assert got[0].best_share == 1.0 and got[1].best_share == 1.0 and got[4].best_share == 1.0


def test_every_run_of_the_least_share_is_found(spark):
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèêøåñç"
    items = [(n, " ".join(f"w{letters[n % 37]}{letters[n // 37]}{letters[j]}" for j in range(n))) for n in (5, 8, 9, 12, 17, 19, 20, 23, 30, 37)]
    texts, want = [], []
    for n, text in items:
        words = text.split()
        least = max(D.LEAST_WORDS, -(-2 * n // 5))
        for size in (least - 1, least):
            for i in range(n - size + 1):
                texts.append("lead in " + " ".join(words[i:i + size]) + " lead out")
                want.append([n] if size == least else [])
    _, _, got = run(spark, texts, items)
    assert [list(got[i]["items"]) for i in range(len(texts))] == want
    _, _, got = run(spark, [items[-1][1], " ".join(items[-1][1].split()[3:15])], items, least_share=0.2)
    assert all(list(got[i]["items"]) == [37] for i in range(2)) and got[0].best_share == 1.0
