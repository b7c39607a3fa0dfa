import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import decontamination as dc
from tests.llm.cases import LONG, documents, nothing


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (1 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


def test_scores_are_those_of_the_plain_algorithm():
    rng = random.Random(1)
    pairs = [([rng.randrange(1, 6) for _ in range(rng.randrange(1, 30))], [rng.randrange(0, 6) for _ in range(rng.randrange(1, 60))]) for _ in range(200)]
    found = dc.align([np.array(a) for a, _ in pairs], [np.array(b) for _, b in pairs])
    assert found.tolist() == [smith_waterman(a, b) for a, b in pairs]


def items(rng, n=20, length=40):
    return [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(60)}" for _ in range(length)) for _ in range(n)]


def benchmark(spark, texts, ids=None):
    return spark.createDataFrame(list(zip(ids or range(len(texts)), texts, strict=True)), "item_id long, text string")


def changed(rng, text, share):
    out = []
    for word in text.split():
        roll = rng.random()
        out += [] if roll < share / 3 else [f"new{rng.randrange(999)}"] if roll < 2 * share / 3 else [word, "put"] if roll < share else [word]
    return " ".join(out)


def test_copies_are_found_and_others_left_alone(spark):
    rng = random.Random(2)
    tests = items(rng)
    clean = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(60)}" for _ in range(300)) for _ in range(40)]
    leaks = [f"{c} {changed(rng, t.upper() + '!', share)} {c}" for t, c, share in zip(tests, clean, [0, 0.1, 0.2, 0.25] * 5, strict=False)]
    found = dc.mark_leaks(documents(spark, clean + leaks, list(range(60))), benchmark(spark, tests)).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert not any(by_id[i]["leaked"] for i in range(40))
    assert all(by_id[40 + i]["leaked"] and by_id[40 + i]["leak_item"] == i for i in range(20))


def test_scores_equal_a_search_of_everything(spark):
    rng = random.Random(3)
    tests = items(rng, 6, 25)
    texts = [f"x y {changed(rng, t, 0.3)} z" for t in tests for _ in range(4)]
    number = lambda text: dc.words_of(text)
    for r in dc.mark_leaks(documents(spark, texts, list(range(24))), benchmark(spark, tests), rare_share=1.0).collect():
        best = max(smith_waterman(number(t), number(texts[r["doc_id"]])) / 25 for t in tests)
        assert r["leak_score"] == pytest.approx(best) or best < 0.3


def test_passage_in_most_documents_keeps_its_seeds(spark):
    rng = random.Random(4)
    tests = items(rng, 3)
    texts = [f"own{i} words{i} {tests[0]} more{i}" for i in range(90)] + [f"clean{i} text{i} only{i}" for i in range(10)]
    found = dc.mark_leaks(documents(spark, texts, list(range(100))), benchmark(spark, tests))
    assert found.where("leaked AND leak_item = 0").count() == 90


def test_ties_go_to_the_smaller_item_and_long_items_are_cut(spark):
    rng = random.Random(5)
    test = items(rng, 1)[0]
    long = " ".join(f"l{i}" for i in range(2000))
    docs = documents(spark, [test, " ".join(f"l{i}" for i in range(900, 1300)), None, "", LONG], [1, 2, 3, 4, 5])
    found = {r["doc_id"]: (r["leak_item"], r["leaked"]) for r in dc.mark_leaks(docs, benchmark(spark, [test, test, long, "few words", None, test], [8, 4, 6, 1, 2, None])).collect()}
    assert found == {1: (4, True), 2: (6, True), 3: (None, False), 4: (None, False), 5: (None, False)}


def test_a_filter_that_lets_all_through_changes_nothing(spark, monkeypatch):
    rng = random.Random(6)
    tests = items(rng)
    docs = documents(spark, [f"a {t} b {u}" for t, u in zip(tests, tests[1:] + tests[:1], strict=True)], list(range(20)))
    whole = sorted(dc.mark_leaks(docs, benchmark(spark, tests)).select("doc_id", "leak_item", "leak_score").collect())
    assert all(r["leak_score"] == 1.0 for r in whole)
    monkeypatch.setattr(dc, "FILTER_BITS", 64)
    assert sorted(dc.mark_leaks(docs, benchmark(spark, tests)).select("doc_id", "leak_item", "leak_score").collect()) == whole


def test_short_items_match_only_as_a_whole(spark):
    texts = ["say What is the capital of France? now", "what is the capital of spain", "Yes!", "yes it is", "yes it", "x yes it y"]
    found = dc.mark_leaks(documents(spark, texts, list(range(6))), benchmark(spark, ["what is the capital of france", "yes", "it yes", "yes it"]))
    assert {r["doc_id"]: r["leak_item"] for r in found.where("leaked").collect()} == {0: 0, 2: 1, 4: 3}


def test_copies_of_a_text_and_replaced_names(spark):
    test = items(random.Random(8), 1)[0]
    docs = documents(spark, [test] * 40 + ["clean words here"] * 20, list(range(60))).withColumn("leak_item", F.lit("old")).withColumn("leaked", F.lit(1))
    found = dc.mark_leaks(docs, benchmark(spark, [test]))
    assert found.count() == 60 and found.where("leaked AND leak_item = 0 AND leak_score = 1").count() == 40
    assert found.columns == [*[c for c in docs.columns if c not in ("leak_item", "leaked")], "leak_item", "leak_score", "leaked"]


def test_nothing_to_look_for_or_in(spark):
    docs = documents(spark)
    assert dc.mark_leaks(docs, benchmark(spark, ["x"]).where("item_id < 0")).where("leaked").count() == 0
    assert dc.mark_leaks(nothing(spark), benchmark(spark, items(random.Random(7)))).count() == 0
    assert dc.remove_leaks(docs, benchmark(spark, items(random.Random(7)))).columns == docs.columns
