import random

import numpy as np
import pytest

from ledgerline.llm import near_dedup
from ledgerline.llm.components import components
from tests.llm.cases import TEXTS, documents, nothing


def brute(rows, width, percent):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if (a and b and (same_id or 100 * len(a & b) >= percent * len(a | b))):
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            groups[find(i)] = min(groups.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), groups.get(find(i)) if doc is not None else None) for i, (doc, _) in enumerate(rows)), key=repr)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_exact(spark, seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 9, 60, 200]))]
        texts += [" ".join(edited(rng, base, rng.choice([0, 0, 1, 2, 5, 9]))) for _ in range(12)]
    texts += ["A b C", "a B c", "a b", "", None, "  "]
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    found = near_dedup.near_duplicates(documents(spark, texts, ids), width=4)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()]
    assert sorted(got, key=repr) == brute(rows, 4, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.collect())


def test_odd_rows(spark):
    ids = [4, 5, 6, 7, 7, 8, 9, 2, None, 2]
    texts = TEXTS[:4] + ["one two three four five six", "one two three four five six", *TEXTS[6:9], "one"]
    got = near_dedup.near_duplicates(documents(spark, texts, ids), width=4).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add((r["component_id"], r["kept"]))
    # 7 has two texts, one of them that of 8, the other that of 2, which has two as well
    assert by_id == {4: {(4, True)}, 5: {(5, True)}, 6: {(6, True)}, 7: {(2, False)}, 8: {(2, False)}, 9: {(9, True)}, 2: {(2, True)}, None: {(2, False)}}
    assert near_dedup.near_duplicates(nothing(spark)).count() == 0


def test_a_large_group_of_near_copies_stays_together(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(edited(rng, base, 6)) for _ in range(150)] + [" ".join(base)]
    found = near_dedup.near_duplicates(documents(spark, texts, list(range(151))), width=5).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=repr) == brute(list(enumerate(texts)), 5, 80)


def test_one_of_each_group_stays(spark):
    docs = documents(spark, ["a b c d e f", "A b c d e f", "other words", None, ""], [3, 1, 7, 8, 9])
    kept = near_dedup.keep_one_of_each(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 7, 8, 9] and kept.columns == docs.columns


def test_signature_estimates_similarity():
    keys = near_dedup.permutation_keys(512)
    a, b = np.arange(0, 900, dtype=np.uint64), np.arange(100, 1000, dtype=np.uint64)
    sign = near_dedup.signatures([near_dedup._mixed(a + np.uint64(7)), near_dedup._mixed(b + np.uint64(7))], keys)
    assert abs((sign[0] == sign[1]).mean() - 0.8) < 0.05
    assert (sign[:, ::2] <= sign[:, 1::2]).all()


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 99), (99, 100), (7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(61)}, 99: 99, 100: 99}
    assert components(links.where("a < 0")).count() == 0


def test_components_of_a_long_chain_in_few_steps(spark, monkeypatch):
    from ledgerline.llm import components

    steps = []
    order = components._order
    monkeypatch.setattr(components, "_order", lambda node, step: (steps.append(step), order(node, step))[1])
    chain = spark.range(600).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.createDataFrame([(900, 901), (902, 901)], "a long, b long"))
    found = {r["node"]: r["component"] for r in components.components(chain).collect()}
    assert found == {**dict.fromkeys(range(601), 0), 900: 900, 901: 900, 902: 900}
    assert max(steps) <= 12
