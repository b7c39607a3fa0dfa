import random
import zlib

import numpy as np

from ledgerline.llm import toxicity
from tests.llm.cases import documents, nothing


def corpus(spark, n=900, seed=1):
    """Insults have endings of their own, threats come mostly with insults, and some words are junk."""
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        insult = rng.random() < 0.3
        threat = rng.random() < (0.6 if insult else 0.05)
        words = [f"w{rng.choice('abcdefghij')}{rng.choice('klmnop')}x" for _ in range(60)]
        if insult:
            words += [f"zugrob{rng.choice('abcdefgh')}{rng.choice('klmno')}." for _ in range(2)]
        if threat:
            words += ["Willhurt!"]
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append((i, int(insult), int(threat), int(insult and threat)))
    labels += [(0, labels[0][1], labels[0][2], labels[0][3]), (n + 5, 1, 1, 1), (None, 1, 1, 1), (2, None, 1, 1)]
    return documents(spark, texts, list(range(n))), spark.createDataFrame(labels, "doc_id long, insult int, threat int, both int")


CATEGORIES = ["insult", "threat", "both"]


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    chain = toxicity.fit(docs, labels.where("doc_id < 600"), CATEGORIES)
    marked = toxicity.predict(docs, chain).join(labels.where("doc_id >= 600"), "doc_id")
    wrong = marked.where("toxic != (both = 1)").count()
    assert marked.count() == 300 and wrong <= 6
    assert [len(e) for e in chain.earlier] == [0, 1, 2] or [len(e) for e in chain.earlier] == [0, 1, 1]


def test_later_models_use_earlier_probabilities(spark):
    docs, labels = corpus(spark)
    chain = toxicity.fit(docs, labels, CATEGORIES)
    assert any(np.abs(e).max() > 0.01 for e in chain.earlier[1:])


def test_rows_and_columns_stay(spark):
    docs, labels = corpus(spark, 300)
    chain = toxicity.fit(docs, labels, ["insult", "threat"])
    odd = documents(spark).withColumnRenamed("label", "p_insult").withColumnRenamed("key", "toxic")
    found = toxicity.predict(odd, chain)
    assert found.count() == odd.count() and found.where("p_insult IS NULL OR toxic IS NULL OR p_insult < 0 OR p_insult > 1").count() == 0
    assert sorted(found.columns) == sorted({*odd.columns, "p_insult", "p_threat", "toxic"})
    assert toxicity.predict(nothing(spark), chain).count() == 0
    kept = toxicity.remove_toxic(docs, labels, ["threat", "insult"])
    assert kept.columns == docs.columns and 0 < kept.count() < 300


def test_no_labels_and_one_class(spark):
    docs, labels = corpus(spark, 40)
    chain = toxicity.fit(docs, labels.where("doc_id < 0"), CATEGORIES)
    assert toxicity.predict(docs, chain).where("toxic OR p_both IS NOT NULL").count() == 0
    single = toxicity.fit(docs, labels.selectExpr("doc_id", "0 AS insult"), ["insult"])
    assert toxicity.predict(docs, single).where("toxic").count() == 0


def test_the_sample_is_bounded_and_does_not_depend_on_order(spark):
    docs, labels = corpus(spark, 200)
    one = toxicity.fit(docs, labels, ["insult"], sample_rows=80)
    two = toxicity.fit(docs.repartition(7), labels.orderBy("insult"), ["insult"], sample_rows=80)
    assert one.columns.tolist() == two.columns.tolist() and np.allclose(one.weights, two.weights)


def numbers(*names):
    return sorted(zlib.crc32(name.encode()) for name in names)


def test_features():
    assert sorted(toxicity.features_of("Zugrobes!")) == numbers("zugr", "zugro", "zugrob")
    assert sorted(toxicity.features_of("ab-cdef")) == numbers("ab", "cdef")
    assert toxicity.features_of("123") == numbers("123") and toxicity.features_of("!?") == numbers("!?")


def test_words_are_forgotten_without_harm(monkeypatch):
    texts = ["one two ab-cdef two", "", "Zugrobes! zugrob", "three four five six seven", "one"]
    expected = [toxicity.Words().of_text(text).tolist() for text in texts]
    columns = np.unique(np.concatenate([np.array(e, np.uint32) for e in expected]))[::2]
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 2)
    words, places, none = toxicity.Words(), toxicity.Words(columns), toxicity.Words(np.zeros(0, np.uint32))
    for text, features in zip(texts, expected, strict=True):
        assert words.of_text(text).tolist() == features == sorted(set(features))
        assert columns[places.of_text(text)].tolist() == [f for f in features if f in set(columns.tolist())]
        assert none.of_text(text).tolist() == []


def test_rare_features_have_weight_beside_many_frequent_ones(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    frequent = " ".join(a + b + c + d for a in letters for b in letters for c in letters for d in "xyz")
    texts = [frequent] * 8 + ["zugrobes"] * 6
    docs = documents(spark, texts, list(range(14)))
    labels = spark.createDataFrame([(i, int(i >= 8)) for i in range(14)], "doc_id long, insult int")
    fitted = toxicity.fit(docs, labels, ["insult"])
    assert len(fitted.columns) > 1 << 15 and set(numbers("zugr", "zugro", "zugrob")) <= set(fitted.columns.tolist())
    assert toxicity.predict(documents(spark, ["zugrobig"], [1]), fitted).first()["toxic"]


def dense_chain(x, labels, folds, categories):
    """The chain by plain matrices and Newton steps, to the end."""

    def solve(x, y, used):
        n = x.shape[1]
        rate = (used @ y) / used.sum()
        share = used / used.sum() * np.where(y > 0, 0.5 / rate, 0.5 / (1 - rate))
        x1, w = np.column_stack([x, np.ones(len(y))]), np.zeros(n + 1)
        ridge = np.diag([*[toxicity.REGULARIZATION] * n, 0.0])
        for _ in range(60):
            p = 1 / (1 + np.exp(-x1 @ w))
            w = w - np.linalg.solve((x1.T * (share * p * (1 - p))) @ x1 + ridge + 1e-12 * np.eye(n + 1), x1.T @ (share * (p - y)) + ridge @ w)
        return w

    odds, out = np.zeros((len(x), 0)), []
    for k in range(categories):
        both, y = np.column_stack([x, odds]), labels[:, k]
        out.append(solve(both, y, np.ones(len(y))))
        own = np.zeros(len(y))
        for fold in range(toxicity.FOLDS):
            w = solve(both, y, (folds != fold).astype(float))
            own = np.where(folds == fold, both @ w[:-1] + w[-1], own)
        odds = np.column_stack([odds, np.clip(own, -toxicity.LIMIT, toxicity.LIMIT)])
    return out


def test_the_chain_is_that_of_a_plain_fit(monkeypatch):
    monkeypatch.setattr(toxicity, "ITERATIONS", 150)
    monkeypatch.setattr(toxicity, "REGULARIZATION", 0.01)
    monkeypatch.setattr(toxicity, "TOLERANCE", 0.0)
    monkeypatch.setattr(toxicity, "BLOCK", 300)
    rng = np.random.default_rng(3)
    x = (rng.random((150, 12)) < 0.4).astype(float)
    first = (x[:, 0] + x[:, 1] + rng.normal(0, 0.7, 150) > 1).astype(float)
    labels = np.column_stack([first, (first + x[:, 2] + rng.normal(0, 0.7, 150) > 1.2).astype(float), (x[:, 3] + rng.normal(0, 0.5, 150) > 0.5).astype(float)])
    folds = np.arange(150) % toxicity.FOLDS
    rows = toxicity.Rows([np.flatnonzero(row).astype(np.uint32) for row in x])
    assert rows.columns.tolist() == list(range(12))
    for own, plain in zip(toxicity.fit_chain(rows, labels, folds)[0], dense_chain(x, labels, folds, 3), strict=True):
        assert np.allclose(own, plain, atol=2e-3)


def test_threshold_of_the_fewest_errors():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 12)
        odds, y = np.array([float(rng.randrange(-3, 4)) for _ in range(n)]), np.array([rng.randrange(2) for _ in range(n)])
        errors = lambda border: ((odds >= border) != (y > 0)).sum()  # noqa: E731, B023
        assert errors(toxicity.fewest_errors(odds, y)) == min(errors(b) for b in np.arange(-8, 8.5, 0.5))
