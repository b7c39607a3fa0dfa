import numpy as np
import pytest

from ledgerline.llm import neighbours
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, v int, shard string, rank int"


def table(spark, ids, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "s", 3) for i, v in zip(ids, vectors, strict=True)], SCHEMA).repartition(3)


def exact(ids, vectors, k):
    x = np.array(vectors, np.float32).astype(np.float64)
    out = {}
    for i, q in enumerate(ids):
        if q % 20 == 0:
            score = (x[i] * x).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
            out[q] = [(int(ids[j]), score[j]) for j in order]
    return out


def answers(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("shard_rows", [100_000, 300])
def test_recall(spark, shard_rows):
    rng = np.random.default_rng(1)
    ids, vectors = np.arange(1500), rng.normal(size=(1500, 24)) * rng.uniform(0.2, 3, (1500, 1))
    found = answers(neighbours.nearest(table(spark, ids.tolist(), vectors), F.col("vec_id") % 20 == 0, shard_rows=shard_rows))
    expected = exact(ids, vectors, 20)
    assert found.keys() == expected.keys() and all(len(a) == 20 for a in found.values())
    assert np.mean([len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) / 20 for q in expected]) >= 0.9
    for q, rows in found.items():
        assert rows == sorted(rows, key=lambda x: (-x[1], x[0]))


def test_small_tables_ties_and_copies_are_exact(spark):
    vectors = [[1, 0]] * 70 + [[0, 1]] * 30 + [[0.5, 0.5], [-1, 0]]
    ids = list(range(100, 202))
    found = answers(neighbours.nearest(table(spark, ids, vectors), F.col("vec_id") % 20 == 0, k=20))
    assert found == {q: rows for q, rows in exact(np.array(ids), vectors, 20).items()}


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    ids = [0, 20, 1, 2, 3, 4, 5, None, 6, 40, 40]
    vectors = [[1, 2], [0, 0], None, [1, None], [nan, 1], [inf, 1], [3, 1], [1, 1], [2, 2, 2], [1, 0], [1, 0]]
    found = answers(neighbours.nearest(table(spark, [i for i in ids if i != 6], [v for i, v in zip(ids, vectors) if i != 6]), F.col("vec_id") % 20 == 0))
    assert found == {0: [(5, 5.0), (40, 1.0)], 40: [(5, 3.0), (0, 1.0)]}
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_every_vector_can_be_reached():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(size=(300, 8)) + 50 * c for c in np.eye(8)[:4]]).astype(np.float32)
    graph = neighbours.build_graph(neighbours._equal_length(points.astype(np.float64), float((points.astype(np.float64) ** 2).sum(1).max())))
    reached, front = set(graph.entries.tolist()), graph.entries
    while len(front):
        front = np.array([n for n in np.unique(graph.edges[front]) if n >= 0 and n not in reached], np.int64)
        reached.update(front.tolist())
    assert len(reached) == 1200 and (graph.edges >= 0).sum(axis=1).max() <= neighbours.DEGREE


def test_vectors_of_each_length_are_answered_among_themselves(spark):
    ids = [0, 20, 1, 5, 40, 6, 60, 7, 80]
    vectors = [[1, 2], [0, 0], None, [3, 1], [1, 0], [2, 2, 2], [1, 1, 0], [5, 0, 1], [1, 1, 1, 1]]
    found = answers(neighbours.nearest(table(spark, ids, vectors), F.col("vec_id") % 20 == 0))
    assert found == {0: [(5, 5.0), (40, 1.0)], 40: [(5, 3.0), (0, 1.0)], 60: [(7, 5.0), (6, 4.0)]}


def test_two_models_in_one_table_give_what_each_gives_alone(spark):
    rng = np.random.default_rng(4)
    short, long = rng.normal(size=(400, 8)), rng.normal(size=(200, 12))
    ids = np.arange(600)
    found = answers(neighbours.nearest(table(spark, ids.tolist(), [*short, *long]), F.col("vec_id") % 20 == 0, k=5, shard_rows=150))
    assert found == {**exact(ids[:400], short, 5), **exact(ids[400:], long, 5)}


@pytest.mark.parametrize("shard_rows", [100_000, 30])
def test_different_vectors_with_equal_scores_go_to_the_smaller_id(spark, shard_rows):
    vectors = [[1.0, *(float(i >> bit & 1) for bit in range(7))] for i in range(90)]
    vectors[0] = [1.0] + [0.0] * 7
    ids = np.array([0, *np.random.default_rng(5).permutation(np.arange(1, 90)).tolist()])
    found = answers(neighbours.nearest(table(spark, ids.tolist(), vectors), F.col("vec_id") == 0, k=5, shard_rows=shard_rows))
    assert found == {0: [(i, 1.0) for i in range(1, 6)]}
