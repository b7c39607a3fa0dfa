import hashlib
import os
import random
import zlib

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import merkle, queries
from tests.llm.cases import documents, nothing

FOLDER = "/root/testdata/sf0.001"


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_of(*fields):
    return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def levels_of(row, arity):
    levels = [row]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def siblings(levels, place, arity):
    out = []
    for row in levels[:-1]:
        start = place - place % arity
        out += [row[i] for i in range(start, min(start + arity, len(row))) if i != place]
        place //= arity
    return out


def brute_force(rows, arity=2):
    """By leaf: (group, order, hash), subroot, root, proof. ``rows``: (group, order, hash)."""
    first = lambda x: (x is not None, x)  # noqa: E731  nulls first
    trees = {}
    for group, order, leaf in sorted(rows, key=lambda r: (first(r[0] if r[0] is None else r[0].encode()), first(r[1]), r[2])):
        trees.setdefault(group, []).append((order, leaf))
    grown = {group: levels_of([leaf for _, leaf in leaves], arity) for group, leaves in trees.items()}
    top = levels_of([levels[-1][0] for levels in grown.values()], arity)
    out = []
    for number, (group, leaves) in enumerate(trees.items()):
        for place, (order, leaf) in enumerate(leaves):
            proof = siblings(grown[group], place, arity) + siblings(top, number, arity)
            out.append((group, order, leaf, grown[group][-1][0], top[-1][0], proof))
    return out


@pytest.mark.parametrize(("arity", "sizes"), [(2, [1]), (2, [5, 1, 16, 33]), (3, [40, 1, 2, 9, 10]), (4, [70]), (2, [1, 1, 1])])
def test_trees_of_many_shapes(spark, monkeypatch, arity, sizes):
    monkeypatch.setattr(merkle, "LEVELS", 3)  # several rounds
    rng = random.Random(3)
    rows = [(None if g == 1 else f"g{g}é", None if rng.random() < 0.1 else rng.randrange(size), sha(str(rng.randrange(10**9)))) for g, size in enumerate(sizes) for _ in range(size)]
    rows += rows[:1] * 2  # repeated rows
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "grp string, ord long, hash string").withColumn("root", F.lit(1))  # clashing names
    manifest = merkle.build(df, "grp", "ord", "hash", arity)
    for part in (4, 7, 1000):
        proved = merkle.fold(merkle.prove(manifest, part), "hash", arity=arity).collect()
        assert sorted(map(repr, ((r["grp"], r["ord"], r["hash"], r["subroot"], r["root"], r["proof"]) for r in proved))) == sorted(map(repr, brute_force(rows, arity)))
        assert all(r["folded_root"] == r["root"] for r in proved)


def test_a_changed_leaf_gives_another_root(spark):
    df = spark.range(50).select(F.lit("x").alias("grp"), "id", F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.sha2(F.lit("other"), 256).alias("other"))
    proofs = merkle.prove(merkle.build(df, "grp", "id", "hash"))
    assert merkle.fold(proofs, "other").where("folded_root = root").count() == 0


def test_the_fetched_nodes_are_the_fewest():
    for arity, n, places in [(2, 16, [3]), (2, 16, [2, 3]), (2, 13, [0, 12]), (3, 20, [0, 1, 2, 19]), (2, 8, list(range(8))), (2, 1, [0])]:
        got = merkle.missing(np.array(places), n, arity)
        known = set(places)
        for level, absent in got:
            runs = {p // arity for p in known}
            count = n
            for _ in range(level):
                count = -(-count // arity)
            assert set(absent.tolist()) == {p for run in runs for p in range(run * arity, min(run * arity + arity, count))} - known
            known = runs
    assert sum(len(absent) for _, absent in merkle.missing(np.arange(4096, 8192), 1 << 20, 2)) == 8


def test_no_rows(spark):
    manifest = merkle.build(spark.createDataFrame([], "grp string, ord long, hash string"), "grp", "ord", "hash")
    assert merkle.fold(merkle.prove(manifest), "hash").count() == 0


def answers(rows):
    """What the query must return for rows (doc_id, source, lang, n_chars, text)."""
    leaves = [(lang, doc_id, leaf_of(doc_id, source, lang, n, text)) for doc_id, source, lang, n, text in rows]
    other = {(doc_id, leaf): leaf_of(doc_id, source, lang, n if n is None else n + 1, text) for (doc_id, source, lang, n, text), (_, _, leaf) in zip(rows, leaves, strict=True)}
    out = []
    for _, doc_id, leaf, subroot, root, proof in brute_force(leaves):
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and other[doc_id, leaf] != leaf
        out.append((doc_id, leaf, subroot, root, sha(*proof), not tampered))
    return sorted(map(repr, out))


def found(df):
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = df.collect()
    assert all((r["folded_root"] == r["root"]) == r["verified"] for r in rows)
    return sorted(repr((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["verified"])) for r in rows)


def test_registered_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    assert found(queries.op13_merkle_manifest(spark, FOLDER)) == answers([tuple(r) for r in docs.collect()])
    assert compare.differences(queries.op13_merkle_manifest(spark, FOLDER), compare.connect(FOLDER), queries.ORACLES["op13_merkle_manifest"]) == []


def test_odd_documents(spark, tmp_path):
    docs = documents(spark)
    docs = docs.unionByName(docs.select(F.col("doc_id") + 100, "text", F.when(F.col("doc_id") > 2, "ü").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"), "id", "body", "key", "spans", "label").toDF(*docs.columns))
    for name, df in (("some", docs), ("none", nothing(spark))):
        df.write.parquet(os.path.join(tmp_path, name, "documents.parquet"))
        rows = [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
        assert found(queries.op13_merkle_manifest(spark, os.path.join(tmp_path, name))) == answers(rows)
