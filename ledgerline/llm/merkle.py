"""Merkle manifest of a dataset, and the proofs of its leaves by multiproofs of leaf partitions.

Rows are the leaves of one tree for each group; the roots of these trees are the leaves of a last one. Nodes have
coordinates (tree, level, place), those of the last tree under the number -1. Trees grow in rounds: a task takes a
block of neighbouring nodes up by several levels, so a round is one shuffle of what the round before left over.

For the proofs, each partition of neighbouring leaves works out the smallest set of nodes that its proofs need and
that do not follow from its own leaves: walking up, what is missing in the runs of the nodes known so far. These
coordinates are fetched by one join for all partitions. Each partition then derives the interior nodes its proofs
share, and writes down the proof of every leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.batches import groups
from ledgerline.llm.ordering import ranked
from ledgerline.session import fresh_path, write_and_read

ARITY = 2
LEVELS = 12  # that a round builds: its tasks hold ARITY ** LEVELS nodes of a block
PART = 4096  # leaves of a partition that are proved together
LAST = -1  # the number of the tree over the roots


@dataclass
class Manifest:
    """``leaves``: ``row`` (the row given), ``tree``, ``idx``, ``n`` (leaves of its tree), ``trees``, ``hash``;
    ``nodes``: ``tree``, ``level``, ``idx``, ``hash`` of all nodes above the leaves and of the roots as leaves."""

    leaves: DataFrame
    nodes: DataFrame
    arity: int


def digest(*fields: Column) -> Column:
    """SHA-256 in hexadecimal of fields, each as its length in bytes, a colon and its text, or a dash for null."""
    texts = [field.cast("string") for field in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")) for text in texts)), 256)


def _parent(children: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(children)).hexdigest().encode()


def _above(n: int, arity: int) -> int:
    return -(-n // arity)


def _grow(nodes: DataFrame, level: int, arity: int, levels: int) -> DataFrame:
    """The next ``levels`` levels over ``nodes`` (``tree``, ``n``, ``idx``, ``hash``, all of ``level``), as far as their trees go."""
    width, schema = arity**levels, "tree long, n long, level int, idx long, hash binary, top boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in groups(batches, ("tree", "block")):
            tree, n, first = (block.column(c)[0].as_py() for c in ("tree", "n", "idx"))
            row = [h.hex().encode() for h in block.column("hash").to_pylist()]
            count = n  # of all nodes of the tree, level by level
            for _ in range(level):
                count = _above(count, arity)
            out = {name: [] for name in ("level", "idx", "hash", "top")}
            for up in range(1, levels + 1):
                if count == 1:
                    break
                row = [_parent(row[i : i + arity]) for i in range(0, len(row), arity)]
                first, count = first // arity, _above(count, arity)
                out["level"] += [level + up] * len(row)
                out["idx"] += range(first, first + len(row))
                out["hash"] += [bytes.fromhex(h.decode()) for h in row]
                out["top"] += [count == 1] * len(row)
            size = len(out["level"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree] * size, pa.int64()), pa.array([n] * size, pa.int64()), pa.array(out["level"], pa.int32()), pa.array(out["idx"], pa.int64()), pa.array(out["hash"], pa.binary()), pa.array(out["top"], pa.bool_())],
                names=["tree", "n", "level", "idx", "hash", "top"],
            )

    blocks = nodes.select("tree", "n", "idx", "hash", F.floor(F.col("idx") / width).cast("long").alias("block"))
    return blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx").mapInArrow(run, schema)


def _grow_to_the_top(nodes: DataFrame, arity: int) -> DataFrame:
    """All nodes above ``nodes`` (``tree``, ``n``, ``idx``, ``hash``, leaves of their trees), stored."""
    spark, levels = nodes.sparkSession, max(1, int(LEVELS / np.log2(arity)))
    largest = nodes.agg(F.max("n")).first()[0] or 0
    built, level = None, 0
    while built is None or largest > 1:
        grown = write_and_read(_grow(nodes, level, arity, levels), fresh_path(spark, "merkle-nodes"))
        built = grown if built is None else built.unionByName(grown)
        level += levels
        for _ in range(levels):
            largest = _above(largest, arity)
        nodes = grown.where((F.col("level") == level) & ~F.col("top"))
    return built


def build(rows: DataFrame, group: str, order: str, leaf: str, arity: int = ARITY) -> Manifest:
    """The manifest of ``rows``: a leaf for each, its hash (hexadecimal text) in the column ``leaf``.

    Leaves stand by ``order`` within their ``group``, nulls first and equal ones by their hash; trees stand by group,
    null first. Every ``arity`` consecutive nodes become the hash of their hashes' texts, the last ones of a level
    also if they are fewer or only one, until one node remains. A single leaf is the root of its tree. Repeated rows
    are leaves of their own. Without rows there are no leaves and no nodes.
    """
    spark = rows.sparkSession
    named = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.col(f"`{group}`").alias("grp"), F.col(f"`{order}`").alias("ord"), F.unhex(F.col(f"`{leaf}`")).alias("hash"))
    named = write_and_read(named, fresh_path(spark, "merkle-rows"))
    placed = ranked(named, ["ord", "hash"], within="grp")
    trees = ranked(placed.groupBy("grp").agg(F.first("n").alias("size")), ["grp"])
    trees = write_and_read(trees.select(F.col("grp").alias("of_grp"), F.col("idx").alias("tree"), F.col("n").alias("trees")), fresh_path(spark, "merkle-trees"))
    leaves = placed.join(trees, F.col("grp").eqNullSafe(F.col("of_grp"))).select("row", "tree", "idx", "n", "trees", "hash")
    leaves = write_and_read(leaves, fresh_path(spark, "merkle-leaves"))
    nodes = _grow_to_the_top(leaves.select("tree", "n", "idx", "hash"), arity)
    tops = nodes.where("top").select("tree", "hash").unionByName(leaves.where("n = 1").select("tree", "hash"))
    tops = tops.join(trees, "tree").select(F.lit(LAST).cast("long").alias("tree"), F.col("trees").alias("n"), F.col("tree").alias("idx"), "hash")
    tops = write_and_read(tops, fresh_path(spark, "merkle-tops"))
    last = _grow_to_the_top(tops, arity)
    nodes = nodes.unionByName(last).select("tree", "level", "idx", "hash")
    return Manifest(leaves, nodes.unionByName(tops.select("tree", F.lit(0).alias("level"), "idx", "hash")), arity)


def _runs(known: np.ndarray, n: int, arity: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs that the ascending places ``known`` of a level with n nodes are in, and all places in these runs."""
    runs = np.unique(known // arity)
    members = (runs[:, None] * arity + np.arange(arity)).ravel()
    return runs, members[members < n]


def missing(places: np.ndarray, n: int, arity: int) -> list[tuple[int, np.ndarray]]:
    """By level, the least nodes of a tree of n leaves that its proofs for ``places`` need besides what follows from them."""
    known, level, out = np.unique(places), 0, []
    while n > 1:
        runs, members = _runs(known, n, arity)
        out.append((level, np.setdiff1d(members, known, assume_unique=True)))
        known, n, level = runs, _above(n, arity), level + 1
    return out


def _proofs(leaves: dict[int, bytes], n: int, fetched: dict[int, dict[int, bytes]], arity: int) -> tuple[dict[int, tuple[bytes, ...]], bytes]:
    """The siblings on the way up from each place of ``leaves``, and the root of their tree."""
    own, level, levels = dict(leaves), 0, []
    while n > 1:
        known = own | fetched.get(level, {})
        runs = sorted({place // arity for place in own})
        levels.append((known, own, n))
        own = {run: _parent([known[place] for place in range(run * arity, min(run * arity + arity, n))]) for run in runs}
        n, level = _above(n, arity), level + 1
    (root,) = own.values()
    above: dict[int, tuple[bytes, ...]] = {0: ()}
    for known, here, n in reversed(levels):
        above = {place: tuple(known[i] for i in range(place - place % arity, min(place - place % arity + arity, n)) if i != place) + above[place // arity] for place in here}
    return above, root


def prove(manifest: Manifest, part: int = PART) -> DataFrame:
    """The columns of the rows given, with ``subroot``, ``root`` (hexadecimal text), ``proof`` (the siblings of the leaf,
    level by level to the root, left to right) and ``tree``, ``idx``, ``n``, ``trees``, the leaf's place. New names win.

    A task holds a partition of ``part`` neighbouring leaves and the nodes it fetched, a few for each level.
    """
    spark, arity = manifest.leaves.sparkSession, manifest.arity
    leaves = manifest.leaves.withColumn("part", F.floor(F.col("idx") / part).cast("long"))

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in groups(batches, ("tree", "part")):
            tree, of_part, n, trees = (own.column(c)[0].as_py() for c in ("tree", "part", "n", "trees"))
            wanted = [(tree, level, place) for level, places in missing(own.column("idx").to_numpy(), n, arity) for place in places.tolist()]
            wanted += [(LAST, level, place) for level, places in missing(np.array([tree]), trees, arity) for place in places.tolist()]
            size = len(wanted)
            columns = list(zip(*wanted, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree] * size, pa.int64()), pa.array([of_part] * size, pa.int64()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())],
                names=["of_tree", "part", "tree", "level", "idx"],
            )

    narrow = leaves.select("tree", "part", "idx", "n", "trees").repartition("tree", "part").sortWithinPartitions("tree", "part", "idx")
    wanted = narrow.mapInArrow(coordinates, "of_tree long, part long, tree long, level int, idx long")
    nodes = manifest.nodes.unionByName(manifest.leaves.select("tree", F.lit(0).alias("level"), "idx", "hash"))
    fetched = wanted.join(nodes, ["tree", "level", "idx"]).select(
        F.col("of_tree").alias("tree"), "part", F.lit(0).alias("kind"), F.when(F.col("tree") == LAST, F.col("level") + 1000).otherwise(F.col("level")).alias("level"), "idx", "hash",
        F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("trees"), F.lit(None).cast(leaves.schema["row"].dataType).alias("row"),
    )
    both = fetched.unionByName(leaves.select("tree", "part", F.lit(1).alias("kind"), F.lit(0).alias("level"), "idx", "hash", "n", "trees", "row"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in groups(batches, ("tree", "part")):
            at = int(np.searchsorted(own.column("kind").to_numpy(), 1))
            got: dict[int, dict[int, bytes]] = {}
            for level, place, node in zip(*(own.column(c).slice(0, at).to_pylist() for c in ("level", "idx", "hash")), strict=True):
                got.setdefault(level, {})[place] = node.hex().encode()
            rows = own.slice(at)
            tree, n, trees = (rows.column(c)[0].as_py() for c in ("tree", "n", "trees"))
            places = rows.column("idx").to_pylist()
            proofs, subroot = _proofs({place: node.hex().encode() for place, node in zip(places, rows.column("hash").to_pylist(), strict=True)}, n, got, arity)
            last, root = _proofs({tree: subroot}, trees, {level - 1000: nodes for level, nodes in got.items() if level >= 1000}, arity)
            size = rows.num_rows
            columns = [rows.column(c).combine_chunks() for c in ("row", "tree", "idx", "n", "trees")]
            columns += [pa.array([x.decode()] * size, pa.string()) for x in (subroot, root)]
            columns.append(pa.array([proofs[place] + last[tree] for place in places], pa.list_(pa.binary())).cast(pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, names=["row", "tree", "idx", "n", "trees", "subroot", "root", "proof"])

    schema = T.StructType([leaves.schema["row"], *(T.StructField(c, T.LongType()) for c in ("tree", "idx", "n", "trees")), T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType()), T.StructField("proof", T.ArrayType(T.StringType()))])
    proved = both.repartition("tree", "part").sortWithinPartitions("tree", "part", "kind", "level", "idx").mapInArrow(expand, schema)
    new = schema.names[1:]
    given = [F.col(f"row.`{c}`").alias(c) for c in leaves.schema["row"].dataType.names if c not in new]
    return proved.select(*given, *new)


def fold(proofs: DataFrame, leaf: str, name: str = "folded_root", arity: int = ARITY) -> DataFrame:
    """``proofs`` with the root that the hash in the column ``leaf`` (hexadecimal text) and the siblings of the proof give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = []
            for node, proof, *steps in zip(*(batch.column(c).to_pylist() for c in (leaf, "proof", "idx", "n", "tree", "trees")), strict=True):
                node, at = node.encode(), 0
                for place, n in (steps[:2], steps[2:]):
                    while n > 1:
                        start = place - place % arity
                        size = min(arity, n - start)
                        others = [sibling.encode() for sibling in proof[at : at + size - 1]]
                        others.insert(place - start, node)
                        node, at, place, n = _parent(others), at + size - 1, place // arity, _above(n, arity)
                folded.append(node.decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(folded, pa.string())], names=[*batch.schema.names, name])

    kept = proofs.select(*(c for c in proofs.columns if c != name))
    return kept.mapInArrow(run, T.StructType([*kept.schema, T.StructField(name, T.StringType())]))
