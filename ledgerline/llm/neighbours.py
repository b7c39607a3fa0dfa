"""Nearest neighbours by largest inner product: a robust-pruned directed graph for each shard, searched by beam.

Vectors are made equally long by one more component, so that the largest inner product is the smallest distance.
A shard's graph grows by batches: a greedy search proposes neighbours for each new vector, pruning keeps those
that no kept neighbour is much nearer to, and edges are added in both directions. Every query is searched for in
every shard, and the shards' answers are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerline.session import fresh_path, write_and_read

SHARD_ROWS = 8192
QUERY_BLOCK = 8192
DEGREE = 32
BEAM = 128
SEARCH_BEAM = 192
RELAXED = 1.2**2  # of squared distances
BATCH = 512
ENTRIES = 32
EXPAND = 4


class Graph:
    """Vectors of one length (rows), their out-edges (``-1``: none) and where searches begin."""

    def __init__(self, points: np.ndarray, edges: np.ndarray, entries: np.ndarray):
        self.points, self.edges, self.entries = points, edges, entries

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ``beam`` best found: numbers (``-1``: none) and inner products, best first.

        All queries advance together. In each step a query opens the best nodes of its beam that are not open
        yet; it ends when all are.
        """
        n_queries, n = len(queries), len(self.points)
        ids = np.full((n_queries, beam), -1, np.int64)
        near = np.full((n_queries, beam), -np.inf, np.float32)
        opened = np.zeros((n_queries, beam), bool)
        seen = np.zeros((n_queries, n), bool)
        first = np.broadcast_to(self.entries, (n_queries, len(self.entries)))
        rows = np.arange(n_queries)
        fresh = first
        while True:
            keep = fresh >= 0
            row_at, column = np.nonzero(keep)
            node = fresh[row_at, column]
            new = ~seen[rows[row_at], node]
            row_at, column, node = row_at[new], column[new], node[new]
            seen[rows[row_at], node] = True
            score = np.full(fresh.shape, -np.inf, np.float32)
            score[row_at, column] = np.einsum("ij,ij->i", queries[rows[row_at]], self.points[node])
            both = np.concatenate([near[rows], score], axis=1)
            best = np.argsort(-both, axis=1, kind="stable")[:, :beam]
            near[rows] = np.take_along_axis(both, best, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(np.isfinite(score), fresh, -1)], axis=1), best, 1)
            opened[rows] = np.take_along_axis(np.concatenate([opened[rows], np.zeros(fresh.shape, bool)], axis=1), best, 1)
            waiting = ~opened & (ids >= 0)
            rows = np.flatnonzero(waiting.any(axis=1))
            if not len(rows):
                return ids, near
            place = np.argsort(~waiting[rows], axis=1, kind="stable")[:, :EXPAND]
            real = np.take_along_axis(waiting[rows], place, 1)
            np.put_along_axis(mask := opened[rows], place, True, 1)
            opened[rows] = mask
            nodes = np.where(real, np.take_along_axis(ids[rows], place, 1), -1)
            fresh = np.where(nodes[:, :, None] >= 0, self.edges[nodes], -1).reshape(len(rows), -1)
            fresh.sort(axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1


def robust_prune(points: np.ndarray, owners: np.ndarray, candidates: np.ndarray, degree: int, relaxed: float, norm: float) -> np.ndarray:
    """For each owner the candidates (``-1``: none) to link with: nearest first, without those that a chosen one
    is nearer to, by the factor ``relaxed``, than the owner is."""
    own = points[owners]
    vectors = points[candidates]
    to_owner = norm - np.einsum("ij,ikj->ik", own, vectors)
    to_owner[(candidates < 0) | (candidates == owners[:, None])] = np.inf
    order = np.argsort(to_owner, axis=1, kind="stable")
    candidates, to_owner = np.take_along_axis(candidates, order, 1), np.take_along_axis(to_owner, order, 1)
    vectors = np.take_along_axis(vectors, order[:, :, None], 1)
    alive = np.isfinite(to_owner)
    alive[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    chosen = np.full((len(owners), degree), -1, np.int64)
    rows = np.arange(len(owners))
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        pick = alive.argmax(axis=1)
        chosen[some, k] = candidates[rows[some], pick[some]]
        between = norm - np.einsum("ij,ikj->ik", vectors[rows, pick], vectors)
        alive &= relaxed * between > to_owner
        alive[rows, pick] = False
    return chosen


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relaxed: float = RELAXED, batch: int = BATCH) -> Graph:
    """The graph over distinct vectors of equal length (rows, float32)."""
    n = len(points)
    norm = float(np.einsum("ij,ij->i", points, points).max()) if n else 0.0
    order = np.random.default_rng(7).permutation(n)
    edges = np.full((n, degree), -1, np.int64)
    graph = Graph(points, edges, order[:ENTRIES])
    done = min(n, degree)
    for node in order[:done]:
        others = order[:done][order[:done] != node]
        edges[node, : len(others)] = others
    while done < n:
        new = order[done : done + min(batch, done)]
        found, _ = graph.search(points[new], beam)
        edges[new] = robust_prune(points, new, found, degree, relaxed, norm)
        _link_back(graph, new, degree, relaxed, norm)
        done += len(new)
    longest = np.argsort(np.abs(points[:, -1]), kind="stable")[:ENTRIES]  # answers to many queries, if lengths differ
    graph.entries = np.unique(np.concatenate([graph.entries, longest]))
    graph.entries = np.concatenate([graph.entries, _unreached(graph)])
    return graph


def _link_back(graph: Graph, new: np.ndarray, degree: int, relaxed: float, norm: float) -> None:
    """Adds edges from the neighbours of new nodes to them; full lists are pruned anew."""
    target = graph.edges[new]
    source = np.broadcast_to(new[:, None], target.shape)[target >= 0]
    target = target[target >= 0]
    order = np.lexsort((-np.einsum("ij,ij->i", graph.points[source], graph.points[target]), target))
    source, target = source[order], target[order]
    nodes, first, n_new = np.unique(target, return_index=True, return_counts=True)
    nth = np.arange(len(target)) - np.repeat(first, n_new)
    used = (graph.edges[nodes] >= 0).sum(axis=1)
    fits = used + n_new <= degree
    slot = np.repeat(used, n_new) + nth
    free = np.repeat(fits, n_new)
    graph.edges[target[free], slot[free]] = source[free]
    full = np.flatnonzero(~fits)
    number = np.full(len(nodes), -1)
    number[full] = np.arange(len(full))
    row = number[np.repeat(np.arange(len(nodes)), n_new)]
    nearest = (row >= 0) & (nth < 2 * degree)
    proposed = np.full((len(full), 2 * degree), -1, np.int64)
    proposed[row[nearest], nth[nearest]] = source[nearest]
    for at in range(0, len(full), BATCH):
        some = nodes[full[at : at + BATCH]]
        candidates = np.concatenate([graph.edges[some], proposed[at : at + BATCH]], axis=1)
        graph.edges[some] = robust_prune(graph.points, some, candidates, degree, relaxed, norm)


def _unreached(graph: Graph) -> np.ndarray:
    """A node of each part of the graph that no path from the entries leads to."""
    reached = np.zeros(len(graph.points), bool)
    extra = []

    def spread(front: np.ndarray) -> None:
        while len(front):
            reached[front] = True
            beyond = np.unique(graph.edges[front])
            front = beyond[(beyond >= 0) & ~reached[beyond]]

    spread(graph.entries)
    while not reached.all():
        node = int(reached.argmin())
        extra.append(node)
        spread(np.array([node]))
    return np.array(extra, np.int64)


def _equal_length(vectors: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest - np.einsum("ij,ij->i", vectors.astype(np.float64), vectors.astype(np.float64)), 0))
    return np.concatenate([vectors, rest[:, None]], axis=1).astype(np.float32)


def usable(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``v`` (array of double), ``k1``, ``k2`` (128 bits of it): the rows that take part, repeated ones once."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double") + F.lit(0.0))
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    return rows.withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(1), "v")).dropDuplicates(["vec_id", "k1", "k2"])


def build_index(classes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each shard of distinct vectors (``k1``, ``k2``, ``first``, their smallest id, ``v``): keys, vectors, edges and entries, stored.

    Vectors of each length (``width``) have shards of their own, of about ``shard_rows`` vectors, dealt by hash,
    however many there are in all.
    """
    sized = classes.withColumn("width", F.size("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    widths = sized.groupBy("width").agg(F.ceil(F.count("*") / shard_rows).alias("n_shards"), F.max(square).alias("longest"))
    shard = F.pmod(F.xxhash64("k1", "k2", F.lit(3)), F.col("n_shards")).cast("int").alias("shard")
    kept = sized.join(F.broadcast(widths), "width").select("width", shard, "k1", "k2", "first", "v", "longest")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("k1", "ascending"), ("k2", "ascending")])
        vectors = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        graph = build_graph(_equal_length(vectors, table["longest"][0].as_py() * (1 + 1e-9)))
        keys = np.stack([table[name].to_numpy() for name in ("k1", "k2", "first")], axis=1)
        parts = {"keys": keys, "vectors": vectors, "edges": graph.edges.astype(np.int32), "entries": graph.entries.astype(np.int32)}
        return pa.table({"width": table["width"][:1], "shard": table["shard"][:1], "n": pa.array([len(table)], pa.int64()), **{name: pa.array([part.tobytes()], pa.binary()) for name, part in parts.items()}})

    built = kept.groupBy("width", "shard").applyInArrow(run, "width int, shard int, n long, keys binary, vectors binary, edges binary, entries binary")
    return write_and_read(built, fresh_path(classes.sparkSession, "graph-index"))


def search_index(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """``query_id``, ``k1``, ``k2``, ``first``, ``score``: the ``k`` best vectors of each shard for each query (``query_id``, ``v``).

    Of vectors with equal scores those with the smaller ``first`` are better.

    Queries meet the shards of their own length. Blocks of queries meet shards one of each in a task, whatever the
    number of queries.
    """
    spark = index.sparkSession
    sized = queries.withColumn("width", F.size("v"))
    widths = F.broadcast(sized.groupBy("width").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("n_blocks")))
    block = F.pmod(F.xxhash64("query_id", F.lit(5)), F.col("n_blocks")).cast("int")
    asked = sized.join(widths, "width").select("width", "query_id", "v", block.alias("block"))
    own = F.broadcast(index.select(F.col("width").alias("own_width"), F.col("shard").alias("own_shard")))
    asked = asked.join(own, F.col("width") == F.col("own_width")).select("own_width", "own_shard", F.col("block").alias("own_block"), "query_id", "v")
    shards = index.join(widths, "width").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks").cast("int") - 1))).drop("n_blocks")

    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("score", pa.float64())])
        if not len(shard) or not len(block):
            return schema.empty_table()
        n = shard["n"][0].as_py()
        vectors = np.frombuffer(shard["vectors"][0].as_py()).reshape(n, -1)
        keys = np.frombuffer(shard["keys"][0].as_py(), np.int64).reshape(n, 3)
        edges = np.frombuffer(shard["edges"][0].as_py(), np.int32).reshape(n, -1)
        longest = float(np.einsum("ij,ij->i", vectors, vectors).max())
        graph = Graph(_equal_length(vectors, longest), edges.astype(np.int64), np.frombuffer(shard["entries"][0].as_py(), np.int32).astype(np.int64))
        asked = block["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(block), -1)
        number = block["query_id"].to_numpy()
        out = []
        for at in range(0, len(asked), BATCH):
            part = asked[at : at + BATCH]
            flat = np.concatenate([part, np.zeros((len(part), 1))], axis=1).astype(np.float32)
            found, _ = graph.search(flat, max(beam, k))
            row, column = np.nonzero(found >= 0)
            node = found[row, column]
            score = (part[row] * vectors[node]).sum(axis=1)
            order = np.lexsort((keys[node, 2], -score, row))
            row, node, score = row[order], node[order], score[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append(pa.table([number[at + row[best]], keys[node[best], 0], keys[node[best], 1], keys[node[best], 2], score[best]], schema=schema))
        return pa.concat_tables(out)

    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("first", T.LongType()), T.StructField("score", T.DoubleType())])
    pairs = shards.groupBy("width", "shard", "block").cogroup(asked.groupBy("own_width", "own_shard", "own_block"))
    return write_and_read(pairs.applyInArrow(run, schema), fresh_path(spark, "graph-found"))


def nearest(embeddings: DataFrame, is_query, k: int = 20, beam: int = SEARCH_BEAM, shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each row that is a query its ``k`` nearest others found.

    ``is_query`` is a condition on ``vec_id``. Nearness is the inner product in double precision of the given
    vectors; of equal ones the smaller id comes first. Every usable row is indexed. Rows take no part if they
    have no id or their vector is null, zero, or holds a null or a component that is not finite. Vectors of
    different lengths have no inner product: each length is indexed and searched by itself. Equal vectors are one
    node of a graph and expand to their ids, of which the smallest k + 1 are enough for any answer. Of vectors with one id the nearest counts. With fewer than ``k`` others all that
    are found are returned; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    rows = write_and_read(usable(embeddings, id_col, vector_col), fresh_path(spark, "vectors"))
    by_id = Window.partitionBy("k1", "k2").orderBy("vec_id")
    members = rows.select("k1", "k2", "vec_id").withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1)
    members = write_and_read(members, fresh_path(spark, "vector-members"))
    firsts = members.where("nth = 1").drop("nth")
    classes = rows.join(firsts, ["vec_id", "k1", "k2"]).select("k1", "k2", F.col("vec_id").alias("first"), "v")
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v")
    found = search_index(build_index(classes, shard_rows), queries, k + 1, beam)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "k1", "k2")
    found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth")
    hits = found.join(members.drop("nth"), ["k1", "k2"]).where("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return hits.select("query_id", "rank", "vec_id", "score")
