"""Approximate nearest neighbours: NN-descent by Spark joins, then greedy search in the neighbour graph.

Equal vectors are one node, kept with its smallest ids, so a vector that fills a third of the table costs no more than
any other. Nodes that lie next to each other in the order of random projections form a shard of some thousand nodes.
The first neighbour lists come from blocks of a few hundred nodes, in several such orders, of a shard and of the whole
table, so that edges cross shards. Each round then joins every node with the vectors of its neighbours, forward and
reverse, scores the pairs among them (they are neighbours of neighbours), and keeps the best of each node's candidates.
A query visits the shards whose centres are nearest to it, up to PROBES, and searches the edges within each greedily
from its entry nodes, in the worker that holds the shard. From what it finds there, and from its own neighbours, it
then walks the whole graph by joins until its best nodes have all been expanded; these are scored again in double
precision.

Nearness is the cosine in double precision. Vectors that are null, empty, zero, or that hold null or non-finite
components take no part (vectors are compared with those of their own length only); nor do rows with a null id. Of rows with the same id the one with the smallest vector counts.
Ties go to the smaller id. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from streamloom.llm.common import cut, table

#: Neighbours kept, reverse neighbours joined a round, rounds, projections for the first lists, nodes of a block.
K, REVERSE, ROUNDS, TREES, BLOCK = 20, 12, 3, 3, 400
#: Nodes of a shard (more if there would be over MOST_SHARDS), and shards that a query visits.
SHARD, MOST_SHARDS, PROBES = 8000, 20_000, 24
#: Search in a shard: entry nodes, nodes expanded a step, nodes that the beam keeps, and nodes returned.
ENTRIES, EXPAND, BEAM, RETURN = 64, 32, 256, 16
#: Nodes that a query keeps, and expands, in the walk of the whole graph.
FAR = 128
SALTS = 32


def nodes_of(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (double), print (128 bits of the components), for the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.coalesce(ok, F.lit(False))).select("vec_id", F.transform(v, lambda x: x + F.lit(0.0)).alias("vec"))
    rows = rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    text = F.concat_ws(",", F.transform("vec", lambda x: x.cast("string")))
    return rows.select("vec_id", "vec", F.md5(text).alias("print"))


def classes_of(rows: DataFrame, keep: int) -> DataFrame:
    """One row for each distinct vector: node (its smallest id), vec, ids (its ``keep`` smallest), in two salted steps."""
    salted = rows.select("print", "vec_id", "vec", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt"))
    w = Window.partitionBy("print", "salt").orderBy("vec_id")
    few = salted.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= keep)
    return few.groupBy("print").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, keep).alias("ids"), F.min("vec_id").alias("node"), F.min("vec").alias("vec")).drop("print")


def _blocks(k: int):
    """Scores the nodes of each run of BLOCK rows with each other; the rows come in the order of a projection."""

    def edges(ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        s = m @ m.T
        np.fill_diagonal(s, -9)
        top = np.argpartition(-s, min(k, len(ids) - 1) - 1, axis=1)[:, :k] if len(ids) > 1 else np.zeros((1, 0), int)
        best = np.take_along_axis(s, top, axis=1)
        u = np.repeat(ids, top.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(ids[top].ravel().astype(np.int64)), pa.array(best.ravel().astype(np.float32))], names=["u", "w", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vecs: list[bytes] = []
        shard = None

        def drained(n: int) -> pa.RecordBatch:
            out = edges(np.array(ids[:n]), np.stack([np.frombuffer(x, np.float16) for x in vecs[:n]]).astype(np.float32))
            del ids[:n], vecs[:n]
            return out

        for b in batches:
            for i, v, own in zip(b.column("node").to_pylist(), b.column("v").to_pylist(), b.column("shard").to_pylist(), strict=True):
                if ids and own != shard:
                    yield drained(len(ids))
                shard = own
                ids.append(i)
                vecs.append(v)
                if len(ids) >= 2 * BLOCK:
                    yield drained(BLOCK)
        if ids:
            yield drained(len(ids))

    return run


def _coded(trees: int):
    """Adds unit vectors in half precision and, for each tree, a code: the signs of random projections as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, codes, raw = b.column("vec").to_pylist(), [], []
            for x in v:
                x = np.array(x)
                unit = x / np.abs(x).max()
                unit /= np.sqrt(unit @ unit)
                raw.append(unit.astype(np.float16).tobytes())
                planes = np.random.default_rng([7, len(x)]).standard_normal((trees, 24, len(x))) if not codes or len(x) != planes.shape[2] else planes
                codes.append(["".join(map(str, c)) for c in (planes @ unit > 0).astype(int).tolist()])
            dims = [len(x) for x in v]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(raw, pa.binary()), pa.array(dims, pa.int32()), pa.array(codes, pa.list_(pa.string()))], names=["node", "v", "dim", "codes"])

    return run


def best(edges: DataFrame, k: int, parts: int) -> DataFrame:
    """The k best neighbours of each node from rows (u, w, s), each pair once: node, nbrs, sims."""
    once = edges.repartition(parts, "u").groupBy("u", "w").agg(F.max("s").alias("s"))
    top = F.slice(F.sort_array(F.collect_list(F.struct("s", "w")), asc=False), 1, k)
    return once.groupBy("u").agg(top.alias("top")).select(F.col("u").alias("node"), F.col("top.w").alias("nbrs"), F.col("top.s").alias("sims"))


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the members of one node's neighbourhood: every pair that improves a member's list."""
    for b in batches:
        out_u, out_w, out_s = [], [], []
        for members in b.column("members").to_pylist():
            ids = np.array([m["u"] for m in members])
            least = np.array([m["least"] for m in members], np.float32)
            m = np.stack([np.frombuffer(x["v"], np.float16) for x in members]).astype(np.float32)
            s = m @ m.T
            i, j = np.nonzero(s > least[:, None])
            off = ids[i] != ids[j]
            i, j = i[off], j[off]
            out_u.append(ids[i])
            out_w.append(ids[j])
            out_s.append(s[i, j])
        if out_u:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_u).astype(np.int64)), pa.array(np.concatenate(out_w).astype(np.int64)), pa.array(np.concatenate(out_s).astype(np.float32))], names=["u", "w", "s"])


def adjacency(graph: DataFrame, reverse: int, parts: int) -> DataFrame:
    """node, u: forward neighbours and the ``reverse`` nearest of those that have the node as a neighbour."""
    forward = graph.select("node", F.explode(F.arrays_zip("nbrs", "sims")).alias("e")).select("node", F.col("e.nbrs").alias("u"), F.col("e.sims").alias("s"))
    back = best(forward.select(F.col("u").alias("x"), F.col("node").alias("w"), "s").withColumnRenamed("x", "u"), reverse, parts)
    back = back.select("node", F.explode("nbrs").alias("u"))
    return forward.select("node", "u").unionByName(back).distinct()


def sharded(nodes: DataFrame) -> DataFrame:
    """node, v (half precision, unit length), dim, codes, shard: shards are ranges in the order of the first projection."""
    n = nodes.count()
    parts = max(1, -(-n // max(SHARD, n // MOST_SHARDS)))
    coded = nodes.select("node", "vec").mapInArrow(_coded(TREES), "node long, v binary, dim int, codes array<string>")
    ranged = cut(coded).withColumn("code", F.col("codes")[0]).repartitionByRange(parts, "dim", "code", "node")
    return cut(ranged.withColumn("shard", F.col("dim") * F.lit(1 << 32) + F.spark_partition_id()).drop("code"))


def build_graph(coded: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """node, nbrs, sims: approximate neighbour lists by NN-descent, across shards."""
    n = coded.count()
    parts = max(6, min(2000, -(-n // SHARD)))
    orders = []
    for t in range(TREES):
        orders.append(coded.select("node", "v", "shard", F.col("codes")[t].alias("code")).repartition(parts, "shard").sortWithinPartitions("shard", "code", "node"))
        if t and n > SHARD:  # the shards are ranges in the first order
            orders.append(coded.select("node", "v", F.col("dim").cast("long").alias("shard"), F.col("codes")[t].alias("code")).repartitionByRange(parts, "shard", "code", "node").sortWithinPartitions("shard", "code", "node"))
    edges = reduce(DataFrame.unionByName, [o.mapInArrow(_blocks(k), "u long, w long, s float") for o in orders])
    graph = cut(best(edges, k, parts))
    vectors = coded.select("node", "v")
    for _ in range(rounds):
        least = graph.select("node", F.when(F.size("sims") < k, F.lit(-2.0)).otherwise(F.array_min("sims")).cast("float").alias("least"))
        known = vectors.join(least, "node").select(F.col("node").alias("u"), "v", "least")
        pairs = adjacency(graph, REVERSE, parts).unionByName(graph.select("node", F.col("node").alias("u")))
        around = pairs.join(known, "u").repartition(parts * 4, "node").groupBy("node").agg(F.collect_list(F.struct("u", "v", "least")).alias("members"))
        new = around.mapInArrow(_local, "u long, w long, s float")
        old = graph.select(F.col("node").alias("u"), F.explode(F.arrays_zip("nbrs", "sims")).alias("e")).select("u", F.col("e.nbrs").alias("w"), F.col("e.sims").alias("s"))
        graph = cut(best(new.unionByName(old), k, parts))
    return graph


def half(column: pa.ChunkedArray) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float16).reshape(len(raw), -1).astype(np.float32)


def walk(m: np.ndarray, links: np.ndarray, q: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search from the entries: nodes and scores of the beam. links: (nodes, degree), -1 where there are fewer."""
    seen = np.zeros(len(m) + 1, bool)
    seen[-1] = True  # index -1
    seen[entries] = True
    ids, sims, done = entries, m[entries] @ q, np.zeros(len(entries), bool)
    while True:
        order = np.argsort(-sims, kind="stable")[:BEAM]
        ids, sims, done = ids[order], sims[order], done[order]
        turn = np.nonzero(~done)[0][:EXPAND]
        if not len(turn):
            return ids, sims
        done[turn] = True
        new = np.unique(links[ids[turn]])
        new = new[~seen[new]]
        seen[new] = True
        ids, sims, done = np.concatenate([ids, new]), np.concatenate([sims, m[new] @ q]), np.concatenate([done, np.zeros(len(new), bool)])


def _visit(key, shard, queries):
    """All queries that visit one shard, in its graph."""
    empty = pa.table({"query": pa.array([], pa.int64()), "node": pa.array([], pa.int64())})
    if not shard.num_rows or not queries.num_rows:
        return empty
    nodes, m = shard.column("node").to_numpy(), half(shard.column("v"))
    order = np.argsort(nodes)
    lists = shard.column("links").to_pylist()
    links = np.full((len(nodes), max(map(len, lists)) or 1), -1, np.int64)
    for i, x in enumerate(lists):
        place = order[np.minimum(np.searchsorted(nodes, x, sorter=order), len(nodes) - 1)]
        place = place[nodes[place] == x]  # the others lie in other shards
        links[i, : len(place)] = place
    entries = order[np.linspace(0, len(nodes) - 1, min(ENTRIES, len(nodes))).astype(int)]
    at = {int(x): i for i, x in enumerate(nodes)}
    out_q, out_n = [], []
    for query, q in zip(queries.column("query").to_pylist(), half(queries.column("q")), strict=True):
        own = np.unique(np.append(entries, at[query])) if query in at else entries
        ids = walk(m, links, q, own)[0][:RETURN]
        out_q.append(np.full(len(ids), query))
        out_n.append(nodes[ids])
    return pa.table({"query": np.concatenate(out_q).astype(np.int64), "node": np.concatenate(out_n).astype(np.int64)})


def routed(coded: DataFrame, queries: DataFrame) -> DataFrame:
    """query, q, shard: the PROBES shards with the nearest centres. The centres (MOST_SHARDS at most) are broadcast."""

    def centre(key, rows):
        v = half(rows.column("v")).mean(axis=0)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "c": pa.array([v.astype(np.float32).tobytes()], pa.binary())})

    rows = coded.select("shard", "v").groupBy("shard").applyInArrow(centre, "shard long, c binary").orderBy("shard").collect()
    centres = coded.sparkSession.sparkContext.broadcast([(r["shard"], bytes(r["c"])) for r in rows])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in {len(c) for _, c in centres.value}:
            own = [(s, c) for s, c in centres.value if len(c) == dim]
            by[dim // 4] = np.array([s for s, _ in own]), np.stack([np.frombuffer(c, np.float32) for _, c in own])
        for b in batches:
            out: list[tuple] = []
            for query, v in zip(b.column("query").to_pylist(), b.column("q").to_pylist(), strict=True):
                q = np.frombuffer(v, np.float16).astype(np.float32)
                shards, c = by[len(q)]
                out += [(query, v, s) for s in shards[np.argsort(-(c @ q), kind="stable")[:PROBES]].tolist()]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["query", "q", "shard"])

    return queries.mapInArrow(route, "query long, q binary, shard long")


def scaled(x) -> Column:
    """The vector times the power of two that brings its largest component near one: no product can overflow or vanish, and no digit changes."""
    top = F.array_max(F.transform(x, lambda p: F.abs(p)))
    power = F.greatest(F.least(F.floor(F.log2(top)), F.lit(1000)), F.lit(-1000))
    return F.transform(x, lambda p: p * F.pow(F.lit(2.0), -power))


def cosine(a: str, b: str):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, p: acc + p)
    return dot(F.col(a), F.col(b)) / F.sqrt(dot(F.col(a), F.col(a))) / F.sqrt(dot(F.col(b), F.col(b)))


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (query, q, node, v), vectors in half precision: query, node, s."""
    for b in batches:
        q, v = b.column("q").to_pylist(), b.column("v").to_pylist()
        sizes, s = np.fromiter(map(len, q), np.int64, len(q)), np.zeros(len(q))
        for size in np.unique(sizes):
            own = np.nonzero(sizes == size)[0]
            x, y = (np.frombuffer(b"".join(c[i] for i in own), np.float16).reshape(len(own), -1).astype(np.float64) for c in (q, v))
            s[own] = np.einsum("ij,ij->i", x, y)
        yield pa.RecordBatch.from_arrays([b.column("query"), b.column("node"), pa.array(s, pa.float64())], names=["query", "node", "s"])


def walked(links: DataFrame, vectors: DataFrame, asked: DataFrame, start: DataFrame) -> DataFrame:
    """query, node: the FAR best nodes that each query reaches from ``start`` (query, node) over links (node, links)."""
    own = Window.partitionBy("query").orderBy(F.desc("s"), "node")
    new, state = start.distinct(), None
    while True:
        rows = new.join(vectors, "node").join(asked, "query").select("query", "q", "node", "v").mapInArrow(_scored, "query long, node long, s double").withColumn("done", F.lit(False))
        rows = rows if state is None else rows.unionByName(state.withColumn("done", F.lit(True)))
        state = cut(rows.withColumn("at", F.row_number().over(own)).filter(F.col("at") <= FAR).drop("at"))
        turn = state.filter(~F.col("done"))
        if turn.isEmpty():
            return state.select("query", "node")
        new = turn.join(links, "node").select("query", F.explode("links").alias("node")).distinct().join(state.select("query", "node"), ["query", "node"], "left_anti")


def search(nodes: DataFrame, coded: DataFrame, graph: DataFrame, queries: DataFrame) -> DataFrame:
    """query, node, score: the nodes that greedy search finds for each query (a node), scored exactly."""
    asked = queries.join(coded.select("node", "v"), "node").select(F.col("node").alias("query"), F.col("v").alias("q"))
    parts = max(6, min(2000, -(-coded.count() // SHARD)))
    links = cut(adjacency(graph, K, parts).groupBy("node").agg(F.collect_list("u").alias("links")))
    held = coded.select("shard", "node", "v").join(links, "node", "left").select("shard", "node", "v", F.coalesce("links", F.array().cast("array<bigint>")).alias("links"))
    found = held.groupBy("shard").cogroup(routed(coded, asked).groupBy("shard")).applyInArrow(_visit, "query long, node long")
    found = found.unionByName(queries.select("node").join(links, "node").select(F.col("node").alias("query"), F.explode("links").alias("node")))
    found = walked(links, coded.select("node", "v"), asked, found)
    vecs = nodes.select("node", scaled(F.col("vec")).alias("vec"))
    found = found.join(vecs, "node").join(vecs.select(F.col("node").alias("query"), F.col("vec").alias("q")), "query")
    return cut(found.select("query", "node", cosine("q", "vec").alias("score")))


def nearest(vectors: DataFrame, modulus: int, top: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest rows found for each row whose id is divisible by ``modulus``."""
    rows = cut(nodes_of(vectors))
    nodes = cut(classes_of(rows, top + 1))
    coded = sharded(nodes)
    graph = build_graph(coded)
    asked = rows.filter(F.col("vec_id") % modulus == 0).select(F.col("vec_id").alias("query_id"), "print")
    node_of = rows.groupBy("print").agg(F.min("vec_id").alias("query"))
    asked = asked.join(node_of, "print").select("query_id", "query")
    found = search(nodes, coded, graph, asked.select(F.col("query").alias("node")).distinct())
    own = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    found = found.withColumn("at", F.row_number().over(own)).filter(F.col("at") <= top + 1).drop("at")
    members = found.join(nodes.select("node", "ids"), "node").select("query", F.explode("ids").alias("vec_id"), "score")
    # No query needs more than the best top + 1 of its node's candidates: its own row is one of them at most.
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    few = members.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= top + 1).drop("at")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = asked.join(few, "query").filter("query_id != vec_id").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return out.select("query_id", "rank", "vec_id", "score")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), 50)
