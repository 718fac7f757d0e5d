"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, stored as flat neighbour arrays.

Vectors that are equal stand in the graph once, with the smallest ids that hold them (``k`` + 1 of them, since a
query needs ``k`` beside itself). Shards are dealt by a hash of the id and hold a bounded number of vectors, so
building needs one pass and its cost grows with the input. Queries stream past every shard; each
returns its ``k`` best with exact distances, and the best of all shards remain.

Defined results: vectors that are null, zero, empty, or hold null or non-finite components take no part;
vectors are compared as doubles and with those of equal length only; queries without an id take no part; rows that repeat an id with one vector count once; with fewer
candidates than ``k``, all are returned; an empty table or one without usable vectors gives no rows; other columns are not read and may have any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from postgrove.llm.common import read_table, stored

ROWS_PER_SHARD = 4096
LINKS, WIDTH_BUILD, WIDTH_SEARCH = 12, 48, 64
#: Tasks that a graph goes to at most.
COPIES = 4


class Graph:
    """Layer 0 is an array of 2 * LINKS neighbours for each vector (-1: none). ``upper`` has for each higher layer the
    vectors in it and LINKS neighbours for each."""

    def __init__(self, vectors: np.ndarray, base: np.ndarray, upper: list[tuple[np.ndarray, np.ndarray]], entry: int):
        self.vectors, self.base, self.upper, self.entry = vectors, base, upper, entry
        self.seen, self.round = np.zeros(len(vectors), dtype=np.int64), 0
        self.rows = [{int(v): k for k, v in enumerate(nodes)} for nodes, _ in upper]

    def around(self, layer: int, node: int) -> np.ndarray:
        found = self.base[node] if layer == 0 else self.upper[layer - 1][1][self.rows[layer - 1][node]]
        return found[found >= 0]

    def distances(self, query: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        gap = self.vectors[nodes] - query
        return np.einsum("ij,ij->i", gap, gap)

    def walk(self, query: np.ndarray, starts: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        """The ``width`` nearest that a best-first walk meets, with squared distances, nearest first."""
        self.round += 1
        seen, mark = self.seen, self.round
        seen[[node for _, node in starts]] = mark
        open_, best = list(starts), [(-d, node) for d, node in starts]
        heapq.heapify(open_)
        heapq.heapify(best)
        while open_:
            d, node = heapq.heappop(open_)
            if d > -best[0][0] and len(best) >= width:
                break
            near = self.around(layer, node)
            near = near[seen[near] != mark]
            if not len(near):
                continue
            seen[near] = mark
            for far, other in zip(self.distances(query, near).tolist(), near.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (-far, other))
                    heapq.heappush(open_, (far, other))
                elif far < -best[0][0]:
                    heapq.heapreplace(best, (-far, other))
                    heapq.heappush(open_, (far, other))
        return sorted((-d, node) for d, node in best)

    def search(self, query: np.ndarray, width: int) -> list[tuple[float, int]]:
        if not len(self.vectors):
            return []
        at = [(float(self.distances(query, np.array([self.entry]))[0]), self.entry)]
        for layer in range(len(self.upper), 0, -1):
            at = self.walk(query, at, 1, layer)
        return self.walk(query, at, width, 0)


def spread(vectors: np.ndarray, near: list[tuple[float, int]], most: int) -> list[int]:
    """Up to ``most`` of ``near`` (nearest first) that are nearer to the centre than to any chosen before; then the nearest left over."""
    nodes = [node for _, node in near]
    points = vectors[nodes]
    norms = np.einsum("ij,ij->i", points, points)
    apart = (norms[:, None] + norms[None, :] - 2 * points @ points.T).tolist()
    chosen, rest = [], []
    for k, (d, _) in enumerate(near):
        if len(chosen) == most:
            break
        row = apart[k]
        (chosen if all(row[j] > d for j in chosen) else rest).append(k)
    return [nodes[k] for k in (chosen + rest)[:most]]


def build(vectors: np.ndarray, ids: np.ndarray, links: int = LINKS, width: int = WIDTH_BUILD) -> Graph:
    """The graph of ``vectors``; heights are drawn from a generator seeded by the first id, so a rebuilt shard is the same."""
    n = len(vectors)
    draw = np.random.Generator(np.random.PCG64(abs(int(ids[0])) if n else 0))
    height = np.floor(-np.log(draw.random(n)) / np.log(links)).astype(int)
    layers = int(height.max()) if n else 0
    base = np.full((n, 2 * links), -1, dtype=np.int32)
    upper = [(np.flatnonzero(height >= layer).astype(np.int32), None) for layer in range(1, layers + 1)]
    upper = [(nodes, np.full((len(nodes), links), -1, dtype=np.int32)) for nodes, _ in upper]
    graph = Graph(vectors, base, upper, 0)
    top = int(height[0]) if n else 0
    for node in range(1, n):
        query = vectors[node]
        at = [(float(graph.distances(query, np.array([graph.entry]))[0]), graph.entry)]
        for layer in range(top, int(height[node]), -1):
            at = graph.walk(query, at, 1, layer)
        for layer in range(min(top, int(height[node])), -1, -1):
            at = graph.walk(query, at, width, layer)
            table, row = (base, lambda x: x) if layer == 0 else (upper[layer - 1][1], graph.rows[layer - 1].__getitem__)
            for other in (chosen := spread(vectors, at, links)):
                held = table[row(other)]
                free = np.flatnonzero(held < 0)
                if len(free):
                    held[free[0]] = node
                else:
                    around = np.append(held, node)
                    away = graph.distances(vectors[other], around)
                    order = np.argsort(away, kind="stable")
                    kept = spread(vectors, list(zip(away[order].tolist(), around[order].tolist())), len(held))
                    held[: len(kept)] = kept
            table[row(node), : len(chosen)] = chosen
        if height[node] > top:
            top, graph.entry = int(height[node]), node
    return graph


def usable(vector: str = "embedding"):
    """True for vectors that take part."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


GRAPH = "dim int, shard int, vectors binary, base binary, layers array<binary>, links array<binary>, entry int, ids array<array<long>>"


def index(vectors: DataFrame, k: int = 10, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """One row per shard of ``vectors`` (vec_id, embedding) with its graph; every usable vector is in it."""
    held = vectors.where(usable()).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).distinct()
    ranked = held.withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    groups = stored(ranked.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")
    shards = max(1, -(-groups.count() // rows_per_shard))
    dealt = groups.select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int").alias("shard"), "embedding", "ids")

    def make(table: pa.Table) -> pa.Table:
        ids = table.column("ids").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: ids[i][0])
        x = np.array(table.column("embedding").combine_chunks().values, dtype=np.float64).reshape(len(ids), -1)[order]
        graph = build(x, np.array([ids[i][0] for i in order]))
        row = {
            "dim": table.column("dim")[0].as_py(), "shard": table.column("shard")[0].as_py(), "vectors": packed(x), "base": graph.base.tobytes(),
            "layers": [nodes.tobytes() for nodes, _ in graph.upper], "links": [links.tobytes() for _, links in graph.upper], "entry": graph.entry, "ids": [ids[i] for i in order],
        }
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.int32(), pa.list_(pa.list_(pa.int64()))]
        return pa.table([pa.array([v], t) for v, t in zip(row.values(), kinds)], list(row))

    # More partitions than shards, so that few shards share a task; a count given here is not coalesced by size.
    return stored(dealt.repartition(3 * shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(make, GRAPH), "graphs")


def packed(x: np.ndarray) -> bytes:
    """Vectors as bytes, of four a component where these hold them exactly and of eight where not."""
    with np.errstate(over="ignore"):
        short = x.astype("<f4")
    return (short if (short == x).all() else x.astype("<f8")).tobytes()


def lengths(gaps: np.ndarray) -> np.ndarray:
    """The Euclidean length of each row, also where squares would leave the range of doubles."""
    with np.errstate(over="ignore", under="ignore"):
        out = np.sqrt((gaps**2).sum(axis=1))
        odd = ~np.isfinite(out) | (out < 1e-150)
        if odd.any():
            most = np.abs(gaps[odd]).max(axis=1, keepdims=True)
            most[most == 0] = 1
            out[odd] = most[:, 0] * np.sqrt(((gaps[odd] / most) ** 2).sum(axis=1))
    return out


def nearest(queries: DataFrame, graphs: DataFrame, k: int = 10, width: int = WIDTH_SEARCH, block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest to each of ``queries`` (query_id, embedding), itself left out.

    Every query goes to every shard of its length. A task gets a graph once, ahead of the queries, which then stream past it; from ``block`` queries on
    a graph goes to several tasks, at most ``COPIES``, so what is exchanged of graphs grows with the index alone. No graph is broadcast."""
    asked = queries.where(usable() & F.col("query_id").isNotNull()).select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).distinct()
    parts = max(1, min(COPIES, -(-asked.count() // block)))
    shards = graphs.select("dim", "shard")
    tasks = 3 * parts * max(1, shards.count())  # more than there are groups, so that few meet in a task
    dealt = asked.select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), "query_id", "embedding").join(shards, "dim")
    held = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("dim", "shard", "part", F.struct("vectors", "base", "layers", "links", "entry", "ids").alias("graph"))
    met = held.unionByName(dealt, allowMissingColumns=True).repartition(tasks, "dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", F.col("graph").isNull())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, ids, names, kinds = None, [], ("query_id", "vec_id", "score"), (pa.int64(), pa.int64(), pa.float64())
        for batch in batches:
            out = []
            for dim, loaded, own, vector in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("dim", "graph", "query_id", "embedding"))):
                if loaded.is_valid:
                    raw, base, layers, links, entry, ids = (loaded[c] for c in ("vectors", "base", "layers", "links", "entry", "ids"))
                    raw, ids = raw.as_py(), ids.as_py()
                    x = np.frombuffer(raw, dtype="<f4" if len(raw) == 4 * dim.as_py() * len(ids) else "<f8").reshape(-1, dim.as_py()).astype(np.float64)
                    upper = [(np.frombuffer(a, dtype=np.int32), np.frombuffer(b, dtype=np.int32).reshape(-1, LINKS)) for a, b in zip(layers.as_py(), links.as_py())]
                    graph = Graph(x, np.frombuffer(base.as_py(), dtype=np.int32).reshape(-1, 2 * LINKS), upper, entry.as_py())
                    continue
                query, own = vector.values.to_numpy(), own.as_py()
                nodes = [node for _, node in graph.search(query, width)]
                found = [(d, v) for node, d in zip(nodes, lengths(graph.vectors[nodes] - query).tolist()) for v in ids[node] if v != own]
                out += [(own, v, d) for d, v in heapq.nsmallest(k, found)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), kinds)], names)

    hits = met.mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest to every vector of ``embeddings`` whose id is divisible by 100, among all others."""
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), "embedding").where("vec_id IS NOT NULL")
    return nearest(rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), index(rows))
