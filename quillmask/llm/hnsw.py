"""Approximate nearest neighbours by largest inner product: a hierarchical
navigable small-world (HNSW) graph per shard, stored as flat neighbour arrays,
with the shards' results merged.

*Index.*  Rows are dealt to shards of about ``shard_rows`` by a hash of their
id; every row is indexed.  Equal vectors of a shard are one node with a list of
ids, so a vector that many rows share neither fills the neighbour lists nor
hides the smaller ids.  A shard is one row: nodes, their ids, and per layer a
flat array of neighbours (-1: none).  The index is a written table.

*Inner products.*  A graph needs a distance, so vectors get one more component
that gives all of a shard the same length; for a query with 0 there, nearest by
Euclidean distance is largest by inner product.

*Building and searching in batches.*  A batch of points is searched in the
graph so far at once (one vectorised best-first beam each), joined by the rest
of its batch, linked to a diverse selection of what it found (a candidate
closer to an already selected neighbour than to the point waits until the end),
and linked back; full neighbour lists are selected anew.

*Searching all shards.*  Queries form blocks of bounded size; every (shard,
block) is one row of an equi-join on the shard, and a query's nearest over all
shards are the first k by score.

Defined results: vectors that are null, zero, of another dimension than most,
or hold a null or a non-finite component take no part, as row or query; ties go
to the smaller id; rows that share the query's id are not its neighbours.
Repeated rows count once; an id of several vectors is one query and one
neighbour, by the best of its pairs.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepared, stored

SHARD_ROWS, BLOCK_ROWS = 8192, 2048
DEGREE, EF_BUILD, EF_SEARCH = 16, 64, 160
BATCH, EXPAND = 256, 4


def valid(vector: Column) -> Column:
    """Not null, not zero, and all components finite."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def distances(points: np.ndarray, ids: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distance of each row of ``to`` to its row of ``ids``, up to a
    constant per row: all points have the same length."""
    return -np.matmul(points[ids], to[:, :, None])[:, :, 0]


def beam(points: np.ndarray, links: np.ndarray, to: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for all rows of ``to`` at once: ids
    (-1: none) and distances of the ``ef`` nearest met, nearest first."""
    q, rows = len(to), np.arange(len(to))[:, None]
    seen = np.zeros((q, len(points) + 1), dtype=bool)           # the last column: no neighbour
    seen[:, -1] = True
    width = max(ef, entry.shape[1])
    ids = np.full((q, width), -1, dtype=np.int64)
    dist = np.full((q, width), np.inf, dtype=np.float32)
    ids[:, :entry.shape[1]] = entry
    dist[:, :entry.shape[1]] = np.where(entry >= 0, distances(points, entry, to), np.inf)
    seen[rows, entry] = True
    order = np.argsort(dist, axis=1)[:, :ef]
    ids, dist = ids[rows, order], dist[rows, order]
    done = ids < 0
    live = np.arange(q)
    while len(live):
        open_ = np.where(done[live], np.inf, dist[live])
        pick = np.argpartition(open_, min(EXPAND, ef) - 1, axis=1)[:, :min(EXPAND, ef)]
        ok = np.isfinite(np.take_along_axis(open_, pick, 1))
        r = live[:, None]
        done[r, pick] = True
        near = np.where(ok[:, :, None], links[ids[r, pick]], -1).reshape(len(live), -1)
        near.sort(axis=1)                                       # a node may be a neighbour of several
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near = np.where(seen[r, near], -1, near)
        seen[r, near] = True
        far = np.where(near >= 0, distances(points, near, to[live]), np.inf).astype(np.float32)
        all_ids, all_dist = np.concatenate([ids[live], near], axis=1), np.concatenate([dist[live], far], axis=1)
        all_done = np.concatenate([done[live], near < 0], axis=1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :ef]
        ids[live], dist[live] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_dist, order, 1)
        done[live] = np.take_along_axis(all_done, order, 1)
        live = live[~done[live].all(axis=1)]
    return ids, dist


def select(points: np.ndarray, of: np.ndarray, cand: np.ndarray, m: int) -> np.ndarray:
    """For each point of ``of`` up to ``m`` diverse candidates (ids, -1: none),
    nearest first, filled up with the nearest that were passed over."""
    dist = np.where(cand >= 0, distances(points, cand, points[of]), np.inf)
    order = np.argsort(dist, axis=1, kind="stable")
    cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
    v = points[cand]
    between = -np.matmul(v, v.transpose(0, 2, 1))
    n, width = cand.shape
    kept, least, count = np.zeros((n, width), dtype=bool), np.full((n, width), np.inf), np.zeros(n, dtype=np.int64)
    for j in range(width):
        take = (cand[:, j] >= 0) & (dist[:, j] < least[:, j]) & (count < m)
        kept[:, j] = take
        count += take
        least = np.where(take[:, None], np.minimum(least, between[:, j]), least)
    rank = np.where(cand < 0, 2 * width, np.where(kept, 0, width) + np.arange(width))
    order = np.argsort(rank, axis=1, kind="stable")[:, :m]
    out = np.take_along_axis(cand, order, 1)
    if width < m:
        out = np.concatenate([out, np.full((n, m - width), -1)], axis=1)
    return out


class Graph:
    """``layers``: per layer a (points x degree) array of neighbours."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray] | None = None, entry: int = 0):
        norm2 = (vectors.astype(np.float64) ** 2).sum(axis=1)
        rest = np.sqrt(np.maximum(norm2.max() - norm2, 0))
        self.points = np.concatenate([vectors, rest[:, None]], axis=1).astype(np.float32)
        self.layers, self.entry = layers or [], entry

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 0) -> "Graph":
        g, n = cls(vectors), len(vectors)
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(DEGREE)).astype(int), 8)
        level[0] = level.max()
        g.layers = [np.full((n, 2 * DEGREE if k == 0 else DEGREE), -1, dtype=np.int32) for k in range(level[0] + 1)]
        at = 1
        while at < n:
            batch = np.arange(at, min(n, at + max(1, min(BATCH, at))))
            g.insert(batch, level)
            at = int(batch[-1]) + 1
        return g

    def descend(self, to: np.ndarray, down_to: int) -> np.ndarray:
        entry = np.full((len(to), 1), self.entry)
        for k in range(len(self.layers) - 1, down_to, -1):
            entry = beam(self.points, self.layers[k], to, entry, 1)[0]
        return entry

    def insert(self, batch: np.ndarray, level: np.ndarray) -> None:
        entry = np.full((len(batch), 1), self.entry)
        for k in range(len(self.layers) - 1, -1, -1):
            links = self.layers[k]
            found = beam(self.points, links, self.points[batch], entry, EF_BUILD if k <= level[batch].max() else 1)[0]
            entry = found[:, :8] if k else found
            on = level[batch] >= k
            own = batch[on]
            if not len(own):
                continue
            # the rest of the batch on this layer, nearest first
            mutual = self.points[own] @ self.points[own].T
            np.fill_diagonal(mutual, -np.inf)
            near = np.argsort(-mutual, axis=1, kind="stable")[:, :min(EF_BUILD // 2, max(len(own) - 1, 0))]
            cand = np.concatenate([found[on], own[near]], axis=1)
            links[own, :DEGREE] = select(self.points, own, cand, DEGREE)
            self.link_back(own, links)

    def link_back(self, own: np.ndarray, links: np.ndarray) -> None:
        """The selected neighbours link back; lists that overflow are selected
        anew."""
        to = links[own, :DEGREE].ravel()
        by = np.repeat(own, DEGREE)[to >= 0]
        to = to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, by = to[order], by[order]
        node, first, n = np.unique(to, return_index=True, return_counts=True)
        cand = np.full((len(node), links.shape[1] + int(n.max(initial=0))), -1, dtype=np.int64)
        cand[:, :links.shape[1]] = links[node]
        cand[np.repeat(np.arange(len(node)), n), links.shape[1] + np.arange(len(to)) - np.repeat(first, n)] = by
        cand.sort(axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        # wide lists (a node that many chose) are rare; they go apart
        used = (cand >= 0).sum(axis=1)
        cand = -np.sort(-cand, axis=1)
        for a, b in ((0, 2 * links.shape[1]), (2 * links.shape[1], cand.shape[1] + 1)):
            some = np.flatnonzero((used > a) & (used <= b))
            for part in np.array_split(some, -(-len(some) // 512)) if len(some) else []:
                width = int(used[part].max())
                links[node[part]] = select(self.points, node[part], cand[part, :width], links.shape[1])

    def search(self, queries: np.ndarray, k: int, ef: int = EF_SEARCH) -> np.ndarray:
        """Positions of the (at least ``k``) nearest of each query; -1: none."""
        to = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        return beam(self.points, self.layers[0], to, self.descend(to, 0), max(ef, k))[0]


def packed(vectors: pd.Series) -> bytes:
    return np.stack(vectors.to_numpy()).astype(np.float64).tobytes()


def index(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row per shard: shard, dim, the nodes' vectors, the ids (node by node,
    ascending) and where each node's begin, and degrees and neighbours of the
    layers, as binary."""
    prepared(rows.sparkSession)
    good = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")) \
        .filter(F.col("vec_id").isNotNull() & valid(F.col("v"))).withColumn("dim", F.size("v"))
    sizes = good.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim, n = (sizes[0]["dim"], sizes[0]["n"]) if sizes else (0, 0)
    shards = max(1, -(-n // shard_rows))
    dealt = good.filter(F.col("dim") == dim).withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        vectors, node = np.unique(np.stack(pdf["v"].to_numpy()), axis=0, return_inverse=True)
        shuffled = np.random.default_rng(1).permutation(len(vectors))
        vectors, node = vectors[shuffled], np.argsort(shuffled)[node.ravel()]
        ids = pdf["vec_id"].to_numpy().astype(np.int64)
        node, ids = np.unique(np.stack([node, ids], axis=1), axis=0).T      # repeated rows are one
        order = np.lexsort((ids, node))
        starts = np.searchsorted(node[order], np.arange(len(vectors) + 1))
        g = Graph.build(vectors)
        return pd.DataFrame({"shard": [key[0]], "dim": [vectors.shape[1]], "vectors": [vectors.tobytes()], "ids": [ids[order].tobytes()],
                             "starts": [starts.astype(np.int64).tobytes()], "degrees": [[x.shape[1] for x in g.layers]],
                             "layers": [[x.tobytes() for x in g.layers]]})

    # one task per shard
    built = dealt.select("shard", "vec_id", "v").repartition(shards, "shard").groupBy("shard").applyInPandas(
        build, "shard int, dim int, vectors binary, ids binary, starts binary, degrees array<int>, layers array<binary>")
    return stored(built, "hnsw")


def search(built: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding",
           ef: int = EF_SEARCH, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` nearest indexed rows of each query: query_id, rank (from 1),
    vec_id, score (inner product)."""
    prepared(built.sparkSession)
    good = queries.select(F.col(vec_id).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v")) \
        .filter(F.col("query_id").isNotNull() & valid(F.col("v"))).withColumn("dim", F.size("v")).dropDuplicates(["query_id", "v"])
    blocks = max(1, -(-good.count() // block_rows))
    good = good.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    packs = good.groupBy("dim", "block").agg(F.collect_list(F.struct("query_id", "v")).alias("queries"))
    keys = built.select("shard", "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    todo = keys.join(packs, ["dim", "block"]).join(built.drop("dim"), "shard")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids, starts = np.frombuffer(r.ids, dtype=np.int64), np.frombuffer(r.starts, dtype=np.int64)
                vectors = np.frombuffer(r.vectors, dtype=np.float64).reshape(len(starts) - 1, r.dim)
                g = Graph(vectors, [np.frombuffer(x, dtype=np.int32).reshape(len(vectors), d) for x, d in zip(r.layers, r.degrees)])
                own = np.array([q["query_id"] for q in r.queries], dtype=np.int64)
                wanted = np.stack([np.asarray(q["v"], dtype=np.float64) for q in r.queries])
                for a in range(0, len(own), BATCH):
                    q = wanted[a:a + BATCH]
                    near = g.search(q, 2 * k, ef)
                    score = np.matmul(vectors[near], q[:, :, None])[:, :, 0]
                    i, j = np.nonzero(near >= 0)
                    # of a node's ids the k + 1 smallest may count
                    first, n = starts[near[i, j]], np.minimum(np.diff(starts)[near[i, j]], k + 1)
                    to = np.repeat(np.arange(len(i)), n)
                    vec = ids[np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(to))]
                    i, value = i[to], score[i, j][to]
                    other = vec != own[a + i]
                    i, vec, value = i[other], vec[other], value[other]
                    # an id that stands in several nodes counts by its best
                    order = np.lexsort((-value, vec, i))
                    i, vec, value = i[order], vec[order], value[order]
                    once = np.concatenate([[True], (i[1:] != i[:-1]) | (vec[1:] != vec[:-1])]) if len(i) else np.zeros(0, dtype=bool)
                    i, vec, value = i[once], vec[once], value[once]
                    order = np.lexsort((vec, -value, i))
                    i, vec, value = i[order], vec[order], value[order]
                    top = np.arange(len(i)) - np.searchsorted(i, i) < k
                    yield pd.DataFrame({"query_id": own[a + i[top]], "vec_id": vec[top], "score": value[top]})

    # a (shard, block) is a task's unit of work
    tasks = max(1, min(2000, blocks * max(1, built.count())))
    found = todo.repartition(tasks, "shard", "block").mapInPandas(find, "query_id long, vec_id long, score double")
    # a query id or a candidate id of several vectors: the best of their pairs
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
