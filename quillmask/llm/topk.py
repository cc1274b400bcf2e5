"""Exact top-k search by integer inner product.

*Vectors.*  Each component x becomes ``floor(scale * x)`` of x as a double.

*Tiles.*  Every task packs its candidates, as read, into shards of at most
``TILE`` rows (one binary row: ids and an integer matrix); queries are packed
likewise into blocks of ``BLOCK``.  Every block meets every shard (the stated
query set against all rows) in a grid: shards and blocks are dealt into parts
of about ``CELL`` bytes, and a task holds one part of each.  Copies are shuffled
by part, never by shard, and nothing is broadcast.

*Scores.*  A tile is one matrix product, in doubles as long as all sums stay
below 2**53 (then every product and sum is exact), else in Python integers.
Per query and tile, the ``k`` best are selected by one key of score and id.

*Merging.*  A task merges the lists of its tiles; the lists of a block are
then merged as a tree, ``FAN`` at a time, one shuffle of short lists per level.

Defined results: vectors that are null or hold null or non-finite components
take no part; a missing component of a shorter vector counts as zero (an empty
vector scores 0).  Rows without an id are no queries and no candidates.  An id
that stands in several rows is one query and one candidate: its score is the
best of its rows', and none of its rows is a candidate of its own query.  Ties
go to the smaller id.  Fewer than k candidates: all of them.  No queries or no
candidates: no rows.  Scores beyond 64 bits are ranked exactly and returned as
the nearest 64-bit integer.  Other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepared, stored

SCALE = 256
TILE, BLOCK = 4096, 512          # candidates of a shard, queries of a block
FAN = 16                         # lists merged at a node of the tree
CELL = 32_000_000                # bytes of the shards, and of the blocks, that a task holds

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def usable(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v) of the vectors that take part, components as doubles."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()) \
        .filter(~bad)


def scaled(vectors: list[np.ndarray], scale: float) -> np.ndarray:
    """Integer matrix (as doubles, or as Python integers if some are beyond
    2**53), shorter vectors filled with zeros."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    with np.errstate(over="ignore"):
        out = np.floor(scale * out)
    if np.isfinite(out).all() and (not out.size or np.abs(out).max() < 2 ** 53):
        return out
    exact = np.zeros(out.shape, dtype=object)
    for i, v in enumerate(vectors):
        exact[i, :len(v)] = [int(x) * int(scale) if abs(x) >= 2 ** 53 else int(np.floor(scale * x)) for x in v]
    return exact


def pack(ids: np.ndarray, m: np.ndarray) -> dict:
    """One row: sorted ids, width, and the matrix as 32-bit or 64-bit integers
    or, beyond, as text."""
    order = np.argsort(ids, kind="stable")
    ids, m = ids[order].astype("<i8"), m[order]
    if m.dtype == object:
        kind, raw = "text", " ".join(map(str, m.ravel())).encode()
    else:
        kind = "<i4" if not m.size or np.abs(m).max() < 2 ** 31 else "<i8"
        raw = m.astype(kind).tobytes()
    return {"ids": ids.tobytes(), "width": m.shape[1], "kind": kind, "raw": raw}


def unpack(ids: bytes, width: int, kind: str, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, dtype="<i8")
    if kind == "text":
        return i, np.array([int(x) for x in raw.decode().split()], dtype=object).reshape(len(i), width)
    return i, np.frombuffer(raw, dtype=kind).reshape(len(i), width).astype(np.float64)


PACKED = "ids binary, width int, kind string, raw binary"


def packed(rows: DataFrame, size: int, scale: float) -> DataFrame:
    """The rows of each task in packs of at most ``size``, as they come."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        vectors: list[np.ndarray] = []
        for pdf in batches:
            for i, v in zip(pdf["id"], pdf["v"]):
                ids.append(i)
                vectors.append(np.asarray(v, dtype=np.float64))
                if len(ids) == size:
                    yield pd.DataFrame([pack(np.array(ids), scaled(vectors, scale))])
                    ids, vectors = [], []
        if ids:
            yield pd.DataFrame([pack(np.array(ids), scaled(vectors, scale))])

    return rows.mapInPandas(run, PACKED)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All inner products, exact: doubles below 2**53, else Python integers."""
    w = min(q.shape[1], c.shape[1])
    q, c = q[:, :w], c[:, :w]
    if q.dtype != object and c.dtype != object:
        bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(w, 1)
        if bound < 2 ** 52:
            return q @ c.T
    exact = np.zeros((len(q), len(c)), dtype=object)
    for j in range(w):
        exact += np.multiply.outer(np.array([int(x) for x in q[:, j]], dtype=object), np.array([int(x) for x in c[:, j]], dtype=object))
    return exact


def best_of(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of the k best of each row; columns sorted by id, one per
    id; ``own`` is the id each row leaves out."""
    n = len(ids)
    lists = []
    at = np.searchsorted(ids, own)
    mine = (at < n) & (ids[np.minimum(at, n - 1)] == own)
    if scores.dtype == object or (scores.size and np.abs(scores).max() * n >= 2 ** 52):
        for i, row in enumerate(scores):
            order = sorted((j for j in range(n) if not (mine[i] and at[i] == j)), key=lambda j: (-int(row[j]), j))[:k]
            lists.append((ids[order], np.array([int(row[j]) for j in order], dtype=object)))
        return lists
    key = scores * n + np.arange(n - 1, -1, -1)          # distinct: smaller ids win ties
    key[mine, at[mine]] = -np.inf
    top = np.argpartition(-key, k - 1, axis=1)[:, :k] if n > k else np.tile(np.arange(n), (len(key), 1))
    best = np.take_along_axis(key, top, axis=1)
    order = np.argsort(-best, axis=1)
    top, best = np.take_along_axis(top, order, axis=1), np.take_along_axis(best, order, axis=1)
    for i in range(len(key)):
        keep = top[i][best[i] > -np.inf]
        lists.append((ids[keep], scores[i, keep].astype(np.int64).astype(object)))
    return lists


def by_id(m: np.ndarray, ids: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """The best of the rows (or columns) of each id; ids are sorted."""
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, int)
    return (m if len(first) == len(ids) else np.maximum.reduceat(m, first, axis=axis)), ids[first]


def tile_lists(q: tuple[np.ndarray, np.ndarray], c: tuple[np.ndarray, np.ndarray], k: int) -> dict[int, list]:
    """Query id -> its k best of a tile as sorted (-score, id)."""
    s, c_ids = by_id(products(q[1], c[1]), c[0], 1)
    s, q_ids = by_id(s, q[0], 0)
    return {int(i): [(-int(x), int(j)) for j, x in zip(*best)]
            for i, best in zip(q_ids, best_of(s, c_ids, q_ids, k))}


def merge(a: list, b: list, k: int) -> list:
    """The k best of two lists of (-score, id), each id once."""
    out: dict[int, int] = {}
    for s, i in sorted(a + b):
        if i not in out:
            out[i] = s
            if len(out) == k:
                break
    return [(s, i) for i, s in out.items()]


LISTS = "block long, path long, query long, ids array<long>, scores array<string>"


def rows_of(block: int, path: int, lists: dict[int, list]) -> pd.DataFrame:
    """A row per query; scores as text, for they may be beyond 64 bits."""
    return pd.DataFrame({"block": block, "path": path, "query": list(lists), "ids": [[i for _, i in v] for v in lists.values()],
                         "scores": [[str(-s) for s, _ in v] for v in lists.values()]})


def cells(packs: DataFrame, least: int) -> int:
    """In how many parts of about ``CELL`` bytes packs are dealt: ``least`` or
    more, but no more than there are packs."""
    size = packs.select(F.count(F.lit(1)).alias("n"), F.sum(F.length("ids") + F.length("raw")).alias("bytes")).first()
    return max(1, min(size["n"], max(least, -(-(size["bytes"] or 0) // CELL))))


def part_of(parts: int):
    return F.pmod(F.xxhash64("ids", "raw"), F.lit(parts))


def every(parts: int):
    """A row for each part."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))


def search(candidates: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding",
           scale: float = SCALE, tile: int = TILE, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` candidates of the highest
    integer inner product for each query, but for the query's own id."""
    spark = prepared(candidates.sparkSession)
    shards = stored(packed(usable(candidates, vec_id, embedding), tile, scale), "topk-shards")
    blocks = stored(packed(usable(queries, vec_id, embedding), block, scale), "topk-blocks")
    n = shards.count()
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # cells of some shards and some blocks, of bounded size; a cell is a group, nothing is broadcast
    columns = ("ids", "width", "kind", "raw")
    rows, cols = cells(shards, spark.sparkContext.defaultParallelism), cells(blocks, 1)
    left = shards.select(part_of(rows).alias("path"), every(cols).alias("col"), *columns)
    right = blocks.select(every(rows).alias("path"), part_of(cols).alias("col"), *columns)

    def score(key: tuple, c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        held = [unpack(*r) for r in c[list(columns)].itertuples(index=False)]
        for r in q[list(columns)].itertuples(index=False) if held else ():
            block, best = unpack(*r), {}
            for shard in held:
                for i, found in tile_lists(block, shard, k).items():
                    best[i] = merge(best.get(i, []), found, k)
            out.append(rows_of(0, key[0], best))
        return pd.concat(out) if out else pd.DataFrame()

    lists = stored(left.groupBy("path", "col").cogroup(right.groupBy("path", "col")).applyInPandas(score, LISTS), "topk-lists")

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        best: dict[int, list] = {}
        for q, ids, scores in zip(pdf["query"], pdf["ids"], pdf["scores"]):
            best[q] = merge(best.get(q, []), [(-int(s), int(i)) for i, s in zip(ids, scores)], k)
        return rows_of(pdf["block"].iloc[0], pdf["path"].iloc[0] // fan, best)

    # groups of about a block of queries; a query's rows in two blocks meet here
    lists = lists.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(max(blocks.count(), 1))))
    width = rows
    while True:
        lists = lists.groupBy("block", F.floor(F.col("path") / fan).alias("up")).applyInPandas(joined, LISTS)
        width = -(-width // fan)
        if width <= 1:
            break
    out = lists.select(F.col("query").alias("query_id"), F.posexplode(F.arrays_zip("ids", "scores")).alias("rank", "m"))
    s = F.col("m.scores")
    beyond = F.when(s.startswith("-"), F.lit(LOW)).otherwise(F.lit(HIGH))
    score_col = F.coalesce(s.try_cast("long"), beyond)
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("m.ids").alias("vec_id"), score_col.alias("score"))
