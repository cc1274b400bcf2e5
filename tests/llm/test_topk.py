"""Exact top-k against brute force in Python integers."""
import random

import numpy as np

from quillmask.llm import topk

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, queries, k, scale=256):
    def usable(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v)

    def whole(v):
        return [int(x) * scale if abs(x) >= 2 ** 53 else int(np.floor(scale * x)) for x in v]
    rows = [(i, whole(v)) for i, v in rows if i is not None and usable(v)]
    queries = [(i, whole(v)) for i, v in queries if i is not None and usable(v)]
    out = {}
    for q, qv in queries:
        best = out.setdefault(q, {})
        for c, cv in rows:
            if c != q:
                best[c] = max(best.get(c, -10 ** 400), sum(a * b for a, b in zip(qv, cv)))
    limit = 2 ** 63
    return {(q, n + 1, c, max(-limit, min(limit - 1, s))) for q, best in out.items()
            for n, (c, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])}


def got(df, queries, k, **kw):
    rows = [tuple(r) for r in topk.search(df, queries, k, **kw).collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def test_brute_force_with_ties_copies_and_odd_vectors(frame):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, -0.3, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)]) for i in range(150)]
    rows += rows[:30] + [(7, [9.0, 9.0, 9.0, 9.0]), (8, [9.0]), (200, []), (201, None), (202, [1.0, None, 1.0, 1.0]), (203, [float("nan")] * 4),
                         (204, [float("inf"), 0.0, 0.0, 0.0]), (None, [5.0] * 4), (205, [0.0] * 4), (206, [1.0] * 6)]
    df = frame(rows, SCHEMA, 5)
    q = [r for r in rows if r[0] is not None and r[0] % 5 == 0]
    for kw in ({"tile": 16, "block": 8, "fan": 2}, {}):
        assert got(df, frame(q, SCHEMA), 5, **kw) == plain(rows, q, 5)


def test_large_numbers_and_few_candidates(frame):
    rows = [(1, [1e30, 1.0]), (2, [-1e30, 3.0]), (3, [1e9, 1e9]), (4, [2.0 ** 40, -2.0 ** 40])]
    df = frame(rows, SCHEMA, 2)
    assert got(df, df, 5) == plain(rows, rows, 5)


def test_empty_tables_and_extra_columns(spark, frame):
    empty, some = frame([], SCHEMA), frame([(1, [1.0]), (2, [2.0])], SCHEMA)
    assert got(empty, some, 3) == got(some, empty, 3) == got(empty, empty, 3) == set()
    clash = some.selectExpr("*", "'x' as path", "1 as block", "2 as v", "3 as id", "4 as ids")
    assert got(clash, clash, 3) == got(some, some, 3) == {(1, 1, 2, 131072), (2, 1, 1, 131072)}


def test_copies_of_the_queries_are_not_sent_to_the_driver(spark, monkeypatch):
    """However small Spark takes the blocks to be, they and their copies are
    shuffled; the cells of the grid give what one cell gives."""
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    queries = rows.filter("vec_id % 5 = 0")
    whole = sorted(tuple(r) for r in topk.search(rows, queries, 3).collect())
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plans, kept = [], topk.stored
    monkeypatch.setattr(topk, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, name))
    monkeypatch.setattr(topk, "CELL", 2000, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        assert sorted(tuple(r) for r in topk.search(rows, queries, 3, tile=16, block=8).collect()) == whole
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert not any("Broadcast" in p for p in plans)
