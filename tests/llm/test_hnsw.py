import numpy as np
import pytest

from quillmask.llm import hnsw as H

VECTORS = "vec_id long, embedding array<double>"


def exact(rows, queries, k):
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], dtype=float)
    out = {}
    for q, x in queries:
        score = (v * np.array(x, dtype=float)).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("unit", [True, False])
def test_recall(frame, unit):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 24)) + rng.integers(0, 6, size=(3000, 1))
    v = v / np.linalg.norm(v, axis=1, keepdims=True) if unit else v * rng.random((3000, 1))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    queries = rows[::20]
    df = frame(rows, VECTORS)
    got = by_query(H.search(H.index(df, shard_rows=1000), df.filter("vec_id % 20 = 0"), 20, block_rows=40))
    want = exact(rows, queries, 20)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert hit / (20 * len(want)) >= 0.95
    lookup = dict(rows)
    for q, near in got.items():
        for i, s in near:
            assert abs(s - float(np.dot(lookup[q], lookup[i]))) < 1e-9
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))


def test_equal_vectors_tie_to_the_smaller_id(frame):
    rng = np.random.default_rng(0)
    one = [1.0, 2.0, 0.5]
    rows = [(i, one) for i in range(300)] + [(i, rng.normal(size=3).tolist()) for i in range(300, 500)]
    df = frame(rows, VECTORS)
    got = by_query(H.search(H.index(df, shard_rows=150), df.filter("vec_id % 20 = 0"), 20))
    want = exact(rows, rows[::20], 20)
    same = [q for q in got if q < 300]
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in same if all(abs(s - 5.25) < 1e-12 for _, s in want[q]))


def test_few_rows_and_bad_vectors(frame):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [None, 1.0]), (7, [1.0]),
            (8, []), (None, [1.0, 1.0]), (40, [-1.0, 0.0]), (20, None), (60, [0.0, 0.0]), (80, [2.0])]
    df = frame([(*r, "x", 1) for r in rows], VECTORS + ", shard string, rank int")
    got = by_query(H.search(H.index(df), df.filter("vec_id % 20 = 0"), 20))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [1, 40], 40: [1, 0]}
    none = frame([], VECTORS)
    assert H.search(H.index(none), none, 5).count() == 0
    assert H.search(H.index(df), none, 5).count() == 0
    assert H.search(H.index(none), df, 5).count() == 0
    alone = frame([(0, [1.0]), (0, [1.0])], VECTORS)
    assert H.search(H.index(alone), alone, 5).count() == 0


def test_repeated_rows_count_once(frame):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    once, twice = frame(rows, VECTORS), frame(rows * 2 + rows[:20], VECTORS)
    near = [by_query(H.search(H.index(df, shard_rows=30), df.filter("vec_id % 20 = 0"), 20)) for df in (once, twice)]
    assert near[0] == near[1] and all(len({i for i, _ in v}) == 20 for v in near[1].values())
    # one id, two vectors: the better one of each pair counts, once
    several = rows + [(7, [9.0, 9.0, 9.0, 9.0]), (20, [-9.0, -9.0, -9.0, -9.0])]
    df = frame(several, VECTORS)
    got = by_query(H.search(H.index(df), df.filter("vec_id % 20 = 0"), 20))
    for q in (0, 20, 40):
        mine = [np.array(v) for i, v in several if i == q]
        want = {}
        for i, v in several:
            if i != q:
                want[i] = max(want.get(i, -1e9), *[float(np.dot(m, v)) for m in mine])
        assert [i for i, _ in got[q]] == sorted(want, key=lambda i: (-want[i], i))[:20]
