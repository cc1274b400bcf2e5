import math
import random
from collections import Counter

import pytest

from quillmask.llm import mixing as X

DOCS = "doc_id long, text string, source string"


def corpus(seed=0):
    rng = random.Random(seed)
    size = {"a": 400, "b": 120, "c": 60, "d": 9}
    rows = [(s, n) for s, k in size.items() for n in (rng.randint(1, 40) for _ in range(k))]
    return [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(rows)]


def tokens(rows):
    out = Counter()
    for _, t, s in rows:
        out[s] += len(t.split())
    return dict(out)


def test_exponent_meets_its_target():
    t = {"a": 10_000, "b": 1000, "c": 100}
    a = X.exponent(t, target=0.8, max_repeats=1e9)
    assert abs(X.entropy(X.tempered(t, a)) - 0.8 * math.log(3)) < 1e-9
    a = X.exponent(t, target=1.0, max_repeats=3.0)
    assert abs(X.repeats(t, X.tempered(t, a), None) - 3.0) < 1e-6
    assert X.exponent(t, target=0.0) == 1.0 and X.exponent({"a": 5}) == 1.0
    assert X.exponent({"a": 5, "b": 5}) == 1.0


@pytest.mark.parametrize("budget", [None, 3000, 30_000])
def test_readings_are_passes_of_a_permutation(frame, monkeypatch, budget):
    monkeypatch.setattr(X, "RANGE_ROWS", 30)
    rows = corpus()
    got = X.mix(frame(rows, DOCS), target=0.9, budget=budget, blocks=8).collect()
    t = tokens(rows)
    planned = {p["source"]: p for p in X.plan(t, 0.9, X.MAX_REPEATS, budget)}
    longest = 40
    for s, p in planned.items():
        own = [r for r in got if r.source == s]
        read = sum(r.mix_tokens for r in own)
        assert p["quota"] <= read < p["quota"] + longest
        per = Counter((r.mix_pass, r.doc_id) for r in own)
        assert set(per.values()) == {1}
        for k in range(p["passes"]):
            assert sum(1 for x in per if x[0] == k) == sum(1 for r in rows if r[2] == s)
        assert {x[0] for x in per} <= set(range(p["passes"] + 1))
        for b in range(8):              # every block holds the weight
            size = sum(r.mix_tokens for r in own if r.mix_block == b)
            assert abs(size - p["quota"] / 8) <= longest
    if budget is None:
        assert {r.doc_id for r in got} == {r[0] for r in rows}


def test_positions_against_a_plain_sum(frame, monkeypatch):
    monkeypatch.setattr(X, "RANGE_ROWS", 7)
    rows = corpus(3)
    docs = frame(rows, DOCS)
    got = {(r.doc_id, r.mix_pass): r.mix_block for r in X.mix(docs, target=0.95, blocks=16).collect()}
    hashed = {r.doc_id: r.h for r in docs.select("doc_id", X.row_hash(docs, 0).alias("h")).collect()}
    want = {}
    for p in X.plan(tokens(rows), 0.95, X.MAX_REPEATS, None):
        for k in range(p["passes"] + 1):
            at = 0
            for i, t, _ in sorted((r for r in rows if r[2] == p["source"]), key=lambda r: hashed[r[0]]):
                if k < p["passes"] or at < p["rest"]:
                    want[i, k] = min(int((k * p["tokens"] + at) * 16 // p["quota"]), 15)
                at += len(t.split())
    assert got == want


def test_edge_cases(frame):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y z", "a"), (4, "x", None), (4, "x", None), (5, "  ", "empty"), (None, "long " * 100_000, "b"), (7, "q", "")]
    docs = frame([(*r, "m", {"k": 1}) for r in rows], DOCS + ", mix_block string, extra map<string,int>")
    got = X.mix(docs).collect()
    first = sorted(str(r.doc_id) for r in got if r.mix_pass == 0)
    assert first == sorted(["1", "2", "3", "4", "4", "5", "None", "7"])
    assert X.mix(frame([], DOCS)).count() == 0
    nothing = X.mix(frame([(1, None, "a"), (2, " ", None)], DOCS)).collect()
    assert len(nothing) == 2
