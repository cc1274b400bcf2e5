"""Factorised training against the materialised feature matrix."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmask.operators import factorised as FT
from quillmask.operators import features as FEAT

SENT = "corpus string, doc_id long, sent_id int, words array<string>, labels array<int>, train boolean"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    words = [f"W{i}" for i in range(40)]
    vec = {w.lower(): rng.normal(size=5).tolist() for w in words[:30]}
    sent, sv = [], []
    for i in range(120):
        n = int(rng.integers(1, 12))
        ws = [words[j] for j in rng.integers(0, 40, n)]
        v = rng.normal(size=3)
        ys = [int(rng.random() < 1 / (1 + np.exp(2 - vec.get(w.lower(), [0.0])[0] * 2 - v[0]))) * int(rng.integers(1, 3)) for w in ws]
        sent.append(("ab"[i % 2], i // 4, i % 4, ws, ys, i % 5 != 0))
        sv.append(("ab"[i % 2], i // 4, i % 4, v.tolist()))
    return (spark.createDataFrame(sent, SENT), spark.createDataFrame(sv, "corpus string, doc_id long, sent_id int, sv array<double>"),
            spark.createDataFrame(list(vec.items()), "word string, v array<double>"), sent, {s[:3]: s[3] for s in sv}, vec)


def matrix(data, corpora, train=True):
    _, _, _, sent, sv, vec = data
    x, y = [], []
    for c, d, s, ws, ys, t in sent:
        if t == train and c in corpora:
            x += [[*vec.get(w.lower(), [0.0] * 5), *sv[c, d, s], 1.0] for w in ws]
            y += [int(v > 0) for v in ys]
    return np.array(x), np.array(y)


def plain(x, y, loss, l2, sentence):
    """Newton on the materialised matrix."""
    x = x if sentence else np.delete(x, range(5, 8), axis=1)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    t, w = np.where(y > 0, 1.0, -1.0), np.zeros(x.shape[1])
    ridge = l2 * np.diag([1.0] * (len(w) - 1) + [0.0])
    for _ in range(200):
        m = t * (x @ w)
        if loss == "logistic":
            p = 1 / (1 + np.exp(m))
            g, h = x.T @ (-weight * t * p), (x * (weight * p * (1 - p))[:, None]).T @ x
        else:
            short = np.maximum(1 - m, 0)
            g, h = x.T @ (-2 * weight * t * short), 2 * (x * (weight * (short > 0))[:, None]).T @ x
        step = np.linalg.solve(h + ridge + 1e-14 * np.eye(len(w)), g + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-13:
            break
    return w if sentence else np.concatenate([w[:5], np.zeros(3), w[5:]])


CONFIGS = [FT.Config(f"{loss}-{s}-{t}", loss, 1e-2, t, s) for loss in FT.LOSSES for s in (True, False) for t in (None, ("a",))]


@pytest.mark.parametrize("limit", [FEAT.BROADCAST_CELLS, 0])
def test_equal_to_the_materialised_matrix(data, limit):
    sent, sv, vec = data[:3]
    rows = FT.sentence_rows(sent, sv, vec, limit=limit)
    assert (rows.matrix is None) == (limit == 0)
    configs = CONFIGS if limit else CONFIGS[:1]
    models = FT.fit(rows, configs, tolerance=1e-9 if limit else 1e-5)
    for c, m in zip(configs, models):
        x, y = matrix(data, c.train or "ab")
        want = plain(x, y, c.loss, c.l2, c.sentence)
        got = np.concatenate([m.word, m.sentence, [m.bias]])
        assert np.abs(got - want).max() < (1e-6 if limit else 1e-2), c
    for r in FT.evaluate(rows, models).collect():
        m = next(m for m in models if m.config.name == r.config)
        x, y = matrix(data, r.corpus, train=False)
        hit = x @ np.concatenate([m.word, m.sentence, [m.bias]]) > 0
        assert (r.tp, r.fp, r.fn, r.tn) == ((hit & (y > 0)).sum(), (hit & (y == 0)).sum(), (~hit & (y > 0)).sum(), (~hit & (y == 0)).sum())


def test_gradient_of_both_tables_is_that_of_the_matrix(data):
    sent, sv, vec = data[:3]
    rng = np.random.default_rng(1)
    points = [rng.normal(size=9) for _ in CONFIGS[:4]]
    found = []
    for limit in (FEAT.BROADCAST_CELLS, 0):
        rows = FT.sentence_rows(sent, sv, vec, limit=limit)
        found.append(FT.losses(rows, CONFIGS[:4], FT.class_weights(rows, CONFIGS[:4]), points))
    for (f1, g1), (f2, g2), c, p in zip(*found, CONFIGS, points):
        x, y = matrix(data, c.train or "ab")
        q = p if c.sentence else np.concatenate([p[:5], np.zeros(3), p[8:]])
        w = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        f = (w * np.log1p(np.exp(-np.where(y > 0, 1, -1) * (x @ q)))).sum() + c.l2 / 2 * p[:-1] @ p[:-1]
        assert abs(f - f1) < 1e-9 and abs(f1 - f2) < 1e-9 and np.abs(g1 - g2).max() < 1e-9


def test_annotation_covers_every_word(data):
    sent, sv, vec = data[:3]
    rows = FT.sentence_rows(sent, sv, vec)
    out = FT.annotate(rows, FT.fit(rows, [FT.Config("x")], tolerance=1e-3))
    assert out.count() == 120 and out.filter(F.size("preds") != F.size("labels")).isEmpty()


def test_no_wide_vector_per_token_is_exchanged(data):
    """The broadcast pass has no exchange before its sums of one row a task."""
    rows = FT.sentence_rows(*data[:3])
    plan = FT.annotate(rows, [FT.Model(FT.Config("x"), np.zeros(5), np.zeros(3), 0.0)])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


# --- F6, F7, F10 -----------------------------------------------------------------------

def test_sentence_vectors_of_both_plans_agree(spark):
    sent = spark.createDataFrame([("c", 1, 0, ["Ab", "ab", "zz", "cd"]), ("c", 1, 1, ["zz"]), ("c", 2, 0, ["cd"] * 3)],
                                 "corpus string, doc_id long, sent_id int, words array<string>")
    vec = spark.createDataFrame([("ab", [1.0, 2.0]), ("cd", [0.5, -1.0])], "word string, v array<double>")
    freq = spark.createDataFrame([("ab", 4), ("cd", 2), ("zz", 9)], "word string, n long")
    for kw in ({}, {"relative": True, "a": 1e-3}, {"fold_case": False, "a": 0.1}, {"freq_fold_case": True, "a": 0.1}):
        one, two = ({tuple(r)[:3]: (r.n_tokens, r.sv) for r in FEAT.weighted_sentence_vec(sent, vec, freq, limit=lim, **kw).collect()}
                    for lim in (FEAT.BROADCAST_CELLS, 0))
        assert one.keys() == two.keys() and all(one[k][0] == two[k][0] and np.allclose(one[k][1], two[k][1], rtol=1e-12) for k in one)
    a, rel = 0.1, FEAT.weighted_sentence_vec(sent, vec, freq, a=0.1).filter("doc_id = 1 and sent_id = 0").first()
    want = (100 * a / (a + 1) * np.array([1.0, 2]) + 100 * a / (a + 4) * np.array([1.0, 2]) + 100 * a / (a + 2) * np.array([0.5, -1])) / 4
    assert np.allclose(rel.sv, want)


def test_first_direction_equals_the_svd(spark):
    rng = np.random.default_rng(2)
    docs = {d: rng.normal(size=(n, 6)) for d, n in ((1, 40), (2, 3), (3, 1), (4, 2))}
    docs[5] = np.zeros((3, 6))
    rows = [("c", d, i, v.tolist()) for d, x in docs.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "corpus string, doc_id long, sent_id int, sv array<double>").repartition(5)
    got = {(r.doc_id, r.sent_id): r.sv for r in FEAT.remove_first_direction(df).collect()}
    assert len(got) == len(rows)
    for d, x in docs.items():
        u = np.linalg.svd(x.T, full_matrices=False)[0][:, :1]
        want = x.T - u @ (u.T @ x.T)
        assert np.allclose([got[d, i] for i in range(len(x))], want.T, atol=1e-9)


def test_projection_keeps_the_largest_variance(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4)) * [5, 3, 0.1, 0.1]
    df = spark.createDataFrame([(f"w{i}", i % 2, v.tolist()) for i, v in enumerate(x)], "word string, annotated int, v array<double>")
    got = np.array([(r.x, r.y) for r in FEAT.project_2d(df).collect()])
    kept = np.linalg.svd(x - x.mean(0), compute_uv=False)[:2]
    assert np.allclose(got.std(axis=0) * np.sqrt(200), kept, rtol=1e-6)
