"""Estimators fitted by passes: against plain versions, on several
partitionings, and saved and loaded."""
import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from quillmask.operators import models as M
from quillmask.operators import passes as PS


def table(x, y, n, w):
    return [(f"w{i}", Vectors.dense(v.tolist()), float(a), float(b), float(c)) for i, (v, a, b, c) in enumerate(zip(x, y, n, w))]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=300) > 0.4).astype(int)
    n = rng.integers(1, 20, 300).astype(float)
    w = n * np.where(y > 0, 0.5 / n[y > 0].sum(), 0.5 / n[y == 0].sum()) * n.sum()
    return x, y, n, w, lambda parts: spark.createDataFrame(table(x, y, n, w), ["word", "features", "label", "n", "weight"]).repartition(parts)


def test_bayes_is_the_closed_form(data):
    x, y, n, _, df = data
    m = PS.GaussianBayes().fit(df(3))
    for k in (0, 1):
        mean = np.average(x[y == k], axis=0, weights=n[y == k])
        var = np.average((x[y == k] - mean) ** 2, axis=0, weights=n[y == k])
        assert np.allclose(m.mean[k], mean) and np.allclose(m.variance[k], var, rtol=1e-6)


def test_boost_equals_a_plain_boost(data):
    x, y, n, _, df = data
    got = PS.HistogramBoost(rounds=12, bins=16).fit(df(5)).stumps
    low, high = x.min(axis=0), x.max(axis=0)
    w, want = n.copy(), []
    for _ in range(12):
        best = None
        for f in range(4):
            for b in range(15):
                edge = low[f] + (high[f] - low[f]) * (b + 1) / 16
                left = x[:, f] < edge
                if left.all() or not left.any():
                    continue
                s = [[w[m & (y == k)].sum() for k in (0, 1)] for m in (left, ~left)]
                imp = sum(a * c / (a + c) for a, c in s if a + c)
                if best is None or imp < best[0] - 1e-12:
                    best = (imp, f, edge, int(s[0][1] > s[0][0]), int(s[1][1] > s[1][0]), left)
        _, f, edge, l, r, left = best
        miss = np.where(left, l, r) != y
        err = w[miss].sum() / w.sum()
        alpha = np.log((1 - err) / err)
        want.append((f, edge, l, r, alpha))
        w = w * np.where(miss, np.exp(alpha), 1)
    assert len(got) == 12 and all(a[0] == b[0] and a[2:4] == b[2:4] and np.isclose(a[1], b[1]) and np.isclose(a[4], b[4], rtol=1e-6) for a, b in zip(got, want))


def test_sgd_stops_when_the_loss_stops(data):
    x, y, n, w, df = data
    m = PS.AveragedSGD().fit(df(4))
    assert len(m.history) > 5 and m.history[-1][2] is not None
    assert np.average(m.classes(x) == (y > 0), weights=w) > 0.85
    best = min(h[2] for h in m.history)
    at = [h for h in m.history if np.allclose(h[0], m.weights)]
    assert at and at[0][2] <= best / (1 - 5e-3) + 1e-12


def test_mixture_does_not_depend_on_partitions(data):
    x, _, n, _, df = data
    models = [PS.PrincipalMixture().fit(df(p)) for p in (1, 4, 7)]
    assert all(np.allclose(m.mean, models[0].mean, atol=1e-8) and np.allclose(m.covariance, models[0].covariance, atol=1e-8)
               and m.label.tolist() == models[0].label.tolist() for m in models)
    assert np.isclose(models[0].share.sum(), 1) and np.allclose(models[0].share @ models[0].mean, np.average(x, axis=0, weights=n))


@pytest.mark.parametrize("name", ["SGDClassifier", "AdaBoostClassifier", "GaussianNB", "GaussianMixture"])
def test_saved_models_predict_alike(spark, data, tmp_path, name):
    df = data[4](2)
    model = M.train_annotator(M.CLASSIFIERS[name](**({"rounds": 4} if name.startswith("Ada") else {})), df)
    M.save_model(model, str(tmp_path / "m"), spark)
    again = M.load_model(str(tmp_path / "m"), spark)
    a, b = ([r.prediction for r in m.transform(df).orderBy("word").select("prediction").collect()] for m in (model, again))
    assert a == b and set(a) <= {0.0, 1.0}
