"""Token classifiers fitted by passes over the training rows (M4, M5, M8, M9):
every pass is one job in which the tasks add up a few matrices, and the driver
holds those sums only.

Rows are ``(features vector, label, n, weight[, x])`` of ``type_training_rows``: a
row per distinct word and label, ``n`` occurrences, ``weight`` balanced.  The
fitted models are small tuples of arrays, written and read as JSON.
"""
from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .factorised import _added

SMOOTHING = 1e-9                # share of the largest variance that is added to all
BINS = 64
RIDGE = 1e-6                    # added to the variances of a mixture


def _arrays(df: DataFrame) -> DataFrame:
    ship_package(df.sparkSession)
    x = F.col("x") if "x" in df.columns else vector_to_array("features")      # as rows are written
    return df.select(x.alias("x"), F.col("label").cast("double").alias("y"),
                     F.col("n").cast("double").alias("n"), F.col("weight").cast("double").alias("w"))


def _matrix(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    import pyarrow.compute as pc
    y, n, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
    return pc.list_flatten(batch.column(0)).to_numpy(zero_copy_only=False).reshape(len(y), -1), y, n, w


def _summed(rows: DataFrame, kernel, size: int) -> np.ndarray:
    """Sum over all rows of ``kernel(x, y, n, w)``, an array of ``size``."""
    def run(batches):
        import pyarrow as pa
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += kernel(*_matrix(batch))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])
    return _added(rows.mapInArrow(run, "s array<double>"), "s", size)


def _width(rows: DataFrame) -> int:
    one = rows.select(F.size("x").alias("d")).first()
    return one["d"] if one else 0


class Linewise:
    """Prediction of a model with ``classes(matrix) -> 0/1 array``."""

    def transform(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        me = self

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            return pd.Series(me.classes(np.vstack(x.to_numpy())).astype(np.float64) if len(x) else np.zeros(0))
        return df.withColumn("prediction", predict(vector_to_array("features")))

    def save(self, spark, path: str) -> None:
        text = json.dumps({"kind": type(self).__name__, **asdict(self)}, default=lambda a: a.tolist())
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark, path: str) -> "Linewise":
    got = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    kind = got.pop("kind")
    return MODELS[kind](**{k: np.array(v) if isinstance(v, list) and k not in ("stumps", "history") else v for k, v in got.items()})


# --- M5: Gaussian naive Bayes ------------------------------------------------------------

@dataclass(frozen=True)
class BayesModel(Linewise):
    """Per class (0, 1): rows, mean and (smoothed) variance of every feature."""
    count: np.ndarray
    mean: np.ndarray
    variance: np.ndarray

    def classes(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            prior = np.log(self.count / self.count.sum())
        score = [prior[k] - 0.5 * np.log(2 * math.pi * self.variance[k]).sum() - 0.5 * ((x - self.mean[k]) ** 2 / self.variance[k]).sum(axis=1)
                 if self.count[k] else np.full(len(x), -np.inf) for k in (0, 1)]
        return score[1] > score[0]


class GaussianBayes:
    """Closed form from the sums and sums of squares of one pass."""

    def fit(self, df: DataFrame) -> BayesModel:
        rows = _arrays(df)
        d = _width(rows)

        def kernel(x, y, n, w):
            out = []
            for k in (0, 1):
                m = n * (y == k)
                out += [[m.sum()], m @ x, m @ (x * x)]
            return np.concatenate(out)
        s = _summed(rows, kernel, 2 * (1 + 2 * d)).reshape(2, -1)
        count, one, two = s[:, 0], s[:, 1:1 + d], s[:, 1 + d:]
        at = np.maximum(count, 1)[:, None]
        mean = one / at
        whole = two.sum(axis=0) / count.sum() - (one.sum(axis=0) / count.sum()) ** 2
        return BayesModel(count, mean, two / at - mean ** 2 + SMOOTHING * whole.max())


# --- M8: AdaBoost on histogram stumps ---------------------------------------------------------

@dataclass(frozen=True)
class BoostModel(Linewise):
    """Rounds (feature, edge, left, right, alpha): ``left`` is the class of
    values below the edge."""
    stumps: list

    def classes(self, x: np.ndarray) -> np.ndarray:
        score = np.zeros(len(x))
        for f, edge, left, right, alpha in self.stumps:
            score += alpha * (2 * np.where(x[:, int(f)] < edge, left, right) - 1)
        return score > 0


class HistogramBoost:
    """SAMME on depth-1 trees.  A round is one pass: the rows' weights follow
    from the stumps so far, the tasks add them up by (feature, bin, class),
    and prefix sums over the bins give the Gini impurity of every edge.  Ties go
    to the first feature and edge."""

    def __init__(self, rounds: int = 50, bins: int = BINS):
        self.rounds, self.bins = rounds, bins

    def fit(self, df: DataFrame) -> BoostModel:
        rows = _arrays(df).checkpoint(eager=True)
        d, bins = _width(rows), self.bins
        low, high = feature_range(rows, d)
        stumps: list = []
        while len(stumps) < self.rounds:
            sums = _summed(rows, _histogram(low, high, bins, list(stumps)), d * bins * 2).reshape(d, bins, 2)
            stump = best_stump(sums, low, high)
            if stump is None:
                break
            f, b, left, right, err = stump
            if err >= 0.5:
                break
            alpha = math.log((1 - err) / err) if err > 0 else 1.0
            stumps.append((f, edges(low, high, bins)[f, b], left, right, alpha))
            if err <= 0:
                break
        return BoostModel(stumps)


def feature_range(rows: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of every feature."""
    def run(batches):
        import pyarrow as pa
        low, high = np.full(d, np.inf), np.full(d, -np.inf)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)[0]
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(low), pa.array(high)], names=["i", "low", "high"])
    got = rows.mapInArrow(run, "i long, low double, high double").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    got.sort(key=lambda r: r["i"])
    return np.array([r["low"] for r in got]), np.array([r["high"] for r in got])


def edges(low: np.ndarray, high: np.ndarray, bins: int) -> np.ndarray:
    """Upper edge of every bin of every feature."""
    return low[:, None] + (high - low)[:, None] * np.arange(1, bins + 1) / bins


def _histogram(low, high, bins, stumps):
    upper = edges(low, high, bins)

    def kernel(x, y, n, w):
        at, hit = n.copy(), y > 0
        for f, edge, left, right, alpha in stumps:
            at = at * np.where((np.where(x[:, f] < edge, left, right) > 0) != hit, math.exp(alpha), 1.0)
        out = np.zeros((x.shape[1], bins, 2))
        for f in range(x.shape[1]):
            b = np.minimum(np.searchsorted(upper[f], x[:, f], side="right"), bins - 1)
            for k in (0, 1):
                out[f, :, k] = np.bincount(b[hit == bool(k)], weights=at[hit == bool(k)], minlength=bins)
        return out.ravel()
    return kernel


def best_stump(sums: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[int, int, int, int, float] | None:
    """(feature, bin, left class, right class, error share) of the edge after
    ``bin`` with the least impurity."""
    left = np.cumsum(sums, axis=1)[:, :-1]
    right = sums.sum(axis=1)[:, None] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        impurity = sum(np.where(s.sum(axis=2) > 0, s[..., 0] * s[..., 1] / s.sum(axis=2), 0.0) for s in (left, right))
    real = (left.sum(axis=2) > 0) & (right.sum(axis=2) > 0)
    if not real.any():
        return None
    f, b = divmod(int(np.where(real, impurity, np.inf).argmin()), impurity.shape[1])
    l, r = left[f, b], right[f, b]
    return f, b, int(l[1] > l[0]), int(r[1] > r[0]), float((l.min() + r.min()) / (l.sum() + r.sum()))


# --- M4: stochastic gradient descent ------------------------------------------------------------

@dataclass(frozen=True)
class LinearModel(Linewise):
    """``history``: (weights, bias, training loss) after every epoch."""
    weights: np.ndarray
    bias: float
    history: list = field(default_factory=list)

    def classes(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias > 0


class AveragedSGD:
    """Hinge loss with L2 penalty.  In an epoch every task makes a pass of small
    steps over its rows from the common weights; the weights are averaged by
    the rows' weight.  It ends when the loss (over all rows, before the epoch)
    has not fallen for ``patience`` epochs by more than ``fall`` of itself; the
    weights of least loss are the model's.  Every epoch reads the rows, so they
    are written first unless they are already (``x``)."""

    def __init__(self, alpha: float = 1e-4, rate: float = 0.1, batch: int = 256, fall: float = 5e-3, patience: int = 5):
        self.alpha, self.rate, self.batch, self.fall, self.patience = alpha, rate, batch, fall, patience

    def fit(self, df: DataFrame) -> LinearModel:
        rows = _arrays(df) if "x" in df.columns else _arrays(df).checkpoint(eager=True)
        d = _width(rows)
        total = rows.agg(F.sum("w")).first()[0] or 1.0
        w, b, history, best = np.zeros(d), 0.0, [], None
        while True:
            s = self._epoch(rows, w, b, total, len(history), d)
            loss = s[d + 2] / total + self.alpha / 2 * float(w @ w)
            if history:
                history[-1][2] = float(loss)
            if best is None or loss < best[0] * (1 - self.fall):
                best = (loss, w, b, len(history))
            elif len(history) - best[3] >= self.patience:
                history.pop() if history[-1][2] is None else None
                return LinearModel(best[1], float(best[2]), history)
            w, b = s[:d] / s[d + 1], s[d] / s[d + 1]
            history.append([w.tolist(), float(b), None])

    def _epoch(self, rows: DataFrame, w: np.ndarray, b: float, total: float, epoch: int, d: int) -> np.ndarray:
        """Sums over tasks: weighted weights and bias, row weight, and the loss
        of the weights the epoch began with."""
        alpha, rate, size = self.alpha, self.rate / math.sqrt(epoch + 1), self.batch

        def run(batches):
            import pyarrow as pa
            own, bias, seen, loss = w.copy(), b, 0.0, 0.0
            for batch in batches:
                x, y, _, weight = _matrix(batch)
                sign = 2 * y - 1
                loss += float((weight * np.maximum(1 - sign * (x @ w + b), 0)).sum())
                order = np.random.default_rng(epoch).permutation(len(y))
                for a in range(0, len(y), size):
                    i = order[a:a + size]
                    part = weight[i].sum()
                    if part <= 0:
                        continue
                    active = np.where(sign[i] * (x[i] @ own + bias) < 1, sign[i] * weight[i], 0.0) / part
                    own = own * (1 - rate * alpha) + rate * (active @ x[i])
                    bias += rate * active.sum()
                seen += float(weight.sum())
            yield pa.RecordBatch.from_arrays([pa.array([[*(own * seen), bias * seen, seen, loss]], pa.list_(pa.float64()))], names=["s"])
        return _added(rows.mapInArrow(run, "s array<double>"), "s", d + 3)


# --- M9: Gaussian mixture ----------------------------------------------------------------------------

@dataclass(frozen=True)
class MixtureModel(Linewise):
    share: np.ndarray
    mean: np.ndarray
    covariance: np.ndarray
    label: np.ndarray

    def densities(self, x: np.ndarray) -> np.ndarray:
        """Log of share times density, rows x components."""
        out = np.empty((len(x), len(self.share)))
        for k in range(len(self.share)):
            root = np.linalg.cholesky(self.covariance[k])
            z = np.linalg.solve(root, (x - self.mean[k]).T)
            out[:, k] = math.log(max(self.share[k], 1e-300)) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * math.log(2 * math.pi)
        return out

    def classes(self, x: np.ndarray) -> np.ndarray:
        return self.label[self.densities(x).argmax(axis=1)] > 0


class PrincipalMixture:
    """Two Gaussian components fitted without the target by expectation
    maximisation; each then predicts the more frequent label of its rows.  The
    components start a standard deviation from the mean on both sides of the
    first principal direction, so the result depends on the rows alone, not on
    their order or partitions.  It ends when the mean log likelihood rises by
    less than ``rise``."""

    def __init__(self, rise: float = 1e-4):
        self.rise = rise

    def fit(self, df: DataFrame) -> MixtureModel:
        rows = _arrays(df).checkpoint(eager=True)
        d = _width(rows)
        size = 1 + d + d * d

        def moments(x, y, n, w):
            return np.concatenate([[n.sum()], n @ x, ((x * n[:, None]).T @ x).ravel()])
        s = _summed(rows, moments, size)
        mean, spread = _moments(s, d)
        value, vector = np.linalg.eigh(spread)
        step = math.sqrt(max(value[-1], 0)) * vector[:, -1] * (1 if vector[np.abs(vector[:, -1]).argmax(), -1] > 0 else -1)
        model = MixtureModel(np.array([0.5, 0.5]), np.stack([mean - step, mean + step]), np.stack([spread, spread]), np.zeros(2))
        before = None
        while True:
            t = _summed(rows, _expected(model), 2 * size + 1)
            parts = t[:-1].reshape(2, size)
            if before is not None and t[-1] / s[0] - before < self.rise:
                break
            before = t[-1] / s[0]
            fitted = [_moments(p, d) for p in parts]
            model = MixtureModel(parts[:, 0] / s[0], np.stack([f[0] for f in fitted]), np.stack([f[1] for f in fitted]), np.zeros(2))

        def votes(x, y, n, w):
            k = model.densities(x).argmax(axis=1)
            return np.bincount(2 * k + (y > 0), weights=n, minlength=4)
        v = _summed(rows, votes, 4).reshape(2, 2)
        return MixtureModel(model.share, model.mean, model.covariance, (v[:, 1] > v[:, 0]).astype(float))


def _moments(s: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    mean = s[1:1 + d] / max(s[0], 1e-300)
    return mean, s[1 + d:].reshape(d, d) / max(s[0], 1e-300) - np.outer(mean, mean) + RIDGE * np.eye(d)


def _expected(model: MixtureModel):
    def kernel(x, y, n, w):
        logs = model.densities(x)
        top = logs.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
        out = []
        for k in range(2):
            r = n * np.exp(logs[:, k] - total)
            out += [[r.sum()], r @ x, ((x * r[:, None]).T @ x).ravel()]
        return np.concatenate([*out, [float(n @ total)]])
    return kernel


MODELS = {m.__name__: m for m in (BayesModel, BoostModel, LinearModel, MixtureModel)}
