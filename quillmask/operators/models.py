"""Token classifiers (M0-M9, A7, V1-V3) on MLlib.

Without sentence vectors a token's features depend only on its (folded)
word, so the training set is the distinct ``(word, label)`` rows with weight
= occurrences (times the balanced class weight where the original balances)
— the same weighted loss as one row per token, at the size of the vocabulary
instead of the corpus.  Predictions
are made per distinct word and joined back to the tokens.  With sentence
vectors the rows are per token (``token_features``).
"""
from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

import pandas as pd

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, stored
from . import passes as PS
from .evaluate import confusion, prf
from .lookup import TypeVectors, occurrences


# --- training data ------------------------------------------------------------------------

def type_training_rows(tok: DataFrame, type_vec: DataFrame | TypeVectors, label: str = "label", written: bool = False) -> DataFrame:
    """F9 on distinct types: ``(word, features, label, n, weight)``; ``n`` =
    occurrences, ``weight`` = n x the balanced class weight.  Each estimator
    takes the one its original does.  The rows of ``tok`` may be counted tokens
    (column ``n``).  With ``TypeVectors`` only words and counts are shuffled.

    ``written``: the rows are in the shared folder, as every fit reads them many
    times; the features are kept as array ``x``, a vector where one is read."""
    t = tok.select(F.lower("word").alias("word"), F.col(label).cast("double").alias("label"), *[c for c in tok.columns if c == "n"])
    g = t.groupBy("word", "label").agg(occurrences(t).alias("_c"))
    per = g.groupBy("label").agg(F.sum("_c").alias("_nc"))
    n = per.select(F.sum("_nc")).scalar()
    k = per.select(F.count(F.lit(1))).scalar()
    cw = per.select("label", (n / (k * F.col("_nc"))).alias("_cw"))
    # in order, so that bagging and descent do not depend on how blocks arrive
    j, dim = _attached(g.join(F.broadcast(cw), "label").sortWithinPartitions("word", "label"), type_vec)
    rows = j.select("word", _filled(dim).alias("x"), "label", F.col("_c").cast("double").alias("n"), (F.col("_c") * F.col("_cw")).alias("weight"))
    rows = stored(rows, "training-rows", "zstd") if written else rows
    return rows.select("word", array_to_vector("x").alias("features"), "label", "n", "weight", *["x"] * written)


def _attached(words: DataFrame, type_vec: DataFrame | TypeVectors):
    """``words`` with the vector ``v`` of each (null: none), and the width."""
    if isinstance(type_vec, TypeVectors):
        return type_vec.attach(words), F.lit(type_vec.dim)
    return words.join(type_vec, "word", "left"), type_vec.select(F.max(F.size("v"))).scalar()


def _filled(dim) -> Column:
    return F.coalesce(F.col("v").cast("array<double>"), F.array_repeat(F.lit(0.0), dim))


def type_features(tok: DataFrame, type_vec: DataFrame | TypeVectors) -> DataFrame:
    """Distinct folded words of ``tok`` with their feature vector."""
    w, dim = _attached(tok.select(F.lower("word").alias("word")).distinct(), type_vec)
    return w.select("word", array_to_vector(_filled(dim)).alias("features"))


# --- estimators (M2-M9) ---------------------------------------------------------------------

def clf_logreg(max_iter: int = 100):
    return LogisticRegression(weightCol="weight", maxIter=max_iter)


def clf_linear_svc(max_iter: int = 100):
    return LinearSVC(weightCol="weight", maxIter=max_iter)


def clf_gaussian_nb():
    return PS.GaussianBayes()


def clf_random_forest(num_trees: int = 100, max_depth: int = 5, seed: int = 7):
    return RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth, weightCol="weight", seed=seed)


def clf_gbt(max_iter: int = 100, seed: int = 7):
    return GBTClassifier(maxIter=max_iter, maxDepth=3, seed=seed, weightCol="n")


def clf_sgd(**kw):
    return PS.AveragedSGD(**kw)


def clf_adaboost(**kw):
    return PS.HistogramBoost(**kw)


def clf_mixture(**kw):
    return PS.PrincipalMixture(**kw)


CLASSIFIERS = {
    "LogisticRegression": clf_logreg, "LinearSVC": clf_linear_svc, "SGDClassifier": clf_sgd,
    "GaussianNB": clf_gaussian_nb, "RandomForest": clf_random_forest, "GradientBoosting": clf_gbt,
    "AdaBoostClassifier": clf_adaboost, "GaussianMixture": clf_mixture,
}


# --- train / test / annotate ---------------------------------------------------------------

def train_annotator(estimator, rows: DataFrame):
    """M0: fit on the training rows (MLlib estimators go through a Pipeline so
    the fitted model saves and loads as one unit).  Growing trees, every
    partition sends the statistics of all nodes of a level, so those rows are
    read in as many partitions as there are cores, however large they are."""
    if isinstance(estimator, (RandomForestClassifier, GBTClassifier)):
        rows = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    if hasattr(estimator, "_java_obj") or hasattr(estimator, "uid"):
        return Pipeline(stages=[estimator]).fit(rows)
    return estimator.fit(rows)


def annotate_model(tok: DataFrame, model, type_feats: DataFrame, out: str = "pred") -> DataFrame:
    """Predict every distinct word once, join the 0/1 prediction back to
    the tokens."""
    p = model.transform(type_feats).select("word", F.col("prediction").cast("int").alias(out))
    return tok.withColumn("_w", F.lower("word")).join(p.withColumnRenamed("word", "_w"), "_w", "left") \
        .fillna(0, [out]).drop("_w")


def test_annotator(model, tok: DataFrame, type_feats: DataFrame, by=("corpus",), label: str = "label") -> DataFrame:
    """M1: predictions on held-out (counted) tokens -> confusion + P/R/F1 per
    ``by``."""
    pred = annotate_model(tok, model, type_feats)
    return prf(confusion(pred, list(by), label, "pred", "n" if "n" in tok.columns else None), list(by), digits=6)


def epoch_f1(model, tok: DataFrame, type_feats: DataFrame, label: str = "label") -> DataFrame:
    """``(epoch, f1, loss)`` on ``tok`` of every epoch of a linear model's
    history: each type is scored under all epochs' weights at once, and counted
    as often as it occurs with each label."""
    from pyspark.ml.functions import vector_to_array
    import numpy as np
    w = np.array([h[0] for h in model.history]).T
    b = np.array([h[1] for h in model.history])
    n = len(b)

    @F.pandas_udf("array<int>")
    def hits(x: pd.Series) -> pd.Series:
        return pd.Series(list((np.vstack(x.to_numpy()) @ w + b > 0).astype(np.int32)) if len(x) else [])
    counts = tok.groupBy(F.lower("word").alias("word"), (F.col(label) > 0).alias("y")).agg(occurrences(tok).alias("n"))
    scored = type_feats.select("word", hits(vector_to_array("features")).alias("h"))
    per = counts.join(scored, "word").select("y", "n", F.posexplode("h").alias("epoch", "p"))
    c = per.groupBy("epoch").agg(F.sum(F.when(F.col("y") & (F.col("p") == 1), F.col("n")).otherwise(0)).alias("tp"),
                                 F.sum(F.when(~F.col("y") & (F.col("p") == 1), F.col("n")).otherwise(0)).alias("fp"),
                                 F.sum(F.when(F.col("y") & (F.col("p") == 0), F.col("n")).otherwise(0)).alias("fn"),
                                 F.sum(F.when(~F.col("y") & (F.col("p") == 0), F.col("n")).otherwise(0)).alias("tn"))
    losses = tok.sparkSession.createDataFrame([(i, h[2]) for i, h in enumerate(model.history)], "epoch int, loss double")
    assert n == len(model.history)
    return prf(c, ["epoch"]).join(F.broadcast(losses), "epoch").select((F.col("epoch") + 1).alias("epoch"), "f1", "loss")


def save_model(model, path: str, spark=None) -> None:
    """IO12: a pipeline as MLlib writes it, a model of ``passes`` as JSON."""
    if isinstance(model, PS.Linewise):
        model.save(spark, path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str, spark=None):
    """``spark``: needed for the models of ``passes``."""
    return PipelineModel.load(path) if spark is None else PS.load(spark, path)


def _confusions(tok: DataFrame, scored: DataFrame, width: int, by: list[str], label: str = "label") -> DataFrame:
    """The confusion counts of (counted) tokens under each of ``width``
    predictions of their word (``preds``; none: 0), with its number ``_i``."""
    t = tok.groupBy(*by, F.lower("word").alias("_w"), label).agg(occurrences(tok).alias("_c"))
    j = t.join(scored.select(F.col("word").alias("_w"), "preds"), "_w", "left")
    preds = F.coalesce("preds", F.array_repeat(F.lit(0), width))
    e = j.select(*by, label, "_c", F.posexplode(preds).alias("_i", "pred"))
    return confusion(e, ["_i", *by], label, "pred", "_c")


class NestedForests:
    """The forests of ``sizes`` (depth, trees) inside a fitted forest.  Trees
    are drawn one by one, so its first n are a forest of n; a tree grown to a
    depth is the deeper one cut there, as splits are chosen from the top, and
    what is left is pruned as MLlib does (leaves side by side that predict the
    same are one).  A word walks down each tree once for all depths."""

    def __init__(self, model, sizes: list[tuple[int, int]]):
        self.sizes, self.depths = sizes, sorted({d for d, _ in sizes})
        if len(self.depths) > 62:
            raise ValueError("at most 62 depths")
        self.trees = [flat_tree(t, self.depths) for t in saved_trees(model)]

    def predictions(self, type_feats: DataFrame) -> DataFrame:
        """``(word, preds)``: a prediction for each of the sizes."""
        import numpy as np
        from pyspark.ml.functions import vector_to_array
        held = type_feats.sparkSession.sparkContext.broadcast(self.trees)
        sizes, depths = self.sizes, self.depths

        @F.pandas_udf("array<int>")
        def run(x: pd.Series) -> pd.Series:
            out = [nested_votes(np.vstack(x.to_numpy()[a:a + 4096]), held.value, sizes, depths) for a in range(0, len(x), 4096)]
            return pd.Series([row for part in out for row in part])
        return type_feats.select("word", run(vector_to_array("features")).alias("preds"))


def saved_trees(model) -> list[dict]:
    """The trees of a fitted forest, as MLlib saves them: columns by node, a
    tree's root first and parents before their children."""
    import numpy as np
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "forest")
    model.write().save(path)
    node = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", node["id"].alias("id"), node["prediction"].alias("prediction"), node["impurityStats"].alias("stats"), node["leftChild"].alias("left"),
        node["rightChild"].alias("right"), node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], 0).alias("threshold")).toArrow()
    at = {c: np.array(rows.column(c).to_pylist() if c == "stats" else rows.column(c).to_numpy()) for c in rows.column_names}
    order = np.lexsort((at["id"], at["treeID"]))
    at = {c: v[order] for c, v in at.items()}
    return [{c: v[part] for c, v in at.items()} for part in np.split(np.arange(len(order)), np.flatnonzero(np.diff(at["treeID"])) + 1)]


def flat_tree(t: dict, depths: list[int]) -> tuple:
    """Of a tree of ``saved_trees``: features, thresholds, children (-1: none),
    class shares, and the bits of the depths at which a node is a leaf."""
    import numpy as np
    left, right = t["left"].astype(np.int32), t["right"].astype(np.int32)
    depth, level = np.zeros(len(left), dtype=np.int32), np.zeros(1, dtype=np.int32)
    while len(level):
        level = level[left[level] >= 0]
        down = depth[level] + 1
        depth[left[level]] = depth[right[level]] = down
        level = np.concatenate([left[level], right[level]])
    total = t["stats"].sum(axis=1, keepdims=True)
    share = np.divide(t["stats"], total, out=np.zeros_like(t["stats"]), where=total != 0)
    leaf = np.zeros(len(left), dtype=np.int64)
    for bit, d in enumerate(depths):
        is_leaf = (left < 0) | (depth >= d)
        for k in range(min(d, int(depth.max())) - 1, -1, -1):
            at = np.flatnonzero((depth == k) & ~is_leaf)
            l, r = left[at], right[at]
            is_leaf[at] = is_leaf[l] & is_leaf[r] & (t["prediction"][l] == t["prediction"][r])
        leaf |= is_leaf.astype(np.int64) << bit
    return t["feature"].astype(np.int32), t["threshold"].astype(np.float64), left, right, share, leaf


def nested_votes(x, trees: list[tuple], sizes: list[tuple[int, int]], depths: list[int]) -> list[list[int]]:
    """The predicted class of each row of ``x`` under each of ``sizes``; ties
    go to the lower class."""
    import numpy as np
    every = (1 << len(depths)) - 1
    votes = np.zeros((len(x), len(depths), trees[0][4].shape[1] if trees else 2))
    out, wanted = np.zeros((len(x), len(sizes)), dtype=np.int64), {n for _, n in sizes}
    for k, (feature, threshold, left, right, share, leaf) in enumerate(trees, 1):
        row, node, done = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        while len(row):
            new = leaf[node] & ~done
            for bit in range(len(depths)):
                hit = np.flatnonzero(new >> bit & 1)
                votes[row[hit], bit] += share[node[hit]]
            done = done | new
            on = np.flatnonzero(done != every)
            row, node, done = row[on], node[on], done[on]
            node = np.where(x[row, feature[node]] <= threshold[node], left[node], right[node])
        if k in wanted:
            for i, (d, n) in enumerate(sizes):
                if n == k:
                    out[:, i] = votes[:, depths.index(d)].argmax(axis=1)
    return out.tolist()


def sweep(configs: list[dict], train_rows_for, test_tok_for, feats_for, by=("corpus",), threads: int = 4) -> DataFrame:
    """V1-V3: fit every configuration and score it on the test sets; one
    long result row per (configuration, test set).  Configurations run in a
    driver thread pool; their Spark jobs share the executors and the cached
    feature tables.  Each config dict names ``clf`` (a ``CLASSIFIERS`` key),
    optional ``params`` and any other columns to carry into the result.

    Forests that differ only in depth and number of trees, over the same rows,
    are read off one fit of the largest (``NestedForests``); their
    ``train_time`` is that fit's."""
    nested: dict[tuple, list[int]] = {}
    for i, cfg in enumerate(configs):
        if cfg["clf"] == "RandomForest" and set(cfg.get("params", {})) == {"max_depth", "num_trees"}:
            nested.setdefault((id(train_rows_for(cfg)), id(test_tok_for(cfg)), id(feats_for(cfg))), []).append(i)
    nested = {k: v for k, v in nested.items() if len(v) > 1}
    inside = {i for v in nested.values() for i in v}

    def named(res, cfg, train_time):
        extra = [F.lit(str(v)).alias(k) for k, v in cfg.items() if k != "params"]
        extra += [F.lit(str(v)).alias(k) for k, v in cfg.get("params", {}).items()]
        return res.select(*extra, F.lit(round(train_time, 3)).alias("train_time"), *res.columns)

    def forests(which):
        cfgs = [configs[i] for i in which]
        sizes = [(c["params"]["max_depth"], c["params"]["num_trees"]) for c in cfgs]
        t0 = time.time()
        est = clf_random_forest(num_trees=max(n for _, n in sizes), max_depth=max(d for d, _ in sizes))
        model = train_annotator(est, train_rows_for(cfgs[0]))
        train_time = time.time() - t0
        scored = NestedForests(model.stages[-1], sizes).predictions(feats_for(cfgs[0]))
        each = stored(_confusions(test_tok_for(cfgs[0]), scored, len(sizes), list(by)), "forest-counts")
        return [named(prf(each.filter(F.col("_i") == i).drop("_i"), list(by), digits=6), c, train_time) for i, c in enumerate(cfgs)]

    def one(cfg):
        est = CLASSIFIERS[cfg["clf"]](**cfg.get("params", {}))
        rows = train_rows_for(cfg)
        t0 = time.time()
        model = train_annotator(est, rows)
        train_time = time.time() - t0
        return named(test_annotator(model, test_tok_for(cfg), feats_for(cfg), by), cfg, train_time)
    parts = [p for which in nested.values() for p in forests(which)]
    with ThreadPoolExecutor(max_workers=threads) as ex:
        parts += list(ex.map(one, [c for i, c in enumerate(configs) if i not in inside]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
