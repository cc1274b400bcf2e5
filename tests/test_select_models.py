"""Early-stop replay against a plain loop; models beat the all-positive
annotator and reload with identical predictions."""
import random

from pyspark.sql import functions as F

from quillmask.operators import models as M
from quillmask.operators import select as SEL


def _loop(hist, max_tries, max_epochs):
    best, tries, n, best_epoch = 0.0, 0, 0, 0
    while tries < max_tries and n < max_epochs and n < len(hist):
        f = hist[n]
        n += 1
        if f >= best:
            best, tries, best_epoch = f, 0, n
        else:
            tries += 1
    return best_epoch, n


def test_best_epoch_matches_loop(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    for run in range(60):
        h = [rnd.choice([0.0, 0.1, 0.2, 0.5, 0.5, 0.7]) for _ in range(rnd.randint(1, 30))]
        if run == 0:
            h = [0.0] * 10
        rows += [(run, e + 1, f) for e, f in enumerate(h)]
        for tries in (2, 6):
            want[(run, tries)] = _loop(h, tries, 20)
    df = spark.createDataFrame(rows, "run int, epoch int, f1 double")
    for tries in (2, 6):
        got = {r.run: (r.best_epoch, r.stop_epoch)
               for r in SEL.best_epoch(df, ["run"], max_tries=tries, max_epochs=20).collect()}
        for run in range(60):
            assert got[run] == want[(run, tries)], (run, tries)


def _separable(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        y = i % 3 == 0
        v = [rnd.gauss(2.0 if y else -2.0, 1.0) for _ in range(4)]
        rows.append((f"w{i}", v, 1 if y else 0))
    tok = spark.createDataFrame([(r[0], r[2]) for r in rows], "word string, label int")
    vec = spark.createDataFrame([(r[0], r[1]) for r in rows], "word string, v array<double>")
    return tok, vec


def test_models_beat_all_positive(spark, tmp_path):
    tok, vec = _separable(spark)
    rows = M.type_training_rows(tok, vec)
    feats = M.type_features(tok, vec)
    tok = tok.withColumn("corpus", F.lit("x"))
    for name in ("LogisticRegression", "GaussianNB", "RandomForest", "SGDClassifier", "AdaBoostClassifier"):
        params = {"rounds": 5} if name == "AdaBoostClassifier" else {}
        model = M.train_annotator(M.CLASSIFIERS[name](**params), rows)
        f1 = M.test_annotator(model, tok, feats).first()["f1"]
        assert f1 > 0.5 + 1e-9, name  # all-positive F1 here is 0.5
    model = M.train_annotator(M.clf_logreg(), rows)
    M.save_model(model, str(tmp_path / "m"))
    again = M.load_model(str(tmp_path / "m"))
    a = model.transform(feats).select("word", F.col("prediction").alias("a"))
    b = again.transform(feats).select("word", F.col("prediction").alias("b"))
    assert a.join(b, "word").filter("a != b").count() == 0


def test_forests_inside_a_forest(spark):
    """Depths cut from a deeper forest are what MLlib fits at that depth, and
    fewer trees are its first ones."""
    from pyspark.ml.classification import RandomForestClassifier
    rnd = random.Random(4)
    rows = []
    for i in range(500):
        v = [rnd.gauss(0, 1) for _ in range(5)]
        rows.append((f"w{i}", v, float(v[0] * v[1] + 0.4 * rnd.gauss(0, 1) > 0.3)))
    df = spark.createDataFrame(rows, "word string, x array<double>, label double").select("word", M.array_to_vector("x").alias("features"), "label").coalesce(1).cache()

    def fit(depth, trees):
        return RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", bootstrap=False, seed=3).fit(df)
    sizes = [(d, n) for d in (1, 3, 5, 9) for n in (1, 4)]
    got = {r.word: list(r.preds) for r in M.NestedForests(fit(9, 4), sizes).predictions(df).collect()}
    for i, (d, n) in enumerate(sizes):
        want = {r.word: int(r.prediction) for r in fit(d, n).transform(df).collect()}
        assert {w: p[i] for w, p in got.items()} == want, (d, n)
    drawn = RandomForestClassifier(numTrees=20, maxDepth=6, seed=3).fit(df)
    got = {r.word: list(r.preds) for r in M.NestedForests(drawn, [(6, 20), (2, 20), (6, 3)]).predictions(df).collect()}
    assert {w: p[0] for w, p in got.items()} == {r.word: int(r.prediction) for r in drawn.transform(df).collect()}
    assert len({tuple(p) for p in got.values()}) > 2


def test_forest_sweep_has_all_its_configurations(spark, monkeypatch):
    from quillmask.plans import catalog as C
    tok, vec = _separable(spark)
    rows = M.type_training_rows(tok, vec, written=True)
    feats, tok = M.type_features(tok, vec), tok.withColumn("corpus", F.lit("en"))
    monkeypatch.setattr(C, "_model_data", lambda *a, **k: (rows, tok, feats))
    out = C.sweep_forest(spark, "").collect()
    assert {(int(r.max_depth), int(r.num_trees)) for r in out} == {(d, n) for d in range(5, 20) for n in (10, 20, 50, 100)} and len(out) == 60
    # against the separate fit of one of them
    one = M.test_annotator(M.train_annotator(M.clf_random_forest(100, 19), rows), tok, feats).first()
    got = next(r for r in out if (r.max_depth, r.num_trees) == ("19", "100"))
    assert (got.en_precision, got.en_recall, got.en_f1) == (one.precision, one.recall, one.f1) and got.en_f1 > 0.9
