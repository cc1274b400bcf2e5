"""Linear token classifiers over word and sentence features (F8, F9, M0-M4, V1,
V3), trained without a feature row per token.

A token's features are its word's vector and its sentence's vector, so its
score is ``w1 . word + w2 . sentence + b``: a number per word plus a number per
sentence.  The gradient needs the sums of the loss derivatives by word (times
the word's vector) and by sentence (times the sentence's vector).  Both wide
vectors are read once per word and once per sentence, never per token.

*Stacked fitting.*  All configurations (loss, training corpora, with or
without the sentence part) are columns of the same matrices: one pass over the
sentences gives the loss and gradient of each, and limited-memory quasi-Newton
steps run side by side on the driver, which holds only the weights.

*Tables.*  ``sentence_rows`` writes a row per sentence: its corpus, the index
of each word's vector, the labels and the sentence vector.  A word table of up
to ``limit`` numbers is broadcast and the tasks return one row of sums each.
With a larger one the words' scores are joined to the sentences in every pass,
and the sums by word are joined to the vectors.
"""
from __future__ import annotations

import time
from dataclasses import dataclass, replace

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..session import scratch_path, ship_package
from .features import BROADCAST_CELLS, SLICE, flat_words, held_types

LOSSES = ("logistic", "squared_hinge")
TOLERANCE = 1e-6                # largest gradient component at the end
FLAT = 1e-5                     # relative fall of the loss over ten steps under which it has stopped falling


@dataclass(frozen=True)
class Config:
    """One classifier: its loss, L2 weight, training corpora (None: all), and
    whether it sees sentence vectors; classes are balanced within the training
    set."""
    name: str
    loss: str = "logistic"
    l2: float = 1e-4
    train: tuple[str, ...] | None = None
    sentence: bool = True


@dataclass(frozen=True)
class Model:
    config: Config
    word: np.ndarray
    sentence: np.ndarray
    bias: float
    rounds: int = 0
    seconds: float = 0.0


# --- tables -------------------------------------------------------------------------

def sentence_rows(sent: DataFrame, sentvec: DataFrame | None, vec: DataFrame, fold_case: bool = True, limit: int = BROADCAST_CELLS,
                  keys=("corpus", "doc_id", "sent_id")) -> "Rows":
    """The training and test table of ``sent`` (keys, words, labels, train),
    with the sentence vectors ``sentvec`` (keys, sv); None: ``sent`` has them."""
    import pyarrow as pa
    spark = sent.sparkSession
    ship_package(spark)
    types = held_types(vec, limit)
    labels = F.transform("labels", lambda x: (x > 0).cast("int")).alias("labels")
    if sentvec is None:
        j = sent.select(*keys, "train", "words", labels, "sv")
    else:
        j = sent.select(*keys, "train", "words", labels).join(sentvec.select(*keys, "sv"), list(keys))
    path = scratch_path(spark, "sentence-rows")
    if types is None:
        w = F.transform("words", F.lower) if fold_case else F.col("words")
        j.select(*keys, "train", w.alias("words"), "labels", "sv").write.parquet(path)
        return Rows(spark.read.parquet(path), None, vec.select("word", "v"), keys)
    held = spark.sparkContext.broadcast({w: i for i, w in enumerate(types[0])})
    n = len(keys) + 1
    schema = ST.StructType([*[j.schema[k] for k in keys], j.schema["train"], ST.StructField("ids", ST.ArrayType(ST.IntegerType())),
                            j.schema["labels"], j.schema["sv"]])

    def run(batches):
        index = held.value
        for batch in batches:
            which, distinct, size = flat_words(batch.column(n))
            ids = np.array([index.get(w.lower() if fold_case else w, -1) for w in distinct] or [-1], dtype=np.int32)[which]
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], column, batch.column(n + 1), batch.column(n + 2)],
                                             names=[f.name for f in schema.fields])
    j.select(*keys, "train", "words", "labels", "sv").mapInArrow(run, schema).write.parquet(path)
    return Rows(spark.read.parquet(path), types[1], None, keys, spark.sparkContext.broadcast(types[1]))


@dataclass(frozen=True)
class Rows:
    """Written sentences, and the word vectors: a matrix to broadcast or, if
    too large, a table."""
    table: DataFrame
    matrix: np.ndarray | None
    vec: DataFrame | None
    keys: tuple[str, ...]
    sent: Broadcast | None = None       # the matrix, sent once for all passes

    @property
    def dims(self) -> tuple[int, int]:
        one = self.table.select(F.size("sv").alias("d")).first()
        if self.matrix is not None:
            return self.matrix.shape[1], one["d"] if one else 0
        word = self.vec.select(F.size("v").alias("d")).first()
        return word["d"] if word else 0, one["d"] if one else 0

    def scored(self, words: np.ndarray) -> DataFrame:
        """The table with ``part``: the words' scores under weights ``words``
        (dim x configurations), word by word; by a join, for a vector table too
        large to send.  Rows of one word are spread over its sentences first."""
        k = words.shape[1]
        score = F.array(*[F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in words[:, j]]), lambda a, b: a.cast("double") * b),
                                      F.lit(0.0), lambda a, b: a + b) for j in range(k)])
        scores = self.vec.select("word", score.alias("s"))
        flat = self.table.select(*self.keys, F.posexplode("words").alias("at", "word")).join(scores, "word", "left")
        zero = F.array_repeat(F.lit(0.0), k)
        folded = flat.groupBy(*self.keys).agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("s", zero).alias("s")))).alias("p"))
        folded = folded.select(*self.keys, F.flatten(F.transform("p", lambda x: x["s"])).alias("part"))
        return self.table.join(folded, list(self.keys), "left").withColumn("part", F.coalesce("part", F.array().cast("array<double>")))


# --- one pass over the sentences --------------------------------------------------------

def flat(column):
    import pyarrow.compute as pc
    return pc.list_flatten(column).to_numpy(zero_copy_only=False)


def slices(size: np.ndarray):
    """Ranges of sentences of about ``SLICE`` tokens, a long one alone."""
    end, at = np.cumsum(size), 0
    while at < len(size):
        start = end[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(end, start + SLICE, side="right")))
        yield at, to, int(start), int(end[to - 1])
        at = to


def derivative(loss: str, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss and its derivative by the margin ``t * score``."""
    if loss == "logistic":
        e = np.exp(-np.abs(margin))
        return np.log1p(e) + np.maximum(-margin, 0), -np.where(margin > 0, e / (1 + e), 1 / (1 + e))
    short = np.maximum(1 - margin, 0)
    return short * short, -2 * short


class Batch:
    """Arrays of an Arrow batch of sentences; ``scores``: of each word, or None
    where the batch brings them."""

    def __init__(self, batch, scores, w1, w2, b):
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        self.corpus = col["corpus"].to_pylist()
        self.train = col["train"].to_numpy(zero_copy_only=False).astype(bool)
        self.y = flat(col["labels"]).astype(np.int64)
        import pyarrow.compute as pc
        self.size = pc.fill_null(pc.list_value_length(col["labels"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.sv = flat(col["sv"]).reshape(len(self.size), -1)
        self.by_sentence = self.sv @ w2 + b
        if scores is not None:
            self.ids = flat(col["ids"])
            self.by_word = None
            self.scores = scores
        else:
            self.words, self.by_word = col["words"], flat(col["part"]).reshape(-1, w1.shape[1])

    def tokens(self, s: int, e: int, t0: int, t1: int) -> tuple[np.ndarray, np.ndarray]:
        """Sentence of each token and the scores of a slice."""
        of = np.repeat(np.arange(s, e), self.size[s:e])
        word = self.by_word[t0:t1] if self.by_word is not None else self.scores[self.ids[t0:t1]]
        return of, word + self.by_sentence[of]


def word_scores(sent: Broadcast | None, w1: np.ndarray) -> np.ndarray | None:
    """In a task: every word's scores, and a last row for words without a
    vector."""
    return None if sent is None else np.vstack([sent.value @ w1, np.zeros((1, w1.shape[1]))])


def stacked(configs: list[Config], points: list[np.ndarray], d1: int, d2: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = np.stack(points, axis=1)
    return w[:d1], w[d1:d1 + d2] * np.array([c.sentence for c in configs], dtype=float), w[-1]


def losses(rows: Rows, configs: list[Config], weights: dict, points: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
    """Loss and gradient of every configuration at its point.  ``weights``:
    (corpus, label) -> weight per configuration."""
    spark = rows.table.sparkSession
    d1, d2 = rows.dims
    w1, w2, b = stacked(configs, points, d1, d2)
    k, matrix = len(configs), rows.matrix
    table = rows.table if matrix is not None else rows.scored(w1)
    held = spark.sparkContext.broadcast((w1, w2, b, weights, [c.loss for c in configs]))
    wide, sent = matrix is None, rows.sent

    def run(batches):
        import pyarrow as pa
        w1, w2, b, weights, kinds = held.value
        matrix, scores = None if wide else sent.value, word_scores(sent, w1)
        loss, g2, gb = np.zeros(k), np.zeros((d2, k)), np.zeros(k)
        by_word = np.zeros((0 if wide else len(matrix) + 1, k))
        none = np.zeros((2, k))
        for arrow in batches:
            x = Batch(arrow, scores, w1, w2, b)
            scale = np.stack([weights.get(c, none) if t else none for c, t in zip(x.corpus, x.train)]) if len(x.size) else np.zeros((0, 2, k))
            out = {}
            for s, e, t0, t1 in slices(x.size):
                if t0 == t1:
                    continue
                of, z = x.tokens(s, e, t0, t1)
                y = x.y[t0:t1]
                sign, own = np.where(y > 0, 1.0, -1.0)[:, None], scale[of, y]
                r = np.empty_like(z)
                for j, kind in enumerate(kinds):
                    value, slope = derivative(kind, sign[:, 0] * z[:, j])
                    loss[j] += (own[:, j] * value).sum()
                    r[:, j] = own[:, j] * slope * sign[:, 0]
                gb += r.sum(axis=0)
                first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                g2 += x.sv[of[first]].T @ np.add.reduceat(r, first, axis=0)
                if wide:
                    for w, v in zip(_slice_words(x.words, t0, t1), r):
                        out[w] = out[w] + v if w in out else v
                else:
                    ids = x.ids[t0:t1]
                    for j in range(k):
                        by_word[:, j] += np.bincount(ids + (ids < 0) * (len(by_word)), weights=r[:, j], minlength=len(by_word))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(out)), pa.array([v.tolist() for v in out.values()], pa.list_(pa.float64()))], names=["word", "sums"])
        g1 = np.zeros((d1, k)) if wide else matrix.T @ by_word[:-1]
        total = np.concatenate([loss, gb, g2.ravel(), g1.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["word", "sums"])

    sums = table.mapInArrow(run, "word string, sums array<double>")
    if wide:
        path = scratch_path(spark, "word-sums")
        sums.write.parquet(path)
        sums = spark.read.schema("word string, sums array<double>").parquet(path)
    total = _added(sums.filter("word is null"), "sums", 2 * k + (d1 + d2) * k)
    loss, gb = total[:k], total[k:2 * k]
    g2, g1 = total[2 * k:2 * k + d2 * k].reshape(d2, k), total[2 * k + d2 * k:].reshape(d1, k)
    if wide:
        # of each word the sums, then its vector times them
        parts = sums.filter("word is not null").groupBy("word").agg(*[F.sum(F.col("sums")[j]).alias(f"_r{j}") for j in range(k)])
        outer = F.concat(*[_times("v", F.col(f"_r{j}")) for j in range(k)])
        g1 = _added(parts.join(rows.vec, "word").select(outer.alias("o")), "o", d1 * k).reshape(k, d1).T
    result = []
    for j, (c, p) in enumerate(zip(configs, points)):
        g = np.concatenate([g1[:, j], g2[:, j] * c.sentence, [gb[j]]])
        g[:-1] += c.l2 * p[:-1]
        result.append((loss[j] + c.l2 / 2 * float(p[:-1] @ p[:-1]), g))
    held.destroy()
    return result


def _times(vector: str, factor):
    return F.transform(vector, lambda a: a.cast("double") * factor)


def _slice_words(column, t0: int, t1: int) -> list[str]:
    import pyarrow.compute as pc
    return pc.list_flatten(column).slice(t0, t1 - t0).to_pylist()


def _added(df: DataFrame, column: str, n: int) -> np.ndarray:
    """Sum of array rows of length ``n``, added up by the executors."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    total = df.select(Summarizer.sum(array_to_vector(column)).alias("s")).first()
    return total["s"].toArray() if total and total["s"] is not None and len(total["s"]) else np.zeros(n)


# --- optimiser -----------------------------------------------------------------------------

def quasi_newton(x: np.ndarray, tolerance: float = TOLERANCE, memory: int = 10):
    """Limited-memory BFGS with backtracking, as a generator that is sent
    (loss, gradient) for every point it yields; returns the last point and the
    number of points.  It ends when the gradient vanishes or the loss has
    stopped falling."""
    f, g = yield x
    pairs, points, trail = [], 1, [f]
    while np.abs(g).max() > tolerance:
        q, back = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (y @ s)
            q -= a * y
            back.append(a)
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, float(np.linalg.norm(g)))
        for (s, y), a in zip(pairs, reversed(back)):
            q += s * (a - (y @ q) / (y @ s))
        slope, t = -(q @ g), 1.0
        while True:
            to = x - t * q
            f2, g2 = yield to
            points += 1
            if f2 <= f + 1e-4 * t * slope or t < 1e-12:
                break
            t *= max(0.1, min(0.5, -slope * t / (2 * (f2 - f - slope * t))))
        s, y = to - x, g2 - g
        if s @ y > 1e-14 * float(np.linalg.norm(s) * np.linalg.norm(y)):
            pairs = [*pairs[1 - memory:], (s, y)] if len(pairs) >= memory else [*pairs, (s, y)]
        x, f, g = to, f2, g2
        trail = [*trail[-10:], f]
        if t < 1e-12 or len(trail) == 11 and trail[0] - f <= min(FLAT, tolerance) * abs(f):
            break
    return x, points


def class_weights(rows: Rows, configs: list[Config]) -> dict[str, np.ndarray]:
    """(label x configuration) weights per corpus: balanced over the training
    set of each configuration, and summing to 1."""
    counts = rows.table.filter("train").groupBy("corpus").agg(
        F.sum(F.size("labels")).alias("n"), F.sum(F.aggregate("labels", F.lit(0), lambda a, b: a + b)).alias("p")).collect()
    out = {r["corpus"]: np.zeros((2, len(configs))) for r in counts}
    for j, c in enumerate(configs):
        used = [r for r in counts if c.train is None or r["corpus"] in c.train]
        pos = sum(r["p"] for r in used)
        neg = sum(r["n"] for r in used) - pos
        for r in used:
            out[r["corpus"]][:, j] = 0.5 / neg if neg else 0, 0.5 / pos if pos else 0
    return out


def spreads(rows: Rows) -> np.ndarray:
    """Root mean square of every feature, over words and over sentences; the
    steps are taken in units of it (the minimum is the same)."""
    d1, d2 = rows.dims

    def of(df: DataFrame, column: str, n: int) -> np.ndarray:
        square = F.concat(F.transform(column, lambda x: x.cast("double") * x.cast("double")), F.array(F.lit(1.0)))
        total = _added(df.select(square.alias("q")), "q", n + 1)
        return np.sqrt(total[:n] / max(total[n], 1))
    word = np.sqrt((rows.matrix ** 2).mean(axis=0)) if rows.matrix is not None and len(rows.matrix) else \
        of(rows.vec, "v", d1) if rows.matrix is None else np.zeros(d1)
    s = np.concatenate([word, of(rows.table, "sv", d2), [1.0]])
    return np.where(s > 0, s, 1.0)


def fit(rows: Rows, configs: list[Config], tolerance: float = TOLERANCE) -> list[Model]:
    """All configurations at once, each until it has converged."""
    bad = [c.loss for c in configs if c.loss not in LOSSES]
    if bad:
        raise ValueError(f"unknown losses: {bad}")
    d1, d2 = rows.dims
    weights, began, unit = class_weights(rows, configs), time.time(), spreads(rows)
    runs = [quasi_newton(np.zeros(d1 + d2 + 1), tolerance) for _ in configs]
    at = {j: next(r) for j, r in enumerate(runs)}
    models: dict[int, Model] = {}
    while at:
        live = sorted(at)
        found = losses(rows, [configs[j] for j in live], {c: w[:, live] for c, w in weights.items()}, [at[j] / unit for j in live])
        for j, (loss, gradient) in zip(live, found):
            try:
                at[j] = runs[j].send((loss, gradient / unit))
            except StopIteration as end:
                x, n = end.value[0] / unit, end.value[1]
                models[j] = Model(configs[j], x[:d1], x[d1:-1] * configs[j].sentence, float(x[-1]), n, time.time() - began)
                del at[j]
    return [models[j] for j in range(len(configs))]


# --- use ---------------------------------------------------------------------------------------

def _packed(models: list[Model]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.stack([m.word for m in models], axis=1), np.stack([m.sentence for m in models], axis=1),
            np.array([m.bias for m in models]))


def annotate(rows: Rows, models: list[Model]) -> DataFrame:
    """``(keys, train, labels, preds)``: 0/1 per word of every sentence; with
    several models one array each, in ``preds`` one after the other."""
    spark = rows.table.sparkSession
    w = _packed(models)
    table = rows.table if rows.matrix is not None else rows.scored(w[0])
    held, sent = spark.sparkContext.broadcast(w), rows.sent
    keys, k = list(rows.keys), len(models)
    schema = ST.StructType([*[rows.table.schema[c] for c in (*keys, "train", "labels")], ST.StructField("preds", ST.ArrayType(ST.IntegerType()))])

    def run(batches):
        import pyarrow as pa
        scores = word_scores(sent, held.value[0])
        for arrow in batches:
            x = Batch(arrow, scores, *held.value)
            out = []
            for s, e, t0, t1 in slices(x.size):
                of, z = x.tokens(s, e, t0, t1)
                hit = (z > 0).astype(np.int32)
                at = np.concatenate([[0], np.cumsum(x.size[s:e])])
                out += [hit[a:b].T.ravel().tolist() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*[arrow.column(arrow.schema.names.index(c)) for c in (*keys, "train", "labels")],
                                              pa.array(out, pa.list_(pa.int32()))], names=[f.name for f in schema.fields])
    assert k >= 1
    return table.mapInArrow(run, schema)


def evaluate(rows: Rows, models: list[Model], by: str = "corpus") -> DataFrame:
    """``(clf, train_set, features, <by>, tp, fp, fn, tn, train_time)`` over the
    sentences outside the training set, all models in one pass."""
    spark = rows.table.sparkSession
    w = _packed(models)
    test = replace(rows, table=rows.table.filter("not train"))
    table = test.table if rows.matrix is not None else test.scored(w[0])
    held, sent, k = spark.sparkContext.broadcast(w), rows.sent, len(models)

    def run(batches):
        import pyarrow as pa
        total: dict = {}
        scores = word_scores(sent, held.value[0])
        for arrow in batches:
            x = Batch(arrow, scores, *held.value)
            group = arrow.column(arrow.schema.names.index(by)).to_pylist()
            for s, e, t0, t1 in slices(x.size):
                of, z = x.tokens(s, e, t0, t1)
                hit, y = z > 0, x.y[t0:t1, None] > 0
                names, which = np.unique(np.array([group[i] for i in range(s, e)], dtype=object).astype(str), return_inverse=True)
                of = which[of - s]
                for g, name in enumerate(names):
                    h, t = hit[of == g], y[of == g]
                    counts = np.stack([(h & t).sum(0), (h & ~t).sum(0), (~h & t).sum(0), (~h & ~t).sum(0)], axis=1)
                    total[name] = total.get(name, 0) + counts
        rows_ = [(n, j, *map(int, c[j])) for n, c in total.items() for j in range(k)]
        cols = list(zip(*rows_)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), pa.string()), *[pa.array(list(c), pa.int64()) for c in cols[1:]]],
                                         names=["g", "m", "tp", "fp", "fn", "tn"])

    parts = table.mapInArrow(run, "g string, m long, tp long, fp long, fn long, tn long").groupBy("m", F.col("g").alias(by)) \
        .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    about = spark.createDataFrame([(j, m.config.name, m.config.loss, "+".join(m.config.train or ("all",)), "word+sentence" if m.config.sentence else "word",
                                    round(m.seconds, 3)) for j, m in enumerate(models)],
                                  "m long, config string, clf string, train_set string, features string, train_time double")
    return parts.join(F.broadcast(about), "m").drop("m")


def save(spark, models: list[Model], path: str) -> None:
    """IO12: the models as a small table (a row each)."""
    rows = [(m.config.name, m.config.loss, m.config.l2, list(m.config.train) if m.config.train is not None else None, m.config.sentence,
             m.word.tolist(), m.sentence.tolist(), m.bias, m.rounds, m.seconds) for m in models]
    spark.createDataFrame(rows, "name string, loss string, l2 double, train array<string>, sentence boolean, word array<double>, "
                                "sentence_weights array<double>, bias double, rounds int, seconds double").coalesce(1).write.parquet(path)


def load(spark, path: str) -> list[Model]:
    return [Model(Config(r["name"], r["loss"], r["l2"], tuple(r["train"]) if r["train"] is not None else None, r["sentence"]),
                  np.array(r["word"]), np.array(r["sentence_weights"]), r["bias"], r["rounds"], r["seconds"])
            for r in spark.read.parquet(path).collect()]
