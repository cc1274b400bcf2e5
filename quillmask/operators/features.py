"""Features (F6-F10): frequency-weighted sentence vectors, first-direction
removal, token feature rows, training matrix and a 2-D projection."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import patterns as P
from ..session import ship_package
from ..sources.tables import SENT_KEYS
from .lookup import zeros

BROADCAST_CELLS = 48_000_000    # numbers of a vector table that is sent to every executor, as they are stored (floats: 192 MB)
BROADCAST_ROWS = 1_500_000      # listed words that are sent along
HELD_BYTES = 64_000_000         # of one document's sentence vectors in memory
SLICE = 32_768                  # tokens whose vectors are in memory at once


def held_types(vec: DataFrame, limit: int = BROADCAST_CELLS) -> tuple[list[str], np.ndarray] | None:
    """Words and matrix of a vector table ``(word, v)`` of at most ``limit``
    numbers, sorted by word; None of a larger one, or of one whose vectors
    differ in width or hold nulls.  A null vector is none.  The rows are counted
    first and arrive as Arrow columns; the numbers keep their type."""
    vec = vec.filter("v is not null")
    size = vec.select(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), F.min(F.size("v")).alias("least"),
                      F.max(F.exists("v", lambda x: x.isNull())).alias("holes")).first()
    dim = size["d"] or 0
    if size["n"] * dim > limit or size["least"] != size["d"] or size["holes"]:
        return None
    rows = vec.select("word", "v").toArrow()
    words = rows.column("word").to_pylist()
    order = sorted(range(len(words)), key=words.__getitem__)
    flat = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return [words[i] for i in order], flat.reshape(len(words), dim)[np.array(order, dtype=np.int64)]


def flat_words(column) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Of an Arrow list column: index of each word among the distinct ones,
    these, and the words per row."""
    import pyarrow.compute as pc
    d = pc.list_flatten(column).dictionary_encode()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_pylist(), size.astype(np.int64)


def list_column(rows: np.ndarray):
    """Rows of a matrix as an Arrow list column."""
    import pyarrow as pa
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(rows.ravel()))


def weighted_sentence_vec(sent: DataFrame, vec: DataFrame, freq: DataFrame, a: float = P.SIF_A,
                          relative: bool = False, fold_case: bool = True, freq_fold_case: bool = False,
                          keys=SENT_KEYS, words: str = "words", limit: int = BROADCAST_CELLS, carried=()) -> DataFrame:
    """``sum_w 100 * v_w * a / (a + f(w)) / len`` per sentence of ``sent``
    (keys and word array), as ``(keys, carried, n_tokens, sv)``.

    ``f`` is the raw count of the word in ``freq`` (missing -> 1), or that count
    over the table total when ``relative``; vectors are looked up lower-cased
    unless ``fold_case`` is off, frequencies as written unless
    ``freq_fold_case``.

    Plan: a vector table of up to ``limit`` numbers, with the frequencies of its
    words, is sent to the executors and the words of a sentence are summed in
    the task that read them (Arrow batches, the distinct words of a batch
    looked up once): no shuffle.  A larger table is joined."""
    import pyarrow as pa
    ship_package(sent.sparkSession)
    types = held_types(vec, limit)
    listed = None
    if types is not None:
        key = F.lower("word") if fold_case and not freq_fold_case else F.col("word")
        rows = freq.select("word", "n", key.alias("_k")).join(vec.select(F.col("word").alias("_k")).distinct(), "_k").select("word", "n")
        listed = rows.limit(BROADCAST_ROWS + 1).toArrow().to_pydict()
    if listed is None or len(listed["word"]) > BROADCAST_ROWS:
        return _joined_sentence_vec(sent, vec, freq, a, relative, fold_case, freq_fold_case, keys, words, carried)
    total = float(freq.agg(F.sum("n")).first()[0] or 1) if relative else 1.0
    weight = {w: 100.0 * a / (a + n / total) for w, n in zip(listed["word"], listed["n"])}
    held = sent.sparkSession.sparkContext.broadcast((dict(zip(types[0], range(len(types[0])))), types[1], weight))
    keys = [*keys, *carried]
    default, n_keys = 100.0 * a / (a + 1.0 / total), len(keys)
    schema = ST.StructType([*[sent.schema[k] for k in keys], ST.StructField("n_tokens", ST.LongType()),
                            ST.StructField("sv", ST.ArrayType(ST.DoubleType()))])

    def run(batches):
        index, matrix, weights = held.value
        for batch in batches:
            which, distinct, size = flat_words(batch.column(n_keys))
            low = [w.lower() for w in distinct]
            row = np.array([index.get(f if fold_case else w, -1) for w, f in zip(distinct, low)], dtype=np.int64)
            scale = np.array([weights.get(f if freq_fold_case else w, default) for w, f in zip(distinct, low)], dtype=np.float64)
            of = np.repeat(np.arange(len(size)), size)
            hit = np.flatnonzero(row[which] >= 0) if len(row) else np.zeros(0, dtype=np.int64)
            which, of = which[hit], of[hit]
            out = np.zeros((len(size), matrix.shape[1]))
            for s in range(0, len(hit), SLICE):
                w, o = which[s:s + SLICE], of[s:s + SLICE]
                first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
                out[o[first]] += np.add.reduceat(matrix[row[w]] * scale[w][:, None], first, axis=0)
            out /= np.maximum(size, 1)[:, None]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n_keys)], pa.array(size), list_column(out)],
                                             names=[f.name for f in schema.fields])
    return sent.select(*keys, F.col(words).alias("_words")).mapInArrow(run, schema)


def _joined_sentence_vec(sent: DataFrame, vec: DataFrame, freq: DataFrame, a: float, relative: bool, fold_case: bool,
                         freq_fold_case: bool, keys, words: str, carried=()) -> DataFrame:
    """F6 by joins: the words of a sentence are counted once, their weights go
    into the vector table, and one row per (sentence, word) is joined to it."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    vec = vec.select(F.col("word").alias("_vk"), F.transform("v", lambda x: x.cast("double")).alias("_v"))
    total = freq.select(F.sum("n").cast("double")).scalar() if relative else F.lit(1.0)

    def scaled(rows, n, word, listed):
        w = F.lit(100.0 * a) / (F.lit(a) + n.cast("double") / total)
        return rows.withColumn("_c", w).select(F.lit(listed).alias("_listed"), F.col(word).alias("_w"),
                                               array_to_vector(F.transform("_v", lambda x: x * F.col("_c"))).alias("_f"))
    f = freq.select(F.col("word").alias("_k"), F.col("n").alias("_n"))
    listed = vec.join(f, F.expr("_vk = lower(_k)") if fold_case else F.col("_vk") == F.col("_k"))
    # words with a listed frequency under their own key, all words of the table under the default
    table = scaled(listed, F.col("_n"), "_k", 1).union(scaled(vec, F.lit(1), "_vk", 0)).checkpoint(eager=True)
    tok = sent.select(*keys, F.explode(words).alias("_word"))
    fk = F.lower("_word") if freq_fold_case else F.col("_word")
    vk = F.lower("_word") if fold_case else F.col("_word")
    hit = table.filter("_listed = 1").select(F.col("_w").alias("_w1"), F.col("_f").alias("_f1"))
    rest = table.filter("_listed = 0").select(F.col("_w").alias("_w0"), F.col("_f").alias("_f0"))
    j = tok.join(hit, fk == F.col("_w1"), "left").join(rest, vk == F.col("_w0"), "left") \
        .select(*keys, F.coalesce("_f1", "_f0").alias("_f")).filter("_f is not null")
    sums = j.groupBy(*keys).agg(Summarizer.sum(F.col("_f")).alias("_s")).select(*keys, vector_to_array("_s").alias("_s"))
    out = sent.select(*keys, *carried, F.size(words).cast("long").alias("n_tokens")).join(sums, list(keys), "left")
    dim = vec.select(F.max(F.size("_v"))).scalar()
    sv = F.coalesce(F.transform("_s", lambda x: x / F.col("n_tokens")), zeros(dim, "double"))
    return out.select(*keys, *carried, "n_tokens", sv.alias("sv"))


def by_document(df: DataFrame, doc_keys=("corpus", "doc_id"), sent_key: str = "sent_id") -> DataFrame:
    """``df`` with the rows of a document side by side in one partition, for
    ``remove_first_direction(together=True)``: words are shuffled once, before
    there are vectors.  ``_copies`` is the number of rows with the sentence's
    key (``times_copies``).  Rows with a null key are dropped, as by a join."""
    keys = [*doc_keys, sent_key]
    rows = df.dropna(subset=keys).repartition(*doc_keys).sortWithinPartitions(*keys)
    return rows.withColumn("_copies", F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def times_copies(df: DataFrame) -> DataFrame:
    """Every row as often as its sentence key occurs: what a join of the
    sentences with their vectors on that key gives."""
    return df.withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).drop("_copies")


def remove_first_direction(sentvec: DataFrame, doc_keys=("corpus", "doc_id"), sent_key: str = "sent_id",
                           col: str = "sv", together: bool = False, carried=()) -> DataFrame:
    """per document, subtract from every sentence vector its projection on
    the first left singular vector of the document's (dim x sentences) matrix.
    A one-sentence document therefore gets the zero vector.

    That direction is the first eigenvector of the document's Gram matrix, which
    is a sum over its sentences: tasks add up what they hold of a document, one
    dim x dim triangle per document and batch is shuffled, and the projection is
    an expression per sentence.  No task holds a document's vectors.

    ``together``: the rows of a document follow each other in one partition
    (``by_document``).  Then nothing is shuffled: the batches of a document wait
    (on disk beyond ``HELD_BYTES``) until its matrix is complete.  ``carried``
    columns stay."""
    keys = list(doc_keys)
    if together:
        return _removed_in_place(sentvec.select(*keys, sent_key, *carried, col), keys, col)
    j = sentvec.select(*keys, sent_key, *carried, col).join(first_directions(sentvec, doc_keys, col), keys)
    dot = F.aggregate(F.zip_with(col, "_u", lambda x, u: x * u), F.lit(0.0), lambda p, q: p + q)
    return j.withColumn("_d", dot).select(*keys, sent_key, *carried, F.zip_with(col, "_u", lambda x, u: x - u * F.col("_d")).alias(col))


def _removed_in_place(rows: DataFrame, keys: list[str], col: str) -> DataFrame:
    """F7 on rows whose documents follow each other within their partition."""
    import pyarrow as pa
    import pyarrow.compute as pc
    ship_package(rows.sparkSession)
    names, last = rows.columns, len(rows.columns) - 1

    def run(batches):
        import tempfile

        def matrix(batch):
            return pc.list_flatten(batch.column(last)).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)

        def solved(grams):
            return np.linalg.eigh(np.stack(grams), UPLO="U")[1][:, :, -1]

        def less(batch, x, u):
            """The batch without the directions ``u`` (a row per sentence)."""
            out = x - u * np.einsum("ij,ij->i", x, u)[:, None]
            return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(last)], list_column(out)], names=names)

        def released(held, gram):
            if held is None:
                return
            u = solved([gram])[0]
            for batch in held.batches():
                x = matrix(batch)
                yield less(batch, x, np.broadcast_to(u, x.shape))

        class Held:
            """The batches of the document that is not complete."""
            def __init__(self):
                self.file = tempfile.SpooledTemporaryFile(max_size=HELD_BYTES)
                self.writer = None

            def add(self, batch):
                self.writer = self.writer or pa.ipc.new_stream(self.file, batch.schema)
                self.writer.write_batch(batch)

            def batches(self):
                self.writer.close()
                self.file.seek(0)
                yield from pa.ipc.open_stream(self.file)
                self.file.close()

        held, open_key, open_gram = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            doc = list(zip(*[batch.column(names.index(k)).to_pylist() for k in keys]))
            first = [0, *[i for i in range(1, len(doc)) if doc[i] != doc[i - 1]]]
            end = [*first[1:], len(doc)]
            x = matrix(batch)
            grams = [x[a:b].T @ x[a:b] for a, b in zip(first, end)]
            if held is not None and doc[0] == open_key:
                open_gram = open_gram + grams[0]
                if len(first) == 1:
                    held.add(batch)
                    continue
                grams[0] = open_gram
                yield from released(held, open_gram)
                held = None
            elif held is not None:
                yield from released(held, open_gram)
                held = None
            cut = first[-1]
            if cut:
                done = grams[:-1]
                u = np.concatenate([solved(done[i:i + 256]) for i in range(0, len(done), 256)])
                yield less(batch.slice(0, cut), x[:cut], np.repeat(u, np.subtract(end, first)[:-1], axis=0))
            held, open_key, open_gram = Held(), doc[-1], grams[-1]
            held.add(batch.slice(cut))
        yield from released(held, open_gram)
    return rows.mapInArrow(run, rows.schema)


def first_directions(sentvec: DataFrame, doc_keys=("corpus", "doc_id"), col: str = "sv") -> DataFrame:
    """``(doc keys, _u)``: the first singular vector of every document."""
    import pyarrow as pa
    import pyarrow.compute as pc
    ship_package(sentvec.sparkSession)
    keys = list(doc_keys)
    key_fields = [sentvec.schema[k] for k in keys]
    partial = ST.StructType([*key_fields, ST.StructField("_g", ST.BinaryType())])
    schema = ST.StructType([*key_fields, ST.StructField("_u", ST.ArrayType(ST.DoubleType()))])

    def grams(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = pc.list_flatten(batch.column(len(keys))).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            doc = batch.select(keys).to_pandas().groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(doc, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(doc[order]) > 0]))
            upper = np.triu_indices(x.shape[1])
            out = [(rows := x[part]).T.dot(rows)[upper].tobytes() for part in np.split(order, first[1:])]
            named = batch.take(pa.array(order[first]))
            yield pa.RecordBatch.from_arrays([*[named.column(i) for i in range(len(keys))], pa.array(out, pa.binary())], names=[*keys, "_g"])

    def directions(batches):
        held, total, done = None, None, []

        def solved(rows):
            n = len(rows[0][1])
            d = int(((8 * n + 1) ** 0.5 - 1) / 2)
            g = np.zeros((len(rows), d, d))
            g[:, *np.triu_indices(d)] = np.stack([r[1] for r in rows])
            # the upper triangle is read; the last eigenvector is of the largest eigenvalue
            u = np.linalg.eigh(g, UPLO="U")[1][:, :, -1]
            names = [pa.array([r[0][i] for r in rows], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([*names, list_column(np.ascontiguousarray(u))], names=[*keys, "_u"])

        types = []
        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(keys))]
            for *key, raw in zip(*[batch.column(i).to_pylist() for i in range(len(keys) + 1)]):
                if key != held:
                    if held is not None:
                        done.append((held, total))
                    held, total = key, np.frombuffer(raw, dtype=np.float64)
                    if len(done) >= 256:
                        yield solved(done)
                        done = []
                else:
                    total = total + np.frombuffer(raw, dtype=np.float64)
        if held is not None:
            yield solved([*done, (held, total)])

    parts = sentvec.select(*keys, col).mapInArrow(grams, partial)
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(directions, schema)


def token_features(tok_vec: DataFrame, sentvec: DataFrame | None = None, keys=SENT_KEYS,
                   v: str = "v", sv: str = "sv", out: str = "features") -> DataFrame:
    """F8: word vector, optionally followed by the sentence vector (joined on
    the sentence key, or carried by the tokens as ``sv``)."""
    wv = F.transform(v, lambda x: x.cast("double"))
    if sentvec is None and sv in tok_vec.columns:
        return tok_vec.withColumn(out, F.concat(wv, F.col(sv)))
    if sentvec is None:
        return tok_vec.withColumn(out, wv)
    j = tok_vec.join(sentvec.select(*keys, sv), list(keys))
    return j.withColumn(out, F.concat(wv, F.col(sv)))


def training_matrix(features: DataFrame, label: str = "label", weight: str | None = None,
                    col: str = "features") -> DataFrame:
    """``(features vector, label double[, weight double])`` for MLlib.
    The count check of the original (one target per row) holds by
    construction: features and label come from the same token row."""
    from pyspark.ml.functions import array_to_vector
    cols = [array_to_vector(col).alias("features"), F.col(label).cast("double").alias("label")]
    if weight:
        cols.append(F.col(weight).cast("double").alias("weight"))
    return features.select(*cols)


def project_2d(type_vec: DataFrame, v: str = "v", seed_cols=("word", "annotated")) -> DataFrame:
    """F10 (re-aimed from UMAP): PCA to two components over distinct
    ``(word, annotated)`` rows; returns ``x, y, word, annotated``."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    d = type_vec.select(*seed_cols, array_to_vector(F.transform(v, lambda x: x.cast("double"))).alias("_f"))
    model = PCA(k=2, inputCol="_f", outputCol="_p").fit(d)
    p = model.transform(d).select(*seed_cols, vector_to_array("_p").alias("_a"))
    return p.select(F.col("_a")[0].alias("x"), F.col("_a")[1].alias("y"), *seed_cols)
