"""Lookups and vocabulary.

Vector tables are ``vec(word string, v array<float>)``.  Lookups join on the
(folded) word; tokens that find nothing get the ``<UNK>`` zero vector.  The
joins are left to AQE: a small table is broadcast at runtime, a big one is
shuffled on the word (AQE splits a hot word).  Wide vectors are joined to
distinct types or (sentence, type) counts, never copied per token first.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import patterns as P
from ..session import ship_package, stored
from .rank import global_rank

SENT_CELLS = 48_000_000         # numbers of a vector table that a join sends to every executor


def zeros(dim: Column | int, dtype: str = "float") -> Column:
    return F.array_repeat(F.lit(0.0).cast(dtype), dim if isinstance(dim, Column) else F.lit(dim))


def as_double(v) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def vector_dim(vec: DataFrame, v: str = "v") -> Column:
    """The width of a vector table, as a scalar subquery."""
    return vec.select(F.max(F.size(v))).scalar()


def occurrences(tok: DataFrame) -> Column:
    """The number of tokens as an aggregate: rows, or the sum of ``n`` where the
    rows are tokens counted before."""
    return F.sum("n") if "n" in tok.columns else F.count(F.lit(1))


def type_counts(tok: DataFrame, word: str = "word", fold_case: bool = True) -> DataFrame:
    """``(word, n)`` over all (counted) tokens (map-side partial counts)."""
    w = F.lower(word) if fold_case else F.col(word)
    return tok.groupBy(w.alias("word")).agg(occurrences(tok).alias("n"))


def rank_types(types: DataFrame, out: str = "rank") -> DataFrame:
    """0-based rank by ``(n desc, word asc)`` — distributed, see ``rank.py``."""
    return global_rank(types, [F.col("n").desc(), F.col("word").asc()], out)


def vectors_by_rank(ranked: DataFrame, embeddings: DataFrame, rank: str = "rank") -> DataFrame:
    """Give the type of rank r the embedding with ``vec_id = r`` (FIXTURES.md
    §C); types ranked beyond the table get none."""
    e = embeddings.select(F.col("vec_id").alias(rank), F.col("embedding").alias("v"))
    return ranked.join(e, rank, "inner").select("word", "v", F.col(rank).alias("line_no"))


def special_vectors(spark, dim: Column) -> DataFrame:
    """``<EOS>`` ones, ``<UNK>`` zeros, ``<SOS>`` minus ones."""
    def row(word, val):
        return spark.range(1).select(F.lit(word).alias("word"),
                                     F.array_repeat(F.lit(val).cast("float"), dim).alias("v"))
    return row(P.EOS_TOKEN, 1.0).unionByName(row(P.UNK_TOKEN, 0.0)).unionByName(row(P.SOS_TOKEN, -1.0))


def dedupe_vectors(vec: DataFrame, case_sensitive: bool = False, line_no: str = "line_no") -> DataFrame:
    """one vector per (folded) word; the last line wins."""
    w = F.col("word") if case_sensitive else F.lower("word")
    return vec.groupBy(w.alias("word")).agg(F.max_by("v", line_no).alias("v"), F.max(line_no).alias(line_no))


def lookup_vectors(tok: DataFrame, vec: DataFrame, word: str = "word", case_sensitive: bool = False,
                   out: str = "v") -> DataFrame:
    """Token -> vector (left outer), ``<UNK>`` zeros when missing.  A table
    of up to ``SENT_CELLS`` numbers is sent to the executors, so neither tokens
    nor vectors are shuffled; a larger one is joined as Spark sees fit."""
    vec = stored(vec.select("word", "v"), "vectors")
    dim = vector_dim(vec)
    key = F.col(word) if case_sensitive else F.lower(word)
    v = vec.select(F.col("word").alias("_k"), F.col("v").alias("_v"))
    size = vec.select(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    v = F.broadcast(v) if size["n"] * max(size["d"] or 0, 0) <= SENT_CELLS else v
    j = tok.withColumn("_k", key).join(v, "_k", "left")
    return j.withColumn(out, F.coalesce("_v", zeros(dim))).drop("_k", "_v")


def lookup_freq(tok: DataFrame, freq: DataFrame, word: str = "word", fold_case: bool = False,
                out: str = "f") -> DataFrame:
    """Token -> frequency; missing words count 1.  Case-sensitive unless
    ``fold_case``, like the original sentence-weight pass."""
    key = F.lower(word) if fold_case else F.col(word)
    f = freq.select(F.col("word").alias("_k"), F.col("n").alias("_n"))
    return tok.withColumn("_k", key).join(f, "_k", "left") \
        .withColumn(out, F.coalesce("_n", F.lit(1)).cast("long")).drop("_k", "_n")


def oov_tokens(tok: DataFrame, vec: DataFrame, word: str = "word", case_sensitive: bool = False) -> DataFrame:
    """Types without a vector, with their token counts."""
    types = type_counts(tok, word, fold_case=not case_sensitive)
    return types.join(vec.select("word"), "word", "left_anti")


def combine_vectors(vecs: list[DataFrame], dims: list[int] | None = None) -> DataFrame:
    """concatenate several vector tables; a word missing from one table
    gets that table's zeros (full outer join on the word).

    ``dims``, the widths: the last table lists all words, each as often as it is
    wanted and with columns that stay; the others list a word once and are sent
    to the executors.  Then nothing is shuffled."""
    if dims:
        out, last = vecs[-1].withColumnRenamed("v", f"_v{len(vecs) - 1}"), len(vecs) - 1
        for i, v in enumerate(vecs[:-1]):
            out = out.join(F.broadcast(v.select("word", F.col("v").alias(f"_v{i}"))), "word", "left")
        parts = [F.coalesce(as_double(f"_v{i}"), zeros(d, "double")) for i, d in enumerate(dims)]
        return out.withColumn("v", F.concat(*parts)).drop(*[f"_v{i}" for i in range(last + 1)])
    dims = [vector_dim(v) for v in vecs]
    out = None
    for i, v in enumerate(vecs):
        v = v.select("word", as_double("v").alias(f"_v{i}"))
        out = v if out is None else out.join(v, "word", "full_outer")
    parts = [F.coalesce(f"_v{i}", zeros(d, "double")) for i, d in enumerate(dims)]
    return out.select("word", F.concat(*parts).alias("v"))


def char_trigrams(word: Column) -> Column:
    """Pieces of a word: its character trigrams, the word itself when shorter."""
    n = F.length(word)
    tri = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(word, i, 3))
    return F.when(n >= 3, tri).otherwise(F.array(word))


def sent_pieces(piece_vec: DataFrame) -> Broadcast | None:
    """A (written) piece table of up to ``features.BROADCAST_CELLS`` numbers on
    every executor, as index and matrix; None of a larger one, or of one that
    lists a piece twice (which counts twice)."""
    from .features import held_types
    types = held_types(piece_vec)
    if types is None or len(set(types[0])) < len(types[0]):
        return None
    return piece_vec.sparkSession.sparkContext.broadcast((dict(zip(types[0], range(len(types[0])))), types[1]))


def subword_vectors(word_piece: DataFrame, piece_vec: DataFrame | Broadcast) -> DataFrame:
    """a word's vector is the sum of its pieces' vectors (pieces without a
    vector add zeros).  ``word_piece(word, piece)`` with one row per piece
    occurrence.  The sum folds one word's pieces (bounded by the word).

    With ``sent_pieces``, ``word_piece`` has a row per word with the array
    ``pieces``; its other columns stay, and nothing is shuffled.

    The pieces of a word are folded as strings; a piece table of up to
    ``features.BROADCAST_CELLS`` numbers is sent to the executors, where they
    are looked up and summed, so no vector is shuffled.  A larger one, or one
    that lists a piece twice, is joined."""
    if isinstance(piece_vec, Broadcast):
        return _summed_pieces(word_piece, piece_vec)
    piece_vec = stored(piece_vec.select("word", "v"), "piece-vectors")
    held = sent_pieces(piece_vec)
    if held is None:
        return _joined_subwords(word_piece, piece_vec)
    return _summed_pieces(word_piece.groupBy("word").agg(F.collect_list("piece").alias("pieces")), held)


def _summed_pieces(rows: DataFrame, held: Broadcast) -> DataFrame:
    """F2 of ``(word, pieces)`` and other columns, which stay."""
    import pyarrow as pa

    from .features import flat_words, list_column
    ship_package(rows.sparkSession)
    own = [f for f in rows.schema.fields if f.name != "pieces"]
    schema = ST.StructType([*own, ST.StructField("v", ST.ArrayType(ST.DoubleType())), ST.StructField("n_pieces", ST.LongType())])

    def run(batches):
        index, matrix = held.value
        for batch in batches:
            which, distinct, size = flat_words(batch.column(len(own)))
            row = np.array([index.get(p, -1) for p in distinct] or [-1], dtype=np.int64)[which]
            of = np.repeat(np.arange(len(size)), size)[row >= 0]
            row = row[row >= 0]
            out = np.zeros((len(size), matrix.shape[1]))
            if len(of):
                first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                out[of[first]] = np.add.reduceat(matrix[row].astype(np.float64), first, axis=0)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(own))], list_column(out), pa.array(size)], names=schema.names)
    return rows.select(*[f.name for f in own], "pieces").mapInArrow(run, schema)


@dataclass(frozen=True)
class TypeVectors:
    """The vectors of all types as tables that are sent to the executors: word
    vectors and, if ``pieces``, subword vectors behind them.  A row per type is
    made where it is read, never written or shuffled for its own sake."""
    words: DataFrame
    dim: int
    pieces: Broadcast | None = None

    def attach(self, rows: DataFrame) -> DataFrame:
        """``rows(word, ...)`` with the vector ``v`` of the word."""
        if self.pieces is None:
            return rows.join(F.broadcast(self.words.select("word", "v")), "word", "left")
        sub = subword_vectors(rows.withColumn("pieces", char_trigrams(F.col("word"))), self.pieces).drop("n_pieces")
        return combine_vectors([self.words, sub], [self.dim, self.pieces.value[1].shape[1]])


def type_vectors(word_vec: DataFrame, pieces: Broadcast | None = None) -> TypeVectors | None:
    """None if the (written) word vectors cannot be sent: over ``SENT_CELLS``
    numbers, none at all, of several widths, or a word listed twice."""
    v = F.col("v")
    size = word_vec.select(F.count(F.lit(1)).alias("n"), F.count_distinct("word").alias("words"), F.max(F.size(v)).alias("d"),
                           F.min(F.when(v.isNotNull(), F.size(v))).alias("least")).first()
    if not size["n"] or (size["d"] or 0) < 1 or size["d"] != size["least"] or size["n"] != size["words"] or size["n"] * size["d"] > SENT_CELLS:
        return None
    return TypeVectors(word_vec, size["d"], pieces)


def _joined_subwords(word_piece: DataFrame, piece_vec: DataFrame) -> DataFrame:
    dim = vector_dim(piece_vec)
    pv = piece_vec.select(F.col("word").alias("piece"), "v")
    j = word_piece.join(pv, "piece", "left").withColumn("v", F.coalesce("v", zeros(dim)))
    g = j.groupBy("word").agg(F.collect_list(F.transform("v", lambda x: x.cast("double"))).alias("_vs"),
                              F.count(F.lit(1)).alias("n_pieces"))
    start = F.transform(F.element_at("_vs", 1), lambda x: F.lit(0.0))  # groups are never empty
    summed = F.aggregate("_vs", start, lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b))
    return g.select("word", summed.alias("v"), "n_pieces")


def build_vocabulary(tok: DataFrame, case_sensitive: bool = False,
                     order=("corpus", "doc_id", "sent_id", "pos")) -> DataFrame:
    """distinct (folded) words numbered by first occurrence, then
    ``<EOS>``, ``<UNK>``, ``<SOS>``.  The first occurrence is a min per type;
    the numbering ranks the types only (distributed rank), which are written
    once."""
    w = F.col("word") if case_sensitive else F.lower("word")
    first = stored(tok.groupBy(w.alias("word")).agg(F.min(F.struct(*order)).alias("_first")), "first-places")
    ranked = global_rank(first, [F.col(f"_first.{c}") for c in order], "id").select("word", "id")
    n = first.select(F.count(F.lit(1))).scalar()
    spark = tok.sparkSession
    specials = spark.range(3).select(
        F.element_at(F.array(*[F.lit(x) for x in (P.EOS_TOKEN, P.UNK_TOKEN, P.SOS_TOKEN)]),
                     (F.col("id") + 1).cast("int")).alias("word"),
        (n + F.col("id")).alias("id"))
    return ranked.unionByName(specials)


def pair_docs(target: DataFrame, pred: DataFrame, doc: str = "doc") -> DataFrame:
    """Keep target rows whose document also has predictions."""
    return target.join(pred.select(doc).distinct(), doc, "left_semi")
