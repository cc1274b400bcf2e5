"""Request payloads for a text-analytics service and parsing of its
responses (IO14, IO15).  The HTTP call itself is not part of the engine."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import patterns as P
from ..operators.rank import global_rank

KEYPHRASE_RESPONSE = ST.StructType([
    ST.StructField("documents", ST.ArrayType(ST.StructType([
        ST.StructField("id", ST.StringType()), ST.StructField("keyPhrases", ST.ArrayType(ST.StringType()))]))),
    ST.StructField("errors", ST.ArrayType(ST.StructType([
        ST.StructField("id", ST.StringType()), ST.StructField("message", ST.StringType())])))])

SENTIMENT_RESPONSE = ST.StructType([
    ST.StructField("documents", ST.ArrayType(ST.StructType([
        ST.StructField("id", ST.StringType()), ST.StructField("score", ST.DoubleType())]))),
    ST.StructField("errors", ST.ArrayType(ST.StructType([
        ST.StructField("id", ST.StringType()), ST.StructField("message", ST.StringType())])))])


def request_batches(docs: DataFrame, text: str = "text", order=("corpus", "doc_id"), language: str = "en",
                    n_batches: int = P.N_REQUEST_BATCHES) -> DataFrame:
    """IO14: number the documents in order (id "0".."n-1") and deal them into
    exactly ``n_batches`` consecutive batches of ``floor(n / n_batches)``, the
    last taking the rest (all in the last one when n < n_batches).

    Returns one row per document ``(batch, id, payload)`` where ``payload`` is
    the document's JSON object.  A batch is a tenth of the corpus, so the
    per-batch ``{"documents": [...]}`` envelope is produced by the writer
    (``write_request_batches``), never collected into one row."""
    ranked = global_rank(docs, list(order), "_rn")
    n = docs.select(F.count(F.lit(1))).scalar()
    k = F.floor(n / F.lit(n_batches))
    batch = F.when(k > 0, F.least(F.floor(F.col("_rn") / k), F.lit(n_batches - 1))).otherwise(F.lit(n_batches - 1))
    doc = F.struct(F.col("_rn").cast("string").alias("id"), F.lit(language).alias("language"),
                   F.col(text).alias("text"))
    return ranked.select(batch.cast("int").alias("batch"), F.col("_rn").alias("id"), F.to_json(doc).alias("payload"))


def write_request_batches(batches: DataFrame, path: str) -> None:
    """One folder per batch (``batch=<i>``); inside, the documents of the batch
    as JSON lines — the streaming form of one request body.  Rows are
    range-partitioned on the document id, so every task writes one contiguous
    id range (a batch is a tenth of the corpus and is never one task's
    work); part files of a batch folder follow id order."""
    batches.repartitionByRange("id").sortWithinPartitions("id") \
        .select("batch", "payload").write.mode("overwrite").partitionBy("batch").text(path)


def batch_summary(batches: DataFrame, n_batches: int = P.N_REQUEST_BATCHES) -> DataFrame:
    """Per batch: documents, first and last id; empty batches included."""
    spark = batches.sparkSession
    agg = batches.groupBy("batch").agg(F.count(F.lit(1)).alias("n_docs"), F.min("id").alias("first_id"),
                                       F.max("id").alias("last_id"))
    return spark.range(n_batches).select(F.col("id").cast("int").alias("batch")) \
        .join(agg, "batch", "left").fillna(0, ["n_docs"])


def parse_keyphrase_responses(responses: DataFrame, col: str = "response") -> tuple[DataFrame, DataFrame]:
    """IO15: service JSON -> ``(id, phrase)`` (duplicates kept) and the error
    list ``(id, message)`` split off.  Results are matched by id, not by the
    order of the response."""
    p = responses.select(F.from_json(col, KEYPHRASE_RESPONSE).alias("r"))
    phrases = p.select(F.explode("r.documents").alias("d")) \
        .select(F.col("d.id").alias("id"), F.explode("d.keyPhrases").alias("phrase"))
    errors = p.select(F.explode("r.errors").alias("e")).select("e.id", "e.message")
    return phrases, errors


def parse_sentiment_responses(responses: DataFrame, col: str = "response") -> tuple[DataFrame, DataFrame]:
    """IO15 for scores: ``(id, score)`` plus the errors."""
    p = responses.select(F.from_json(col, SENTIMENT_RESPONSE).alias("r"))
    scores = p.select(F.explode("r.documents").alias("d")).select("d.id", "d.score")
    errors = p.select(F.explode("r.errors").alias("e")).select("e.id", "e.message")
    return scores, errors
