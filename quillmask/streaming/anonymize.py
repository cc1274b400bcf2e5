"""Anonymise documents as they arrive.

Stateless: each micro-batch goes through the same row-local plan as the
batch flagship (sentence split, tokens, rule spans, masked text inside the
document row), so the stream needs no state store and no watermark.  The sink
is a parquet folder beside its checkpoint.  ``availableNow`` processes what is
there and stops; run again with the same sink, it goes on after what it has
processed (the source offsets live in the checkpoint).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators.text import anonymize_documents
from ..session import scratch_path
from ..sources.tables import TURNS

SOURCES = {
    "documents": ("doc_id long, text string, lang string, source string, n_chars long",
                  F.col("doc_id")),
    "conversations": ("conv_id long, turn long, role string, text string",
                      F.col("conv_id") * TURNS + F.col("turn")),
    "benchmark": ("item_id long, text string", F.col("item_id")),
}


def document_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The three text tables as one stream of ``(corpus, doc_id, text)``; all
    files there are at a trigger, unless bounded."""
    out = None
    for name, (schema, key) in SOURCES.items():
        reader = spark.readStream.schema(schema)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        s = reader.parquet(f"{sf_dir.rstrip('/')}/{name}*.parquet")
        s = s.select(F.lit(name).alias("corpus"), key.cast("long").alias("doc_id"), "text")
        out = s if out is None else out.unionByName(s)
    return out


def anonymize_stream(stream: DataFrame, pattern: str = P.GOLD) -> DataFrame:
    return anonymize_documents(stream, pattern=pattern)


def run_to_sink(spark: SparkSession, masked: DataFrame, sink: str | None = None, checkpoint: str | None = None) -> str:
    """Write the stream to a parquet folder (append, exactly-once through the
    checkpoint) and process everything available; returns the folder.  Pass
    the same ``sink`` and ``checkpoint`` to go on where the last run ended."""
    sink = sink or scratch_path(spark, "stream_anonymize")
    q = (masked.writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint or sink + "-checkpoint").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return sink
