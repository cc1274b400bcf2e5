"""Driver parquet tables and the common corpus view over them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS_KEYS = ["corpus", "doc_id"]
SENT_KEYS = ["corpus", "doc_id", "sent_id"]
TURNS = 1 << 32
TOKEN_KEYS = ["corpus", "doc_id", "sent_id", "pos"]


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Parquet scan with the projection applied at once, so only ``cols``
    reach the ``ReadSchema``."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def union_corpora(frames: dict[str, DataFrame]) -> DataFrame:
    """IO2: several ``(doc_id, text)`` frames -> one frame with a ``corpus``
    column (no shuffle: ``Union`` just concatenates partitions)."""
    out = None
    for name, df in frames.items():
        df = df.select(F.lit(name).alias("corpus"), F.col("doc_id").cast("long").alias("doc_id"), "text")
        out = df if out is None else out.unionByName(df)
    return out


def corpora(spark: SparkSession, sf_dir: str, which: tuple[str, ...] = ("documents", "conversations", "benchmark")) -> DataFrame:
    """``(corpus, doc_id, text)`` over the three text tables (FIXTURES.md §C):
    conversation turns are documents keyed ``conv_id * 2**32 + turn`` (no two
    turns share a key; an id too large for that is an error, not a clash)."""
    frames = {}
    if "documents" in which:
        frames["documents"] = read_table(spark, sf_dir, "documents", "doc_id", "text")
    if "conversations" in which:
        frames["conversations"] = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text") \
            .select((F.col("conv_id") * TURNS + F.col("turn")).alias("doc_id"), "text")
    if "benchmark" in which:
        frames["benchmark"] = read_table(spark, sf_dir, "benchmark", "item_id", "text") \
            .select(F.col("item_id").alias("doc_id"), "text")
    return spread_documents(union_corpora(frames))


def spread_documents(docs: DataFrame, keys=("corpus", "doc_id")) -> DataFrame:
    """The documents as scanned, unless the session asks for a spread
    (``quillmask.spreadPartitions``, off by default): then they are hashed on
    the document key into that many partitions.  It is for tests and benches on
    tables of one row group, which arrive as one partition; at scale the scan
    itself provides the parallelism and no text should move."""
    n = int(docs.sparkSession.conf.get("quillmask.spreadPartitions", "0"))
    return docs.repartition(n, *keys) if n else docs
