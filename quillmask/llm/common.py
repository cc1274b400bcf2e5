"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import ctypes

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, scratch_path, ship_package, shuffles_dropped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepared(spark: SparkSession) -> SparkSession:
    """Shared folder and package on the executors; called by every operator
    that writes intermediate tables or runs Python in tasks."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage
    with a table that outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(nullable(df.schema)).parquet(path)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names based on ``names`` that ``df`` doesn't have (in any case),
    so helper columns never clash with the caller's."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        c = f"__{n}"
        while c.lower() in have:
            c += "_"
        have.add(c.lower())
        out.append(c)
    return out


def give_back() -> None:
    """Returns what a worker has freed to the system; the C library keeps the
    pages of large arrays otherwise, over all later tasks of the worker."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):       # another C library
        pass
