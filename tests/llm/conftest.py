import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows to a DataFrame with a DDL schema, in several partitions."""
    def make(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts) if rows else spark.createDataFrame([], schema)
    return make
