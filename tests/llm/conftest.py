import pytest


@pytest.fixture
def frame(spark):
    """A DataFrame of rows with an extra column whose name an operator might use."""

    def make(rows, schema, extra=("body", "fp", "size", "hash", "_x", "node", "h", "_id", "_h", "_n0", "_at", "c0")):
        from pyspark.sql import functions as F

        taken = [c.split()[0] for c in schema.split(", ")]
        return spark.createDataFrame(rows, schema).withColumns({c: F.lit("extra") for c in extra if c not in taken})

    return make
