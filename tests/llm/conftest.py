import pytest


@pytest.fixture
def rows(spark):
    """A table from rows, with further columns whose names clash with those that operators use inside."""

    def make(data, schema):
        df = spark.createDataFrame(data, schema)
        for name in ("tid", "sid", "within", "canonical", "look", "batch"):
            if name not in df.columns:
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make
