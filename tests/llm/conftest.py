import pytest
from llm_data import CLASHES, EDGES, SCHEMA, SF
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (id, text) pairs; every other column is null. ``clash`` adds columns with internal names."""

    def make(pairs, clash=False):
        df = spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in pairs], SCHEMA)
        if clash:
            for name in CLASHES:
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def edges(make_docs):
    return make_docs(EDGES, clash=True)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
