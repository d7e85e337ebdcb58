from __future__ import annotations

import os

import pytest
from pyspark.sql import DataFrame, SparkSession, functions as F

from tradelens.llm.common import read, ship_package

from .helpers import CLASHES, DATA, SCHEMA, edge_rows


@pytest.fixture(scope="session", autouse=True)
def shipped(spark: SparkSession) -> None:
    ship_package(spark)


@pytest.fixture(scope="session")
def edge_docs(spark: SparkSession) -> DataFrame:
    docs = spark.createDataFrame(edge_rows(), SCHEMA)
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.fixture(scope="session")
def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark: SparkSession) -> DataFrame:
    assert os.path.isdir(DATA)
    return read(spark, DATA, "documents")


@pytest.fixture(scope="session")
def rows(docs: DataFrame) -> list:
    return docs.collect()
