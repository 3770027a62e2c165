from pathlib import Path

import pytest

from diffloom.storage import shared_folder

DOCS = "doc_id long, text string, kept string, node long, component_id string"


@pytest.fixture
def docs(spark):
    """Documents with extra columns whose names clash with those of operators."""

    def make(rows):
        full = [(i, text, "x", None, "y") for i, text in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make


@pytest.fixture
def table_path(spark, docs):
    def make(rows):
        path = shared_folder(spark)
        docs(rows).write.parquet(path)
        return path

    return make


@pytest.fixture
def words():
    """A stream of invented words with a fixed seed."""
    import random

    rng = random.Random(5)

    def make(n, vocabulary=400):
        return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))

    return make


@pytest.fixture
def small_tables():
    return Path("/root/testdata/sf0.001")
