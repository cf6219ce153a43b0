import hashlib
import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("row_id", LongType())])


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture
def prose():
    """Deterministic invented prose."""

    def make(seed, words=120):
        rnd = random.Random(seed)
        return " ".join("".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(2, 8))) for _ in range(words))

    return make


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text) with columns whose names clash with those used inside the operators."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", 5) for i, t in rows], DOCS)

    return make
