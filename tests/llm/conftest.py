import random

import pytest
from pyspark.sql import types as T

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("row", T.StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """texts by doc_id as a table, with columns whose names the operators use inside."""

    def make(pairs):
        return spark.createDataFrame([(i, t, "k", 1, "r") for i, t in pairs], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, no letters, non-Latin, very long, and repeated rows."""
    rng = random.Random(1)
    long = " ".join(words(rng, 30_000))
    return [(0, None), (1, ""), (2, " \n\t "), (3, "word"), (4, "!!! ??? ..."), (5, "日本語 текст ñandú Ω"), (6, long), (7, "same text here twice"), (8, "same text here twice"), (8, "same text here twice"), (None, "no key at all")]
