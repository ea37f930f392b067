import sys

import pytest
from pyspark.sql import types as T

ROOT_DIR = __file__.rsplit("/tests/", 1)[0]
sys.path.insert(0, ROOT_DIR)

SMALL = "/root/testdata/sf0.001"
# other columns of the driver's table, and names the operators use themselves
EXTRA = {"lang": "en", "source": "s", "n_chars": 1, "score": 0.5, "h": 7, "n": 3, "cls": 1, "row": 2,
         "label": "x", "line": 9, "component": 4, "places": "p", "key": 1, "held_out": True}
DOC_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    + [T.StructField(k, {str: T.StringType(), int: T.LongType(), float: T.DoubleType(),
                         bool: T.BooleanType()}[type(v)]) for k, v in EXTRA.items()])


@pytest.fixture(scope="session")
def docs(spark):
    """Builds a documents table of (doc_id, text) rows, with clashing extra columns."""
    def make(rows):
        return spark.createDataFrame([(i, t, *EXTRA.values()) for i, t in rows], DOC_SCHEMA)
    return make


@pytest.fixture(scope="session", autouse=True)
def ready(spark):
    from daycast.llm.common import prepare
    prepare(spark)


def words(*numbers, stem="word"):
    return " ".join(f"{stem}{n}" for n in numbers)


# nulls, empty and blank texts, one very long text, ties, repeated rows
ODD = [(1, None), (2, ""), (3, " \t\n "), (None, "alpha beta gamma delta epsilon"), (None, None),
       (4, "one"), (4, "one"), (5, " ".join(f"w{i}" for i in range(30_000))), (6, "É Ü ß 漢字 🙂 ́x"),
       (7, "same text here for two rows of this table"), (8, "same text here for two rows of this table")]
