import os
import random
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from made_up import make_text  # noqa: E402

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

@pytest.fixture(scope="session")
def hard_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, texts without words or letters."""
    rng = random.Random(7)
    rows = []
    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        rows.append((i, make_text(rng, lang, rng.randint(5, 120)), lang, "s", 1))
    rows += [(100, None, "en", "s", None), (101, "", "en", None, 0), (102, "  \n\t ", None, "s", 5), (103, "12 34 !!", "en", "s", 8),
             (104, make_text(rng, "en", 9000), "en", "s", 1), (105, rows[3][1], "de", "t", 1), (106, rows[3][1], "de", "t", 1),
             (None, rows[5][1], "en", "s", 1), (None, "nobody's text", None, None, None), (107, "x" * 3000, "en", "s", 1),
             (108, "a<|endoftext|> b  c\n\nd's <|startoftext|>é", "en", "s", 1)]
    return rows + [rows[7], rows[7]]


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    """The hard rows with further columns, named as the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(hard_rows, DOCUMENTS)
    for name in ("digest", "keep_id", "fp", "fingerprint", "bucket", "place", "block", "rank", "length", "score", "part", "ids"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
