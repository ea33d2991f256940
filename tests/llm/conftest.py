from __future__ import annotations

import pytest
from pyspark.sql import types as T

#: Texts with every odd case: null, empty, blanks, one word, ties, repeated lines, other scripts, a very long one.
ODD = [None, "", "   \n\t ", "word", "Word", "a b c", "a b c d e", "a b c d e", "line one is here\nline one is here\n\nlast",
       "ÉÀ ü　日本語 🙂 1½ ² <s> ▁x\x00y", "x " * 40_000, "\n".join(f"number {k} of many" for k in range(3_000))]
SCHEMA = T.StructType([T.StructField(n, T.StringType() if n in ("text", "lang", "source") else T.LongType()) for n in ("doc_id", "text", "lang", "source", "n_chars")])


@pytest.fixture(scope="session")
def odd_docs(spark):
    """One row for each odd text, a repeated row, and a row of nulls."""
    rows = [(k, t, "en" if k % 2 else None, None if k % 3 else "s", None) for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[6], (None, None, None, None, None), (None, "a b c d e f", "en", "s", 1)], SCHEMA).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
