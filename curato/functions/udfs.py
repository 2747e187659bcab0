"""X-04: functions for users' SQL that are written in Python: an aggregate over Arrow batches and a table function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def counts_entropy(n: pd.Series) -> float:
    """Entropy in nats of a distribution told by its counts, one row a value: pre-aggregated, so that a group is as large as its values."""
    p = n[n > 0].to_numpy(float)
    return float(-(p / p.sum() * np.log(p / p.sum())).sum()) if len(p) else 0.0


@F.udtf(returnType=T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("body", T.StringType())]))
class TextPieces:
    """A text in pieces of so many characters; an empty text is one empty piece, a null one none."""

    def eval(self, text: str, size: int) -> Iterator[tuple[int, str]]:
        if text is not None:
            for i in range(max(1, -(-len(text) // max(1, size)))):
                yield i, text[i * size : (i + 1) * size]


def register(spark: SparkSession) -> None:
    """Makes counts_entropy(n) and text_pieces(text, size) known to spark.sql."""
    spark.udf.register("counts_entropy", counts_entropy)
    spark.udtf.register("text_pieces", TextPieces)
