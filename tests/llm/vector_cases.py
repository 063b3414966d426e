"""Rows of embeddings that the operators on vectors must take."""

import numpy as np
from pyspark.sql import functions as F

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def table(n, dim, seed=1):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(dim, dim)) * np.exp(-np.arange(dim) / 4)
    return [(int(i), [float(x) for x in r.normal(size=dim) @ mix / 3], None if i % 11 == 0 else int(i % 7)) for i in range(n)]


def odd(dim):
    """Null vectors, null and non-finite entries, a null vec_id, repeated rows and copies of a vector."""
    v = [0.25 * (i % 5) - 0.4 for i in range(dim)]
    out = [(9001, None, 1), (9002, [*v[1:], None], 1), (9003, [float("nan"), *v[1:]], 2), (9004, [*v[1:], float("inf")], 2), (9005, [float("-inf"), *v[1:]], None)]
    return [*out, (None, v, 3), (9006, v, None), (9006, v, None), (9006, [-x for x in v], 3), *((9100 + i, v, 3) for i in range(60))]


def clashing(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("component", "n", "deviation", "whitened", "explained", "k", "value", "dim", "code", "error", "label_error", "block", "part", "entry", "total", "sums", "count", "_label", "_c0"):
        df = df.withColumn(c, F.lit("x"))
    return df
