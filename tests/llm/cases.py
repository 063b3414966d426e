"""Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and river stone light under over green house walks seven quickly often never tree bird north".split()


def prose(n, seed):
    r = random.Random(seed)
    lines, line = [], []
    for _ in range(n):
        line.append(r.choice(WORDS) + str(r.randint(0, 400)))
        if r.random() < 0.1:
            lines.append(" ".join(line))
            line = []
    return "\n".join([*lines, " ".join(line)])


def rows():
    base = prose(120, 1)
    out = [(i, prose(80, i + 10), "en", f"src{i % 3}", None) for i in range(20)]
    out += [(100, base, "en", "a", 1), (101, base, None, "a", 1), (101, base, None, "a", 1), (102, base + " more", "en", None, 1)]
    out += [(103, None, None, None, None), (104, "", "en", "a", 0), (105, " \n\t ", "en", "a", 3), (None, "text without number", "en", "a", 19), (106, "x" * 200_000, "en", "a", 200_000), (107, "Footer line\n" + prose(60, 77), "en", "b", 0)]
    out += [(200 + i, f"  FOOTER line \n{prose(60, 900 + i)}\n\n", "en", "b", 0) for i in range(12)]
    return out


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def clashing(spark):
    """With extra columns named as those that operators make."""
    from pyspark.sql import functions as F

    d = docs(spark)
    for c in ("node", "keys", "kept", "rule", "n_words", "slot", "position", "_source", "_order", "_t", "_kept", "_bytes", "t", "key", "salt", "bucket", "comp", "held_out", "row", "_c0", "_within", "word"):
        d = d.withColumn(c, F.lit("x"))
    return d


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
