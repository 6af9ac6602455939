"""Small documents that hold the awkward cases, shared by the operator tests."""

import random

from pyspark.sql import Row
from pyspark.sql import types as T

# clashing names on purpose: the operators' own output and helper columns
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in ("id", "fp", "size", "kept", "piece", "blob", "spans", "n_words", "start")],
])


def texts(seed: int = 1, n: int = 60) -> list:
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "dél", "été.", "日本", "x y", "\x1cq", "MIT", "license", "under", "the"]
    words += ["w%d" % i for i in range(40)]

    def prose(k):
        return " ".join(r.choice(words) for _ in range(k)) + "."

    out = [None, "", " ", "\n\n", "one", "two words", prose(30), prose(30)]
    for _ in range(n):
        out.append("\n".join(prose(r.randint(1, 40)) for _ in range(r.randint(1, 6))))
    long = "\n".join(prose(r.randint(5, 60)) for _ in range(300))
    out += [long, long + " tail", "a" * 5000, "ab " * 3000, out[10], out[10], out[12] + " extra", "\t\x0b\x0c tabs\rand\r\nends"]
    return out


def documents(spark, values=None, seed: int = 1, repeat: bool = True):
    values = texts(seed) if values is None else values
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t) if t is not None else None, *["z"] * 9)
            for i, t in enumerate(values)]
    if repeat and rows:
        rows += [rows[-1], rows[len(rows) // 2], (None, "null id text here and there", None, None, None, *[None] * 9)]
    return spark.createDataFrame([Row(*r) for r in rows], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
