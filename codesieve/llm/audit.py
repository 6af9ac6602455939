"""Audit of filters that run one after the other: what each removes, alone, first or last.

Every document passes or fails each of the five filters whatever the others do, so all orders are
answered by one contingency tensor per part: counts by pass / fail along five axes.  Spark counts
the 32 cells of each part; a step of an order is then a contraction of the tensor with one vector
per axis: (1, 0) selects pass, (0, 1) fail and (1, 1) all.  No text is read twice and no order is
run.

Filters: A under ``min_words`` words; B distinct words under ``min_distinct`` per cent; C upper-case
letters over ``max_upper`` per cent of the characters; D any of ``symbols``; E the text of a smaller id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

FILTERS = "ABCDE"
MEASURES = ("n", "good", "toxic")
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)

_UPPER = bytes(range(0x41, 0x5B))
_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACES = b"\x20\t\n\x0b\x0c\r"
_WINDOW = 1 << 20

RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


@dataclass(frozen=True)
class Limits:
    min_words: int = 200
    min_distinct: int = 50
    max_upper: int = 3
    symbols: bytes = b"#$%&*|"


def _windows(raw: bytes) -> Iterator[bytes]:
    """The text in windows that end at white space, so no word is cut (a longer word makes a longer window)."""
    lo, n = 0, len(raw)
    while n - lo > _WINDOW:
        hi = lo + _WINDOW
        while hi < n and raw[hi] not in _SPACES:
            hi += 1
        yield raw[lo:hi]
        lo = hi
    yield raw[lo:]


def failed_filters(raw: bytes, limits: Limits = Limits()) -> int:
    """Bits 0 to 3: the text fails A, B, C, D.  Words are maximal runs outside space and \\x09-\\x0D (what
    ``bytes.split`` gives)."""
    words, distinct = 0, set()
    for window in _windows(raw):
        found = window.split()
        words += len(found)
        distinct.update(found)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    chars = len(raw.translate(None, _CONTINUATION))
    symbol = len(raw.translate(None, limits.symbols)) < len(raw)
    return ((words < limits.min_words) | (100 * len(distinct) < limits.min_distinct * words) << 1
            | (100 * upper > limits.max_upper * chars) << 2 | symbol << 3)


def filter_failures(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang",
                    limits: Limits = Limits()) -> DataFrame:
    """One narrow row per document: id, part ('' for null), failed (bits of A to D), digest (128 bits of SHA-256 of
    the text).  Null text counts as empty.  No shuffle; one text at a time is held beside its batch."""
    narrow = docs.select(docs[id_col].alias("id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"),
                         docs[text].cast("string").alias("text"))

    def run(batches):
        for b in batches:
            failed, digest = [], []
            column = b.column(2)
            wide = pa.types.is_large_string(column.type)
            for value in column.cast(pa.large_binary() if wide else pa.binary()):
                raw = value.as_py() or b""
                failed.append(failed_filters(raw, limits))
                digest.append(hashlib.sha256(raw).digest()[:16])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(failed, pa.int32()), pa.array(digest, pa.binary())],
                                             ["id", "part", "failed", "digest"])

    schema = StructType([narrow.schema[0], narrow.schema[1]]).add("failed", IntegerType()).add("digest", "binary")
    return narrow.mapInArrow(run, schema)


def filter_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang",
                 limits: Limits = Limits()) -> DataFrame:
    """The contingency cells: part, failed (bits 0 to 4 for A to E), n, good, toxic; at most 32 rows a part.

    A document fails E if a smaller id has its text.  Equal texts fail A to D alike, so a group of copies is
    counted as (part, labels, count, smallest id) before anything is dealt by text: a group that holds a third of
    all rows sends one row per task.  What is dealt by text after that holds a row per part and label.  Null ids
    have no smaller ones and are none: they pass E.  Rows that repeat an id and its text pass or fail E together.
    An id is good (toxic) if any of its label rows says 1; ids without labels are neither.
    """
    rows = (filter_failures(docs, id_col, text, part, limits).groupBy("id", "part", "failed", "digest")
            .agg(F.count(F.lit(1)).alias("n")))
    marks = (labels.where(labels[id_col].isNotNull()).groupBy(labels[id_col].alias("id"))
             .agg(F.coalesce(F.max(labels["quality"] == 1), F.lit(False)).alias("good"),
                  F.coalesce(F.max(labels["toxic"] == 1), F.lit(False)).alias("toxic"))
             .select("id", F.unhex(F.lit("")).alias("salt"), "good", "toxic"))
    # null ids match no label; their digests spread them over the tasks of the join
    salted = rows.withColumn("salt", F.when(F.col("id").isNull(), F.col("digest")).otherwise(F.unhex(F.lit(""))))
    marked = salted.join(marks, ["id", "salt"], "left").select(
        "id", "part", "failed", "digest", "n", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    known = F.col("id").isNotNull()
    copies = marked.groupBy("digest", "part", "failed", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_null"),
        F.min(F.when(known, F.struct("id", "n"))).alias("first"))
    smallest = F.min("first.id").over(Window.partitionBy("digest"))
    passing = (F.col("n_null") + F.when(F.col("first.id") == F.col("smallest"), F.col("first.n")).otherwise(F.lit(0)))
    split = copies.withColumn("smallest", smallest).withColumn("passing", passing).select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct(F.col("failed"), F.col("passing").alias("n")),
            F.struct(F.col("failed").bitwiseOR(F.lit(16)).alias("failed"), (F.col("n") - F.col("passing")).alias("n")))).alias("c"))
    # good and toxic are counts here: n where the mark is set
    total = [F.sum(F.when(F.col(c), F.col("c.n")).otherwise(F.lit(0))).alias(c) for c in ("good", "toxic")]
    return split.groupBy("part", F.col("c.failed").alias("failed")).agg(F.sum("c.n").alias("n"), *total)


def _selectors(filters: str = FILTERS) -> tuple[list[str], np.ndarray]:
    """The orders, and for each (order, step, question) one selector per filter axis.

    Questions: kept (all filters so far pass), removed (those before pass, this fails), failing (this fails),
    alone (this fails, all others pass).
    """
    orders = ["".join(p) for p in permutations(filters)]
    picks = np.empty((len(orders), len(filters), 4, len(filters), 2), np.int64)
    for o, order in enumerate(orders):
        for s, name in enumerate(order):
            before = set(order[:s])
            for axis, other in enumerate(filters):
                if other == name:
                    picks[o, s, :, axis] = (PASS, FAIL, FAIL, FAIL)
                else:
                    chosen = PASS if other in before else ALL
                    picks[o, s, :, axis] = (chosen, chosen, ALL, PASS)
    return orders, picks


def contract_cells(cells: np.ndarray, filters: str = FILTERS) -> dict[str, np.ndarray]:
    """Answers of one part from its cells (2 per filter axis, then the measures n, good, toxic)."""
    orders, picks = _selectors(filters)
    axes = [chr(97 + i) for i in range(len(filters))]
    spec = "".join(axes) + "m," + ",".join("x" + a for a in axes) + "->xm"
    flat = picks.reshape(-1, len(filters), 2)
    got = np.einsum(spec, cells, *[flat[:, i] for i in range(len(filters))], optimize=True).astype(np.int64)
    got = got.reshape(len(orders), len(filters), 4, cells.shape[-1])
    removed = got[:, :, 1]
    which = np.array([[filters.index(f) for f in order] for order in orders])
    by_filter = np.zeros(len(filters), np.int64)
    np.add.at(by_filter, which, removed[:, :, 0])
    return {"kept": got[:, :, 0, 0], "removed": removed[:, :, 0], "redundant": got[:, :, 2, 0] - removed[:, :, 0],
            "unique_fails": got[:, :, 3, 0], "good_lost": removed[:, :, 1], "toxic_lost": removed[:, :, 2],
            "shapley": by_filter[which]}


def _answers(pdf: pd.DataFrame) -> pd.DataFrame:
    """All orders and steps of one part, from its cells."""
    cells = np.zeros((2,) * len(FILTERS) + (len(MEASURES),), np.int64)
    for failed, *counts in pdf[["failed", *MEASURES]].itertuples(index=False):
        cells[tuple(failed >> i & 1 for i in range(len(FILTERS)))] += counts
    orders, _ = _selectors()
    steps = len(FILTERS)
    out = {"part": pdf["part"].iloc[0], "filter_order": np.repeat(orders, steps),
           "step": np.tile(np.arange(1, steps + 1, dtype=np.int32), len(orders))}
    return pd.DataFrame(out | {k: v.ravel() for k, v in contract_cells(cells).items()})


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang",
                  limits: Limits = Limits()) -> DataFrame:
    """One row per part, order of the five filters and step: what the step keeps, removes and costs.

    kept: documents left after it; removed: here; redundant: fail this filter but were gone; unique_fails: fail
    this filter only; good_lost and toxic_lost: removed here and labelled so; shapley: what this filter removes
    summed over all orders (120 times its Shapley value).  Zeros are included.

    ``labels`` holds the id, quality and toxic.  Null text is empty (it fails A), a null part is ''.  Repeated rows
    count each.  Extra columns are not read.  An empty table has no part and gives no row.  A very long text is
    read in windows; only its distinct words are held.
    """
    return filter_cells(docs, labels, id_col, text, part, limits).groupBy("part").applyInPandas(_answers, RESULT)
