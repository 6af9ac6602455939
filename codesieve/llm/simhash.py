"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, groups.

Fingerprints within ``max_bits`` differing bits are split into ``max_bits + 3`` blocks.
Two close fingerprints differ in at most ``max_bits`` blocks, so they agree on at least
three whole blocks; every choice of three blocks is a join key.  Only distinct fingerprints
are joined, so copies cost one row, and a key shared by very many fingerprints is cut
into pairs of sub-blocks that go to different tasks.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh64_intdigest

from codesieve.llm.common import fresh_names, small_batches, stored
from codesieve.llm.components import components, forest

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
_ROWS = 1 << 15
_SMALL = 64


def fingerprint_of(text: bytes, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Fingerprint of one whole text; 0 when it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))[1:]
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans = zip(starts, ends[shingle - 1:]) if len(words) > shingle else [(0, len(line))]
    h = np.fromiter((xxh64_intdigest(line[s:e], seed) for s, e in spans), np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), _ROWS):
        part = h[lo:lo + _ROWS]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(docs: DataFrame, col: str = "fingerprint", text: str = "text",
                     shingle: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """docs plus ``col``: the fingerprint's 64 bits as a long.  Null text counts as empty (fingerprint 0)."""
    if col in docs.columns:
        raise ValueError(f"documents already have a column {col}")
    at = docs.columns.index(text)

    def run(batches):
        for b in small_batches(batches, at):
            prints = [_signed(fingerprint_of((t or "").encode(), shingle, seed)) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints, pa.int64())], [*b.schema.names, col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(col, "long"))


def block_masks(max_bits: int = MAX_BITS) -> list[int]:
    """One mask for every choice of three of ``max_bits + 3`` nearly equal blocks of the 64 bits."""
    n = max_bits + 3
    cuts = [round(i * 64 / n) for i in range(n + 1)]
    blocks = [((1 << cuts[i + 1]) - (1 << cuts[i])) for i in range(n)]
    return [a | b | c for a, b, c in combinations(blocks, 3)]


def _close(x: np.ndarray, cross: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges of one group of fingerprints; with ``cross`` only pairs across x[:cross] and x[cross:]."""
    a, b = [], []
    left, right = (x[:cross], x[cross:]) if cross else (x, x)
    for lo in range(0, len(left), 256):
        i, j = np.nonzero(np.bitwise_count(left[lo:lo + 256, None] ^ right[None, :]) <= max_bits)
        p, q = left[lo + i], right[j]
        keep = p != q
        p, q = forest(p[keep], q[keep])
        a.append(p)
        b.append(q)
    return forest(np.concatenate(a), np.concatenate(b))


def _verify(max_bits: int):
    """Sorted rows (t, mv, i, j, own, fp) -> edges (a, b) of pairs at ``max_bits`` or fewer."""

    def edges(key: np.ndarray, own: np.ndarray, fp: np.ndarray):
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        size = np.diff(np.append(start, len(fp)))
        group = np.repeat(np.arange(len(start)), size)
        a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        whole = key[start, 2] == key[start, 3]
        few = np.repeat(whole & (size <= _SMALL), size)
        for d in range(1, int(size[whole & (size <= _SMALL)].max(initial=1))):
            near = np.flatnonzero((group[d:] == group[:-d]) & few[d:]
                                  & (np.bitwise_count(fp[d:] ^ fp[:-d]) <= max_bits))
            a.append(fp[near])
            b.append(fp[near + d])
        for g in np.flatnonzero(~(whole & (size <= _SMALL))):
            x = fp[start[g]:start[g] + size[g]]
            cross = 0 if whole[g] else int((own[start[g]:start[g] + size[g]] == key[start[g], 2]).sum())
            if whole[g] or 0 < cross < len(x):
                p, q = _close(x, cross, max_bits)
                a.append(p)
                b.append(q)
        return forest(np.concatenate(a), np.concatenate(b))

    def run(batches):
        left: list = []
        for batch in batches:
            left.append(batch)
            t = pa.Table.from_batches(left)
            cols = [t.column(c).to_numpy() for c in range(6)]
            key = np.stack(cols[:4], axis=1)
            differs = np.flatnonzero((key != key[-1]).any(axis=1))
            cut = int(differs[-1]) + 1 if len(differs) else 0  # the last group may go on in the next batch
            if cut:
                a, b = edges(key[:cut], cols[4][:cut], cols[5][:cut].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
            left = t.slice(cut).to_batches()
        if left:
            t = pa.Table.from_batches(left)
            cols = [t.column(c).to_numpy() for c in range(6)]
            a, b = edges(np.stack(cols[:4], axis=1), cols[4], cols[5].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return run


def fingerprint_links(prints: DataFrame, max_bits: int = MAX_BITS, block_rows: int = 1024) -> DataFrame:
    """prints (fp long, distinct) -> edges (a, b) that join all fingerprints within ``max_bits`` bits.

    Every close pair is compared; of those in one group a spanning forest is returned, not all pairs.
    """
    masks = [_signed(m) for m in block_masks(max_bits)]
    keys = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("mv")) for t, m in enumerate(masks)
    ])).alias("k")).select("k.t", "k.mv", "fp")
    sizes = keys.groupBy("t", "mv").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / F.lit(block_rows)).cast("long")
    own: Column = F.pmod(F.xxhash64("fp"), F.col("parts"))
    rows = (keys.join(sizes, ["t", "mv"]).withColumn("parts", parts).withColumn("own", own)
            .select("t", "mv", "fp", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("o"))
            .select(F.col("t").cast("long").alias("t"), "mv", F.least("own", "o").alias("i"),
                    F.greatest("own", "o").alias("j"), "own", "fp"))
    # rows of block i come before those of block j within a pair of blocks
    return (rows.repartition("t", "mv", "i", "j").sortWithinPartitions("t", "mv", "i", "j", "own", "fp")
            .mapInArrow(_verify(max_bits), "a long, b long"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS,
                   max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits) and component_id, the smallest id whose
    fingerprint is reachable over links of at most ``max_bits`` bits.

    Null and empty texts have fingerprint zero and link like any other.  Rows with a null id take part;
    a group of null ids alone has a null component.  Repeated rows come back as often as they came.
    Other columns are not read.  An empty table gives no rows.
    """
    marked = stored(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "fp", "text",
                                     shingle).select("id", "fp"), "fingerprints")
    prints = marked.groupBy("fp").agg(F.min("id").alias("low"))
    found = fingerprint_groups(prints, max_bits)
    out = marked.join(found, "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                      F.col("component_id"))


def fingerprint_groups(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """prints (fp, low) -> (fp, component, component_id): the group's smallest fingerprint and smallest ``low``."""
    links = fingerprint_links(prints.select("fp"), max_bits)
    member = components(links)
    full = prints.join(member, prints.fp == member.node, "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("component"))
    lows = full.groupBy("component").agg(F.min("low").alias("component_id"))
    return full.join(lows, "component").select("fp", "component", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS,
             max_bits: int = MAX_BITS) -> DataFrame:
    """The documents with one row per group: the smallest id (nulls last), then the smallest fingerprint.

    Keeps all columns.  Of repeated rows of that id and fingerprint one is kept.
    """
    fp, head_id, head_fp = fresh_names(docs.columns, "fp", "head_id", "head_fp")
    marked = with_fingerprint(docs, fp, text, shingle)
    narrow = stored(marked.select(F.col(id_col).alias("id"), F.col(fp).alias("fp")), "fingerprints")
    prints = narrow.groupBy("fp").agg(F.min("id").alias("low"))
    group = fingerprint_groups(prints, max_bits)
    best = F.struct(F.col("low").isNull().alias("z"), F.col("low"), F.col("fp"))
    heads = (prints.join(group, "fp").groupBy("component").agg(F.min(best).alias("s"))
             .select(F.col("s.low").alias(head_id), F.col("s.fp").alias(head_fp)))
    kept = marked.join(heads, (F.col(fp) == F.col(head_fp)) & F.col(id_col).eqNullSafe(F.col(head_id)))
    return kept.drop(head_id, head_fp).dropDuplicates([id_col, fp]).drop(fp)
