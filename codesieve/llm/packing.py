"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens.

Items above a third of the capacity are matched in pairs, largest with the largest that fits,
so a sequence holds two of them at most; smaller items then go, largest first, to the smallest
gap that takes them.  All items of one length are alike, so the whole plan is made on the
histogram of lengths: at most ``capacity`` counts, however many documents there are.  Each
item finds its place by its rank among the items of its length.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from codesieve.llm.common import small_batches, stored

CAPACITY = 2048
END_ID = 0
_PLAIN = re.compile(r"\s\s|\A\s|\s\Z|[^\S \n]|<\|")


class _Words(dict):
    """word -> ids as little-endian 32-bit bytes; a bounded memo, words beyond the bound are encoded each time."""

    def __init__(self, encode, lead: str, bound: int = 300_000):
        super().__init__()
        self.encode, self.lead, self.bound = encode, lead, bound

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(self.lead + word)
        if len(self) < self.bound:
            self[word] = ids
        return ids


class Encoder:
    """The ids of a byte-level BPE vocabulary file, fast on texts of plain words.

    The vocabulary splits a text before a single space or around a single line feed between
    words, so such texts are encoded word by word through a memo of the words' ids.  All other
    texts are encoded whole by the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        piece = self._piece_encoder(ranks) if os.path.exists(ranks) else self._ids
        self.first, self.rest = _Words(piece, ""), _Words(piece, " ")
        self.line_feed = piece("\n")

    def _ids(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def _piece_encoder(ranks: str):
        """The same vocabulary as ranks: quicker for short pieces that hold no special token."""
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        return lambda piece: np.array(coder.encode_ordinary(piece), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """ids of the whole text as little-endian 32-bit bytes."""
        if not text:
            return b""
        if _PLAIN.search(text):
            return self._ids(text)
        first, rest, lines = self.first, self.rest.__getitem__, []
        for line in text.split("\n"):
            words = line.split(" ")
            lines.append(first[words[0]] + b"".join(map(rest, words[1:])))
        return self.line_feed.join(lines)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text",
                 capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and ``ids``, little-endian bytes).

    A document is its ids and then ``end_id``; null text counts as empty (the end id alone).
    Documents longer than ``capacity`` are cut so that all pieces but the first are full.
    """
    narrow = docs.select(docs[id_col].alias(id_col), docs[text].cast("string").alias("text"))
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(vocabulary)
        for b in small_batches(batches, 1):
            at, piece, start, length, crc, kept = [], [], [], [], [], []
            for row, t in enumerate(b.column(1).to_pylist()):
                ids = enc.encode(t or "") + tail
                n = len(ids) // 4
                lo, k = 0, 0
                while lo < n:
                    hi = lo + ((n - lo) % capacity or capacity)
                    part = ids[4 * lo:4 * hi]
                    at.append(row)
                    piece.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(part)
                    lo, k = hi, k + 1
            cols = [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(kept, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = (StructType([narrow.schema[0]]).add("piece", IntegerType()).add("start", "long").add("length", "long")
              .add("ids_crc32", "long"))
    return narrow.mapInArrow(run, schema.add("ids", "binary") if with_ids else schema)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Histogram of lengths -> (placements, number of sequences).

    A placement (length, rank, count, sequence, offset) puts the items of that length with ranks
    rank .. rank + count - 1 into sequences sequence .. sequence + count - 1, one in each, at offset.
    """
    left = {l: n for l, n in histogram.items() if n > 0}
    if any(not 0 < l <= capacity for l in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    done: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_gaps: list[int] = []
    used = dict.fromkeys(left, 0)
    bins = 0

    def place(length: int, count: int, first: int, offset: int) -> None:
        done.append((length, used[length], count, first, offset))
        used[length] += count
        left[length] -= count

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(open_gaps, gap)
            gaps[gap].append((first, count))

    large = sorted(l for l in left if 3 * l > capacity)
    alive = large[:]  # ascending lengths with items left
    for a in reversed(large):
        while left[a]:
            at = bisect_left(alive, min(a, capacity - a) + 1) - 1
            if at >= 0 and alive[at] == a and left[a] == 1:
                at -= 1
            if at < 0:
                n, b = left[a], 0
                place(a, n, bins, 0)
            else:
                b = alive[at]
                n = left[a] // 2 if b == a else min(left[a], left[b])
                place(a, n, bins, 0)
                place(b, n, bins, a)
                if not left[b] and b != a:
                    alive.pop(at)
            leave(capacity - a - b, bins, n)
            bins += n
        if alive and alive[-1] == a:
            alive.pop()
    for length in sorted((l for l in left if 3 * l <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(open_gaps, length)
            if at == len(open_gaps):
                fresh = -(-left[length] // (capacity // length))
                leave(capacity, bins, fresh)
                bins += fresh
                continue
            gap = open_gaps[at]
            first, count = gaps[gap].pop()
            n = min(count, left[length])
            leave(gap, first + n, count - n)
            if not gaps[gap]:
                del gaps[gap]
                open_gaps.remove(gap)
            place(length, n, first, capacity - gap)
            leave(gap - length, first, n)
    return done, bins


def pack_pieces(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """pieces (id, piece, start, length, ids_crc32; at most ``capacity`` long) plus sequence_id and offset.

    Repeated rows are items of their own.  No rows in, no rows out.
    """
    items = stored(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    done, _ = plan_bins(counts, capacity)
    # rank among the items of a length, in two steps so that a common length is not one task:
    # place in a bucket, plus the sizes of the buckets before it
    buckets = max(1, int(4 * total ** 0.5))
    order = [id_col, "piece", "start", "ids_crc32"]
    keyed = items.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (keyed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
             .select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    ranked = (keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)))
              .join(sizes, ["length", "_bucket"])
              .select(*items.columns, (F.col("_before") + F.col("_rank") - 1).alias("_rank")))
    # the plan has at most a few entries for each length of 1 .. capacity, whatever the number of documents
    plan = np.array(sorted(done), np.int64).reshape(-1, 5)
    key = plan[:, 0] << 44 | plan[:, 1]
    at_length = items.columns.index("length")

    def run(batches):
        for b in batches:
            length, rank = b.column(at_length).to_numpy(), b.column(b.num_columns - 1).to_numpy()
            at = np.searchsorted(key, length << 44 | rank, side="right") - 1
            seq = plan[at, 3] + rank - plan[at, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq), pa.array(plan[at, 4])],
                                             [*b.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(run, StructType([*items.schema.fields]).add("sequence_id", "long").add("offset", "long"))


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Whole documents -> one row per piece with its sequence and place.

    Null and empty texts are the end id alone; repeated rows and null ids are packed like any other;
    other columns are not read; an empty table gives no rows.
    """
    return pack_pieces(token_pieces(docs, vocabulary, id_col, text, capacity, end_id), id_col, capacity)


def sequences(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
              end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (little-endian 32-bit bytes).

    A group holds one sequence, at most ``capacity`` tokens.
    """
    pieces = token_pieces(docs, vocabulary, id_col, text, capacity, end_id, with_ids=True)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return (pack_pieces(pieces, id_col, capacity).groupBy("sequence_id")
            .agg(F.sum("length").alias("n_tokens"), parts.alias("p"))
            .select("sequence_id", "n_tokens", F.aggregate(
                "p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")))
