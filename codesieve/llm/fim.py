"""Fill-in-the-middle order of documents, by rotations in place that are turned back exactly.

A text is cut in three; its parts get sentinels and change places so that a model learns to write
the middle from both sides.  The text is copied into one bytearray, the sentinels are inserted, and
two neighbouring segments are exchanged by three reversals.  The same rotation with the lengths
exchanged puts the text back.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codesieve.llm.common import row_chunks, utf8_buffer

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
BATCH_BYTES = 16 << 20
_BLOCK = 1 << 20

# what a byte begins: nothing (it continues a character), a letter, another character
_KIND = np.full(256, 2, np.uint8)
_KIND[0x80:0xC0] = 0
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
_CONTINUATION = bytes(range(0x80, 0xC0))


def _unit_starts(raw: bytes, lo: int) -> np.ndarray:
    """Which bytes of the block at ``lo`` begin a unit: a run of letters A-Z a-z, or one other character."""
    kind = _KIND[np.frombuffer(raw, np.uint8, min(_BLOCK, len(raw) - lo), lo)]
    before = np.empty_like(kind)
    before[0] = _KIND[raw[lo - 1]] if lo else 0
    before[1:] = kind[:-1]
    return (kind == 2) | ((kind == 1) & (before != 1))


def count_units(raw: bytes) -> list[int]:
    """Units that begin in each block of the text."""
    return [int(np.count_nonzero(_unit_starts(raw, lo))) for lo in range(0, len(raw), _BLOCK)]


def cut_place(raw: bytes, counts: list[int], units: int) -> int:
    """The byte where the first ``units`` units end."""
    for i, n in enumerate(counts):
        if units < n:
            return i * _BLOCK + int(np.flatnonzero(_unit_starts(raw, i * _BLOCK))[units])
        units -= n
    return len(raw)


def _reverse(view: np.ndarray) -> None:
    """Reverse in place, block by block from both ends."""
    lo, hi = 0, len(view)
    while hi - lo > 1:
        k = min((hi - lo) // 2, _BLOCK)
        head = view[lo:lo + k].copy()
        view[lo:lo + k] = view[hi - k:hi][::-1]
        view[hi - k:hi] = head[::-1]
        lo, hi = lo + k, hi - k


def rotate(buffer: bytearray, lo: int, mid: int, hi: int) -> None:
    """Exchange buffer[lo:mid] and buffer[mid:hi] in place: reverse each, then both together."""
    view = np.frombuffer(buffer, np.uint8)
    for a, b in ((lo, mid), (mid, hi), (lo, hi)):
        _reverse(view[a:b])


def rearrange(raw: bytes, prefix: int, middle: int, form: str) -> bytearray:
    """The text with its prefix ending at byte ``prefix`` and its middle at byte ``middle`` in the given form."""
    buffer = bytearray(raw)
    if form == PLAIN:
        return buffer
    for at, sentinel in ((middle, SUFFIX), (prefix, MIDDLE), (0, PREFIX)):
        buffer[at:at] = sentinel
    # <P>prefix<M>middle | <S>suffix: the suffix goes before the middle, or before all
    lo = 0 if form == SPM else prefix + len(PREFIX)
    rotate(buffer, lo, middle + len(PREFIX) + len(MIDDLE), len(buffer))
    return buffer


def put_back(output: bytes, form: str) -> bytearray:
    """The text that ``rearrange`` was given, from its output and form alone.

    No text that was rearranged holds a sentinel, and none can arise where a text meets one (a sentinel has '<' at
    its start only), so the first place of each is its place.
    """
    buffer = bytearray(output)
    if form == PLAIN:
        return buffer
    lo, mid = buffer.find(SUFFIX), buffer.find(PREFIX if form == SPM else MIDDLE)
    rotate(buffer, lo, mid, len(buffer))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.find(sentinel)
        del buffer[at:at + len(sentinel)]
    return buffer


def _draw(seed: int, doc_id) -> list[int] | None:
    """Four 32-bit draws of a document; none without an id."""
    if doc_id is None:
        return None
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * i:4 * i + 4], "big") for i in range(4)]


def _string(values: list) -> pa.Array:
    """Byte strings as a string column, not decoded."""
    return pa.array(values, pa.binary()).view(pa.string())


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 1, rate: int = 90,
                   spm_rate: int = 20) -> DataFrame:
    """One row per document: id, n (units), form, prefix_chars, middle_chars, output.

    Units are runs of letters A-Z a-z and single other characters; two draws from SHA-256 of ``seed:id`` give
    the cuts, two more whether (``rate`` per cent) and how (``spm_rate`` per cent suffix first) parts are moved.
    Plain, with null lengths and the text itself, are: an empty or null text, one that holds a sentinel, one not
    drawn, and a null id.  Rows are taken alone: repeated rows give repeated results, other columns are not read,
    an empty table gives none.  A long text is scanned block by block; it is held once more as the buffer in which
    its parts move.
    """
    narrow = docs.select(docs[id_col].alias(id_col), docs[text].cast("string").alias("text"))

    def one(doc_id, raw: bytes):
        counts = count_units(raw)
        n, draw = sum(counts), _draw(seed, doc_id)
        if not raw or draw is None or draw[2] % 100 >= rate or any(s in raw for s in (PREFIX, SUFFIX, MIDDLE)):
            return n, PLAIN, None, None, raw
        form = SPM if draw[3] % 100 < spm_rate else PSM
        prefix, middle = sorted(cut_place(raw, counts, h % (n + 1)) for h in draw[:2])
        chars = [len(s.translate(None, _CONTINUATION)) for s in (raw[:prefix], raw[prefix:middle])]
        return n, form, *chars, bytes(rearrange(raw, prefix, middle, form))

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for b in batches:
            data, offsets = utf8_buffer(b.column(1))
            for lo, hi in row_chunks(offsets, BATCH_BYTES):
                ids = b.column(0).slice(lo, hi - lo)
                rows = [one(i.as_py(), data[offsets[k]:offsets[k + 1]].tobytes()) for k, i in enumerate(ids, lo)]
                cols = [pa.array(c, t) for c, t in zip(list(zip(*rows))[:4], kinds)]
                yield pa.RecordBatch.from_arrays([ids, *cols, _string([r[4] for r in rows])],
                                                 [id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = StructType([narrow.schema[0]])
    for name, kind in (("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string")):
        schema = schema.add(name, kind)
    return narrow.mapInArrow(run, schema)


def restore(rows: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """The rows with a column ``restored``: the text before ``fill_in_middle``, from output and form.

    A null output gives a null text; a null form counts as plain.
    """
    if "restored" in rows.columns:
        raise ValueError("the rows have a column 'restored' already")
    names = rows.columns
    at, how = names.index(output), names.index(form)

    def run(batches):
        for b in batches:
            data, offsets = utf8_buffer(b.column(at))
            for lo, hi in row_chunks(offsets, BATCH_BYTES):
                part = b.slice(lo, hi - lo)
                made = [None if not valid.as_py() else
                        bytes(put_back(data[offsets[k]:offsets[k + 1]].tobytes(), f.as_py() or PLAIN))
                        for k, (valid, f) in enumerate(zip(part.column(at).is_valid(), part.column(how)), lo)]
                yield pa.RecordBatch.from_arrays([*part.columns, _string(made)], [*names, "restored"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("restored", "string"))


def fim_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 1, rate: int = 90,
               spm_rate: int = 20) -> DataFrame:
    """``fill_in_middle`` with the SHA-256 of its output and of the text restored from it in place of the texts."""
    made = restore(fill_in_middle(docs, id_col, text, seed, rate, spm_rate))
    return made.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))
