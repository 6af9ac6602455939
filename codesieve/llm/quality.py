"""Quality rules, line first: failing lines go, then documents that lost too much text go.

Each line is judged by itself: sentence end, navigation separators, symbol share, shouting,
stuttering and short boilerplate phrases.  A document is rejected when it fails the base
figures (too few words, too many repeated 8-word windows) or when the failing lines hold
more than ``max_lost`` of its non-blank bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from codesieve.llm.common import row_chunks, small_batches, utf8_buffer, word_hashes, word_spans

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
MAX_LOST = 0.5

_SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(_SYMBOLS)] = True
# fixed values: characters that may end a sentence, and phrases of page furniture
_ENDS = (".", "!", "?", ":", ";", ",", '"', "'", ")", "]", "…", "”", "’", "»", "。", "！", "？")
_ENDS = tuple(e.encode() for e in _ENDS)
_BOILERPLATE = re.compile(
    rb"all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies|enable javascript|"
    rb"skip to content|back to top|sign in|log in|click here|read more|share this|follow us|subscribe now|powered by")
_NAV = re.compile(rb"\s(?:\||>|\xc2\xbb|\xc2\xb7|\xe2\x80\xa2|/)\s")


def line_fails(line: bytes) -> str | None:
    """The rule that a non-blank line fails, or None."""
    body = line.strip()
    words = body.split()
    n = len(words)
    if len(_NAV.findall(body)) * 4 >= n and n >= 4:
        return "navigation"
    if (len(body) - len(body.translate(None, _SYMBOLS))) * 20 > len(body):
        return "symbols"
    if n >= 5 and body.isupper():
        return "shouting"
    if n >= 8 and sum(a == b for a, b in zip(words, words[1:])) * 3 > n:
        return "stutter"
    if n <= 15 and _BOILERPLATE.search(body.lower()):
        return "boilerplate"
    if not body.endswith(_ENDS):
        return "punctuation"
    return None


def clean_text(text: bytes) -> tuple[bytes, int, int, int]:
    """(text without failing lines, lost bytes, non-blank bytes, repeated lines) of one document."""
    kept, lost, total, repeats, seen = [], 0, 0, 0, set()
    for line in text.split(b"\n"):
        body = line.strip()
        if not body:
            kept.append(line)
            continue
        if line in seen:
            repeats += 1
        seen.add(line)
        total += len(body)
        if line_fails(line):
            lost += len(body)
        else:
            kept.append(line)
    return b"\n".join(kept), lost, total, repeats


def _repeat_words(hashes: np.ndarray, first: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Words per document that lie in a WINDOW-word window found twice or more in that document."""
    n = len(hashes)
    covered = np.zeros(n + 1, np.int64)
    if n >= WINDOW:
        h = hashes.copy()[:n - WINDOW + 1]
        for j in range(1, WINDOW):
            h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[j:n - WINDOW + 1 + j]
        start = np.flatnonzero(doc[:n - WINDOW + 1] == doc[WINDOW - 1:])
        key = h[start] ^ (doc[start].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        codes, _ = pd.factorize(key)
        twice = start[np.bincount(codes)[codes] >= 2] if len(codes) else start
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    return inside[first[1:]] - inside[first[:-1]]


def _figures(text: pa.Array) -> dict[str, np.ndarray]:
    raw_all, off_all = utf8_buffer(text)
    out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words")}
    for lo, hi in row_chunks(off_all):
        offsets = off_all[lo:hi + 1] - off_all[lo]
        raw = raw_all[off_all[lo]:off_all[hi]]
        starts, ends, first = word_spans(raw, offsets)
        hashes = word_hashes(raw, starts, ends)
        doc = np.repeat(np.arange(hi - lo), np.diff(first))
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        chars = np.concatenate([[0], np.cumsum(points[ends] - points[starts])])
        symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[raw])])[offsets]
        out["n_words"].append(np.diff(first))
        out["word_chars"].append(chars[first[1:]] - chars[first[:-1]])
        out["n_symbols"].append(np.diff(symbols))
        out["n_repeat_words"].append(_repeat_words(hashes, first, doc))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def _judge(column: pa.Array, max_lost: float, with_text: bool):
    f = _figures(column)
    lines = [clean_text((t or "").encode()) for t in column.to_pylist()]
    lost = np.fromiter((x[1] for x in lines), np.int64, len(lines))
    total = np.fromiter((x[2] for x in lines), np.int64, len(lines))
    f["n_dup_lines"] = np.fromiter((x[3] for x in lines), np.int64, len(lines))
    f["base_failed"] = (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])
    f["kept"] = ~f["base_failed"] & (lost <= max_lost * total)
    f["lost_bytes"] = lost
    return f, ([x[0].decode() for x in lines] if with_text else None)


_COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
            "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "lost_bytes": "long"}


def quality_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """One row per input row: id, the base figures, base_failed, kept, lost_bytes.

    Null text counts as empty: no words, hence base_failed.  Rows are judged alone, so repeated
    rows give repeated results; other columns are not read.  No shuffle.
    """
    narrow = docs.select(docs[id_col].alias(id_col), docs[text].cast("string").alias("text"))

    def run(batches):
        for b in small_batches(batches, 1):
            f, _ = _judge(b.column(1), max_lost, False)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(f[k]) for k in _COLUMNS)], [id_col, *_COLUMNS])

    schema = StructType([narrow.schema[0]])
    for name, kind in _COLUMNS.items():
        schema = schema.add(name, kind)
    return narrow.mapInArrow(run, schema)


def keep_good(docs: DataFrame, text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """The kept documents, all columns, their text without the failing lines."""
    at = docs.columns.index(text)

    def run(batches):
        for b in small_batches(batches, at):
            f, texts = _judge(b.column(at), max_lost, True)
            cleaned = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(
                [cleaned if i == at else c for i, c in enumerate(b.columns)], b.schema.names).filter(pa.array(f["kept"]))

    return docs.mapInArrow(run, docs.schema)
