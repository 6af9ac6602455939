"""Repeated passages: maximal repeat groups from an enhanced suffix array, all but the first occurrence removed.

A byte goes when a ``length``-byte string that covers it also starts earlier.  Texts are far too long to
sort every suffix at full length, so suffixes are taken at anchors: of every ``length``-byte window the
positions whose ``k``-byte hash is the least of the window.  Equal windows have equal anchors, so every
repeat is seen at an anchor, and an anchor's repeats lie within its context of ``length - k`` bytes to the
left and ``length`` to the right.

1. Anchors with their context hash are dealt by k-byte hash.  A context seen before is a repeat as a whole.
   Anchors that no other context shares drop out.  Each batch of documents first drops its own repeats, and
   a k-byte string with many contexts in one batch (a common passage's edge) is dealt by context instead.
2. For anchors shared by different contexts the context bytes are fetched, dealt by anchor and sorted: the
   suffix array of that anchor.  A stack scan over its common prefixes gives the interval tree; inside each
   interval the left contexts, sorted in the same way, split where their extensions differ.  Each pair of
   intervals is a maximal repeat group with all its occurrences, and all but the earliest go.
   Groups beyond ``group_rows`` are compared window by window instead, so that no task holds one whole.
3. The runs of each document are joined back to its text.

Earlier means smaller id (null last), then text hash for texts under one id, then start.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import mix64, row_chunks, stored, utf8_buffer

LENGTH = 100
K = 32
GROUP_ROWS = 2048
_MANY = 8
_PIECE = 1 << 18
_BATCH = 8 << 20
_LAST = (1 << 63) - 1
_BYTE = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_ODD = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n of an odd base modulo 2**64, and of its inverse."""
    size = max(1 << 21, 1 << n.bit_length())
    if size not in _POWERS:
        def table(b: int) -> np.ndarray:
            steps = np.full(size + 1, b, np.uint64)
            steps[0] = 1
            return np.cumprod(steps, dtype=np.uint64)
        _POWERS[size] = table(_BASE), table(pow(_BASE, -1, 1 << 64))
    return _POWERS[size]


def _slide(a: np.ndarray, w: int, f) -> np.ndarray:
    """f over all windows of w entries."""
    out, m = a, 1
    while 2 * m <= w:
        out, m = f(out[:-m], out[m:]), 2 * m
    n = len(a) - w + 1
    return f(out[:n], out[w - m:w - m + n]) if m < w else out


def _rank(h: np.ndarray) -> np.ndarray:
    """The upper half of unmixed hashes, never zero: what windows choose their anchors by."""
    return (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


class Prefix:
    """Hashes of any stretch of a byte array from its running sums."""

    def __init__(self, raw: np.ndarray):
        power, self.inverse = _powers(len(raw))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * power[:len(raw)], dtype=np.uint64)])

    def hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix64((self.sums[hi] - self.sums[lo]) * self.inverse[lo])

    def every(self, k: int) -> np.ndarray:
        """Hashes of all stretches of k bytes, in order of their starts; not mixed."""
        return (self.sums[k:] - self.sums[:-k]) * self.inverse[:len(self.sums) - k]


def anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = K,
            first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, k-byte hash, context hash, document) of the anchors of the windows inside starts .. ends.

    Only windows that start in first .. last - 1 count.
    """
    n = len(raw)
    if n < length:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    pre = Prefix(raw)
    h = _rank(pre.every(k))
    low = _slide(h, length - k + 1, np.minimum)
    ok = np.zeros(n + 1, np.int64)
    long = ends - starts >= length
    np.add.at(ok, starts[long], 1)
    np.add.at(ok, ends[long] - length + 1, -1)
    ok = np.cumsum(ok)[:len(low)] > 0
    ok[:first] = False
    if last is not None:
        ok[last:] = False
    low[~ok] = 0
    pad = np.zeros(length - k, h.dtype)
    at = np.flatnonzero(_slide(np.concatenate([pad, low, pad]), length - k + 1, np.maximum) == h)
    doc = np.searchsorted(starts, at, side="right") - 1
    lo, hi = np.maximum(starts[doc], at - (length - k)), np.minimum(ends[doc], at + length)
    ctx = mix64(pre.hash(lo, hi) + (at - lo).astype(np.uint64) * _ODD + (hi - at).astype(np.uint64))
    return at, pre.hash(at, at + k), ctx, doc


def _batch_anchors(raw_all: np.ndarray, off: np.ndarray, length: int, k: int):
    """(document, position, k-byte hash, context hash) of all rows of a batch."""
    out = []
    for lo, hi in row_chunks(off, _PIECE):
        raw, o = raw_all[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        if len(raw) <= 8 * _PIECE:
            full = np.flatnonzero(o[1:] > o[:-1])  # documents with bytes, so that starts are distinct
            at, h, c, d = anchors(raw, o[:-1][full], o[1:][full], length, k)
            out.append((lo + full[d], at - o[:-1][full][d], h, c))
            continue
        for j in range(0, len(raw), _PIECE):  # one very long text, in overlapping pieces
            left = max(0, j - length)
            part = raw[left:j + _PIECE + 2 * length]
            at, h, c, _ = anchors(part, np.array([0]), np.array([len(part)]), length, k, j - left, j - left + _PIECE)
            out.append((np.full(len(at), lo), at + left, h, c))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    doc, pos, h, c = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((pos, doc))  # neighbouring pieces of a long text share anchors
    doc, pos, h, c = doc[order], pos[order], h[order], c[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])
    return doc[new], pos[new], h[new], c[new]


def merge_runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs [start, end) joined where they touch, by document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    shift = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])]) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], (start + shift)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return doc[first], start[first], (reach - shift)[np.append(first[1:], len(doc)) - 1]


_STEP1 = "key long, ctx long, doc long, tie long, pos int, end int"
# ``end`` of a row of step 1: an anchor dealt by its k bytes; one dealt by its context (``ctx`` then holds
# the k-byte hash); a mark that a k-byte hash has several contexts; above zero a finished run
_ANCHOR, _APART, _MARK = 0, -1, -2


def _anchor_rows(length: int, k: int):
    left = length - k
    names = ["key", "ctx", "doc", "tie", "pos", "end"]

    def rows(b):
        raw, off = utf8_buffer(b.column(2))
        docs, ties = b.column(0).to_numpy(), b.column(1).to_numpy()
        d, pos, h, ctx = _batch_anchors(raw, off, length, k)
        if not len(d):  # no text is long enough to hold a repeat
            return None
        place = np.empty(len(docs), np.int64)  # documents in the order that says which is earlier
        place[np.lexsort((ties, docs))] = np.arange(len(docs))
        order = np.lexsort((place[d] << 32 | pos, ctx, h))
        d, pos, h, ctx = d[order], pos[order], h[order], ctx[order]
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new = new_h | np.concatenate([[True], ctx[1:] != ctx[:-1]])
        again = np.flatnonzero(~new)
        rep = np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))[again]
        again = again[(docs[d[again]] != docs[d[rep]]) | (ties[d[again]] != ties[d[rep]]) | (pos[again] != pos[rep])]
        rd, rs, re = merge_runs(d[again], np.maximum(pos[again] - left, 0), pos[again] + length)
        # contexts of each k-byte hash among these documents
        group = np.cumsum(new_h) - 1
        contexts = np.bincount(group[new])
        keep = np.flatnonzero(new)
        apart = contexts[group[keep]] > _MANY
        key = np.where(apart, mix64(h[keep] ^ (ctx[keep] * _ODD)), h[keep])
        second = np.where(apart, h[keep], ctx[keep])
        mark = np.flatnonzero(new_h & (contexts[group] > _MANY))
        who = np.concatenate([d[keep], d[mark], rd])
        return [np.concatenate([key, h[mark], mix64(docs[rd].astype(np.uint64))]).view(np.int64),
                np.concatenate([second, np.zeros(len(mark) + len(rd), np.uint64)]).view(np.int64), docs[who], ties[who],
                np.concatenate([pos[keep], pos[mark], rs]).astype(np.int32),
                np.concatenate([np.where(apart, _APART, _ANCHOR), np.full(len(mark), _MARK), re]).astype(np.int32)]

    def run(batches):
        for b in batches:
            _, off = utf8_buffer(b.column(2))
            for lo, hi in row_chunks(off, _BATCH):
                if off[hi] - off[lo] < length:
                    continue
                cols = rows(b.slice(lo, hi - lo))
                for at in range(0, len(cols[0]) if cols else 0, 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at:at + 50_000]) for c in cols], names)

    return run


_STEP2 = "doc long, tie long, start int, end int, anchor long"


def _groups(batches):
    """Batches sorted by their first columns -> tables cut only between values of the first column."""
    left: list = []
    for b in batches:
        left.append(b)
        key = b.column(0)
        if len(b) == 0 or key[0].as_py() == key[len(b) - 1].as_py():
            continue
        t = pa.Table.from_batches(left)
        k = t.column(0).to_numpy()
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1
        yield t.slice(0, cut)
        left = t.slice(cut).to_batches()
    if left:
        t = pa.Table.from_batches(left)
        if len(t):
            yield t


def _scan_anchors(length: int, k: int):
    """Sorted rows of step 1 -> runs (doc, tie, start, end, null) and requests (doc, tie, position, null, anchor)."""
    left = length - k

    def scan(key, ctx, doc, tie, pos, end):
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        kind = np.where(end > 0, 1, end)
        done = kind == 1
        new = new_key | np.concatenate([[True], (ctx[1:] != ctx[:-1]) | (kind[1:] != kind[:-1])])
        group = np.cumsum(new_key) - 1
        anchor = kind == _ANCHOR
        several = np.bincount(group[new & anchor], minlength=group[-1] + 1) > 1
        several |= np.bincount(group[kind == _MARK], minlength=group[-1] + 1) > 0
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        same = (doc == doc[first]) & (tie == tie[first]) & (pos == pos[first])
        again = ((anchor | (kind == _APART)) & ~new & ~same)
        ask = new & ((anchor & several[group]) | (kind == _APART))
        r = np.flatnonzero(again)
        q = np.flatnonzero(ask)
        f = np.flatnonzero(done)
        name = np.where(kind[q] == _APART, ctx[q], key[q])
        return [np.concatenate([doc[r], doc[f], doc[q]]), np.concatenate([tie[r], tie[f], tie[q]]),
                np.concatenate([np.maximum(pos[r] - left, 0), pos[f], pos[q]]).astype(np.int32),
                np.concatenate([pos[r] + length, end[f], np.zeros(len(q), np.int32)]).astype(np.int32),
                np.concatenate([np.zeros(len(r) + len(f), np.int64), name]), len(r) + len(f)]

    def run(batches):
        for t in _groups(batches):
            *cols, n_runs = scan(*(t.column(i).to_numpy() for i in range(6)))
            if len(cols[0]):
                is_run = np.arange(len(cols[0])) < n_runs
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3], mask=~is_run),
                     pa.array(cols[4], mask=is_run)], ["doc", "tie", "start", "end", "anchor"])

    return run


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def interval_tree(lcp: list[int], least: int):
    """Stack scan over common prefixes of sorted strings: (prefix, first, last) of every interval of two or
    more neighbours whose common prefix is ``prefix`` >= ``least`` and longer than that of any wider one."""
    stack: list[list[int]] = []
    for i, value in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > value:
            height, first = stack.pop()
            yield height, first, i
        if value >= least and (not stack or stack[-1][0] < value):
            stack.append([value, first])


def _prefixes(strings: list[bytes], width: int) -> list[int]:
    """Common prefixes of neighbours."""
    if len(strings) < 8:
        return [_common(a, b) for a, b in zip(strings, strings[1:])]
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    table = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)
    differ = table[1:] != table[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return np.minimum(first, np.minimum(size[1:], size[:-1])).tolist()


def repeat_groups(right: list[bytes], left: list[bytes], length: int = LENGTH, place: list | None = None,
                  lcp: list[int] | None = None):
    """Maximal repeat groups of one anchor: (bytes to the left, bytes to the right, members).

    right: the members' bytes from the anchor on, sorted; left: those before it, reversed.  An interval of
    the right contexts is right-maximal; its left contexts split into intervals where their extensions
    differ, so each of these is left-maximal too.  Groups shorter than ``length`` are left out.

    With ``place`` (an order of the members) only what tells a member of an earlier one is kept: a member
    whose whole left context an earlier one has too leaves the scan with its interval.  In every wider
    interval the earlier one stands for it, and it could gain nothing there.  ``lcp``: common prefixes of
    neighbours in ``right``, where they are known.
    """
    widest = max(map(len, left))
    if lcp is None:
        lcp = _prefixes(right, max(1, max(map(len, right))))
    least = max(1, length - widest)
    stack: list[tuple[int, list[int]]] = []
    for i, value in enumerate([*lcp, -1]):
        members = [i]
        while stack and stack[-1][0] > value:
            height, below = stack.pop()
            members = below + members
            order = sorted(members, key=left.__getitem__)
            sorted_left = [left[m] for m in order]
            back = _prefixes(sorted_left, widest or 1)
            if max(back) + height < length:
                continue
            # the empty left extension counts where the right side alone is long enough
            told = set()
            for b, f, l in interval_tree(back, max(0, length - height)):
                group = order[f:l + 1]
                yield b, height, group
                if place is not None and b == widest:
                    first = min(group, key=place.__getitem__)
                    told.update(m for m in group if m != first)
            if told:
                members = [m for m in members if m not in told]
        if value >= least:
            if stack and stack[-1][0] == value:
                stack[-1][1].extend(members)
            else:
                stack.append((value, members))


_STEP3 = "key long, right binary, left binary, doc long, tie long, pos int, end int"


def _windows_of(raw: bytes, asks: list[int], length: int, k: int):
    """(start, 16-byte name) of every window whose least k-byte hash is at one of the asked positions."""
    h = _rank(Prefix(np.frombuffer(raw, np.uint8)).every(k))
    low = _slide(h, length - k + 1, np.minimum)
    starts = set()
    for p in asks:
        lo = max(0, p - (length - k))
        starts.update((lo + np.flatnonzero(low[lo:p + 1] == h[p])).tolist())
    for s in starts:
        yield s, hashlib.blake2b(raw[s:s + length], digest_size=16).digest()


def _contexts(length: int, k: int, flush: int = 40_000):
    """Documents with their requests -> context rows by anchor; window rows of very large groups by window hash."""
    reach = length - k

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

        def emit(out, seen, runs):
            # a window seen before among these documents is a run already; only first ones are dealt
            out += [(int.from_bytes(n[:8], "little", signed=True), n[8:], None, *p, -1) for n, p in seen.items()]
            out += [(hash(p) & _LAST, None, None, *p, p[2] + length) for p in runs]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                              ["key", "right", "left", "doc", "tie", "pos", "end"])

        for b in batches:
            out: list[tuple] = []
            seen: dict[bytes, tuple] = {}
            runs: list[tuple] = []
            asks = b.column(3)
            bound = np.concatenate([[0], np.cumsum(asks.value_lengths().fill_null(0).to_numpy())]).tolist()
            start, anchor, large = (asks.flatten().field(i).to_pylist() for i in range(3))
            doc, tie = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i in np.flatnonzero(np.diff(bound)).tolist():
                raw = unpack.decompress(b.column(2)[i].as_py())
                mine = range(bound[i], bound[i + 1])
                out += [(anchor[j], raw[start[j]:start[j] + length], raw[max(0, start[j] - reach):start[j]][::-1],
                         doc[i], tie[i], start[j], 0) for j in mine if not large[j]]
                many = [start[j] for j in mine if large[j]]
                for s, name in _windows_of(raw, many, length, k) if many else ():
                    place = (doc[i], tie[i], s)
                    first = seen.get(name)
                    if first is not None:
                        runs.append(max(place, first))
                        place = min(place, first)
                    seen[name] = place
                if len(out) + len(seen) + len(runs) > flush:
                    yield emit(out, seen, runs)
                    out, seen, runs = [], {}, []
            if out or seen:
                yield emit(out, seen, runs)

    return run


def _scan_suffixes(length: int):
    """Sorted context rows -> runs (doc, tie, start, end) of all but the earliest occurrence of each repeat group."""

    def run(batches):
        for t in _groups(batches):
            key, end = t.column(0).to_numpy(), t.column(6).to_numpy()
            doc, tie, pos = (t.column(i).to_numpy() for i in (3, 4, 5))
            place = _places(doc, tie, pos)
            done = np.flatnonzero(end > 0)
            who, lo_, hi_ = [done], [pos[done].astype(np.int64)], [end[done].astype(np.int64)]
            # contexts, by anchor
            rows = np.flatnonzero(end == 0)
            right, left = t.column(1).take(pa.array(rows)).to_pylist(), t.column(2).take(pa.array(rows)).to_pylist()
            lcp = _prefixes(right, length) if len(rows) > 1 else []
            bound = np.append(np.flatnonzero(np.concatenate([[True], key[rows][1:] != key[rows][:-1]])), len(rows)).tolist()
            order = place[rows].tolist()
            member, back, ahead = [], [], []
            for lo, hi in zip(bound, bound[1:]) if len(rows) else ():
                if hi - lo < 2:
                    continue
                at = order[lo:hi]
                if hi - lo == 2:
                    if at[0] == at[1]:
                        continue
                    b = _common(left[lo], left[lo + 1])
                    if b + lcp[lo] >= length:
                        member.append(lo if at[0] > at[1] else lo + 1)
                        back.append(b)
                        ahead.append(lcp[lo])
                    continue
                for b, a, group in repeat_groups(right[lo:hi], left[lo:hi], length, at, lcp[lo:hi - 1]):
                    first = min(at[m] for m in group)
                    found = [lo + m for m in group if at[m] != first]
                    member += found
                    back += [b] * len(found)
                    ahead += [a] * len(found)
            m = rows[np.array(member, np.int64)]
            who.append(m)
            lo_.append(pos[m] - np.array(back, np.int64))
            hi_.append(pos[m] + np.array(ahead, np.int64))
            # single windows, by their bytes' name
            w = np.flatnonzero(end < 0)
            if len(w):
                number = _as_numbers(t.column(1).take(pa.array(w)))
                s = np.lexsort((place[w], number, key[w]))
                w, number = w[s], number[s]
                new = np.concatenate([[True], (key[w][1:] != key[w][:-1]) | (number[1:] != number[:-1])])
                first = np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
                again = w[place[w] != place[w][first]]
                who.append(again)
                lo_.append(pos[again].astype(np.int64))
                hi_.append(pos[again] + length)
            who, lo_, hi_ = np.concatenate(who), np.concatenate(lo_), np.concatenate(hi_)
            if len(who):
                # runs of one document within these rows are joined before they are dealt
                names, at = np.unique(np.stack([doc[who], tie[who]]), axis=1, return_inverse=True)
                d, s, e = merge_runs(at.ravel(), lo_, hi_)
                yield pa.RecordBatch.from_arrays([pa.array(names[0][d]), pa.array(names[1][d]),
                                                  pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))],
                                                 ["doc", "tie", "start", "end"])

    return run


def _places(doc: np.ndarray, tie: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Ranks of the places; equal places (of repeated rows) have one rank."""
    order = np.lexsort((pos, tie, doc))
    d, t, p = doc[order], tie[order], pos[order]
    out = np.empty(len(doc), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1])])) if len(doc) else 0
    return out


def _as_numbers(column) -> np.ndarray:
    """8-byte values as numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int64)


def _pack_texts(batches):
    pack = zstandard.ZstdCompressor(level=3)
    for b in batches:
        z = pa.array([pack.compress(t.encode()) for t in b.column(2).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), z], ["doc", "tie", "z"])


def keep_outside(raw: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """(bytes outside the runs, the runs clipped to the text and joined where they touch)."""
    joined: list[list[int]] = []
    for s, e in sorted((s, min(e, len(raw))) for s, e in runs):
        if joined and s <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], e)
        else:
            joined.append([s, e])
    kept, at = [], 0
    for s, e in joined:
        kept.append(raw[at:s])
        at = e
    kept.append(raw[at:])
    return b"".join(kept), [(s, e) for s, e in joined]


def repeat_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = K,
                group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per distinct (id, text): doc (id, null as the largest long), tie, z (zstandard text), copies,
    runs array<struct<start, end>> (not joined, may pass the end of the text)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    tie: Column = F.xxhash64("body")  # tells the texts of one id apart, null ids above all
    base = (docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), body.alias("body"))
            .select("doc", tie.alias("tie"), "body"))
    rows = base.mapInArrow(_anchor_rows(length, k), _STEP1)
    order = ["key", "ctx", "doc", "tie", "pos", "end"]
    scanned = stored(rows.repartition("key").sortWithinPartitions(*order).mapInArrow(_scan_anchors(length, k), _STEP2),
                     "repeats")
    asks = scanned.filter("anchor is not null").select("doc", "tie", "start", "anchor")
    large = (asks.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group_rows)
             .select(F.col("anchor").alias("_a"), F.lit(True).alias("large")))
    asked = (asks.join(large, F.col("anchor") == F.col("_a"), "left")
             .groupBy(F.col("doc").alias("_d"), F.col("tie").alias("_t"))
             .agg(F.collect_list(F.struct("start", "anchor", F.coalesce("large", F.lit(False)).alias("large"))).alias("asks")))
    # rows with equal id and text are one, with their count; both joins below read one shuffle of the texts
    texts = (base.mapInArrow(_pack_texts, "doc long, tie long, z binary").groupBy("doc", "tie")
             .agg(F.first("z").alias("z"), F.count(F.lit(1)).alias("copies")))
    contexts = (texts.join(asked, (F.col("doc") == F.col("_d")) & (F.col("tie") == F.col("_t")), "left")
                .select("doc", "tie", "z", "asks").mapInArrow(_contexts(length, k), _STEP3))
    found = (contexts.repartition("key").sortWithinPartitions("key", "right", "doc", "tie", "pos")
             .mapInArrow(_scan_suffixes(length), "doc long, tie long, start int, end int"))
    runs = (scanned.filter("anchor is null").select("doc", "tie", "start", "end").union(found)
            .groupBy(F.col("doc").alias("_d"), F.col("tie").alias("_t"))
            .agg(F.collect_list(F.struct("start", "end")).alias("runs")))
    return (texts.join(runs, (F.col("doc") == F.col("_d")) & (F.col("tie") == F.col("_t")), "left")
            .select("doc", "tie", "z", "copies", "runs"))


def _per_document(batches, length: int):
    """(row of the batch, text, kept bytes, runs) of every document; copies after the first lose all they can."""
    unpack = zstandard.ZstdDecompressor()
    for doc, z, copies, runs in batches:
        raw = unpack.decompress(z)
        kept, joined = keep_outside(raw, [(r["start"], r["end"]) for r in runs or ()])
        yield doc, raw, kept, joined
        for _ in range(copies - 1):
            yield (doc, raw, b"", [(0, len(raw))]) if len(raw) >= length else (doc, raw, raw, [])


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = K,
                  group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.

    Null text counts as empty.  Rows that repeat id and text are copies of the first of them.  Null ids
    come last in order.  Other columns are not read.  An empty table gives no rows.
    """
    def run(batches):
        for b in batches:
            rows = [(None if d == _LAST else d, len(raw), len(raw) - len(kept), len(joined), hashlib.sha256(kept).hexdigest())
                    for d, raw, kept, joined in _per_document(zip(*(b.column(i).to_pylist() for i in range(4))), length)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                                 [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return (repeat_runs(docs, id_col, text, length, k, group_rows).select("doc", "z", "copies", "runs")
            .mapInArrow(run, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = K,
                   group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per input row: id, text without its repeats (bytes that no longer form UTF-8 at a cut are
    dropped), spans array<struct<start, end>> of removed bytes."""
    def run(batches):
        for b in batches:
            rows = [(None if d == _LAST else d, kept.decode("utf-8", "ignore"), [{"start": s, "end": e} for s, e in joined])
                    for d, _, kept, joined in _per_document(zip(*(b.column(i).to_pylist() for i in range(4))), length)]
            if rows:
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.string(), span])],
                                                 [id_col, text, "spans"])

    return (repeat_runs(docs, id_col, text, length, k, group_rows).select("doc", "z", "copies", "runs")
            .mapInArrow(run, f"{id_col} long, {text} string, spans array<struct<start:long,end:long>>"))
