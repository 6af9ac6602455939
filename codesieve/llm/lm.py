"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays that workers map.

Counting.  A task counts the n-grams of its documents and deals them by the hash of their last word but one.  All
n-grams that share it lie in one shard, and with them all their suffixes of two words or more and all their contexts,
so one task finds the figures of every order above the first without another shuffle:
    at the highest order, and for what begins a document, how often a gram occurs;
    below it the number of distinct words before it;
    of each context the total of these counts and how many grams have 1, 2 and more of them.
The words before a single word are counted alike, first of all and in one round, from pairs that are dealt by their
last word.  Shards of grams are dealt in ROUNDS, each of which reads the texts anew, and the shuffle files of a round go
when it ends, so the disk holds a part of all grams at a time.
A word that fills more than a quarter of a shard is split by the word that follows.  Suffixes stay together then,
contexts don't, and only the contexts of such words are summed by another shuffle.

The model folder lies in the cluster's shared folder and must be mounted, as memory mapping needs files:
    grams-<shard>     per order the sorted 64-bit names and their counts, then the contexts with a total above 1
    words-<range>     sorted word hashes and their figures
    contexts-<range>  the same of the contexts of split words
    shards.npz        the files written and the split words, written last
A context without an entry has a total of 1 if it is itself a known gram, else it has not been seen.  Files are
written under another name and renamed, so a task that runs again does no harm.

Scoring.  From the first order up, p(w | h) = max(c(h,w) - D, 0) / c(h) + l(h) * p(w | shorter h), where the lowest is
p(w) = max(before(w) - D', 0) / pairs + l' / (V + 1); its last term leaves room for one unknown word.  The
probabilities of all known words and the unknown one add up to 1 after every context.  A document begins with one
mark, so its first word has a context of that mark only.
"""

from __future__ import annotations

import contextlib
import functools
import math
import os
from collections import OrderedDict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codesieve.llm.common import LOWER, mix64, row_chunks, stored, utf8_buffer, word_hashes, word_spans
from codesieve.session import shared_path

FOLDS = 10
# hashes of the two marks that are no words
BEGIN = np.uint64(0x5851F42D4C957F2D)
END = np.uint64(0x14057B7EF767814F)
_ODD = np.uint64(0xD1342543DE82EF95)
_CHUNK = 2 << 20
_FLUSH = 1_000_000
_SHARD_BYTES = 8_000_000  # of text for each shard of grams
ORDER = 3
DEALT = 3  # shards are dealt in rounds by their number's remainder,
ROUNDS = ((0, 1), (2,))  # fewer as the model grows beside the shuffle files
_SCORED = 4 << 20  # bytes of text that are scored together
SPLIT_WORDS = 100_000  # a word is split only if it is more than this part of all tokens, so there are fewer of them
COMMON_WORDS = 50_000  # words above this part of all tokens, so fewer than that, have a fixed number while grams are dealt
_SLOT_BITS = 18
STATS = ("seen", "before", "total", "once", "twice", "more")


def gram_names(words: list[np.ndarray]) -> np.ndarray:
    """64-bit names of the grams whose words are given in order, one array for each place."""
    name = mix64(words[-1])
    for w in reversed(words[:-1]):
        name = mix64(w * _ODD + name)
    return name


def token_stream(raw: np.ndarray, off: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(words of each token's gram, oldest first; its length without repeated begin marks; tokens before each row).

    The tokens of a row are its lower-cased words, then one end mark.
    """
    raw = LOWER[raw]
    starts, ends, first = word_spans(raw, off)
    tokens = np.insert(word_hashes(raw, starts, ends), first[1:], END)
    first = first + np.arange(len(first))
    place = np.arange(len(tokens)) - np.repeat(first[:-1], np.diff(first))
    words = [tokens]
    for back in range(1, order):
        before = np.full(len(tokens), BEGIN)
        inside = np.flatnonzero(place >= back)
        before[inside] = tokens[inside - back]
        words.insert(0, before)
    return words, np.minimum(place + 2, order), first


def _small(x: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds x."""
    top = int(x.max(initial=0))
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def _unsmall(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, f"<u{len(b) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _add_up(name: np.ndarray, count: np.ndarray, *more: np.ndarray):
    """Sorted distinct names, the sums of their counts, and the other columns, which the name decides."""
    order = np.argsort(name)
    name, count = name[order], count[order]
    new = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, np.int64)
    return name[new], np.add.reduceat(count, new) if len(name) else count, *(c[order[new]] for c in more)


@dataclass(frozen=True)
class Dealing:
    """Which shard holds a gram: by its last word but one, and by its last one too where that word is split."""

    shards: int
    words: np.ndarray  # sorted hashes of the split words, fewer than SPLIT_WORDS
    parts: np.ndarray

    def split(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the split words, their entries)."""
        if not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        where = np.flatnonzero(self.words[at] == word)
        return where, at[where]

    def home(self, word: np.ndarray) -> np.ndarray:
        return ((word >> np.uint64(24)) % np.uint64(self.shards)).astype(np.int64)

    def shard(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = self.home(before)
        where, at = self.split(before)
        part = (mix64(last[where]) >> np.uint64(8)) % self.parts[at].astype(np.uint64)
        out[where] = (out[where] + part.astype(np.int64)) % self.shards
        return out


def _count_words(batches):
    """Texts -> (word, count) of each stretch of tokens."""
    names = ["word", "n"]

    def rows(parts):
        word, n = _add_up(*(np.concatenate(x) for x in zip(*parts)))
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names)

    parts, held = [], 0
    for b in batches:
        raw_all, off_all = utf8_buffer(b.column(0))
        for lo, hi in row_chunks(off_all, _CHUNK):
            off = off_all[lo:hi + 1] - off_all[lo]
            words, _, _ = token_stream(raw_all[off_all[lo]:off_all[hi]], off, 1)
            parts.append(_add_up(words[0], np.ones(len(words[0]), np.int64)))
            held += len(parts[-1][0])
            if held > _FLUSH:
                parts = [_add_up(*(np.concatenate(x) for x in zip(*parts)))]
                held = len(parts[0][0])
                if held > _FLUSH // 2:
                    yield rows(parts)
                    parts, held = [], 0
    if held:
        yield rows(parts)


_GRAMS = "shard int, n int, n_runs int, rare binary, before binary, runs binary, others binary, count binary"


@dataclass(frozen=True)
class Numbers:
    """Numbers of words: common ones have their rank, others a place after them in a list of each block."""

    words: np.ndarray  # by rank

    @functools.cached_property
    def _slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word and number in each slot of a table by the hash's upper bits; sorted words without one; their numbers)."""
        slot = (self.words >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        number = np.zeros(1 << _SLOT_BITS, np.int64)
        number[slot] = np.arange(len(slot))
        late = np.flatnonzero(number[slot] != np.arange(len(slot)))
        late = late[np.argsort(self.words[late])]
        return self.words[number], number, self.words[late], late

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of every word, the block's list of rare words)."""
        held, number, late, ranks = self._slots
        slot = (words >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        out = number[slot]
        miss = np.flatnonzero(held[slot] != words)
        if len(late):
            at = np.minimum(np.searchsorted(late, words[miss]), len(late) - 1)
            found = late[at] == words[miss]
            out[miss[found]] = ranks[at[found]]
            miss = miss[~found]
        rare, back = np.unique(words[miss], return_inverse=True)
        out[miss] = len(self.words) + back
        return out, rare


def _planes(x: np.ndarray) -> np.ndarray:
    """Bytes of all numbers, first the lowest of each, then the next."""
    x = _small(x)
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.ravel()


def _unplanes(b: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, n)
    return np.ascontiguousarray(raw.T).view(f"<u{len(raw)}").ravel().astype(np.int64)


def _count_grams(order: int, deal: Dealing, numbers: Numbers, remainders: tuple[int, ...] = (), backward: bool = False):
    """Texts -> blocks of (gram, count) of the shards whose number leaves one of ``remainders`` by DEALT (none: of all
    shards), dealt by shard.

    ``backward``: words of a gram are in reverse, so that pairs are dealt by their last word.  In a block grams are sorted by their last word but one, then by the last, so the first is kept as runs and the
    other as steps; all words are numbers.
    """
    common = len(numbers.words)
    wanted = np.isin(np.arange(deal.shards) % DEALT, remainders)

    def blocks(parts):
        _, count, *words = _add_up(*(np.concatenate(x) for x in zip(*parts)))
        shard = deal.shard(words[-2], words[-1])
        number, rare = numbers.of(np.concatenate(words))
        number = number.reshape(order, len(count))
        # one key of shard, some bits of the hash of the last word but one, and the number of the last
        free = 64 - 24 - deal.shards.bit_length()
        sort = np.argsort((shard.astype(np.uint64) << np.uint64(free + 24)) | ((mix64(words[-2]) >> np.uint64(64 - free)) << np.uint64(24))
                          | np.minimum(number[-1], (1 << 24) - 1).astype(np.uint64))
        count, shard, number = count[sort], shard[sort], number[:, sort]
        bound = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])).tolist()
        pack = zstandard.ZstdCompressor(level=1)
        rows = []
        for lo, hi in zip(bound, bound[1:]):
            mine = number[:, lo:hi].copy()
            far = mine >= common  # the rare words of this row alone
            here, back = np.unique(mine[far], return_inverse=True)
            mine[far] = common + back
            before, last = mine[-2], mine[-1]
            new = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
            step = np.diff(last, prepend=0)
            step = (step << 1) ^ (step >> 63)  # small numbers for steps down, too
            rows.append((int(shard[lo]), hi - lo, len(new), rare[here - common].tobytes(), pack.compress(_planes(before[new])),
                         _small(np.diff(np.append(new, hi - lo))).tobytes(),
                         b"".join(len(z).to_bytes(4, "little") + z for z in (pack.compress(_planes(x)) for x in (step, *mine[:-2]))),
                         pack.compress(_planes(count[lo:hi]))))
        kinds = [*[pa.int32()] * 3, *[pa.binary()] * 5]
        for i in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i:i + 1000]), kinds)],
                                             ["shard", "n", "n_runs", "rare", "before", "runs", "others", "count"])

    def run(batches):
        parts, held = [], 0
        for b in batches:
            raw_all, off_all = utf8_buffer(b.column(0))
            for lo, hi in row_chunks(off_all, _CHUNK):
                off = off_all[lo:hi + 1] - off_all[lo]
                words, _, _ = token_stream(raw_all[off_all[lo]:off_all[hi]], off, order)
                if backward:
                    words.reverse()
                if remainders:
                    mine = np.flatnonzero(wanted[deal.shard(words[-2], words[-1])])
                    words = [w[mine] for w in words]
                part = _add_up(gram_names(words), np.ones(len(words[0]), np.int64), *words)
                parts.append(part)
                held += len(part[0])
                if held > _FLUSH:
                    yield from blocks(parts)
                    parts, held = [], 0
        if held:
            yield from blocks(parts)

    return run


def _read_block(numbers: Numbers, n: int, n_runs: int, rare: bytes, before: bytes, runs: bytes, others: bytes, count: bytes):
    """A row of ``_count_grams`` -> (counts, words of the grams by place)."""
    unpack = zstandard.ZstdDecompressor()
    words = np.concatenate([numbers.words, np.frombuffer(rare, np.uint64)])
    packed = []
    while others:
        size = 4 + int.from_bytes(others[:4], "little")
        packed.append(_unplanes(unpack.decompress(others[4:size]), n))
        others = others[size:]
    step, *rest = packed
    last = np.cumsum((step >> 1) ^ -(step & 1))
    middle = np.repeat(_unplanes(unpack.decompress(before), n_runs), _unsmall(runs, n_runs))
    return _unplanes(unpack.decompress(count), n), [words[x] for x in (*rest, middle, last)]


def _save(path: str, arrays: list[np.ndarray]) -> None:
    """Arrays in one file: how many, the width and length of each, then the arrays, each from a multiple of 8 bytes."""
    part = f"{path}.{os.getpid()}.{os.urandom(4).hex()}.tmp"
    with open(part, "wb") as f:
        f.write(np.array([len(arrays), *(x for a in arrays for x in (a.itemsize, len(a)))], np.int64).tobytes())
        for a in arrays:
            f.write(a.tobytes())
            f.write(bytes(-a.nbytes % 8))
    os.replace(part, path)


def _load(path: str) -> list[np.ndarray]:
    raw = np.asarray(np.memmap(path, np.uint8, "r"))
    n = int(raw[:8].view(np.int64)[0])
    sizes, at, out = raw[8:8 + 16 * n].view(np.int64).reshape(n, 2).tolist(), 8 + 16 * n, []
    for width, length in sizes:
        out.append(raw[at:at + width * length].view(f"u{width}"))
        at += -(-width * length // 8) * 8
    return out


def _sums_by(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys; the sums of their counts, and how many of these are 1, 2 and more."""
    sort = np.argsort(key)
    key, count = key[sort], count[sort]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[new], [np.add.reduceat(x.astype(np.int64), new) for x in (count, count == 1, count == 2, count > 2)]


_TOP = 255  # counts from here on are kept apart, so that the others take one byte
_SHARD_ROWS = "kind int, key long, a long, b long, c long, d long"
_WORD_CONTEXT, _WORD, _LEVEL, _CONTEXT, _SHARD = range(5)


def _grams_of(t: pa.Table, numbers: Numbers) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Blocks of one shard -> (sorted names, counts, words by place) of its grams."""
    parts = []
    for row in zip(*(t[k].to_pylist() for k in t.column_names[1:])):
        count, words = _read_block(numbers, *row)
        parts.append((gram_names(words), count, *words))
    name, count, *words = _add_up(*(np.concatenate(x) for x in zip(*parts)))
    return name, count, words


def _shard_table(rows: list[tuple]) -> pa.Table:
    cols = [np.concatenate([np.full(len(r[1]), r[0], np.int32) for r in rows]),
            *(np.concatenate([r[i].astype(np.int64, copy=False) for r in rows]) for i in range(1, 6))]
    return pa.table({k: pa.array(c) for k, c in zip(("kind", "key", "a", "b", "c", "d"), cols)})


def _sum_before(numbers: Numbers):
    """Blocks of backward pairs of one shard -> rows (_WORD, word, 0, distinct words before it, 0, 0)."""

    def run(t: pa.Table) -> pa.Table:
        _, _, words = _grams_of(t, numbers)
        word, before = np.unique(words[0], return_counts=True)
        zero = np.zeros(len(word), np.int64)
        return _shard_table([(_WORD, word.view(np.int64), zero, before, zero, zero)])

    return run


def _sum_shard(folder: str, order: int, deal: Dealing, numbers: Numbers):
    """Blocks of one shard -> its file in ``folder``, and rows (kind, key, a, b, c, d): the figures of one-word
    contexts and of the contexts of split words (total, once, twice, more), of
    an order (grams with a count of 1, 2, 3, 4), and the shard itself."""

    def run(t: pa.Table) -> pa.Table:
        name, count, words = _grams_of(t, numbers)
        rows, files, contexts = [], [], []
        grams = (name, count, words)
        for k in range(order, 1, -1):
            if k < order:  # suffixes of the longer grams, and what begins a document
                longer, _, tokens = grams
                suffix = gram_names(tokens[1:])
                one = np.ones(len(suffix), np.int64)
                begins = np.flatnonzero((words[order - k] == BEGIN) & (words[order - k + 1] != BEGIN))
                head = [w[begins] for w in words[order - k:]]
                parts = [np.concatenate(x) for x in zip((suffix, one, *tokens[1:]), (gram_names(head), count[begins], *head))]
                name_k, count_k, *tokens = _add_up(*parts)
            else:
                at = np.flatnonzero(words[1] != BEGIN)  # no mark repeated
                name_k, count_k, tokens = name[at], count[at], [w[at] for w in words]
            grams = (name_k, count_k, tokens)
            many = np.flatnonzero(count_k >= _TOP)
            files = [name_k, np.minimum(count_k, _TOP).astype(np.uint8), name_k[many], _small(count_k[many]), *files]
            rows.append((_LEVEL, np.array([k]), *(np.array([(count_k == i).sum()]) for i in (1, 2, 3, 4))))
            if not len(name_k):
                contexts = [*([np.zeros(0, np.uint64)] * 5 if k > 2 else []), *contexts]
            elif k > 2:
                split = np.zeros(len(name_k), bool)
                split[deal.split(tokens[-2])[0]] = True
                figures = []
                for mine in (split, ~split):
                    figures.append(_sums_by(gram_names([w[mine] for w in tokens[:-1]]), count_k[mine]) if mine.any()
                                   else (np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * 4))
                rows.append((_CONTEXT, figures[0][0].view(np.int64), *figures[0][1]))
                ctx, sums = figures[1]
                some = sums[0] > 1
                contexts = [ctx[some], *(_small(x[some]) for x in sums), *contexts]
            else:
                ctx, sums = _sums_by(tokens[0], count_k)
                rows.append((_WORD_CONTEXT, ctx.view(np.int64), *sums))
        shard = t["shard"][0].as_py()
        _save(f"{folder}/grams-{shard}", [*files, *contexts])
        rows.append((_SHARD, np.array([shard]), *[np.zeros(1, np.int64)] * 4))
        return _shard_table(rows)

    return run


def _save_range(folder: str, kind: str, columns: tuple[str, ...]):
    """Figures of the keys of one range -> its file; one row of sums (of no meaning for contexts)."""

    def run(t: pa.Table) -> pa.Table:
        key = t["key"].to_numpy().view(np.uint64)
        sort = np.argsort(key)
        stat = [t[c].to_numpy()[sort] for c in columns]
        shard = t["shard"][0].as_py()
        _save(f"{folder}/{kind}-{shard}", [key[sort], *map(_small, stat)])
        seen, before = stat[0], stat[1]
        return pa.table({"shard": [shard], "types": [int((seen > 0).sum())], "pairs": [int(before.sum())],
                         **{f"b{i}": [int((before == i).sum())] for i in (1, 2, 3, 4)},
                         "b3up": [int((before > 2).sum())]})

    return run


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many items occur 1, 2, 3 and 4 times.

    Where a count is zero the estimate does not exist, and one outside (0, k) would take all mass from the items that
    occur k times or leave none for the lower order; then k / 2 is taken for k = 1, 2, 3.  So every discount is
    positive, and every probability, too.
    """
    if n[0] and n[0] + 2 * n[1]:
        y = n[0] / (n[0] + 2 * n[1])
    else:
        return 0.5, 1.0, 1.5
    out = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2 for k in (1, 2, 3)]
    return tuple(d if 0 < d < k else k / 2 for k, d in zip((1, 2, 3), out))


@dataclass(frozen=True)
class Model:
    """A trained model: its folder and the few figures that all workers need."""

    folder: str
    order: int
    shards: int
    tokens: int
    types: int
    pairs: int
    gram_discounts: tuple[tuple[float, float, float], ...]  # of the orders from 2 on
    word_discounts: tuple[float, float, float]
    rest: float = field(default=1.0)  # mass of the lowest order that is spread evenly


MAPS = 4096  # files that a worker keeps mapped; a process may hold some 65,000 maps
_MAPPED: OrderedDict[str, list[np.ndarray]] = OrderedDict()
_LISTS: dict[str, tuple[Dealing, dict[str, frozenset[int]]]] = {}
MANIFEST = "shards.npz"
_KINDS = ("grams", "words", "contexts")


def _listed(model: Model) -> tuple[Dealing, dict[str, frozenset[int]]]:
    """How grams are dealt and the files of a model, from the list that is written last; without it there is no model."""
    if model.folder not in _LISTS:
        listed = np.load(f"{model.folder}/{MANIFEST}")
        _LISTS[model.folder] = (Dealing(model.shards, listed["split"], listed["parts"]),
                                {k: frozenset(listed[k].tolist()) for k in _KINDS})
    return _LISTS[model.folder]


def _mapped(path: str) -> list[np.ndarray]:
    """The arrays of a mapped file; the least recently used ones are unmapped.  A listed file that is missing is an error."""
    if path in _MAPPED:
        _MAPPED.move_to_end(path)
    else:
        _MAPPED[path] = _load(path)
        if len(_MAPPED) > MAPS:
            _MAPPED.popitem(last=False)
    return _MAPPED[path]


def _find(table: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, place) of sorted names in a sorted mapped array."""
    if not len(table):
        return np.zeros(len(names), bool), np.zeros(len(names), np.int64)
    at = np.minimum(np.searchsorted(table, names), len(table) - 1)
    return table[at] == names, at


def _range(key: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of the hash, so that sorted keys have sorted ranges."""
    return (((key >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _by_file(model: Model, kind: str, number: np.ndarray):
    """(arrays, places) for each listed file that the numbers ask for; places in order."""
    listed = _listed(model)[1][kind]
    sort = np.argsort(number.astype(np.uint16) if model.shards <= 1 << 16 else number, kind="stable")
    bound = np.flatnonzero(np.concatenate([[True], np.diff(number[sort]) != 0, [True]])).tolist() if len(number) else []
    for lo, hi in zip(bound, bound[1:]):
        s = int(number[sort[lo]])
        if s in listed:
            yield _mapped(f"{model.folder}/{kind}-{s}"), sort[lo:hi]


def range_figures(model: Model, kind: str, keys: np.ndarray, width: int) -> np.ndarray:
    """The figures of sorted distinct keys of words or of split contexts; zeros for unknown ones."""
    out = np.zeros((len(keys), width), np.int64)
    for (table, *stat), places in _by_file(model, kind, _range(keys, model.shards)):
        found, at = _find(table, keys[places])
        for i, column in enumerate(stat):
            out[places[found], i] = column[at[found]]
    return out


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, a place of each, the value's number for every place); quicker than a stable sort."""
    sort = np.argsort(x)
    ranked = x[sort]
    new = np.ones(len(x), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    back = np.empty(len(x), np.int64)
    back[sort] = np.cumsum(new) - 1
    return ranked[new], sort[new], back


def gram_counts(model: Model, name: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Counts of grams of sorted distinct names whose words are given in order (below the highest order: distinct words
    before them)."""
    out = np.zeros(len(name), np.int64)
    at = 4 * (len(words) - 2)
    for arrays, places in _by_file(model, "grams", _listed(model)[0].shard(words[-2], words[-1])):
        table, count, many, n = arrays[at:at + 4]
        found, place = _find(table, name[places])
        out[places[found]] = count[place[found]]
        high = places[found][count[place[found]] == _TOP]
        if len(high):
            out[high] = n[np.searchsorted(many, name[high])]
    return out


def context_figures(model: Model, name: np.ndarray, words: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    """(total, once, twice, more) of contexts of two words or more, by sorted distinct names; ``known``: which of them
    are known grams."""
    out = np.zeros((len(name), 4), np.int64)
    out[:, :2] = known[:, None]
    deal, last = _listed(model)[0], words[-1]
    at = 4 * (model.order - 1) + 5 * (len(words) - 2)
    split = deal.split(last)[0]
    whole = np.ones(len(name), bool)
    whole[split] = False
    plain = np.flatnonzero(whole)
    for arrays, places in _by_file(model, "grams", deal.home(last[plain])):
        table, *stat = arrays[at:at + 5]
        places = plain[places]
        found, place = _find(table, name[places])
        for i, column in enumerate(stat):
            out[places[found], i] = column[place[found]]
    if len(split):
        figures = range_figures(model, "contexts", name[split], 4)
        seen = figures[:, 0] > 0
        out[split[seen]] = figures[seen]
    return out


def _spread(figures: np.ndarray, discounts: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(total, 1 where there is none; share left to the lower order) of contexts with (total, once, twice, more)."""
    total, once, twice, more = figures.T
    some = np.maximum(total, 1)
    left = (once * discounts[0] + twice * discounts[1] + more * discounts[2]) / some
    return some, np.where(total > 0, left, 1.0)


def log_probabilities(model: Model, words: list[np.ndarray], length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log10 of the model's probability, of the base's, training count) of each token of a stream.

    Whatever a word, gram or context decides alone is found once for each distinct one.
    """
    tokens = words[-1]
    distinct, _, back = _distinct(np.append(tokens, BEGIN))
    back, begin = back[:-1], back[-1]
    stat = range_figures(model, "words", distinct, len(STATS))
    seen, before, contexts = stat[:, 0], stat[:, 1], stat[:, 2:]
    dw = np.array([0.0, *model.word_discounts])
    lowest = np.maximum(before - dw[np.minimum(before, 3)], 0) / max(model.pairs, 1) + model.rest / (model.types + 1)
    base = np.log10((seen + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
    p = lowest[back]
    # the context of a token is the shorter gram that ends at the token before
    context = np.where(words[-2] == BEGIN, begin, np.roll(back, 1))
    for k in range(2, model.order + 1):
        at = np.flatnonzero(length >= k)
        mine = [w[at] for w in words[-k:]]
        name, first, number = _distinct(gram_names(mine))
        mine = [w[first] for w in mine]
        n = gram_counts(model, name, mine)
        some, left = _spread(contexts, model.gram_discounts[k - 2])
        d = np.array([0.0, *model.gram_discounts[k - 2]])
        which = context if k == 2 else context[at - 1]
        kept = np.maximum(n - d[np.minimum(n, 3)], 0)
        p[at] = kept[number] / some[which] + left[which] * p[at]
        if k < model.order:
            contexts = context_figures(model, name, mine, n > 0)
            context = np.zeros(len(tokens), np.int64)
            context[at] = number
    return np.log10(p), base[back], seen[back]


def _write_manifest(folder: str, deal: Dealing, files: dict[str, list[int]]) -> None:
    """The files that were written and the split words, as the last file of the model."""
    part = f"{folder}/{MANIFEST}.{os.urandom(4).hex()}.tmp"
    with open(part, "wb") as f:
        np.savez(f, split=deal.words, parts=deal.parts, **{k: np.array(v, np.int64) for k, v in files.items()})
    os.replace(part, f"{folder}/{MANIFEST}")


def _folder(path: str) -> str:
    """The mounted path of a shared folder."""
    plain = path.removeprefix("file://").removeprefix("file:")
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"the model is memory-mapped: give a mounted folder, not {path}")
    return "/" + plain.lstrip("/")


def _deal(seen: DataFrame, tokens: int, shards: int) -> Dealing:
    """Split words: those that fill more than a quarter of a shard and are more than 1 / SPLIT_WORDS of all tokens.

    There are as many begin marks as end marks.
    """
    least = max(tokens / (4 * shards), tokens / SPLIT_WORDS)
    found = seen.filter(F.col("n") > least).collect() if shards > 1 else []  # fewer than SPLIT_WORDS rows
    words = np.array([r["word"] for r in found], np.int64).view(np.uint64)
    parts = np.array([min(shards, math.ceil(4 * shards * r["n"] / tokens)) for r in found], np.int64)
    ends = words == END
    words, parts = np.append(words, np.full(ends.sum(), BEGIN)), np.append(parts, parts[ends])
    sort = np.argsort(words)
    return Dealing(shards, words[sort], parts[sort])


def _number(seen: DataFrame, tokens: int) -> Numbers:
    """Numbers by rank for the begin mark and the words that are more than 1 / COMMON_WORDS of all tokens."""
    found = seen.filter(F.col("n") * F.lit(COMMON_WORDS) > F.lit(tokens)).collect()  # fewer than COMMON_WORDS rows
    ranked = sorted(found, key=lambda r: (-r["n"], r["word"]))
    return Numbers(np.concatenate([np.array([BEGIN]), np.array([r["word"] for r in ranked], np.int64).view(np.uint64)]))


def train(docs: DataFrame, text: str = "text", folder: str | None = None, order: int = ORDER) -> Model:
    """Count all of ``docs`` (null text: empty, an end mark alone) and write a model of ``order`` 2 or more.

    Only sums, counts of counts, file numbers, fewer than SPLIT_WORDS split and fewer than COMMON_WORDS common words
    reach the driver.  The number of shards grows with the texts, so each is of bounded size, and the tasks that sum
    them grow with it.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    with _short_shuffles(docs.sparkSession):
        return _train(docs, text, folder, order)


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _short_shuffles(spark: SparkSession):
    """Inside, the shuffle files of a written step are removed when it ends; the setting is put back after."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def _train(docs: DataFrame, text: str, folder: str | None, order: int) -> Model:
    spark: SparkSession = docs.sparkSession
    body = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = body.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(size / _SHARD_BYTES))
    folder = _folder(folder or shared_path(spark, "lm"))
    os.makedirs(folder, exist_ok=True)
    seen = stored(body.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "seen")
    tokens = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    deal = _deal(seen, tokens, shards)
    numbers = _number(seen, tokens)

    def summed(order: int, backward: bool, rounds, sums, name: str) -> DataFrame:
        out = None
        for nth, remainders in enumerate(rounds):
            blocks = body.mapInArrow(_count_grams(order, deal, numbers, remainders, backward), _GRAMS)
            dealt = blocks.repartition(max(1, math.ceil(shards * len(remainders or range(DEALT)) / DEALT)), "shard").groupBy("shard")
            part = stored(dealt.applyInArrow(sums, _SHARD_ROWS), f"{name}-{nth}")
            out = part if out is None else out.unionByName(part)
        return out

    # pairs come first, while no grams are on the disk
    before = summed(2, True, [()], _sum_before(numbers), "before")
    rows = (summed(order, False, ROUNDS if shards > 1 else [()], _sum_shard(folder, order, deal, numbers), "grams")
            .unionByName(before))
    few = {r["key"]: list(r)[1:] for r in rows.filter(F.col("kind") == _LEVEL).groupBy("key").agg(*[F.sum(c) for c in "abcd"]).collect()}
    where, zero = F.col("kind"), F.lit(0).cast("long")
    figures = {"before": (_WORD, "b"), "total": (_WORD_CONTEXT, "a"), "once": (_WORD_CONTEXT, "b"), "twice": (_WORD_CONTEXT, "c"),
               "more": (_WORD_CONTEXT, "d")}
    both = (rows.filter(where.isin(_WORD, _WORD_CONTEXT))
            .select("key", zero.alias("seen"), *[F.when(where == k, F.col(c)).otherwise(zero).alias(n) for n, (k, c) in figures.items()])
            .unionByName(seen.select(F.col("word").alias("key"), F.col("n").alias("seen"), *[zero.alias(n) for n in figures])))
    words = both.groupBy("key").agg(*[F.sum(k).alias(k) for k in STATS])
    contexts = (rows.filter(where == _CONTEXT).groupBy("key")
                .agg(*[F.sum(a).alias(b) for a, b in zip("abcd", STATS[2:])]).filter("total > 1"))
    high = F.shiftrightunsigned("key", 32) * F.lit(shards)
    schema = "shard long, types long, pairs long, b1 long, b2 long, b3 long, b4 long, b3up long"

    def ranges(df: DataFrame, kind: str, columns: tuple[str, ...]) -> DataFrame:
        dealt = df.withColumn("shard", F.shiftright(high, 32).cast("int"))
        return stored(dealt.groupBy("shard").applyInArrow(_save_range(folder, kind, columns), schema), kind)

    sums = ranges(words, "words", STATS)
    split = ranges(contexts, "contexts", STATS[2:])
    s = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums.columns]).first()
    # one number per file: a reader must find them all
    files = {"grams": rows.filter(where == _SHARD).select("key"), "words": sums.select("shard"), "contexts": split.select("shard")}
    _write_manifest(folder, deal, {k: [r[0] for r in df.collect()] for k, df in files.items()})
    dw = discounts([s["b1"], s["b2"], s["b3"], s["b4"]])
    rest = (dw[0] * s["b1"] + dw[1] * s["b2"] + dw[2] * s["b3up"]) / s["pairs"] if s["pairs"] else 1.0
    return Model(folder, order, shards, tokens, s["types"], s["pairs"],
                 tuple(discounts(few.get(k, [0] * 4)) for k in range(2, order + 1)), dw, rest)


_FIELDS = {"n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double", "perplexity": "double"}


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, and n_tokens, n_known, base_score, score (log10), perplexity.

    Null text counts as empty: its only token is the end mark.  On a machine that does not see the model's files
    (its list of shards, or one that is listed) the job fails; it never scores as if nothing had been learnt.
    """
    narrow = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))

    def run(batches):
        for b in batches:
            raw_all, off_all = utf8_buffer(b.column(len(keep)))
            cols = [[] for _ in range(4)]
            for lo, hi in row_chunks(off_all, _SCORED):
                off = off_all[lo:hi + 1] - off_all[lo]
                words, length, first = token_stream(raw_all[off_all[lo]:off_all[hi]], off, model.order)
                p, base, seen = log_probabilities(model, words, length)
                cols[0].append(np.diff(first))
                for c, x in zip(cols[1:], ((seen > 0).astype(np.int64), base, p)):
                    c.append(np.add.reduceat(x, first[:-1]))
            n, known, base, p = (np.concatenate(c) if c else np.zeros(0) for c in cols)
            out = [n.astype(np.int64), known.astype(np.int64), base, p, 10.0 ** np.minimum(-p / np.maximum(n, 1), 300)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c) for c in out)], [*keep, *_FIELDS])

    schema = StructType(narrow.schema.fields[:-1])
    for name, kind in _FIELDS.items():
        schema = schema.add(name, kind)
    return narrow.mapInArrow(run, schema)


def held_out_scores(docs: DataFrame, id_col: str = "doc_id", text: str = "text", folds: int = FOLDS,
                    order: int = ORDER) -> DataFrame:
    """Train on the documents whose crc32(id as text) is not divisible by ``folds`` and score all of them.

    A null id counts as the empty text (held out); repeated rows count each time; other columns are not
    read; an empty table gives no rows, and with nothing to learn from every token has probability 1.
    """
    out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(folds) == 0
    narrow = docs.select(F.col(id_col), F.col(text).alias("text"), out.alias("held_out"))
    model = train(narrow.filter(~F.col("held_out")), order=order)
    return (score(narrow, model, [id_col, "held_out"]).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
            .select(id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"))
