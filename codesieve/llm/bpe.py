"""BPE over the words of a text as a transducer with bounded lookahead, and the way back.

The merge list says how far a merge at the open end of a word can reach back.  Two texts that begin
alike are merged alike left of a frontier, at first the end of what they share.  Only a merge (u, v)
across the frontier moves it, by the length of u; then one text holds uv there and the other u, so
the next merge across, which has a higher rank, has a right part that begins with u in its own
derivation.  The longest such chain of merges of rising rank is the sufficient lookahead: a token
that ends so many symbols before the end of what was read can no longer change.  A word of any
length is therefore encoded in blocks, in constant memory; what is emitted never has to be revised.

The files handled are word-level ones with an end-of-word mark: NFC, lower case, white space dropped,
words by a pattern of the file, bytes as symbols.  A file of another kind raises ValueError.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

BLOCK = 2048          # symbols read beyond the lookahead before tokens are emitted
MEMO = 300_000        # remembered pieces; further ones are encoded each time
BATCH_IDS = 4 << 20
_WINDOW = 1 << 16
_LONG = 256           # longer pieces are not remembered
_FEW = 100            # symbols up to which a list is quicker than a heap

# white space of the file's patterns; str.split() also splits at \x1c-\x1f, which are no white space there
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_NOT_SPACE = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level files: itself if it prints in Latin-1, else 256 and up in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = [chr(b) if b in shown else "" for b in range(256)]
    hidden = (b for b in range(256) if not table[b])
    for i, b in enumerate(hidden):
        table[b] = chr(256 + i)
    return table


def sufficient_lookahead(merges: list[tuple[str, str]], length) -> int:
    """How many symbols before the open end the tokens may still change; ``length`` gives a token's symbols.

    For each merge in rank order: the length of its left part and, before it, the furthest reach of an earlier merge
    whose left part begins the derivation of its right part.  The list must be proper: each part is a symbol or made
    by an earlier merge, each token by one merge; then merges happen in the order of their ranks.
    """
    halves: dict[str, tuple[str, str]] = {}
    reach: dict[str, int] = {}
    parts = {p for m in merges for p in m}
    made_by = {a + b for a, b in merges}
    symbols, furthest = parts - made_by, 0
    for left, right in merges:
        whole = left + right
        if whole in halves or any(p not in symbols and p not in halves for p in (left, right)):
            raise ValueError("the merge list is not proper")
        before, spine = 0, right
        while True:
            before = max(before, reach.get(spine, 0))
            if spine not in halves:
                break
            spine = halves[spine][0]
        halves[whole] = (left, right)
        reach[left] = max(reach.get(left, 0), before + length(left))
        furthest = max(furthest, reach[left])
    return furthest


class Vocabulary:
    """A vocabulary file: symbols of bytes, ranked merges, tokens by id, and the lookahead of its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], self._checked(spec)
        self.mark = model["end_of_word_suffix"]
        ids = model["vocab"]
        chars = byte_symbols()
        self.inner = [ids[c] for c in chars]
        self.final = [ids[c + self.mark] for c in chars]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(merges)}
        self.made = [ids[a + b] for a, b in merges]  # token of each rank
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t.encode() for t, i in ids.items()} | {i: t.encode() for t, i in self.added.items()}
        # symbols of a token: one a character; the mark is part of the last one
        self.length = {i: len(t.removesuffix(self.mark)) for t, i in ids.items()}
        self.lookahead = sufficient_lookahead(merges, lambda t: len(t.removesuffix(self.mark)))
        value = {c: b for b, c in enumerate(chars)}
        self.bytes = {i: bytes(value[c] for c in t.removesuffix(self.mark)) + (b" " if t.endswith(self.mark) else b"")
                      for t, i in ids.items()} | {i: t.encode() + b" " for t, i in self.added.items()}
        self.words = regex.compile(split)
        longest = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    @staticmethod
    def _checked(spec: dict) -> str:
        """The word pattern of a file of the kind handled here."""
        def kinds(x):
            return [p["type"] for p in x] if x else []

        model, normal, words = spec["model"], spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps, cuts = normal.get("normalizers"), words.get("pretokenizers")
        fits = (model["type"] == "BPE" and model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix")
                and not model.get("dropout") and not model.get("byte_fallback") and not model.get("ignore_merges")
                and kinds(steps) == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"}
                and kinds(cuts) == ["Split", "ByteLevel"] and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
                and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
                and spec.get("decoder") is None and spec.get("post_processor") is None
                and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]))
        if not fits:
            raise ValueError("not a word-level BPE file of the kind handled here")
        return cuts[0]["pattern"]["Regex"]

    def merge(self, symbols: list[int]) -> list[int]:
        """All merges among the symbols: always the lowest rank, and of equal ones the leftmost."""
        return self._merge_few(symbols) if len(symbols) <= _FEW else self._merge_many(symbols)

    def _merge_few(self, symbols: list[int]) -> list[int]:
        """The ranks of neighbours in a list beside the tokens; its minimum is the next merge."""
        ranks, none = self.ranks.get, len(self.made)
        tokens = list(symbols)
        near = [ranks(p, none) for p in zip(tokens, tokens[1:])]
        while near:
            rank = min(near)
            if rank == none:
                break
            i = near.index(rank)
            tokens[i:i + 2] = (self.made[rank],)
            del near[i]
            if i < len(near):
                near[i] = ranks((tokens[i], tokens[i + 1]), none)
            if i:
                near[i - 1] = ranks((tokens[i - 1], tokens[i]), none)
        return tokens

    def _merge_many(self, symbols: list[int]) -> list[int]:
        """A heap of (rank, place) over a linked list of tokens."""
        ranks, n = self.ranks, len(symbols)
        token, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            # the pair may be gone: its left or right part was merged away or into another token
            if token[i] < 0 or j >= n or ranks.get((token[i], token[j]), -1) != rank:
                continue
            token[i], token[j] = self.made[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (token[i], token[k]) in ranks:
                    heappush(heap, (ranks[token[i], token[k]], i))
            h = before[i]
            if h >= 0 and (token[h], token[i]) in ranks:
                heappush(heap, (ranks[token[h], token[i]], h))
        return [t for t in token if t >= 0]


class WordTransducer:
    """Bytes of one word in, token ids out as soon as no further byte can change them.

    Holds at most the lookahead, one block and one token, however long the word is.
    """

    def __init__(self, vocabulary: Vocabulary, block: int = BLOCK):
        self.vocabulary, self.block = vocabulary, block
        self.open: list[int] = []     # symbols not covered by emitted tokens
        self.last: int | None = None  # the last byte read: whether it ends the word is not known yet

    def feed(self, data: bytes) -> Iterator[int]:
        for lo in range(0, len(data), self.block):
            part = data[lo:lo + self.block]
            if self.last is not None:
                self.open.append(self.vocabulary.inner[self.last])
            self.open += [self.vocabulary.inner[b] for b in part[:-1]]
            self.last = part[-1]
            if len(self.open) >= self.vocabulary.lookahead + self.block:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        """Emit the tokens that end at least the lookahead before the open end; what follows starts afresh at their border."""
        settled, at, v = len(self.open) - self.vocabulary.lookahead, 0, self.vocabulary
        for token in v.merge(self.open):
            if at + v.length[token] > settled:
                break
            at += v.length[token]
            yield token
        del self.open[:at]

    def close(self) -> list[int]:
        """The rest of the word; its last byte carries the end-of-word mark."""
        if self.last is None:
            return []
        rest = self.vocabulary.merge([*self.open, self.vocabulary.final[self.last]])
        self.open, self.last = [], None
        return rest


class _Pieces(dict):
    """Word, or piece between white space, -> its ids as 32-bit bytes; at most ``MEMO`` pieces are remembered."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= _LONG and len(self) < MEMO:
            self[piece] = ids
        return ids


class Encoder:
    """Text -> ids.  White space separates: what lies between is normalised and encoded by itself."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words, self.pieces = _Pieces(self._word), _Pieces(self._piece)
        self.newer = None

    def _words_of(self, piece: str) -> Iterable[str]:
        """The words of a piece after NFC and lower case, character by character (no final sigma)."""
        if not piece.isascii():
            if any(unicodedata.category(c) == "Cn" for c in set(piece)):
                return self._newer_words(piece)
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        lowered, words = piece.lower(), self.vocabulary.words
        return words.findall(lowered) if len(lowered) <= _WINDOW else (m[0] for m in words.finditer(lowered))

    def _newer_words(self, piece: str) -> list[str]:
        """The same of a piece with characters that this Python's tables don't have yet, by the library's tables."""
        from tokenizers import Regex, normalizers, pre_tokenizers

        if self.newer is None:
            self.newer = (normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]),
                          pre_tokenizers.Split(Regex(self.vocabulary.words.pattern), "removed", True))
        return [w for w, _ in self.newer[1].pre_tokenize_str(self.newer[0].normalize_str(piece))]

    def _word(self, word: str) -> bytes:
        data = word.encode()
        if len(data) <= _LONG:
            inner = self.vocabulary.inner
            ids = self.vocabulary.merge([*[inner[b] for b in data[:-1]], self.vocabulary.final[data[-1]]])
            return array("i", ids).tobytes()
        transducer, out = WordTransducer(self.vocabulary), array("i")
        for lo in range(0, len(data), _WINDOW):
            out.extend(transducer.feed(data[lo:lo + _WINDOW]))
        out.extend(transducer.close())
        return out.tobytes()

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self._words_of(piece)))

    def _plain(self, text: str) -> Iterator[bytes]:
        """A text without added tokens, window by window; a window ends before white space."""
        lo, n = 0, len(text)
        while lo < n:
            hi = lo + _WINDOW
            if hi < n:
                space = _SPACE.search(text, hi)
                hi = space.start() if space else n
            window = text[lo:hi]
            found = _SPACE.split(window) if _NOT_SPACE.search(window) else window.split()
            yield b"".join(map(self.pieces.__getitem__, found))
            lo = hi

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as 32-bit bytes."""
        added, special = self.vocabulary.added, self.vocabulary.special
        parts: Iterable[str] = special.split(text) if special and special.search(text) else (text,)
        return b"".join(array("i", [added[p]]).tobytes() if p in added else b"".join(self._plain(p)) for p in parts)


class ByteToText:
    """UTF-8 in pieces of any size -> text: up to three bytes of a character that is not complete wait for the rest.

    What can't become a character is replaced by U+FFFD as in a whole decode.
    """

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            b = data[-back]
            if b < 0x80:
                break
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                if back < need:  # a lead byte always begins something new, so it is safe to cut before it
                    cut -= back
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held.decode("utf-8", "replace"), b""
        return rest


class Decoder:
    """Ids in blocks -> text.  ``joined``: the file's own way, tokens with a space between; else the bytes that the
    tokens stand for, a space for each end of word."""

    def __init__(self, vocabulary: Vocabulary, joined: bool = True):
        self.table = vocabulary.tokens if joined else vocabulary.bytes
        self.between = b" " if joined else b""
        self.state, self.started = ByteToText(), False

    def feed(self, ids: list[int]) -> str:
        data = self.between.join([self.table[i] for i in ids if i in self.table])
        if data and self.started:
            data = self.between + data
        self.started = self.started or bool(data)
        return self.state.feed(data)

    def close(self) -> str:
        return self.state.close()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Vocabulary(path))
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ids (array<int>) of the whole text, as the file's library gives them.

    Null and empty text have no ids.  The file's added tokens count as such where a text holds their strings.  Rows
    are taken alone: repeated rows give repeated results, a null id stays, other columns are not read, an empty table
    gives no row.  A long text is read in windows that end at white space and a long word in blocks.
    """
    narrow = docs.select(docs[id_col].alias(id_col), docs[text].cast("string").alias("text"))

    def run(batches):
        coder = encoder(vocabulary)

        def batch(at, made):
            sizes = np.cumsum([0, *(len(m) // 4 for m in made)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(made), np.int32))
            return pa.RecordBatch.from_arrays([at, pa.ListArray.from_arrays(pa.array(sizes), values)], [id_col, "ids"])

        for b in batches:
            made, total, lo = [], 0, 0
            for k, value in enumerate(b.column(1)):
                made.append(coder.encode(value.as_py() or ""))
                total += len(made[-1]) // 4
                if total >= BATCH_IDS:
                    yield batch(b.column(0).slice(lo, k + 1 - lo), made)
                    made, total, lo = [], 0, k + 1
            if made:
                yield batch(b.column(0).slice(lo), made)

    return narrow.mapInArrow(run, StructType([narrow.schema[0]]).add("ids", ArrayType(IntegerType())))


def decode_documents(encoded: DataFrame, vocabulary: str, ids: str = "ids", joined: bool = True) -> DataFrame:
    """The rows with a column ``decoded``: the text of their ids; null ids give an empty text, unknown ids nothing."""
    if "decoded" in encoded.columns:
        raise ValueError("the rows have a column 'decoded' already")
    names = encoded.columns
    at = names.index(ids)

    def run(batches):
        known = encoder(vocabulary).vocabulary
        for b in batches:
            made, size, lo = [], 0, 0
            for k, value in enumerate(b.column(at)):
                row = value.values.to_numpy(zero_copy_only=False) if value.is_valid else np.zeros(0, np.int32)
                decoder = Decoder(known, joined)
                parts = [decoder.feed(row[i:i + _WINDOW].tolist()) for i in range(0, len(row), _WINDOW)]
                made.append("".join(parts) + decoder.close())
                size += len(made[-1])
                if size >= 4 * BATCH_IDS:
                    yield pa.RecordBatch.from_arrays([*b.slice(lo, k + 1 - lo).columns, pa.array(made, pa.string())], [*names, "decoded"])
                    made, size, lo = [], 0, k + 1
            if made:
                yield pa.RecordBatch.from_arrays([*b.slice(lo).columns, pa.array(made, pa.string())], [*names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields]).add("decoded", "string"))


def bpe_report(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256."""
    made = decode_documents(encode_documents(docs, vocabulary, id_col, text), vocabulary)
    return made.select(id_col, F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
