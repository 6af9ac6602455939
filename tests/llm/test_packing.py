import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codesieve.llm import packing
from tests.llm import cases

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def check_plan(hist, capacity):
    done, bins = packing.plan_bins(hist, capacity)
    ranks, at = defaultdict(list), defaultdict(list)
    for length, rank, count, first, offset in done:
        ranks[length] += range(rank, rank + count)
        for i in range(count):
            at[first + i].append((offset, length))
    assert {l: sorted(r) for l, r in ranks.items()} == {l: list(range(n)) for l, n in hist.items() if n}
    assert set(at) <= set(range(bins))
    for items in at.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= capacity
        assert sum(3 * length > capacity for _, length in items) <= 2
    return len(at)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 30), max_size=25))
def test_plan_places_every_item_once(hist):
    used = check_plan(hist, 60)
    gaps = []  # plain best-fit decreasing over single items
    for length in sorted((l for l, n in hist.items() for _ in range(n)), reverse=True):
        fits = [g for g in gaps if g >= length]
        gap = min(fits) if fits else 60
        if fits:
            gaps.remove(gap)
        gaps.append(gap - length)
    assert used <= 1.1 * len(gaps) + 1


def test_plan_on_many_items():
    r = random.Random(3)
    hist = Counter(min(2048, int(r.expovariate(1 / 500)) + 1) for _ in range(100_000))
    hist[2048] += 1_000_000_000
    done, bins = packing.plan_bins(dict(hist))
    total = sum(l * n for l, n in hist.items())
    assert bins <= 1.0001 * total / 2048 and len(done) < 50_000


def test_ids_are_the_library_s():
    enc, lib = packing.Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    odd = ["a  b", " a", "a ", "a\n\nb", "a \nb", "a\n b", "it's 's ' s", "<|endoftext|>", "a <|endoftext|> b", "x<|y", " a b",
           "a b c", "日本 語", "é ́", "\x1ca b", "\x85 b", "1234 12\n3", "\r\n", "a\tb", "​ ​", "🙂 🙂🙂\n🙂"]
    for t in [x for x in cases.texts(6) if x] + odd:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t'sabZ0é日.<| 　\x1c-", max_size=40))
def test_ids_property(text):
    enc, lib = packing.encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY) if not hasattr(test_ids_property, "lib") else test_ids_property.lib
    test_ids_property.lib = lib
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [2048, 50])
def test_round_trip(spark, capacity):
    docs = cases.documents(spark, cases.texts(8))
    lib = Tokenizer.from_file(VOCABULARY)
    rows = packing.pack_documents(docs, VOCABULARY, capacity=capacity).collect()
    want = []
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(r.doc_id, k, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes()))
                 for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == Counter(want)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for items in by.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(r.length for r in rows)
    assert len(by) <= 1.1 * total / capacity + 1


def test_sequences_hold_the_ids(spark):
    docs = cases.documents(spark, cases.texts(9, 10))
    lib = Tokenizer.from_file(VOCABULARY)
    seqs = packing.sequences(docs, VOCABULARY).collect()
    assert all(len(s.ids) == 4 * s.n_tokens <= 8192 for s in seqs)
    got = Counter(i for s in seqs for i in np.frombuffer(bytes(s.ids), "<u4").tolist())
    assert got == Counter(i for r in docs.collect() for i in [*lib.encode(r.text or "", add_special_tokens=False).ids, 0])


def test_empty_table(spark):
    assert packing.pack_documents(cases.empty(spark), VOCABULARY).count() == 0
