import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codesieve.llm import repeats
from tests.llm import cases


def brute(rows, length):
    """rows (id, text), any order -> Counter of (id, n_bytes, n_removed, n_spans, kept digest)."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = set(), []
    for d, t in order:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s:s + length]
            if w in seen:
                gone[s:s + length] = b"\x01" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def got(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def passages(seed, n=60, length=100):
    """Documents that share passages of all lengths around ``length``, with edits at their edges and inside."""
    r = random.Random(seed)

    def prose(k):
        return "".join(r.choice("abcdeé 日\n") for _ in range(k))

    shared = [prose(r.randint(length // 2, 4 * length)) for _ in range(6)] + ["-" * (2 * length), "ab" * length]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            p = r.choice(shared)
            lo = r.randint(0, len(p) // 2) if r.random() < 0.5 else 0
            p = p[lo:len(p) - (r.randint(0, len(p) // 2) if r.random() < 0.5 else 0)]
            if r.random() < 0.3:
                i = r.randrange(len(p))
                p = p[:i] + r.choice("xyz") + p[i + 1:]
            parts += [prose(r.randint(0, length)), p]
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("length,k,group_rows", [(100, 32, 2048), (100, 32, 3), (20, 8, 2048), (20, 8, 5)])
def test_matches_brute_force(spark, length, k, group_rows):
    docs = cases.documents(spark, passages(length + k, length=length) + cases.texts(15, 10))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(repeats.repeat_report(docs, length=length, k=k, group_rows=group_rows)) == brute(rows, length)


def test_common_passage_with_many_edges(spark):
    """One passage in every document, another text around it each time; batches of a few documents."""
    r = np.random.default_rng(2)
    values = [f"{r.integers(1 << 60)} {r.integers(1 << 60):x} " + "the very same passage " * 3 + "that all of them share, word for word, from end to end. "
              f"{r.integers(1 << 60)}" * int(r.integers(1, 4)) for _ in range(120)]
    docs = cases.documents(spark, values).repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 25)
    try:
        for group_rows in (2048, 20):
            assert got(repeats.repeat_report(docs, group_rows=group_rows)) == brute([(x.doc_id, x.text) for x in docs.collect()], 100)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_texts_under_one_id(spark):
    """Two texts under one id are two documents; which is earlier goes by text hash, so only the totals are fixed."""
    r = random.Random(4)
    p = "".join(r.choice("abcdefgh ") for _ in range(300))
    docs = spark.createDataFrame([(1, p + "x"), (1, p + "y"), (2, p)], "doc_id long, text string")
    rows = repeats.repeat_report(docs).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(1, 0), (1, 300), (2, 300)]


def test_removed_text(spark):
    r = random.Random(5)
    p = "".join(r.choice("abcdefgh ") for _ in range(150))
    docs = spark.createDataFrame([(1, "A" + p + "B"), (2, "C" + p + "D"), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    assert rows[1].text == "A" + p + "B" and rows[2].text == "CD" and rows[3].text == ""
    assert [(s.start, s.end) for s in rows[2].spans] == [(1, 151)]


def test_empty_table(spark):
    assert repeats.repeat_report(cases.empty(spark)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=12), st.text("ab", max_size=6)), min_size=2, max_size=14), st.integers(2, 8),
       st.randoms())
def test_folded_scan_marks_the_same_bytes(pairs, least, r):
    pairs = sorted(pairs, key=lambda x: x[0].encode())
    right, left = [x[0].encode() for x in pairs], [x[1].encode() for x in pairs]
    place = list(range(len(pairs)))
    r.shuffle(place)

    def covered(groups):
        out = [set() for _ in pairs]
        for b, a, members in groups:
            first = min(members, key=place.__getitem__)
            for m in members:
                if m != first:
                    out[m].update(range(-b, a))
        return out

    assert covered(repeats.repeat_groups(right, left, least, place)) == covered(repeats.repeat_groups(right, left, least))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", max_size=30), min_size=2, max_size=12), st.integers(2, 8))
def test_repeat_groups_are_all_maximal_repeats(texts, least):
    """Members: (left, right) around one anchor; every pair's longest common stretch is in a group."""
    r = random.Random(len(texts))
    rows = sorted(((t, "".join(r.choice("ab") for _ in range(r.randint(0, 6)))) for t in texts), key=lambda x: x[0].encode())
    right, left = [x[0].encode() for x in rows], [x[1].encode() for x in rows]
    groups = list(repeats.repeat_groups(right, left, least))
    for back, ahead, members in groups:
        assert back + ahead >= least and len(members) > 1
        assert len({(left[m][:back], right[m][:ahead]) for m in members}) == 1
        assert all(len(left[m]) >= back and len(right[m]) >= ahead for m in members)
        # maximal to the right and, among its members, to the left
        assert len({left[m][back:back + 1] or m for m in members}) > 1
    for i in range(len(rows)):
        for j in range(i):
            a, b = repeats._common(right[i], right[j]), repeats._common(left[i], left[j])
            if a + b >= least and a >= max(1, least - max(map(len, left))):
                assert any(i in m and j in m and x >= b and y >= a for x, y, m in groups)


def test_very_long_text_in_pieces(monkeypatch):
    r = random.Random(9)
    raw = np.frombuffer("".join(r.choice("abcde ") for _ in range(30_000)).encode(), np.uint8)
    off = np.array([0, len(raw)])
    whole = repeats._batch_anchors(raw, off, 100, 32)
    monkeypatch.setattr(repeats, "_PIECE", 1000)
    pieces = repeats._batch_anchors(raw, off, 100, 32)
    assert all(np.array_equal(a, b) for a, b in zip(whole, pieces))


def test_many_null_ids_are_told_apart(spark):
    """Different texts under one id are keyed by all 64 bits of their hash; equal low bits are no longer one text."""
    texts = [f"text number {i} with nothing that repeats over a hundred bytes" for i in range(3000)]
    shared = "a passage of more than one hundred bytes that stands in two texts without an id, word for word, and goes on " * 2
    texts += [shared + "one", "two " + shared]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(4)
    got = repeats.repeat_report(docs).collect()
    kept = Counter(r.kept_sha256 for r in got)
    whole = Counter(hashlib.sha256(t.encode()).hexdigest() for t in texts[:3000])
    assert len(got) == 3002 and not whole - kept and sum(r.n_removed > 0 for r in got) >= 1
    keys = repeats.repeat_runs(docs).select("doc", "tie").distinct().count()
    assert keys == len(set(texts))
