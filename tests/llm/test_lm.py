import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from codesieve.llm import lm
from codesieve.llm.common import word_hashes
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(lowered), None]


class Brute:
    """Counts of every order by their definition: raw ones at the highest order and after a begin mark, else words before."""

    def __init__(self, texts, order=2):
        self.order, self.c = order, Counter()
        raw = [Counter() for _ in range(order + 1)]
        for t in texts:
            seq = tokens(t)
            self.c.update(seq)
            marked = ["<s>", *seq]
            for k in range(2, order + 1):
                raw[k].update(tuple(marked[i:i + k]) for i in range(len(marked) - k + 1))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.counts = [Counter() for _ in range(order + 1)]
        for k in range(2, order + 1):
            before = Counter(g[1:] for g in raw[k + 1]) if k < order else {}
            self.counts[k] = Counter({g: n if k == order or g[0] == "<s>" else before[g] for g, n in raw[k].items()})
        self.pairs = raw[2]
        self.before = Counter(w for _, w in raw[2])
        self.total, self.kinds = Counter(), defaultdict(lambda: [0, 0, 0])
        for counts in self.counts:
            for g, n in counts.items():
                self.total[g[:-1]] += n
                self.kinds[g[:-1]][min(n, 3) - 1] += 1
        self.d = [[0, *lm.discounts([sum(n == k for n in counts.values()) for k in (1, 2, 3, 4)])] for counts in self.counts]
        self.dw = [0, *lm.discounts([sum(n == k for n in self.before.values()) for k in (1, 2, 3, 4)])]
        rest = sum(self.dw[min(n, 3)] for n in self.before.values())
        self.rest = rest / len(self.pairs) if self.pairs else 1.0

    def p(self, context, w):
        """context: a tuple of words, with one begin mark at most."""
        b = self.before[w]
        out = max(b - self.dw[min(b, 3)], 0) / max(len(self.pairs), 1) + self.rest / (self.v + 1)
        for k in range(2, min(len(context) + 1, self.order) + 1):
            h = tuple(context[len(context) - k + 1:])
            if self.total[h]:
                n, d = self.counts[k][(*h, w)], self.d[k]
                spread = sum(d[j + 1] * m for j, m in enumerate(self.kinds[h])) / self.total[h]
                out = max(n - d[min(n, 3)], 0) / self.total[h] + spread * out
        return out

    def score(self, text):
        seq = tokens(text)
        base = sum(math.log10((self.c[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in seq)
        marked = ["<s>", *seq]
        return len(seq), sum(self.c[w] > 0 for w in seq), base, sum(math.log10(self.p(marked[:i + 1], w)) for i, w in enumerate(seq))


@pytest.mark.parametrize("order,shard_bytes", [(3, 30_000_000), (2, 5_000), (3, 5_000), (4, 5_000)])
def test_matches_brute_force(spark, monkeypatch, order, shard_bytes):
    monkeypatch.setattr(lm, "_SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(lm, "_FLUSH", 500)
    docs = cases.documents(spark, cases.texts(16) + ["x" * 64, "x" * 65, "y" * 64 + "x" * 70, "X" * 200])
    rows = docs.select("doc_id", "text").collect()
    held = {d: zlib.crc32(str("" if d is None else d).encode()) % 10 == 0 for d, _ in rows}
    brute = Brute([t for d, t in rows if not held[d]], order)
    want = sorted((d is None, d or 0, held[d], *brute.score(t)[:2], brute.n, *brute.score(t)[2:]) for d, t in rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
                 for r in lm.held_out_scores(docs, order=order).collect())
    assert len(want) == len(got) and any(held.values())
    for w, g in zip(want, got):
        assert w[:6] == g[:6] and np.allclose(w[6:], g[6:], rtol=1e-9)


def test_probabilities_add_up():
    brute = Brute(cases.texts(17, 20), 3)
    seen = list(brute.counts[3])[::50]
    for u in [("<s>",), ("alpha",), ("w3", "alpha"), ("never", "seen"), *[g[:2] for g in seen]]:
        assert abs(sum(brute.p(u, w) for w in [*brute.c, "an unknown word"]) - 1) < 1e-9


def test_held_out_text_scores_better_than_its_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in lm.held_out_scores(docs).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert all(r.perplexity > 1 for r in rows)


def test_nothing_to_learn_from(spark):
    assert lm.held_out_scores(cases.empty(spark)).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    docs = spark.createDataFrame([(only, "some words")], "doc_id long, text string")
    r = lm.held_out_scores(docs).collect()[0]
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_folder_must_be_mounted():
    with pytest.raises(ValueError):
        lm._folder("hdfs://host/x")
    assert lm._folder("file:///a/b") == lm._folder("file:/a/b") == lm._folder("/a/b") == "/a/b"


def test_no_probability_is_zero(spark):
    """Counts whose plain estimate of a discount is 0 or less: contexts with frequent pairs only still leave something."""
    pairs = [(f"p{i} q{i}", 4) for i in range(300)] + [(f"r{i} s{i}", 2) for i in range(20)] + [("a1 b1", 1), ("a2 b2", 3)]
    texts = [t for t, n in pairs for _ in range(n)]
    held = [i for i in range(40_000, 40_400) if zlib.crc32(str(i).encode()) % 10 == 0]
    train = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 10][:len(texts)]
    rows = list(zip(train, texts)) + list(zip(held, ["a1 zzz", "a2 b3", "p1 q2", "s1 r1", ""]))
    got = {r.doc_id: r for r in lm.held_out_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    brute = Brute(texts, lm.ORDER)
    assert all(math.isfinite(r.score) and r.perplexity < 1e6 for r in got.values())
    assert all(np.isclose(got[i].score, brute.score(t)[3], rtol=1e-9) for i, t in rows[-5:])


def test_discounts_leave_and_take_something():
    r = np.random.default_rng(3)
    for _ in range(2000):
        n = [int(x) for x in r.integers(0, r.choice([2, 10, 1000]), 4)]
        assert all(0 < d < k for k, d in zip((1, 2, 3), lm.discounts(n)))


def test_random_counts_add_up_to_one():
    r = np.random.default_rng(4)
    for _ in range(30):
        texts = [" ".join(f"w{i}" for i in r.integers(0, 5, r.integers(1, 6))) for _ in range(r.integers(1, 8))] * int(r.integers(1, 5))
        brute = Brute(texts, 3)
        words = [*brute.c, "an unknown word"]
        for u in [("<s>",), *[(a, b) for a in words for b in words if a is not None and b is not None]]:
            ps = [brute.p(u, w) for w in words]
            assert min(ps) > 0 and abs(sum(ps) - 1) < 1e-9


def test_missing_model_files_are_an_error(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words {i % 7} and more") for i in range(60)], "doc_id long, text string")
    model = lm.train(docs, folder=str(tmp_path / "model"))
    assert lm.score(docs, model, ["doc_id"]).count() == 60
    moved = tmp_path / "moved"
    (tmp_path / "model").rename(moved)
    (tmp_path / "model").mkdir()  # a host that sees an empty folder, in a worker that has not mapped the files
    import dataclasses
    empty = dataclasses.replace(model, folder=str(tmp_path / "elsewhere"))
    (tmp_path / "elsewhere").mkdir()
    with pytest.raises(Exception, match="No such file"):
        lm.score(docs, empty, ["doc_id"]).collect()
    part = dataclasses.replace(model, folder=str(tmp_path / "part"))
    (tmp_path / "part").mkdir()
    (tmp_path / "part" / lm.MANIFEST).write_bytes((moved / lm.MANIFEST).read_bytes())
    with pytest.raises(Exception, match="No such file"):
        lm.score(docs, part, ["doc_id"]).collect()


def test_few_maps_are_kept(monkeypatch, tmp_path):
    monkeypatch.setattr(lm, "MAPS", 2)
    for i in range(5):
        lm._save(str(tmp_path / f"{i}"), [np.arange(3, dtype=np.uint8), np.zeros(0, np.uint64), np.arange(i, i + 9, dtype=np.uint64)])
        few, none, more = lm._mapped(str(tmp_path / f"{i}"))
        assert few.tolist() == [0, 1, 2] and not len(none) and more.tolist() == list(range(i, i + 9))
    assert len(lm._MAPPED) == 2


@pytest.mark.parametrize("order", [2, 3])
def test_split_words_and_high_counts(spark, monkeypatch, order):
    """A word that holds a third of all tokens lies in several shards, and counts beyond a byte are kept."""
    monkeypatch.setattr(lm, "_SHARD_BYTES", 4_000)
    r = np.random.default_rng(11)
    texts = [" ".join(w for i in r.integers(0, 60, 40) for w in ("the", f"w{i}", f"x{i % 7}")) for _ in range(60)]
    texts += ["again and again " * 200] * 3 + [None, ""] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = lm.train(docs, order=order)
    deal = lm._listed(model)[0]
    assert model.shards > 4 and len(deal.words) and deal.parts.max() > 1
    brute = Brute(texts, order)
    assert max(brute.counts[order].values()) > lm._TOP
    got = {x.doc_id: x.score for x in lm.score(docs, model, ["doc_id"]).collect()}
    assert all(np.isclose(got[i], brute.score(t)[3], rtol=1e-9) for i, t in enumerate(texts))


def test_higher_orders_fit_better(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sums = [sum(r.score for r in lm.held_out_scores(docs, order=k).filter("not held_out").collect()) for k in (2, 3)]
    assert sums[1] > sums[0]


def test_order_is_checked(spark):
    with pytest.raises(ValueError):
        lm.train(cases.empty(spark), order=1)


def test_a_word_counts_alike_beside_long_words(spark):
    """Words of more than 64 bytes in one part of the table leave the words of that part as they are elsewhere."""
    long = ["z" * 65, "q" * 64 + " " + "é" * 40, "x" * 1000]
    texts = [f"some words here w{i} and Eight8 by ninetynin {long[i % 3] if i < 20 else ''}" for i in range(60)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize([*enumerate(texts)], 3), "doc_id long, text string")
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(60)}
    assert {held[i] for i in range(20)} == {held[i] for i in range(20, 60)} == {True, False}
    brute = Brute([t for i, t in enumerate(texts) if not held[i]], lm.ORDER)
    for r in lm.held_out_scores(docs).collect():
        n, known, base, score = brute.score(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], n, known, brute.n)
        assert np.allclose([r.base_score, r.score], [base, score], rtol=1e-9)


def test_hash_of_a_word_is_its_own():
    words = [b"", b"a", b"\0", b"a\0", b"abcdefgh", b"abcdefgh\0", b"abcdefghi", b"x" * 64, b"x" * 65, b"x" * 128, b"x" * 129, b"y" + b"x" * 128]
    words += [bytes(r) for r in np.random.default_rng(7).integers(0, 256, (200, 21), np.uint8)]

    def hashes(some):
        off = np.cumsum([0, *map(len, some)])
        return word_hashes(np.frombuffer(b"".join(some), np.uint8), off[:-1], off[1:]).tolist()

    together = hashes(words[1:])
    assert len(set(together)) == len(together)
    assert together == [hashes([w])[0] for w in words[1:]] == hashes(words[:0:-1])[::-1]
