import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codesieve.llm import mixing
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes: dict, pattern, share, cap):
    """Iterated resharing, as the contract words it."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: pattern[i % len(pattern)] for i, s in enumerate(order)}
    target, free, rest = {}, set(order), share * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if rest * w[s] / total > cap * sizes[s]}
        if not over:
            target |= {s: rest * w[s] / total for s in free}
            break
        for s in over:
            target[s] = cap * sizes[s]
        rest -= sum(target[s] for s in over)
        free -= over
    return target


def brute_schedule(words, block, step):
    """Slots of each source, read off the points one by one."""
    order = sorted((s for s in words if s is not None and words[s])) + ([None] if words.get(None) else [])
    total = sum(words.values())
    n = -(-total // block)
    slots = defaultdict(list)
    for i in range(n):
        at = math.floor(i * step % 2**32 / 2**32 * total)
        for s in order:
            if at < words[s]:
                slots[s].append(i)
                break
            at -= words[s]
    for j, s in enumerate(s for s in order if not slots[s]):
        slots[s].append(n + j)
    return slots


def brute(rows, block, step=mixing.GOLDEN, pattern=(3, 1, 2), share=1.5, cap=2.0):
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    by = defaultdict(list)
    for i, (d, _, s) in enumerate(rows):
        by[s].append(i)
    sizes = {s: sum(size[i] for i in members) for s, members in by.items()}
    target = brute_targets(sizes, pattern, share, cap)
    slots = brute_schedule({s: math.floor(t) for s, t in target.items()}, block, step)
    out = []
    for s, members in by.items():
        def place(i):
            d = rows[i][0]
            return hashlib.md5(f"mix:{'' if d is None else d}".encode()).hexdigest()[:16], d is not None, d or 0, size[i]
        at, words = 0, min(len(slots[s]) * block, math.floor(target[s]))
        for i in sorted(members, key=place):
            taken = sum(max(0, min(at + e * sizes[s] + size[i], words) - at - e * sizes[s]) for e in (0, 1))
            first = slots[s][at // block] if size[i] and at < words else None
            out.append((rows[i][0], size[i], sizes[s], round(target[s], 6), taken, first))
            at += size[i]
    return Counter(out)


def answer(rows):
    return Counter((r.id, r.size, r.source_size, round(r.target, 6), r.taken, r.first_slots[0] if r.first_slots else None)
                   for r in rows)


@pytest.mark.parametrize("block_words,step", [(16, mixing.GOLDEN), (7, mixing.GOLDEN), (16, 1), (16, 1 << 31)])
def test_matches_brute_force(spark, block_words, step):
    docs = cases.documents(spark, cases.texts(11))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    placed, plan = mixing.mix(docs, block_words=block_words, step=step)
    got = mixing.taken_words(placed, plan).collect()
    assert answer(got) == brute(rows, block_words, step)
    assert all(r.taken <= 2 * r.size for r in got)
    blocks = plan.groupBy("source", "slot").agg({"to_word": "sum", "from_word": "sum"}).collect()
    per = defaultdict(list)
    for b in blocks:
        per[b["source"]].append((b["slot"], b["sum(to_word)"] - b["sum(from_word)"]))
    for v in per.values():  # whole blocks but for the last
        assert {n for _, n in sorted(v)[:-1]} <= {block_words}


def test_the_schedule_decides_and_meets_the_targets(spark):
    docs = cases.documents(spark, cases.texts(11))
    placed, plan = mixing.mix(docs)
    golden = mixing.taken_words(placed, plan).collect()
    by = defaultdict(list)
    for r in golden:
        by[r.source].append(r)
    for rows in by.values():
        assert 0 <= rows[0].target - sum(r.taken for r in rows) <= 4 * mixing.LEAST_BLOCK
    other = mixing.mix(docs, step=1)
    assert answer(golden) != answer(mixing.taken_words(*other).collect())


def test_block_size_follows_the_words(spark):
    def size(*targets):
        return mixing.block_size(spark.createDataFrame([("s", 1, float(t)) for t in targets], "source string, size long, target double"))
    assert (size(0), size(1e6), size(5e7, 5e7), size(1e13)) == (16, 16, 95, 1024)


def test_every_stretch_is_near_the_weights(spark):
    targets = spark.createDataFrame([("a", 10**6, 3e6), ("b", 10**6, 1e6), (None, 10**6, 2e6)],
                                    "source string, size long, target double")
    slots = sorted(mixing.schedule(targets, 1000).collect(), key=lambda r: r.slot)
    assert len(slots) == 6000
    for n in (60, 600, 3000, 6000):
        seen = Counter(r.source for r in slots[:n])
        for s, part in (("a", 1 / 2), ("b", 1 / 6), (None, 1 / 3)):
            assert abs(seen[s] - n * part) <= 3
    for s in ("a", "b", None):
        assert [r["rank"] for r in slots if r.source == s] == list(range(sum(r.source == s for r in slots)))


def test_tiny_source_gets_its_words(spark):
    docs = cases.documents(spark, ["w " * 30_000, "w " * 3], repeat=False)
    placed, plan = mixing.mix(docs)
    rows = {r.id: r for r in mixing.taken_words(placed, plan).collect()}
    assert rows[1].taken == math.floor(rows[1].target) > 0 and rows[1].first_slots[0] is not None


def test_whole_documents(spark):
    docs = cases.documents(spark, cases.texts(12))
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    placed, plan = mixing.mix(docs)
    want = Counter()
    for key, group in _by_key(mixing.taken_words(placed, plan).collect()).items():
        if key[2]:
            want[key[0]] += len(group) * math.floor(sum(r.taken for r in group) / sum(r.size for r in group) + 0.5)
    assert Counter(r.doc_id for r in out.collect()) == +want


def test_copies_carry_their_slots(spark):
    docs = cases.documents(spark, cases.texts(12), repeat=False)
    out = mixing.mix_documents(docs, slot_col="slot")
    assert out.columns == [*docs.columns, "slot"]
    plan = mixing.mix(docs)[1]
    first = {(r["id"], r["round"]): r["slot"] for r in plan.groupBy("id", "round").agg(F.min("slot").alias("slot")).collect()}
    by = defaultdict(list)
    for r in out.collect():
        by[r.doc_id].append(r.slot)
    assert by and all(sorted(v) == [first[d, k] for k in range(len(v))] for d, v in by.items())


def _by_key(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.id, r.source, r.size].append(r)
    return by


@pytest.mark.parametrize("values", [[], [None, "", "\n"]])
def test_nothing_to_mix(spark, values):
    docs = cases.documents(spark, values, repeat=False)
    placed, plan = mixing.mix(docs)
    rows = mixing.taken_words(placed, plan).collect()
    assert len(rows) == len(values) and all(r.taken == 0 and r.target == 0 for r in rows)
    assert plan.count() == 0 and mixing.mix_documents(docs).count() == 0
