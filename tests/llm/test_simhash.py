import re
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from codesieve.llm import simhash
from codesieve.llm.components import components
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, max_bits=3):
    """Group label (smallest position) of each fingerprint, by comparing all pairs."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(i):
                if bin(prints[i] ^ prints[j]).count("1") <= max_bits and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_matches_brute_force(spark):
    docs = cases.documents(spark, cases.texts(5))
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_print(r.text) for r in rows]
    label = groups(prints)
    low = {}
    for r, k in zip(rows, label):
        if r.doc_id is not None:
            low[k] = min(low.get(k, r.doc_id), r.doc_id)
    want = Counter((r.doc_id, f"{p:016x}", low.get(k)) for r, p, k in zip(rows, prints, label))
    got = simhash.simhash_groups(docs).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(low.get(k) for k in set(label))


def test_empty_table(spark):
    assert simhash.simhash_groups(cases.empty(spark)).count() == 0
    assert simhash.keep_one(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("block_rows", [1024, 40])
def test_links_find_every_close_pair(spark, block_rows):
    """A dense cloud around one fingerprint plus random ones; small blocks force the split of a hot key."""
    r = np.random.default_rng(7)
    x = {int(v) for v in r.integers(0, 1 << 63, 300)}
    centre = int(r.integers(0, 1 << 63))
    for _ in range(500):
        v = centre
        for b in r.integers(0, 63, r.integers(0, 7)):
            v ^= 1 << int(b)
        x.add(v)
    x = sorted(x)
    df = spark.createDataFrame([(v,) for v in x], "fp long").repartition(5)
    got = {r.node: r.component for r in components(simhash.fingerprint_links(df, block_rows=block_rows)).collect()}
    label = groups(x)
    assert {v: x[k] for v, k in zip(x, label)} == {v: got.get(v, v) for v in x}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(1, 300)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    df = spark.createDataFrame(chain + star + [(5, 5)], "a long, b long").repartition(7)
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{i: 1 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(300)}}
