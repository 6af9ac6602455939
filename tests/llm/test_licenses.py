import random
import re
from collections import Counter

import pytest

from codesieve.llm import licenses
from tests.llm import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    at, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        at += hits
        if hits:
            labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_matches_brute_force(spark):
    values = cases.texts(4) + ["Under THE mit-license under the MIT License.", "cc by nc cc BY-NC cc by", "x apache license, version 2.0",
                               "under the mit licensed", "éunder the mit license"] * 2
    docs = cases.documents(spark, values)
    want = Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
    rows = licenses.scan_licenses(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_empty_table(spark):
    assert licenses.scan_licenses(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("text,postfix", [
    ("MIT OR Apache-2.0", ["mit", "apache-2.0", "or"]),
    ("MIT OR GPL-2.0 AND BSD", ["mit", "gpl-2.0", "bsd", "and", "or"]),
    ("(MIT OR GPL-2.0) AND BSD", ["mit", "gpl-2.0", "or", "bsd", "and"]),
    ("GPL-2.0 WITH classpath AND MIT", ["gpl-2.0", "classpath", "with", "mit", "and"]),
    ("MIT and then words", ["mit", "then", "and"]),
    ("MIT (c) someone", ["mit"]),
    ("(MIT", None), ("OR MIT", None), ("", None), ("MIT OR", None), ("()", None),
])
def test_shunting_yard(text, postfix):
    assert licenses.parse_expression(text) == postfix


def tree(text):
    return licenses.evaluate(licenses.parse_expression(text))


def test_choices():
    got = tree("(MIT OR GPL-2.0 WITH cp) AND BSD")
    assert got.names() == {"mit", "gpl-2.0-with-cp", "bsd"}
    assert set(got.choices()) == {frozenset({"mit", "bsd"}), frozenset({"gpl-2.0-with-cp", "bsd"})}
    assert tree("(c and c) or b").expression() == "b or c"
    assert got.expression() == "bsd and (gpl-2.0-with-cp or mit)" and got.required == {"bsd"}


def test_all_choices_of_seven_two_way_ones():
    got = tree(" and ".join(f"(a{i} or b{i})" for i in range(7)))
    assert len(set(got.choices())) == 128 and got.required == set() and len(got.names()) == 14


def brute_choices(postfix):
    """Sets of names by plain multiplication."""
    stack = []
    for token in postfix:
        if token in ("or", "and", "with"):
            b, a = stack.pop(), stack.pop()
            if token == "or":
                stack.append(a | b)
            elif token == "and":
                stack.append({x | y for x in a for y in b})
            else:
                exception = "+".join(sorted(frozenset().union(*b)))
                stack.append({frozenset(f"{x}-with-{exception}" for x in one) for one in a})
        else:
            stack.append({frozenset([token])})
    return stack[-1]


def test_random_expressions_match_brute_force():
    r = random.Random(5)

    def make(depth):
        if depth == 0 or r.random() < 0.3:
            return r.choice("abcdefg")
        parts = [make(depth - 1) for _ in range(r.randint(2, 3))]
        return "(" + f" {r.choice(['and', 'or', 'or', 'with'])} ".join(parts) + ")"

    for _ in range(400):
        text = make(3)
        want = brute_choices(licenses.parse_expression(text))
        got = tree(text)
        assert set(got.choices()) == want, text
        assert got.names() == frozenset().union(*want) and got.required == frozenset.intersection(*want), text
        again = licenses.evaluate(licenses.parse_expression(got.expression()))  # the same choices when read again
        assert set(again.choices()) == want, (text, got.expression())


def test_deep_and_long_expressions_in_linear_time():
    deep = "".join(f"(l{i} {'and' if i % 2 else 'or'} " for i in range(50_000)) + "last" + ")" * 50_000
    got = tree(deep)
    assert len(got.names()) == 50_001 and len(got.expression()) >= 300_000


def test_tag_in_text():
    auto = licenses.build_automaton()
    row = licenses.scan_text(b"/* SPDX-License-Identifier: (MIT OR Apache-2.0) */ code", auto)
    assert row[5:] == ("apache-2.0,mit", 1.0, "apache-2.0 or mit", "")
    two = licenses.scan_text(b"SPDX-License-Identifier: MIT\nSPDX-License-Identifier: BSD and (MIT or X)\n", auto)
    assert two[5:] == ("bsd,mit,x", 1.0, "bsd and (mit or x); mit", "bsd,mit")


def test_long_expression_is_read_whole():
    auto = licenses.build_automaton()
    names = [f"licence-{i}" for i in range(400)]
    for text in (f"({' OR '.join(names)}) AND last", " AND ".join([*names, "last"])):
        row = licenses.scan_text(f"// SPDX-License-Identifier: {text}\ncode".encode(), auto)
        assert len(text) > 5000 and set(row[5].split(",")) == {*names, "last"} and row[6] == 1.0
