import re
from collections import Counter

from codesieve.llm import quality
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed)


def test_base_figures_match_brute_force(spark):
    values = cases.texts(3) + ["a b c d e f g h " * 5, "x # y | <z>\nx # y | <z>\n" * 12]
    docs = cases.documents(spark, values)
    got = quality.quality_report(docs).collect()
    want = Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                   for r in got) == want
    assert all(not (r.base_failed and r.kept) for r in got)


def test_empty_table(spark):
    assert quality.quality_report(cases.empty(spark)).count() == 0
    assert quality.keep_good(cases.empty(spark)).count() == 0


def test_line_rules():
    assert quality.line_fails(b"a | b | c | d | e") == "navigation"
    assert quality.line_fails(b"the### cat$$$ sat%%% on***") == "symbols"
    assert quality.line_fails(b"BUY NOW WHILE STOCKS LAST!!") == "shouting"
    assert quality.line_fails(b"so so so so so so so so much.") == "stutter"
    assert quality.line_fails(b"All rights reserved.") == "boilerplate"
    assert quality.line_fails(b"a title with no end") == "punctuation"
    assert quality.line_fails(b"A plain sentence.") is None


def test_lines_go_then_documents(spark):
    good = "A plain sentence with a good number of words in it, told once and told well by one who knows them all."
    junk = "home | about | news | help | more | jobs"
    docs = cases.documents(spark, [good + "\n" + junk, good, "\n".join([good] + [junk + f" {i} | x" for i in range(9)]), None],
                           repeat=False)
    kept = {r.doc_id: r.text for r in quality.keep_good(docs).collect()}
    assert kept == {0: good, 1: good}
    assert quality.keep_good(docs).columns == docs.columns


def test_clean_labelled_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.quality_report(docs).join(labels, "doc_id").filter("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.2 * len(bad)
