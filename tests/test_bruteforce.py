"""Properties and hand-computed vectors of the text rules, on generated text."""

import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codesieve import rules
from codesieve.functions import text as tx
from codesieve.operators import feedback as fb

PLAIN = st.text(alphabet=st.sampled_from(list("xyzw \n\t.,;:0123")), max_size=60)
PIECE = st.sampled_from(["const a = (", "const b=(x", "const cc = (p, q", ") =>", ")  =>", " 1\n", "\n", " y ", "=>", "const  d\n= (", ")\n=> 2",
                         "function f1", "def g(", "é", "const const = ("])


def _frame(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


@settings(max_examples=25, deadline=None)
@given(st.lists(PLAIN, min_size=1, max_size=10), st.sampled_from(rules.DSA_HINTS))
def test_a_hint_word_makes_a_file_dsa(spark, texts, hint):
    long = "import a\n" * rules.SHORT_FILE_LINES
    rows = [("p", long + t) for t in texts] + [("p", long + t + hint.upper()) for t in texts] + [(hint, long + t) for t in texts]
    got = [r[0] for r in _frame(spark, rows).select(tx.is_dsa("path", "content")).collect()]
    n = len(texts)
    assert got == [False] * n + [True] * 2 * n


def test_short_files_without_imports_are_dsa(spark):
    n = rules.SHORT_FILE_LINES
    rows = [("p", "x\n" * (n - 1)), ("p", "x\n" * n), ("p", "x\n" * (n - 1) + "x"), ("p", "Import x"), ("p", "REQUIRE(x)"), ("import", "x")]
    assert [r[0] for r in _frame(spark, rows).select(tx.is_dsa("path", "content")).collect()] == [True, False, False, False, False, True]


def test_the_higher_topic_wins(spark):
    """A text with one key of each of two topics gets the one that is listed first."""
    lone = {}  # a key of each topic that holds no key of an earlier topic
    for i, (name, keys) in enumerate(rules.TOPIC_RULES):
        for k in keys:
            if not any(e in k.lower() for _, earlier in rules.TOPIC_RULES[:i] for e in earlier) and k == k.lower():
                lone[name] = k
                break
    names = [n for n, _ in rules.TOPIC_RULES if n in lone]
    assert len(names) >= 12
    rows = [(f"{i}", f"{lone[b]} 0 {lone[a]}") for i, (a, b) in enumerate(zip(names, names[1:]))] + [("p", "0")]
    got = [r[0] for r in _frame(spark, rows).select(tx.detect_topic(F.lit(""), "content")).collect()]
    order = [n for n, _ in rules.TOPIC_RULES]
    assert got[-1] == rules.DEFAULT_TOPIC
    for g, a, b in zip(got, names, names[1:]):
        assert order.index(g) <= order.index(a)


@settings(max_examples=25, deadline=None)
@given(st.lists(PLAIN, min_size=1, max_size=12), st.integers(0, 5))
def test_lines_add_up(spark, texts, k):
    rows = [("p", t) for t in texts] + [("p", "a\r\nb\n" * k + t) for t in texts]
    got = [r[0] for r in _frame(spark, rows).select(tx.line_count("content")).collect()]
    assert [b - a for a, b in zip(got, got[len(texts):])] == [2 * k] * len(texts)
    assert got[:len(texts)] == [t.count("\n") + (t != "" and not t.endswith("\n")) for t in texts]


NAMES = [
    ("function one(){}\ndef two():\nconst three = (a) => a\nfunction four(){}", ["one", "four", "three"]),
    ("const a = (x\nconst b = (y) => 1", ["b"]),
    ("const a = (const b = (x) => 1", ["a"]),
    ("const a = (1) => 2; const a = (3) => 4; const b = () => 5", ["a", "b"]),
    ("const a =\n (x) => 1", ["a"]),
    ("const a = (x)\n=> 1", ["a"]),
    ("const a = (x) = > 1", []),
    ("const a = x => 1", []),
    ("const a = (x) => 1 const b = (", ["a"]),
    ("def f (x): f(x)", ["f"]),
    ("function  _x1 ()", ["_x1"]),
    ("x = 1", []),
    ("const const = (x) => 1", ["const"]),
    (") =>\nconst a = (\n) =>\nconst b = ( ) =>", ["b"]),
]


def test_function_names_by_hand(spark):
    got = [list(r[0]) for r in _frame(spark, [("p", c) for c, _ in NAMES]).select(tx.function_names("content")).collect()]
    assert got == [n for _, n in NAMES]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(PIECE, max_size=14).map("".join), min_size=1, max_size=20))
def test_cutting_lines_behind_their_last_arrow_changes_no_name(spark, texts):
    """The single-pass reading equals the pattern on the whole text; a repeated text adds no name."""
    pattern = "(?dU)" + rules.FN_NAME_PATTERNS[1]
    df = _frame(spark, [("p", t) for t in texts])
    got = df.select(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)).alias("whole"),
                    F.regexp_extract_all(tx._arrow_lines(F.col("content")), F.lit(pattern), F.lit(1)).alias("cut"),
                    tx.function_names("content").alias("once"),
                    tx.function_names(F.concat("content", F.lit("\n"), "content")).alias("twice")).collect()
    for r in got:
        assert r.whole == r.cut and set(r.once) <= set(r.twice)


def test_names_of_a_very_long_line(spark):
    rows = [("p", "const x = ( " * 90_000), ("p", "const x = (" + " " * 1_000_000), ("p", "const x" + "y" * 1_000_000),
            ("p", "const x = ( " * 90_000 + ") => 1")]
    df = _frame(spark, rows).cache()
    df.count()
    t0 = time.time()
    got = [list(r[0]) for r in df.select(tx.function_names("content")).collect()]
    assert got == [[], [], [], ["x"]] and time.time() - t0 < 10


def test_recursion_and_loops_by_hand(spark):
    rows = [("def go(x): return go(x - 1)", True, 0, False), ("def go(x): pass", False, 0, False),
            ("def go(x): pass\ngogo (1)", False, 0, False), ("def go(x): pass\ny = go (1)", True, 0, False),
            ("def f(x): pass", True, 0, False),  # the first f is that of def
            ("for a\nfor b", False, 2, False), ("for (;;) { for", False, 2, True),
            ("forx { for", False, 1, True), ("{ for for", False, 2, False)]
    got = _frame(spark, [("p", r[0]) for r in rows]).select(
        tx.has_recursion("content"), tx.loop_count("content"), tx.has_nested_loops("content")).collect()
    assert [tuple(g) for g in got] == [r[1:] for r in rows]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab \t\n\x0b\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2003\u2028\u3000\u200b\ufeff")),
                        max_size=12), min_size=1, max_size=20))
def test_strip_is_python_s(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert [r[0] for r in df.select(tx.strip_ws("s")).collect()] == [t.strip() for t in texts]


def test_one_reply_a_file(spark):
    files = _frame(spark, [(f"f{i}.py", "x = 1") for i in range(3)]).withColumn("repo_url", F.lit("r"))
    ok = '{{"classification": "dsa", "feedback": "{}"}}'
    replies = spark.createDataFrame([("r", "f0.py", 1, ok.format("first")), ("r", "f0.py", 3, ok.format("last")), ("r", "f0.py", 4, "{no"),
                                     ("r", "f0.py", 2, ok.format("second")), ("r", "f1.py", 1, ok.format("\\u001cok\\u001f"))],
                                    "repo_url string, path string, turn int, reply string")
    got = {r.path: (r.feedback, r.source) for r in
           fb.review_with_replies(files, replies, ["repo_url", "path"], order=["turn"]).collect()}
    assert len(got) == 3 and got["f0.py"] == ("last", "reply") and got["f1.py"] == ("ok", "reply") and got["f2.py"][1] == "rules"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("a/:.@;?#githo ")), max_size=30), min_size=1, max_size=20))
def test_url_parse_matches_urllib(spark, urls_in):
    from urllib.parse import urlparse

    from codesieve.functions import urls

    df = spark.createDataFrame([(u,) for u in urls_in], "u string")
    got = df.select("u", urls.parse_repo_url("u").alias("p")).select("u", "p.owner", "p.name").collect()
    for r in got:
        parts = urlparse(r["u"]).path.strip("/").split("/")
        want = (parts[0], parts[1].removesuffix(".git")) if len(parts) >= 2 else (None, None)
        assert (r["owner"], r["name"]) == want, r["u"]
