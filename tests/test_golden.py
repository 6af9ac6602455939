"""Golden vectors for the rule operators (one small file per case)."""

import pytest
from pyspark.sql import functions as F

from codesieve.functions import text as tx
from codesieve.functions import urls
from codesieve.operators import feedback as fb

# path, content, class, topic (None for development), ext, lines, names, loops, nested, recursive, variant
GOLDEN = [
    ("algo/bs.py", "def search(a, t):\n    low = 0\n    high = len(a) - 1\n    return search(a, t)\n",
     "DSA", "Binary Search", ".py", 4, ["search"], 0, False, True, 1),
    ("src/a.py", "import os\nprint(os.getcwd())\n", "development", None, ".py", 2, [], 0, False, False, 1),
    ("web/app.js", "import x from 'y'\nconst go = (a) => { for (;;) { for (;;) {} } }\n",
     "development", None, ".js", 2, ["go"], 2, True, False, 1),
    ("src/calc.ts", "import z\nfunction add(p) { return p }\n", "development", None, ".ts", 2, ["add"], 0, False,
     False, 0),
    ("lib/perm.go", "// backtracking\nfunc perm() { for i := range s { choose(i) } }\n",
     "DSA", "Backtracking", ".go", 2, [], 1, False, False, 1),
    ("x/one.py", "", "DSA", "General DSA", ".py", 0, [], 0, False, False, 0),
    ("x/y.py", "x = 1\n", "DSA", "General DSA", ".py", 1, [], 0, False, False, 1),
    ("docs/readme.md", "All about trees", "DSA", "Linked List", ".md", 1, [], 0, False, False, 1),
    ("lib/util.go", 'package util\nimport "fmt"\nfunc Max() {}\n', "development", None, ".go", 3, [], 0, False,
     False, 0),
    ("src/main.c", "int main() { for (int i=0;i<n;i++) { x(); } }\n", "DSA", "Two Pointers", ".c", 1, [], 1,
     False, False, 0),
    ("src/many.py", "def d1(): pass\ndef d2(): pass\ndef d1(): pass\ndef d3(): d1()\ndef d4(): pass\n",
     "DSA", "General DSA", ".py", 5, ["d1", "d2", "d3"], 0, False, True, 1),
    ("src/hash.rs", "use std;\nfn f() { format!(x) }\n", "DSA", "Hashing", ".rs", 2, [], 0, False, False, 0),
    (".py", "import a\n", "development", None, "", 1, [], 0, False, False, 1),
    ("B.PY", "import a\n", "development", None, ".PY", 1, [], 0, False, False, 0),
    ("src/sub.py", "import q\ndef foo(): pass\ny = foofoo (1)\n", "development", None, ".py", 3, ["foo"], 0,
     False, False, 0),
]


@pytest.fixture(scope="module")
def golden_rows(spark):
    df = spark.createDataFrame([(g[0], g[1]) for g in GOLDEN], "path string, content string")
    out = df.select(
        "path",
        F.when(tx.is_dsa("path", "content"), "DSA").otherwise("development").alias("cls"),
        tx.detect_topic("path", "content").alias("topic"),
        tx.file_extension("path").alias("ext"),
        tx.line_count("content").alias("lines"),
        tx.function_names("content").alias("names"),
        tx.loop_count("content").alias("loops"),
        tx.has_nested_loops("content").alias("nested"),
        tx.has_recursion("content").alias("rec"),
        F.pmod(tx.variant_seed("path"), F.lit(2)).alias("variant"),
    )
    return {r["path"]: r for r in out.collect()}


@pytest.mark.parametrize("case", GOLDEN, ids=[g[0] for g in GOLDEN])
def test_golden(golden_rows, case):
    path, _, cls, topic, ext, lines, names, loops, nested, rec, variant = case
    r = golden_rows[path]
    assert r["cls"] == cls
    if topic is not None:
        assert r["topic"] == topic
    assert r["ext"] == ext
    assert r["lines"] == lines
    assert list(r["names"]) == names
    assert r["loops"] == loops
    assert r["nested"] == nested
    assert r["rec"] == rec
    assert r["variant"] == variant


def test_extensions_and_lines(spark):
    exts = {"a/b.py": ".py", ".py": "", "a.b/c": "", "x.": ".", "..a.b": ".b", "a.tar.gz": ".gz"}
    df = spark.createDataFrame([(k,) for k in exts], "p string")
    got = {r[0]: r[1] for r in df.select("p", tx.file_extension("p")).collect()}
    assert got == exts
    lines = {"": 0, "a": 1, "a\n": 1, "a\n\nb": 3, "\n": 1, "a\r\nb\rc\x0bd\x1ce f": 6}
    df = spark.createDataFrame([(k,) for k in lines], "c string")
    got = {r[0]: r[1] for r in df.select("c", tx.line_count("c")).collect()}
    assert got == lines


def test_urls(spark):
    cases = {
        "https://github.com/o/r.git": ("o", "r"),
        "git@github.com:o/r.git": ("git@github.com:o", "r"),
        "https://github.com/o": (None, None),
        "https://tok@github.com/o/r/tree/main?x=1#f": ("o", "r"),
        "https://github.com//o/r/": ("o", "r"),
        "https://github.com/o/r;p": ("o", "r"),
        "  https://github.com/o/r.git.git": ("o", "r.git"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    got = {r[0]: (r[1], r[2]) for r in df.select("u", urls.parse_repo_url("u").alias("p"))
           .select("u", "p.owner", "p.name").collect()}
    assert got == cases


def test_feedback_text_shapes(spark):
    df = spark.createDataFrame([("algo/bs.py", GOLDEN[0][1], "k"), ("web/app.js", GOLDEN[2][1], "k"),
                                ("src/a.py", GOLDEN[1][1], "k"), ("src/many.py", GOLDEN[10][1], "k")],
                               "path string, content string, key string")
    rows = {r["path"]: r for r in fb.review_files(df, keys=["key"]).collect()}
    bs = rows["algo/bs.py"]["feedback"].split("\n")
    assert bs[0] == "# DSA Review (Binary Search)"
    assert bs[1] == "# Complexity hints: uses recursion (watch stack depth)"
    assert bs[2].startswith("# Easy: ") and bs[3].startswith("# Medium: ") and bs[4].startswith("# Hard: ")
    assert bs[5] == "" and len(bs) == 6
    js = rows["web/app.js"]["feedback"].split("\n")
    assert js[0] == "// Development Review" and len(js) == 8 and all(x.startswith("// - ") for x in js[1:7])
    py = rows["src/a.py"]["feedback"].split("\n")
    assert py[0] == "# Development Review" and len(py) == 7 and all(x.startswith("# - ") for x in py[1:6])
    assert py[1:4] == [x.replace("//", "#", 1) for x in js[1:4]] and py[4] not in js  # three notes are common to both
    many = rows["src/many.py"]["feedback"]
    assert "(e.g., d1, d2, d3)" in many and "{functions}" not in many
