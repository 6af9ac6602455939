"""The code_tree source, lenient decoding and edge rows."""

import hashlib
import os
import random
import tempfile

from pyspark.sql import functions as F

from codesieve.functions import text as tx
from codesieve.operators import feedback as fb
from codesieve.operators import select as sel
from codesieve.sources import snapshots as snap
from codesieve.sources.tree import CodeTreeDataSource


def _write(root, rel, data: bytes):
    full = os.path.join(root, rel)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as f:
        f.write(data)


def test_code_tree_reads_hidden_and_underscore_files(spark):
    root = tempfile.mkdtemp(prefix="codesieve-tree-")
    _write(root, "acme__one/pkg/__init__.py", b"import os\n")
    _write(root, "acme__one/_priv/c.py", b"x = 1\r\ny = 2\r")
    _write(root, "acme__one/.github/w.py", b"a\n")
    _write(root, "acme__one/.git/HEAD", b"ref\n")
    _write(root, "acme__one/a b#c.txt", b"x\r\ny\xff\n\xef\xbf\xbd")
    _write(root, "solo/main.go", b"package main\n")
    spark.dataSource.register(CodeTreeDataSource)
    df = (spark.read.format("code_tree").option("path", root).option("snapshot_id", "s1")
          .option("url_prefix", "https://github.com/").load())
    rows = {(r.repo_url, r.path): r.content for r in df.collect()}
    assert ("https://github.com/acme/one", "pkg/__init__.py") in rows
    assert rows[("https://github.com/acme/one", "_priv/c.py")] == "x = 1\ny = 2\n"
    assert ("https://github.com/acme/one", ".github/w.py") in rows
    assert not any(p.startswith(".git/") for _, p in rows)
    assert rows[("https://github.com/acme/one", "a b#c.txt")] == "x\ny\n�"
    assert ("https://github.com/solo", "main.go") in rows
    blobs = {r.path: r.blob_sha for r in df.collect()}
    # git blob id of the raw bytes ("git hash-object")
    assert blobs["main.go"] == hashlib.sha1(b"blob 13\0package main\n").hexdigest()
    code = {r.path for r in snap.code_files(df).collect()}
    assert code == {"pkg/__init__.py", "_priv/c.py", "a b#c.txt", "main.go"}


def test_decode_text_drops_invalid_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"x\r\ny\xff\n"),), (None,)], "raw binary")
    got = [r[0] for r in df.select(snap.decode_text("raw")).collect()]
    assert got == ["x\ny\n", None]


def test_decode_text_is_python_free_and_like_python(spark):
    r = random.Random(5)
    parts = [b"\xff", b"\xe2", b"\x82", b"\xac", b"\xed", b"\xa0", b"\x80", b"\xf0", b"\x9f", b"\xf4", b"\x90", b"\xc0", b"\xe0", b"\xc3",
             b"\xef", b"\xbf", b"\xbd", b"a", b"0", b"1", b"\n", b"\r", b"\x1a", b"\0", "\ufffd".encode(), "\u00e9\U0001f600".encode()]
    rows = [(None,), *((bytearray(b"".join(r.choices(parts, k=r.randint(0, 12)))),) for _ in range(5000))]
    out = spark.createDataFrame(rows, "raw binary").select("raw", snap.decode_text("raw").alias("t"))
    # whole batches of texts in Python workers grew with the files
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for x in out.collect():
        want = None if x.raw is None else bytes(x.raw).decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")
        assert x.t == want


def test_edge_rows(spark):
    big = "a" * (1 << 20)
    rows = [
        ("e/null.py", None),
        ("e/big.py", big),
        ("e/naive.py", "def naïve(x):\n    return naïve(x)\n"),
        ("e/arrow.js", "const f = (a\x85b) => 1\n"),
        ("e/crlf.py", "import a\r\nb\r\n"),
    ]
    df = spark.createDataFrame(rows, "path string, content string")
    ok, bad = sel.split_rejects(df)
    assert [r.path for r in bad.collect()] == ["e/null.py"]
    out = {r.path: r for r in ok.select("path", tx.function_names("content").alias("n"),
                                        tx.has_recursion("content").alias("rec"),
                                        tx.line_count("content").alias("lines")).collect()}
    assert list(out["e/naive.py"].n) == ["naïve"] and out["e/naive.py"].rec
    assert list(out["e/arrow.js"].n) == ["f"]
    assert out["e/big.py"].lines == 1
    assert out["e/crlf.py"].lines == 2
    reviewed = fb.review_files(ok, keys=[]).collect()
    assert len(reviewed) == 4


def test_reply_with_null_class_is_development(spark):
    df = spark.createDataFrame([('x {"classification": null, "feedback": "fine"} y',),
                                ('{"classification": "DSA-ish", "feedback": 3}',), ("no json",)], "reply string")
    got = [(r.usable, r.reply_classification, r.reply_feedback) for r in fb.parse_replies(df).collect()]
    assert got == [(True, "development", "fine"), (True, "DSA", "3"), (False, None, None)]


def test_replies_read_as_a_json_parser_reads_them(spark):
    """Against the json module: repeated keys, nulls, and everything that is not one whole object."""
    import json
    import re

    replies = ['{"classification": "a", "classification": " Dsa", "feedback": "x", "feedback": " y "}',
               '{"feedback": "x", "feedback": null}', '{"feedback": null, "feedback": "x"}', '{"classification": "dsa", "classification": null}',
               '{"a": 1} and {"feedback": "b"}', '{"a": 1}, {"feedback": "b"}', '{"a": 1}}', "{'feedback': 'x'}", '{"feedback": "a\nb"}',
               '{"feedback": "a\tb"}', '{"feedback": "a\\nb \\u0041 \\ud83d\\ude00"}', '{"feedback": "x",}', '{"feedback": 01}', "{}", '{"x": {bad}}',
               '{"feedback": "x", "n": [1, {"feedback": "inner"}]}', '{"n": {"feedback": "inner"}}', '{"feedback" "x"}', '{"feedback": "x" /* c */}',
               "```json\n{\n \"classification\": \"DSA\",\n \"feedback\": \"ok\"\n}\n```", '{"feedback": tru}', "", None, "{", "}{",
               '{"feedback": "\x85 x\u2003"}', '{"Feedback": "case"}', '{"feedback": "{"}', 'a } b { "feedback": "x" }']
    rows = spark.createDataFrame([(i, t, "z") for i, t in enumerate(replies)], "i int, reply string, usable_ string").repartition(2)
    got = {r.i: (r.usable, r.reply_classification, r.reply_feedback) for r in fb.parse_replies(rows).collect()}
    for i, t in enumerate(replies):
        m = re.search(r"\{[\s\S]*\}", t or "")
        try:
            data = json.loads(m.group(0))
        except (ValueError, AttributeError):
            assert got[i] == (False, None, None), t
            continue
        label = "DSA" if str(data.get("classification", "development")).strip().lower().startswith("dsa") else "development"
        assert got[i] == (True, label, str(data.get("feedback", "")).strip()), t


def test_repo_without_code_files_and_deleted_file_in_cap(spark):
    head = spark.createDataFrame([("r1", "a.bin", "x"), ("r2", "a.py", "1"), ("r2", "c.py", "3")],
                                 "repo_url string, path string, content string")
    changed = spark.createDataFrame([("r2", "b.py", "D"), ("r2", "c.py", "M")],
                                    "repo_url string, path string, status string")
    runs = spark.createDataFrame([("r1", "full"), ("r2", "recent")], "repo_url string, mode string")
    s = sel.select_files(head, changed, runs=runs, max_files=1)
    assert {(r.repo_url, r.path) for r in s.collect()} == {("r2", "b.py")}
    assert sel.existing_only(s, head).count() == 0
    s2 = sel.select_files(head, changed, runs=runs, max_files=2)
    assert {r.path for r in sel.existing_only(s2, head).collect()} == {"c.py"}
    assert s2.where(F.col("repo_url") == "r1").count() == 0


def test_negative_caps_are_rejected(spark):
    import pytest

    head = spark.createDataFrame([("r", "a.py", "x")], "repo_url string, path string, content string")
    changed = spark.createDataFrame([], "repo_url string, path string, status string")
    with pytest.raises(ValueError):
        sel.select_files(head, changed, mode="full", max_files=-1)
    with pytest.raises(ValueError):
        sel.cap_files(head, -3)


def test_mode_normalisation(spark):
    head = spark.createDataFrame([("r", f"f{i:02d}.py", "x") for i in range(15)] + [("r", "z.md", "y")],
                                 "repo_url string, path string, content string")
    changed = spark.createDataFrame([], "repo_url string, path string, status string")
    for mode, n in [(None, 16), ("", 16), ("FULL", 16), ("Recent", 10), ("smart", 15), ("weird", 16)]:
        runs = spark.createDataFrame([("r", mode)], "repo_url string, mode string")
        assert sel.select_files(head, changed, runs=runs).count() == n, mode
