"""Edited renames: hand-made cases, and many small random repositories against comparing all pairs one by one."""

import random
import re
from collections import Counter, defaultdict

import pytest

from codesieve.sources import renames, snapshots

FILES = "repo_url string, path string, content string"


def chunks(text):
    text = text.replace("\r\n", "\n")
    bag = Counter()
    for piece in re.findall(r"[^\n]{0,63}\n|[^\n]{1,64}", text):
        bag[piece] += len(piece.encode())
    return bag


def score(a, b):
    x, y = chunks(a), chunks(b)
    size = max(sum(x.values()), sum(y.values()))
    return sum(min(n, y[c]) for c, n in x.items()) / size if size else 0.0


def plain_renames(base, head, similar=0.5, similar_name=0.75, limit=1000):
    """{(repo, old, new): score} by the rules, all pairs of each repository compared."""
    out = {}
    repos = {r for r, _, _ in base + head}
    for repo in repos:
        b = {p: c for r, p, c in base if r == repo}
        h = {p: c for r, p, c in head if r == repo}
        gone, come = sorted(set(b) - set(h)), sorted(set(h) - set(b))
        same = defaultdict(lambda: ([], []))
        for p in gone:
            same[b[p]][0].append(p)
        for p in come:
            same[h[p]][1].append(p)
        for content, (old, new) in same.items():
            if content is not None:
                for o, n in zip(old, new):
                    out[repo, o, n] = 1.0
                    gone.remove(o)
                    come.remove(n)
        gone, come = [p for p in gone if b[p]], [p for p in come if h[p]]
        name = lambda p: p.rsplit("/", 1)[-1]
        old_names, new_names = Counter(map(name, gone)), Counter(map(name, come))
        for o in list(gone):
            if old_names[name(o)] == new_names[name(o)] == 1:
                n = next(p for p in come if name(p) == name(o))
                if score(b[o], h[n]) >= similar_name:
                    out[repo, o, n] = score(b[o], h[n])
                    gone.remove(o)
                    come.remove(n)
        if limit is not None and len(gone) * len(come) > limit * limit:
            continue
        pairs = sorted((-score(b[o], h[n]), name(o) != name(n), n, o) for o in gone for n in come if score(b[o], h[n]) >= similar)
        used = set()
        for s, _, n, o in pairs:
            if ("o", o) not in used and ("n", n) not in used:
                used |= {("o", o), ("n", n)}
                out[repo, o, n] = -s
    return out


def found(spark, base, head, **options):
    b, h = (spark.createDataFrame(x, FILES) for x in (base, head))
    rows = snapshots.renamed_files(b, h, **options).collect()
    got = {(r["repo_url"], r["old_path"], r["path"]): r["score"] for r in rows}
    assert len(got) == len(rows)
    return got


LINES = [f"line number {i} of the file\n" for i in range(40)]


def text(*numbers):
    return "".join(LINES[i] for i in numbers)


def test_hand_made_set(spark):
    base = [("r", "a/main.py", text(*range(10))), ("r", "a/util.py", text(*range(10, 20))), ("r", "a/gone.py", text(20, 21, 22, 23)),
            ("r", "a/two.py", text(24, 25, 26, 27)), ("r", "a/three.py", text(24, 25, 26, 28)), ("r", "a/same.py", text(30, 31)),
            ("r", "a/crlf.py", text(32, 33, 34).replace("\n", "\r\n")), ("r", "a/empty.py", ""), ("r", "a/null.py", None),
            ("r", "a/long.py", "y" * 640), ("r", "stays.py", text(1)), ("other", "a/x.py", text(5, 6, 7))]
    head = [("r", "b/main.py", text(*range(9))), ("r", "b/tool.py", text(*range(10, 17))), ("r", "b/far.py", text(20, 35, 36, 37)),
            ("r", "b/one.py", text(24, 25, 26, 27, 29)), ("r", "b/same2.py", text(30, 31)), ("r", "b/crlf2.py", text(32, 33, 34) + "end\n"),
            ("r", "b/empty2.py", "new"), ("r", "b/null2.py", None), ("r", "b/long2.py", "y" * 500), ("r", "stays.py", text(1, 2)),
            ("r", "b/x.py", text(5, 6, 7))]
    got = {(o, n): round(s, 3) for (_, o, n), s in found(spark, base, head).items()}
    assert got == {("a/main.py", "b/main.py"): round(score(base[0][2], head[0][2]), 3),       # the name, over 75 per cent
                   ("a/util.py", "b/tool.py"): round(score(base[1][2], head[1][2]), 3),       # another name, over 50
                   ("a/two.py", "b/one.py"): round(score(base[3][2], head[3][2]), 3),         # the better of two for one file
                   ("a/same.py", "b/same2.py"): 1.0, ("a/crlf.py", "b/crlf2.py"): round(score(base[6][2], head[5][2]), 3),
                   ("a/long.py", "b/long2.py"): round(448 / 640, 3)}                         # seven whole chunks of 64
    b, h = (spark.createDataFrame(x, FILES) for x in (base, head))
    plain = {tuple(r) for r in snapshots.snapshot_diff(b, h).select("path", "status").collect()}
    edited = {tuple(r) for r in snapshots.snapshot_diff(b, h, similar=0.5).select("path", "status").collect()}
    assert plain - edited == {(o, "D") for o, _ in got if o != "a/same.py"} and not edited - plain
    assert ("stays.py", "M") in edited and ("a/gone.py", "D") in edited and ("a/three.py", "D") in edited


def random_repositories(seed, n):
    r = random.Random(seed)
    base, head = [], []
    for i in range(n):
        lines = [f"{r.choice('abc')}{j}\n" * r.randint(1, 3) for j in range(r.randint(2, 12))] + ["\n", "}\n"]
        for side, out in (("o", base), ("n", head)):
            for k in range(r.randint(0, 8)):
                name = r.choice(["index.py", "util.py", f"f{k}.py"])
                content = "".join(r.choice(lines) for _ in range(r.randint(0, 8)))
                out.append((f"repo{i}", f"{side}{k}/{name}", r.choice([content, content, content, None])))
    return base, head


def test_random_repositories_against_all_pairs(spark):
    base, head = random_repositories(5, 120)
    for options in ({}, {"similar": 0.3, "similar_name": 0.9, "rename_limit": None}, {"rename_limit": 2}):
        mine = {"similar": 0.5, "similar_name": 0.75, "limit": 1000} | {("limit" if k == "rename_limit" else k): v for k, v in options.items()}
        got = found(spark, base, head, **options)
        assert got == pytest.approx(plain_renames(base, head, **mine)) and got


def test_common_lines_are_not_looked_up(spark):
    """Files that share a licence and differ below it: the pairs looked at grow with the files, not with their square."""
    licence = "".join(f"licence {i}\n" for i in range(10))
    base = [("r", f"a/f{i}.py", licence + f"body {i} of the old file\n" * 10) for i in range(200)]
    head = [("r", f"b/g{i}.py", licence + f"body {i} of the old file\n" * 9 + "new\n") for i in range(200)]
    tagged = spark.createDataFrame([(*x, "D") for x in base] + [(*x, "A") for x in head], FILES + ", side string")
    assert renames._candidates(renames.chunk_bags(tagged), 0.5).count() == 200
    assert found(spark, base, head).keys() == {("r", f"a/f{i}.py", f"b/g{i}.py") for i in range(200)}


def test_nothing_to_match(spark):
    assert found(spark, [], [("r", "a.py", "x\n")]) == {} and found(spark, [("r", "a.py", "x\n")], []) == {}
    with pytest.raises(ValueError):
        found(spark, [], [], similar=0)
