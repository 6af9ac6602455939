from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codesieve.llm import audit
from tests.llm import cases

SPACES = " \t\n\x0b\x0c\r"


def words(text):
    out, word = [], ""
    for c in text:
        if c in SPACES:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


def plain_audit(docs, labels, limits=audit.Limits()):
    """Every order run over the documents, filter by filter."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = []
    for i, t, part in docs:
        t, w = t or "", words(t or "")
        fails = {"A": len(w) < limits.min_words, "B": 100 * len(set(w)) < limits.min_distinct * len(w),
                 "C": 100 * sum("A" <= c <= "Z" for c in t) > limits.max_upper * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t]}
        rows.append((part or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r[1:] for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [r for r in left if r[0][name]]
                kept = [r for r in left if not r[0][name]]
                shapley[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(kept), len(gone), sum(r[0][name] for r in mine) - len(gone),
                    sum(r[0][name] and sum(r[0].values()) == 1 for r in mine), sum(r[1] for r in gone), sum(r[2] for r in gone), name]
                left = kept
        for (p, order, step), v in out.items():
            if p == part:
                v[-1] = shapley[order[step - 1]]
    return out


def found(df):
    return {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in df.collect()}


def check(spark, docs, labels, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    m = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit_filters(d, m, **more)
    rows = got.collect()
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in rows} == plain_audit(docs, labels, **more)
    assert len(rows) == 600 * len({p or "" for _, _, p in docs})


LIMITS = audit.Limits(min_words=4)


def test_all_orders_against_running_them(spark):
    made = ["a b c d", "a a a a a b", "A B c d e", "# a b c d", "x", "", None, "A A A $", "one two three four five",
            "dél étè x y\x1cz w", "q " * 300, "a b c d", "a b c d"]
    docs = [(i, t, ("en", "de", None, "")[i % 4]) for i, t in enumerate(made * 2)]
    docs += [(None, "a b c d", "en"), (None, "a b c d", "en"), (None, "only null here now", "fr"), (3, "# a b c d", "de"), (40, None, "xx")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 20)]
    labels = [(i, q, int(t)) for i, q, t in labels] + [(3, 0, 0), (3, None, 1), (None, 1, 1), (999, 1, 1), (4, None, None)]
    check(spark, docs, labels, limits=LIMITS)


def test_copies_across_parts_and_repeated_ids(spark):
    docs = [(i, "one text in many copies", f"p{i % 3}") for i in range(50, 400)]
    docs += [(50, "one text in many copies", "p0"), (50, "one text in many copies", "p1"), (7, "one text in many copies", "p2"),
             (7, "one text in many copies", "p2"), (7, "another text of the id", "p2"), (1, "another text of the id", "p0")]
    check(spark, docs, [(i, 1, int(i % 5 == 0)) for i in range(0, 400, 2)], limits=LIMITS)


def test_production_limits_and_clashing_columns(spark):
    docs = cases.documents(spark)
    docs = docs.withColumns({c: F.lit("z") for c in ("part", "failed", "digest", "salt", "n", "first", "smallest", "passing",
                                                     "good", "toxic", "filter_order", "step")})
    labels = spark.createDataFrame([(i, i % 2, 1, "z", "z") for i in range(30)],
                                   "doc_id long, quality int, toxic int, salt string, good string")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.select("doc_id", "text", "lang").collect()]
    assert found(audit.audit_filters(docs, labels)) == plain_audit(rows, [(i, i % 2, 1) for i in range(30)])


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit_filters(cases.empty(spark), labels).collect() == []
    docs = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    assert found(audit.audit_filters(docs, labels)) == plain_audit([(1, "a b", "en")], [])


def test_a_very_long_text_is_read_in_windows():
    text = ("word " * 40 + "x" * 3000 + "\n") * 1500 + "é" * 2_000_000
    assert len(text.encode()) > 3 * audit._WINDOW
    w = words(text)
    assert sum(len(p.split()) for p in audit._windows(text.encode())) == len(w)
    assert audit.failed_filters(text.encode()) == 2
    assert audit.failed_filters(("A" * 1_100_000 + " #").encode()) == 0b1101


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=96, max_size=96))
def test_contractions_add_up(counts):
    cells = np.array(counts).reshape(2, 2, 2, 2, 2, 3)
    got, total = audit.contract_cells(cells), int(cells[..., 0].sum())
    last = got["kept"][:, -1]
    assert (last == cells[0, 0, 0, 0, 0, 0]).all()  # the order does not matter in the end
    assert (last + got["removed"].sum(1) == total).all()
    assert (got["good_lost"].sum(1) == cells[..., 1].sum() - cells[0, 0, 0, 0, 0, 1]).all()
    assert (got["removed"] >= got["unique_fails"]).all()
    assert (got["shapley"].sum(1) == 120 * (total - last)).all()
