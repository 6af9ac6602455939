import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codesieve.llm import fim
from tests.llm import cases

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plain_form(doc_id, text, seed=1, rate=90, spm_rate=20):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    if doc_id is not None:
        digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
        h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or doc_id is None or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


AWKWARD = ["<", "<P", "<S<M", "a<S>b", "<P>", "<M>x", "x <<P", "><S", "日本語 text é1", "\x00\x00", "a", " ", "\n", "ab1\r\ncd",
           "Z" * 5000, "é" * 3000, "word " * 40_000]


def test_forms_and_restored_texts(spark):
    docs = cases.documents(spark, [*cases.texts(3), *AWKWARD * 5])
    got = fim.restore(fim.fill_in_middle(docs)).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in got), key=key) == sorted(
        ((i, *plain_form(i, t), t or "") for i, t in texts), key=key)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_report_and_parameters(spark):
    docs = cases.documents(spark).withColumns({c: F.lit("z") for c in ("n", "form", "output", "restored", "prefix_chars")})
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["doc_id"]: tuple(r)[1:] for r in fim.fim_report(docs, seed=7, rate=50, spm_rate=50).collect()}
    for r in docs.select("doc_id", "text").collect():
        n, form, p, m, out = plain_form(r["doc_id"], r["text"], 7, 50, 50)
        assert got[r["doc_id"]] == (n, form, p, m, sha(out), sha(r["text"] or ""))


def test_empty_table_and_null_output(spark):
    assert fim.fim_report(cases.empty(spark)).collect() == []
    rows = spark.createDataFrame([(None, "psm", 1), ("abc", None, 2), ("<P>a<S>c<M>b", "psm", 3)], "output string, form string, x int")
    assert [(r["x"], r["restored"]) for r in fim.restore(rows).orderBy("x").collect()] == [(1, None), (2, "abc"), (3, "abc")]
    with pytest.raises(ValueError):
        fim.restore(rows.withColumn("restored", F.lit(1)))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1 <>PSMé日\n", max_size=60), st.integers(0, 60), st.integers(0, 60), st.sampled_from(["psm", "spm"]))
def test_rotations_turn_back(text, x, y, form):
    raw = text.encode()
    if any(s in raw for s in (b"<P>", b"<S>", b"<M>")):
        return
    counts = fim.count_units(raw)
    units = UNITS.findall(text)
    assert sum(counts) == len(units)
    a, b = sorted((min(x, len(units)), min(y, len(units))))
    p, m = fim.cut_place(raw, counts, a), fim.cut_place(raw, counts, b)
    assert raw[:p].decode() == "".join(units[:a]) and raw[p:m].decode() == "".join(units[a:b])
    out = bytes(fim.rearrange(raw, p, m, form))
    one, two, three = (s.decode() for s in (raw[:p], raw[p:m], raw[m:]))
    assert out.decode() == (f"<P>{one}<S>{three}<M>{two}" if form == "psm" else f"<S>{three}<P>{one}<M>{two}")
    assert bytes(fim.put_back(out, form)) == raw


def test_blocks_of_a_very_long_text(monkeypatch):
    monkeypatch.setattr(fim, "_BLOCK", 7)
    text = "ab1 é日 word,\n" * 50
    raw, units = text.encode(), UNITS.findall(text)
    counts = fim.count_units(raw)
    for k in range(0, len(units) + 1, 13):
        assert raw[:fim.cut_place(raw, counts, k)].decode() == "".join(units[:k])
    out = bytes(fim.rearrange(raw, 100, 300, "spm"))
    assert out == b"<S>" + raw[300:] + b"<P>" + raw[:100] + b"<M>" + raw[100:300] and bytes(fim.put_back(out, "spm")) == raw
