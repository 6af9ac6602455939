import hashlib
import math
import re
from collections import Counter, defaultdict

from codesieve.llm import privacy
from tests.llm import cases

HARD = [
    "Mail a.b+c@x-y.example.com, or a@b.c_d@e.f.g é x@y @z.a a@b a@.b a..b@c.d.e. me@host.org",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.0003.255 1.2.3 999999999999.1.1.1 10.0.0.1é 0.0.0.0",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4 1 1 x 5500005555555559 0000000000000 12345678901234567890123",
    "+1 (555) 123-4567, +44.20.7946.0958 +1-2 +123456789012345678 +49 30 12 +a +5 ( ) 5 + 1 555 123 4567",
    "日本 a@b.cd 🙂 10.20.30.40 🙂🙂 +1 555 123 4567 4111111111111111",
    "x" * 3000 + " " + "1" * 2000 + " " + "a." * 1000 + "@" + "b." * 1500 + "c",
    " ".join(f"u{i}@h{i}.org" for i in range(1500)),
]


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        s += n - 9 if n > 9 else n
    return s % 10 == 0


def brute_base(text):
    t = text or ""
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_match_brute_force(spark):
    docs = cases.documents(spark, cases.texts(14) + HARD)
    rows = privacy.private_report(docs).collect()
    want = Counter()
    for r in docs.collect():
        spans = brute_base(r.text)
        line = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        n = Counter(k for *_, k in spans)
        want[(r.doc_id, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(line.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == want


FILL = " ".join(f"{a}{b}word" for a in "abcdefgh" for b in "klmnopqr")


def test_terms_that_reveal_an_entity(spark):
    """'Zephyrine' stands near one address only, 'common' everywhere, 'twice' below the support."""
    values = [f"{FILL} common Zephyrine wrote to z@post.org today common. {FILL}"] * 4
    values += [f"common words here {FILL} common"] * 30 + ["twice near z@post.org", "twice near z@post.org", f"{FILL} far Zephyrus"]
    docs = cases.documents(spark, values, repeat=False)
    rows = {r.doc_id: r for r in privacy.private_spans(docs).collect()}
    text = values[0]
    found = {text[s["start"]:s["end"]]: s["kind"] for s in rows[0].spans}
    assert found["z@post.org"] == "email" and found["Zephyrine"] == "term_remove" and "common" not in found
    assert [s["kind"] for s in rows[34].spans] == ["email"]
    assert rows[5].spans == [] and rows[36].spans == []
    clean = {r.doc_id: r.text for r in privacy.sanitise(docs).collect()}
    assert "Zephyrine" not in clean[0] and "[email]" in clean[0] and clean[5] == values[5]


def test_terms_are_marked_at_every_place(spark):
    """Also beyond the window in the text that mentions the entity, and in texts that do not."""
    values = [f"{FILL} Zephyrine wrote to z@post.org today. {FILL} Zephyrine"] * 4
    values += [f"{FILL} words here"] * 30 + ["only zephyrine here", "Zephyrines and xZephyrine"]
    docs = cases.documents(spark, values, repeat=False)
    rows = {r.doc_id: r for r in privacy.private_spans(docs, generalise=0.6).collect()}
    marked = [values[i][s["start"]:s["end"]] for i in (0, 3, 34) for s in rows[i].spans if s["kind"] in privacy.TERM_KINDS]
    assert Counter(m.lower() for m in marked)["zephyrine"] == 5 and rows[35].spans == [] and len(rows) == 36
    clean = {r.doc_id: r.text for r in privacy.sanitise(docs, generalise=0.6).collect()}
    assert all("zephyrine" not in clean[i].lower() for i in range(35)) and clean[35] == values[35]


def test_disclosure_figures(spark):
    near = [(i, "e", "t", i, i + 1) for i in range(4)] + [(9, "e", "u", 0, 1)] * 1 + [(i, "f", "t", i, i + 1) for i in range(3)]
    df = spark.createDataFrame(near, "row long, entity string, term string, start long, end long")
    counts = spark.createDataFrame([("t", 8), ("u", 1), ("v", 991)], "term string, n long")
    rows = {(r.entity, r.term): r.ratio for r in privacy.disclosures(df, counts, 3, 0.0).collect()}
    want = {("e", "t"): 1 + math.log2(4 / 8) / math.log2(1000 / 5), ("f", "t"): 1 + math.log2(3 / 8) / math.log2(1000 / 3)}
    assert rows.keys() == want.keys() and all(abs(rows[k] - v) < 1e-12 for k, v in want.items())


def test_windows_and_places(spark):
    text = "cutword " + "x" * 95 + " alpha, (bravo) a@b.cd charlie d3lta echo 10.0.0.1 " + "foxtrot " * 14
    docs = cases.documents(spark, [text], repeat=False)
    row = privacy.find_base(docs).collect()[0]
    by = defaultdict(set)
    for x in row.near:
        assert text[x["start"]:x["end"]].lower() == x["term"]
        by[x["entity"]].add(x["term"])
    mail = hashlib.md5(b"email:a@b.cd").hexdigest()
    assert by[mail] == {"alpha", "bravo", "charlie", "echo", "foxtrot"}


def test_numbers_that_are_no_mentions_leave_the_window_whole(spark):
    """Numbers that fail the check, and other mentions, do not end a window; places are right far into a long text."""
    card = "4111 1111 1111 1111"
    texts = [f"alpha 2024 bravo {card}, charlie 1234567 delta 2025 echo",
             "é日" * 1600 + " alpha 300.1.1.1 bravo 10.0.0.1 charlie 999.9.9.9 delta 10.0.0.2 echo " + "x" * 3000,
             "alpha +12 bravo +1 555 123 4567 charlie +3 4 delta"]
    docs = cases.documents(spark, texts, repeat=False)
    rows = {r.id: r for r in privacy.find_base(docs).collect()}
    names = [f"card:{card.replace(' ', '')}", "ip:10.0.0.1", "phone:15551234567"]
    wants = [{"alpha", "bravo", "charlie", "delta", "echo"}] * 2 + [{"alpha", "bravo", "charlie", "delta"}]
    for i, (name, want) in enumerate(zip(names, wants)):
        entity = hashlib.md5(name.encode()).hexdigest()
        assert {x["term"] for x in rows[i].near if x["entity"] == entity} == want
        assert all(texts[i][x["start"]:x["end"]].lower() == x["term"] for x in rows[i].near)


def test_empty_table(spark):
    assert privacy.private_report(cases.empty(spark)).count() == 0
    assert privacy.sanitise(cases.empty(spark)).count() == 0
