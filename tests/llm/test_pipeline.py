import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from codesieve.llm import quality
from tests.llm import cases
from tests.llm.test_mixing import brute_targets
from tests.llm.test_quality import brute as figures
from tests.llm.test_secrets import HARD, brute as secret_counts
from tests.llm.test_simhash import brute_print, groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(rows):
    """(id, text, source) rows -> the rows of each stage, in plain Python."""
    kept = []
    for d, t, s in rows:
        clean, lost, total, _ = quality.clean_text((t or "").encode())
        if not figures(t)[-1] and lost <= total / 2:
            kept.append((d, clean.decode(), s))
    prints = [brute_print(t) for _, t, _ in kept]
    label = groups(prints)
    best = {}
    for (d, t, s), p, k in zip(kept, prints, label):
        rank = (d is None, d or 0, p - (1 << 64) if p >> 63 else p)
        if k not in best or rank < best[k][0]:
            best[k] = (rank, (d, t, s))
    single = [row for _, row in best.values()]
    return kept, single


def mixed(rows):
    size = [len(WORD.findall(t)) for _, t, _ in rows]
    by = defaultdict(list)
    for i, (_, _, s) in enumerate(rows):
        by[s].append(i)
    sizes = {s: sum(size[i] for i in m) for s, m in by.items()}
    target = brute_targets(sizes, (3, 1, 2), 1.5, 2.0)
    out = Counter()
    for s, members in by.items():
        at = 0
        for i in sorted(members, key=lambda i: (hashlib.md5(f"mix:{rows[i][0]}".encode()).hexdigest()[:16], rows[i][0])):
            taken = sum(max(0, min(at + e * sizes[s] + size[i], math.floor(target[s])) - at - e * sizes[s]) for e in (0, 1))
            out[rows[i]] += math.floor(taken / size[i] + 0.5) if size[i] else 0
            at += size[i]
    return +out


def test_stages_match_brute_force(spark, tmp_path):
    values = cases.texts(21, 40) + [f"A sentence number {i} of sufficient length to stay, with a login: {h}\nthat goes on and on {i} "
                                    f"for some {i * 7} more words than twenty so that it is kept as a whole." for i, h in enumerate(HARD[:5])]
    docs = cases.documents(spark, values)
    columns = docs.columns
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    kept, single = expected(rows)
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns
            assert docs.filter("n_chars <> char_length(text)").count() == 0 or name in ("simhash", "mixing")
        results[name] = docs
    read = lambda n: [(r.doc_id, r.text, r.source) for r in results[n].collect()]
    assert Counter(read("quality")) == Counter(kept)
    assert Counter(read("simhash")) == Counter(single)
    after = read("secrets")
    assert Counter((d, s) for d, _, s in after) == Counter((d, s) for d, _, s in single)
    assert all(secret_counts(t)[:3] == (0, 0, 0) for _, t, _ in after)
    texts = {(d, t) for d, t, _ in single if not any(secret_counts(t)[:3])}
    assert texts <= {(d, t) for d, t, _ in after}
    assert Counter(read("mixing")) == mixed(after)
    lib = Tokenizer.from_file(corpus_pipeline.VOCABULARY)
    want = Counter()
    for d, t, _ in read("mixing"):
        ids = lib.encode(t, add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want.update((d, k, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in results["packing"].collect()) == want


def test_empty_documents(spark, tmp_path):
    docs = cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
        docs = spark.createDataFrame([], docs.schema)


def test_registered(spark):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)", n)[1]) for n in names) == list(range(1, 14))
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
