import hashlib
import json
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codesieve.llm import bpe
from tests.llm import cases

PATH = public_tokenizers.path("word_bpe_49k.json")
SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def known():
    return bpe.Vocabulary(PATH)


def ids_of(coder, text):
    return list(memoryview(coder.encode(text)).cast("i"))


TEXTS = ["", " ", "\x1c", "a\x1cb", "a\x85b", "ΑΣ ΟΔΟΣ", "İstanbul I", "é e ́x", "don't we'LL 've'", f"{SPECIAL}", f"a{SPECIAL}B {SPECIAL}{SPECIAL}",
         "<|startoftext|> x <|end", "1234 ½ Ⅷ", " 　x", "日本語のテキスト", "😀👍🏽 ok", "A" * 3000, "ab" * 4000, "!?" * 3000, "ꟋᲉ new ՘b1",
         "supercalifragilistic exhilarating", "힣가 Å"]


def test_ids_and_texts_are_the_library_s(spark, library):
    docs = cases.documents(spark, [*cases.texts(5), *TEXTS])
    encoded = bpe.encode_documents(docs, PATH)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = sorted((i or -1, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in encoded.collect()) == want
    back = bpe.decode_documents(encoded, PATH).collect()
    assert sorted((r["doc_id"] or -1, r["decoded"]) for r in back) == sorted(
        (i, library.decode(ids, skip_special_tokens=False)) for i, ids in want)


def test_report(spark, library):
    docs = cases.documents(spark).withColumns({c: F.lit("z") for c in ("ids", "decoded", "n_tokens")})
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"] or -1, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = [(r["doc_id"] or -1, *tuple(r)[1:]) for r in bpe.bpe_report(docs, PATH).collect()]
    assert sorted(got) == sorted(want)
    assert bpe.bpe_report(cases.empty(spark), PATH).collect() == []


def test_null_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [320, 49406, 999999, 518])], "x int, ids array<int>")
    got = {r["x"]: r["decoded"] for r in bpe.decode_documents(rows, PATH).collect()}
    assert got[1] == "" and got[2] == "" and got[3].split(" ")[1:] == ["<|startoftext|>", "the</w>"]
    with pytest.raises(ValueError):
        bpe.decode_documents(rows.withColumn("decoded", F.lit(1)), PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    library, coder = test_any_text.both = getattr(test_any_text, "both", None) or (Tokenizer.from_file(PATH), bpe.Encoder(bpe.Vocabulary(PATH)))
    assert ids_of(coder, text) == library.encode(text, add_special_tokens=False).ids


def test_every_character(known, library):
    coder, chars = bpe.Encoder(known), [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f"aΣ{c}b1" for c in chars]
    assert [ids_of(coder, t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_a_long_word_in_blocks_of_any_size_and_constant_memory(known, library):
    r = random.Random(4)
    for alphabet, block in (("aeinrstlohg", 16), ("ab", 64), ("exhilarating", 1), ("é日a", 50)):
        word = "".join(r.choice(alphabet) for _ in range(5000))
        data, transducer, out, widest = word.encode(), bpe.WordTransducer(known, block), [], 0
        for lo in range(0, len(data), 13):
            out += transducer.feed(data[lo:lo + 13])
            widest = max(widest, len(transducer.open))
        out += transducer.close()
        # the library splits a word only where its pattern does
        assert out == library.encode(word, add_special_tokens=False).ids
        assert widest <= known.lookahead + 2 * max(block, 13) + 32


def naive(merges, symbols):
    symbols = list(symbols)
    while True:
        ranked = [(merges[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in merges]
        if not ranked:
            return symbols
        _, i = min(ranked)
        symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9))
def test_lookahead_suffices_for_any_proper_list(seed):
    """Random merge lists: what ends the lookahead before the open end is the same whatever follows."""
    r = random.Random(seed)
    tokens, merges = ["a", "b", "c"], []
    for _ in range(r.randint(1, 12)):
        a, b = r.choice(tokens), r.choice(tokens)
        if a + b not in tokens:
            merges.append((a, b))
            tokens.append(a + b)
    if not merges:
        return
    look, ranks = bpe.sufficient_lookahead(merges, len), {m: i for i, m in enumerate(merges)}
    for _ in range(20):
        start = "".join(r.choice("abc") for _ in range(r.randint(1, 25)))

        def settled(text):
            at, out = 0, []
            for t in naive(ranks, text):
                at += len(t)
                if at > len(start) - look:
                    break
                out.append(t)
            return out

        assert settled(start) == settled(start + "".join(r.choice("abc") for _ in range(r.randint(0, 12))))


def test_improper_lists_are_refused():
    for merges in ([("ab", "c"), ("a", "b")], [("a", "b"), ("ab", "c"), ("b", "c"), ("a", "bc")]):
        with pytest.raises(ValueError):
            bpe.sufficient_lookahead(merges, len)


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    spec = json.load(open(PATH))
    spec["normalizer"]["normalizers"].pop()
    (tmp_path / "x.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "x.json"))


def test_few_and_many_merge_alike(known):
    r = random.Random(9)
    for n in (0, 1, 2, 5, 60, 400):
        symbols = [known.inner[ord(r.choice("aeinrstlo"))] for _ in range(n)]
        assert known._merge_few(symbols) == known._merge_many(symbols)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(max_size=40), st.text(max_size=20).map(str.encode)), st.integers(1, 5))
def test_bytes_become_text_in_pieces(data, step):
    machine = bpe.ByteToText()
    parts = [machine.feed(data[i:i + step]) for i in range(0, len(data), step)]
    assert len(machine.held) <= 3
    assert "".join(parts) + machine.close() == data.decode("utf-8", "replace")


def test_decoding_to_plain_text(known):
    coder = bpe.Encoder(known)
    for text in ("two words", "日本語 😀 ok", "naïve"):
        ids = ids_of(coder, text)
        decoder = bpe.Decoder(known, joined=False)
        assert "".join(decoder.feed([i]) for i in ids) + decoder.close() == text + " "
