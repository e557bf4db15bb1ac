"""Byte-pair encoding and decoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe
from millrace.llm.queries import QUERIES, table

PATH = public_tokenizers.path("word_bpe_49k.json")
POOL = ["'", "s", "r", "e", "l", " ", "\n", "a", "b", "\u00e9", "e\u0301", "\u0301", "1", "!", "\u03a3", "\u0130", "<|endoftext|>", "<|endof", "\u1100", "\u1161", "\u11a8", "\u4e2d", "\U0001f600", "\u2003", "\u07fd", "x"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def coded(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_the_query_equals_the_library(spark, sf_dir, library):
    got = {r.doc_id: r for r in QUERIES["op11_bpe"](spark, sf_dir).collect()}
    for doc_id, text in table(spark, sf_dir, "documents").select("doc_id", "text").collect():
        ids = coded(library, text or "")
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_small_windows_and_slices_give_the_same_tokens(library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 97)
    work, r = bpe.Encoder(bpe.vocabulary(PATH), window=16), random.Random(2)
    for pool in (POOL, POOL[:5] + ["a", "b", "\u00e9", "\u0301"], ["'", "re", "x"]):
        for _ in range(60):
            text = "".join(r.choice(pool) for _ in range(r.randrange(1, 900)))
            assert work.encode(text).tolist() == coded(library, text), text


def test_every_code_point_is_cut_and_spelt_like_the_library_does(library):
    work = bpe.encoder(PATH)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 2000):
        for between in ("a", "", "\u0301e"):
            text = between.join(points[lo : lo + 2000])
            assert work.encode(text).tolist() == coded(library, text), hex(lo)


def test_a_run_of_any_length_is_held_in_a_window(library):
    voc, r = bpe.vocabulary(PATH), random.Random(3)
    for text in ("".join(r.choice("abcdefghij") for _ in range(30_000)), "the" * 10_000, "a" * 20_001):
        work, out, held = bpe.Transducer(voc), [], 0
        for lo in range(0, len(text), 100):
            out += work.feed(text[lo : lo + 100])
            held = max(held, len(work.open))
        assert held <= bpe.WINDOW + voc.lookahead + 100
        assert out + work.finish() == coded(library, text)


def test_the_lookahead_of_small_merge_lists():
    letters = {"a", "b", "c"}
    assert bpe.lookahead([["a", "b"]], letters, "") == 1
    # b c before a b: whether a b is merged depends on a c two symbols on.
    assert bpe.lookahead([["b", "c"], ["a", "b"]], letters, "") == 2
    for merges in ([["ab", "c"], ["a", "b"]], [["a", "b"], ["a", "b"]]):
        with pytest.raises(ValueError):
            bpe.lookahead(merges, letters, "")


def test_bytes_become_text_as_they_come():
    r = random.Random(4)
    data = "a\u00e9\u4e2d\U0001f600".encode() + bytes(r.randrange(256) for _ in range(4000)) + "\U0001f600".encode()[:3]
    for step in (1, 2, 3, 7):
        state = bpe.Text()
        parts = [state.feed(data[lo : lo + step]) for lo in range(0, len(data), step)]
        assert "".join(parts) + state.finish() == data.decode("utf-8", "replace")
        assert len(state.open) < 4


def test_decoding_of_a_byte_level_file_returns_the_text():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    text = "Na\u00efve \u4e2d\u6587 \U0001f600 <|endoftext|> x\n" * 50
    ids = np.array(library.encode(text, add_special_tokens=False).ids, np.int32)
    assert "".join(bpe.decoder(path).stream(ids)) == text == library.decode(ids.tolist(), skip_special_tokens=False)


def test_awkward_rows(spark, library):
    long = "word " * 300_000 + "x" * 100_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "same"), (4, "same"), (None, "no id"), (6, long), (7, "\u0301" * 50)]
    docs = spark.createDataFrame([(i, t, "kept", [7]) for i, t in rows], "doc_id long, text string, lang string, ids array<int>")
    got = bpe.encode(docs, PATH)
    assert got.columns == ["doc_id", "text", "lang", "ids"]
    back = bpe.decode(got, PATH, text="lang").collect()
    assert len(back) == len(rows)
    for r in back:
        assert r.ids == coded(library, r.text or "")
        assert r.lang == library.decode(r.ids, skip_special_tokens=False)
    empty = bpe.decode(bpe.encode(docs.filter(F.lit(False)), PATH), PATH)
    assert empty.count() == 0
    odd = spark.createDataFrame([(1, [3306, None, 10**6]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r.text for r in bpe.decode(odd, PATH).orderBy("doc_id").collect()] == ["hello</w>", "", ""]
