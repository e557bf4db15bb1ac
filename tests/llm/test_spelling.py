"""Spelling variants against a plain version."""

import random
import re
import zlib
from collections import Counter

import pytest

from millrace.llm import spelling
from millrace.llm.queries import QUERIES, table

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(rows, every=199, least_length=6, least_count=5, ratio=5):
    """word -> (form, root, n, near words, n of the form)."""
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            n[run if h % every else run[:at] + run[at + 1 :]] += 1
    n = {w: k for w, k in n.items() if k >= least_count and len(w) >= least_length}
    holes = {}
    for w in n:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in n}
    for w in n:
        for i in range(len(w)):
            near[w] |= holes[w[:i], w[i + 1 :]]
            if (short := w[:i] + w[i + 1 :]) in n:
                near[w].add(short)
                near[short].add(w)
        near[w].discard(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def plain(df):
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def test_the_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = plain(QUERIES["op12_spelling"](spark, sf_dir))
    assert got == brute(rows) and len(got) > 200


@pytest.mark.parametrize("cell,cells", [(8, 1 << 20), (8, 4), (1000, 4)])
def test_cells_and_blocks_of_any_size_give_the_same_pairs(spark, cell, cells):
    r = random.Random(5)
    rows, words = [], set()
    for _ in range(300):  # many words of the same letters, and their variants
        word = "".join(r.choice("abcé×") for _ in range(r.randrange(6, 9)))
        words |= {word, word[:3] + "z" + word[4:], word[1:] + "e", word[2] + word[:2] + word[3:]}
    for k, w in enumerate(sorted(words)):
        rows += [(k, f"{w.upper()} " * 3 + f"{w}. " * r.choice([1, 2, 3, 9, 60, 400]))]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, word int")
    got = plain(spelling.variants(docs, every=7, cell=cell, cells=cells))
    assert got == brute(rows, every=7)
    assert any(v[0] and v[1] != v[0] for v in got.values()), "a form of a form"


def test_awkward_rows(spark):
    long = "Straße " * 50_000 + "y" * 300_000
    rows = [(1, None), (2, ""), (None, "abcdefg " * 6), (4, "abcdefg"), (4, "abcdefg"), (5, long), (6, "12 !! 中文" * 9), (7, "ABCDEFH abcdefh " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert plain(spelling.variants(docs)) == brute(rows)
    assert spelling.variants(docs.limit(0)).count() == 0
