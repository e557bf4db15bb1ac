"""Near-duplicates, decontamination, repeats and toxicity against plain versions and on awkward rows."""

import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from millrace.llm import decontaminate, minhash, repeats, toxicity  # noqa: E402
from millrace.llm.components import components  # noqa: E402
from millrace.llm.queries import QUERIES, table  # noqa: E402

DOCS = "doc_id long, text string, n_words string, size int, spans int, kept int, rejected int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4) for i, t in rows], DOCS)


def corpus(spark, sf_dir):
    return [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def awkward():
    r = random.Random(3)
    base = [f"word{r.randrange(500)}" for _ in range(200)]
    rows = [(1, " ".join(base)), (2, None), (3, ""), (4, " \t\n"), (5, "One two"), (6, "one TWO"), (7, "one two three four five")]
    for i in range(8, 40):  # near copies in chains, most of them far from the first
        for _ in range(3):
            base[r.randrange(200)] = f"new{r.randrange(10**6)}"
        rows.append((i, " ".join(base)))
    rows += [(40, rows[0][1].upper()), (41, rows[0][1]), (42, "é " * 3000), (43, "é " * 2999)]
    return rows


def test_near_duplicates_equal_brute_force(spark, awkward):
    want = brute.near_duplicates(awkward)
    got = minhash.near_duplicates(frame(spark, awkward)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(awkward)


def test_near_duplicates_of_a_family_around_the_threshold(spark):
    r = random.Random(1)
    base, rows = [f"w{k}" for k in range(600)], []
    for i in range(1200):  # each member has its own 12 or so of 40 edits
        edits = {6 * e + 2: f"e{e}" for e in range(40) if r.random() < 0.3}
        rows.append((i, " ".join(edits.get(k, w) for k, w in enumerate(base))))
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for _, t in rows]
    place = {g: k for k, g in enumerate(set().union(*sets))}
    held = np.zeros((len(rows), len(place)), np.float32)
    for i, s in enumerate(sets):
        held[i, [place[g] for g in s]] = 1
    both, n = held @ held.T, held.sum(axis=1)
    linked = 100 * both >= 85 * (n[:, None] + n - both)
    want = np.arange(len(rows))
    while (want != (new := np.where(linked, want, len(rows)).min(axis=1))).any():
        want = new
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == dict(enumerate(want.tolist()))


def test_near_duplicates_empty_repeated_and_null_ids(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    rows = [(9, "a b c d e f"), (9, "a b c d e f"), (None, "a b c d e f"), (None, "z y x w v"), (4, "A b C d e f")]
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    assert got == [("4", "4", True), ("9", "4", False), ("9", "4", False), ("None", "4", False), ("None", "None", True)]


def test_keep_one_returns_the_columns_of_its_input(spark):
    docs = frame(spark, [(2, "a b c d e f"), (1, "a b c d e f"), (3, None)])
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_components_of_a_chain_and_a_hub(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def contaminated(found):
    return {r.doc_id: (r.n_words, r.n_hit, r.n, r.sha, r.contaminated) for r in found.select("*", F.size("items").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("sha")).collect()}


@pytest.mark.parametrize("slice_bytes", [1 << 25, 40])
def test_contamination_equals_brute_force(spark, slice_bytes):
    words = [f"w{k}" for k in range(60)]
    items = [("a", " ".join(words[:20])), ("b", "short ONE"), ("c", None), ("d", ""), ("e", " ".join(words[10:30])), (None, " ".join(words[40:55])), ("a", " ".join(words[:20]))]
    rows = [
        (1, " ".join(words)), (2, "x " * 400 + "Short, one! " + "y " * 10), (3, None), (4, ""), (5, "..."), (6, " ".join(words[:12])),
        (7, "SHORT-ONE"), (8, "a_short one"), (9, "q " * 247 + " ".join(words[5:18])), (10, "q " * 248 + " ".join(words[5:18])), (11, "é" + " short one"),
    ]
    want = brute.contamination(rows, [x for x in items if x[0]])
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    got = contaminated(decontaminate.find(frame(spark, rows), benchmark, slice_bytes=slice_bytes))
    assert {k: v for k, v in got.items() if k != 1} == {k: v for k, v in want.items() if k != 1}
    assert got[1][1] == 45 and got[1][2] == 2  # the item without an id marks its 15 words
    assert got[9][4] and not got[10][4]


def test_contaminated_spans_and_documents_go(spark):
    docs = frame(spark, [(1, "Keep Short one, keep"), (2, None), (3, "clean text"), (3, "clean text")])
    found = decontaminate.find(docs, spark.createDataFrame([("b", "short one")], "item_id string, text string"))
    assert sorted(str(r.text) for r in decontaminate.remove_spans(found).collect()) == ["Keep  , keep", "None", "clean text", "clean text"]
    assert sorted(r.doc_id for r in decontaminate.remove_documents(found).collect()) == [2, 3, 3]
    none = decontaminate.find(docs, spark.createDataFrame([], "item_id string, text string"))
    assert none.filter("contaminated").count() == 0 and decontaminate.find(frame(spark, []), spark.createDataFrame([], "item_id string, text string")).count() == 0


def test_op8_equals_brute_force(spark, sf_dir):
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in QUERIES["op8_decontaminate"](spark, sf_dir).collect()}
    assert got == brute.contamination(corpus(spark, sf_dir), items)


def removed(rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows.collect()}


def test_repeats_equal_brute_force(spark):
    r = random.Random(5)
    line = "".join(r.choice("abcdé ") for _ in range(400))
    rows = [(1, line), (2, None), (3, ""), (4, line[:49]), (5, "x" + line[100:150] + "y"), (6, line[100:149]), (7, "ab" * 300), (8, "ab" * 300 + "c"), (9, line), (10, "ba" * 40)]
    rows += [(20 + k, "".join(r.choice("ab") for _ in range(60)) + line[k * 7 : k * 7 + 90] + "".join(r.choice("ab") for _ in range(60))) for k in range(12)]
    assert removed(repeats.remove_repeats(frame(spark, rows))) == brute.repeats(rows)


def test_parts_below_the_length_do_not_reach_the_suffix_sort(spark):
    r = random.Random(6)
    shared = [bytes(r.choice(b"abcdefgh") for _ in range(n)) for n in (39, 60)]
    rows = [(10 * k + side, 10 * k + side, bytes([65 + side]) * 3 + part + bytes([75 + side]) * 30) for k, part in enumerate(shared) for side in range(3)]
    runs = repeats.shared_runs(spark.createDataFrame(rows, "chunk long, doc long, bytes binary")).collect()
    assert {x.chunk for x in runs} == {10, 11, 12}
    whole = {c: bytes(b) for c, _, b in rows}
    assert all(bytes(x.bytes) == whole[x.chunk][x.off :][: len(x.bytes)] and shared[1] in bytes(x.bytes) for x in runs)


def test_repeats_of_equal_rows_and_null_ids(spark):
    text = "0123456789" * 8
    rows = [(3, text), (3, text), (None, text), (5, text), (4, None)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in repeats.remove_repeats(frame(spark, rows)).collect())
    assert got == [("3", 80, 0), ("3", 80, 0), ("4", 0, 0), ("5", 80, 80), ("None", 80, 0)]
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


def test_op9_equals_brute_force(spark, sf_dir):
    assert removed(QUERIES["op9_repeats"](spark, sf_dir)) == brute.repeats(corpus(spark, sf_dir))


def test_op2_equals_brute_force(spark, sf_dir):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op2_minhash"](spark, sf_dir).collect()}
    assert got == brute.near_duplicates(corpus(spark, sf_dir))


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    judged = toxicity.judge(docs.select("doc_id", "text"), labels.filter("doc_id % 4 <> 0"))
    r = judged.join(labels.filter("doc_id % 4 = 0"), "doc_id").agg(F.count_if(F.expr("toxic = 1 AND rejected")).alias("hit"), F.count_if(F.expr("toxic = 1")).alias("all"), F.count_if(F.expr("toxic = 0 AND rejected")).alias("wrong"), F.count_if(F.expr("toxic = 0")).alias("clean")).first()
    assert r.hit >= 0.85 * r.all and r.wrong <= 0.01 * r.clean


def test_a_repeated_document_counts_once_in_the_fit(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["bad", "foul", "x"] if i % 3 == 0 else ["good", "nice", "x"]) + str(r.randrange(3)) for _ in range(12))) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    once, often = (toxicity.train(frame(spark, d), labels, {"toxic": "toxic"}) for d in (rows, rows + [rows[0]] * 500))
    assert once.chosen.tolist() == often.chosen.tolist() and len(once.chosen)
    assert np.allclose(once.models[0].token, often.models[0].token) and np.isclose(once.models[0].bias, often.models[0].bias)


def test_toxicity_without_usable_labels(spark):
    docs = frame(spark, [(1, "some words here"), (2, None), (3, ""), (3, "")])
    for rows in ([], [(None, 1, 1)], [(1, None, 0), (2, 1, 0)], [(1, 1, None)]):
        out = toxicity.judge(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
        assert out.count() == 4 and out.filter("rejected").count() == 0
    one = toxicity.judge(frame(spark, []), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int"))
    assert one.count() == 0
