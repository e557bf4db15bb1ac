"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import negatives
from millrace.llm.queries import ORACLES, QUERIES, table

SCHEMA = "vec_id long, embedding array<double>, label int, id string, score int"


def brute(rows, is_anchor, k=5, low=80, high=100):
    """All result rows, from plain whole numbers."""
    clean = {}
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i not in clean or (y, v) < clean[i]:
            clean[i] = (y, v)
    held = {i: (y, [math.floor(256 * x) if math.isfinite(256 * x) else 256 * int(x) for x in v]) for i, (y, v) in clean.items()}
    out = []
    for a, (y, v) in held.items():
        if not is_anchor(a):
            continue
        scored = []
        for b, (z, w) in held.items():
            if b != a and len(w) == len(v):
                s = sum(p * q for p, q in zip(v, w))
                scored.append((max(-(2**63), min(2**63 - 1, s)), b, z))
        scored.sort(key=lambda r: (-r[0], r[1]))
        for ps, p, _ in [r for r in scored if r[2] == y][:k]:
            band = [r for r in scored if r[2] != y and low * ps <= 100 * r[0] <= high * ps][:k]
            out += [(a, p, n + 1, b, ps, s) for n, (s, b, _) in enumerate(band)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 0) for i, v, y in rows], SCHEMA)


def test_the_query_equals_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in table(spark, sf_dir, "embeddings").collect()]
    want = brute(rows, lambda i: i % 100 == 0)
    assert result(QUERIES["op13_negatives"](spark, sf_dir)) == want and want
    assert "op13_negatives" in ORACLES


@pytest.mark.parametrize("spread", [0.05, 2.0])
def test_skewed_lengths_and_few_dimensions(spark, spread):
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 6)) * np.exp(r.normal(size=(3000, 1)) * spread)
    rows = [(int(i), [float(c) for c in v], int(r.integers(0, 4))) for i, v in enumerate(x)]
    got = result(negatives.mine(frame(spark, rows), F.col("id") % 50 == 0, bucket=64, anchors=20, stripes=3))
    assert got == brute(rows, lambda i: i % 50 == 0)


def test_coordinates_prune_and_lose_nothing():
    r = np.random.default_rng(4)
    rows, pruned = r.normal(size=(400, 5)), 0
    bucket = negatives.Bucket(np.arange(400), np.zeros(400), rows)
    for anchor in negatives.whole(r.normal(size=(50, 5))):
        products = bucket.numbers @ anchor
        length = float(negatives.lengths(anchor[None])[0])
        for share in (0.3, 0.8, 0.95, 1.0, 1.1):
            least = share * products.max()
            found = bucket.candidates(anchor, length, least)
            assert found is None or set(np.flatnonzero(products >= least)) <= set(found)
            pruned += found is not None and len(found) < 100
    assert pruned > 50


def test_one_vector_in_a_third_of_the_rows(spark):
    r = np.random.default_rng(6)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [float(c) for c in r.normal(size=3)], i % 4) for i in range(3000)]
    assert result(negatives.mine(frame(spark, rows), F.col("id") % 100 == 0, bucket=128)) == brute(rows, lambda i: i % 100 == 0)


def test_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0], 1), (1, [2.0, 1.0], 1), (2, [2.0, 0.9], 0), (3, [0.0, 0.0], 1), (4, [0.0, 0.0], 0), (5, [1.0], 1), (6, [], 1), (7, [], 0), (10, [], 1)]
    rows += [(11, None, 1), (12, [1.0, None], 1), (13, [inf, 1.0], 1), (14, [nan, 1.0], 0), (15, [1.0, 1.0], None), (None, [1.0, 1.0], 1)]
    rows += [(20, [1.0, 2.0], 1), (20, [1.0, 2.0], 1), (30, [3.0, 1.0], 2), (30, [1.0, 3.0], 0), (31, [1.0, 2.9], 2)]
    rows += [(40, [1e306, 1e300], 3), (41, [1e306, 1.0], 3), (42, [1e306, 1e305], 4), (43, [-1e6, 1e6], 3), (44, [2.5e5, 3.0e9], 4), (45, [1e5, 3.1e9], 3), (50, [1e5, 3.2e9], 3)]
    want = brute(rows, lambda i: i % 10 == 0)
    assert result(negatives.mine(frame(spark, rows), F.col("id") % 10 == 0, bucket=2, stripes=2)) == want and want
    assert negatives.mine(frame(spark, rows).limit(0), F.col("id") % 10 == 0).count() == 0
    assert negatives.mine(frame(spark, rows), F.lit(False)).count() == 0
