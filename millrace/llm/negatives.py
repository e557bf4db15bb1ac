"""Hard negatives by inner product, with buckets of like length and pruning by coordinates.

Rows are sorted by length and cut into buckets of ``BUCKET`` rows, each with a list of
its rows sorted by value for every coordinate of the unit vectors. An anchor that looks
for products of at least t needs, in a bucket of rows no longer than l, a cosine of at
least t / (|q| l). Above 1 the bucket has none. Else the cosine bounds the value of each
coordinate of a row: for the anchor's ``FOCUS`` largest coordinates the feasible ranges
are read off the sorted lists, and the rows in all of them are the candidates. These are
verified by exact products of whole numbers.

Two passes: the first finds every anchor's positives, the second the rows of other
labels in the band below each positive. The threshold t rises as results come in,
longest rows first.

Scale: anchors are a stated query set, dealt out in blocks of ``ANCHORS``; buckets go to
each block in ``STRIPES`` stripes (every stripe a task of its own, with rows of all
lengths), packed one bucket a row, and stream through sorted, so a task holds one block
of anchors and one bucket. A task returns an anchor's best few alone, however many
buckets it has seen. Nothing is grouped by label, so a label may hold any share of the
rows; a length that many rows share is cut by id.

Cases: rows with a null id or label, a null vector, or one with a null or a component
that is not finite take no part; of rows with one id the least by label and vector
counts; vectors meet those with as many components alone; zero and empty vectors have
product 0; products beyond 64 bits count as the nearest 64-bit number; ties go to the
smaller id; fewer results than asked for are returned as they are; a positive of score 0
has the band 0 to 0 and one below 0 has none; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BUCKET = 1024
ANCHORS = 1024
STRIPES = 8
FOCUS = 4
WORST = -(1 << 4200)  # below any product of finite vectors
SURE = 1 << 53  # whole numbers up to this are exact as doubles
LONG = (1 << 63) - 1


def whole(vectors: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x); as doubles where the products of all rows stay exact, else as Python's whole numbers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * float(scale))
    if np.isfinite(scaled).all() and (not scaled.size or np.abs(scaled).max() ** 2 * scaled.shape[1] < SURE):
        return scaled
    return np.array([[int(x) * scale if not np.isfinite(x * scale) else int(np.floor(x * scale)) for x in row] for row in vectors.tolist()], object).reshape(vectors.shape)


def lengths(numbers: np.ndarray) -> np.ndarray:
    """Lengths, never too short."""
    if numbers.dtype == object:
        return np.array([float(min(sum(x * x for x in row), 10**300)) for row in numbers]) ** 0.5 * (1 + 1e-9)
    return np.sqrt((numbers * numbers).sum(axis=1)) * (1 + 1e-12)


class Bucket:
    """Rows of like length and, for every coordinate, their order by its value in the unit vector."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.labels, self.numbers = ids, labels, whole(vectors)
        self.lengths = lengths(self.numbers)
        self.longest = float(self.lengths.max())
        unit = self.numbers.astype(np.float64) / np.where(self.lengths > 0, self.lengths, 1)[:, None] if self.numbers.dtype != object else None
        self.order = None if unit is None else np.argsort(unit, axis=0)
        self.sorted = None if unit is None else np.take_along_axis(unit, self.order, 0)

    def candidates(self, anchor: np.ndarray, length: float, least: float) -> np.ndarray | None:
        """Rows whose product with the anchor may be ``least`` or more; None stands for all."""
        if least <= 0 or self.sorted is None or anchor.dtype == object:
            return None
        if length == 0:
            return np.zeros(0, np.int64)
        cosine = least / (length * self.longest) * (1 - 1e-9) if self.longest else np.inf
        if cosine > 1:
            return np.zeros(0, np.int64)
        focus = np.argsort(-np.abs(anchor), kind="stable")[:FOCUS]
        q = anchor[focus].astype(np.float64) / length
        spread = np.sqrt(np.maximum(1 - q * q, 0) * (1 - cosine * cosine)) + 1e-9
        # The value of a coordinate is within q cos +- spread, and may be larger where the row's cosine may.
        low = np.where(q < -cosine, -1.0, q * cosine - spread)
        high = np.where(q > cosine, 1.0, q * cosine + spread)
        held, n = None, len(self.ids)
        for f, a, b in zip(focus, low, high, strict=True):
            values = self.sorted[:, f]
            lo, hi = np.searchsorted(values, a, "left"), np.searchsorted(values, b, "right")
            if hi - lo == n:
                continue
            inside = np.zeros(n, bool)
            inside[self.order[lo:hi, f]] = True
            held = inside if held is None else held & inside
        return None if held is None else np.flatnonzero(held)


class Best:
    """The first k of one list: higher scores first, then smaller ids."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, []

    def least(self) -> int:
        """What a row must score at least to enter."""
        return self.rows[-1][0] if len(self.rows) == self.k else WORST

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            edge = np.sort(scores)[-self.k]
            keep = scores >= edge
            scores, ids = scores[keep], ids[keep]
            if len(scores) > 4 * self.k:  # many equal ones
                above = scores > edge
                equal = np.sort(ids[~above])[: self.k]
                scores, ids = np.concatenate([scores[above], np.repeat(edge, len(equal))]), np.concatenate([ids[above], equal])
        self.rows = sorted([*self.rows, *zip((int(s) for s in scores), ids.tolist())], key=lambda r: (-r[0], r[1]))[: self.k]


class Anchor:
    """One anchor's running results: its positives, or the band below each positive it has been given."""

    def __init__(self, id_: int, label: int, vector: list[float], positives: list[tuple[int, int]] | None, k: int, low: int, high: int) -> None:
        self.id, self.label = id_, label
        self.numbers = whole(np.array([vector], np.float64))[0]
        self.length = float(lengths(self.numbers[None])[0])
        self.positives = positives
        self.bands = None if positives is None else [(-(-low * p // 100), high * p // 100) for _, p in positives]
        self.lists = [Best(k) for _ in positives or [0]]

    def least(self) -> int:
        """The lowest product that still matters."""
        if self.bands is None:
            return self.lists[0].least()
        return min((max(a, best.least()) for (a, b), best in zip(self.bands, self.lists) if a <= b), default=-WORST)

    def meet(self, bucket: Bucket) -> None:
        least = self.least()
        if least == -WORST:
            return
        rows = bucket.candidates(self.numbers, self.length, float(max(min(least, LONG), -LONG)))
        if rows is None:
            rows = np.arange(len(bucket.ids))
        other = bucket.ids[rows] != self.id
        rows = rows[other & ((bucket.labels[rows] == self.label) == (self.bands is None))]
        if not len(rows):
            return
        numbers, own = bucket.numbers[rows], self.numbers
        if numbers.dtype == object or own.dtype == object or self.length * bucket.longest >= SURE:
            exact = [sum(int(x) * int(y) for x, y in zip(row, own)) for row in numbers]
            scores = np.array([max(-LONG - 1, min(LONG, s)) for s in exact], np.int64)
        else:
            scores = (numbers @ own).astype(np.int64)
        for i, best in enumerate(self.lists):
            a, b = (WORST, -WORST) if self.bands is None else self.bands[i]
            keep = (scores >= max(a, best.least(), -LONG - 1)) & (scores <= min(b, LONG))
            if keep.any():
                best.add(scores[keep], bucket.ids[rows[keep]])


def usable(vectors: DataFrame, vec_id: str, label: Column, vector: str) -> DataFrame:
    """id, label, vector: the rows that take part, one for every id."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad)
    return rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.label", "row.vector")


def bucketed(rows: DataFrame, bucket: int = BUCKET, stripes: int = STRIPES) -> DataFrame:
    """size, stripe, rank, ids, labels, vectors: one row a bucket; the stripes take turns at the rows, longest first."""
    # Summed as doubles, a length is only the order of the rows; the bounds come from the whole numbers.
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    rows = rows.select("id", "label", "vector", F.size("vector").alias("size"), length.alias("length"), F.pmod(F.xxhash64("id"), F.lit(stripes)).alias("stripe"))
    rows = rows.repartitionByRange("size", F.desc("length"), "id").sortWithinPartitions("size", "stripe", F.desc("length"), "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, key = [], None

        def row() -> pa.RecordBatch:
            ids, labels, flat = (np.concatenate([x[i] for x in open_]) for i in range(3))
            values = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([open_[0][3]], pa.float64())]
            return pa.RecordBatch.from_arrays([*values, *(pa.array([x.tobytes()], pa.binary()) for x in (ids, labels, flat))], ["size", "stripe", "length", "ids", "labels", "vectors"])

        for batch in batches:
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            size, length, stripe = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_numpy()
            place = batch.column(2).offsets.to_numpy()
            flat = batch.column(2).values.to_numpy()
            edges = np.flatnonzero((np.diff(size) != 0) | (np.diff(stripe) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(ids)]):
                while lo < hi:
                    held = sum(len(x[0]) for x in open_)
                    if open_ and (key != (int(size[lo]), int(stripe[lo])) or held == bucket):
                        yield row()
                        open_, held = [], 0
                    key, end = (int(size[lo]), int(stripe[lo])), min(hi, lo + bucket - held)
                    open_.append((ids[lo:end], labels[lo:end], flat[place[lo] : place[end]].copy(), float(length[lo])))
                    lo = end
        if open_:
            yield row()

    return rows.mapInArrow(cut, "size int, stripe bigint, length double, ids binary, labels binary, vectors binary")


def searched(anchors: DataFrame, buckets: DataFrame, k: int, low: int = 0, high: int = 0, stripes: int = STRIPES) -> DataFrame:
    """anchor_id, positive_id, positive_score, id, score: the best ``k`` of each stripe for every list of every anchor.

    Without a column ``positives`` an anchor's list is of its own label; with it there is
    one list for each positive, of other labels.
    """
    given = "positives" in anchors.columns
    positives = F.col("positives") if given else F.lit(None).cast("array<struct<score: bigint, id: bigint>>")
    asked = anchors.select("size", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(stripes - 1).cast("bigint"))).alias("stripe"), F.lit(0).alias("asks"), F.lit(0.0).alias("length"), F.struct("id", "label", "vector", positives.alias("positives")).alias("anchor"), *[F.lit(None).cast("binary").alias(c) for c in ("ids", "labels", "vectors")])
    most = anchors.groupBy("size").agg(F.max("block").alias("last"))
    held = buckets.join(most, "size").select("size", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("block"), "stripe", F.lit(1).alias("asks"), "length", F.lit(None).cast(asked.schema["anchor"].dataType).alias("anchor"), "ids", "labels", "vectors")
    both = asked.unionByName(held).repartition("size", "block", "stripe").sortWithinPartitions("size", "block", "stripe", "asks", F.desc("length"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def results() -> pa.RecordBatch:
            out = [(a.id, *(a.positives[i] if given else (None, None)), other, score) for a in held for i, best in enumerate(a.lists) for score, other in best.rows]
            columns = list(zip(*out)) if out else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "positive_id", "positive_score", "id", "score"])

        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                here = tuple(batch.column(at[n])[i].as_py() for n in ("size", "block", "stripe"))
                if here != key:
                    if held:
                        yield results()
                    key, held = here, []
                if batch.column(at["asks"])[i].as_py() == 0:
                    a = batch.column(at["anchor"])[i].as_py()
                    listed = [(p["id"], p["score"]) for p in a["positives"]] if given else None
                    held.append(Anchor(a["id"], a["label"], a["vector"], listed, k, low, high))
                elif held:
                    ids, labels, flat = (np.frombuffer(batch.column(at[n])[i].as_buffer(), t) for n, t in (("ids", np.int64), ("labels", np.int64), ("vectors", np.float64)))
                    bucket = Bucket(ids, labels, flat.reshape(len(ids), -1))
                    for anchor in held:
                        anchor.meet(bucket)
        if held:
            yield results()

    return both.mapInArrow(run, "anchor_id bigint, positive_id bigint, positive_score bigint, id bigint, score bigint")


def mine(vectors: DataFrame, is_anchor: Column, label: Column | str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, vec_id: str = "vec_id", vector: str = "embedding", bucket: int = BUCKET, anchors: int = ANCHORS, stripes: int = STRIPES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For every anchor (``is_anchor`` over ``id``, ``label``, ``vector``) and each of its
    first ``positives`` rows of the same label, the first ``negatives`` rows of other
    labels that score from ``low`` to ``high`` percent of the positive's score.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = scratch.store(usable(vectors, vec_id, F.col(label) if isinstance(label, str) else label, vector), "negatives-rows")
    buckets = scratch.store(bucketed(rows, bucket, stripes), "negatives-buckets")
    chosen = rows.filter(is_anchor).withColumn("size", F.size("vector"))
    blocks = chosen.groupBy("size").agg(F.ceil(F.count("*") / anchors).alias("blocks"))
    chosen = chosen.join(blocks, "size").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("blocks")
    near = searched(chosen, buckets, positives, stripes=stripes)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    near = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    near = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("positives"))
    near = scratch.store(chosen.join(near, chosen["id"] == near["anchor_id"]).drop("anchor_id"), "negatives-anchors")
    found = searched(near, buckets, negatives, low, high, stripes)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
