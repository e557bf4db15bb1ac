"""Approximate nearest neighbours by a forest of random-projection trees.

Fitting: every tree splits a bounded sample by hyperplanes halfway between two random
points until ``LEAF`` points are left. Indexing: every row is routed to its leaf in
every tree. Searching: one priority queue per query, shared by all trees, holds the
branches not taken with the least margin on the way to them; leaves come off it until
they hold ``SHARE`` of all rows of all trees, and are ``VISITS`` at least. Reranking: the rows of those leaves are compared by exact
cosine in double precision.

Scale: the forest is fitted on at most about ``SAMPLE`` rows, so its size is bounded
and it is broadcast. Rows meet queries by leaf; a leaf with more than ``BLOCK`` rows
is cut into blocks that its queries are sent to, themselves in blocks, so no task
holds an unbounded leaf, and a block returns only each query's best few. Equal vectors are one entry with their
``k + 1`` smallest ids, which is all that any result can name, so copies of one vector
do not multiply the work. The leaves visited hold a fixed share of the rows, however many
leaves the drawn sample gives: vectors without structure, where the nearest is hardly
nearer than the rest, need 0.3 for a recall of 0.9 and more, which is the default. On clustered vectors many small
leaves (a larger ``sample`` and a smaller ``leaf``) reach it with a
thousandth (a smaller ``share``).

Cases: vectors that are null, zero, or hold a null or a number that is not finite take
no part, nor do rows with a null id; vectors meet those with as many components alone,
each number of components being a search of its own; vectors whose squares would leave
the range of a double are scaled first, which no cosine shows; with fewer candidates than k all found are returned; ties go to the smaller
id; rows with one id and vector count once; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, stamped

SAMPLE = 16_384
TREES = 4
LEAF = 256
VISITS = 72
SHARE = 0.3
BLOCK = 2048
K = 5


@dataclass
class Forest:
    """Nodes of all trees: a plane, its offset, and two children; a child below 0 is leaf -1 - child."""

    planes: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: np.ndarray
    leaves: int


def fit(sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 5) -> Forest:
    rng = np.random.default_rng(seed)
    planes, offsets, children, roots, leaves = [], [], [], [], 0
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    for _ in range(trees):
        todo = [(np.arange(len(unit)), -1, 0)]
        roots.append(None)
        while todo:
            rows, parent, side = todo.pop()
            halves = None
            if len(rows) > leaf:
                for _try in range(4):
                    a, b = unit[rng.choice(rows, 2, replace=False)]
                    plane = a - b
                    margin = unit[rows] @ plane
                    offset = float(np.median(margin))
                    left = margin <= offset
                    if 0 < left.sum() < len(rows):
                        halves = rows[left], rows[~left]
                        break
            if halves is None:
                here = -1 - leaves
                leaves += 1
            else:
                here = len(planes)
                planes.append(plane)
                offsets.append(offset)
                children.append([0, 0])
                todo += [(halves[0], here, 0), (halves[1], here, 1)]
            if parent < 0:
                roots[-1] = here
            else:
                children[parent][side] = here
    wide = unit.shape[1] if unit.ndim == 2 else 0
    return Forest(np.array(planes).reshape(-1, wide), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), np.array(roots), leaves)


def route(forest: Forest, vectors: np.ndarray) -> np.ndarray:
    """The leaf of every vector in every tree."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = np.empty((len(unit), len(forest.roots)), np.int64)
    for t, root in enumerate(forest.roots):
        at = np.full(len(unit), root)
        while (open_ := np.flatnonzero(at >= 0)).size:
            node = at[open_]
            right = np.einsum("ij,ij->i", unit[open_], forest.planes[node]) > forest.offsets[node]
            at[open_] = forest.children[node, right.astype(int)]
        out[:, t] = -1 - at
    return out


def search(forest: Forest, vector: np.ndarray, visits: int, sizes: np.ndarray, rows: float) -> list[int]:
    """The leaves to look into, best first, from one queue over all trees, until they are ``visits`` and hold ``rows`` of ``sizes``."""
    margins = forest.planes @ (vector / np.linalg.norm(vector)) - forest.offsets if len(forest.planes) else forest.offsets
    queue = [(-np.inf, int(r)) for r in forest.roots]
    heapq.heapify(queue)
    found: list[int] = []
    held = 0
    while queue and (len(found) < visits or held < rows):
        worst, node = heapq.heappop(queue)
        if node < 0:
            found.append(-1 - node)
            held += sizes[-1 - node]
            continue
        m = margins[node]
        near, far = forest.children[node, int(m > 0)], forest.children[node, int(m <= 0)]
        heapq.heappush(queue, (worst, int(near)))
        heapq.heappush(queue, (max(worst, abs(m)), int(far)))
    return found


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def in_range(vector: Column) -> Column:
    """The vector, scaled where the square of its largest component would overflow or vanish."""
    most = F.array_max(F.transform(vector, F.abs))
    return F.when((most > 1e100) | (most < 1e-100), F.transform(vector, lambda x: x / most)).otherwise(vector)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.to_list(), np.float64)


def _best(queries: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of a block for each query, never its own id; scores depend on the two vectors alone."""
    q, x = _matrix(queries["vector"]), _matrix(block["vector"])
    lengths_q, lengths_x = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    rough = (q @ x.T) / lengths_q[:, None] / lengths_x
    if len(x) > k + 1:
        least = np.partition(rough, len(x) - k - 1, axis=1)[:, len(x) - k - 1] - 1e-9
        a, b = np.nonzero(rough >= least[:, None])
    else:
        a, b = (g.ravel() for g in np.indices(rough.shape))
    exact = (q[a] * x[b]).sum(axis=1) / (lengths_q[a] * lengths_x[b])
    ids = block["ids"].to_list()
    many = np.array([len(v) for v in ids])[b]
    found = pd.DataFrame({
        "query_id": np.repeat(queries["id"].to_numpy()[a], many),
        "vec_id": np.concatenate([ids[i] for i in b]) if len(b) else np.zeros(0, np.int64),
        "score": np.repeat(exact, many),
    })
    found = found[found["query_id"] != found["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return found.groupby("query_id").head(k)


def neighbours(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, visits: int = VISITS, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that ``is_query`` holds for."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.filter(F.col(vec_id).isNotNull()).select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = scratch.store(stamped(rows.filter(usable(F.col("vector"))).withColumn("vector", in_range(F.col("vector")))), "ann-rows")
    sizes = [r.size for r in rows.select(F.size("vector").alias("size")).distinct().collect()]
    found = [_search(rows.filter(F.size("vector") == size), size, scratch, k, sample, trees, leaf, visits, share) for size in sizes]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], f"query_id {rows.schema['id'].dataType.simpleString()}, rank int, vec_id {rows.schema['id'].dataType.simpleString()}, score double")


def _search(rows: DataFrame, size: int, scratch: Scratch, k: int, sample: int, trees: int, leaf: int, visits: int, share: float) -> DataFrame:
    """The search among stored rows of one number of components."""
    spark = rows.sparkSession
    # Of equal vectors, the smallest ids: first within each partition, then over all.
    few = rows
    for keys in (["vector", "__part"], ["vector"]):
        few = few.dropDuplicates(["id", "vector"]) if keys == ["vector"] else few
        few = few.withColumn("__i", F.dense_rank().over(Window.partitionBy(*keys).orderBy("id"))).filter(F.col("__i") <= k + 1)
    entries = few.groupBy("vector").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    entries = scratch.store(entries, "ann-entries")
    total = entries.count()
    drawn = entries.filter(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < int(min(1.0, sample / total) * (1 << 30)) + 1)
    forest = fit(_matrix(drawn.select("vector").toPandas()["vector"]) if total else np.zeros((0, size)), trees, leaf)
    shared = spark.sparkContext.broadcast(forest)

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"leaf": list(route(shared.value, _matrix(batch["vector"]))), "vector": batch["vector"], "ids": batch["ids"]})

    def sought(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"id": batch["id"], "vector": batch["vector"], "leaf": [search(shared.value, v, visits, sizes, share * sizes.sum()) for v in _matrix(batch["vector"])]})

    id_type = rows.schema["id"].dataType.simpleString()
    indexed = entries.mapInPandas(routed, f"leaf array<bigint>, vector array<double>, ids array<{id_type}>")
    indexed = indexed.select(F.explode("leaf").alias("leaf"), "vector", "ids").withColumn("__h", F.pmod(F.xxhash64("vector"), F.lit(1 << 30)))
    indexed = scratch.store(indexed, "ann-index")
    sizes = np.zeros(forest.leaves, np.int64)
    for row in indexed.groupBy("leaf").agg(F.count("*").alias("n")).collect():  # as many as the forest has leaves
        sizes[row.leaf] = row.n
    asked = rows.filter("is_query").dropDuplicates(["id", "vector"]).select("id", "vector").mapInPandas(sought, f"id {id_type}, vector array<double>, leaf array<bigint>")
    asked = scratch.store(asked.select("id", "vector", F.explode("leaf").alias("leaf")), "ann-asked")
    # A leaf is a grid of blocks of rows and blocks of queries.
    grid = indexed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).join(asked.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("rounds")), "leaf")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    asked = asked.join(grid, "leaf").select("leaf", every("blocks").alias("block"), F.pmod(F.xxhash64("id"), F.col("rounds")).alias("round"), "id", "vector")
    held = indexed.join(grid, "leaf").select("leaf", F.pmod("__h", F.col("blocks")).alias("block"), every("rounds").alias("round"), "vector", "ids")

    def meet(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return _best(queries, block, k)

    met = asked.groupBy("leaf", "block", "round").cogroup(held.groupBy("leaf", "block", "round")).applyInPandas(meet, f"query_id {id_type}, vec_id {id_type}, score double")
    met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
