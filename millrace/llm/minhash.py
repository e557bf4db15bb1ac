"""Near-duplicates by one-permutation MinHash with optimal densification.

A document's set holds its distinct shingles of five words. One hash of a shingle
gives both its bin and its value in it; the least value of each bin is the signature,
and an empty bin takes over that of the first filled bin in its own random sequence of
bins (optimal densification). Bands of the signature are bucket keys. A bucket gives
star-shaped candidate edges, from its members to a few centres, so candidates grow
with the members and never with their square. Candidates are confirmed on full sets.

Bands: 36 of 7 rows. Two sets at the threshold of 0.85 miss every common bucket with
probability (1 - 0.85^7)^36, about 9e-7. A star misses a link between two members that
are both far from its centre. So the centre is the member with the smallest share of
shingles that no other crowded node holds (a crowded node shares a bucket with at least
two more), as the edits of near copies are such shingles. Where a bucket still holds
several components, each member outside the largest is held against the others by an
exact bound: what two sets share is at most, summed over ``PROFILE`` classes of shingles,
the smaller number of shared shingles either has in the class. Whatever the bound leaves
is confirmed, the likeliest partners first, until nothing is left.

Scale: documents with equal sets are one node, so copies meet once. Buckets, pairs and
links are joined on their keys with aggregates combined on the map side; a bucket that
holds a third of all nodes is only ever joined, which adaptive execution splits, or cut
into a grid. Shingles of crowded nodes are counted in one aggregate that leaves only those
of a single node. Pairs that the bound leaves a chance meet by their texts, which are
smaller than their sets, in a second grid: a text is sent once to a cell, not once a pair.

Cases: a null or empty text, or one of white space, has an empty set and is linked
with nothing; with fewer than five words the whole sequence is the one shingle; rows
with one doc_id count as one document; a null doc_id never names a component unless
its group has no other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructType

from .common import SPACED, Scratch, mix, pieces, ranges_hash, with_columns, words
from .components import components

SHINGLE = 5
BANDS, ROWS = 36, 7
BINS = BANDS * ROWS
NEAREST = 4  # partners of a member in the first round of the rescue
GRID = 4096
CELL = 256  # texts a side of the cells that confirm pairs
PROFILE = 512  # classes of shingles in the bound on what two sets share
_TRIES = np.random.default_rng(11).integers(0, BINS, (4096, BINS))
_LANES = np.random.default_rng(12).integers(1, 1 << 62, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    found = words(texts, SPACED)
    hashes = found.hashes()
    at = np.arange(max(0, len(hashes) - shingle + 1))
    rolled = ranges_hash(hashes, at, at + shingle)
    out = []
    for lo, hi in zip(found.first[:-1], found.first[1:], strict=True):
        if hi - lo >= shingle:
            out.append(np.unique(rolled[lo : hi - shingle + 1]))
        else:
            out.append(ranges_hash(hashes, np.array([lo]), np.array([hi])) if hi > lo else rolled[:0])
    return out


def signature(own: np.ndarray) -> np.ndarray:
    """One value per bin of a non-empty sorted set."""
    bins = (((own >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    firsts = np.flatnonzero(np.diff(bins, prepend=-1))
    out = np.zeros(BINS, np.uint64)
    filled = np.zeros(BINS, bool)
    out[bins[firsts]] = own[firsts]
    filled[bins[firsts]] = True
    empty = np.flatnonzero(~filled)
    step = 32 if len(firsts) > 32 else 512
    for k in range(0, len(_TRIES), step):
        if not len(empty):
            break
        tries = _TRIES[k : k + step, empty]
        hit = filled[tries]
        first = hit.argmax(axis=0)
        found = hit[first, np.arange(len(empty))]
        out[empty[found]] = out[tries[first[found], np.flatnonzero(found)]]
        empty = empty[~found]
    if len(empty):
        out[empty] = own[0]
    return out


def classes(own: np.ndarray) -> np.ndarray:
    """The class of each shingle, by bits that the signature leaves alone."""
    return (((own & np.uint64(0xFFFFFFFF)) * np.uint64(PROFILE)) >> np.uint64(32)).astype(np.int64)


def profile(own: np.ndarray) -> bytes | None:
    """The number of shingles in every class, a byte each; None where one does not fit."""
    counts = np.bincount(classes(own), minlength=PROFILE)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def _sign(texts: pa.Array) -> list[pa.Array]:
    sets = shingle_sets(texts)
    signed = np.array([signature(s) for s in sets if len(s)], np.uint64).reshape(-1, BANDS, ROWS)
    numbers = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    buckets = iter(mix((signed * _LANES).sum(axis=2, dtype=np.uint64) + numbers).view(np.int64))
    digests = [[int(mix(s ^ np.uint64(c)).sum(dtype=np.uint64).view(np.int64)) for s in sets] for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return [
        pa.array([len(s) for s in sets], pa.int64()),
        *(pa.array(d, pa.int64()) for d in digests),
        pa.array([next(buckets) if len(s) else None for s in sets], pa.list_(pa.int64())),
        pa.array([profile(s) for s in sets], pa.binary()),
    ]


@F.arrow_udf(LongType())
def _most_shared(a: pa.Array, b: pa.Array) -> pa.Array:
    """What two sets share at most by their profiles; null where one has none."""
    known = [x is not None and y is not None for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
    left, right = (np.frombuffer(b"".join(x.filter(pa.array(known, pa.bool_())).to_pylist()), np.uint8).reshape(-1, PROFILE) for x in (a, b))
    most = iter(np.minimum(left, right).sum(axis=1, dtype=np.int64).tolist())
    return pa.array([next(most) if k else None for k in known], pa.int64())


@F.arrow_udf(BinaryType())
def _without(profiles: pa.Array, single: pa.Array) -> pa.Array:
    """Profiles less the classes of the shingles to leave out."""
    out = []
    for x, gone in zip(profiles.to_pylist(), single.to_pylist(), strict=True):
        out.append(x and (np.frombuffer(x, np.uint8) - np.bincount(np.array(gone or [], np.int64), minlength=PROFILE)).astype(np.uint8).tobytes())
    return pa.array(out, pa.binary())


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, text) of some nodes."""
    return docs.join(nodes, F.col("doc_id") == F.col("node"), "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text")


def _shared_profiles(crowded: DataFrame, nodes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, n_shingles, live, profile) of crowded nodes; live and profile count shingles that another one holds too."""
    crowded = scratch.store(crowded.select("node").distinct(), "minhash-crowded")

    def listed(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([s.view(np.int64) for s in shingle_sets(texts)], pa.list_(pa.int64()))]

    own = with_columns(_texts(docs, crowded), "text", "shingles array<bigint>", listed).select(F.col("doc_id").alias("node"), F.explode("shingles").alias("shingle"))
    single = own.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1")
    at = F.shiftright(F.col("shingle").bitwiseAND(0xFFFFFFFF) * PROFILE, 32).cast("int")
    single = single.groupBy("node").agg(F.collect_list(at).alias("single"))  # no more than a document's shingles
    live = crowded.join(nodes.select("node", "n_shingles", "profile"), "node").join(single, "node", "left")
    live = live.select("node", "n_shingles", (F.col("n_shingles") - F.coalesce(F.size("single"), F.lit(0))).alias("live"), _without("profile", "single").alias("profile"))
    return scratch.store(live, "minhash-live")


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Of candidate pairs (a, b), those with 100 * intersection >= percent * union, on full sets."""
    brief = nodes.select("node", "n_shingles", "profile")
    known = pairs.join(brief.toDF("a", "n_a", "profile_a"), "a").join(brief.toDF("b", "n_b", "profile_b"), "b")
    known = known.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    known = known.withColumn("most", F.coalesce(_most_shared("profile_a", "profile_b"), F.least("n_a", "n_b")))
    known = scratch.store(known.filter(100 * F.col("most") >= percent * (F.col("n_a") + F.col("n_b") - F.col("most"))).select("a", "b"), "minhash-pairs")
    ends = scratch.store(_ends(known), "minhash-ends")
    texts = scratch.store(_texts(docs, ends), "minhash-texts")

    blocks = max(1, -(-ends.count() // CELL))
    kind = nodes.schema["node"].dataType.simpleString()
    at = known.select(*[F.pmod(F.xxhash64(x), F.lit(blocks)).alias(f"cell_{x}") for x in ("a", "b")], "a", "b")
    asks = at.groupBy("cell_a", "cell_b", F.col("a").alias("node")).agg(F.collect_list("b").alias("others"))  # about CELL at most
    told = at.select("cell_a", "cell_b", F.col("b").alias("node")).distinct().withColumn("others", F.lit(None).cast(f"array<{kind}>"))
    met = asks.unionByName(told).join(texts, F.col("node") == F.col("doc_id")).select("cell_a", "cell_b", "node", "others", "text")

    def linked(cell: list[pa.RecordBatch]) -> list[tuple]:
        asks, sets = [], {}
        for batch in cell:
            ids, texts = batch.column("node").to_pylist(), batch.column("text")
            for lo, hi in pieces(texts):
                sets.update(zip(ids[lo:hi], shingle_sets(texts.slice(lo, hi - lo)), strict=True))
            asks += [(a, others) for a, others in zip(ids, batch.column("others").to_pylist(), strict=True) if others is not None]
        out = []
        for a, others in asks:
            own, sizes = sets[a], np.array([len(sets[b]) for b in others])
            there = np.concatenate([sets[b] for b in others])
            hit = own[np.minimum(np.searchsorted(own, there), len(own) - 1)] == there
            both = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
            out += [(a, b) for b, ok in zip(others, 100 * both >= percent * (len(own) + sizes - both), strict=True) if ok]
        return out

    return _by_cell(met, ["cell_a", "cell_b"], linked, f"a {kind}, b {kind}")


def _by_cell(rows: DataFrame, cells: list[str], work: Callable[[list[pa.RecordBatch]], list[tuple]], schema: str) -> DataFrame:
    """``work`` on the rows of each cell, with one cell and one Arrow batch in memory."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def done(cell: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if made := work(cell):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in cells])
            if held and (keys[:, 0] != last).any():
                yield from done(held)
                held = []
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo:
                    yield from done(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
            last = keys[:, -1]
        if held:
            yield from done(held)
        held = None
        pa.default_memory_pool().release_unused()

    return rows.repartition(*cells).sortWithinPartitions(*cells).mapInArrow(stream, schema)


def _rescue(crowded: DataFrame, live: DataFrame, percent: int, nearest: int, scratch: Scratch) -> DataFrame:
    """Candidates for the members of a bucket outside its largest component.

    Each meets the members of other components, leaves out those that sizes and profiles
    rule out, and keeps the ``nearest`` likeliest; ``cut`` tells of a member that has more.
    A bucket is cut into a grid of about ``GRID`` by ``GRID`` members.
    """
    sizes = crowded.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n"))
    main = main.select("bucket", F.col("main.component").alias("main"), F.ceil(F.col("n") / GRID).alias("blocks"), F.ceil((F.col("n") - F.col("main.n")) / GRID).alias("rounds"))
    alive = live.filter(100 * F.col("live") >= percent * F.col("n_shingles"))  # the others link with nobody
    rows = crowded.join(main, "bucket").join(alive, "node")
    seat = F.xxhash64("node", "bucket")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    cells = ["bucket", "block", "round"]
    told = ["node", "component", "n_shingles", "live", "profile", "asks"]
    members = rows.withColumn("block", F.pmod(seat, F.col("blocks"))).withColumn("round", every("rounds")).withColumn("asks", F.lit(False))
    asking = rows.filter("component <> main").withColumn("round", F.pmod(seat, F.col("rounds"))).withColumn("block", every("blocks")).withColumn("asks", F.lit(True))
    met = members.select(*cells, *told).unionByName(asking.select(*cells, *told))

    def pairs(cell: list[pa.RecordBatch]) -> list[tuple]:
        rows = pa.Table.from_batches(cell).combine_chunks()
        asks, n, live = (rows.column(c).to_numpy() for c in ("asks", "n_shingles", "live"))
        if asks.all() or not asks.any():
            return []
        ids, component = rows.column("node").to_pylist(), rows.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
        own = rows.column("profile").to_pylist()
        known = np.array([x is not None for x in own])
        profiles = np.frombuffer(b"".join(x or bytes(PROFILE) for x in own), np.uint8).reshape(-1, PROFILE)
        out = []
        for a in np.flatnonzero(asks):
            most = np.minimum(live, live[a])
            left = np.flatnonzero(~asks & (component != component[a]) & (100 * most >= percent * (n + n[a] - most)))
            most = np.where(known[left] & known[a], np.minimum(profiles[left], profiles[a]).sum(axis=1, dtype=np.int64), most[left])
            union = n[left] + n[a] - most
            fits = 100 * most >= percent * union
            left, share = left[fits], most[fits] / union[fits]
            cut = len(left) > nearest
            out += [(min(ids[a], ids[k]), max(ids[a], ids[k]), cut) for k in left[np.argsort(-share, kind="stable")[:nearest]]]
        return out

    kind = live.schema["node"].dataType.simpleString()
    return scratch.store(_by_cell(met, cells, pairs, f"a {kind}, b {kind}, cut boolean").groupBy("a", "b").agg(F.max("cut").alias("cut")), "minhash-rescue")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id linked, however far) and kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = with_columns(docs, "text", "n_shingles bigint, d1 bigint, d2 bigint, buckets array<bigint>, profile binary", _sign)
    signed = scratch.store(signed.drop("text"), "minhash-signed")
    same = ["n_shingles", "d1", "d2"]
    groups = scratch.store(signed.filter("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("node")), "minhash-groups")
    nodes = signed.join(groups.filter("node IS NOT NULL"), [*same]).filter("doc_id = node").select("node", "n_shingles", "buckets", "profile").dropDuplicates(["node"])
    nodes = scratch.store(nodes, "minhash-nodes")
    members = nodes.select("node", F.explode("buckets").alias("bucket"))
    full = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket", (F.col("n") > 2).alias("crowded"))
    members = scratch.store(members.join(full, "bucket"), "minhash-buckets")
    crowded = members.filter("crowded").select("bucket", "node")
    live = _shared_profiles(crowded, nodes, docs, scratch)
    # A node that leads does so in all buckets it shares, so its pairs repeat and fall together.
    lead = F.min(F.struct(F.coalesce("alone", F.lit(0.0)), F.xxhash64("node"), F.col("node").alias("node"))).alias("lead")
    alone = live.select("node", (1 - F.col("live") / F.col("n_shingles")).alias("alone"))
    stars = members.join(alone, "node", "left").groupBy("bucket").agg(lead).select("bucket", F.col("lead.node").alias("centre"))
    pairs = members.join(stars, "bucket").filter("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    tested = scratch.store(pairs, "minhash-tested")
    links = scratch.store(_confirmed(tested, nodes, docs, percent, scratch), "minhash-links")
    joined = components(links)
    nearest, cut = NEAREST, True
    while cut:
        at = crowded.join(joined, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
        open_ = at.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket")
        at = scratch.store(at.join(open_, "bucket", "left_semi"), "minhash-open")
        met = _rescue(at, live, percent, nearest, scratch)
        cut = not met.filter("cut").isEmpty()
        more = scratch.store(met.select("a", "b").join(tested, ["a", "b"], "left_anti"), "minhash-more")
        found = scratch.store(_confirmed(more, nodes, docs, percent, scratch), "minhash-links")
        if not found.isEmpty():
            joined = components(joined.toDF("a", "b").unionByName(found))
        tested, crowded, nearest = tested.unionByName(more), at.select("bucket", "node"), 4 * nearest
    of_group = groups.join(joined, "node", "left").select(*[F.col(c).alias(f"__{c}") for c in same], F.coalesce("component", "node").alias("component_id"))
    out = signed.join(of_group, (F.col("n_shingles") == F.col("__n_shingles")) & (F.col("d1") == F.col("__d1")) & (F.col("d2") == F.col("__d2")), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """The documents without those that another of their group stands for."""
    gone = near_duplicates(docs, doc_id, text, percent).filter("NOT kept").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col(doc_id) == F.col("__gone"), "left_anti")
