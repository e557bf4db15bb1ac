"""Sharding by fixed virtual slots.

A record's hash gives one of ``SLOTS`` virtual slots. The bytes of each slot are
summed, and a versioned map says which shard a slot belongs to. Rebalancing edits the
map: it moves or swaps whole slots until the shards' bytes are near equal, and writes
the map under the next version. Placing a record needs its hash and the map only.

Scale: texts are read once and never shuffled; what moves is a few numbers per
record. The map has ``SLOTS`` rows at any size, so the driver edits it and it is
broadcast. Records are numbered per slot and input partition, so no slot needs to fit
in one task.

Cases: a null text has no bytes, so size 1, and a null checksum; equal rows are numbered
and spread over slots by number, so any share of them fits under near equal shards
(``place`` sees no numbers: give it a column that tells them apart); an empty table gives no rows and an even map.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ordinal_within, stamped

SLOTS = 4096
TOLERANCE = 1e-4


def slot_of(keys: list[str], slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def size_of(text: str) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def even_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 1: slots dealt to shards in turn."""
    return [k % shards for k in range(slots)]


def rebalance(shard_of: list[int], slot_bytes: dict[int, int], shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """An edited map whose heaviest and lightest shards differ by few bytes.

    Each edit moves a slot from the heaviest shard to the lightest, or swaps two of
    their slots, and lowers the difference; slots that need not move stay.
    """
    edited = list(shard_of)
    load = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(edited):
        load[shard] += slot_bytes.get(slot, 0)
        held[shard].append((slot_bytes.get(slot, 0), slot))
    for own in held:
        own.sort()
    enough = tolerance * sum(load) / max(shards, 1)

    def move(entry: tuple[int, int], a: int, b: int) -> None:
        del held[a][bisect_left(held[a], entry)]
        insort(held[b], entry)
        load[a] -= entry[0]
        load[b] += entry[0]
        edited[entry[1]] = b

    while True:
        a, b = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[a] - load[b]
        if gap <= enough:
            return edited
        best: tuple[int, tuple[int, int], tuple[int, int] | None] | None = None
        for back in [None, *held[b]]:
            want = gap // 2 + (back[0] if back else 0)
            k = bisect_left(held[a], (want, -1))
            for entry in held[a][max(0, k - 1) : k + 1]:
                moved = entry[0] - (back[0] if back else 0)
                if 0 < moved < gap and (best is None or abs(gap - 2 * moved) < best[0]):
                    best = (abs(gap - 2 * moved), entry, back)
        if best is None:
            return edited
        move(best[1], a, b)
        if best[2]:
            move(best[2], b, a)


def save_map(spark: SparkSession, shard_of: list[int], version: int, path: str) -> DataFrame:
    """Write a map as ``path/version=N`` and read it back; earlier versions stay."""
    rows = [(k, s) for k, s in enumerate(shard_of)]
    spark.createDataFrame(rows, "virtual_slot int, shard int").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")
    return load_map(spark, path, version)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version}")


def place(docs: DataFrame, slot_map: DataFrame, keys: list[str], slots: int = SLOTS) -> DataFrame:
    """Add virtual_slot and shard: a projection and a broadcast of ``slots`` rows."""
    docs = docs.drop("virtual_slot", "shard").withColumn("virtual_slot", slot_of(keys, slots))
    return docs.join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot")


def assign(docs: DataFrame, shards: int = 8, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per record: doc_id, size, text_crc32, virtual_slot, map_version, shard and its place ``slot`` in the shard."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    records = docs.select(F.col(doc_id).alias("doc_id"), size_of(text).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(doc_id, text).alias("__hash"))
    records = scratch.store(stamped(records), "shard-records")
    # The first of equal rows keeps the slot of its hash; the others' numbers take them to slots of their own.
    copy = F.when(F.col("__copy") == 0, F.col("__hash")).otherwise(F.xxhash64("__hash", "__copy"))
    records = ordinal_within(records, ["doc_id", "__hash"], "__copy").withColumn("virtual_slot", F.pmod(copy, F.lit(slots)).cast("int"))
    records = scratch.store(records.drop("__hash", "__copy"), "shard-slots")
    totals = {r.virtual_slot: (r.n, r.b) for r in records.groupBy("virtual_slot").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}  # at most ``slots`` rows
    first = even_map(shards, slots)
    edited = rebalance(first, {k: b for k, (_, b) in totals.items()}, shards)
    path = f"{scratch.paths[0]}-map"
    save_map(spark, first, 1, path)
    placed = save_map(spark, edited, 2, path)
    begins, ahead = [], [0] * shards
    for k, shard in enumerate(edited):
        begins.append((k, ahead[shard]))
        ahead[shard] += totals.get(k, (0, 0))[0]
    placed = placed.join(F.broadcast(spark.createDataFrame(begins, "virtual_slot int, begin bigint")), "virtual_slot")
    numbered = ordinal_within(records, ["virtual_slot"], "__in_slot").join(F.broadcast(placed), "virtual_slot")
    return numbered.select("doc_id", "size", "text_crc32", "virtual_slot", F.lit(2).alias("map_version"), "shard", (F.col("begin") + F.col("__in_slot")).alias("slot"))
