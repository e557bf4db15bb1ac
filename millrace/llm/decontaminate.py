"""Benchmark decontamination: a broadcast set of hashed benchmark windows, scanned over all documents.

A benchmark item gives windows of ``size`` consecutive words (an item with fewer
words is one window). Each document's windows are hashed in arrays, looked up in the
broadcast hashes, and every hit is compared word by word before it counts.

Scale: documents are never shuffled. The benchmark is cut into slices of at most
``SLICE`` bytes of text (a slice holds one item at least); one slice is broadcast at
a time and the marks of all slices are merged, so a benchmark of any size works and
what a task holds is bounded.

Cases: a null or empty text has no words and is never contaminated; repeated rows
are each judged; an item without words has no windows; an item with a null id marks
words but is not listed; with an empty benchmark nothing is hit; an input column
named like a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, Scratch, Words, ranges_hash, with_columns, words

SIZE = 13
SLICE = 32 << 20
_FILTER_BITS = 20


@dataclass
class Windows:
    """The windows of one slice: per length, sorted hashes, and what each stands for."""

    lengths: dict[int, tuple[np.ndarray, np.ndarray]]
    meaning: dict[tuple[int, int], dict[bytes, list[str]]]


def _spelled(found: Words, lo: int, hi: int) -> bytes:
    return b" ".join(found.data[found.starts[k] : found.ends[k]].tobytes() for k in range(lo, hi))


def item_windows(items: list[tuple[str | None, str | None]], size: int = SIZE) -> Windows:
    meaning: dict[tuple[int, int], dict[bytes, list[str]]] = {}
    for item, text in items:
        found = words(pa.array([text], pa.string()), LETTERS)
        n = len(found.starts)
        if not n:
            continue
        long = min(n, size)
        at = np.arange(n - long + 1)
        for i, h in zip(at, ranges_hash(found.hashes(), at, at + long).tolist(), strict=True):
            named = meaning.setdefault((long, h), {}).setdefault(_spelled(found, i, i + long), [])
            if item is not None and item not in named:
                named.append(item)
    lengths = {}
    for long in {k[0] for k in meaning}:
        hashes = np.array(sorted(h for n, h in meaning if n == long), np.uint64)
        likely = np.zeros(1 << _FILTER_BITS, bool)
        likely[hashes >> np.uint64(64 - _FILTER_BITS)] = True
        lengths[long] = (hashes, likely)
    return Windows(lengths, meaning)


def scan(texts: pa.Array, windows: Windows) -> list[pa.Array]:
    """Per text: number of words, [first, last) word of each hit run, bytes of each hit run, items found."""
    found = words(texts, LETTERS)
    n = len(found.starts)
    marks = np.zeros(n + 1, np.int64)
    items: dict[int, set[str]] = {}
    if n:
        hashes = found.hashes()
        per_text = np.diff(found.first)
        last = np.repeat(found.first[1:], per_text)
        owner = np.repeat(np.arange(len(texts)), per_text)
        for long, (known, likely) in windows.lengths.items():
            if n < long:
                continue
            at = np.arange(n - long + 1)
            at = at[at + long <= last[: n - long + 1]]
            h = ranges_hash(hashes, at, at + long)
            keep = likely[h >> np.uint64(64 - _FILTER_BITS)]
            at, h = at[keep], h[keep]
            where = np.minimum(np.searchsorted(known, h), len(known) - 1)
            keep = known[where] == h
            for i, value in zip(at[keep].tolist(), h[keep].tolist(), strict=True):
                named = windows.meaning[long, value].get(_spelled(found, i, i + long))
                if named is not None:
                    marks[i] += 1
                    marks[i + long] -= 1
                    items.setdefault(int(owner[i]), set()).update(named)
    hit = np.cumsum(marks)[:n] > 0
    spans: list[list[dict]] = []
    total = np.concatenate([[0], np.cumsum(hit)])
    for k in range(len(texts)):
        lo, hi = found.first[k], found.first[k + 1]
        runs = []
        if total[hi] > total[lo]:
            edge = np.diff(np.concatenate([[0], hit[lo:hi].astype(np.int8), [0]]))
            for a, b in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), strict=True):
                runs.append({"first": int(a), "last": int(b), "start": int(found.starts[lo + a] - found.bounds[k]), "end": int(found.ends[lo + b - 1] - found.bounds[k])})
        spans.append(runs)
    span_type = pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "last", "start", "end")]))
    return [pa.array(np.diff(found.first), pa.int64()), pa.array(spans, span_type), pa.array([sorted(items.get(k, ())) for k in range(len(texts))], pa.list_(pa.string()))]


_ADDED = "n_words bigint, spans array<struct<first: bigint, last: bigint, start: bigint, end: bigint>>, items array<string>"


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE, slice_bytes: int = SLICE) -> DataFrame:
    """Add n_words, spans (hit runs by word and by UTF-8 byte), items, n_hit and contaminated.

    A document is contaminated when at least a twentieth of its words, and at least
    one, is hit.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_slices = 1 + total // slice_bytes
    kept = [c for c in docs.columns if c not in ("n_words", "spans", "items", "n_hit", "contaminated")]
    out = docs.select(*kept)
    for k in range(n_slices):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_slices)) == k).collect()
        shared = spark.sparkContext.broadcast(item_windows([(r.item, r.text) for r in rows], size))
        found = with_columns(out.select(*kept, *([F.col("spans").alias("__spans"), F.col("items").alias("__items")] if k else [])), text, _ADDED, lambda texts, shared=shared: scan(texts, shared.value))
        if k:
            found = found.withColumn("spans", _merged(F.concat("__spans", "spans"))).withColumn("items", F.array_sort(F.array_union("__items", "items"))).drop("__spans", "__items")
        out = scratch.store(found, "decontaminate") if k < n_slices - 1 else found
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"])
    out = out.withColumn("n_hit", n_hit)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _merged(spans):
    """Runs of several slices as maximal runs."""
    empty = F.array().cast("array<struct<first: bigint, last: bigint, start: bigint, end: bigint>>")

    def add(done, s):
        open_ = F.element_at(done, -1)
        joined = F.struct(open_["first"].alias("first"), F.greatest(open_["last"], s["last"]).alias("last"), open_["start"].alias("start"), F.greatest(open_["end"], s["end"]).alias("end"))
        touches = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["last"] >= s["first"])
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), empty, add)


def remove_documents(found: DataFrame) -> DataFrame:
    """Only the clean documents, with their own columns."""
    return found.filter(~F.col("contaminated")).drop("n_words", "spans", "items", "n_hit", "contaminated")


def remove_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """The text without its hit runs, where each hit run falls to one space."""

    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for value, runs in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if value is not None and runs:
                raw, at, left = value.encode(), 0, []
                for r in runs:
                    left.append(raw[at : r["start"]])
                    at = r["end"]
                value = b" ".join([*left, raw[at:]]).decode()
            out.append(value)
        return pa.array(out, pa.string())

    cut_text = F.arrow_udf(cut, "string")
    return found.withColumn(text, cut_text(text, "spans"))
