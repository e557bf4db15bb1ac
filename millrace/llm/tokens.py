"""Token counts by scanning flat token files for end-of-document separators.

``encode`` writes documents as one flat run of token ids per input partition, a
separator after each, cut into blocks of ``BLOCK`` ids without regard to documents and
without any index of where they begin. ``scan`` finds the separators of each block at
once in an array, and stitches documents that cross blocks with a prefix scan over the
blocks' open ends. ``read_flat`` reads such files from elsewhere.

Scale: a block is a row, so any number of tasks share a file. The prefix scan works on
one row per block: first within groups of ``GROUP`` blocks, then over the groups, so no
task holds all the blocks of a long file. A document may cross any number of blocks.

Cases: a null or empty text is a separator alone, with no tokens; ids that follow a
file's last separator are an unfinished document, returned with ``finished`` false;
repeated rows are documents of their own; an empty table gives no rows. Text that
spells a separator is encoded as ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces

BLOCK = 1 << 16
GROUP = 1024
END = 50256


def byte_pairs(path: str, pattern: str) -> Callable[[list[str]], list[list[int]]]:
    """An encoder over a vocabulary file of base64 tokens and ranks; made once in each task."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [encoding.encode_ordinary(t) for t in texts]


def encode(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[list[int]]]], doc_id: str = "doc_id", text: str = "text", end: int = END, width: int = 2, block: int = BLOCK) -> DataFrame:
    """file, block, ids (``width`` bytes each, little end first), first_doc, docs.

    ``docs`` lists the documents read since the block before, in order, and
    ``first_doc`` counts those ahead of them; neither says where a document begins.
    Write the result before use.
    """
    schema = f"file int, block bigint, ids binary, first_doc bigint, docs array<{docs.select(doc_id).schema[0].dataType.simpleString()}>"
    kind = np.dtype(f"<u{width}")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number, work = TaskContext.get().partitionId(), 0, None
        open_, names, first, id_type = np.zeros(0, kind), [], 0, None

        def row(ids: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([number], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([first], pa.int64()), pa.array([names], pa.list_(id_type))], ["file", "block", "ids", "first_doc", "docs"])

        for batch in batches:
            id_type = batch.column(0).type
            work = work or encoder()
            for lo, hi in pieces(batch.column(1)):
                found = work([t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()])
                flat = np.fromiter((x for ids in found for x in (*ids, end)), kind)
                open_, names = np.concatenate([open_, flat]), names + batch.column(0).slice(lo, hi - lo).to_pylist()
                while len(open_) >= block:
                    yield row(open_[:block])
                    open_, first, names, number = open_[block:], first + len(names), [], number + 1
        if len(open_) or names:
            yield row(open_)

    return docs.mapInArrow(run, schema)


def read_flat(spark: SparkSession, path: str, file: int = 0, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Blocks of a flat binary token file, split over tasks by Hadoop's fixed-length reader.

    The file's length must be a multiple of a block's bytes, as that reader asks for.
    """
    records = spark.sparkContext.newAPIHadoopFile(
        path, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable",
        conf={"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(block * width)},
    )
    return spark.createDataFrame(records.map(lambda kv: (file, kv[0], bytes(kv[1]))), "file int, block bigint, ids binary")


def scan(blocks: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """file, ordinal (of the document in its file), n_tokens, finished."""
    kind = np.dtype(f"<u{width}")

    def find(ids: pa.Array) -> pa.Array:
        """Per block: the lengths between separators, first the part before the first one, last the part after the last."""
        out = []
        for raw in ids:
            values = np.frombuffer(raw.as_buffer() or b"", kind)
            at = np.flatnonzero(values == end)
            out.append(np.diff(np.concatenate([[-1], at, [len(values)]])) - 1)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in out])])
        flat = np.concatenate(out) if out else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int64()))

    cut = blocks.select("file", "block", F.arrow_udf(find, "array<bigint>")("ids").alias("parts"))
    cut = cut.withColumn("group", F.floor(F.col("block") / GROUP)).withColumn("n", (F.size("parts") - 1).cast("bigint"))
    # Open before a block: the tails since the last block with a separator, that is their running sum less its value there.
    cut = cut.withColumn("tail", F.element_at("parts", -1))
    inner = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    run = cut.withColumn("__sum", F.coalesce(F.sum("tail").over(inner), F.lit(0)))
    run = run.withColumn("__base", F.max(F.when(F.col("n") > 0, F.col("__sum"))).over(inner))
    run = run.withColumn("__seps", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    groups = run.groupBy("file", "group").agg(F.sum("n").alias("n"), (F.sum("tail") - F.coalesce(F.max(F.when(F.col("n") > 0, F.col("__sum"))), F.lit(0))).alias("tail"))
    outer = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("__sum", F.coalesce(F.sum("tail").over(outer), F.lit(0)))
    groups = groups.withColumn("__base", F.max(F.when(F.col("n") > 0, F.col("__sum"))).over(outer)).withColumn("g_seps", F.coalesce(F.sum("n").over(outer), F.lit(0)))
    left = groups.groupBy("file").agg(F.sum("n").alias("ordinal"), (F.sum("tail") - F.coalesce(F.max(F.when(F.col("n") > 0, F.col("__sum"))), F.lit(0))).alias("n_tokens"))
    left = left.filter("n_tokens > 0").withColumn("finished", F.lit(False))
    groups = groups.select("file", "group", "g_seps", (F.col("__sum") - F.coalesce("__base", F.lit(0))).alias("g_open"))
    run = run.join(groups, ["file", "group"])
    inside = F.col("__sum") - F.coalesce("__base", F.lit(0))
    run = run.withColumn("carry", F.when(F.col("__base").isNull(), F.col("g_open") + inside).otherwise(inside)).withColumn("first", F.col("g_seps") + F.col("__seps"))
    done = run.select("file", "first", "carry", F.posexplode(F.slice("parts", F.lit(1), F.size("parts") - 1)).alias("i", "part"))
    done = done.select("file", (F.col("first") + F.col("i")).alias("ordinal"), (F.col("part") + F.when(F.col("i") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("finished"))
    return done.unionByName(left)


def counted(written: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """doc_id, n_tokens for blocks from ``encode``: the k-th separator of a file ends its k-th document."""
    read = written.select("file", "first_doc", F.posexplode("docs").alias("i", "doc_id")).select("file", (F.col("first_doc") + F.col("i")).alias("ordinal"), "doc_id")
    return scan(written.select("file", "block", "ids"), end, width).filter("finished").join(read, ["file", "ordinal"]).select("doc_id", "n_tokens")
