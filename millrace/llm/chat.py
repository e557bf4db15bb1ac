"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered with that
participant as the assistant and everyone else as a named user; a mask says which
characters to train on, which are the bodies of the participant's own turns.

A rendering is returned in pieces, one per turn and participant, each with its place
in the whole, ``piece_start`` to ``piece_end`` (in characters), and the trained span,
``mask_start`` to ``mask_end``. ``assembled`` puts bounded conversations together.

Scale: only functions of Spark SQL run. Turns are range-partitioned by conversation
and turn, so a conversation that holds a third of all rows spreads over many tasks;
lengths are summed in each slice of a conversation and carried across its slices.
Output grows with turns times the participants of their conversation, which is what
rotation asks for. System turns are not a participant: they open every rendering as
they are.

Marks inside a text or role are written with a backslash after the ``<`` (one more where
there are some already, so that they can be told back), and line breaks inside a role as
blanks: no text opens or closes a turn.

Cases: a null or empty text is a turn with an empty body; a null role is a participant
named ``unknown``; rows with a null conversation belong to one conversation; ties in
``turn`` are ordered by role and text, and repeated rows all stay; a conversation with
system turns alone has no participant and no rendering; an empty table gives no rows;
other input columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, stamped

SYSTEM = "system"
UNKNOWN = "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def unmarked(text: Column | str) -> Column:
    """The text with a backslash in every mark."""
    return F.regexp_replace(text, r"<(\\*)\|(im_start|im_end)\|>", r"<$1\\|$2|>")


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, participant, position, role, piece, piece_start, piece_end, mask_start, mask_end.

    The masks are null where a turn is not the participant's own; a trained span holds
    the body and the closing mark.
    """
    scratch = Scratch(turns.sparkSession)
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(UNKNOWN)).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    # Equal rows may change places without a trace; their row numbers only let them spread.
    order = ["conv_id", "turn", "role", "__md5", "__row"]
    rows = rows.withColumn("__md5", F.md5("text")).withColumn("__row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("__md5", "__row")
    rows = scratch.store(stamped(rows), "chat-turns")

    people = rows.filter(F.col("role") != SYSTEM).select(F.col("conv_id").alias("__c"), F.col("role").alias("participant")).distinct()
    seen = rows.join(people, F.col("conv_id").eqNullSafe(F.col("__c"))).drop("__c")
    own = F.col("role") == F.col("participant")
    name = F.when(own, F.lit("assistant")).when(F.col("role") == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), F.regexp_replace(unmarked("role"), r"[\r\n]", " ")))
    head = F.concat(F.lit(OPEN), name, F.lit("\n"))
    seen = seen.withColumn("__own", own).withColumn("__head", F.length(head).cast("bigint"))
    seen = seen.withColumn("piece", F.concat(head, unmarked("text"), F.lit(CLOSE))).withColumn("__len", F.length("piece").cast("bigint"))

    keys = ["conv_id", "participant"]
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    slices = seen.groupBy(*keys, "__part").agg(F.count("*").alias("n"), F.sum("__len").alias("len"))
    slices = slices.select(F.col("conv_id").alias("__c"), F.col("participant").alias("__s"), F.col("__part").alias("__p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__n"), F.coalesce(F.sum("len").over(earlier), F.lit(0)).alias("__chars"))
    within = Window.partitionBy(*keys, "__part").orderBy("__pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = seen.withColumn("__i", F.count("*").over(within)).withColumn("__upto", F.sum("__len").over(within))
    seen = seen.join(slices, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("participant") == F.col("__s")) & (F.col("__part") == F.col("__p")))
    end = F.col("__chars") + F.col("__upto")
    start = end - F.col("__len")
    return seen.select(
        "conv_id", "participant", (F.col("__n") + F.col("__i") - 1).alias("position"), "role", "piece",
        start.alias("piece_start"), end.alias("piece_end"),
        F.when(F.col("__own"), start + F.col("__head")).alias("mask_start"),
        F.when(F.col("__own"), end - 1).alias("mask_end"),
    )


def assembled(pieces: DataFrame, most: int = 10_000) -> DataFrame:
    """One row per rendering of at most ``most`` turns: text and mask spans; longer ones stay in pieces."""
    short = pieces.groupBy("conv_id", "participant").agg(F.count("*").alias("n")).filter(F.col("n") <= most).select(F.col("conv_id").alias("__c"), F.col("participant").alias("__s"))
    rows = pieces.join(short, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("participant") == F.col("__s")))
    whole = F.sort_array(F.collect_list(F.struct("position", "piece", "mask_start", "mask_end")))
    spans = F.transform(F.filter("w", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end")))
    return rows.groupBy("conv_id", "participant").agg(whole.alias("w")).select("conv_id", "participant", F.array_join("w.piece", "").alias("text"), spans.alias("spans"))
