"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words. A document of a source is to be taken
target / source size times, which is rarely whole. The fractions are rounded
together: two documents of a source are paired, words move at random from one to the
other, with the expectation of both kept, until one of them is taken a whole number
of times, and the other goes on to the next pair. So the words taken from a source
stay constant up to the last fraction left.

Scale: fractions are folded in groups of about ``GROUP`` documents, the one left over
in each group goes to the next level of a reduction tree, and a root group that was
held back joins the last level. The last fraction is drawn, and what it adds or
leaves out is made up by whole copies of the root's documents, so that a source comes
within about a short document of its target.
Groups come from a hash within a source, so a source with any share of the rows uses
all tasks; a group never exceeds a small multiple of ``GROUP``. Only functions of
Spark SQL run; draws come from hashes of the documents, so reruns agree however rows
are partitioned.

Cases: a null text has size 0 and is taken 0 times its size; null sources are one
source, last in order; repeated rows are rounded as one and share its copies evenly;
an empty table gives no rows; input columns named like results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ordinal_within, stamped

WEIGHTS = (5, 2, 1)
MOST = 3
GROUP = 48
RESULTS = ["size", "source_size", "target", "copies", "taken"]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add what the mix needs to know of a text: its words and its checksum."""
    size = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    return docs.drop(*RESULTS).withColumn("size", size.cast("bigint")).withColumn("__crc", F.crc32(text))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add ``target`` to a table of (source, source_size).

    Weights repeat along the sources in order of code points, null last. Shares above
    ``most`` times a source's size stop there and the rest is shared anew, until none
    is above; each round is one aggregate over the sources.
    """
    scratch = Scratch(sizes.sparkSession)
    order = F.col("source").asc_nulls_last()
    ordered = scratch.store(stamped(sizes.repartitionByRange(order).sortWithinPartitions(order)), "mix-sources")
    ranked = ordinal_within(ordered, [], "__rank").drop("__part", "__pos")
    weight = F.element_at(F.array(*[F.lit(w).cast("decimal(20,0)") for w in weights]), (F.col("__rank") % len(weights)).cast("int") + 1)
    ranked = scratch.store(ranked.withColumn("__weight", weight), "mix-weights")
    size = F.col("source_size").cast("decimal(20,0)")
    total, parts = ranked.agg(F.sum(size), F.sum("__weight")).first()
    num, den, capped = int(total or 0), int(parts or 1), -1
    while True:
        # A share is num * weight / den.
        above = F.lit(num).cast("decimal(38,0)") * F.col("__weight") > F.lit(most * den).cast("decimal(38,0)") * F.col("source_size")
        n, stopped, left = ranked.agg(F.count_if(above), F.sum(F.when(above, size)), F.sum(F.when(~above, F.col("__weight")))).first()
        if n == capped:
            break
        capped = n
        if left:
            num, den = int(total) - most * int(stopped or 0), int(left)
    share = F.col("__weight").cast("double") * float(num) / float(den)
    top = (most * F.col("source_size")).cast("double")
    return ranked.withColumn("target", F.when(above, top).otherwise(F.least(share, top))).drop("__rank", "__weight")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _draw(seed: int, *keys: Column) -> Column:
    return F.xxhash64(F.lit(seed), *keys).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def _fold(items: Column, item_type: str, seed: int) -> Column:
    """Fold sorted items into (carry: the item still fractional, done: the whole ones)."""

    def with_p(x: Column, p: Column) -> Column:
        return x.withField("p", p)

    def whole(x: Column) -> Column:
        return (x["p"] <= 0) | (x["p"] >= 1)

    def pair(done: Column, a: Column, b: Column) -> Column:
        up_a, up_b = (1 - a["p"]) * a["s"], (1 - b["p"]) * b["s"]
        down_a, down_b = a["p"] * a["s"], b["p"] * b["s"]
        moves = F.struct(F.least(up_a, down_b).alias("up"), F.least(down_a, up_b).alias("down"))

        def settled(m: Column) -> Column:
            rises = _draw(seed, a["k"], b["k"]) * (m["up"] + m["down"]) < m["down"]
            new_a = F.when(rises, F.when(up_a <= down_b, F.lit(1.0)).otherwise(a["p"] + m["up"] / a["s"])).otherwise(F.when(down_a <= up_b, F.lit(0.0)).otherwise(a["p"] - m["down"] / a["s"]))
            new_b = F.when(rises, F.when(down_b <= up_a, F.lit(0.0)).otherwise(b["p"] - m["up"] / b["s"])).otherwise(F.when(up_b <= down_a, F.lit(1.0)).otherwise(b["p"] + m["down"] / b["s"]))
            return F.array(with_p(a, new_a), with_p(b, new_b))

        def split(both: Column) -> Column:
            return F.struct(F.get(F.filter(both, lambda x: ~whole(x)), F.lit(0)).alias("carry"), F.concat(done, F.filter(both, whole)).alias("done"))

        return _let(_let(moves, settled), split)

    def step(state: Column, b: Column) -> Column:
        first = F.struct(b.alias("carry"), state["done"].alias("done"))
        return F.when(state["carry"].isNull(), first).otherwise(pair(state["done"], state["carry"], b))

    empty = F.struct(F.lit(None).cast(item_type).alias("carry"), F.array().cast(f"array<{item_type}>").alias("done"))
    return F.aggregate(items, empty, step)


def _settled(carry: Column, done: Column, item_type: str, most: int, seed: int) -> Column:
    """Draw the last fraction and make up for it by whole copies of the root's documents, long ones first."""
    bump = (_draw(seed, carry["k"]) < carry["p"]).cast("double")

    def step(state: Column, x: Column) -> Column:
        taken, unit = x["unit"]["base"] + x["p"], x["unit"]
        more = (2 * state["owed"] > x["s"]) & (taken + 1 <= most * unit["m"])
        less = (-2 * state["owed"] > x["s"]) & (taken >= 1)
        change = F.when(more, F.lit(1.0)).when(less, F.lit(-1.0)).otherwise(F.lit(0.0))
        return F.struct((state["owed"] - change * x["s"]).alias("owed"), F.concat(state["out"], F.array(x.withField("p", x["p"] + change))).alias("out"))

    start = F.struct(F.coalesce((carry["p"] - bump) * carry["s"], F.lit(0.0)).alias("owed"), F.array().cast(f"array<{item_type}>").alias("out"))
    last = F.when(carry.isNull(), F.array().cast(f"array<{item_type}>")).otherwise(F.array(carry.withField("p", bump)))
    return F.concat(last, F.aggregate(F.sort_array(done), start, step)["out"])


def _rounded(units: DataFrame, most: int, seed: int, scratch: Scratch) -> DataFrame:
    """Give every unit ``bump``, 0 or 1, for its fraction ``__p``; units have source, size, __n (units of the source) and __k."""
    fields = [f for f in units.columns if f not in ("__p", "__k")]
    open_ = (F.col("__p") > 0) & (F.col("size") > 0)
    item = F.struct((-F.col("size")).alias("order"), F.col("__k").alias("k"), F.col("__p").alias("p"), F.col("size").cast("double").alias("s"), F.struct(*fields).alias("unit"))
    item_type = units.select(item.alias("x")).schema["x"].dataType.simpleString()
    chunk = F.pmod(F.xxhash64(F.lit(seed), "__k"), F.ceil(F.col("__n") / GROUP))
    waiting = units.filter(open_).select("source", chunk.alias("chunk"), item.alias("item"))
    root, level = waiting.filter("chunk = 0"), waiting.filter("chunk > 0")
    done = [units.filter(~open_).select(*fields, F.lit(0).alias("bump"))]
    for depth in range(1, 64):
        sizes = level.groupBy("source").agg(F.count("*").alias("n"))
        last = (sizes.agg(F.max("n")).first()[0] or 0) <= GROUP
        if last:
            level = level.select("source", F.lit(0).alias("chunk"), "item").unionByName(root)
        elif depth > 1:
            sizes = sizes.select(F.col("source").alias("__source"), "n")
            level = level.join(sizes, F.col("source").eqNullSafe(F.col("__source"))).select("source", F.pmod(F.xxhash64(F.lit(seed + depth), F.col("item.k")), F.ceil(F.col("n") / GROUP)).alias("chunk"), "item")
        folded = level.groupBy("source", "chunk").agg(_fold(F.sort_array(F.collect_list("item")), item_type, seed + depth).alias("f"))
        folded = folded.select("source", "f.*")
        if last:
            folded = folded.select("source", F.lit(None).cast(item_type).alias("carry"), _settled(F.col("carry"), F.col("done"), item_type, most, seed).alias("done"))
        folded = scratch.store(folded, "mix-level")
        done.append(folded.select(F.explode("done").alias("x")).select("x.unit.*", F.col("x.p").cast("int").alias("bump")))
        if last:
            break
        level = folded.filter("carry IS NOT NULL").select("source", F.lit(0).alias("chunk"), F.col("carry").alias("item"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 20) -> DataFrame:
    """Add source_size, target, copies and taken to a table from ``measure``."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.drop(*RESULTS[1:])
    keys = [F.col(doc_id).alias("doc"), F.col(source).alias("source"), "size", F.col("__crc").alias("crc")]
    units = scratch.store(docs.select(*keys).groupBy("doc", "source", "size", "crc").agg(F.count("*").alias("m")), "mix-units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("__n"))
    goal = targets(sizes, weights, most).withColumnRenamed("source", "__source")
    units = units.join(goal, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    exact = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)) * F.col("m")
    units = units.withColumn("base", F.floor(exact)).withColumn("__p", exact - F.floor(exact)).withColumn("__k", F.xxhash64(F.lit(seed), "doc", "source", "size", "crc"))
    units = _rounded(units, most, seed, scratch).select(F.col("doc").alias("__doc"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("crc").alias("__text"), F.col("m").alias("__m"), "source_size", "target", (F.col("base") + F.col("bump")).alias("__copies"))
    same = F.col(doc_id).eqNullSafe(F.col("__doc")) & F.col(source).eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size")) & F.col("__crc").eqNullSafe(F.col("__text"))
    joined = docs.join(units, same)
    once = joined.filter("__m = 1").withColumn("copies", F.col("__copies"))
    again = ordinal_within(scratch.store(stamped(joined.filter("__m > 1")), "mix-repeated"), ["__doc", "__source", "__size", "__text"], "__i").drop("__part", "__pos")
    share = F.floor(F.col("__copies") / F.col("__m")) + (F.col("__i") < F.col("__copies") % F.col("__m")).cast("bigint")
    rows = once.unionByName(again.withColumn("copies", share).drop("__i"))
    rows = rows.withColumn("taken", F.col("copies") * F.col("size"))
    return rows.drop("__doc", "__source", "__size", "__text", "__crc", "__m", "__copies")


def repeat(mixed: DataFrame) -> DataFrame:
    """Each row as often as it is taken, without the columns of the mix."""
    own = [c for c in mixed.columns if c not in RESULTS]
    return mixed.filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(*own)
