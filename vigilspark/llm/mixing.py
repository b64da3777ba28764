"""Mixing sources to target weights by hash thresholds, with DataFrame functions only.

Every document has a hash.  Tokens are summed by source and hash bucket; the running sum over a
source's buckets shows which bucket its budget ends in, and only that bucket is summed again by the
next bits of the hash, level by level, until the threshold lies between two hashes.  One filter then
takes a document once more or not; nothing is sorted, and thresholds are nested: a larger budget
takes all that a smaller one took.

Sources are ordered by code point, null last, and weigh 1, 2, 3, repeating.  Targets share 100 % of
all sizes by weight, none above ``cap`` times its source's size; what is over goes to the others by
weight.  A document of a source with target = q * size + rest is taken q times, and once more if its
hash is under the threshold for rest, so never more than ``cap`` times.  Null or word-less texts have
size 0 and add nothing.  Rows with equal doc_id and text have equal hashes and share their fate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import column_name, materialise

#: Bits of the hash that each level resolves; three levels tell 2**36 documents of a source apart.
BITS = 12
LEVELS = 3
#: Sources up to which the plan is broadcast; with more, documents and plan meet by a shuffle.
MAX_BROADCAST = 10_000
WORD = r"[^ \t-\r]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source in and out.

    Sources in order of cap over weight reach their caps one after another, so running sums give
    the level at which the rest shares; windows run over one row a source, never over documents."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = (
        sizes.withColumn("weight", weight).withColumn("cap", (cap * F.col("source_size")).cast("double"))
        .withColumn("left", F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("capped", F.col("left") * F.col("weight") > F.col("cap") * F.col("open"))
    )
    first_open = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "source", "left", "open"))).over(everything)
    return ranked.withColumn("first", first_open).select(
        "source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("first.left") * F.col("weight") / F.col("first.open"))).alias("target"))


def mix(docs: DataFrame, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target, taken and times."""
    names = {c: column_name(docs, c) for c in ("size", "source_size", "target", "taken", "times")}
    hashed = F.xxhash64("doc_id", "text")
    sized = materialise(docs.select("source", hashed.alias("h"), word_count(F.col("text")).alias("size")), "sized")
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), cap, weights)
    # Budget of the partial pass: what the whole passes leave.
    passes = F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(cap)).cast("int")
    plan = materialise(goal.withColumn("passes", passes).withColumn(
        "rest", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0))).withColumn("floor", F.lit(0).cast("long")), "plan")
    unsigned = F.shiftrightunsigned("h", 64 - BITS * LEVELS)  # the hash's leading bits, as a number
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = sized.withColumn("u", unsigned).join(
            plan.select(F.col("source").alias("s"), "floor"), F.col("source").eqNullSafe(F.col("s"))).where(
            F.shiftright("u", shift + BITS) == F.shiftright("floor", shift + BITS))
        histogram = inside.groupBy("source", F.shiftright("u", shift).alias("bucket")).agg(F.sum("size").alias("tokens"))
        running = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket"))
        filled = histogram.withColumn("upto", running).join(
            plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        # Buckets that fit whole; the next one is the boundary bucket.
        fit = filled.groupBy("source").agg(
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))), F.lit(0)).alias("used"),
            F.min(F.when(F.col("upto") > F.col("rest"), F.col("bucket"))).alias("boundary"),
            F.min(F.when(F.col("upto") > F.col("rest"), F.col("upto"))).alias("over"),
        ).select(F.col("source").alias("s"), "used", "boundary", "over")
        joined = plan.join(fit, F.col("source").eqNullSafe(F.col("s")), "left")
        end = F.lit(1 << (BITS * LEVELS))
        rest = F.col("rest") - F.coalesce("used", F.lit(0))
        floor = F.when(F.col("boundary").isNotNull(), F.shiftleft("boundary", shift)).otherwise(end)
        if level == LEVELS - 1:  # the last hash itself: in, if that comes nearer
            near = F.col("boundary").isNotNull() & (F.col("over") - F.col("rest") < rest)
            floor = floor + F.when(near, 1).otherwise(0)
        plan = materialise(joined.select("source", "source_size", "target", "passes", rest.alias("rest"), floor.cast("long").alias("floor")), "plan")
    mark = column_name(docs, "s")
    keyed = plan.select(F.col("source").alias(mark), F.col("source_size").alias("plan_size"), F.col("target").alias("plan_target"), "passes", "floor")
    plan_row = column_name(docs, "plan")
    keyed = keyed.select(F.struct(*keyed.columns).alias(plan_row))
    if plan.count() <= MAX_BROADCAST:  # a plan row is under 100 bytes plus the source's name
        keyed = F.broadcast(keyed)
    out = docs.join(keyed, docs["source"].eqNullSafe(F.col(f"{plan_row}.{mark}")), "left")
    p = lambda c: F.col(f"{plan_row}.{c}")
    more = F.shiftrightunsigned(hashed, 64 - BITS * LEVELS) < p("floor")
    times = p("passes") + F.when(more & (p("passes") < cap), 1).otherwise(0)
    size = word_count(F.col("text"))
    return out.select(*(docs[c] for c in docs.columns), size.alias(names["size"]), p("plan_size").alias(names["source_size"]),
                      p("plan_target").alias(names["target"]), (size * times).cast("long").alias(names["taken"]), times.cast("int").alias(names["times"]))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
