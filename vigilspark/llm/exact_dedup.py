"""Exact dedup with heavy hitters split off.

Every text gets its SHA-256.  Each task runs Misra-Gries with ``counters`` counters over its digests and
sends what is frequent there; the sums that reach a ``counters``-th of all rows are the candidates.  Counters
never count too much, so there are at most ``counters`` + 1 candidates whatever the input holds: that bound is
what allows the broadcasts.  No digest of three ``counters``-ths of the rows is missed.  The candidates are
verified: counted exactly and given their winner, by one aggregate that combines in each task.  The winners are
broadcast and settle their rows where they are read; only the rows of the other digests are shuffled.

Of equal texts the row with the largest doc_id stays (null is the smallest).  Null and empty texts are equal.
Rows that are equal in doc_id and text too are told apart by a number that is written with the digests, so
exactly one row of a group is kept.  An empty table gives an empty one.  Extra columns of the input are
carried; names that it has already get an underscore.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import column_name, map_batches, materialise

#: Counters of a task; also bounds the rows that are broadcast.
COUNTERS = 4096
#: Digests that a task counts before it merges them into its counters.
MERGE_ROWS = 32_768


def misra_gries(batches, counters: int):
    """(digest, n) of what is frequent in the batches: n is at most the true count and short by two
    ``counters``-ths of the rows at most."""
    held = pa.table({"digest": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
    waiting: list[pa.RecordBatch] = []
    rows = 0

    def merge():
        nonlocal held
        fresh = pa.concat_arrays([b.column(0).cast(pa.binary()) for b in waiting])
        both = pa.concat_tables([held, pa.table({"digest": fresh, "n": np.ones(len(fresh), np.int64)})])
        held = both.group_by("digest").aggregate([("n", "sum")]).rename_columns(["digest", "n"])
        if held.num_rows > counters:
            n = held.column("n").to_numpy()
            less = n - np.partition(n, -counters - 1)[-counters - 1]  # counter number ``counters`` + 1 falls to zero
            held = held.set_column(1, "n", pa.array(less)).filter(pa.array(less > 0))
        waiting.clear()

    for batch in batches:
        rows += batch.num_rows
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= MERGE_ROWS:
            merge()
    if waiting:
        merge()
    # What isn't frequent here needn't be sent: it costs one more share of the rows.
    often = held.column("n").to_numpy() * (counters + 1) > rows
    yield from held.filter(pa.array(often)).to_batches()


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The digests, at most ``counters`` + 1, whose counted rows reach a share of 1 / (``counters`` + 1) of all."""
    total = digests.count()
    counted = map_batches(digests.select("digest"), lambda batches: misra_gries(batches, counters), "digest binary, n long")
    found = counted.groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") * (counters + 1) >= total).select("digest")
    return materialise(found, "frequent")


def decide(docs: DataFrame, carry: list[str] | None = None, counters: int = COUNTERS) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all but the text) with keep_id, group_size, kept and text_sha256; one row a row.

    Carry the text as well to filter a corpus by ``kept``."""
    carry = [c for c in docs.columns if c != "text"] if carry is None else carry
    id_type = docs.schema["doc_id"].dataType
    digest = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))
    rows = materialise(docs.select(
        digest.alias("digest"), F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"),
        F.struct(*(F.col(c) for c in carry)).alias("carried")), "digests")
    order = F.max(F.struct("id", "row")).alias("winner")
    candidates = F.broadcast(frequent_digests(rows, counters))
    verified = materialise(rows.join(candidates, "digest", "left_semi").groupBy("digest").agg(order, F.count("*").alias("size")), "winners")
    marked = rows.join(F.broadcast(verified), "digest", "left")
    rest = marked.where(F.col("size").isNull()).drop("winner", "size")
    groups = rest.groupBy("digest").agg(order, F.count("*").alias("size")).where("size > 1")
    settled = marked.where(F.col("size").isNotNull()).unionByName(rest.join(groups, "digest", "left"))
    alone = F.col("size").isNull()
    kept = alone | (F.col("winner.row") == F.col("row"))
    keep_id = F.when(alone, F.col("id")).otherwise(F.col("winner.id")).cast(id_type)
    added = {"keep_id": keep_id, "group_size": F.coalesce("size", F.lit(1)).cast("long"), "kept": kept, "text_sha256": F.lower(F.hex("digest"))}
    return settled.select(*(F.col("carried")[c].alias(c) for c in carry), *(v.alias(column_name(docs, c)) for c, v in added.items()))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decide(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
