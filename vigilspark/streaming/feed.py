"""The daily feed board: item state, changes, source health, windows; batch and streaming forms.

Batch forms work on all deliveries (id, day, watched fields); the stateful streams in state.py give the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert_items(deliveries: DataFrame) -> DataFrame:
    """Item state after all runs: (id, day, seq, source, level) to first and last day seen and the latest fields."""
    latest = F.max_by(F.struct("source", "level"), F.struct("day", "seq"))
    return deliveries.groupBy("id").agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), latest.alias("_l")).select("id",
        "first_seen", "last_seen", "_l.source", "_l.level")


def detect_changes(deliveries: DataFrame, watched: list[str]) -> DataFrame:
    """(id, day, changes) of runs in which a watched field differs from the run before; both sides must be filled.

    An item that isn't delivered has not changed."""
    window = Window.partitionBy("id").orderBy("day")
    daily = deliveries.groupBy("id", "day").agg(F.max_by(F.struct(*watched), "seq").alias("_n"))
    pair = daily.withColumn("_o", F.lag("_n").over(window))
    filled = lambda c: c.isNotNull() & (c.cast("string") != "")
    changed = F.filter(F.array(*(F.when(filled(F.col(f"_o.{c}")) & filled(F.col(f"_n.{c}")) & (F.col(f"_o.{c}") != F.col(f"_n.{c}")),
        F.lit(c)) for c in watched)), lambda x: x.isNotNull())
    return pair.select("id", "day", changed.alias("changes")).where(F.size("changes") > 0)


def enrich_once(items: DataFrame, version: int, enrich, ok: str = "ok") -> DataFrame:
    """Apply ``enrich`` (DataFrame with a new summary and ``ok``) to the rows of an older version; a failed one keeps its summary."""
    old = items.where(F.coalesce("enrich_v", F.lit(0)) < version)
    done = enrich(old).select(*[c for c in items.columns if c not in ("summary", "enrich_v")],
        F.when(F.col(ok), F.col("new_summary")).otherwise(F.col("summary")).alias("summary"), F.when(F.col(ok), version).otherwise(F.col("enrich_v")).alias("enrich_v"))
    return items.where(F.coalesce("enrich_v", F.lit(0)) >= version).unionByName(done)


def source_health(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Per current source: last try, its result, last success and error; retired sources have no row."""
    per = runs.groupBy("source").agg(F.max("day").alias("last_try"), F.max_by(F.struct("ok", "error", "count"), "day").alias("_l"),
        F.max(F.when(F.col("ok"), F.col("day"))).alias("last_ok"))
    return sources.select("source").join(per, "source", "left").select("source", F.coalesce("_l.ok", F.lit(False)).alias("ok"), "last_ok", "last_try",
        F.when(~F.col("_l.ok"), F.col("_l.error")).alias("error"), F.coalesce("_l.count", F.lit(0)).alias("count"))


def tumbling_counts(events: DataFrame, length: str, late: str = "2 days") -> DataFrame:
    """Events a key and window; on a stream, data up to ``late`` late is counted."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", length).alias("_w"), "key").agg(F.count("*").alias("n")).select(F.date_format("_w.start", "yyyy-MM-dd").alias("start"), "key", "n")


def stream_dedup(events: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    if events.isStreaming:
        return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def first_run_guard(items: DataFrame, today: str) -> DataFrame:
    """One row: whether all items were first seen today, and how many may be called new."""
    first = F.coalesce(F.bool_and(F.col("first_seen") == today), F.lit(True))
    return items.agg(first.alias("first_load"), F.count("*").alias("items"),
        F.count_if(F.col("first_seen") == today).alias("_n")).select("first_load", "items", F.when(F.col("first_load"), F.lit(0)).otherwise(F.col("_n")).alias("new"))


def source_freshness(items: DataFrame, sources: DataFrame, today: str) -> DataFrame:
    """Latest item of each source, its age in days, quiet beyond twice the cadence or without items."""
    latest = items.groupBy("source").agg(F.max("date").alias("latest"))
    age = F.datediff(F.to_date(F.lit(today)), F.to_date("latest"))
    return sources.join(latest, "source", "left").withColumn("age_days", age).withColumn("quiet", F.col("age_days").isNull() | (F.col("age_days") > 2 * F.col("cadence")))


def run_available(stream: DataFrame, checkpoint: str, name: str, mode: str) -> DataFrame:
    """Run a stream over what is there and return the sink's rows (an in-memory table for boards and tests)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
