"""Stateful streams against their batch forms, however the deliveries are split."""

import random

import pytest
from pyspark.sql import functions as F

from vigilspark.streaming import feed, state

SCHEMA = "id long, day string, seq long, source string, level int"


def deliveries(seed):
    r = random.Random(seed)
    rows = []
    for i in range(12):
        for seq in range(r.randrange(1, 9)):
            rows.append((i, f"2024-03-{r.randrange(1, 7):02d}", seq * 100 + i, r.choice(["a", "b", "", None]), r.choice([1, 2, None])))
    return rows


def micro_batches(spark, rows, schema, folder, files, seed):
    r = random.Random(seed)
    r.shuffle(rows)
    cuts = sorted(r.randrange(len(rows) + 1) for _ in range(files - 1))
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        if a < b:
            spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(f"file://{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/in")


@pytest.mark.parametrize("seed", [1, 2])
def test_items_in_any_split(spark, tmp_path, seed):
    state.use_rocksdb(spark)
    rows = deliveries(seed)
    stream = micro_batches(spark, rows, SCHEMA, tmp_path, 5, seed)
    state.write_available(state.item_stream(stream), "update", f"file://{tmp_path}/out", f"file://{tmp_path}/log", idle=False)
    got = spark.read.parquet(f"file://{tmp_path}/out").groupBy("id").agg(F.max_by(F.struct("source", "level", "first_seen", "last_seen", "updated",
        "changes"), "batch").alias("r")).select("id", "r.*")
    batch = spark.createDataFrame(rows, SCHEMA)
    changes = feed.detect_changes(batch, ["source", "level"]).groupBy("id").agg(F.max("day").alias("updated"), F.max_by("changes", "day").alias("changes"))
    want = feed.upsert_items(batch).join(changes, "id", "left").select(
        "id", "source", "level", "first_seen", "last_seen", "updated", F.coalesce("changes", F.array().cast("array<string>")).alias("changes"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_quiet_sources_in_any_order(spark, tmp_path):
    state.use_rocksdb(spark)
    r = random.Random(5)
    rows = sorted((f"s{r.randrange(4)}", f"2024-02-{d:02d} {r.randrange(24):02d}:00:00") for d in list(range(1, 9)) + [15, 16, 27, 28] for _ in range(2))
    rows += [("s1", "2024-02-03 01:00:00"), ("gone", "2024-02-04 01:00:00")]
    rows.sort(key=lambda x: x[1])
    swapped = [rows[i + (1 if i % 2 == 0 else -1)] if i + 1 < len(rows) - len(rows) % 2 else rows[i] for i in range(len(rows))]
    sources = spark.createDataFrame([(f"s{k}", k + 1, "2024-02-01") for k in range(4)] + [("never", 2, "2024-02-01")], "source string, cadence int, start string")
    for i in range(0, len(swapped), 4):
        spark.createDataFrame(swapped[i:i + 4], "source string, ts string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("source string, ts string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    state.write_available(state.quiet_stream(stream, sources, "2 days"), "append", f"file://{tmp_path}/out", f"file://{tmp_path}/log", idle=True)
    got = spark.read.parquet(f"file://{tmp_path}/out").drop("batch")
    items = spark.createDataFrame(rows, "source string, ts string").select("source", F.substring("ts", 1, 10).alias("day"))
    want = state.quiet_spells(items, sources, "2024-02-26")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    assert any(x["source"] == "never" for x in got.collect()) and not any(x["source"] == "gone" for x in got.collect())


def test_a_failing_source_stops_only_itself(spark, tmp_path):
    for name in ("good", "bad", "other"):
        spark.createDataFrame([(i, name) for i in range(5)], "n int, name string").write.parquet(f"file://{tmp_path}/{name}")
    read = lambda name, column: spark.readStream.schema("n int, name string").parquet(f"file://{tmp_path}/{name}").select(column.alias("n"))
    streams = {"good": read("good", F.col("n")), "bad": read("bad", F.when(F.col("n") == 3,
        F.raise_error(F.lit("no"))).otherwise(F.col("n")).cast("int")), "other": read("other", F.col("n"))}
    health = state.collect_sources(streams, f"file://{tmp_path}/out", f"file://{tmp_path}/log")
    assert [(r["source"], r["ok"], r["count"]) for r in health.collect()] == [("good", True, 5), ("bad", False, 0), ("other", True, 5)]
    got = state.collected(streams, f"file://{tmp_path}/out").groupBy("source").count().collect()
    assert sorted(map(tuple, got)) == [("good", 5), ("other", 5)]


def test_delivered_again_is_one_item(spark, tmp_path):
    rows = [(i % 7, f"2024-03-0{1 + i % 3} 0{i % 9}:00:00") for i in range(60)]
    stream = micro_batches(spark, rows, "id int, ts string", tmp_path, 4, 3)
    deduped = feed.stream_dedup(stream, ["id"], "30 days")
    state.write_available(deduped, "append", f"file://{tmp_path}/out", f"file://{tmp_path}/log", idle=True)
    assert sorted(r["id"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == list(range(7))
