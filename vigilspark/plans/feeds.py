"""Queries for vigilspark.streaming.feed."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilspark.plans.registry import query
from vigilspark.streaming import feed as f
from vigilspark.streaming import state

# Deliveries: an id's last event of a day counts; event_id orders them.
_D = "(SELECT id, day, source, level, event_id AS seq FROM {feed})"
_DAILY = f"(SELECT id, day, arg_max(source, seq) AS source, arg_max(level, seq) AS level FROM {_D} GROUP BY 1, 2)"


def _deliveries(v):
    return v.feed.withColumnRenamed("event_id", "seq")


@query("r1_upsert_items", f"""SELECT id, min(day) AS first_seen, max(day) AS last_seen, arg_max(source, day || lpad(CAST(seq AS VARCHAR), 12, '0')) AS source, arg_max(level, day || lpad(CAST(seq AS VARCHAR), 12, '0')) AS level
FROM {_D} GROUP BY 1""")
def _(v):
    return f.upsert_items(_deliveries(v))


_CHANGES = f"""(SELECT id, day, CASE WHEN source <> ps AND level <> pl THEN 'source,level' WHEN source <> ps THEN 'source'
WHEN level <> pl THEN 'level' END AS changes FROM (SELECT *, lag(source) OVER w AS ps, lag(level) OVER w AS pl
FROM {_DAILY} WINDOW w AS (PARTITION BY id ORDER BY day)) WHERE ps IS NOT NULL AND (source <> ps OR level <> pl))"""


@query("r2_detect_changes", f"SELECT * FROM {_CHANGES}")
def _(v):
    return f.detect_changes(_deliveries(v), ["source", "level"]).withColumn("changes", F.array_join("changes", ","))


def _checkpoint(v):
    return v.folder("streams")


# The same feed with missing fields, dealt over four files, so that days come late and twice: a file is a micro-batch.
_FILES = 4
_GAPPY = """(SELECT id, day, event_id AS seq, CASE WHEN event_id % 13 > 0 THEN source END AS source, CASE WHEN event_id % 17 > 0 THEN level END AS level
FROM {feed} QUALIFY row_number() OVER (PARTITION BY id, day ORDER BY event_id DESC) = 1)"""


def _stream(v, rows, files, in_order=False):
    """``rows`` as a stream of files, one a micro-batch; ``in_order``: of their numbers, as far as they are known."""
    path = v.folder("incoming")
    if in_order:  # the source reads older files first, so they are written one after the other
        for k in sorted(r[0] for r in rows.select("file").distinct().collect()):
            rows.where(F.col("file") == k).coalesce(1).write.mode("append").parquet(path)
    else:
        rows.repartition(files, "file").write.parquet(path)
    return v.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path).drop("file")


def _output(v, stream, mode):
    """What a stream over the files that are there wrote, with the number of the micro-batch."""
    state.use_rocksdb(v.spark)
    out = _checkpoint(v)
    state.write_available(stream, mode, out, out + "-log", idle=mode == "append")
    return v.spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(out)


@query("r1_item_stream", f"""WITH p AS (SELECT *, lag(source) OVER w AS ps, lag(level) OVER w AS pl FROM {_GAPPY} WINDOW w AS (PARTITION BY id ORDER BY day)),
c AS (SELECT *, concat_ws(',', CASE WHEN source <> ps THEN 'source' END, CASE WHEN level <> pl THEN 'level' END) AS changes FROM p),
i AS (SELECT id, min(day) AS first_seen, max(day) AS last_seen, arg_max({{'s': source, 'l': level}}, day) AS r FROM c GROUP BY 1)
SELECT i.id, r.s AS source, r.l AS level, first_seen, last_seen, updated, coalesce(u.changes, '') AS changes FROM i
LEFT JOIN (SELECT id, max(day) AS updated, arg_max(changes, day) AS changes FROM c WHERE changes <> '' GROUP BY 1) u USING (id)""")
def _(v):
    """The stateful stream in micro-batches that bring late days, same days again and missing fields."""
    seq = F.col("event_id")
    rows = v.feed.select("id", "day", seq.alias("seq"), F.when(seq % 13 > 0, F.col("source")).alias("source"),
        F.when(seq % 17 > 0, F.col("level")).alias("level"), (seq * 7 % _FILES).alias("file"))
    items = _output(v, state.item_stream(_stream(v, rows, _FILES)), "update")
    newest = items.groupBy("id").agg(F.max_by(F.struct(*(c for c in items.columns if c not in ("id", "batch"))), "batch").alias("r"))
    return newest.select("id", "r.source", "r.level", "r.first_seen", "r.last_seen", "r.updated", F.array_join("r.changes", ",").alias("changes"))


# Users stand for sources: each has a cadence, and one in nine is retired.
_CADENCE = "CAST(1 + {0} % 3 AS INT)"


@query("a34_quiet_stream", f"""WITH s AS (SELECT DISTINCT user_id AS source, {_CADENCE.format('user_id')} AS cadence FROM {{events}} WHERE user_id % 9 > 0
UNION ALL SELECT -1, 4),
d AS (SELECT source, '2024-01-01' AS day FROM s UNION SELECT user_id, {{date:ts}} FROM {{events}}),
g AS (SELECT source, day, lead(day) OVER (PARTITION BY source ORDER BY day) AS after FROM d),
q AS (SELECT source, day AS latest, after, CAST(CAST(day AS DATE) + CAST(2 * cadence + 1 AS INT) AS DATE) AS quiet FROM g JOIN s USING (source))
SELECT source, latest, strftime(quiet, '%Y-%m-%d') AS quiet_from FROM q WHERE quiet <= (SELECT CAST(max(ts) - INTERVAL 2 DAY AS DATE) FROM {{events}})
AND (after IS NULL OR CAST(after AS DATE) >= quiet)""")
def _(v):
    """Alarms by timers, over files of ten days each and in any order within them."""
    events = v.events.select(F.col("user_id").alias("source"), "ts", F.floor(F.unix_timestamp("ts") / 864_000).alias("file"))
    sources = v.events.where("user_id % 9 > 0").select(F.col("user_id").alias("source"), F.expr(_CADENCE.format("user_id")).alias("cadence")).distinct().union(
        v.spark.createDataFrame([(-1, 4)], "source long, cadence int")).withColumn("start", F.lit("2024-01-01"))
    return _output(v, state.quiet_stream(_stream(v, events, 4, in_order=True), sources), "append").drop("batch")


@query("r4_source_streams", """SELECT event_type AS source, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN 0 ELSE count(*) END AS
count, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(sum(event_id) AS BIGINT) END AS ids FROM {events} GROUP BY 1""")
def _(v):
    """A stream for each event type, of which one can't be read: the others' rows are there all the same."""
    kinds = [r[0] for r in v.events.select("event_type").distinct().orderBy("event_type").collect()]
    path = f"{v.sf_dir}/events.parquet*"
    read = lambda kind: v.spark.readStream.schema(v.events.schema).parquet(path).where(F.col("event_type") == kind).select(
        F.when(F.col("event_type") == "error", F.raise_error(F.lit("the source sent nonsense"))).otherwise(F.col("event_id")).cast("long").alias("event_id"))
    out = v.folder("collected")
    streams = {k: read(k) for k in kinds}
    health = state.collect_sources(streams, out, v.folder("streams"))
    items = state.collected(streams, out).groupBy("source").agg(F.count("*").alias("count"), F.sum("event_id").alias("ids"))
    zero = F.lit(0).cast("long")
    return health.drop("count").join(items, "source", "left").select("source", "ok", F.coalesce("count", zero).alias("count"), F.coalesce("ids", zero).alias("ids"))


@query("r3_enrich_once", """SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 AND p_partkey % 5 > 0 THEN 'new ' || p_name ELSE p_type END AS summary, CASE
WHEN p_size % 3 = 0 AND p_partkey % 5 > 0 THEN 2 WHEN p_size % 3 = 0 THEN 1 ELSE 2 END AS enrich_v FROM {part}""")
def _(v):
    items = v.part.select(F.col("p_partkey").alias("id"), "p_name", F.col("p_type").alias("summary"), F.when(F.col("p_size") % 3 == 0, 1).otherwise(2).alias("enrich_v"))
    return f.enrich_once(items, 2, lambda df: df.withColumn("new_summary", F.concat(F.lit("new "), "p_name")).withColumn("ok", F.col("id") % 5 > 0)).drop("p_name")


_RUNS = "(SELECT event_type AS source, {date:ts} AS day, CAST(count(*) AS BIGINT) AS n, count(*) % 3 > 0 AS ok FROM {events} GROUP BY 1, 2)"


@query("r4_source_health", f"""SELECT s.source, coalesce(arg_max(ok, day), false) AS ok, max(day) FILTER (ok) AS last_ok, max(day) AS last_try, CASE
WHEN NOT arg_max(ok, day) THEN 'failed' END AS error, coalesce(arg_max(n, day), 0) AS count FROM (SELECT DISTINCT event_type AS source
FROM {{events}} WHERE event_type <> 'click' UNION SELECT 'silent') s LEFT JOIN {_RUNS} r ON s.source = r.source GROUP BY 1""")
def _(v):
    runs = v.events.groupBy(F.col("event_type").alias("source"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("count"),
        (F.count("*") % 3 > 0).alias("ok")).withColumn("error", F.lit("failed"))
    sources = v.events.select(F.col("event_type").alias("source")).distinct().where("source <> 'click'").union(v.spark.createDataFrame([("silent",)], "source string"))
    return f.source_health(runs, sources)


@query("r5_tumbling_counts", """SELECT strftime(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS start, event_type AS key,
count(*) AS n FROM {events} GROUP BY 1, 2""")
def _(v):
    return f.tumbling_counts(v.events.select("ts", F.col("event_type").alias("key")), "7 days")


@query("r5_tumbling_stream", "SELECT {date:ts} AS start, event_type AS key, count(*) AS n FROM {events} GROUP BY 1, 2")
def _(v):
    stream = v.spark.readStream.schema(v.events.schema).parquet(f"{v.sf_dir}/events.parquet*").select("ts", F.col("event_type").alias("key"))
    out = _checkpoint(v)
    q = f.tumbling_counts(stream, "1 day").writeStream.outputMode("update").foreachBatch(lambda df,
        n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", out + "-log").trigger(availableNow=True).start()
    q.awaitTermination()
    return v.spark.read.parquet(out).groupBy("start", "key").agg(F.max_by("n", "batch").alias("n"))


@query("r6_stream_dedup", "SELECT DISTINCT user_id, {date:ts} AS day FROM {events}")
def _(v):
    rows = v.events.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return f.stream_dedup(rows.union(rows), ["user_id", "day"])


@query("r6_dedup_stream", "SELECT DISTINCT user_id, {date:ts} AS day FROM {events}")
def _(v):
    """Every delivery comes twice, in other files."""
    rows = v.events.select("user_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("event_id") % 3).alias("file"))
    both = rows.union(rows.withColumn("file", F.pmod(F.col("file") + 1, F.lit(3))))
    return _output(v, f.stream_dedup(_stream(v, both, 3), ["user_id", "day"], "400 days"), "append").select("user_id", "day")


@query("r7_first_run_guard", """SELECT bool_and(d = '2024-01-03') AS first_load, count(*) AS items, CAST(CASE WHEN bool_and(d = '2024-01-03') THEN 0 ELSE
count(*) FILTER (d = '2024-01-03') END AS BIGINT) AS new FROM (SELECT user_id, min({date:ts}) AS d FROM {events} GROUP BY 1)""")
def _(v):
    return f.first_run_guard(v.events.groupBy("user_id").agg(F.min(F.date_format("ts", "yyyy-MM-dd")).alias("first_seen")),
        "2024-01-03").withColumn("new", F.col("new").cast("long"))


@query("a34_source_freshness", """SELECT s.source, s.cadence, max(d) AS latest, CAST(date_diff('day',
CAST(max(d) AS DATE), DATE '2024-02-09') AS INT) AS age_days, max(d) IS NULL OR date_diff('day',
CAST(max(d) AS DATE), DATE '2024-02-09') > 2 * s.cadence AS quiet FROM (SELECT event_type AS source, length(event_type) AS cadence FROM {events}
GROUP BY 1, 2 UNION SELECT 'silent', 3) s LEFT JOIN (SELECT event_type, {date:ts} AS d FROM {events}) e ON e.event_type = s.source GROUP BY 1, 2""")
def _(v):
    items = v.events.select(F.col("event_type").alias("source"), F.date_format("ts", "yyyy-MM-dd").alias("date"))
    sources = items.select("source", F.length("source").alias("cadence")).distinct().union(v.spark.createDataFrame([("silent", 3)], "source string, cadence int"))
    return f.source_freshness(items, sources, "2024-02-09")
