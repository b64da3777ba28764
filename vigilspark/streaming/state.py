"""Stateful streams of the feed board: items by day, sources that fall silent, sources that fail.

All need the RocksDB state store (see use_rocksdb)."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_WHOLE = ("byte", "short", "integer", "long")
_DAY_MS = 86_400_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def write_available(stream: DataFrame, mode: str, out: str, checkpoint: str, idle: bool) -> None:
    """Run a stream over what is there, each micro-batch into a folder ``batch=...`` of ``out``; one that is run again
    after a failure replaces its folder.

    ``idle``: whether micro-batches without rows run too.  Timers by event time need them; state with a processing-time
    limit would ask for one after the other without end."""
    spark, setting = stream.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(idle).lower())
    try:
        stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)


class ItemState(StatefulProcessor):
    """An item's days, each with its last delivery and what it changed; days and items leave after ``ttl_ms``.

    A delivery may come in any micro-batch: a second one of a day replaces it if its ``seq`` is larger, and a late
    day is put between its neighbours, whose changes are found anew.  A day whose predecessor has left keeps the
    changes that were found while it was there."""

    def __init__(self, fields: dict[str, str], watched: list[str], ttl_ms: int):
        self.fields, self.watched, self.ttl_ms = fields, watched, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        typed = "seq long, " + ", ".join(f"{c} {kind}" for c, kind in self.fields.items()) + ", changes array<string>"
        self.days = handle.getMapState("days", "day string", typed, self.ttl_ms)
        self.item = handle.getValueState("item", f"first_seen string, updated string, updates array<string>, day string, {typed}", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = ["day", "seq", *self.fields]
        new = pd.concat(rows)[columns].astype(object)
        kept = pd.DataFrame([(*day, *held) for day, held in self.days.iterator()], columns=[*columns, "changes"], dtype=object)
        first, updated, updates = None, None, []
        if self.item.exists():  # the newest day is here too, should it have left the map
            first, updated, updates, *newest = self.item.get()
            if not (kept["day"] == newest[0]).any():
                kept.loc[len(kept)] = newest
        every = pd.concat([kept, new], ignore_index=True).sort_values(["day", "seq"], kind="stable").drop_duplicates("day", keep="last").reset_index(drop=True)
        values, before = every[self.watched], every[self.watched].shift()
        filled = lambda x: x.notna() & (x != "")
        changed = (filled(values) & filled(before) & (values != before)).to_numpy()
        found = [[c for c, flag in zip(self.watched, row) if flag] for row in changed]
        oldest = kept.loc[kept["day"] == every["day"][0], "changes"]
        if len(oldest) and oldest.iloc[0] is not None:
            found[0] = list(oldest.iloc[0])
        every["changes"] = found
        whole = [self._plain(row) for row in every[[*columns, "changes"]].itertuples(index=False)]
        had = {row[0]: row for row in map(self._plain, kept.itertuples(index=False))}
        for row in whole:
            if had.get(row[0]) != row:
                self.days.updateValue((row[0],), row[1:])
        updating = [row for row in whole if row[-1]]
        there = {row[0] for row in whole}
        if updating and (updated is None or updated in there or updating[-1][0] > updated):
            updated, updates = updating[-1][0], updating[-1][-1]
        elif updated in there:
            updated, updates = None, []
        first = min(whole[0][0], first or whole[0][0])
        newest = whole[-1]
        self.item.update((first, updated, list(updates or []), *newest))
        yield pd.DataFrame([[key[0], *newest[2:-1], first, newest[0], updated, list(updates or [])]], columns=["id", *self.fields, "first_seen", "last_seen", "updated", "changes"])

    def _plain(self, row) -> tuple:
        """Missing values as None, whole numbers as int (pandas makes floats of them beside missing ones)."""
        day, seq, *values, changes = row
        values = [None if pd.isna(v) else int(v) if kind in ("int", "bigint", "smallint", "tinyint") else v for v, kind in zip(values, self.fields.values())]
        return (day, int(seq), *values, list(changes) if isinstance(changes, (list, tuple)) else [])

    def close(self) -> None:
        pass


def item_stream(stream: DataFrame, watched: list[str] | None = None, ttl: timedelta = timedelta(days=90)) -> DataFrame:
    """Streaming form of upsert_items and detect_changes: a row an item and micro-batch with its newest state.

    ``stream`` has id, day, seq and the fields; all of them are watched unless said otherwise.  An item's state ends
    ``ttl`` after its last delivery, a day's after its own."""
    fields = {f.name: f.dataType.simpleString() for f in stream.schema if f.name not in ("id", "day", "seq")}
    out = f"id {stream.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} {kind}" for c,
        kind in fields.items()) + ", first_seen string, last_seen string, updated string, changes array<string>"
    state = ItemState(fields, list(fields) if watched is None else watched, int(ttl.total_seconds() * 1000))
    return stream.groupBy("id").transformWithStateInPandas(statefulProcessor=state, outputStructType=out, outputMode="Update", timeMode="ProcessingTime")


class SourceState(StatefulProcessor):
    """A source's days with items, and a timer for each: when no later one has come within twice the cadence, the
    timer tells so, without a row of that source.  A day leaves with its timer, so the state stays short."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cadence = handle.getValueState("cadence", "days int")
        self.days = handle.getMapState("days", "day int", "seen boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.cadence.update((int(initialState["cadence"].iloc[0]),))
        self._watch(_number(initialState["start"].iloc[0]))

    def _watch(self, day: int) -> None:
        if not self.days.containsKey((day,)):
            self.days.updateValue((day,), (True,))
            self.handle.registerTimer((day + 2 * self.cadence.get()[0] + 1) * _DAY_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.cadence.exists():  # else the source is retired
            for day in sorted({_number(d) for frame in rows for d in frame["day"].unique()}):
                self._watch(day)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = 2 * self.cadence.get()[0]
        at = expiredTimerInfo.getExpiryTimeInMs() // _DAY_MS
        day = at - last - 1
        if not any(day < other[0] <= day + last for other in self.days.keys()):
            yield pd.DataFrame([[key[0], _text(day), _text(at)]], columns=["source", "latest", "quiet_from"])
        self.days.removeKey((day,))

    def close(self) -> None:
        pass


def _number(day: str) -> int:
    return date.fromisoformat(str(day)).toordinal() - date(1970, 1, 1).toordinal()


def _text(day: int) -> str:
    return date.fromordinal(day + date(1970, 1, 1).toordinal()).isoformat()


def quiet_stream(items: DataFrame, sources: DataFrame, late: str = "2 days") -> DataFrame:
    """(source, latest, quiet_from): a source has brought nothing for more than twice its cadence after ``latest``.

    ``items`` (source, ts) is a stream, ``sources`` (source, cadence in days, start) a table; sources that aren't in
    it are retired and raise no alarm.  Alarms come when the watermark, ``late`` behind the newest item of any source,
    passes their day, and equal quiet_spells as long as no item is later than that."""
    dated = items.select("source", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    kind = dated.schema["source"].dataType.simpleString()
    known = sources.select(F.col("source").cast(kind).alias("source"), F.col("cadence").cast("int").alias("cadence"), F.col("start").cast("string").alias("start"))
    return dated.groupBy("source").transformWithStateInPandas(
        statefulProcessor=SourceState(), outputStructType=f"source {kind}, latest string, quiet_from string", outputMode="Append", timeMode="EventTime",
        initialState=known.groupBy("source"))


def quiet_spells(items: DataFrame, sources: DataFrame, until: str) -> DataFrame:
    """Batch form of quiet_stream over the items (source, day) up to the day that the watermark reached."""
    from pyspark.sql import Window

    days = sources.select("source", F.col("start").alias("day")).unionByName(items.select("source", "day")).distinct()
    after = F.lead("day").over(Window.partitionBy("source").orderBy("day"))
    quiet = F.date_add(F.to_date("day"), 2 * F.col("cadence") + 1)
    spells = days.withColumn("_after", after).join(sources.select("source", "cadence"), "source").withColumn("_quiet", quiet)
    return spells.where((F.col("_quiet") <= F.to_date(F.lit(until))) & (F.col("_after").isNull() | (F.to_date("_after") >= F.col("_quiet")))).select(
        "source", F.col("day").alias("latest"), F.date_format("_quiet", "yyyy-MM-dd").alias("quiet_from"))


def collect_sources(streams: dict[str, DataFrame], out: str, checkpoint: str) -> DataFrame:
    """Run every source's stream over what is there, each as a query of its own, and say how each one did.

    Rows (source, ok, error, count) for the sources; items are below ``out``, in a folder ``source=...`` each.  A source
    that fails stops its own query only: what it has committed stays, the others go on, and its next run takes up where
    its checkpoint ends."""
    queries, failed, had = {}, {}, {}
    for name, stream in streams.items():
        had[name] = _rows_in(stream, f"{out}/source={name}")
        try:
            queries[name] = stream.writeStream.format("parquet").option("path", f"{out}/source={name}").option(
                "checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
        except Exception as e:  # a stream that can't even be planned
            failed[name] = str(e)
    for name, query in queries.items():
        try:
            query.awaitTermination()
        except Exception as e:
            failed[name] = str(e)
    rows = [(name, name not in failed, failed.get(name, "")[:120] or None, 0 if name in failed else _rows_in(stream, f"{out}/source={name}") - had[name])
            for name, stream in streams.items()]
    spark = next(iter(streams.values())).sparkSession if streams else SparkSession.active()
    return spark.createDataFrame(rows, "source string, ok boolean, error string, count long")


def collected(streams: dict[str, DataFrame], out: str) -> DataFrame:
    """What collect_sources has committed, with its ``source``.

    Each folder is read by its own log, so files that a failed run left behind don't count."""
    parts = [part.withColumn("source", F.lit(name)) for name, stream in streams.items() if (part := _committed(stream, f"{out}/source={name}")) is not None]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _committed(stream: DataFrame, path: str) -> DataFrame | None:
    """What a stream's sink has committed; nothing before its first run."""
    try:
        return stream.sparkSession.read.schema(stream.schema).parquet(path)
    except AnalysisException:
        return None


def _rows_in(stream: DataFrame, path: str) -> int:
    found = _committed(stream, path)
    return 0 if found is None else found.count()
