"""Structured Streaming jobs over observations, moves and project events (key, id, ts, status, value)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plotwright.tables import shared_dir


def source(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream of the Parquet files at a path (a folder or a single file), so many a batch if that is given, timestamps with a zone."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).options(**({"maxFilesPerTrigger": files} if files else {})).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, a single file will do too
    return stream.withColumns({c: F.col(c).cast("timestamp") for c, kind in stream.dtypes if kind == "timestamp_ntz"})


def fresh(observed: DataFrame, ttl: str) -> DataFrame:
    """The first observation of each key within the time to live; its repeats are dropped."""
    return observed.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["key"])


def _in_time(rows: Iterator[pd.DataFrame], timerValues) -> pd.DataFrame:
    """A key's rows of a batch in order, but for those older than the watermark (Spark itself drops them a batch later)."""
    whole = pd.concat(list(rows)).sort_values(["ts", "id"], kind="stable")
    whole["us"] = whole["ts"].astype("datetime64[us]").astype("int64")
    return whole[whole["us"] >= 1000 * timerValues.getCurrentWatermarkInMs()]


class _Fresh(StatefulProcessor):
    """Passes an observation if its key has none that is younger than the time to live; what has run out is forgotten by a timer."""

    def __init__(self, ttl: pd.Timedelta):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.until.get()
        until = before = held[0] if held else None
        kept = []
        for row in _in_time(rows, timerValues).itertuples(index=False):
            if until is None or row.us >= until:
                kept.append((row.key, row.id, row.ts))
                until = int(row.us + self.ttl // pd.Timedelta(microseconds=1))
        if until != before:
            if before is not None:
                self.handle.deleteTimer(-(-before // 1000))
            self.until.update((until,))
            self.handle.registerTimer(-(-until // 1000))
        if kept:
            yield pd.DataFrame(kept, columns=["key", "id", "ts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        return iter([])


class _Live(StatefulProcessor):
    """Keeps of each key the latest status and the greatest value since it was last idle; an idle key is forgotten by a timer."""

    def __init__(self, idle: pd.Timedelta):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "us long, id long, status string, most double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        us, last, status, most, n = self.state.get() or (None, None, None, None, 0)
        before, idle = us, self.idle // pd.Timedelta(microseconds=1)
        whole = _in_time(rows, timerValues)
        if not len(whole):
            return
        for row in whole.itertuples(index=False):
            at = row.us
            if us is not None and at - us > idle:
                us, last, status, most, n = None, None, None, None, 0
            if us is None or (at, row.id) >= (us, last):
                us, last, status = int(at), int(row.id), row.status
            if not pd.isna(row.value):
                most = float(row.value) if most is None else max(most, float(row.value))
            n += 1
        if before is not None:
            self.handle.deleteTimer((before + idle) // 1000 + 1)
        self.handle.registerTimer((us + idle) // 1000 + 1)
        self.state.update((us, last, status, most, n))
        yield pd.DataFrame({"key": [whole["key"].iloc[0]], "ts": [pd.Timestamp(us, unit="us", tz="UTC")], "status": [status], "most": [most], "n": [n]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])


def fresh_again(observed: DataFrame, ttl: str, late: str = "0 seconds") -> DataFrame:
    """key, id, ts of each observation (key, id, ts) that finds none of its key younger than the time to live: the first, and the first after each that has run out.

    State is one moment a key, and goes with its timer; what comes later than the watermark is dropped.
    """
    kinds = observed.schema
    out = f"key {kinds['key'].dataType.simpleString()}, id {kinds['id'].dataType.simpleString()}, ts timestamp"
    own = observed.select("key", "id", "ts").withWatermark("ts", late)
    return own.groupBy("key").transformWithStateInPandas(_Fresh(pd.Timedelta(ttl)), out, "append", "EventTime")


def live_state(events: DataFrame, idle: str, late: str = "0 seconds") -> DataFrame:
    """key, ts, status, most, n after each batch in which a key has events (key, id, ts, status, value): since it was last idle for longer than that."""
    out = f"key {events.schema['key'].dataType.simpleString()}, ts timestamp, status string, most double, n long"
    own = events.select("key", "id", "ts", "status", F.col("value").cast("double").alias("value")).withWatermark("ts", late)
    return own.groupBy("key").transformWithStateInPandas(_Live(pd.Timedelta(idle)), out, "update", "EventTime")


def in_batches(spark: SparkSession, table: DataFrame, by: str, n: int) -> DataFrame:
    """A stream of a table in n batches by ranges of a column, each batch from files of its own in the shared folder."""
    import uuid

    path = f"{shared_dir(spark)}/streams/source-{uuid.uuid4().hex}"
    cuts = table.agg(F.percentile_approx(F.col(by).cast("timestamp").cast("double"), [k / n for k in range(1, n)], 10_000)).first()[0] or []
    at = F.col(by).cast("timestamp").cast("double")
    for low, high in zip([None, *cuts], [*cuts, None]):
        inside = (F.lit(True) if low is None else at >= low) & (F.lit(True) if high is None else at < high)
        table.where(inside).coalesce(1).write.mode("append").parquet(path)
    return source(spark, path, 1)


def checked_moves(moves: DataFrame, zones: DataFrame) -> DataFrame:
    """Moves (site_id, x, y) joined to the static zones (site_id, id, x0, y0, x1, y1) that they land on, if any."""
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    z = zones.withColumnsRenamed({"site_id": "z_site", "id": "zone_id"})
    return moves.join(z, (F.col("site_id") == F.col("z_site")) & inside, "left").withColumn("is_valid", F.col("zone_id").isNull()).drop("z_site", "x0", "y0", "x1", "y1")


def status_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events a status and tumbling window; what comes later than the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "status", "n")


def latest_state(events: DataFrame) -> DataFrame:
    """Per key its latest status and its greatest value so far."""
    return events.groupBy("key").agg(F.max_by("status", F.struct("ts", "id")).alias("status"), F.max("value").alias("most"))


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State of single keys and timers need this store; a query keeps the store that it has started with."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def run(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All there is of a stream, worked off and written to the shared folder; complete results replace the ones before, updates get the number of their batch."""
    import uuid

    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(f"{base}/rows")
    elif mode == "update":
        query = writer.foreachBatch(lambda df, batch: df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{base}/rows/part={batch}")).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema.add("batch", "long")).option("basePath", f"{base}/rows").parquet(f"{base}/rows")
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
