"""Structured Streaming over a folder or file of events, run until all that is there has been read."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace import storage

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream. Watermarks need a timestamp with zone, so ts is cast.

    The table may be a file or a folder; a stream reads a lone file only by a pattern.
    """
    raw = spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parque[t]")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


#: The state store that keyed state with timers needs.
TIMERS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def drained(stream: DataFrame, mode: str = "append", conf: dict[str, str] | None = None) -> DataFrame:
    """Run the stream over all available input into Parquet (exactly once), and read that. conf holds for this query.

    In update mode each micro-batch is a folder of its own (column batch), written anew if the batch is run again.
    """
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    out = storage.scratch(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(f"{out}/rows")
    else:
        query = writer.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")).start()
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{out}/rows")
    return spark.read.schema(StructType([*stream.schema, StructField("batch", LongType())])).parquet(f"{out}/rows")


def window_counts(stream: DataFrame, size: str, late: str) -> DataFrame:
    """Events by type in tumbling windows that the watermark has closed."""
    grouped = stream.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n")


def user_sessions(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """Closed sessions by user."""
    grouped = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n_events"))
    return grouped.select("user_id", F.col("s.start").alias("session_start"), "n_events")


def first_by(stream: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Rows without later ones of the same keys inside the watermark; state is dropped behind it."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def daily_totals(stream: DataFrame, late: str) -> DataFrame:
    """For each user and day, the number of events and purchases so far, in update mode; a day's state goes when the watermark passes it."""
    bought = F.count(F.when(F.col("event_type") == "purchase", 1))
    grouped = stream.withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n_events"), bought.alias("n_purchases"))
    return grouped.select("user_id", F.col("w.start").alias("day"), "n_events", "n_purchases")


def running_totals(daily: DataFrame) -> DataFrame:
    """For each user and day, the running number of events and purchases, from the drained rows of daily_totals: the last of each day, summed up."""
    last = daily.groupBy("user_id", "day").agg(*[F.max_by(c, "batch").alias(c) for c in ("n_events", "n_purchases")])
    upto = Window.partitionBy("user_id").orderBy("day")
    return last.select("user_id", "day", *[F.sum(c).over(upto).alias(c) for c in ("n_events", "n_purchases")])


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, seconds: int, late: str, how: str = "inner") -> DataFrame:
    """Pairs of two streams with equal keys and 0 <= left_time - right_time < seconds; left rows without a pair (how: leftOuter) when the watermark tells that none can come.

    Both sides have a watermark, and the time condition bounds what either can still meet, so state goes on both. Columns must differ but for keys.
    """
    a, b = left.withWatermark(left_time, late), right.withWatermark(right_time, late).withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    near = [F.col(right_time) <= F.col(left_time), F.col(right_time) > F.col(left_time) - F.expr(f"INTERVAL {seconds} SECONDS")]
    return a.join(b, reduce(and_, [*same, *near]), how).drop(*[f"__{k}" for k in keys])


def step_sessions(stream: DataFrame, steps: list[str], idle: int, late: str) -> DataFrame:
    """Closed sessions by user, with how many of the steps were taken in order, each by its earliest event after the one before.

    An open session is a row of keyed state, its events' times and kinds. Once the watermark is idle seconds past the last one of them,
    the session comes out and its state goes, so idle users have none. What comes late but before that is put in order.
    A user's events of one open session are held together. State and its timer are those of Spark's session window, so no event goes
    through Python; with TIMERS the state lies on disk. That window takes in what begins just at its end, so it is a microsecond short, and
    closes that much early. Rows without a time are left out.
    """
    kinds = list(dict.fromkeys(steps))
    # 0: no step
    kind = F.coalesce(*[F.when(F.col("event_type") == k, i) for i, k in enumerate(kinds, 1)], F.lit(0))
    rows = stream.withWatermark("ts", late).select("user_id", "ts", F.struct(F.unix_micros("ts").alias("us"), kind.alias("kind")).alias("event"))
    held = rows.groupBy("user_id", F.session_window("ts", f"{idle * 1_000_000 - 1} microseconds").alias("s")).agg(F.collect_list("event").alias("events"))
    # no event is of the kind behind the last step
    wanted = F.array(*[F.lit(kinds.index(k) + 1) for k in steps], F.lit(-1))

    def take(done, event):
        follows = (event["kind"] == F.element_at(wanted, done["depth"] + 1)) & (done["last"].isNull() | (event["us"] > done["last"]))
        return F.when(follows, F.struct((done["depth"] + 1).alias("depth"), event["us"].alias("last"))).otherwise(done)

    none = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("long").alias("last"))
    depth = F.aggregate(F.array_sort("events"), none, take, lambda done: done["depth"])
    return held.select("user_id", F.col("s.start").alias("session_start"), F.size("events").cast("long").alias("n_events"), depth.alias("depth"))
