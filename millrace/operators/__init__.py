"""Relational and event-time operators on DataFrames."""

from __future__ import annotations

from collections import deque
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace import storage


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key. Spark keeps k rows a key and task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs of equal keys with 0 <= left_time - right_time < seconds, as an equality join on time buckets.

    Right rows go to their own bucket of that length and to the next; a pair then meets in exactly one,
    so a long history of a key is spread over its buckets. Columns of the two sides must differ but for keys.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    a = left.withColumn("__bucket", bucket(left_time))
    b = right.withColumn("__bucket", F.explode(F.array(bucket(right_time), bucket(right_time) + 1)))
    gap = F.unix_micros(F.col(left_time).cast("timestamp")) - F.unix_micros(F.col(right_time).cast("timestamp"))
    return a.join(b, [*keys, "__bucket"]).filter((gap >= 0) & (gap < seconds * 1_000_000)).drop("__bucket")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, ties: str) -> DataFrame:
    """left with the value of the latest right row of the same key that is not later.

    One union and one window over the key: no join. `ties` orders rows of one time, right rows first.
    """
    a = left.withColumn("__value", F.lit(None).cast(right.schema[value].dataType)).withColumn("__left", F.lit(True))
    b = right.select(*keys, time, ties, F.col(value).alias("__value"), F.lit(False).alias("__left"))
    w = Window.partitionBy(*keys).orderBy(time, "__left", ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(f"last_{value}", F.last("__value", ignorenulls=True).over(w))
    return both.filter("__left").select(*left.columns, f"last_{value}")


def sessions(df: DataFrame, key: str, time: str, gap: str, *aggregates: Column) -> DataFrame:
    """Aggregates of runs of rows with less than gap between them."""
    grouped = df.groupBy(key, F.session_window(time, gap).alias("__s")).agg(*aggregates)
    return grouped.select(key, F.col("__s.start").alias("session_start"), F.col("__s.end").alias("session_end"), *[c for c in grouped.columns if c not in (key, "__s")])


def funnel(df: DataFrame, key: str, time: str, kind: str, steps: list[str], within: str | None = None) -> DataFrame:
    """For each key that took the first step, how many steps it took in order, each by its earliest time
    after the one before and all within an interval of the first step."""
    first = df.filter(F.col(kind) == steps[0]).groupBy(key).agg(F.min(time).alias("t0"))
    found, last = first, "t0"
    for i, step in enumerate(steps[1:], 1):
        rows = df.filter(F.col(kind) == step).select(key, F.col(time).alias("__t"))
        limit = F.col("__t") <= F.col("t0") + F.expr(f"INTERVAL {within}") if within else F.lit(True)
        hits = found.join(rows, key).filter((F.col("__t") > F.col(last)) & limit).groupBy(key).agg(F.min("__t").alias(f"t{i}"))
        found, last = found.join(hits, key, "left"), f"t{i}"
    depth = reduce(lambda a, b: a + b, [F.col(f"t{i}").isNotNull().cast("int") for i in range(len(steps))])
    return found.select(key, depth.alias("depth"))


def pivot(df: DataFrame, keys: list[str], column: str, values: list[str], measure: Column) -> DataFrame:
    """A pivot over stated values: naming them spares the pass that would look for them."""
    return df.groupBy(*keys).pivot(column, values).agg(measure)


def quantiles(df: DataFrame, key: str, value: str, at: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of value by key, one column for each entry of at (name to share).

    Equal values are counted first. The counts are dealt to partitions by ranges of key and value, so that a key of many values
    lies in many of them, whatever its outliers; they are stored once, with the partition as their bucket. The sums of buckets tell which ones hold a
    wanted rank, and only those are looked at value by value. A task holds one range of values at most, never a key.
    Null keys, null values and NaN are left out.
    """
    rows = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value)).groupBy(key, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = storage.stored(rows.repartitionByRange(parts, key, "v").withColumn("bucket", F.spark_partition_id()), "values")
    # one row for each key and partition
    sizes = placed.groupBy(key, "bucket").agg(F.sum("c").alias("size"))
    whole = Window.partitionBy(key)
    before = F.sum("size").over(whole.orderBy("bucket")) - F.col("size")
    ranked = sizes.select(key, "bucket", "size", before.alias("before"), F.sum("size").over(whole).alias("n"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in at.items()])
    asked = ranked.select("*", F.explode(wanted).alias("w")).select(key, "bucket", "before", "size", "w.name", (F.col("w.q") * (F.col("n") - 1)).alias("pos"))
    asked = asked.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos")))))
    asked = asked.filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("size"))).select(key, "bucket", "before", "name", "pos", "rank")
    inside = placed.join(asked.select(key, "bucket").distinct(), [key, "bucket"], "left_semi")
    upto = inside.withColumn("upto", F.sum("c").over(Window.partitionBy(key, "bucket").orderBy("v")))
    found = upto.join(asked, [key, "bucket"]).filter((F.col("rank") - F.col("before") < F.col("upto")) & (F.col("rank") - F.col("before") >= F.col("upto") - F.col("c")))
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    each = found.groupBy(key, "name").agg((low + (high - low) * (F.first("pos") - F.min("rank"))).alias("q"))
    return storage.stored(each.groupBy(key).agg(*[F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in at]), "quantiles")


def matched_once(df: DataFrame, key: str, time: str, kind: str, row: str, opens: str, closes: str, seconds: int) -> DataFrame:
    """Pairs of a closing row and the latest opening row of its key that is not later, at most so many seconds before and not taken by an earlier pair.

    Which pairs there are depends on all pairs before, so no join or window tells them: a table function goes once over each key's rows in
    order (ties by row, opening rows first) and holds the opening rows of the last seconds only. Rows without key or time are in no pair.
    """

    @F.udtf(returnType="key long, closed long, opened long")
    class Pairs:
        def __init__(self):
            self.open = deque()

        def eval(self, r):
            if r["kind"] == opens:
                self.open.append((r["us"], r["row"]))
                return
            while self.open and r["us"] - self.open[0][0] > seconds * 1_000_000:
                self.open.popleft()
            if self.open:
                yield r["key"], r["row"], self.open.pop()[1]

    micros = F.unix_micros(F.col(time).cast("timestamp"))
    rows = df.filter(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(kind).isin(opens, closes))
    rows = rows.select(F.col(key).cast("long").alias("key"), micros.alias("us"), F.col(kind).alias("kind"), F.col(row).cast("long").alias("row"), (F.col(kind) == closes).alias("last"))
    return Pairs(rows.asTable().partitionBy("key").orderBy("us", "last", "row"))
