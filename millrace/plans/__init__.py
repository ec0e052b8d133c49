"""The library's queries over the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace import functions, operators, sources, streaming


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sources.table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp_ntz'2000-09-02'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("revenue"), F.round(F.avg("l_discount"), 4).alias("avg_disc"), F.count(F.lit(1)).alias("n")
    )


def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: sources.table(spark, sf_dir, n)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    # 25 nations and 5 regions at every scale
    buyers = t("customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = t("orders").filter("o_orderdate >= timestamp_ntz'1996-01-01' AND o_orderdate < timestamp_ntz'1998-01-01'")
    sold = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    return sold.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def orders_with_and_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = sources.table(spark, sf_dir, "orders")
    returned = sources.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("kind", F.lit("left_semi"))
    return orders.join(returned, "o_orderkey", "left").groupBy("o_orderpriority", F.coalesce("kind", F.lit("left_anti")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = sources.table(spark, sf_dir, "orders")
    return operators.top_k(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_totalprice", "rank")


def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rollup and a cube in one pass: the rollup's sets are among the cube's."""
    lines = sources.table(spark, sf_dir, "lineitem")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    measures = (F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.grouping_id().alias("level"))
    found = lines.groupingSets([[flag, status], [flag], [status], []], flag, status).agg(*measures)
    both, cube = F.array(F.lit("rollup"), F.lit("cube")), F.array(F.lit("cube"))
    return found.withColumn("how", F.explode(F.when(F.col("level").isin(0, 1, 3), both).otherwise(cube)))


def quantity_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.pivot(sources.table(spark, sf_dir, "lineitem"), ["l_linenumber"], "l_returnflag", ["A", "N", "R"], F.round(F.sum("l_quantity"), 2))


def clicks_before_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = sources.table(spark, sf_dir, "events")
    bought = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("bought_at"))
    clicked = events.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("clicked_at"))
    return operators.band_join(bought, clicked, ["user_id"], "bought_at", "clicked_at", 6 * 3600).select("user_id", "purchase_id", "click_id")


def value_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = sources.table(spark, sf_dir, "events")
    spread = events.groupBy("event_type").agg(F.round(F.stddev("value"), 6).alias("sd"), F.round(F.var_pop("value"), 4).alias("var"), F.count_distinct("user_id").alias("users"))
    at = operators.quantiles(events, "event_type", "value", {"p50": 0.5, "p95": 0.95})
    return spread.join(at, "event_type", "left").select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "sd", "var", "users")


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    buyers = sources.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    sellers = sources.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    found = {"union": buyers.union(sellers).distinct(), "intersect": buyers.intersect(sellers), "except": buyers.exceptAll(sellers), "intersect_all": buyers.intersectAll(sellers)}
    parts = [d.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("how", F.lit(how)) for how, d in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = sources.table(spark, sf_dir, "events")
    count = lambda w, how: events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n", F.lit(how).alias("how"))
    return count(F.window("ts", "1 day"), "tumbling").unionByName(count(F.window("ts", "1 day", "12 hours"), "sliding"))


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = sources.table(spark, sf_dir, "events")
    found = operators.sessions(events, "user_id", "ts", "4 hours", F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 2).alias("total"))
    return found.select("user_id", "session_start", "n_events", "total")


def last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = sources.table(spark, sf_dir, "events")
    bought = events.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    seen = events.filter("event_type = 'view'").select("user_id", "ts", "event_id", "value")
    return operators.asof_join(bought, seen, ["user_id"], "ts", "value", "event_id").select("user_id", "event_id", "last_value")


def rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    # seconds since the epoch as a whole number of microseconds: a range frame over them is exact
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    day = Window.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000, 0)
    return sources.table(spark, sf_dir, "events").withColumn("us", micros).select(
        "event_id", F.round(F.avg("value").over(w.rowsBetween(-4, 0)), 6).alias("avg_5"), F.round(F.sum("value").over(day), 4).alias("sum_day"), F.lag("event_type").over(w).alias("before")
    )


def purchase_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = operators.funnel(sources.table(spark, sf_dir, "events"), "user_id", "ts", "event_type", ["view", "click", "purchase"], "12 HOURS")
    return found.groupBy("depth").agg(F.count(F.lit(1)).alias("users"))


def json_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = sources.table(spark, sf_dir, "events").select(functions.json_long("props", "$.k").alias("k"), "value")
    return events.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = sources.table(spark, sf_dir, "pages")
    return pages.select("page_id", functions.url_host("url").alias("host"), functions.page_title("html").alias("title"))


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.drained(streaming.window_counts(streaming.events(spark, sf_dir), "1 day", "1 hour"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.drained(streaming.user_sessions(streaming.events(spark, sf_dir), "4 hours", "1 hour"))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are delivered twice, kept once."""
    twice = streaming.events(spark, sf_dir).unionByName(streaming.events(spark, sf_dir))
    kept = streaming.first_by(twice, ["event_id"], "1 hour")
    return streaming.drained(kept.select("event_id", "user_id", "event_type"))


def stream_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = streaming.drained(streaming.daily_totals(streaming.events(spark, sf_dir), "1 hour"), "update")
    return streaming.running_totals(daily).groupBy("user_id").agg(F.max("n_events").alias("n_events"), F.max("n_purchases").alias("n_purchases"))


def stream_clicks_before_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the clicks of the six hours before, by two streams; purchases without any once the watermark has passed them."""
    events = lambda kind, i, t: streaming.events(spark, sf_dir).filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(i), F.col("ts").alias(t))
    joined = streaming.interval_join(events("purchase", "purchase_id", "bought_at"), events("click", "click_id", "clicked_at"), ["user_id"], "bought_at", "clicked_at", 6 * 3600, "1 hour", "leftOuter")
    return streaming.drained(joined.select("user_id", "purchase_id", "click_id"))


def stream_step_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed sessions with how far each went from view to click to purchase, from keyed state with timers."""
    steps = streaming.step_sessions(streaming.events(spark, sf_dir), ["view", "click", "purchase"], 4 * 3600, "1 hour")
    return streaming.drained(steps, conf=streaming.TIMERS)


def clicks_taken_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the latest click of the six hours before that no earlier purchase has taken."""
    events = sources.table(spark, sf_dir, "events")
    found = operators.matched_once(events, "user_id", "ts", "event_type", "event_id", "click", "purchase", 6 * 3600)
    return found.select(F.col("key").alias("user_id"), F.col("closed").alias("purchase_id"), F.col("opened").alias("click_id"))


def robust_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's distance from its type's median in median absolute deviations."""
    events = sources.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    off = events.join(operators.quantiles(events, "event_type", "value", {"m": 0.5}), "event_type").withColumn("d", F.abs(F.col("value") - F.col("m")))
    spread = operators.quantiles(off, "event_type", "d", {"mad": 0.5})
    return off.join(spread, "event_type").select("event_id", F.round(F.col("d") / F.nullif(F.col("mad"), F.lit(0.0)), 6).alias("score"))


_NET = "l_extendedprice * (1 - l_discount)"
SQL = {
    pricing_summary: f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum({_NET}), 2) AS revenue, round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL",
    revenue_by_nation: f"SELECT r_name, n_name, round(sum({_NET}), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY ALL",
    orders_with_and_without_lines: "SELECT o_orderpriority, count(*) AS n, 'left_semi' AS kind FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1 UNION ALL SELECT o_orderpriority, count(*), 'left_anti' FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1",
    top_orders: "SELECT o_custkey, o_orderkey, o_totalprice, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3",
    grouping_sets: "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, grouping(l_returnflag, l_linestatus)::BIGINT AS level, 'rollup' AS how FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus) UNION ALL SELECT l_returnflag, l_linestatus, count(*), round(sum(l_quantity), 2), grouping(l_returnflag, l_linestatus)::BIGINT, 'cube' FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    quantity_pivot: 'SELECT l_linenumber, round(sum(l_quantity) FILTER (l_returnflag = \'A\'), 2) AS "A", round(sum(l_quantity) FILTER (l_returnflag = \'N\'), 2) AS "N", round(sum(l_quantity) FILTER (l_returnflag = \'R\'), 2) AS "R" FROM lineitem GROUP BY 1',
    clicks_before_purchase: "SELECT p.user_id, p.event_id AS purchase_id, c.event_id AS click_id FROM events p JOIN events c ON p.user_id = c.user_id AND c.ts <= p.ts AND c.ts > p.ts - INTERVAL 6 HOURS WHERE p.event_type = 'purchase' AND c.event_type = 'click'",
    value_profile: "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(stddev(value), 6) AS sd, round(var_pop(value), 4) AS var, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    set_operations: "WITH b AS (SELECT c_nationkey AS k FROM customer), s AS (SELECT s_nationkey AS k FROM supplier) SELECT k, count(*) AS n, 'union' AS how FROM (FROM b UNION FROM s) GROUP BY 1 UNION ALL SELECT k, count(*), 'intersect' FROM (FROM b INTERSECT FROM s) GROUP BY 1 UNION ALL SELECT k, count(*), 'except' FROM (FROM b EXCEPT ALL FROM s) GROUP BY 1 UNION ALL SELECT k, count(*), 'intersect_all' FROM (FROM b INTERSECT ALL FROM s) GROUP BY 1",
    window_counts: "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, 'tumbling' AS how FROM events GROUP BY 1, 2 UNION ALL SELECT time_bucket(INTERVAL 12 HOURS, ts) - o * INTERVAL 12 HOURS, event_type, count(*), 'sliding' FROM events, range(2) AS t(o) GROUP BY 1, 2",
    user_sessions: "WITH a AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 4 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a) SELECT user_id, min(ts) AS session_start, count(*) AS n_events, round(sum(value), 2) AS total FROM b GROUP BY user_id, s",
    last_view: "SELECT p.user_id, p.event_id, v.value AS last_value FROM (FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts",
    rolling_features: "SELECT event_id, round(avg(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS avg_5, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), 4) AS sum_day, lag(event_type) OVER (w) AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    purchase_funnel: "WITH a AS (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT a.user_id, min(ts) AS t1 FROM a JOIN events e ON a.user_id = e.user_id AND event_type = 'click' AND ts > t0 AND ts <= t0 + INTERVAL 12 HOURS GROUP BY 1), c AS (SELECT a.user_id, min(ts) AS t2 FROM a JOIN b USING (user_id) JOIN events e ON a.user_id = e.user_id AND event_type = 'purchase' AND ts > t1 AND ts <= t0 + INTERVAL 12 HOURS GROUP BY 1) SELECT (1 + (t1 IS NOT NULL)::INT + (t2 IS NOT NULL)::INT)::INT AS depth, count(*) AS users FROM a LEFT JOIN b USING (user_id) LEFT JOIN c USING (user_id) GROUP BY 1",
    json_buckets: "SELECT json_extract(props, '$.k')::BIGINT AS k, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1",
    page_hosts: "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages",
    stream_window_counts: "SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMPTZ AS window_start, event_type, count(*) AS n FROM events WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2",
    stream_sessions: "WITH a AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 4 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a) "
    "SELECT user_id, min(ts)::TIMESTAMPTZ AS session_start, count(*) AS n_events FROM b GROUP BY user_id, s HAVING max(ts) + INTERVAL 4 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    stream_dedup: "SELECT event_id, user_id, event_type FROM events",
    stream_running_totals: "SELECT user_id, count(*) AS n_events, count(*) FILTER (event_type = 'purchase') AS n_purchases FROM events GROUP BY 1",
    stream_clicks_before_purchase: "WITH p AS (FROM events WHERE event_type = 'purchase'), c AS (FROM events WHERE event_type = 'click'), m AS (SELECT p.user_id, p.event_id AS purchase_id, c.event_id AS click_id, p.ts FROM p LEFT JOIN c ON p.user_id = c.user_id AND c.ts <= p.ts AND c.ts > p.ts - INTERVAL 6 HOURS) "
    "SELECT user_id, purchase_id, click_id FROM m WHERE click_id IS NOT NULL OR ts <= (SELECT least((SELECT max(ts) FROM p), (SELECT max(ts) FROM c)) - INTERVAL 1 HOUR)",
    stream_step_sessions: "WITH a AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 4 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a), "
    "v AS (SELECT user_id, s, min(ts) FILTER (event_type = 'view') AS t0 FROM b GROUP BY ALL), c AS (SELECT b.user_id, b.s, any_value(t0) AS t0, min(ts) FILTER (event_type = 'click' AND ts > t0) AS t1 FROM b JOIN v USING (user_id, s) GROUP BY ALL), "
    "d AS (SELECT b.user_id, b.s, any_value(t0) AS t0, any_value(t1) AS t1, min(ts) FILTER (event_type = 'purchase' AND ts > t1) AS t2, min(ts) AS first, max(ts) AS last, count(*) AS n FROM b JOIN c USING (user_id, s) GROUP BY ALL) "
    "SELECT user_id, first::TIMESTAMPTZ AS session_start, n AS n_events, ((t0 IS NOT NULL)::INT + (t1 IS NOT NULL)::INT + (t2 IS NOT NULL)::INT)::INT AS depth FROM d WHERE last + INTERVAL 4 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    clicks_taken_once: None,
    robust_scores: "WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS m FROM events GROUP BY 1), d AS (SELECT event_id, e.event_type, abs(value - m) AS d FROM events e JOIN m USING (event_type)), s AS (SELECT event_type, quantile_cont(d, 0.5) AS mad FROM d GROUP BY 1) SELECT event_id, round(d / nullif(mad, 0), 6) AS score FROM d JOIN s USING (event_type)",
}


def queries() -> dict:
    return {f.__name__: f for f in SQL}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in SQL.items() if sql}
