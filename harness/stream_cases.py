"""Incremental and streaming forms, data-quality checks, relational and scalar primitives."""

import uuid

from pyspark.sql import functions as F

from harness.cases import VIEWS, Tables, case
from harness.metric_cases import closed
from orgpulse.functions import scalars as fx
from orgpulse.functions.similarity import jaro_winkler
from orgpulse.operators import gold, matching, ordered, org, quality
from orgpulse.session import ensure_checkpoint_dir
from orgpulse.sources import landing, schemas, versioned
from orgpulse.streaming import change_state, incremental, windows

V = VIEWS


def scratch(t: Tables, name: str) -> str:
    """A fresh path below the session's shared checkpoint folder; Spark creates it when it writes."""
    return f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def event_stream(t: Tables):
    """The events table as a file stream."""
    schema = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


# --- incremental rules ---------------------------------------------------------------------


@case("incremental_by_version", "SELECT event_id, event_type FROM <events> WHERE event_id > (SELECT max(event_id) FROM <events> WHERE event_type = 'click')")
def newer(t):
    rows = t["events"].select("event_id", "event_type")
    return incremental.incremental_by_version(rows, rows.where(F.col("event_type") == "click"), "event_id")


@case("incremental_first_run", "SELECT event_id, event_type FROM <events>")
def first_run(t):
    rows = t["events"].select("event_id", "event_type")
    return incremental.incremental_by_version(rows, rows.where(F.col("event_type") == "none"), "event_id")


@case("incremental_with_lookback", "SELECT event_id, ts::DATE::VARCHAR AS day FROM <events> WHERE ts::DATE > (SELECT max(ts::DATE) - 3 FROM <events> WHERE ts < TIMESTAMP '2024-01-20')")
def lookback(t):
    rows = t["events"].select("event_id", F.to_date("ts").alias("day"))
    return incremental.incremental_with_lookback(rows, rows.where(F.col("day") < F.lit("2024-01-20").cast("date")), "day", 3)


@case("late_data_switch", "SELECT event_id, CASE WHEN ts::DATE < DATE '2024-01-20' THEN 'final' ELSE 'provisional' END AS kind FROM <events> WHERE ts::DATE <= DATE '2024-01-20'")
def settled(t):
    rows = t["events"].withColumn("day", F.to_date("ts"))
    final, live = (rows.select("event_id", "day", F.lit(k).alias("kind")) for k in ("final", "provisional"))
    return incremental.late_data_switch(final, live, F.col("day"), "2024-01-20").select("event_id", "kind")


_NEWEST = "SELECT user_id, event_type, event_id, round(value,6) AS value FROM <events> QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1"


@case("upsert_by_key", _NEWEST)
def upserted(t):
    path = scratch(t, "upsert")
    rows = t["events"].select("user_id", "event_type", "event_id", "value", "ts")
    for batch in (rows.where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp")), rows.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp"))):
        incremental.upsert_by_key(batch.drop("ts"), path, ["user_id", "event_type"], ["event_id"], ["event_type"])
    return t.spark.read.parquet(path).select("user_id", "event_type", "event_id", "value")


@case("write_sink", "SELECT user_id, event_type, event_id, round(value,6) AS value FROM <events> UNION ALL SELECT user_id, event_type, event_id, round(value,6) FROM <events> WHERE event_type = 'click'")
def written(t):
    path = scratch(t, "sink")
    rows = t["events"].select("user_id", "event_type", "event_id", "value")
    landing.write_sink(rows, path, "table", partition_by=["event_type"])
    landing.write_sink(rows.where(F.col("event_type") == "click"), path, "append", partition_by=["event_type"])
    return t.spark.read.parquet(path).select("user_id", "event_type", "event_id", "value")


@case("export_csv", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM <orders>")
def exported(t):
    path = scratch(t, "csv")
    landing.export_csv(t["orders"].select("o_orderkey", "o_orderstatus", "o_orderpriority"), path)
    return t.spark.read.schema("o_orderkey bigint, o_orderstatus string, o_orderpriority string").option("header", True).csv(path)


@case("read_bronze", "SELECT tenant_id, source_id, slack_user_id, email, NULL::VARCHAR AS tz FROM <b_slack_users>")
def landed(t):
    path = scratch(t, "bronze")
    t["b_slack_users"].write.mode("overwrite").json(path)
    return landing.read_bronze(t.spark, path, schemas.bronze_schema("slack_users"), "json").select("tenant_id", "source_id", "slack_user_id", "email", "tz")


# --- streams ------------------------------------------------------------------------------------

def _measures():
    return {"n": F.count(F.lit(1)), "total": F.sum("value")}


def _window_sql(start: str, length: str) -> str:
    return f"SELECT event_type, ({start})::VARCHAR AS window_start, ({start} + INTERVAL {length})::VARCHAR AS window_end, count(*) AS n, round(sum(value), 4) AS total FROM <events> GROUP BY event_type, {start}"


def _rounded(df):
    return df.withColumn("total", F.round("total", 4))


_DAY = "date_trunc('day', ts)"
_MON = "date_trunc('week', ts)"
_SUN = "(date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY)"


def _windowed_stream(t, grain: str):
    """Counts of the event stream per window, kept by upsert; equals the batch result."""
    path = scratch(t, "window")
    stream = event_stream(t).withWatermark("ts", "3 days")
    counted = windows.tumbling(stream, "ts", grain, ["event_type"], _measures())
    keys = ["event_type", "window_start", "window_end"]
    incremental.run_available(counted, lambda batch, _: incremental.upsert_by_key(batch, path, keys, ["n"]), scratch(t, "window-ckpt"), "update")
    return _rounded(t.spark.read.parquet(path))


case("stream_tumbling_day", _window_sql(_DAY, "1 DAY"))(lambda t: _windowed_stream(t, "day"))
case("tumbling_monday_week", _window_sql(_MON, "7 DAY"))(lambda t: _rounded(windows.tumbling(t["events"], "ts", "monday_week", ["event_type"], _measures())))
case("tumbling_sunday_week", _window_sql(_SUN, "7 DAY"))(lambda t: _rounded(windows.tumbling(t["events"], "ts", "sunday_week", ["event_type"], _measures())))


_SLIDING = """SELECT event_type, s::VARCHAR AS window_start, (s + INTERVAL 14 DAY)::VARCHAR AS window_end, sum(n)::BIGINT AS n FROM (SELECT event_type, date_trunc('day', ts) AS d, count(*) AS n FROM <events> GROUP BY ALL), LATERAL (SELECT unnest(generate_series(d - INTERVAL 13 DAY, d, INTERVAL 1 DAY)) AS s) GROUP BY event_type, s"""


@case("sliding_windows", _SLIDING)
def slid(t):
    folded = t["events"].groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return windows.sliding(folded, "day", "14 days", "1 day", ["event_type"], {"n": F.sum("n")})


_SESSIONS = """SELECT user_id, min(ts)::VARCHAR AS window_start, (max(ts) + INTERVAL 6 HOUR)::VARCHAR AS window_end, count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
  SELECT user_id, ts, COALESCE(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR, true) AS gap FROM <events>)) GROUP BY user_id, s"""


@case("session_windows", _SESSIONS)
def bursts(t):
    return windows.sessions(t["events"], "ts", "6 hours", ["user_id"], {"n": F.count(F.lit(1))})


case("stream_sliding_windows", _SLIDING)(lambda t: _slid_stream(t))


def _slid_stream(t):
    path = scratch(t, "sliding")
    windows.keep_sliding(event_stream(t), "ts", "14 days", "1 day", "3 days", ["event_type"], {"n": F.count(F.lit(1))}, path, scratch(t, "sliding-ckpt"))
    return versioned.read(t.spark, path).drop("_batch")


@case("stream_session_windows", _SESSIONS)
def bursts_of_stream(t):
    path, checkpoint = scratch(t, "sessions"), scratch(t, "sessions-ckpt")
    stream, close = closable_stream(t)
    for step in (None, close):
        if step:
            step()
        windows.keep_sessions(stream, "ts", "6 hours", "1 day", ["user_id"], {"n": F.count(F.lit(1))}, path, checkpoint)
    closing = F.lit(change_state.CLOSING_TIME).cast("timestamp")
    return t.spark.read.parquet(path).drop("_batch").where(F.col("window_start") < closing)


@case(
    "stream_settled_days",
    "SELECT event_type, d::VARCHAR AS window_start, (d + INTERVAL 1 DAY)::VARCHAR AS window_end, n, round(total, 4) AS total, CASE WHEN epoch_ms(d + INTERVAL 1 DAY) <= epoch_ms(newest) - 3 * 86400000 THEN 1 ELSE 0 END AS settled FROM (SELECT event_type, date_trunc('day', ts) AS d, count(*) AS n, sum(value) AS total FROM <events> GROUP BY ALL), (SELECT max(ts) AS newest FROM <events>)",
)
def settled_stream(t):
    """Days that can't change any more are final, the last ones provisional."""
    final, provisional = scratch(t, "final"), scratch(t, "provisional")
    windows.keep_days(event_stream(t), "ts", "3 days", ["event_type"], _measures(), final, provisional, scratch(t, "days-ckpt"))
    return _rounded(windows.settled_days(t.spark, final, provisional, ["event_type"]))


@case("stream_dedup", "SELECT DISTINCT user_id, event_type FROM <events>")
def deduplicated(t):
    path = scratch(t, "dedup")
    once = incremental.dedup_stream(event_stream(t), ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type")
    incremental.run_available(once, lambda batch, i: incremental.append_batch(batch, path, i), scratch(t, "dedup-ckpt"), "append")
    return t.spark.read.parquet(path).select("user_id", "event_type")


@case("stream_changed_since", "SELECT user_id, max_by(event_type, event_id) AS event_type FROM <events> GROUP BY ALL")
def changed(t):
    path = scratch(t, "versions")
    at = F.lit("2024-02-01").cast("timestamp")

    def write(batch, batch_id):
        incremental.snapshot_batch(batch, path, "user_id", ["event_type"], at, batch_id, ["event_id"])

    incremental.run_available(event_stream(t), write, scratch(t, "versions-ckpt"), "append")
    return t.spark.read.parquet(path).select("user_id", "event_type")


@case("upsert_versioned", _NEWEST)
def upserted_versions(t):
    """Three overlapping batches, the oldest rows last; each publishes a version."""
    path = scratch(t, "versioned")
    rows = t["events"].select("user_id", "event_type", "event_id", "value")
    for part in (1, 2, 0):
        versioned.upsert(rows.where(F.pmod("user_id", F.lit(3)).isin(part, (part + 1) % 3)), path, ["user_id", "event_type"], ["event_id"])
    return versioned.read(t.spark, path).select("user_id", "event_type", "event_id", "value")


def closable_stream(t, rows=None):
    """The event stream joined with a folder that a last row can be put into, which moves the watermark past all rows, and the way to put it there."""
    stream = event_stream(t) if rows is None else rows(event_stream(t))
    path, schema = scratch(t, "closing"), stream.schema
    t.spark.createDataFrame([], schema).write.parquet(path)
    closing = t.spark.readStream.schema(schema).parquet(path)
    return stream.unionByName(closing), lambda: change_state.closing_row(t.spark, schema, "ts").write.mode("append").parquet(path)


@case("stream_versions", "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM <events>) WHERE before IS DISTINCT FROM event_type")
def versions_of_stream(t):
    """Every change of a user's event type, two in one batch too."""
    path, checkpoint = scratch(t, "changes"), scratch(t, "changes-ckpt")
    stream, close = closable_stream(t, lambda s: s.select("event_id", "user_id", "event_type", "ts"))
    changes = change_state.changed_since(stream, ["user_id"], ["event_type"], "ts", ["event_id"], "3 days")
    for step in (None, close):
        if step:
            step()
        incremental.run_available(changes, lambda batch, i: incremental.append_batch(batch, path, i), checkpoint, "append")
    return t.spark.read.parquet(path).select("event_id", "user_id", "event_type")


@case("append_only", "SELECT event_id, event_type FROM <events>")
def appended(t):
    path = scratch(t, "append")
    rows = t["events"].select("event_id", "event_type")
    for batch_id in (0, 1, 1):  # the second batch arrives twice
        incremental.append_batch(rows.where((F.col("event_type") == "click") == F.lit(batch_id == 0)), path, batch_id)
    return t.spark.read.parquet(path).select("event_id", "event_type")


@case("alert_stream", "SELECT event_id, user_id, 'critical' AS level FROM <events> WHERE value > 300")
def fired(t):
    from orgpulse.streaming.alerts import alert_stream

    path = scratch(t, "alerts")
    rules = t.spark.createDataFrame([("t", "amount", "gt", 300.0, "critical")], "tenant_id string, metric_key string, operator string, threshold double, level string")
    values = event_stream(t).select(F.lit("t").alias("tenant_id"), F.lit("amount").alias("metric_key"), "event_id", "user_id", F.col("value").alias("metric_value"))
    alert_stream(values, lambda: rules, path, scratch(t, "alerts-ckpt"), available_now=True).awaitTermination()
    return t.spark.read.parquet(path).select("event_id", "user_id", "level")


# --- data quality ------------------------------------------------------------------------------------

case("not_null", "SELECT unique_key, concat_ws(',', CASE WHEN author_email IS NULL THEN 'author_email' END, CASE WHEN branch_name IS NULL THEN 'branch_name' END) AS missing FROM <b_commits> WHERE author_email IS NULL OR branch_name IS NULL")(
    lambda t: quality.not_null(t["b_commits"], ["author_email", "branch_name"]).select("unique_key", "missing")
)
case("unique", "SELECT l_orderkey, count(*) AS n FROM <lineitem> GROUP BY ALL HAVING count(*) > 1")(lambda t: quality.unique(t["lineitem"], "l_orderkey"))
case("unique_combination", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM <lineitem> GROUP BY ALL HAVING count(*) > 1")(lambda t: quality.unique_combination(t["lineitem"], ["l_orderkey", "l_linenumber"]))
case("accepted_values", "SELECT o_orderpriority, count(*) AS n FROM <orders> WHERE o_orderpriority NOT IN ('1-URGENT','2-HIGH') GROUP BY ALL")(lambda t: quality.accepted_values(t["orders"], "o_orderpriority", ["1-URGENT", "2-HIGH"]))
case("freshness", "SELECT event_type, max(ts)::VARCHAR AS newest, round(date_diff('second', date_trunc('second', max(ts)), TIMESTAMP '2024-02-01') / 3600.0, 6) AS age_h FROM <events> GROUP BY ALL")(
    lambda t: quality.freshness(t["events"].withColumn("ts", F.col("ts").cast("timestamp")), "ts", "2024-02-01", ["event_type"])
)

# --- relational primitives ---------------------------------------------------------------------------------

case("scan_filter", "SELECT c_custkey, c_name FROM <customer> WHERE c_mktsegment IN ('BUILDING','MACHINERY') AND c_acctbal > 0 AND c_name LIKE 'Customer#%' AND c_mktsegment ILIKE '%build%' AND c_nationkey <> 3")(
    lambda t: t["customer"]
    .where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_acctbal") > 0) & F.startswith("c_name", F.lit("Customer#")) & F.col("c_mktsegment").ilike("%build%") & (F.col("c_nationkey") != 3))
    .select("c_custkey", "c_name")
)
case("inner_equi_join", "SELECT l_orderkey, l_linenumber, l_partkey, s_name, o_custkey FROM <lineitem> JOIN <orders> ON o_orderkey = l_orderkey JOIN <supplier> ON s_suppkey = l_suppkey")(
    lambda t: t["lineitem"].join(t["orders"], F.col("o_orderkey") == F.col("l_orderkey")).join(t["supplier"], F.col("s_suppkey") == F.col("l_suppkey")).select("l_orderkey", "l_linenumber", "l_partkey", "s_name", "o_custkey")
)
case("left_equi_join", "SELECT o_orderkey, l_linenumber FROM <orders> LEFT JOIN <lineitem> ON o_orderkey = l_orderkey")(
    lambda t: t["orders"].join(t["lineitem"], F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "l_linenumber")
)
_USERS = "(SELECT user_id AS id, count(*) AS a FROM <events> WHERE event_type = 'click' GROUP BY ALL)"
case("full_outer_chain", f"SELECT id, a, b, c FROM {_USERS} FULL JOIN (SELECT o_custkey AS id, count(*) AS b FROM <orders> WHERE o_orderstatus = 'F' GROUP BY ALL) USING (id) FULL JOIN (SELECT c_custkey AS id, 1 AS c FROM <customer> WHERE c_acctbal < 0) USING (id)")(
    lambda t: t["events"].where(F.col("event_type") == "click").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("a"))
    .join(t["orders"].where(F.col("o_orderstatus") == "F").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("b")), ["id"], "full")
    .join(t["customer"].where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("id"), F.lit(1).alias("c")), ["id"], "full")
)
case("left_anti_join", "SELECT c_custkey FROM <customer> WHERE NOT EXISTS (SELECT 1 FROM <events> WHERE user_id = c_custkey)")(
    lambda t: t["customer"].join(t["events"], F.col("user_id") == F.col("c_custkey"), "left_anti").select("c_custkey")
)
case("not_exists_null_safe", "SELECT c_custkey FROM <customer> WHERE NOT EXISTS (SELECT 1 FROM <events> WHERE user_id IS NOT DISTINCT FROM c_custkey AND event_type = 'error')")(
    lambda t: t["customer"].join(t["events"].where(F.col("event_type") == "error"), F.col("c_custkey").eqNullSafe(F.col("user_id")), "left_anti").select("c_custkey")
)
case("left_semi_join", "SELECT c_custkey FROM <customer> WHERE EXISTS (SELECT 1 FROM <events> WHERE user_id = c_custkey AND value > 100)")(
    lambda t: t["customer"].join(t["events"].where(F.col("value") > 100), F.col("user_id") == F.col("c_custkey"), "left_semi").select("c_custkey")
)
case("right_join", "SELECT o_orderkey, c_custkey FROM <orders> RIGHT JOIN <customer> ON o_custkey = c_custkey AND o_orderstatus = 'P'")(
    lambda t: t["orders"].where(F.col("o_orderstatus") == "P").join(t["customer"], F.col("o_custkey") == F.col("c_custkey"), "right").select("o_orderkey", "c_custkey")
)
case("dictionary_lookup", "SELECT s_suppkey, n_name, r_name FROM <supplier> LEFT JOIN <nation> ON n_nationkey = s_nationkey LEFT JOIN <region> ON r_regionkey = n_regionkey")(
    lambda t: t["supplier"].join(t["nation"], F.col("n_nationkey") == F.col("s_nationkey"), "left").join(t["region"], F.col("r_regionkey") == F.col("n_regionkey"), "left").select("s_suppkey", "n_name", "r_name")
)
_AS_OF_SQL = "SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, (SELECT max(o_orderkey) FROM (SELECT o_orderkey, o_orderdate FROM <orders> WHERE o_custkey = l_partkey) o WHERE o.o_orderdate = (SELECT max(o_orderdate) FROM <orders> x WHERE x.o_custkey = l_partkey AND x.o_orderdate <= l_shipdate)) AS last_order FROM <lineitem>"


@case("as_of_lookup", _AS_OF_SQL)
def as_of(t):
    """Latest order at or before the ship date; of several on one day the largest key."""
    orders = t["orders"].select(F.col("o_custkey").alias("l_partkey"), F.col("o_orderdate").alias("l_shipdate"), F.col("o_orderkey").alias("last_order"))
    facts = t["lineitem"].select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    return ordered.as_of_join(facts, orders, ["l_partkey"], "l_shipdate", "last_order", F.year).drop("l_shipdate")


case("range_join_days", "SELECT c_custkey, o_orderkey, l_orderkey, l_linenumber, l_suppkey FROM <customer> JOIN <orders> ON o_custkey = c_custkey JOIN <lineitem> ON l_partkey = c_custkey AND abs(date_diff('day', o_orderdate, l_shipdate)) <= 5")(
    # Each order is offered to the eleven days around it, so the range becomes an equi-join on key and day.
    lambda t: t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    .withColumn("near", F.explode(F.sequence(F.date_sub(F.to_date("o_orderdate"), 5), F.date_add(F.to_date("o_orderdate"), 5))))
    .join(t["lineitem"].withColumn("day", F.to_date("l_shipdate")), (F.col("l_partkey") == F.col("c_custkey")) & (F.col("day") == F.col("near")))
    .select("c_custkey", "o_orderkey", "l_orderkey", "l_linenumber", "l_suppkey")
)
case("recursive_ancestry", "WITH RECURSIVE a AS (SELECT unit_id, parent_id AS ancestor FROM <b_units> WHERE parent_id IS NOT NULL UNION SELECT a.unit_id, u.parent_id FROM a JOIN <b_units> u ON u.unit_id = a.ancestor WHERE u.parent_id IS NOT NULL) SELECT * FROM a")(
    lambda t: org.ancestors(t["b_units"])
)
case("conditional_aggregates", "SELECT o_custkey, count_if(o_orderstatus = 'F') AS done, COALESCE(round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END),4),0) AS open_value, round(avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END),4) AS urgent_avg FROM <orders> GROUP BY ALL")(
    lambda t: t["orders"].groupBy("o_custkey").agg(
        fx.count_where(F.col("o_orderstatus") == "F").alias("done"), F.round(fx.sum_where("o_totalprice", F.col("o_orderstatus") == "O"), 4).alias("open_value"), F.round(fx.avg_where("o_totalprice", F.col("o_orderpriority") == "1-URGENT"), 4).alias("urgent_avg")
    )
)
case("distinct_aggregate", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM <lineitem> GROUP BY ALL")(
    lambda t: t["lineitem"].select("l_returnflag", "l_partkey").distinct().groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("parts"))
)
case("distinct_aggregate_approx")(lambda t: t["lineitem"].groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.01).alias("parts")))
case("latest_non_null", "SELECT user_id, max_by(event_type, event_id) FILTER (WHERE event_type <> 'error') AS last_kind FROM <events> GROUP BY ALL")(
    lambda t: t["events"].groupBy("user_id").agg(fx.latest_filled(F.when(F.col("event_type") != "error", F.col("event_type")), "event_id", "event_id").alias("last_kind"))
)
case("array_aggregate", "SELECT user_id, (SELECT string_agg(x, '|' ORDER BY x) FROM (SELECT DISTINCT unnest([event_type, 'k' || (k % 3)::VARCHAR]) AS x FROM <b_ev> i WHERE i.user_id = o.user_id)) AS tools FROM (SELECT DISTINCT user_id FROM <b_ev>) o")(
    lambda t: t["b_ev"].groupBy("user_id").agg(fx.distinct_flat(F.array("event_type", F.concat(F.lit("k"), (F.col("k") % 3).cast("string")))).alias("tools"))
)
case("exact_upper_median", "SELECT l_returnflag, list_sort(list(l_extendedprice))[(floor(count(*) / 2))::INT + 1] AS median FROM <lineitem> GROUP BY ALL")(
    lambda t: ordered.exact_quantile(t["lineitem"], ["l_returnflag"], "l_extendedprice", 0.5, "median")
)
case("upper_median_small_groups", "SELECT l_orderkey, list_sort(list(l_quantity))[(floor(count(*) / 2))::INT + 1] AS median FROM <lineitem> GROUP BY ALL")(
    lambda t: t["lineitem"].groupBy("l_orderkey").agg(fx.upper_median_of(F.collect_list("l_quantity")).alias("median"))
)
case("group_by_expression", "SELECT lower(o_orderpriority) AS p, o_orderdate::DATE::VARCHAR AS d, count(*) AS n FROM <orders> GROUP BY lower(o_orderpriority), o_orderdate::DATE")(
    lambda t: t["orders"].groupBy(F.lower("o_orderpriority").alias("p"), F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n"))
)
case("rollup", "SELECT r_name, n_name, count(*) AS n FROM <customer> JOIN <nation> ON n_nationkey = c_nationkey JOIN <region> ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)")(
    lambda t: t["customer"].join(t["nation"], F.col("n_nationkey") == F.col("c_nationkey")).join(t["region"], F.col("r_regionkey") == F.col("n_regionkey")).rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"))
)
case("cube", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM <lineitem> GROUP BY CUBE (l_returnflag, l_linestatus)")(lambda t: t["lineitem"].cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q")))
case("version_numbers", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version_num FROM <events>")(
    lambda t: ordered.with_row_number(t["events"].select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], F.to_date("ts"), "version_num").drop("ts")
)
case("next_and_previous", "SELECT user_id, event_id, lag(event_id) OVER w AS prev_id, lead(event_id) OVER w AS next_id FROM <events> WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")(
    lambda t: ordered.with_neighbours(t["events"].select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], {"prev_id": "event_id"}, {"next_id": "event_id"}, F.to_date("ts")).drop("ts")
)
case("percent_rank", "SELECT event_type, event_id, round(percent_rank() OVER (PARTITION BY event_type ORDER BY value), 6) AS pr FROM <events>")(
    lambda t: ordered.percent_rank_by(t["events"].select("event_type", "event_id", "value"), ["event_type"], "value", "pr").drop("value")
)
case("dense_rank_all", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) AS r FROM <orders>")(lambda t: ordered.dense_rank_all(t["orders"].select("o_orderkey", "o_custkey"), "o_custkey", "r").drop("o_custkey"))
case("top_k", "SELECT o_orderkey, round(o_totalprice,6) AS o_totalprice FROM <orders> ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")(
    lambda t: t["orders"].select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30)
)
case("union_all", "SELECT c_custkey AS id, c_name AS name FROM <customer> UNION ALL SELECT s_suppkey, s_name FROM <supplier>")(
    lambda t: t["customer"].select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).unionByName(t["supplier"].select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
)
case("distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM <lineitem>")(lambda t: t["lineitem"].select("l_returnflag", "l_linestatus", "l_linenumber").distinct())
case("except_all", "SELECT l_suppkey FROM <lineitem> EXCEPT ALL SELECT l_suppkey FROM <lineitem> WHERE l_returnflag = 'R'")(lambda t: t["lineitem"].select("l_suppkey").exceptAll(t["lineitem"].where(F.col("l_returnflag") == "R").select("l_suppkey")))
case("intersect", "SELECT user_id AS id FROM <events> INTERSECT SELECT c_custkey FROM <customer> WHERE c_acctbal < 1000")(
    lambda t: t["events"].select(F.col("user_id").alias("id")).intersect(t["customer"].where(F.col("c_acctbal") < 1000).select("c_custkey"))
)
case("scalar_subquery", "SELECT o_orderkey FROM <orders> WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM <orders>)")(
    lambda t: t["orders"].where(F.col("o_totalprice") > t["orders"].agg((F.avg("o_totalprice") * 1.5).alias("m")).scalar()).select("o_orderkey")
)
case("array_join", "SELECT doc_id, w AS word FROM (SELECT doc_id, unnest(string_split(source || ' ' || lang, ' ')) AS w FROM <documents>)")(
    lambda t: t["documents"].select("doc_id", F.explode(F.split(F.concat_ws(" ", "source", "lang"), " ")).alias("word"))
)
case("unpivot", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, m AS measure, v AS amount FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(['l_tax','l_discount']) AS m, unnest([l_tax, l_discount]) AS v FROM <lineitem>)")(
    lambda t: t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax", "l_discount").unpivot(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_tax", "l_discount"], "measure", "amount")
)
case("typed_empty_relation", "SELECT tenant_id, person_id, metric_date, tasks_closed FROM (SELECT NULL::VARCHAR AS tenant_id, NULL::VARCHAR AS person_id, NULL::VARCHAR AS metric_date, 0::DOUBLE AS tasks_closed WHERE false) UNION ALL BY NAME SELECT tenant_id, person_id, metric_date::VARCHAR AS metric_date, tasks_closed::DOUBLE AS tasks_closed FROM <v_closed>")(
    lambda t: gold.empty_relation(t.spark, "tenant_id string, person_id string, metric_date string, tasks_closed double").unionByName(
        closed(t).select("tenant_id", "person_id", F.col("metric_date").cast("string").alias("metric_date"), F.col("tasks_closed").cast("double").alias("tasks_closed"))
    )
)

# --- scalar functions ---------------------------------------------------------------------------------------------


@case(
    "scalar_conditions",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'ok' END AS band, COALESCE(nullif(lower(trim(' ' || c_mktsegment || ' ')), 'building'), '') AS seg, CASE WHEN c_mktsegment = 'BUILDING' THEN lower(c_name) ELSE c_mktsegment || '@X' END AS k FROM <customer>""",
)
def conditions(t):
    segment = F.lower(F.trim(F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))))
    email = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.concat("c_mktsegment", F.lit("@X")))
    return t["customer"].select(
        "c_custkey",
        fx.multi_if((F.col("c_acctbal") < 0, F.lit("debt")), (F.col("c_acctbal") < 1000, F.lit("low")), default=F.lit("ok")).alias("band"),
        fx.or_empty(fx.null_if(segment, "building")).alias("seg"),
        F.when(email != "", email).otherwise(fx.person_key(email, "c_name")).alias("k"),
    )


@case("scalar_json", """SELECT event_id, COALESCE(props::JSON->>'k','') AS k_text, COALESCE((props::JSON->>'k')::DOUBLE, 0) AS k_num, '' AS missing, 0.0::DOUBLE AS missing_num, 0 AS missing_flag, 2 AS n, '{"a":"' || event_type || '","b":""}' AS packed FROM <events>""")
def json_functions(t):
    return t["events"].select(
        "event_id", fx.json_text("props", "k").alias("k_text"), fx.json_number("props", "k").alias("k_num"), fx.json_text("props", "a", "b").alias("missing"), fx.json_number("props", "z").alias("missing_num"), fx.json_flag("props", "z").alias("missing_flag"),
        fx.json_size(F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]"))).alias("n"), fx.json_of_map({"a": "event_type", "b": F.lit(None)}).alias("packed"),
    )


@case(
    "scalar_parse_time",
    """SELECT event_id, date_trunc('second', ts)::VARCHAR AS iso, date_trunc('second', ts)::VARCHAR AS from_seconds, date_trunc('second', ts)::VARCHAR AS from_millis, (ts::DATE)::TIMESTAMP::VARCHAR AS slashed, NULL::VARCHAR AS garbage, (epoch_us(ts) // 1000)::BIGINT AS millis FROM <events>""",
)
def parse_time(t):
    ts = F.col("ts").cast("timestamp")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t["events"].select(
        "event_id", fx.parse_time(iso).alias("iso"), fx.parse_time(F.unix_timestamp(ts).cast("string")).alias("from_seconds"), fx.parse_time((F.unix_timestamp(ts) * 1000).cast("string")).alias("from_millis"),
        fx.parse_time(F.date_format(ts, "yyyy/MM/dd")).alias("slashed"), fx.parse_time(F.lit("not a date")).alias("garbage"), fx.to_millis(ts).alias("millis"),
    )


case("scalar_durations", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber * 3600 + (l_partkey % 60) * 60 + l_suppkey % 60 AS d, 0 AS z, date_diff('second', l_shipdate, TIMESTAMP '1999-01-01') AS gap FROM <lineitem>")(
    lambda t: t["lineitem"].select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        fx.duration_seconds(F.concat(F.lit("PT"), F.col("l_linenumber").cast("string"), F.lit("H"), (F.col("l_partkey") % 60).cast("string"), F.lit("M"), (F.col("l_suppkey") % 60).cast("string"), F.lit("S"))).alias("d"),
        fx.duration_seconds(F.lit(None).cast("string")).alias("z"), fx.seconds_between("l_shipdate", F.lit("1999-01-01").cast("timestamp")).alias("gap"),
    )
)
case("scalar_weeks", "SELECT o_orderkey, date_trunc('week', o_orderdate)::DATE::VARCHAR AS monday, (o_orderdate::DATE - dayofweek(o_orderdate)::INT)::VARCHAR AS sunday FROM <orders>")(
    lambda t: t["orders"].select("o_orderkey", fx.monday_week("o_orderdate").alias("monday"), fx.sunday_week("o_orderdate").alias("sunday"))
)
case("scalar_numbers", "SELECT event_id, round(value, 1) AS r, least(100.0, greatest(10.0, value)) AS c, abs(value - 50) AS a, value / nullif(event_id % 3, 0) AS q, round(round(value / 490.02 * 100, 9), 2) AS p FROM <events>")(
    lambda t: t["events"].select("event_id", F.round("value", 1).alias("r"), fx.clamp(F.col("value"), 10, 100).alias("c"), F.abs(F.col("value") - 50).alias("a"), fx.ratio("value", F.col("event_id") % 3).alias("q"), fx.percent("value", F.lit(490.02), 2).alias("p"))
)
case("scalar_regex", "SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)license') THEN 1 ELSE 0 END AS m, CASE WHEN text ILIKE '%copyright%' OR text ILIKE '%the%' THEN 1 ELSE 0 END AS i FROM <documents>")(
    lambda t: t["documents"].select("doc_id", fx.flag(fx.matches("text", "(?i)license")).alias("m"), fx.flag(fx.ilike_any("text", ["%copyright%", "%the%"])).alias("i"))
)
case("scalar_hashes", "SELECT c_custkey, md5(concat_ws('-', c_custkey::VARCHAR, c_name)) AS digest, length(c_name) AS n FROM <customer>")(
    lambda t: t["customer"].select("c_custkey", fx.digest_key("-", "c_custkey", "c_name").alias("digest"), F.length("c_name").alias("n"))
)
_TEXTS = "|".join(f"' || length({c}) || '|' || {c} || '" for c in ("c_name", "c_mktsegment"))
_UUID = "md5(c_name)"
case(
    "scalar_row_hash",
    f"SELECT c_custkey, sha256('{_TEXTS}') AS h, substr({_UUID}, 1, 8) || '-' || substr({_UUID}, 9, 4) || '-' || substr({_UUID}, 13, 4) || '-' || substr({_UUID}, 17, 4) || '-' || substr({_UUID}, 21, 12) AS u FROM <customer>",
)(lambda t: t["customer"].select("c_custkey", fx.row_hash(["c_name", "c_mktsegment"], "__null__").alias("h"), fx.stable_uuid("c_name").alias("u")))
case("scalar_arrays", "SELECT page_id, string_split(url, '/')[1] AS first_part, string_split(url, '/')[-1] AS last_part, len(string_split(url, '/')) AS n FROM <pages>")(
    lambda t: t["pages"].select("page_id", F.array_distinct(F.split("url", "/"))[0].alias("first_part"), F.element_at(F.split("url", "/"), -1).alias("last_part"), F.size(F.split("url", "/")).alias("n"))
)
case("scalar_maps", "SELECT c_custkey, c_name AS v, 1 AS has_name, 0 AS has_other, '' AS none FROM <customer>")(
    lambda t: t["customer"].withColumn("m", F.create_map(F.lit("name"), "c_name")).select(
        "c_custkey", fx.map_value("m", "name").alias("v"), fx.map_has("m", "name").alias("has_name"), fx.map_has("m", "other").alias("has_other"), fx.empty_map("string").alias("none")
    )
)
case("scalar_casts", "SELECT page_id, TRY_CAST(split_part(url, '/', 5) AS BIGINT) AS n, TRY_CAST(split_part(url, '/', 4) AS DOUBLE) AS d, NULL::DOUBLE AS x FROM <pages>")(
    lambda t: t["pages"].select("page_id", fx.split_part("url", "/", 5).try_cast("bigint").alias("n"), fx.split_part("url", "/", 4).try_cast("double").alias("d"), F.lit(None).cast("double").alias("x"))
)
case("scalar_jaro_winkler", "SELECT a.s_suppkey, round(jaro_winkler_similarity(s_name, 'Supplier#000000042'), 6) AS sim FROM <supplier> a")(
    lambda t: t["supplier"].select("s_suppkey", jaro_winkler("s_name", F.lit("Supplier#000000042")).alias("sim"))
)


def _soundex(text: str) -> str:
    """Soundex in SQL: digits of all letters, h and w skipped, runs joined, the first letter kept, vowels gone."""
    digits = f"regexp_replace(translate(upper({text}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623017202'), '[^0-7]', '0', 'g')"
    run = f"left({digits}, 1) || replace(substr({digits}, 2), '7', '')"
    for digit in "123456":
        run = f"regexp_replace({run}, '{digit}+', '{digit}', 'g')"
    return f"upper(left({text}, 1)) || rpad(left(replace(substr({run}, 2), '0', ''), 3), 3, '0')"


case("scalar_soundex", f"SELECT p_partkey, {_soundex('p_name')} AS code FROM <part>")(lambda t: t["part"].select("p_partkey", F.soundex("p_name").alias("code")))

# Names of random letters; the known form has one letter, at some place, replaced by an x.
_NAME = "translate(substr(md5(c_custkey::string), 1, 14), '0123456789', 'ghijklmnop')"
_KNOWN_NAME = f"substr({_NAME}, 1, (c_custkey % 14)::int) || 'x' || substr({_NAME}, (c_custkey % 14)::int + 2)"


@case(
    "match_names",
    f"""
WITH d AS (SELECT 't' || (c_custkey % 2) AS tenant_id, 'git' AS source_type, 'display_name' AS alias_type, {_NAME} AS alias_value, {_soundex(_NAME)} AS sound FROM <customer>), k AS (SELECT 't' || (c_custkey % 2) AS tenant_id, 'P' || c_custkey AS person_id, {_KNOWN_NAME} AS p, {_soundex(_KNOWN_NAME)} AS known_sound FROM <customer>),
rated AS (SELECT d.*, person_id, jaro_winkler_similarity(alias_value, p) >= 0.95 AS near, sound = known_sound AS alike FROM d JOIN k USING (tenant_id))
SELECT tenant_id, person_id, source_type, alias_type, alias_value, if(near, 'name_jaro_winkler', 'name_soundex') AS rule, if(near, 0.75, 0.6)::DOUBLE AS confidence FROM rated WHERE near OR alike""",
)
def fuzzy_names(t):
    """All pairs of names by either rule."""
    rows = t["customer"]
    shape = [F.concat(F.lit("t"), (F.col("c_custkey") % 2).cast("string")).alias("tenant_id"), F.lit("git").alias("source_type"), F.lit("display_name").alias("alias_type")]
    seen = rows.select(*shape, F.expr(_NAME).alias("alias_value"))
    known = rows.select(*shape, F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("person_id"), F.expr(_KNOWN_NAME).alias("alias_value"))
    return matching.match_candidates(seen, known, fuzzy=True)
