"""Streaming jobs over the events table and over bars, run to the end and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.scalar import rnd
from barloom.plans import sqltext as S
from barloom.plans.registry import query
from barloom.plans.events import CROSS_SQL
from barloom.plans.sequential import ZIGZAG_SQL, _fold, macd_sql, wilder_sql
from barloom.plans.sqltext import full, r
from barloom.plans.util import shown_sql
from barloom.session import attach_row, stored
from barloom.sources import bars as SRC
from barloom.streaming import day_table as DT
from barloom.streaming import jobs as ST
from barloom.streaming import ordered as O

MAX_TS = "(SELECT max(ts) FROM events)"


def event_stream(spark, sf_dir):
    schema = SRC.table(spark, sf_dir, "events").schema
    stream = ST.parquet_stream(spark, sf_dir, "events.parquet", schema)
    # Watermarks need a zoned timestamp; the table stores local ones.
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def bar_stream(spark, sf_dir, batches: int = 4):
    """Weekly bars written in day order as a few files, then read as a stream one file at a time."""
    bars = SRC.bars_brand_week(spark, sf_dir).select("sym", "d", "close", "vol")
    folder = ST.scratch(spark, "bars")
    edges = ["1900-01-01", "1997-01-01", "1999-01-01", "2000-06-01", "2999-01-01"]
    for lo, hi in zip(edges[:batches], edges[1:]):
        part = bars.where((F.col("d") >= F.lit(lo).cast("date")) & (F.col("d") < F.lit(hi).cast("date")))
        # Files of one period hold different symbols, so their order inside the period does not matter.
        part.repartition("sym").write.mode("append").parquet(folder)
    return ST.parquet_stream(spark, folder, "*.parquet", bars.schema, 1)


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def stamp_sql(c: str, name: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {name or c}"


@query(
    "stream_tick_bars", "ST1 S1",
    f"""WITH b AS (SELECT event_type AS sym, date_trunc('hour', ts) AS start, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS n FROM events WHERE value > 0 GROUP BY 1, 2)
SELECT sym, {stamp_sql('start')}, {r('open', 4)} AS open, {r('high', 4)} AS high, {r('low', 4)} AS low, {r('close', 4)} AS close, n FROM b WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events WHERE value > 0) - INTERVAL 1 HOUR""",
)
def stream_tick_bars(spark, sf_dir):
    bars = ST.tick_bars(event_stream(spark, sf_dir).where("value > 0"), "event_type", F.col("value"), ["event_id"], "1 hour", "1 hour")
    out = ST.run_available(bars, "tick-bars")
    return out.select("sym", stamp("start"), *[rnd(c, 4).alias(c) for c in ("open", "high", "low", "close")], "n")


@query(
    "stream_sliding_breadth", "ST2",
    f"""WITH w AS (SELECT unnest(generate_series(time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 5 HOUR, time_bucket(INTERVAL 1 HOUR, ts), INTERVAL 1 HOUR)) AS start, event_type FROM events)
SELECT {stamp_sql('start')}, count(*) AS n, {r("avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END)")} AS share FROM w WHERE start + INTERVAL 6 HOUR <= {MAX_TS} - INTERVAL 1 HOUR GROUP BY w.start""",
)
def stream_sliding_breadth(spark, sf_dir):
    out = ST.run_available(ST.sliding_breadth(event_stream(spark, sf_dir), F.col("event_type") == "error", "6 hours", "1 hour", "1 hour"), "breadth")
    return out.select(stamp("start"), "n", rnd("share").alias("share"))


@query(
    "stream_burst_sessions", "ST3 W46",
    f"""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 3 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e)
SELECT user_id, {stamp_sql('min(ts)', 'start')}, {stamp_sql('max(ts) + INTERVAL 3 HOUR', '"end"')}, count(*) AS events FROM s GROUP BY user_id, sid HAVING max(ts) + INTERVAL 3 HOUR <= {MAX_TS} - INTERVAL 1 HOUR""",
)
def stream_burst_sessions(spark, sf_dir):
    out = ST.run_available(ST.burst_sessions(event_stream(spark, sf_dir), "user_id", "3 hours", "1 hour"), "sessions")
    return out.select("user_id", stamp("start"), stamp("end"), "events")


@query("stream_macd", "ST4 Q1", S.with_bars(S.BRAND_WEEK, S.adjusted(), macd_sql()) + shown_sql("mc", {"dif": "dif", "dea": "dea"}, 4))
def stream_macd(spark, sf_dir):
    out = ST.run_available(ST.streaming_macd(bar_stream(spark, sf_dir)), "macd")
    return out.select("sym", F.col("d").cast("string").alias("d"), rnd("dif", 4).alias("dif"), rnd("dea", 4).alias("dea"))


@query(
    "stream_zigzag_lows", "ST5 Q8",
    S.with_bars(S.BRAND_WEEK, S.adjusted(), ZIGZAG_SQL.replace("PCT", "0.05")) + "SELECT zz.sym, CAST(adj.d AS VARCHAR) AS d, CAST(found AS BIGINT) AS low_pos, CAST(zz.pos AS BIGINT) AS sig_pos FROM zz JOIN adj ON adj.sym = zz.sym AND adj.pos = zz.pos WHERE found IS NOT NULL",
)
def stream_zigzag_lows(spark, sf_dir):
    out = ST.run_available(ST.streaming_zigzag(bar_stream(spark, sf_dir), 0.05), "zigzag")
    return out.withColumn("d", F.col("d").cast("string"))


@query("stream_last_n_buffer", "ST6 W4 W7", S.with_bars(S.BRAND_WEEK) + shown_sql("bars", {"mean": full("avg", "close", 20), "min": full("min", "close", 20), "max": full("max", "close", 20)}, 4))
def stream_last_n_buffer(spark, sf_dir):
    out = ST.run_available(ST.streaming_last_n(bar_stream(spark, sf_dir), "close", 20), "last-n")
    return out.select("sym", F.col("d").cast("string").alias("d"), *[rnd(c, 4).alias(c) for c in ("mean", "min", "max")])


@query("stream_first_of_day", "ST7", "SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS d FROM events")
def stream_first_of_day(spark, sf_dir):
    # The delay spans the table, so a repeated (user, day) is always still remembered.
    out = ST.run_available(ST.first_of_day(event_stream(spark, sf_dir), "user_id", "40 days").select("user_id", "d"), "dedup")
    return out.withColumn("d", F.col("d").cast("string"))


@query(
    "stream_static_calendar_join", "ST8 J4",
    """WITH c AS (SELECT d, row_number() OVER (ORDER BY d) AS p FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events WHERE event_type = 'purchase')) SELECT e.event_id, CAST(p AS DOUBLE) AS cal_pos FROM events e LEFT JOIN c ON c.d = CAST(e.ts AS DATE)""",
)
def stream_static_calendar_join(spark, sf_dir):
    bought = SRC.table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("ts").cast("date").alias("d"))
    stream = event_stream(spark, sf_dir).withColumn("d", F.col("ts").cast("date")).select("event_id", "d")
    out = ST.run_available(ST.with_static(stream, SRC.calendar(bought), ["d"]), "static")
    return out.select("event_id", F.col("cal_pos").cast("double").alias("cal_pos"))


@query(
    "stream_matured_pairs", "ST9 L6",
    f"SELECT a.user_id, a.event_id, {stamp_sql('b.ts', 'later_ts')}, {r('b.value', 4)} AS value FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'signup' AND b.event_type = 'purchase'",
)
def stream_matured_pairs(spark, sf_dir):
    ev = event_stream(spark, sf_dir)
    signups = ev.where("event_type = 'signup'").select("user_id", "ts", "event_id")
    bought = event_stream(spark, sf_dir).where("event_type = 'purchase'").select("user_id", "ts", "value")
    out = ST.run_available(ST.matured_pairs(signups, bought, "user_id", "6 hours", "1 hour"), "pairs")
    return out.select("user_id", "event_id", stamp("later_ts"), rnd("value", 4).alias("value"))


@query(
    "stream_idempotent_day_sink", "ST10 ST11 S13",
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS d, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
)
def stream_idempotent_day_sink(spark, sf_dir):
    """The same stream written twice into one table partitioned by day leaves each day once."""
    folder = ST.scratch(spark, "days")
    for run in ("first", "second"):
        rows = event_stream(spark, sf_dir).select("event_id", "user_id", F.col("ts").cast("date").alias("d"))
        rows = ST.observe_late(rows.withColumn("ts", F.col("d").cast("timestamp")), "ts", F.lit("2024-01-02").cast("timestamp"), "1 day")
        ST.start_day_sink(rows.drop("ts"), f"{folder}/rows", f"{folder}/_state_{run}").awaitTermination()
    stored = spark.read.parquet(f"{folder}/rows")
    return stored.groupBy(F.col("d").cast("string").alias("d")).agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"))


# ---------------------------------------------------------------- rows out of order
def jittered_bar_stream(spark, sf_dir, files: int = 4):
    """Weekly bars as a stream whose batches overlap by up to 20 weeks: a bar comes with a period or with the next one.

    A last batch holds one row of no symbol, far ahead, as a source's heartbeat: the watermark passes all other rows.
    """
    bars = SRC.bars_brand_week(spark, sf_dir).select("sym", "d", *[F.col(c).cast("double") for c in ("high", "low", "close")])
    bars = stored(bars.withColumn("ts", F.col("d").cast("timestamp")), "bars")
    arrival = F.date_add("d", F.pmod(F.xxhash64("sym", "d"), F.lit(140)).cast("int"))
    folder = ST.scratch(spark, "jittered")
    edges = ["1900-01-01", "1994-01-01", "1996-01-01", "1998-01-01", "2999-01-01"]
    for lo, hi in zip(edges, edges[1:]):
        part = bars.where((arrival >= F.lit(lo).cast("date")) & (arrival < F.lit(hi).cast("date")))
        part.repartition(files).write.mode("append").parquet(folder)
    ahead = spark.range(files).select(
        F.lit("").alias("sym"), F.lit("2100-01-01").cast("date").alias("d"), *[F.lit(0.0).alias(c) for c in ("high", "low", "close")],
        (F.lit("2100-01-01").cast("timestamp") + F.make_dt_interval(F.col("id"))).alias("ts"),
    )
    ahead.repartition(files).write.mode("append").parquet(folder)
    return ST.parquet_stream(spark, folder, "*.parquet", bars.schema, files)


def ordered(spark, sf_dir, fold, name):
    out = ST.run_available(O.in_order(jittered_bar_stream(spark, sf_dir), fold, "ts", "150 days"), name)
    return out.where("sym <> ''").withColumn("d", F.col("ts").cast("date").cast("string"))


@query(
    "stream_indicators_out_of_order", "ST4 Q1 Q2 Q3",
    S.with_bars(S.BRAND_WEEK, S.adjusted(), macd_sql(), *wilder_sql(14),
                "a0 AS (SELECT *, greatest(high - low, abs(high - pre_close), abs(low - pre_close)) AS tr FROM adj)",
                f"a1 AS (SELECT *, list(tr) FILTER (WHERE pos > 1) {S.past()} AS tl FROM a0)",
                f"a2 AS (SELECT *, CASE WHEN pos > 14 THEN {_fold('list_avg(tl[1:14])', 'tl[15:]', 1 / 14)} END AS atr14 FROM a1)")
    + f"SELECT sym, CAST(d AS VARCHAR) AS d, {r('dif', 4)} AS dif, {r('dea', 4)} AS dea, {r('100.0 * coalesce(g / nullif(g + o, 0), 0) + 0 * g', 4)} AS rsi, {r('atr14', 4)} AS atr "
    "FROM mc JOIN w2 USING (sym, d) JOIN a2 USING (sym, d)",
)
def stream_indicators_out_of_order(spark, sf_dir):
    """MACD, RSI and ATR in one pass over bars that arrive up to 20 weeks out of order."""
    out = ordered(spark, sf_dir, O.together(O.macd("close"), O.rsi("close", 14), O.atr("high", "low", "close", 14)), "indicators")
    return out.select("sym", "d", *[rnd(c, 4).alias(c) for c in ("dif", "dea", "rsi", "atr")])


@query(
    "stream_crosses_out_of_order", "ST5 E9",
    S.with_bars(S.BRAND_WEEK, S.adjusted(), macd_sql(), CROSS_SQL)
    + f"SELECT sym, CAST(d AS VARCHAR) AS d, CAST(golden AS BIGINT) AS golden, {r('dif', 4)} AS dif, {r('dea', 4)} AS dea FROM cr WHERE golden OR death",
)
def stream_crosses_out_of_order(spark, sf_dir):
    out = ordered(spark, sf_dir, O.crosses("close"), "crosses")
    return out.select("sym", "d", F.col("golden").cast("long").alias("golden"), rnd("dif", 4).alias("dif"), rnd("dea", 4).alias("dea"))


@query(
    "stream_zigzag_out_of_order", "ST5 Q8",
    S.with_bars(S.BRAND_WEEK, S.adjusted(), ZIGZAG_SQL.replace("PCT", "0.05")) + "SELECT zz.sym, CAST(adj.d AS VARCHAR) AS d, CAST(found AS BIGINT) AS low_pos, CAST(zz.pos AS BIGINT) AS sig_pos FROM zz JOIN adj ON adj.sym = zz.sym AND adj.pos = zz.pos WHERE found IS NOT NULL",
)
def stream_zigzag_out_of_order(spark, sf_dir):
    return ordered(spark, sf_dir, O.zigzag("close", 0.05), "ordered-zigzag").select("sym", "d", "low_pos", "sig_pos")


@query(
    "stream_last_n_out_of_order", "ST6 W4 W7",
    S.with_bars(S.BRAND_WEEK) + shown_sql("bars", {"mean": full("avg", "close", 20), "low": full("min", "close", 20), "high": full("max", "close", 20)}, 4),
)
def stream_last_n_out_of_order(spark, sf_dir):
    out = ordered(spark, sf_dir, O.last_n("close", 20), "ordered-last-n")
    return out.select("sym", "d", *[rnd(c, 4).alias(c) for c in ("mean", "low", "high")])


# ---------------------------------------------------------------- late rows, commits
BATCH_SQL = "least(4, CAST(floor((day(ts) - 1) / 7) AS BIGINT) + CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END)"


def dealt_event_stream(spark, sf_dir, files: int = 2):
    """Events as five batches by week of the month; every ninth comes one batch later."""
    events = SRC.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "user_id", "ts", F.col("ts").cast("date").alias("d"))
    batch = F.least(F.lit(4), F.floor((F.dayofmonth("ts") - 1) / 7) + F.when(F.col("event_id") % 9 == 0, 1).otherwise(0))
    events = stored(events.withColumn("batch", batch.cast("int")), "dealt")
    folder = ST.scratch(spark, "dealt")
    for i in range(5):
        events.where(F.col("batch") == i).drop("batch").repartition(files).write.mode("append").parquet(folder)
    return ST.parquet_stream(spark, folder, "*.parquet", events.drop("batch").schema, files)


@query(
    "stream_late_rows", "ST10",
    f"""WITH e AS (SELECT *, {BATCH_SQL} AS batch FROM events), n AS (SELECT batch, max(ts) AS newest FROM e GROUP BY 1),
w AS (SELECT batch, max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAY AS behind FROM n),
f AS (SELECT e.*, coalesce(ts < behind, false) AS late FROM e JOIN w USING (batch)),
c AS (SELECT late, count(*) AS counted FROM f GROUP BY 1)
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS d, CAST(late AS BIGINT) AS late, count(*) AS events, count(DISTINCT user_id) AS users, any_value(counted) AS counted FROM f JOIN c USING (late) GROUP BY 1, 2""",
)
def stream_late_rows(spark, sf_dir):
    """Rows in time and rows more than two days behind the newest of earlier batches, by day; and how many the batches counted of each."""
    folder = ST.scratch(spark, "late")
    in_time, late, counted = DT.route_late(dealt_event_stream(spark, sf_dir), "ts", 2 * 86_400, "d", folder, f"{folder}/_state")
    both = in_time.read().withColumn("late", F.lit(0)).unionByName(late.read().withColumn("late", F.lit(1)))
    days = both.groupBy(F.col("d").cast("string").alias("d"), F.col("late").cast("long").alias("late")).agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"))
    n = counted.agg(F.sum(F.col("n_rows") - F.col("n_late")).alias("in_time"), F.sum("n_late").alias("behind"))
    return attach_row(days, n).select("d", "late", "events", "users", F.when(F.col("late") == 1, F.col("behind")).otherwise(F.col("in_time")).alias("counted"))


@query(
    "stream_committed_days", "ST11 S13",
    f"""WITH e AS (SELECT *, CAST(ts AS DATE) AS d, {BATCH_SQL} AS batch FROM events)
SELECT CAST(d AS VARCHAR) AS d, count(*) AS events, count(DISTINCT user_id) AS users, count(DISTINCT batch) AS batches FROM e GROUP BY 1""",
)
def stream_committed_days(spark, sf_dir):
    """Five batches, days in several of them, all replayed from a new checkpoint, then compacted: each row once.

    ``batches`` is the number of manifest lines of a day before compaction.
    """
    folder = ST.scratch(spark, "committed")
    table, stream = DT.DayTable(spark, f"{folder}/table"), dealt_event_stream(spark, sf_dir)
    for run in ("first", "replay"):
        table.start(stream, f"{folder}/_state_{run}").awaitTermination()
    lines = stored(table.manifest().groupBy(F.col("day").alias("d")).agg(F.count(F.lit(1)).alias("batches")), "lines")
    table.compact()
    days = table.read().groupBy(F.col("d").cast("string").alias("d")).agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"))
    return days.join(lines, "d")


@query(
    "stream_unmatched_pairs", "ST9 L6 L11",
    f"""WITH a AS (SELECT * FROM events WHERE event_type = 'signup'), b AS (SELECT * FROM events WHERE event_type = 'purchase'),
p AS (SELECT a.user_id, a.event_id, b.ts AS later_ts, b.value FROM a JOIN b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR),
m AS (SELECT min(x) AS x FROM (SELECT max(ts) AS x FROM a UNION ALL SELECT max(ts) FROM b))
SELECT user_id, event_id, {stamp_sql('later_ts')}, {r('value', 4)} AS value FROM p
UNION ALL SELECT user_id, event_id, NULL, NULL FROM a, m WHERE event_id NOT IN (SELECT event_id FROM p) AND a.ts + INTERVAL 6 HOUR < m.x - INTERVAL 1 HOUR""",
)
def stream_unmatched_pairs(spark, sf_dir):
    """As ``stream_matured_pairs``, with the events that stay without a pair once none can come any more."""
    signups = event_stream(spark, sf_dir).where("event_type = 'signup'").select("user_id", "ts", "event_id")
    bought = event_stream(spark, sf_dir).where("event_type = 'purchase'").select("user_id", "ts", "value")
    out = ST.run_available(ST.matured_pairs(signups, bought, "user_id", "6 hours", "1 hour", "leftOuter"), "outer-pairs")
    return out.select("user_id", "event_id", stamp("later_ts"), rnd("value", 4).alias("value"))
