"""Scans, calendars, profiles, filters over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import scalar as C
from barloom.functions.rolling import BARS as B
from barloom.functions.scalar import rnd, sdiv
from barloom.operators import joins as J
from barloom.plans import sqltext as S
from barloom.plans.registry import query
from barloom.plans.sqltext import r
from barloom.plans.util import shown
from barloom.sources import bars as SRC
from barloom.sources import tables as T


@query(
    "bars_from_fills_weekly", "S1 S6 S18 C11 ST1",
    S.with_bars(S.BRAND_WEEK) + f"SELECT sym, CAST(d AS VARCHAR) AS d, {r('open', 4)} AS open, {r('high', 4)} AS high, "
    f"{r('low', 4)} AS low, {r('close', 4)} AS close, {r('vol')} AS vol, amount, CAST(n AS BIGINT) AS n FROM bars",
)
def bars_from_fills_weekly(spark, sf_dir):
    bars = SRC.bars_brand_week(spark, sf_dir)
    return bars.select(
        "sym", F.col("d").cast("string").alias("d"), *[rnd(c, 4).alias(c) for c in ("open", "high", "low", "close")],
        rnd("vol").alias("vol"), "amount", "n",
    )


@query(
    "clean_order_bars", "S1 S17 U4 C11",
    f"""WITH x AS (SELECT o_custkey AS sym, CAST(o_orderdate AS DATE) AS d, o_totalprice AS close, o_orderkey,
 row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS rn FROM orders
 WHERE o_totalprice IS NOT NULL)
 SELECT sym, CAST(d AS VARCHAR) AS d, {r('close', 2)} AS close, o_orderkey FROM x WHERE rn = 1""",
)
def clean_order_bars(spark, sf_dir):
    raw = SRC.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("sym"), C.to_day("o_orderdate").alias("d"), F.col("o_totalprice").alias("close"), "o_orderkey"
    )
    out = SRC.clean_bars(raw, keep_first=["o_orderkey"])
    return out.select("sym", F.col("d").cast("string").alias("d"), rnd("close", 2).alias("close"), "o_orderkey")


@query(
    "index_series_with_day_numbers", "S2",
    S.with_bars(S.INDEX_WEEK) + f"SELECT CAST(d AS VARCHAR) AS d, {r('close', 4)} AS close, "
    f"CAST(d - DATE '1970-01-01' AS BIGINT) AS day_no FROM bars",
)
def index_series_with_day_numbers(spark, sf_dir):
    raw = SRC.index_bars(spark, sf_dir).withColumn("trade_date", F.date_format("d", "yyyyMMdd")).drop("d", "sym")
    out = T.read_index(raw)
    return out.select(
        F.col("d").cast("string").alias("d"), rnd("close", 4).alias("close"), F.col("day_no").cast("long").alias("day_no")
    )


@query(
    "trading_calendar", "S8 S7",
    S.with_bars(S.USER_DAY) + """SELECT CAST(d AS VARCHAR) AS d, CAST(row_number() OVER (ORDER BY d) AS BIGINT) AS cal_pos
 FROM (SELECT DISTINCT d FROM bars)""",
)
def trading_calendar(spark, sf_dir):
    cal = SRC.calendar(SRC.bars_user_day(spark, sf_dir))
    return cal.select(F.col("d").cast("string").alias("d"), F.col("cal_pos").cast("long").alias("cal_pos"))


SPLICE_CUT = "1998-06-01"


@query(
    "spliced_market_return", "S9 S10",
    S.with_bars(S.INDEX_WEEK, f"b AS ({S.index_of('STANDARD')})",
                "ra AS (SELECT d, close / lag(close) OVER (ORDER BY d) - 1.0 AS ret, 'all' AS src FROM bars)",
                "rb AS (SELECT d, close / lag(close) OVER (ORDER BY d) - 1.0 AS ret, 'part' AS src FROM b)")
    + f"""SELECT CAST(d AS VARCHAR) AS d, {r('ret')} AS ret, src FROM (SELECT * FROM ra WHERE d < DATE '{SPLICE_CUT}'
 UNION ALL SELECT * FROM rb WHERE d >= DATE '{SPLICE_CUT}')""",
)
def spliced_market_return(spark, sf_dir):
    def returns(index, tag):
        return index.select("d", (sdiv("close", B.ref("close", 1)) - 1.0).alias("ret"), F.lit(tag).alias("src"))

    out = SRC.splice(
        returns(SRC.index_bars(spark, sf_dir), "all"), returns(SRC.index_bars(spark, sf_dir, "STANDARD"), "part"), SPLICE_CUT
    )
    return out.select(F.col("d").cast("string").alias("d"), rnd("ret").alias("ret"), "src")


PANEL_SQL = S.with_bars(
    S.SUPP_MONTH,
    "basic AS (SELECT l_suppkey AS sym, CAST(date_trunc('month', l_shipdate) AS DATE) AS d, avg(l_discount) AS disc, "
    "avg(l_tax) AS tax FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2)",
    "p0 AS (SELECT *, lag(close) OVER (PARTITION BY sym ORDER BY d) AS pre_close, "
    "dense_rank() OVER (ORDER BY d) AS cal_pos FROM bars)",
    "lim AS (SELECT sym, d, pre_close * 1.1 AS up_limit, pre_close * 0.9 AS down_limit FROM p0 WHERE cal_pos % 17 <> 0)",
)


def limits_of(adj, cal):
    """Stand-in limit table: previous close +-10%, absent on every 17th calendar day."""
    placed = adj.join(F.broadcast(cal), "d")
    return placed.where(F.pmod("cal_pos", F.lit(17)) != 0).select(
        "sym", "d", (F.col("pre_close") * 1.1).alias("up_limit"), (F.col("pre_close") * 0.9).alias("down_limit")
    )


@query(
    "panel_of_bars_basics_limits", "S4 S5 J1",
    PANEL_SQL + f"""SELECT b.sym, CAST(b.d AS VARCHAR) AS d, {r('b.close', 4)} AS close, {r('disc')} AS disc, {r('tax')} AS tax,
 {r('up_limit', 4)} AS up_limit, {r('down_limit', 4)} AS down_limit FROM bars b LEFT JOIN basic USING (sym, d)
 LEFT JOIN lim USING (sym, d) WHERE b.d BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""",
)
def panel_of_bars_basics_limits(spark, sf_dir):
    adj = SRC.adjust(SRC.bars_supp_month(spark, sf_dir))
    basic = (
        SRC.table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'")
        .groupBy(F.col("l_suppkey").alias("sym"), F.date_trunc("month", "l_shipdate").cast("date").alias("d"))
        .agg(F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"))
    )
    limits = limits_of(adj, SRC.calendar(adj))
    first, last = "1996-01-01", "1999-12-31"
    panel = J.join_many_to_one(
        # Grouped by the key just above, so unique without a check.
        J.join_many_to_one(T.in_range(adj.select("sym", "d", "close"), first, last), T.in_range(basic, first, last), ["sym", "d"], check=False),
        T.in_range(limits, first, last), ["sym", "d"],
    )
    return panel.select(
        "sym", F.col("d").cast("string").alias("d"), rnd("close", 4).alias("close"), rnd("disc").alias("disc"),
        rnd("tax").alias("tax"), rnd("up_limit", 4).alias("up_limit"), rnd("down_limit", 4).alias("down_limit"),
    )


@query(
    "compact_sink_columns", "S12 S11",
    S.with_bars(S.USER_DAY) + f"SELECT sym, CAST(d AS VARCHAR) AS d, CAST(CAST({r('close', 4)} AS FLOAT) AS DOUBLE) AS close, "
    f"CAST(CAST({r('amount', 4)} AS FLOAT) AS DOUBLE) AS amount FROM bars",
)
def compact_sink_columns(spark, sf_dir):
    out = T.compact(SRC.bars_user_day(spark, sf_dir).select("sym", "d", "close", "amount"))
    return out.select("sym", F.col("d").cast("string").alias("d"), F.col("close").cast("double").alias("close"),
                      F.col("amount").cast("double").alias("amount"))


@query(
    "stale_days_by_fingerprint", "S13",
    S.with_bars(S.USER_DAY, "c AS (SELECT d, row_number() OVER (ORDER BY d) AS p FROM (SELECT DISTINCT d FROM bars))")
    + "SELECT CAST(d AS VARCHAR) AS d FROM c WHERE p % 3 <> 0 OR p % 2 = 0",
)
def stale_days_by_fingerprint(spark, sf_dir):
    cal = SRC.calendar(SRC.bars_user_day(spark, sf_dir))
    now, before = {"window": 20, "lag": 1}, {"window": 10, "lag": 1}
    done = cal.where("cal_pos % 3 = 0")
    manifest = done.where("cal_pos % 2 = 1").select("d", T.config_digest(now).alias("digest")).unionByName(
        done.where("cal_pos % 2 = 0").select("d", T.config_digest(before).alias("digest"))
    )
    return T.stale_days(cal, manifest, now).select(F.col("d").cast("string").alias("d"))


@query(
    "side_table_profile", "S15",
    f"""WITH t AS (SELECT user_id, CAST(ts AS DATE) AS d, CASE WHEN value > 0 THEN value END AS value, CASE WHEN event_type = 'view' THEN props END AS props FROM events),
 w AS (SELECT count(*) AS n_rows, min(d) AS first_d, max(d) AS last_d, count(DISTINCT user_id) AS n_keys, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS mv,
 avg(CASE WHEN props IS NULL THEN 1.0 ELSE 0.0 END) AS mp FROM t)
 SELECT 'value' AS "column", {r('mv')} AS missing, n_rows, CAST(first_d AS VARCHAR) AS first_d, CAST(last_d AS VARCHAR) AS last_d, n_keys FROM w
 UNION ALL SELECT 'props', {r('mp')}, n_rows, CAST(first_d AS VARCHAR), CAST(last_d AS VARCHAR), n_keys FROM w""",
)
def side_table_profile(spark, sf_dir):
    side = SRC.table(spark, sf_dir, "events").select(
        "user_id", F.col("ts").cast("date").alias("d"), C.positive("value").alias("value"),
        F.when(F.col("event_type") == "view", F.col("props")).alias("props"),
    )
    out = T.profile(side, "user_id", "d", ["value", "props"])
    return out.select("column", rnd("missing").alias("missing"), "n_rows", F.col("first_d").cast("string").alias("first_d"),
                      F.col("last_d").cast("string").alias("last_d"), "n_keys")


@query(
    "missing_days_and_last_day", "S15 A13",
    S.with_bars(S.USER_DAY, "cal AS (SELECT DISTINCT d FROM bars)", "mx AS (SELECT max(d) AS mx FROM bars)",
                "pur AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events WHERE event_type = 'signup' AND value > 300)",
                "k AS (SELECT sym, max(d) AS last_d FROM bars GROUP BY 1)")
    + "SELECT 'missing' AS kind, CAST(cal.d AS VARCHAR) AS d, NULL::DOUBLE AS sym FROM cal WHERE d NOT IN (SELECT d FROM pur) "
      "UNION ALL SELECT 'stopped', CAST(last_d AS VARCHAR), CAST(sym AS DOUBLE) FROM k, mx WHERE last_d < mx",
)
def missing_days_and_last_day(spark, sf_dir):
    bars = SRC.bars_user_day(spark, sf_dir)
    signups = SRC.table(spark, sf_dir, "events").where("event_type = 'signup' and value > 300")
    gone = T.missing_days(signups.select(F.col("ts").cast("date").alias("d")), SRC.calendar(bars))
    stopped = T.last_day_coverage(bars).where("not is_current")
    return gone.select(F.lit("missing").alias("kind"), F.col("d").cast("string").alias("d"), F.lit(None).cast("double").alias("sym")).unionByName(
        stopped.select(F.lit("stopped").alias("kind"), F.col("last_d").cast("string").alias("d"), F.col("sym").cast("double").alias("sym"))
    )


@query(
    "coverage_and_trigger_rates", "S16",
    S.with_bars(S.SUPP_MONTH, S.adjusted(), "f AS (SELECT year(d) AS y, CASE WHEN r IS NOT NULL THEN CASE WHEN r > 0.5 THEN 1.0 ELSE 0.0 END END AS up, "
                "CASE WHEN pos > 20 THEN CASE WHEN close < open THEN 1.0 ELSE 0.0 END END AS dn FROM adj)")
    + f"""SELECT CAST(y AS BIGINT) AS y, {r('avg(CASE WHEN up IS NULL THEN 1.0 ELSE 0.0 END)')} AS up_missing, {r('avg(up)')} AS up_rate,
 {r('avg(CASE WHEN dn IS NULL THEN 1.0 ELSE 0.0 END)')} AS dn_missing, {r('avg(dn)')} AS dn_rate FROM f GROUP BY y""",
)
def coverage_and_trigger_rates(spark, sf_dir):
    adj = SRC.adjust(SRC.bars_supp_month(spark, sf_dir))
    flags = adj.select(
        F.year("d").cast("long").alias("y"), C.flag(F.col("r") > 0.5).alias("up"),
        F.when(F.col("pos") > 20, C.flag(F.col("close") < F.col("open"))).alias("dn"),
    )
    out = T.trigger_rates(flags, ["up", "dn"], ["y"])
    return out.select("y", *[rnd(c).alias(c) for c in out.columns if c != "y"])


@query(
    "event_type_shares_and_codes", "S16 P19 A13",
    f"""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
 SELECT event_type, n AS "rows", {r('n / (sum(n) OVER ())')} AS share, CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS code FROM c""",
)
def event_type_shares_and_codes(spark, sf_dir):
    shares = T.value_shares(SRC.table(spark, sf_dir, "events"), "event_type")
    coded = T.label_codes(shares, "event_type", "code")
    return coded.select("event_type", "rows", rnd("share").alias("share"), "code")


@query(
    "date_offsets_and_parts", "P20 F6.18",
    f"""SELECT DISTINCT CAST(o_orderdate AS DATE)::VARCHAR AS d, CAST(CAST(o_orderdate AS DATE) - 1 AS VARCHAR) AS d_minus_1,
 CAST(CAST(o_orderdate AS DATE) - 180 AS VARCHAR) AS d_minus_180, CAST(dayofyear(o_orderdate) AS BIGINT) AS day_of_year,
 CAST(weekofyear(o_orderdate) AS BIGINT) AS week_of_year, CAST(quarter(o_orderdate) AS BIGINT) AS quarter,
 CAST(day(o_orderdate) AS BIGINT) AS day_of_month, CAST(day(o_orderdate) = 1 AS BIGINT) AS month_start,
 CAST(CAST(o_orderdate AS DATE) = last_day(CAST(o_orderdate AS DATE)) AS BIGINT) AS month_end,
 CAST(CAST(o_orderdate AS DATE) = CAST(date_trunc('quarter', o_orderdate) AS DATE) AS BIGINT) AS quarter_start,
 CAST(CAST(o_orderdate AS DATE) = CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS BIGINT) AS quarter_end
 FROM orders""",
)
def date_offsets_and_parts(spark, sf_dir):
    from barloom.features.calendar import date_parts

    days = SRC.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    out = date_parts(T.with_date_offsets(days, "d", [1, 180]))
    return out.select(
        *[F.col(c).cast("string").alias(c) for c in ("d", "d_minus_1", "d_minus_180")],
        *[F.col(c).cast("long").alias(c) for c in out.columns if not c.startswith("d_minus") and c != "d"],
    )


@query(
    "segments_by_date", "P4",
    """WITH s AS (SELECT CASE WHEN d < DATE '1996-01-01' THEN 'early' WHEN d BETWEEN DATE '1998-12-01' AND DATE '1998-12-31' THEN 'embargo'
 WHEN d < DATE '1999-01-01' THEN 'train' WHEN d < DATE '2000-07-01' THEN 'val' ELSE 'test' END AS seg
 FROM (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem)) SELECT seg, count(*) AS n FROM s GROUP BY seg""",
)
def segments_by_date(spark, sf_dir):
    from barloom.operators.segments import Segments

    rule = Segments.of(
        embargo=("1998-12-01", "1998-12-31"), early=(None, "1995-12-31"), train=("1996-01-01", "1998-12-31"),
        val=("1999-01-01", "2000-06-30"), test=("2000-07-01", None),
    )
    days = SRC.table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("d"))
    return days.select(rule.column("d").alias("seg")).groupBy("seg").agg(F.count(F.lit(1)).alias("n"))


@query(
    "board_limit_and_name_status", "P5 P6 S17",
    """WITH c AS (SELECT CASE c_custkey % 5 WHEN 0 THEN '688' WHEN 1 THEN '300' WHEN 2 THEN '301' WHEN 3 THEN '600' ELSE '830' END
 || CAST(c_custkey AS VARCHAR) || CASE WHEN c_custkey % 5 = 4 THEN '.BJ' ELSE '.SZ' END AS code,
 CASE c_custkey % 4 WHEN 0 THEN '*st' WHEN 1 THEN 'ST ' WHEN 2 THEN '退' ELSE '' END || c_mktsegment AS nm,
 DATE '2020-08-20' + CAST(c_custkey % 9 AS INT) AS d FROM customer)
 SELECT code, CAST(d AS VARCHAR) AS d, CASE WHEN suffix(code, '.BJ') THEN 30.0 WHEN starts_with(code, '688') THEN 20.0
 WHEN (starts_with(code, '300') OR starts_with(code, '301')) AND d >= DATE '2020-08-24' THEN 20.0 ELSE 10.0 END::DOUBLE AS lim,
 CASE WHEN contains(nm, '退') THEN 3.0 WHEN contains(upper(nm), '*ST') THEN 2.0 WHEN contains(upper(nm), 'ST') THEN 1.0 ELSE 0.0 END::DOUBLE AS status FROM c""",
)
def board_limit_and_name_status(spark, sf_dir):
    key = F.col("c_custkey")
    front = F.element_at(F.array(*map(F.lit, ("688", "300", "301", "600", "830"))), (key % 5 + 1).cast("int"))
    mark = F.element_at(F.array(*map(F.lit, ("*st", "ST ", "退", ""))), (key % 4 + 1).cast("int"))
    cust = SRC.table(spark, sf_dir, "customer").select(
        F.concat(front, key.cast("string"), F.when(key % 5 == 4, ".BJ").otherwise(".SZ")).alias("code"),
        F.concat(mark, "c_mktsegment").alias("nm"), F.date_add(F.lit("2020-08-20").cast("date"), (key % 9).cast("int")).alias("d"),
    )
    return cust.select(
        "code", F.col("d").cast("string").alias("d"), C.board_limit("code", "d").alias("lim"), C.name_status("nm").alias("status")
    )


@query(
    "history_slice_around_day", "P8",
    S.with_bars(S.USER_DAY, "x AS (SELECT *, CASE WHEN d <= DATE '2024-01-15' THEN row_number() OVER (PARTITION BY sym, d <= DATE '2024-01-15' ORDER BY d DESC) END AS back, "
                "CASE WHEN d > DATE '2024-01-15' THEN row_number() OVER (PARTITION BY sym, d <= DATE '2024-01-15' ORDER BY d) END AS ahead FROM bars)")
    + f"SELECT sym, CAST(d AS VARCHAR) AS d, {r('close', 4)} AS close FROM x WHERE back <= 7 OR ahead <= 3",
)
def history_slice_around_day(spark, sf_dir):
    out = slice_around(SRC.bars_user_day(spark, sf_dir), "2024-01-15", 7, 3)
    return shown(out, {"close": F.col("close")}, 4)


def slice_around(bars, day: str, history: int, future: int):
    """Last ``history`` rows up to the day and first ``future`` rows after it, per symbol."""
    t = F.lit(day).cast("date")
    past, ahead = bars.where(F.col("d") <= t), bars.where(F.col("d") > t)
    newest = Window.partitionBy("sym").orderBy(F.desc("d"))
    oldest = Window.partitionBy("sym").orderBy("d")
    kept = past.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= history)
    return kept.unionByName(ahead.withColumn("_rn", F.row_number().over(oldest)).where(F.col("_rn") <= future)).drop("_rn")


@query(
    "symbols_with_enough_history", "P9 P10",
    S.with_bars(S.USER_DAY, "c AS (SELECT sym, count(*) AS k FROM bars GROUP BY 1)")
    + f"SELECT sym, CAST(d AS VARCHAR) AS d, {r('close', 4)} AS close FROM bars JOIN c USING (sym) WHERE k >= 27 AND sym NOT IN (1, 2)",
)
def symbols_with_enough_history(spark, sf_dir):
    bars = SRC.bars_user_day(spark, sf_dir)
    long_enough = bars.groupBy("sym").count().where("count >= 27").select("sym")
    pseudo = [1, 2]
    out = bars.where(~F.col("sym").isin(pseudo)).join(long_enough, "sym", "left_semi")
    return shown(out, {"close": F.col("close")}, 4)


@query(
    "fee_schedule", "L12",
    f"""WITH x AS (SELECT o_orderkey, o_totalprice AS amt, CAST(o_orderdate AS DATE) + INTERVAL 26 YEAR AS d FROM orders)
 SELECT o_orderkey, {r('greatest(5.0, amt * 0.00025)')} AS commission, CASE WHEN d < DATE '2023-08-28' THEN 0.001 ELSE 0.0005 END::DOUBLE AS stamp,
 {r('amt * 0.001')} AS slippage, CAST(floor(100000.0 / amt / 100) * 100 AS BIGINT) AS shares FROM x""",
)
def fee_schedule(spark, sf_dir):
    orders = SRC.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("amt"),
        (F.col("o_orderdate").cast("date") + F.expr("interval 26 years")).cast("date").alias("d"),
    )
    return orders.select(
        "o_orderkey", rnd(C.commission("amt")).alias("commission"), C.stamp_rate("d").alias("stamp"),
        rnd(F.col("amt") * C.SLIPPAGE).alias("slippage"), C.lot_shares(F.lit(100000.0), "amt").alias("shares"),
    )


@query(
    "safe_division_and_inf_guard", "P2 P3 C9",
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_discount, l_tax FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)::VARCHAR AS d, {r('l_extendedprice', 2)} AS px, {r('l_tax / nullif(l_discount, 0)')} AS ratio FROM x""",
)
def safe_division_and_inf_guard(spark, sf_dir):
    li = SRC.table(spark, sf_dir, "lineitem")
    raw = F.col("l_tax") / F.nullif("l_discount", F.lit(0.0))
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").cast("string").alias("d"),
        rnd("l_extendedprice", 2).alias("px"), rnd(C.finite(F.coalesce(sdiv("l_tax", "l_discount"), raw))).alias("ratio"),
    )


@query(
    "csv_bars_round_trip", "S3",
    S.with_bars(S.USER_DAY) + f"SELECT CAST(sym AS VARCHAR) AS sym, CAST(d AS VARCHAR) AS d, {r('close', 4)} AS close FROM bars WHERE d BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'",
)
def csv_bars_round_trip(spark, sf_dir):
    """Bars written as one CSV folder per symbol and read back with the symbol taken from the path."""
    from barloom.streaming.jobs import scratch

    folder = scratch(spark, "csv")
    bars = SRC.bars_user_day(spark, sf_dir).select("sym", F.date_format("d", "yyyyMMdd").alias("trade_date"), "close")
    T.write_csv_by_symbol(bars, folder)
    out = T.read_csv_bars(spark, folder, "trade_date string, close double", "trade_date", "2024-01-05", "2024-01-20", symbol_pattern=r"sym=([^/]+)/")
    return out.select("sym", F.col("d").cast("string").alias("d"), rnd("close", 4).alias("close"))


@query(
    "summary_table_append", "S14 S11",
    "SELECT 'w5' AS name, count(*) AS events, CAST(5 AS BIGINT) AS window_rows FROM orders UNION ALL SELECT 'w20', count(*), CAST(20 AS BIGINT) FROM lineitem",
)
def summary_table_append(spark, sf_dir):
    """One row appended per configuration, then the whole table read."""
    from barloom.streaming.jobs import scratch

    folder = scratch(spark, "summary")
    for name, source, w in (("w5", "orders", 5), ("w20", "lineitem", 20)):
        T.append_summary(spark, {"name": name, "events": SRC.table(spark, sf_dir, source).count(), "window_rows": w}, folder)
    return spark.read.parquet(folder).select("name", "events", "window_rows")


@query(
    "tick_windows_by_slice", "W4 W7 W1",
    f"""WITH t AS (SELECT event_id, user_id, value, row_number() OVER w AS pos, count(value) OVER f AS k, avg(value) OVER f AS m, max(value) OVER f AS x, lag(value, 5) OVER w AS l5 FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
 SELECT event_id, CAST(pos AS BIGINT) AS pos, CASE WHEN k = 20 THEN {r('m')} END AS mean20, CASE WHEN k = 20 THEN {r('x')} END AS max20, {r('l5')} AS back5 FROM t""",
)
def tick_windows_by_slice(spark, sf_dir):
    """Windows over raw ticks, whose keys have no calendar bound: every user is cut into slices of 64 rows."""
    from barloom.operators.series_slices import number_rows, windows_by_slice

    ticks = SRC.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    numbered = number_rows(ticks, ["user_id"], ["ts", "event_id"], F.col("ts").cast("date"))
    out = windows_by_slice(
        numbered, lambda w: {"mean20": w.agg("mean", "value", 20), "max20": w.agg("max", "value", 20), "back5": w.ref("value", 5)}, 64, 20, ["user_id"]
    )
    return out.select("event_id", F.col("pos").cast("long").alias("pos"), *[rnd(c).alias(c) for c in ("mean20", "max20", "back5")])


@query(
    "as_of_on_ticks", "J7 J8",
    f"""WITH p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT e.event_id, {r('p.value', 4)} AS last_purchase FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts > p.ts""",
)
def as_of_on_ticks(spark, sf_dir):
    """Latest purchase strictly before every other event; users are worked day by day."""
    ev = SRC.table(spark, sf_dir, "events")
    bought = ev.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("paid"))
    others = ev.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    out = J.as_of(others, bought, ["user_id"], "ts", ["paid"], "as_of_ts", strict=True, slot=F.col("ts").cast("date"))
    return out.select("event_id", rnd("paid", 4).alias("last_purchase"))
