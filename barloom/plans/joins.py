"""Joins over panels: as-of, interval, snapshot, merge, densification."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.functions.rolling import BARS as B
from barloom.functions.scalar import rnd
from barloom.operators import joins as J
from barloom.plans import sqltext as S
from barloom.plans.registry import query
from barloom.plans.sqltext import r
from barloom.plans.util import shown
from barloom.session import ensure_checkpoint_dir, stored
from barloom.sources import bars as SRC
from barloom.sources import tables as T

# One interval per user and day of its signup/error events; the last event of the day names it; it ends when the next one starts.
STATUS_SQL = """st0 AS (SELECT user_id AS sym, CAST(ts AS DATE) AS start, arg_max(event_type, row(ts, event_id)) AS kind FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1, 2),
st AS (SELECT sym, start, lead(start) OVER (PARTITION BY sym ORDER BY start) AS nxt, kind FROM st0)"""


def status_intervals(spark, sf_dir, gap_days: int = 4):
    """Intervals from signup/error days: open at the last one, otherwise until the next start or at most ``gap_days`` on."""
    from pyspark.sql import Window

    ev = SRC.table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "error"))
    days = ev.groupBy(F.col("user_id").alias("sym"), F.col("ts").cast("date").alias("start")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"))
    nxt = F.lead("start").over(Window.partitionBy("sym").orderBy("start"))
    return days.select("sym", "start", F.least(F.date_add("start", gap_days), nxt).alias("_e"), nxt.alias("_n"), "kind").select(
        "sym", "start", F.when(F.col("_n").isNotNull(), F.col("_e")).alias("end"), "kind"
    )


@query(
    "status_interval_join", "J6 S9 F5.10",
    S.with_bars(S.USER_DAY, STATUS_SQL, "iv AS (SELECT sym, start, CASE WHEN nxt IS NOT NULL THEN least(start + 4, nxt) END AS fin, kind FROM st)",
                "j AS (SELECT b.sym, b.d, iv.kind, row_number() OVER (PARTITION BY b.sym, b.d ORDER BY iv.start DESC NULLS LAST) AS rn, iv.fin FROM bars b LEFT JOIN iv ON iv.sym = b.sym AND iv.start <= b.d)")
    + "SELECT sym, CAST(d AS VARCHAR) AS d, CASE WHEN kind IS NOT NULL AND (fin IS NULL OR d <= fin) THEN kind ELSE 'none' END AS status FROM j WHERE rn = 1",
)
def status_interval_join(spark, sf_dir):
    bars = SRC.bars_user_day(spark, sf_dir).select("sym", "d")
    out = J.interval_value(bars, status_intervals(spark, sf_dir), ["sym"], "d", "kind", "status", F.lit("none"))
    return out.select("sym", F.col("d").cast("string").alias("d"), "status")


ASOF_SQL = S.with_bars(S.USER_DAY, "q AS (SELECT user_id AS sym, CAST(ts AS DATE) AS d, max(value) AS top FROM events WHERE event_type = 'purchase' AND value > 0 GROUP BY 1, 2)")


def purchases(spark, sf_dir):
    ev = SRC.table(spark, sf_dir, "events").where("event_type = 'purchase' and value > 0")
    return ev.groupBy(F.col("user_id").alias("sym"), F.col("ts").cast("date").alias("d")).agg(F.max("value").alias("top"))


@query(
    "as_of_latest_purchase", "J7",
    ASOF_SQL + f"SELECT b.sym, CAST(b.d AS VARCHAR) AS d, CAST(q.d AS VARCHAR) AS as_of_d, {r('top', 4)} AS top FROM bars b ASOF LEFT JOIN q ON b.sym = q.sym AND b.d >= q.d",
)
def as_of_latest_purchase(spark, sf_dir):
    out = J.as_of(SRC.bars_user_day(spark, sf_dir).select("sym", "d"), purchases(spark, sf_dir), ["sym"], "d", ["top"])
    return out.select("sym", F.col("d").cast("string").alias("d"), F.col("as_of_d").cast("string").alias("as_of_d"), rnd("top", 4).alias("top"))


@query(
    "as_of_strictly_before", "J8",
    ASOF_SQL + f"SELECT b.sym, CAST(b.d AS VARCHAR) AS d, CAST(q.d AS VARCHAR) AS as_of_d, {r('top', 4)} AS top FROM bars b ASOF LEFT JOIN q ON b.sym = q.sym AND b.d > q.d",
)
def as_of_strictly_before(spark, sf_dir):
    out = J.as_of(SRC.bars_user_day(spark, sf_dir).select("sym", "d"), purchases(spark, sf_dir), ["sym"], "d", ["top"], strict=True)
    return out.select("sym", F.col("d").cast("string").alias("d"), F.col("as_of_d").cast("string").alias("as_of_d"), rnd("top", 4).alias("top"))


@query(
    "neighbour_calendar_days", "J9 J10",
    S.with_bars(S.USER_DAY, "c AS (SELECT *, dense_rank() OVER (ORDER BY d) AS p FROM bars)")
    + f"SELECT c.sym, CAST(c.d AS VARCHAR) AS d, {r('a.close', 4)} AS prev_close, {r('z.close', 4)} AS next_close FROM c LEFT JOIN c a ON a.sym = c.sym AND a.p = c.p - 1 LEFT JOIN c z ON z.sym = c.sym AND z.p = c.p + 1",
)
def neighbour_calendar_days(spark, sf_dir):
    bars = SRC.bars_user_day(spark, sf_dir).select("sym", "d", "close")
    cal = SRC.calendar(bars)
    out = J.neighbour_day(J.neighbour_day(bars, cal, ["close"], -1, "prev_"), cal, ["close"], 1, "next_")
    return shown(out, {"prev_close": F.col("prev_close"), "next_close": F.col("next_close")}, 4)


@query(
    "index_aligned_returns", "J11 J28 J4",
    S.with_bars(S.BRAND_WEEK, S.adjusted(), f"ib AS ({S.index_of('PROMO')})", "ir AS (SELECT d, close / lag(close) OVER (ORDER BY d) - 1 AS ridx FROM ib)")
    + f"SELECT adj.sym, CAST(adj.d AS VARCHAR) AS d, {r('r')} AS ret, {r('ridx')} AS ridx, {r('r - ridx')} AS excess FROM adj LEFT JOIN ir ON ir.d = adj.d",
)
def index_aligned_returns(spark, sf_dir):
    from barloom.plans.factory import index_returns

    adj = SRC.adjust(SRC.bars_brand_week(spark, sf_dir))
    out = adj.join(F.broadcast(index_returns(SRC.index_bars(spark, sf_dir, "PROMO"))), "d", "left")
    return shown(out, {"ret": F.col("r"), "ridx": F.col("RIDX"), "excess": F.col("r") - F.col("RIDX")})


@query(
    "snapshot_at_event_keys", "J5 J27 J3 P22",
    S.with_bars(S.USER_DAY, S.adjusted(), "k AS (SELECT DISTINCT user_id AS sym, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'error')",
                f"f AS (SELECT *, {S.full('avg', 'r', 5)} AS m5 FROM adj)")
    + f"SELECT k.sym, CAST(k.d AS VARCHAR) AS d, {r('m5')} AS m5, {r('close', 4)} AS close FROM k LEFT JOIN f ON f.sym = k.sym AND f.d = k.d",
)
def snapshot_at_event_keys(spark, sf_dir):
    keys = SRC.table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("sym"), F.col("ts").cast("date").alias("d")).distinct()
    feats = SRC.adjust(SRC.bars_user_day(spark, sf_dir)).select("sym", "d", B.agg("mean", "r", 5).alias("m5"), "close")
    cut = feats.join(keys, ["sym", "d"], "left_semi")
    out = J.join_many_to_one(keys, cut, ["sym", "d"])
    return out.select("sym", F.col("d").cast("string").alias("d"), rnd("m5").alias("m5"), rnd("close", 4).alias("close"))


@query(
    "outer_join_of_two_sources", "J2 J1",
    """WITH a AS (SELECT user_id AS sym, CAST(ts AS DATE) AS d, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY 1, 2), b AS (SELECT user_id AS sym, CAST(ts AS DATE) AS d, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY 1, 2)
 SELECT sym, CAST(d AS VARCHAR) AS d, CAST(clicks AS DOUBLE) AS clicks, CAST(views AS DOUBLE) AS views FROM a FULL JOIN b USING (sym, d)""",
)
def outer_join_of_two_sources(spark, sf_dir):
    ev = SRC.table(spark, sf_dir, "events")

    def daily(kind, out):
        return ev.where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("sym"), F.col("ts").cast("date").alias("d")).agg(F.count(F.lit(1)).cast("double").alias(out))

    both = J.join_one_to_one(daily("click", "clicks"), daily("view", "views"), ["sym", "d"])
    return both.withColumn("d", F.col("d").cast("string"))


@query(
    "feature_sources_merged", "J19 J26 J18",
    S.with_bars(S.SUPP_MONTH, S.adjusted(), f"f AS (SELECT *, {S.full('avg', 'r', 5)} AS m5, {S.full('stddev_samp', 'r', 10)} AS s10 FROM adj)")
    + f"SELECT sym, CAST(d AS VARCHAR) AS d, {r('m5')} AS m5, {r('s10')} AS s10, {r('vol')} AS vol FROM f",
)
def feature_sources_merged(spark, sf_dir):
    # Read by the spine, by every source, by the key checks and by the check of repeated columns.
    adj = stored(SRC.adjust(SRC.bars_supp_month(spark, sf_dir)).select("sym", "d", "r", "vol"), "merged-bars")
    spine = adj.select("sym", "d")
    one = adj.select("sym", "d", B.agg("mean", "r", 5).alias("m5"))
    two = adj.select("sym", "d", B.agg("mean", "r", 5).alias("m5"), B.agg("std", "r", 10).alias("s10"))
    three = adj.select("sym", "d", "vol")
    out = J.merge_sources(spine, {"s1": one, "s2": two, "s3": three}, ["sym", "d"])
    return shown(out, {c: F.col(c) for c in ("m5", "s10", "vol")})


@query(
    "calendar_densified_bars", "J23",
    S.with_bars(S.USER_DAY, "c AS (SELECT DISTINCT d FROM bars)", "s AS (SELECT sym, min(d) AS lo, max(d) AS hi FROM bars GROUP BY 1)")
    + f"SELECT s.sym, CAST(c.d AS VARCHAR) AS d, {r('b.close', 4)} AS close FROM s JOIN c ON c.d BETWEEN lo AND hi LEFT JOIN bars b ON b.sym = s.sym AND b.d = c.d",
)
def calendar_densified_bars(spark, sf_dir):
    bars = SRC.bars_user_day(spark, sf_dir)
    return shown(J.densify(bars, SRC.calendar(bars)), {"close": F.col("close")}, 4)


@query(
    "pool_minus_events_same_day", "J17 U3",
    S.with_bars(S.USER_DAY) + "SELECT sym, CAST(d AS VARCHAR) AS d FROM bars b WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'purchase' AND e.user_id = b.sym AND CAST(e.ts AS DATE) = b.d)",
)
def pool_minus_events_same_day(spark, sf_dir):
    ev = SRC.table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("sym"), F.col("ts").cast("date").alias("d"))
    out = J.anti_same_day(SRC.bars_user_day(spark, sf_dir).select("sym", "d"), ev)
    return out.withColumn("d", F.col("d").cast("string"))


@query(
    "coverage_of_event_keys", "J21 G25",
    S.with_bars(S.USER_DAY, "k AS (SELECT DISTINCT user_id AS sym, CAST(ts AS DATE) + 1 AS d FROM events)")
    + "SELECT (SELECT count(*) FROM k) AS n_keys, (SELECT count(*) FROM k WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.sym = k.sym AND b.d = k.d)) AS uncovered",
)
def coverage_of_event_keys(spark, sf_dir):
    keys = SRC.table(spark, sf_dir, "events").select(F.col("user_id").alias("sym"), F.date_add(F.col("ts").cast("date"), 1).alias("d")).distinct()
    have = SRC.bars_user_day(spark, sf_dir).select("sym", "d", F.lit(1).alias("_h"))
    both = keys.join(have, ["sym", "d"], "left")
    return both.agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("_h").isNull()).alias("uncovered"))


@query(
    "tradability_flags", "P16 J10",
    S.with_bars(S.USER_DAY, STATUS_SQL, "c AS (SELECT *, dense_rank() OVER (ORDER BY d) AS p, lag(close) OVER (PARTITION BY sym ORDER BY d) AS pre FROM bars)",
                "mx AS (SELECT max(p) AS mp FROM c)", "j AS (SELECT c.sym, c.d, c.p, st.kind, z.open AS nopen, z.vol AS nvol, c.close * 1.1 AS lim FROM c ASOF LEFT JOIN st ON st.sym = c.sym AND c.d >= st.start LEFT JOIN c z ON z.sym = c.sym AND z.p = c.p + 1)")
    + """SELECT sym, CAST(d AS VARCHAR) AS d, CAST(coalesce(kind = 'error', false) AS BIGINT) AS f_st, CAST(coalesce(nopen >= lim - 0.01, false) AS BIGINT) AS f_limitup, CAST(nopen IS NULL OR nvol <= 0 OR nopen <= 0 AS BIGINT) AS f_suspend,
 CAST(coalesce(kind = 'error', false) OR coalesce(nopen >= lim - 0.01, false) OR nopen IS NULL OR nvol <= 0 OR nopen <= 0 AS BIGINT) AS f_any FROM j""",
)
def tradability_flags(spark, sf_dir):
    bars = SRC.bars_user_day(spark, sf_dir)
    out = tradability(bars, SRC.calendar(bars), status_intervals(spark, sf_dir).select("sym", F.col("start").alias("d"), "kind"))
    return out.select("sym", F.col("d").cast("string").alias("d"), *[F.col(f).cast("long").alias(f) for f in ("f_st", "f_limitup", "f_suspend", "f_any")])


def tradability(bars, calendar, names):
    """Flags on each row: special status as of the day, next calendar day opening at the limit, or not traded then."""
    named = J.as_of(bars, names, ["sym"], "d", ["kind"])
    ahead = J.neighbour_day(named, calendar, ["open", "vol"], 1, "next_")
    special = F.coalesce(F.col("kind") == "error", F.lit(False))
    locked = F.coalesce(F.col("next_open") >= F.col("close") * 1.1 - 0.01, F.lit(False))
    stopped = F.col("next_open").isNull() | (F.col("next_vol") <= 0) | (F.col("next_open") <= 0)
    return ahead.withColumns({"f_st": special, "f_limitup": locked, "f_suspend": stopped, "f_any": special | locked | stopped})


@query(
    "limits_at_event_dates", "S19",
    S.with_bars(S.SUPP_MONTH, S.adjusted(), "c AS (SELECT *, dense_rank() OVER (ORDER BY d) AS p FROM adj)", "lim AS (SELECT sym, d, pre_close * 1.1 AS up, pre_close * 0.9 AS down FROM c WHERE p % 17 <> 0)",
                "ev AS (SELECT sym, d FROM c WHERE pct > 150)")
    + f"SELECT ev.sym, CAST(ev.d AS VARCHAR) AS d, {r('up', 4)} AS up, {r('down', 4)} AS down FROM ev LEFT JOIN lim ON lim.sym = ev.sym AND lim.d = ev.d",
)
def limits_at_event_dates(spark, sf_dir):
    from barloom.plans.sources import limits_of

    adj = SRC.adjust(SRC.bars_supp_month(spark, sf_dir))
    events = adj.where("pct > 150").select("sym", "d")
    table = limits_of(adj, SRC.calendar(adj))
    # Only days and symbols of events are read from the limit table; a missing row means no constraint.
    table = table.join(events.select("d").distinct(), "d", "left_semi").join(events.select("sym").distinct(), "sym", "left_semi")
    out = events.join(table, ["sym", "d"], "left")
    return shown(out, {"up": F.col("up_limit"), "down": F.col("down_limit")}, 4)


@query(
    "limits_from_dated_table", "S4 S19",
    S.with_bars(S.SUPP_MONTH, S.adjusted(), "c AS (SELECT *, dense_rank() OVER (ORDER BY d) AS p FROM adj)", "lim AS (SELECT sym, d, pre_close * 1.1 AS up, pre_close * 0.9 AS down FROM c WHERE p % 17 <> 0)",
                "ev AS (SELECT sym, d FROM c WHERE pct > 150)")
    + f"SELECT ev.sym, CAST(ev.d AS VARCHAR) AS d, {r('up', 4)} AS up, {r('down', 4)} AS down FROM ev LEFT JOIN lim ON lim.sym = ev.sym AND lim.d = ev.d",
)
def limits_from_dated_table(spark, sf_dir):
    """Limits written by day, and read back for the days of the events only."""
    events, table = events_and_dated_limits(spark, sf_dir)
    out = events.join(T.rows_of_days(table, events), ["sym", "d"], "left")
    return shown(out, {"up": F.col("up_limit"), "down": F.col("down_limit")}, 4)


def events_and_dated_limits(spark, sf_dir):
    """(large moves, the limit table as a folder per day)."""
    from barloom.plans.sources import limits_of

    adj = stored(SRC.adjust(SRC.bars_supp_month(spark, sf_dir)), "dated-bars")
    folder = f"{ensure_checkpoint_dir(spark)}/limits-{uuid.uuid4().hex}"
    T.write_by_day(limits_of(adj, SRC.calendar(adj)), folder)
    return adj.where("pct > 150").select("sym", "d"), spark.read.parquet(folder)


@query(
    "labels_joined_by_key", "J25 J26 J18",
    """WITH d AS (SELECT doc_id, source, lang, n_chars FROM documents) SELECT source, count(*) AS docs, count(quality) AS labelled, CAST(sum(quality) AS DOUBLE) AS good, count(*) FILTER (WHERE quality IS NULL) AS unlabelled FROM d LEFT JOIN labels USING (doc_id) GROUP BY 1""",
)
def labels_joined_by_key(spark, sf_dir):
    docs = SRC.table(spark, sf_dir, "documents").select("doc_id", "source")
    out = J.join_many_to_one(docs, SRC.table(spark, sf_dir, "labels"), ["doc_id"])
    return out.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.count("quality").alias("labelled"), F.sum("quality").cast("double").alias("good"), F.count_if(F.col("quality").isNull()).alias("unlabelled")
    )


@query(
    "event_table_adapter", "P21",
    f"""WITH e AS (SELECT 'sig_' || event_id AS event_id, user_id AS sym, CAST(ts AS DATE) AS d, value AS score FROM events WHERE event_type = 'purchase' AND value > 0) SELECT event_id, sym, CAST(d AS VARCHAR) AS d, {r('score', 4)} AS score FROM e""",
)
def event_table_adapter(spark, sf_dir):
    raw = SRC.table(spark, sf_dir, "events").where("event_type = 'purchase' and value > 0")
    out = adapt_events(raw, {"event_id": F.concat(F.lit("sig_"), "event_id"), "sym": F.col("user_id"), "d": F.col("ts").cast("date"), "score": F.col("value")}, "score")
    return out.select("event_id", "sym", F.col("d").cast("string").alias("d"), rnd("score", 4).alias("score"))


def adapt_events(raw, columns, score: str):
    """Rename a foreign event table; raise unless scores are known and positive and ids unique (checked in one job each)."""
    out = raw.select(*[e.alias(n) for n, e in columns.items()])
    bad = out.where(F.col(score).isNull() | (F.col(score) <= 0))
    if not bad.isEmpty():
        raise ValueError("events with a missing or non-positive score")
    J.assert_unique(out, ["event_id"], "event table")
    return out


@query("densified_missing_share", "J23 S15", S.with_bars(S.BRAND_WEEK, "c AS (SELECT DISTINCT d FROM bars)", "s AS (SELECT sym, min(d) AS lo, max(d) AS hi FROM bars GROUP BY 1)")
       + f"SELECT s.sym, count(*) AS days, {r('avg(CASE WHEN b.close IS NULL THEN 1.0 ELSE 0.0 END)')} AS missing FROM s JOIN c ON c.d BETWEEN lo AND hi LEFT JOIN bars b ON b.sym = s.sym AND b.d = c.d GROUP BY 1")
def densified_missing_share(spark, sf_dir):
    bars = SRC.bars_brand_week(spark, sf_dir)
    out = J.densify(bars, SRC.calendar(bars))
    return out.groupBy("sym").agg(F.count(F.lit(1)).alias("days"), rnd(F.avg(F.col("close").isNull().cast("double"))).alias("missing"))
