"""Stability of the detectors: under perturbed settings, and under truncation of the history at many days."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.features import market as MK
from barloom.functions.scalar import rnd
from barloom.operators import configured as K
from barloom.operators import events as E
from barloom.operators import sequential as Q
from barloom.plans import sqltext as S
from barloom.plans.events import BACKUP_SQL, BASE, MAIN_SQL, divergence_sql
from barloom.plans.market import REGIME_SQL
from barloom.plans.registry import query
from barloom.plans.sequential import FRACTAL_SQL, ZIGZAG_SQL, macd_bars, spaced_sql
from barloom.plans.sqltext import r
from barloom.session import stored
from barloom.sources import bars as SRC

# One setting at a time moved by a fifth, rounded, for weekly bars.
BASE_MAIN = {"method": "fractal", "order": 5, "pct": None, "min_sep": 10, "regime_window": 60}
BASE_BACKUP = {"method": "zigzag", "order": None, "pct": 0.05, "min_sep": 5, "regime_window": None}
PERTURBED = {
    "main": (
        BASE_MAIN,
        {"order_4": {"order": 4}, "order_6": {"order": 6}, "min_sep_8": {"min_sep": 8}, "min_sep_12": {"min_sep": 12}, "regime_48": {"regime_window": 48}, "regime_72": {"regime_window": 72}},
    ),
    "backup": (BASE_BACKUP, {"pct_004": {"pct": 0.04}, "pct_006": {"pct": 0.06}, "min_sep_4": {"min_sep": 4}, "min_sep_6": {"min_sep": 6}}),
}


def settings_rows():
    """Every configuration as a row of ``configured.SETTINGS``."""
    rows = []
    for pool, (base, changes) in PERTURBED.items():
        for name, change in {"base": {}, **changes}.items():
            own = base | change
            rows.append((pool, name, own["method"], own["order"], own["pct"], own["min_sep"], own["regime_window"], 0.001, 2))
    return rows


def configured_sql(wanted: float = 1.0) -> tuple[str, ...]:
    """CTE ``cev`` (pool, config, sym, sig_pos, low_pos, ...) with one chain of CTEs per configuration."""
    ctes, parts = [], []
    for i, (pool, name, method, order, pct, sep, window, _, _) in enumerate(settings_rows()):
        if method == "fractal":
            ctes.append(FRACTAL_SQL.replace("fl AS", f"lo{i} AS").replace("pos + 3", f"pos + {order}").replace("3 PRECEDING", f"{order} PRECEDING").replace("3 FOLLOWING", f"{order} FOLLOWING").replace("na = 3 AND nb = 3", f"na = {order} AND nb = {order}"))
        else:
            ctes.append(ZIGZAG_SQL.replace("zz AS", f"zz{i} AS").replace("FROM zz JOIN", f"FROM zz{i} zz JOIN").replace("PCT", str(pct)))
            ctes.append(f"lo{i} AS (SELECT sym, found AS low_pos, pos AS sig_pos FROM zz{i} WHERE found IS NOT NULL)")
        ctes += [spaced_sql(f"lo{i}", sep, f"sp{i}"), divergence_sql(f"sp{i}", f"cv{i}x")]
        regime = ""
        if window is not None:
            ctes.append(REGIME_SQL.replace("rg0", f"ra{i}").replace("rg1", f"rb{i}").replace("rg AS", f"rg{i} AS").replace("ix, 60", f"ix, {window}"))
            regime = f" JOIN rg{i} ON rg{i}.d = mc.d AND rg{i}.regime = {wanted}"
        parts.append(f"SELECT '{pool}' AS pool, '{name}' AS config, e.*, mc.d FROM cv{i}x e JOIN mc ON mc.sym = e.sym AND mc.pos = e.sig_pos{regime}")
    return (*ctes, f"cev AS ({' UNION ALL '.join(parts)})")


def configured_events(spark, sf_dir, wanted: float = 1.0):
    """Events of all configurations, those with a regime window only in the wanted phase of the market."""
    panel = macd_bars(spark, sf_dir)
    settings = spark.createDataFrame(settings_rows(), K.SETTINGS)
    returns = stored(MK.market_returns(panel), "market-returns")
    phases = None
    for window in K.distinct_values(settings, "regime_window"):
        one = MK.regime(returns, window).select(F.lit(window).alias("regime_window"), "d", "regime")
        phases = one if phases is None else phases.unionByName(one)
    events = K.configured_divergences(panel, K.configured_lows(panel, settings))
    days = panel.select("sym", F.col("pos").cast("long").alias("sig_pos"), "d")
    return stored(K.in_wanted_phase(events, days, phases, wanted), "configured-events")


@query(
    "configured_events", "UF7 E6 G20",
    S.with_bars(*BASE, *configured_sql()) + "SELECT pool, config, sym, CAST(d AS VARCHAR) AS d, CAST(sig_pos AS BIGINT) AS sig_pos, CAST(low_pos AS BIGINT) AS low_pos, CAST(prev_pos AS BIGINT) AS prev_pos, CAST(rank AS BIGINT) AS rank FROM cev",
)
def configured_event_rows(spark, sf_dir):
    """Two pools in twelve configurations from one table of settings."""
    return configured_events(spark, sf_dir).select("pool", "config", "sym", F.col("d").cast("string").alias("d"), "sig_pos", "low_pos", "prev_pos", "rank")


def recall_sql(key: str) -> str:
    return f"""k_{key} AS (SELECT DISTINCT pool, config, sym, {key} AS p FROM cev), base_{key} AS (SELECT pool, sym, p FROM k_{key} WHERE config = 'base'),
n_{key} AS (SELECT pool, count(*) AS n_base FROM base_{key} GROUP BY 1)"""


@query(
    "perturbed_recalls", "G20 J22 UF7",
    S.with_bars(*BASE, *configured_sql(), recall_sql("sig_pos"), recall_sql("low_pos"))
    + " UNION ALL ".join(
        f"""SELECT '{basis}' AS basis, k.pool, config, any_value(n_base) AS n_base, count(*) AS n_other, count(b.p) AS n_both, {r('count(b.p) / any_value(n_base)')} AS recall_base, {r('count(b.p) / count(*)')} AS recall_other
 FROM k_{key} k JOIN n_{key} n ON n.pool = k.pool LEFT JOIN base_{key} b ON b.pool = k.pool AND b.sym = k.sym AND b.p = k.p WHERE config <> 'base' GROUP BY k.pool, config"""
        for basis, key in (("signal", "sig_pos"), ("low", "low_pos"))
    ),
)
def perturbed_recalls(spark, sf_dir):
    """Each of ten perturbations against its pool's base setting, by signal row and by low."""
    events = configured_events(spark, sf_dir)
    out = None
    for basis, key in (("signal", "sig_pos"), ("low", "low_pos")):
        one = K.recalls(events, "base", ["sym", key]).withColumn("basis", F.lit(basis))
        out = one if out is None else out.unionByName(one)
    return out.select("basis", "pool", "config", "n_base", "n_other", "n_both", rnd("recall_base").alias("recall_base"), rnd("recall_other").alias("recall_other"))


# ---------------------------------------------------------------- truncation at many days
N_CUTS = 138
CUTS_SQL = f"""cal AS (SELECT d, row_number() OVER (ORDER BY d) AS p, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM bars)),
ct0 AS (SELECT ceil(p * {N_CUTS} / n) AS e, max(d) AS cut_d FROM cal GROUP BY 1), ct AS (SELECT row_number() OVER (ORDER BY cut_d) AS cut, cut_d, lag(cut_d) OVER (ORDER BY cut_d) AS after_d FROM ct0)"""
KNOWN = ["sig_pos", "low_pos", "prev_pos", "rank", "formation"]


@query(
    "truncation_equality", "G23 E26 J22 J7",
    S.with_bars(*MAIN_SQL, *BACKUP_SQL, CUTS_SQL)
    + " UNION ALL ".join(
        f"""SELECT '{pool}' AS pool, CAST(cut AS BIGINT) AS cut, CAST(cut_d AS VARCHAR) AS cut_d, count(e.sym) AS n_whole, count(e.sym) AS n_prefix, count(e.sym) AS n_both
 FROM ct LEFT JOIN (SELECT v.sym, mc.d FROM {pool}_ev v JOIN mc ON mc.sym = v.sym AND mc.pos = v.sig_pos) e ON e.d <= cut_d AND (after_d IS NULL OR e.d > after_d) GROUP BY cut, cut_d"""
        for pool in ("main", "backup")
    ),
)
def truncation_equality(spark, sf_dir):
    """Both pools on every prefix of the history that ends at one of 138 days, all prefixes in one run: the events of a
    window are the same with and without the rows after it, by count and row by row."""
    bars = SRC.adjust(SRC.bars_brand_week(spark, sf_dir)).select("sym", "d", "pos", "close", "vol")
    bars = stored(bars, "truncation-bars")
    cuts = stored(K.cut_days(SRC.calendar(bars), N_CUTS), "cuts")

    def detect(lows):
        def run(rows):
            panel = stored(Q.add_recursions(rows.select("sym", "d", "pos", "close", "vol"), [Q.macd("close")]), "replayed")
            return E.divergences(panel, lows(panel), E.DivergenceRule())

        return run

    out = None
    for pool, lows in (("main", lambda p: E.fractal_lows(p, "close", 3)), ("backup", lambda p: Q.zigzag_lows(p, "close", 0.05))):
        one = K.truncation_test(bars, cuts, detect(lows), KNOWN).withColumn("pool", F.lit(pool))
        out = one if out is None else out.unionByName(one)
    return out.select("pool", F.col("cut").cast("long").alias("cut"), F.col("cut_d").cast("string").alias("cut_d"), "n_whole", "n_prefix", "n_both")
