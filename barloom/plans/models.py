"""Model step on the scored monthly panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.rolling import BARS as B
from barloom.functions.scalar import rnd
from barloom.operators import labels as L
from barloom.operators import model as K
from barloom.operators import sequential as Q
from barloom.operators import stats as G
from barloom.operators.cross_section import positions
from barloom.operators.joins import shuffled_join
from barloom.operators.tree_race import race_on_codes
from barloom.plans import sqltext as S
from barloom.plans.registry import query
from barloom.plans.sqltext import r
from barloom.plans.stats import SCORED_SQL, scored
from barloom.session import attach_row, cut_lineage, stored
from barloom.sources import bars as SRC

FEATURES = ("mom", "vol10", "amount", "vol", "prob")
QUICK = K.TreeParams(max_rounds=4, depth=2)


@query(
    "date_level_folds", "K1",
    SCORED_SQL + """, dd AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM sc)), f AS (SELECT d, CASE WHEN p < n - (n // 6) * 5 THEN 0 ELSE (p - (n - (n // 6) * 5)) // (n // 6) + 1 END AS fold FROM dd)
SELECT CAST(fold AS BIGINT) AS fold, count(*) AS n, CAST(min(sc.d) AS VARCHAR) AS first_d, CAST(max(sc.d) AS VARCHAR) AS last_d FROM sc JOIN f ON f.d = sc.d GROUP BY 1""",
)
def date_level_folds(spark, sf_dir):
    folded = K.date_folds(scored(spark, sf_dir).select("sym", "d"))
    return folded.groupBy(F.col("fold").cast("long").alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), F.min("d").cast("string").alias("first_d"), F.max("d").cast("string").alias("last_d")
    )


def train_and_val(spark, sf_dir):
    df = cut_lineage(scored(spark, sf_dir).where("lab is not null"))
    return df.where("seg = 'train'"), df.where("seg <> 'train'")


@query("out_of_fold_calibrated_metrics", "K2 K3 K4 K6 K7 K5")
def out_of_fold_calibrated_metrics(spark, sf_dir):
    """Metric rows per segment of one label and one setting: folds, calibration, final fit, scoring."""
    train, later = train_and_val(spark, sf_dir)
    metrics, _, _ = K.run_config(train, later.where("seg = 'val'"), FEATURES, "lab", QUICK, 5, ["sym"])
    return metrics.select("seg", "n", rnd("base_rate").alias("base_rate"), rnd("ap").alias("ap"), rnd("precision_day").alias("precision_day"))


@query("label_race_two_labels", "K5 T4 T5")
def label_race_two_labels(spark, sf_dir):
    """Two labels in one setting raced on validation precision, with the winner marked."""
    train, later = train_and_val(spark, sf_dir)
    gain = lambda df: df.withColumn("lab2", (F.col("fwd") > 0.1).cast("double"))
    rows = K.race(gain(train), gain(later.where("seg = 'val'")), FEATURES, ("lab", "lab2"), (QUICK,), 2, ["sym"]).where("seg = 'val'")
    from barloom.operators.cross_section import group_quantiles

    rows = cut_lineage(rows)
    mid = group_quantiles(rows, [], "ap", {"mid": 0.5})
    best = rows.orderBy(F.desc("precision_day"), F.desc("ap"), "candidate").limit(1).select(F.col("candidate").alias("_best"))
    out = attach_row(attach_row(rows, mid), best)
    return out.select(
        "candidate", rnd("precision_day").alias("precision_day"), rnd("ap").alias("ap"), ((F.col("candidate") == F.col("_best")) & (F.col("ap") >= F.col("mid"))).cast("long").alias("winner")
    )


RACE_GAINS = {"lab": 0.0, "gain5": 0.05, "gain10": 0.1}
# Leaves (2 ** depth for 15, 31, 63), rows of a leaf, step, share of the features; rounds end by the validation error.
RACE_ROUNDS = 1000
RACE_GRID = tuple(
    K.TreeParams(max_rounds=RACE_ROUNDS, depth=depth, step=step, min_rows=rows, share=share)
    for depth in (4, 5, 6) for rows in (50, 100, 200) for step in (0.05, 0.1) for share in (0.6, 0.8)
)


# The labels raced: a sniper hit, the signs of two families of returns over nine horizons, three gains of the scored panel.
RACE_LABELS = ("hit_n20_k2", *[f"{family}_h{h}" for family in ("cur", "open_exec") for h in L.HORIZONS], *RACE_GAINS)


@query("label_race_grid", "K5 K2 T4 T5")
def label_race_grid(spark, sf_dir):
    """Every label in every setting of the grid over five folds, all from one table of binned features, ranked on validation.

    A label without a known value in validation has no metrics and comes last.
    """
    panel = scored(spark, sf_dir)  # stored by ``scored``
    bars = Q.add_recursions(SRC.adjust(SRC.bars_supp_month(spark, sf_dir)), [Q.atr("high", "low", "close", 14, "atr14")])
    signs = {"hit_n20_k2": L.sniper_hit(20, 2.0)} | L.sign_labels()
    later = bars.select("sym", "d", *[c.alias(n) for n, c in signs.items()])
    gains = [F.when(F.col("fwd").isNotNull(), (F.col("fwd") > level).cast("double")).alias(name) for name, level in RACE_GAINS.items()]
    labelled = stored(shuffled_join(panel.select("sym", "d", "seg", *FEATURES, *gains), later, ["sym", "d"]), "race-labels")
    binned, val = K.shared_bins(labelled.where("seg = 'train'"), [labelled.where("seg = 'val'")], FEATURES)
    rows = cut_lineage(race_on_codes(binned, val, FEATURES, list(RACE_LABELS), RACE_GRID, 5, ["sym"], segments=["val"]))
    entered = spark.createDataFrame([(y, i) for y in RACE_LABELS for i in range(len(RACE_GRID))], "candidate string, config_id int")
    rows = entered.join(rows, ["candidate", "config_id"], "left")
    place = F.row_number().over(Window.orderBy(F.desc("precision_day"), F.desc("ap"), "candidate", "config_id"))  # one row per candidate
    return rows.select("candidate", F.col("config_id").cast("long").alias("config_id"), rnd("precision_day").alias("precision_day"), rnd("ap").alias("ap"), place.cast("long").alias("place"))


@query("importance_and_elbow", "G18 G19 K3")
def importance_and_elbow(spark, sf_dir):
    """Features with positive importance in rank order, and the elbow of cumulative importance."""
    train, _ = train_and_val(spark, sf_dir)
    model = K.fit_trees(train, FEATURES, "lab", K.TreeParams(max_rounds=5, depth=3))
    ranked = K.importance_ranking(model, FEATURES)
    total, points = 0.0, []
    for place, _, weight in ranked:
        total += weight
        points.append((place, total))
    k = G.elbow(points)
    return spark.createDataFrame([(p, f, round(w, 6), p <= k) for p, f, w in ranked], "place long, feature string, importance double, kept boolean")


@query("logistic_recognizer", "K8")
def logistic_recognizer(spark, sf_dir):
    """Accepted share and hit rate per segment of a standardised logistic recogniser fitted on train."""
    train, later = train_and_val(spark, sf_dir)
    model = K.fit_recognizer(train, FEATURES, "lab")
    scored_rows = K.scores(model, train.unionByName(later), "p")
    accepted = F.col("p") >= 0.5
    return scored_rows.groupBy("seg").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg(accepted.cast("double"))).alias("accepted"), rnd(F.avg(F.when(accepted, F.col("lab")))).alias("hit")
    )


@query(
    "median_threshold_rule", "K9",
    SCORED_SQL + f""", t AS (SELECT median(mom) AS theta FROM sc WHERE seg = 'train' AND lab = 1 AND mom IS NOT NULL) SELECT seg, {r('any_value(theta)')} AS theta, count(*) AS n, {r('avg(CASE WHEN mom <= theta THEN 1.0 ELSE 0.0 END)')} AS accepted, {r('avg(CASE WHEN mom <= theta THEN lab END)')} AS hit FROM sc, t WHERE lab IS NOT NULL AND mom IS NOT NULL GROUP BY seg""",
)
def median_threshold_rule(spark, sf_dir):
    df = scored(spark, sf_dir)
    theta = K.median_threshold(df.where("seg = 'train'"), "mom", "lab")
    both = attach_row(df.where("lab is not null and mom is not null"), theta)
    ok = F.col("mom") <= F.col("theta")
    return both.groupBy("seg").agg(rnd(F.first("theta")).alias("theta"), F.count(F.lit(1)).alias("n"), rnd(F.avg(ok.cast("double"))).alias("accepted"), rnd(F.avg(F.when(ok, F.col("lab")))).alias("hit"))




def many_features(spark, sf_dir):
    """The scored panel with windows of the monthly bars, twelve features in all."""
    adj = SRC.adjust(SRC.bars_supp_month(spark, sf_dir))
    windows = {f"move{n}": B.pct_change("cf", n) for n in (1, 2, 3, 8)} | {f"calm{n}": B.agg("std", "r", n) for n in (4, 6)} | {"drift6": B.agg("mean", "r", 6)}
    wide = adj.select("sym", "d", *[c.alias(n) for n, c in windows.items()])
    return cut_lineage(scored(spark, sf_dir).where("lab is not null").join(wide, ["sym", "d"])), [*FEATURES, *windows]


@query("refit_ladder", "G18 G19 K3")
def refit_ladder(spark, sf_dir):
    """Models of the first 5, 10 and 12 features by importance, their daily precision on validation, and the elbow."""
    df, names = many_features(spark, sf_dir)
    train, val = df.where("seg = 'train'"), df.where("seg = 'val'")
    found = [f for _, f, _ in K.importance_ranking(K.fit_trees(train, names, "lab", K.TreeParams(max_rounds=5, depth=3)), names)]
    ranked = [*found, *[n for n in names if n not in found]]
    curve = K.with_elbow(K.refit_ladder(train, val, ranked, "lab", QUICK, ["sym"]))
    return curve.select("k", rnd("precision").alias("precision"), rnd("distance").alias("distance"), F.col("chosen").cast("long").alias("chosen"))


@query(
    "elbow_of_turnover_share", "G19 A16",
    S.with_bars(S.SUPP_MONTH).rstrip() + f""", a AS (SELECT sym, sum(amount) AS s FROM bars GROUP BY 1), o AS (SELECT row_number() OVER (ORDER BY s DESC, sym) AS k, sum(s) OVER (ORDER BY s DESC, sym ROWS UNBOUNDED PRECEDING) / sum(s) OVER () AS share FROM a),
n AS (SELECT max(k) AS n FROM o), c AS (SELECT k, share FROM o, n WHERE k IN {K.LADDER} OR k = n), e AS (SELECT arg_min(share, k) AS y0, arg_max(share, k) AS y1, log2(min(k)) AS x0, log2(max(k)) AS x1 FROM c),
d AS (SELECT k, share, abs((x1 - x0) * (share - y0) - (y1 - y0) * (log2(k) - x0)) / sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS distance FROM c, e)
SELECT k, {r('share')} AS share, {r('distance')} AS distance, CAST(k = (SELECT min(k) FROM d WHERE distance >= (SELECT max(distance) FROM d) - 1e-12) AS BIGINT) AS chosen FROM d""",
)
def elbow_of_turnover_share(spark, sf_dir):
    """The share of all turnover that the k largest symbols hold, at the sizes of the ladder, and its elbow."""
    sums = SRC.bars_supp_month(spark, sf_dir).groupBy("sym").agg(F.sum("amount").alias("s"))
    placed = cut_lineage(positions(sums.withColumns({"minus": -F.col("s"), "all": F.lit(1)}), ["all"], ["minus", "sym"], "k"))
    sizes = K.ladder_sizes(placed.agg(F.max("k_n")).first()[0])
    ladder = spark.createDataFrame([(k,) for k in sizes], "size int")
    # Each symbol counts towards the ladder sizes at or above its place: a lookup of at most one row per size.
    reach = placed.withColumn("size", F.explode(F.filter(F.lit(sizes), lambda x: x >= F.col("k"))))
    held = reach.groupBy("size").agg(F.sum("s").alias("held")).join(ladder, "size")
    curve = attach_row(held, sums.agg(F.sum("s").alias("total"))).select(F.col("size").cast("long").alias("k"), (F.col("held") / F.col("total")).alias("share"))
    out = K.with_elbow(curve, "k", "share")
    return out.select("k", rnd("share").alias("share"), rnd("distance").alias("distance"), F.col("chosen").cast("long").alias("chosen"))
