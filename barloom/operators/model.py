"""Model step on Spark ML: date folds, out-of-fold scores, calibration, races, score tables.

Trees stand in for the boosted trees of the original workflow; numbers differ, the fold discipline, key alignment,
determinism and output columns are what this module keeps.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, QuantileDiscretizer, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import col
from barloom.operators.stats import precision_at_k, segment_metrics
from barloom.session import attach_row, cut_lineage, stored


#: Fits that run at the same time; each is a job of its own over the same stored vectors.
FITS_AT_ONCE = 4


@dataclass(frozen=True)
class TreeParams:
    max_rounds: int = 20
    depth: int = 3
    step: float = 0.1
    seed: int = 42
    #: Rows that both sides of a split have at least, and the share of the features that is drawn for splits.
    min_rows: int = 1
    share: float = 1.0


def date_folds(df: DataFrame, n_splits: int = 5, day: str = "d", out: str = "fold") -> DataFrame:
    """Expanding date blocks: block 0 is never validated, block k validates a model of all earlier blocks.

    Borders lie on days. The last ``n_splits`` blocks have floor(days / (n_splits + 1)) days each. The day table is
    one row per day.
    """
    days = df.select(day).distinct().withColumn("_p", F.row_number().over(Window.orderBy(day)) - 1)
    days = attach_row(days, days.agg(F.count(F.lit(1)).alias("_n")))
    size = F.floor(F.col("_n") / (n_splits + 1))
    first = F.col("_n") - size * n_splits
    fold = F.when(F.col("_p") < first, 0).otherwise(F.floor((F.col("_p") - first) / size) + 1)
    return df.join(F.broadcast(days.select(day, fold.cast("int").alias(out))), day)


def _stages(features: Sequence[str]) -> list:
    filled = [f"_f_{f}" for f in features]
    return [
        Imputer(inputCols=list(features), outputCols=filled, strategy="mean"),
        VectorAssembler(inputCols=filled, outputCol="_features", handleInvalid="keep"),
    ]


def fit_trees(train: DataFrame, features: Sequence[str], label: str, params: TreeParams, validation: str | None = None) -> PipelineModel:
    """Boosted trees on mean-imputed features. With a boolean ``validation`` column rounds stop early on those rows."""
    gbt = GBTClassifier(
        featuresCol="_features", labelCol=label, maxIter=params.max_rounds, maxDepth=params.depth, stepSize=params.step, seed=params.seed,
        predictionCol="_pred", validationTol=0.001, minInstancesPerNode=params.min_rows, featureSubsetStrategy="all" if params.share >= 1.0 else str(params.share),
    )
    gbt = gbt.setProbabilityCol("_prob").setRawPredictionCol("_raw")
    if validation is not None:
        gbt = gbt.setValidationIndicatorCol(validation)
    return Pipeline(stages=[*_stages(features), gbt]).fit(train)


def scores(model: PipelineModel, df: DataFrame, out: str = "raw_prob") -> DataFrame:
    """Probability of class 1 as a plain double column; the frame keeps its own columns."""
    scored = model.transform(df)
    return scored.select(*df.columns, F.get(vector_to_array("_prob"), F.lit(1)).alias(out))


def rounds_of(model: PipelineModel) -> int:
    return model.stages[-1].getNumTrees


def out_of_fold(df: DataFrame, features: Sequence[str], label: str, n_splits: int, params: TreeParams, day: str = "d") -> tuple[DataFrame, list[int]]:
    """(rows with out-of-fold ``oof``, NULL in block 0; rounds chosen per fold). Rows are only ever scored by
    models of earlier days."""
    folded = cut_lineage(date_folds(df.where(col(label).isNotNull()), n_splits, day))
    out = folded.where("fold = 0").withColumn("oof", F.lit(None).cast("double"))
    best = []
    for k in range(1, n_splits + 1):
        seen = folded.where(F.col("fold") <= k).withColumn("_val", F.col("fold") == k)
        model = fit_trees(seen, features, label, params, "_val")
        best.append(rounds_of(model))
        out = out.unionByName(scores(model, folded.where(F.col("fold") == k), "oof"))
    return out, best


def final_rounds(best: Sequence[int]) -> int:
    return max(int(round(sum(best) / len(best))), 1)


@dataclass(frozen=True)
class SquaredLogit:
    """Logistic calibration on p and p*p; scoring is a plain column expression."""

    coef: tuple[float, float]
    intercept: float

    @classmethod
    def fit(cls, df: DataFrame, prob: str, label: str, c: float = 1.0, max_iter: int = 1000, weight: str | None = None) -> "SquaredLogit":
        """Rows count by score and label: one row per pair of these is fitted. With ``weight`` rows are such pairs already."""
        known = df.where(col(prob).isNotNull() & col(label).isNotNull()).select(col(prob).alias("_p"), col(label).cast("double").alias("_y"), (col(weight) if weight else F.lit(1)).cast("double").alias("_w"))
        if weight is None:
            known = cut_lineage(known.groupBy("_p", "_y").agg(F.sum("_w").alias("_w")))
        if not known.where(F.isnan("_p") | ~F.col("_p").between(0.0, 1.0)).isEmpty():
            raise ValueError("calibration needs finite probabilities in [0, 1]")
        design = VectorAssembler(inputCols=["_p", "_pp"], outputCol="_x").transform(known.withColumn("_pp", F.col("_p") * F.col("_p")))
        n = known.agg(F.sum("_w")).first()[0]
        # Same penalty as a summed loss with strength 1/c on unscaled columns.
        lr = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1.0 / (c * n), standardization=False, maxIter=max_iter)
        m = lr.fit(design)
        return cls((float(m.coefficients[0]), float(m.coefficients[1])), float(m.intercept))

    @classmethod
    def fit_groups(cls, counts: DataFrame, group: str, prob: str, n: str, pos: str, groups: int, c: float = 1.0, max_iter: int = 100) -> list["SquaredLogit"]:
        """The calibrations of the groups 0, 1, ... from rows and positive ones per (group, score): the optimum that ``fit`` looks
        for, by Newton steps of all groups together. Each is one pass that adds up slopes and curvatures per group."""
        spark, p = counts.sparkSession, col(prob)
        counts = counts.select(col(group).alias("_g"), p.alias("_p"), col(n).cast("double").alias("_n"), col(pos).cast("double").alias("_k"))
        seen = {r["_g"]: r for r in counts.groupBy("_g").agg(F.sum("_n").alias("n"), F.sum("_k").alias("k"), F.max(F.isnan("_p") | ~F.col("_p").between(0.0, 1.0)).alias("bad")).collect()}
        if any(r["bad"] for r in seen.values()):
            raise ValueError("calibration needs finite probabilities in [0, 1]")
        if len(seen) < groups:
            raise ValueError("a group has no row to calibrate on")
        # One class only: its probability is 1, as with ``fit``.
        out = {g: cls((0.0, 0.0), float("inf") if r["k"] else float("-inf")) for g, r in seen.items() if r["k"] in (0, r["n"])}
        at = {g: np.array([np.log(r["k"] / (r["n"] - r["k"])), 0.0, 0.0]) for g, r in seen.items() if g not in out}  # intercept, p, p * p
        before: dict[int, tuple[np.ndarray, float]] = {}
        ridge = np.array([0.0, 1.0 / c, 1.0 / c])
        z = F.col("_b0") + F.col("_b1") * F.col("_p") + F.col("_b2") * F.col("_p") * F.col("_p")
        q, square = 1.0 / (1.0 + F.exp(-F.col("_z"))), F.col("_n") * F.col("_q") * (1.0 - F.col("_q"))
        loss = F.col("_n") * (F.log1p(F.exp(-F.abs("_z"))) + F.greatest(F.col("_z"), F.lit(0.0))) - F.col("_k") * F.col("_z")
        sums = [F.sum(loss).alias("loss")]
        sums += [F.sum((F.col("_n") * F.col("_q") - F.col("_k")) * F.col("_p") ** i).alias(f"g{i}") for i in range(3)]
        sums += [F.sum(square * F.col("_p") ** i).alias(f"h{i}") for i in range(5)]
        for _ in range(max_iter):
            if not at:
                break
            here = spark.createDataFrame([(g, *map(float, b)) for g, b in sorted(at.items())], "_g int, _b0 double, _b1 double, _b2 double")
            rows = counts.join(F.broadcast(here), "_g").withColumn("_z", z).withColumn("_q", q).groupBy("_g").agg(*sums).collect()
            for r in rows:
                g, b = r["_g"], at[r["_g"]]
                value = r["loss"] + 0.5 * float(ridge @ b**2)
                if g in before and value > before[g][1] + 1e-9 * abs(before[g][1]):  # too far: half the way back
                    at[g] = (before[g][0] + b) / 2.0
                    continue
                slope = np.array([r["g0"], r["g1"], r["g2"]]) + ridge * b
                curve = np.array([[r[f"h{i + j}"] for j in range(3)] for i in range(3)]) + np.diag(ridge + 1e-12)
                step = np.linalg.solve(curve, slope)
                before[g], at[g] = (b, value), b - step
                if np.abs(step).max() <= 1e-9 * (1.0 + np.abs(b).max()):
                    done = np.round(at.pop(g), 12)
                    out[g] = cls((float(done[1]), float(done[2])), float(done[0]))
        if at:
            raise ValueError(f"{len(at)} calibrations have not settled after {max_iter} steps")
        return [out[g] for g in range(groups)]

    def of(self, p: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(-(self.intercept + self.coef[0] * p + self.coef[1] * p * p)))

    def column(self, prob: Column | str) -> Column:
        p = col(prob)
        return 1.0 / (1.0 + F.exp(-(self.intercept + self.coef[0] * p + self.coef[1] * p * p)))


def score_table(
    train_oof: DataFrame, later: DataFrame, model: PipelineModel, calibrator: SquaredLogit, label: str, keys: Sequence[str], seg: str = "seg"
) -> DataFrame:
    """keys, seg, prob, y: calibrated out-of-fold scores on train, final-model scores later, no label on test."""
    train = train_oof.select(*keys, seg, calibrator.column("oof").alias("prob"), col(label).alias("y"))
    after = scores(model, later).select(*keys, seg, calibrator.column("raw_prob").alias("prob"), F.when(col(seg) != "test", col(label)).alias("y"))
    return train.unionByName(after)


def run_config(train: DataFrame, val: DataFrame, features: Sequence[str], label: str, params: TreeParams, n_splits: int, tie: Sequence[str], k: int = 5) -> tuple[DataFrame, SquaredLogit, PipelineModel]:
    """One label and one setting: folds, calibration, final fit; metric rows of train (out of fold) and val."""
    oof, best = out_of_fold(train, features, label, n_splits, params)
    oof = cut_lineage(oof)
    calibrator = SquaredLogit.fit(oof, "oof", label)
    final = fit_trees(train.where(col(label).isNotNull()), features, label, replace(params, max_rounds=final_rounds(best)))
    tables = score_table(oof, val, final, calibrator, label, [*tie, "d"])
    metrics = segment_metrics(tables.where("prob is not null"), "prob", "y", "seg", k, tie)
    return metrics, calibrator, final


def shared_bins(train: DataFrame, others: Sequence[DataFrame], features: Sequence[str], bins: int = 32) -> list[DataFrame]:
    """``train`` and ``others`` with every feature cut into quantile bins of ``train``, stored once for all fits; missing values
    are a bin of their own."""
    names = [f"_b_{f}" for f in features]
    cut = QuantileDiscretizer(numBuckets=bins, inputCols=list(features), outputCols=names, handleInvalid="keep", relativeError=0.0005).fit(train)
    out = []
    for df in (train, *others):
        binned = cut.transform(df)
        rest = [c for c in df.columns if c not in features]
        out.append(stored(binned.select(*rest, *[F.col(n).alias(f) for n, f in zip(names, features)]), "binned"))
    return out


def race(train: DataFrame, val: DataFrame, features: Sequence[str], labels: Sequence[str], grid: Sequence[TreeParams], n_splits: int, tie: Sequence[str]) -> DataFrame:
    """Metric rows of every label and setting, tagged; pick winners with the ranking operators.

    Candidates don't depend on one another: ``FITS_AT_ONCE`` of them run at a time, each as jobs of its own.
    """

    def one(candidate: tuple[str, int]) -> DataFrame:
        label, i = candidate
        metrics, calibrator, _ = run_config(train, val, features, label, grid[i], n_splits, tie)
        return metrics.select(
            F.lit(label).alias("candidate"), F.lit(i).alias("config_id"), "*", F.lit(calibrator.coef[0]).alias("calib_p"), F.lit(calibrator.coef[1]).alias("calib_p2")
        )

    with ThreadPool(FITS_AT_ONCE) as pool:
        rows = pool.map(one, [(label, i) for label in labels for i in range(len(grid))])
    return reduce(DataFrame.unionByName, rows)


def importance_ranking(model: PipelineModel, features: Sequence[str]) -> list[tuple[int, str, float]]:
    """(rank, feature, importance) of features with positive importance; names break ties."""
    weights = model.stages[-1].featureImportances.toArray()
    ordered = sorted(((-float(w), f) for f, w in zip(features, weights) if w > 0))
    return [(i + 1, f, -w) for i, (w, f) in enumerate(ordered)]


def fit_recognizer(train: DataFrame, features: Sequence[str], label: str) -> PipelineModel:
    """Standardised logistic regression, mean and spread taken from the training rows."""
    stages = [
        *_stages(features), StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True, withStd=True),
        LogisticRegression(featuresCol="_scaled", labelCol=label, predictionCol="_pred", probabilityCol="_prob", rawPredictionCol="_raw", regParam=0.001),
    ]
    return Pipeline(stages=stages).fit(train)


def median_threshold(train: DataFrame, feature: str, label: str) -> DataFrame:
    """One row ``theta``: median of a feature over the positive training rows; accept values at or below it."""
    from barloom.operators.cross_section import group_quantiles

    return group_quantiles(train.where((col(label) == 1) & col(feature).isNotNull()), [], feature, {"theta": 0.5})


# ---------------------------------------------------------------- ladder of refits
# Sizes tried of a ranked feature list, and the fewest features a ladder starts with.
LADDER = (5, 10, 15, 20, 25, 30, 40, 50, 75, 100, 150, 200, 300, 500, 750, 1000, 1500)
FEWEST = 5


def ladder_sizes(n: int) -> list[int]:
    """The sizes of the ladder up to ``n`` features, and ``n`` itself."""
    if n < FEWEST:
        raise ValueError(f"{n} features are too few for a ladder")
    return sorted({k for k in LADDER if k <= n} | {n})


def refit_ladder(train: DataFrame, val: DataFrame, ranked: Sequence[str], label: str, params: TreeParams, tie: Sequence[str], top: int = 5) -> DataFrame:
    """(k, precision): a model of the first ``k`` ranked features for every size, scored by the mean daily precision on ``val``.

    Missing values are filled and features put into one vector once; every size slices the same stored vectors.
    """
    filled = Pipeline(stages=_stages(ranked)).fit(train)
    columns = [*tie, "d", label, "_features"]
    both = [stored(filled.transform(df.where(col(label).isNotNull())).select(*columns), "ladder-vectors") for df in (train, val)]

    def fit(k: int) -> DataFrame:
        cut = VectorSlicer(inputCol="_features", outputCol="_cut", indices=list(range(k)))
        trees = GBTClassifier(featuresCol="_cut", labelCol=label, maxIter=params.max_rounds, maxDepth=params.depth, stepSize=params.step, seed=params.seed, predictionCol="_pred")
        model = trees.setProbabilityCol("_prob").setRawPredictionCol("_raw").fit(cut.transform(both[0]))
        scored = model.transform(cut.transform(both[1])).withColumn("prob", F.get(vector_to_array("_prob"), F.lit(1)))
        return precision_at_k(scored, "prob", label, top, tie=tie).select(F.lit(k).cast("long").alias("k"), F.col("precision_day").alias("precision"))

    with ThreadPool(FITS_AT_ONCE) as pool:
        rows = pool.map(fit, ladder_sizes(len(ranked)))
    return cut_lineage(reduce(DataFrame.unionByName, rows))


def with_elbow(curve: DataFrame, k: str = "k", value: str = "precision") -> DataFrame:
    """``curve`` with each point's distance to the line through its first and last point over log2(k), and ``chosen`` on the
    farthest one; of equally far ones the smallest k. Sizes must differ; one point is its own elbow."""
    counts = curve.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(k).alias("sizes"), F.count(value).alias("known")).first()
    if not counts["n"] == counts["sizes"] == counts["known"]:
        raise ValueError("a curve has one known value for every size")
    end = F.struct(F.log2(k).alias("x"), F.col(value).cast("double").alias("y"))
    placed = attach_row(curve, curve.agg(F.min_by(end, k).alias("_a"), F.max_by(end, k).alias("_b")))
    dx, dy = F.col("_b.x") - F.col("_a.x"), F.col("_b.y") - F.col("_a.y")
    away = F.abs(dx * (F.col(value) - F.col("_a.y")) - dy * (F.log2(k) - F.col("_a.x"))) / F.sqrt(dx * dx + dy * dy)
    placed = placed.withColumn("distance", F.when(dx > 0, away).otherwise(F.lit(0.0))).drop("_a", "_b")
    far = placed.agg(F.max("distance").alias("_far"))
    near_far = F.col("distance") >= F.col("_far") - 1e-12 * F.greatest(F.lit(1.0), F.col("_far"))
    tied = attach_row(placed, far).withColumn("_tied", near_far)
    first = tied.agg(F.min(F.when(F.col("_tied"), F.col(k))).alias("_first"))
    return attach_row(tied, first).withColumn("chosen", F.col(k) == F.col("_first")).drop("_far", "_tied", "_first")
