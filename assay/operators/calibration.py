"""Model fitting, calibration and cross-validation with Spark ML."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.hashing import pick_index
from assay.functions.scalars import apply_temperature, clipped_logit, score_linear
from assay.operators.common import bounded_rows, materialize
from assay.operators.isotonic import Isotonic, interpolate, knots_of, pool, training_cells
from assay.operators.metrics import auroc_avg_rank, ece_bin, rates
from assay.operators.reports import abstention_report
from assay.operators.sampling import sweep_pick, threshold_sweep

MAX_ITER = 2000
MIN_CLASS = 100


def fold_of(key: Column, folds: int = 5, seed=0) -> Column:
    """Fold 0..folds-1 from md5 of the key: a group never crosses folds."""
    return pick_index(folds, seed, "fold", key)


def _logistic(df: DataFrame, reg: float, intercept: bool = True):
    weight = {"weightCol": "_w"} if "_w" in df.columns else {}
    lr = LogisticRegression(
        featuresCol="_x", labelCol="_y", maxIter=MAX_ITER, regParam=reg, fitIntercept=intercept,
        standardization=False, tol=1e-8, **weight,
    )
    return lr.fit(df)


def _vectors(df: DataFrame, features: str, y: str = "y") -> DataFrame:
    return df.select(array_to_vector(F.col(features)).alias("_x"), F.col(y).cast("double").alias("_y"))


def _array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def fit_logistic(df: DataFrame, features: str = "features", y: str = "y", c: float = 1.0) -> tuple[list[float], float]:
    """L2 logistic regression with penalty 1/(C n), features unscaled: (weights, intercept)."""
    data = _vectors(df, features, y).persist()
    try:
        model = _logistic(data, 1.0 / (c * data.count()))
    finally:
        data.unpersist()
    return [float(v) for v in model.coefficients], float(model.intercept)


def linear_probability(features: Column, weights: list[float], intercept: float) -> Column:
    """Score of a fitted model as an expression: stays in the JVM, no model object in the plan."""
    n = len(weights)
    return score_linear(features, _array([0.0] * n), _array([1.0] * n), _array(weights), F.lit(intercept))


def fit_logistic_baseline(
    df: DataFrame, names: list[str], features: str = "features", y: str = "y", c: float = 1.0
) -> DataFrame:
    """Standardize (population std), fit, and return one row with the model and its training metrics."""
    data = df.select(F.col(features).alias("features"), F.col(y).cast("int").alias("y")).persist()
    try:
        n = data.count()
        raw = data.select(array_to_vector("features").alias("_r"))
        scaler = StandardScaler(inputCol="_r", outputCol="_s", withMean=True, withStd=True).fit(raw)
        shrink = ((n - 1) / n) ** 0.5 if n > 1 else 0.0
        mean = [float(v) for v in scaler.mean]
        # a constant feature keeps scale 1
        scale = [float(v) * shrink or 1.0 for v in scaler.std]
        z = F.zip_with(
            F.zip_with("features", _array(mean), lambda v, m: v - m), _array(scale), lambda v, s: v / s
        )
        model = _logistic(_vectors(data.withColumn("_z", z), "_z"), 1.0 / (c * n))
    finally:
        data.unpersist()
    coef = [float(v) for v in model.coefficients]
    row = [(list(names), mean, scale, coef, float(model.intercept), 1)]
    schema = "feature_names array<string>, mean array<double>, scale array<double>, coef array<double>, intercept double, version int"
    fitted = df.sparkSession.createDataFrame(row, schema)
    scored = batch_score_linear(df.select(F.col(features).alias("features"), F.col(y).alias("y")), fitted)
    everything = scored.withColumn("_all", F.lit(0))
    bal = bounded_rows(rates(everything, ["_all"]), 1)[0]["balanced_accuracy"]
    auroc = bounded_rows(auroc_avg_rank(everything, ["_all"]), 1)[0]["auroc"]
    return fitted.withColumns(
        {"train_balanced_accuracy": F.lit(bal).cast("double"), "train_auroc": F.lit(auroc).cast("double")}
    )


def batch_score_linear(df: DataFrame, model: DataFrame, features: str = "features") -> DataFrame:
    """Add ``p`` from a one-row model table; the row becomes literals, so scoring is a projection."""
    m = bounded_rows(model.select("mean", "scale", "coef", "intercept"), 1)[0]
    p = score_linear(F.col(features), _array(m["mean"]), _array(m["scale"]), _array(m["coef"]), F.lit(m["intercept"]))
    return df.withColumn("p", p)


def batch_score(
    df: DataFrame, make_predict: Callable, features: list[str], shapes: list | None = None, batch_size: int = 32
) -> DataFrame:
    """Add ``p`` with a pluggable model: ``make_predict`` loads it once per Python worker.

    ``shapes`` gives the shape of each array column.
    """
    udf = predict_batch_udf(
        make_predict, return_type=T.DoubleType(), batch_size=batch_size, input_tensor_shapes=shapes
    )
    return df.withColumn("p", udf(*[F.col(f) for f in features]))


def fit_temperatures(cells: DataFrame, most: int = 100) -> dict[int, float]:
    """Temperature of each fit over cells ``fit, p, n, s``: minimizes the log loss of sigmoid(logit / T).

    Newton steps on 1/T for all fits at once; a step that does not lower the loss is halved. The loss is convex, so a
    weight at or below zero means that no temperature beats a constant: the result is infinite. The least one is 1e-6.
    """
    logits = cells.select("fit", clipped_logit(F.col("p")).alias("z"), F.col("n").cast("double").alias("n"), F.col("s").cast("double").alias("s")).persist()
    try:
        known = [r["fit"] for r in bounded_rows(logits.select("fit").distinct(), 10_000)]
        weight = dict.fromkeys(known, 1.0)
        step, loss, moving = dict.fromkeys(known, 0.0), dict.fromkeys(known, math.inf), set(known)
        for _ in range(most):
            if not moving:
                break
            pairs = [F.lit(v) for k in sorted(moving) for v in (k, weight[k])]
            b = F.try_element_at(F.create_map(*pairs), F.col("fit"))
            t = b * F.col("z")
            q = 1 / (1 + F.exp(-t))
            soft = F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t)))
            sums = logits.where(F.col("fit").isin(*moving)).groupBy("fit").agg(
                F.sum(F.col("n") * soft - F.col("s") * t).alias("loss"),
                F.sum((F.col("n") * q - F.col("s")) * F.col("z")).alias("slope"),
                F.sum(F.col("n") * q * (1 - q) * F.col("z") * F.col("z")).alias("bend"),
            )
            for r in bounded_rows(sums, 10_000):
                k = r["fit"]
                if r["loss"] > loss[k] * (1 + 1e-12) and abs(step[k]) > 1e-12:
                    step[k] /= 2
                    weight[k] -= step[k]
                    continue
                loss[k] = r["loss"]
                step[k] = -r["slope"] / r["bend"] if r["bend"] > 0 else 0.0
                weight[k] = min(weight[k] + step[k], 1e6)
                if abs(step[k]) <= 1e-12 * (1 + abs(weight[k])) or weight[k] == 1e6:
                    moving.discard(k)
    finally:
        logits.unpersist()
    return {k: max(1.0 / w, 1e-6) if w > 0 else math.inf for k, w in weight.items()}


def fit_temperature(df: DataFrame, y: str = "y", p: str = "p") -> float:
    """The temperature of one table; equal scores are merged with their counts first. 1.0 without scored rows."""
    _, cells = training_cells(df, 1, F.lit(0), y, p)
    return fit_temperatures(cells.where("fit = 1")).get(1, 1.0)


def fit_isotonic(df: DataFrame, y: str = "y", p: str = "p") -> Isotonic:
    """Isotonic fit on score cells; the knots stay a table."""
    _, cells = training_cells(df, 1, F.lit(0), y, p)
    return Isotonic(materialize(knots_of(pool(cells.where("fit = 1"))).drop("fit")))


def _by_case(column: str, values: dict) -> Column:
    """The expression of the row's case; one pass scores all folds or families."""
    out = F.lit(None).cast("double")
    for key, value in values.items():
        out = F.when(F.col(column) == key, value).otherwise(out)
    return out


def _policies(held: DataFrame, temperatures: dict[int, float], knots: DataFrame) -> DataFrame:
    """(policy, fit, p, n, s) with the scores of the three policies in place of p."""
    cooled = apply_temperature(F.col("p"), _by_case("fit", {k: F.lit(t) for k, t in temperatures.items()}))
    both = F.array(
        F.struct(F.lit("identity").alias("policy"), F.col("p").alias("p")),
        F.struct(F.lit("temperature").alias("policy"), cooled.alias("p")),
    )
    flat = held.select("fit", "n", "s", F.inline(both))
    # both sides come from the same cells, so their scores are equal as text
    text = F.col("p").cast("string").alias("_k")
    mapped = interpolate(held.select("fit", "p"), knots).select("fit", text, "p_cal")
    risen = held.select("fit", text, "n", "s").join(mapped, ["fit", "_k"])
    return flat.unionByName(risen.select("fit", "n", "s", F.lit("isotonic").alias("policy"), F.col("p_cal").alias("p")))


def _judged(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, n_pos, brier, ece10) of cells p, n, s."""
    p, n, s = F.col("p"), F.col("n"), F.col("s")
    bins = cells.groupBy(*by, ece_bin(p).alias("bin")).agg(
        F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum(n * p).alias("mass"), F.sum(s * F.pow(p - 1, 2) + (n - s) * F.pow(p, 2)).alias("err")
    )
    total = F.sum("n")
    gap = F.sum(F.abs(F.col("mass") - F.col("s"))) / total
    return bins.groupBy(*by).agg(total.alias("n"), F.sum("s").alias("n_pos"), (F.sum("err") / total).alias("brier"), gap.alias("ece10"))


def calibration_cv(df: DataFrame, folds: int = 5, seed=0, key: str = "id") -> DataFrame:
    """(policy, fold, n, brier, ece10) of the held-out scores of identity, temperature and isotonic.

    One aggregate of the rows gives the cells of every fold; all fits and figures work on cells.
    """
    held, train = training_cells(df, folds, fold_of(F.col(key), folds, seed))
    train = train.where(F.col("fit") < folds)
    cells = _policies(held, fit_temperatures(train), knots_of(pool(train)))
    return _judged(cells.withColumnRenamed("fit", "fold"), ["policy", "fold"]).drop("n_pos")


def two_threshold_cv(df: DataFrame, folds: int = 5, seed=0, key: str = "id") -> DataFrame:
    """Abstention figures per fold; needs no fit."""
    return abstention_report(df.withColumn("fold", fold_of(F.col(key), folds, seed)), ["fold"])


def calibration_final(df: DataFrame) -> DataFrame:
    """(policy, temperature, n, brier, ece10, small_sample) with the fits on all rows."""
    _, cells = training_cells(df, 1, F.lit(0))
    cells = cells.where("fit = 1")
    temperatures = fit_temperatures(cells)
    out = _judged(_policies(cells, temperatures, knots_of(pool(cells))), ["policy"])
    small = (F.col("n_pos") < MIN_CLASS) | (F.col("n") - F.col("n_pos") < MIN_CLASS)
    t = F.when(F.col("policy") == "temperature", F.lit(temperatures.get(1)))
    return out.select("policy", "n", "brier", "ece10", small.alias("small_sample"), t.cast("double").alias("temperature"))


def grouped_cv(
    df: DataFrame, group: str, features: str = "features", y: str = "y", folds: int = 5, seed=0, c: float = 1.0
) -> DataFrame:
    """Out-of-fold scores ``p``; an original and its variants share the group and hence the fold."""
    data = df.withColumn("fold", fold_of(F.col(group), folds, seed))
    kept = data.select("fold", features, y).persist()
    models = {}
    try:
        for k in range(folds):
            models[k] = fit_logistic(kept.where(F.col("fold") != k), features, y, c)
    finally:
        kept.unpersist()
    scores = {k: linear_probability(F.col(features), w, b) for k, (w, b) in models.items()}
    return data.withColumn("p", _by_case("fold", scores))


def leave_one_family_out(
    df: DataFrame, family: str, families: list[str], threshold: float, features: str = "features", y: str = "y"
) -> DataFrame:
    """(family, n, recall): each variant family scored by a fit on all other rows, clean originals included."""
    kept = df.select(F.col(family).alias("family"), features, y).persist()
    models = {}
    try:
        for name in families:
            models[name] = fit_logistic(kept.where(F.col("family") != name), features, y)
    finally:
        kept.unpersist()
    scores = {n: linear_probability(F.col(features), w, b) for n, (w, b) in models.items()}
    held = df.select(F.col(family).alias("family"), features).where(F.col("family").isin(*families))
    return held.withColumn("p", _by_case("family", scores)).groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("p") >= threshold).cast("double")).alias("recall")
    )


def tuned_threshold(oof: DataFrame, max_fpr: float = 0.03) -> DataFrame:
    """Threshold chosen from out-of-fold scores by the sweep rule."""
    rows = oof.withColumn("_all", F.lit(0))
    return sweep_pick(threshold_sweep(rows, ["_all"]), ["_all"], max_fpr).drop("_all")


def meta_classifier(
    train: DataFrame, test: DataFrame, vector: str, clean: str, by: list[str], y: str = "y"
) -> tuple[DataFrame, list[float], float]:
    """AUROC of a logistic on the whole response vector against one on the clean score only, with its weights."""
    weights, b = fit_logistic(train, vector, y)
    only, b0 = fit_logistic(train.withColumn("_c", F.array(clean)), "_c", y)
    scored = test.withColumn("p_meta", linear_probability(F.col(vector), weights, b)).withColumn(
        "p_base", linear_probability(F.array(clean), only, b0)
    )
    scored = scored.withColumn("y", F.col(y))
    base = auroc_avg_rank(scored.withColumn("p", F.col("p_base")), by).withColumnRenamed("auroc", "auroc_clean")
    meta = auroc_avg_rank(scored.withColumn("p", F.col("p_meta")), by).select(*by, F.col("auroc").alias("auroc_meta"))
    return base.join(meta, by), weights, b

