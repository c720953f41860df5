"""Model fitting, calibration and cross-validation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import functions as F

from assay.operators import calibration as c
from assay.operators.common import bounded_rows
from assay.operators.metrics import auroc_avg_rank, brier, ece10
from assay.operators.reports import abstention_cells
from assay.plans.base import query, r, rounded
from assay.plans.proxies import grids, scores, table, u_sql, wide_grids, with_ctes
from assay.plans.q_metrics import BIN, variant_scores
from assay.plans.q_sampling import responses

FOLD = f"floor({u_sql('0', chr(39) + 'fold' + chr(39), 'id')} * 5)::INT"



def fits_sql(train: str) -> str:
    """CTEs after ``train`` (fit, p, n, s): ``cool`` (fit, t) by Newton steps, ``iso`` (fit, p, v) by the max-min formula over all spans."""
    return f"""{train},
logits AS (SELECT fit, n, s, ln(greatest(1e-9, least(1 - 1e-9, p)) / (1 - greatest(1e-9, least(1 - 1e-9, p)))) AS z FROM train),
newton AS (
  SELECT DISTINCT fit, 0 AS it, 1.0::DOUBLE AS b FROM train
  UNION ALL
  SELECT fit, it + 1, b - sum((n * q - s) * z) / sum(n * q * (1 - q) * z * z)
  FROM (SELECT l.*, it, b, 1 / (1 + exp(-b * z)) AS q FROM newton JOIN logits l USING (fit) WHERE it < 30) GROUP BY fit, it, b),
cool AS (SELECT fit, 1 / b AS t FROM newton WHERE it = 30),
run AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(s) OVER w AS cs FROM train WINDOW w AS (PARTITION BY fit ORDER BY p)),
spans AS (SELECT a.fit, a.i AS j, b.i AS k, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS m FROM run a JOIN run b ON b.fit = a.fit AND b.i >= a.i),
tails AS (SELECT fit, j, k AS i, min(m) OVER (PARTITION BY fit, j ORDER BY k DESC) AS low FROM spans),
iso AS (SELECT run.fit, p, v FROM run JOIN (SELECT fit, i, max(low) AS v FROM tails GROUP BY fit, i) m ON m.fit = run.fit AND m.i = run.i)"""


def judged_sql(held: str) -> str:
    """CTEs after ``held`` (fit, p, n, s): ``judged`` (policy, fit, n, n_pos, brier, ece10) of the three policies."""
    return f""", {held},
warm AS (SELECT h.*, a.p AS ap, a.v AS av FROM held h ASOF LEFT JOIN iso a ON a.fit = h.fit AND h.p >= a.p),
mapped AS (SELECT w.*, c.p AS cp, c.v AS cv FROM warm w ASOF LEFT JOIN iso c ON c.fit = w.fit AND w.p <= c.p),
judged_rows AS (
  SELECT 'identity' AS policy, fit, p, n, s FROM held
  UNION ALL SELECT 'temperature', fit, 1 / (1 + exp(-ln(greatest(1e-9, least(1 - 1e-9, p)) / (1 - greatest(1e-9, least(1 - 1e-9, p)))) / t)), n, s FROM held JOIN cool USING (fit)
  UNION ALL SELECT 'isotonic', fit, CASE WHEN cp > ap THEN av + (cv - av) * (p - ap) / (cp - ap) ELSE coalesce(av, cv) END, n, s FROM mapped),
judged_bins AS (SELECT policy, fit, {BIN} AS bin, sum(n) AS n, sum(s) AS s, sum(n * p) AS mass, sum(s * (p - 1) ** 2 + (n - s) * p ** 2) AS err FROM judged_rows GROUP BY ALL),
judged AS (SELECT policy, fit, sum(n)::BIGINT AS n, sum(s) AS n_pos, sum(err) / sum(n) AS brier, sum(abs(mass - s)) / sum(n) AS ece10 FROM judged_bins GROUP BY ALL)"""


def recursive(*names: str, body: str) -> str:
    return with_ctes(*names, body=body).replace("WITH ", "WITH RECURSIVE ", 1).replace("\n, ", ",\n", 1)


ALL_CELLS = ", train AS (SELECT 0 AS fit, p, count(*) AS n, sum(y) AS s FROM scores WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY p)"
FOLD_CELLS = f""", folded AS (SELECT p, y, {FOLD} AS fold FROM scores WHERE p IS NOT NULL AND y IS NOT NULL),
train AS (SELECT t.k::INT AS fit, p, count(*) AS n, sum(y) AS s FROM folded, range(5) t(k) WHERE fold <> t.k GROUP BY ALL)"""


def embedding_rows(spark, sf):
    """(id, features, y): the upper half of the embedding labels is the positive class."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.transform("embedding", lambda v: v.cast("double")).alias("features"),
        (F.col("label") >= 5).cast("int").alias("y"),
    )


@query("fit_logistic_baseline")
def q_baseline(spark, sf):
    names = [f"x{i}" for i in range(64)]
    return rounded(c.fit_logistic_baseline(embedding_rows(spark, sf), names), 5)


@query("fit_temperature", recursive("scores", body=f"{fits_sql(ALL_CELLS)} SELECT (SELECT count(*) FROM scores) AS n, {r('t', 4)} AS temperature FROM cool"))
def q_fit_temperature(spark, sf):
    t = c.fit_temperature(scores(spark, sf))
    return scores(spark, sf).agg(F.count(F.lit(1)).alias("n")).withColumn("temperature", F.round(F.lit(t), 4))


@query(
    "fit_isotonic",
    with_ctes(
        "scores",
        body=f""", cells AS (SELECT p, count(*) AS n, sum(y) AS s, row_number() OVER (ORDER BY p) AS i FROM scores GROUP BY p),
run AS (SELECT *, sum(n) OVER (ORDER BY i) AS cn, sum(s) OVER (ORDER BY i) AS cs FROM cells),
spans AS (SELECT a.i AS j, b.i AS k, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS m FROM run a JOIN run b ON b.i >= a.i),
tails AS (SELECT j, k AS i, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS low FROM spans),
fit AS (SELECT i, max(low) AS v FROM tails GROUP BY i)
SELECT id, {r('v')} AS p_cal FROM scores JOIN cells ON cells.p = scores.p JOIN fit ON fit.i = cells.i""",
    ).replace("\n, ", ",\n", 1),
)
def q_isotonic(spark, sf):
    """The SQL twin is the max-min formula over all spans instead of pooling."""
    df = scores(spark, sf)
    return rounded(c.fit_isotonic(df).transform(df.select("id", "p")).select("id", "p_cal"))


@query(
    "calibration_cv",
    recursive(
        "scores",
        body=f"""{fits_sql(FOLD_CELLS)}
{judged_sql("held AS (SELECT fold AS fit, p, count(*) AS n, sum(y) AS s FROM folded GROUP BY ALL)")}
SELECT policy, fit AS fold, n, {r('brier')} AS brier, {r('ece10')} AS ece10 FROM judged""",
    ),
)
def q_calibration(spark, sf):
    return rounded(c.calibration_cv(scores(spark, sf)))


@query(
    "calibration_identity",
    with_ctes(
        "scores",
        body=f""", f AS (SELECT *, {FOLD} AS fold FROM scores),
b AS (SELECT fold, {BIN} AS bin, count(*) AS k, avg(p) AS mp, avg(y) AS my FROM f GROUP BY ALL)
SELECT fold, n, {r('brier')} AS brier, {r('ece')} AS ece10 FROM
(SELECT fold, count(*) AS n, avg((p - y) * (p - y)) AS brier FROM f GROUP BY fold)
JOIN (SELECT fold, sum(k * abs(mp - my)) / sum(k) AS ece FROM b GROUP BY fold) USING (fold)""",
    ).replace("\n, ", ",\n", 1),
)
def q_identity(spark, sf):
    df = scores(spark, sf).withColumn("fold", c.fold_of(F.col("id")))
    return rounded(brier(df, ["fold"]).join(ece10(df, ["fold"], guard=0).drop("n"), "fold"))


@query(
    "two_threshold_cv",
    with_ctes(
        "scores",
        body=f"""SELECT fold, n, d AS n_decided, {r('1 - d / n')} AS abstain_rate, {r('CASE WHEN d > 0 THEN w / d END')} AS error_within_decided
FROM (SELECT {FOLD} AS fold, count(*) AS n, count(*) FILTER (p >= 0.65 OR p <= 0.35) AS d,
  count(*) FILTER ((p >= 0.65 OR p <= 0.35) AND (p >= 0.65) <> (y = 1)) AS w FROM scores GROUP BY 1)""",
    ),
)
def q_two_threshold(spark, sf):
    return rounded(c.two_threshold_cv(scores(spark, sf)))


@query(
    "calibration_final",
    recursive(
        "scores",
        body=f"""{fits_sql(ALL_CELLS)}
{judged_sql("held AS (SELECT * FROM train)")}
SELECT policy, n, {r('brier')} AS brier, {r('ece10')} AS ece10, n_pos < 100 OR n - n_pos < 100 AS small_sample,
  CASE WHEN policy = 'temperature' THEN {r('t')} END AS temperature FROM judged JOIN cool USING (fit)""",
    ),
)
def q_calibration_final(spark, sf):
    return rounded(c.calibration_final(scores(spark, sf)))


# the five transforms of the abstention study
TRANSFORMS = ("jpeg60", "jpeg40", "resize0.5", "web", "noise0.05")


def degraded_vectors(spark, sf):
    """(id, suite, class, variant, score, y, features): clean responses and five degraded siblings; y says degraded."""
    rows = variant_scores(spark, sf).where(F.col("variant").isin("clean", *TRANSFORMS))
    p = F.col("p")
    vector = F.array(p, F.abs(p - 0.5), p * (1 - p))
    return rows.select(
        "id", "suite", F.col("y").alias("class"), "variant", p.alias("score"), (F.col("variant") != "clean").cast("int").alias("y"), vector.alias("features")
    )


def tuned(spark, sf):
    """Out-of-fold evidence scores, and the row with the threshold chosen from them."""
    oof = c.grouped_cv(degraded_vectors(spark, sf), "id")
    return oof, bounded_rows(c.tuned_threshold(oof), 1)[0]


@query("grouped_cv")
def q_grouped(spark, sf):
    oof, pick = tuned(spark, sf)
    return rounded(auroc_avg_rank(oof, ["fold"]).withColumns({k: F.lit(pick[k]).cast("double") for k in ("t", "recall", "fpr")}), 4)


@query("abstention_study")
def q_study(spark, sf):
    """Response vectors, grouped cross-validation, tuned threshold, flags, and the cells that the gates judge."""
    oof, pick = tuned(spark, sf)
    flagged = oof.select("variant", F.col("score").alias("p"), F.col("class").alias("y"), (F.col("p") >= F.lit(pick["t"])).alias("flag"))
    return rounded(abstention_cells(flagged, "variant"), 4)


@query(
    "grouped_cv_folds",
    with_ctes("wide", body=f"SELECT fold, count(*) AS n_groups FROM (SELECT DISTINCT id, {FOLD} AS fold FROM wide) GROUP BY fold"),
)
def q_folds(spark, sf):
    df = wide_grids(spark, sf).select("id", c.fold_of(F.col("id")).alias("fold"))
    return df.groupBy("fold").agg(F.count(F.lit(1)).alias("n_groups"))


@query("leave_one_family_out")
def q_family(spark, sf):
    """Recall of each family at the threshold tuned on the out-of-fold scores."""
    t = tuned(spark, sf)[1]["t"]
    return rounded(c.leave_one_family_out(degraded_vectors(spark, sf), "variant", list(TRANSFORMS), t), 4)


@query("meta_classifier")
def q_meta(spark, sf):
    """Response vectors: fit on four folds, compared on the fifth."""
    rows = responses(spark, sf).join(scores(spark, sf).select("id", "y", "suite"), "id")
    names = [n for n in rows.columns if n not in ("id", "y", "suite")]
    rows = rows.withColumn("vector", F.array(*names)).withColumn("fold", c.fold_of(F.col("id")))
    out, weights, intercept = c.meta_classifier(
        rows.where("fold <> 0"), rows.where("fold = 0"), "vector", "p_clean", ["suite"]
    )
    export = F.array(*[F.round(F.lit(w), 4) for w in weights])
    return rounded(out, 4).withColumn("weights", export).withColumn("intercept", F.round(F.lit(intercept), 4))


def make_linear(weights: list[float], intercept: float) -> Callable:
    """Factory for a model that runs in the Python workers, here the linear one."""
    def load() -> Callable[[np.ndarray], np.ndarray]:
        w = np.asarray(weights)

        def predict(x: np.ndarray) -> np.ndarray:
            return 1.0 / (1.0 + np.exp(-(x.reshape(-1, len(w)) @ w + intercept)))

        return predict

    return load


@query(
    "batch_score",
    with_ctes(
        "px",
        body=f"""SELECT id, {r('p')} AS p_table, {r('p')} AS p_worker FROM (
  SELECT id, 1 / (1 + exp(-(sum((v - 127.5) * (((i * 37 % 11) - 5) / 200.0)) + 0.25))) AS p FROM px GROUP BY id)""",
    ),
)
def q_batch_score(spark, sf):
    """The same linear model as a broadcast table and as a pluggable worker-side model."""
    weights = [((i * 37 % 11) - 5) / 200.0 for i in range(64)]
    row = [([127.5] * 64, [1.0] * 64, weights, 0.25)]
    model = spark.createDataFrame(row, "mean array<double>, scale array<double>, coef array<double>, intercept double")
    df = grids(spark, sf).select("id", "grid")
    native = c.batch_score_linear(df, model, "grid").select("id", "grid", F.col("p").alias("p_table"))
    shift = 0.25 - 127.5 * sum(weights)
    both = c.batch_score(native, make_linear(weights, shift), ["grid"], [[64]])
    return rounded(both.select("id", "p_table", F.col("p").alias("p_worker")))
