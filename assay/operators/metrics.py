"""Scorecard metrics; every function takes ``by`` so that all groups are computed in one job.

Inputs carry ``y`` (0/1, 1 = ai), ``p`` (score) and, for ordinal ranks, ``id``. One rule holds for all of them:
rows without a score or a class take no part in any count or metric, and ``unscored`` counts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.scalars import THRESHOLD
from assay.operators.common import ratio
from assay.operators.ranks import accumulate, cumulative_cells, ordinal_ranks, scored

# Bin edges as numpy's linspace(0, 1, 11) gives them; 0.3 lies below the fourth edge.
ECE_EDGES = (
    0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0,
)
FPR_TARGETS = (0.005, 0.01, 0.02)
MIN_PER_SOURCE = 10


def unscored(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_rows, n_unscored): how many rows every metric leaves out; groups with none have 0."""
    missing = F.count_if(F.col("p").isNull() | F.col("y").isNull())
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), missing.alias("n_unscored"))


def _count(cond: Column, weight: Column) -> Column:
    return F.sum(F.when(cond, weight).otherwise(0))


def _confusion_aggs(thr: float, n: Column, pos: Column) -> list[Column]:
    p = F.col("p")
    return [
        F.sum(n).alias("n"),
        F.sum(pos).alias("n_ai"),
        F.sum(n - pos).alias("n_real"),
        _count(p >= thr, pos).alias("tp"),
        _count(p < thr, n - pos).alias("tn"),
        _count(p >= thr, n - pos).alias("fp"),
        _count(p < thr, pos).alias("fn"),
    ]


def add_rates(df: DataFrame) -> DataFrame:
    """Rates from confusion counts; a missing class reads recall 0.0 and balanced accuracy null."""
    n_ai, n_real = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    ai, real = ratio(F.col("tp"), n_ai), ratio(F.col("tn"), n_real)
    return df.withColumns(
        {
            "ai_recall": ai,
            "real_recall": real,
            "false_ai_rate": ratio(F.col("fp"), n_real),
            "balanced_accuracy": F.when((n_ai > 0) & (n_real > 0), (ai + real) / 2),
        }
    )


def confusion(df: DataFrame, by: list[str], thr: float = THRESHOLD) -> DataFrame:
    return scored(df).groupBy(*by).agg(*_confusion_aggs(thr, F.lit(1), F.col("y").cast("long")))


def rates(df: DataFrame, by: list[str], thr: float = THRESHOLD) -> DataFrame:
    return add_rates(confusion(df, by, thr))


def brier(df: DataFrame, by: list[str]) -> DataFrame:
    err = F.col("p") - F.col("y")
    return scored(df).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(err * err).alias("brier"))


def ece_bin(p: Column) -> Column:
    """Bin 0..9 as the number of inner edges at or below p: comparisons only, so it stays in generated code."""
    inner = [(p >= F.lit(e)).cast("int") for e in ECE_EDGES[1:-1]]
    return sum(inner[1:], inner[0])


def reliability_table(df: DataFrame, by: list[str]) -> DataFrame:
    return scored(df).groupBy(*by, ece_bin(F.col("p")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("mean_y")
    )


def ece10(df: DataFrame, by: list[str], guard: int = 10) -> DataFrame:
    """Expected calibration error; groups under ``guard`` rows read 0 (pass 0 for no guard)."""
    n = F.sum("n")
    gap = F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / n
    return (
        reliability_table(df, by).groupBy(*by).agg(n.alias("n"), F.when(n >= guard, gap).otherwise(0.0).alias("ece10"))
    )


def _pos(df: DataFrame) -> tuple[Column, Column]:
    n_pos = F.max("all_n_pos").cast("double")
    n_neg = (F.max("all_n") - F.max("all_n_pos")).cast("double")
    return n_pos, n_neg


def auroc_avg_rank(df: DataFrame, by: list[str]) -> DataFrame:
    """Tie-correct area under the ROC curve, from cells only; null for a single class."""
    return auroc_of_cells(cumulative_cells(df, by), by)


def auroc_of_cells(run: DataFrame, by: list[str]) -> DataFrame:
    n_pos, n_neg = _pos(run)
    neg = (F.col("n") - F.col("n_pos")).cast("double")
    neg_below = (F.col("cum_n") - F.col("cum_n_pos")).cast("double") - neg
    wins = F.sum(F.col("n_pos") * (neg_below + neg / 2))
    return run.groupBy(*by).agg(
        F.max("all_n").alias("n"), F.when((n_pos > 0) & (n_neg > 0), wins / (n_pos * n_neg)).alias("auroc")
    )


def _curve_aggs() -> list[Column]:
    """Ordinal-rank auroc and step-wise auprc over ranked rows; null for a single class."""
    n_pos, n_neg = F.max("all_n_pos").cast("double"), F.max(F.col("all_n") - F.col("all_n_pos")).cast("double")
    rank_sum = F.sum(F.when(F.col("y") == 1, F.col("rank_asc").cast("double")))
    precision = F.sum(F.when(F.col("y") == 1, F.col("pos_desc") / F.col("rank_desc")))
    both = (n_pos > 0) & (n_neg > 0)
    return [
        F.when(both, (rank_sum - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg)).alias("auroc"),
        F.when(both, precision / n_pos).alias("auprc"),
    ]


def rank_curves(df: DataFrame, by: list[str], key: str = "id") -> DataFrame:
    """Ordinal-rank auroc and step-wise auprc of each group."""
    ranked = ordinal_ranks(df, by, key=key)
    return ranked.groupBy(*by).agg(F.max("all_n").alias("n"), *_curve_aggs())


def auroc_ordinal(df: DataFrame, by: list[str], key: str = "id") -> DataFrame:
    return rank_curves(df, by, key).drop("auprc")


def auprc_step(df: DataFrame, by: list[str], key: str = "id") -> DataFrame:
    return rank_curves(df, by, key).drop("auroc")


def _recall_column(target: float) -> str:
    return "ai_recall_at_fpr_" + str(target).replace(".", "_")


def _fpr_aggs(targets) -> list[Column]:
    """Recall at the cut score per target, over rows with running counts le_n, le_pos and sizes eq_n, eq_pos.

    The cut is the real score of rank max(1, ceil((1 - t) n)); it counts as positive itself, so the
    realized rate may exceed t.
    """
    n_pos, n_neg = F.col("all_n_pos"), F.col("all_n") - F.col("all_n_pos")
    neg_le = F.col("le_n") - F.col("le_pos")
    neg_lt = neg_le - (F.col("eq_n") - F.col("eq_pos"))
    out = []
    for t in targets:
        want = F.greatest(F.lit(1), F.ceil(F.lit(1.0 - t) * n_neg))
        at_cut = (neg_lt < want) & (neg_le >= want)
        hit = n_pos - (F.col("le_pos") - F.col("eq_pos"))
        value = F.when(at_cut & (n_pos > 0), hit / n_pos)
        out.append(F.max(value).alias(_recall_column(t)))
    return out


def _as_ties(run: DataFrame) -> DataFrame:
    """Cumulative cells under the names of the ranked rows."""
    return run.withColumns(
        {"le_n": F.col("cum_n"), "le_pos": F.col("cum_n_pos"), "eq_n": F.col("n"), "eq_pos": F.col("n_pos")}
    )


def recall_at_fpr(df: DataFrame, by: list[str], targets=FPR_TARGETS) -> DataFrame:
    return _as_ties(cumulative_cells(df, by)).groupBy(*by).agg(*_fpr_aggs(targets))


def _point_aggs(thr: float, n: Column, pos: Column) -> list[Column]:
    """Confusion, brier, ece10 and mean confidence over rows or cells of weight n with pos positives."""
    p, total = F.col("p"), F.sum(n)
    gaps = [
        F.coalesce(F.abs(F.sum(F.when(F.col("_bin") == b, p * n - pos))), F.lit(0.0)) for b in range(len(ECE_EDGES) - 1)
    ]
    return [
        *_confusion_aggs(thr, n, pos),
        (F.sum(pos * F.pow(p - 1, 2) + (n - pos) * F.pow(p, 2)) / total).alias("brier"),
        F.when(total >= 10, sum(gaps[1:], gaps[0]) / total).otherwise(0.0).alias("ece10"),
        (F.sum(n * p) / total).alias("mean_conf"),
    ]


def cell_metrics(df: DataFrame, by: list[str], thr: float = THRESHOLD, targets=FPR_TARGETS) -> DataFrame:
    """All metrics that depend only on the score cells, with the tie-correct AUROC; no row-level shuffle."""
    run = _as_ties(cumulative_cells(df, by)).withColumn("_bin", ece_bin(F.col("p")))
    n, pos = F.col("n"), F.col("n_pos")
    neg = (n - pos).cast("double")
    wins = F.sum(pos * ((F.col("cum_n") - F.col("cum_n_pos")).cast("double") - neg / 2))
    n_pos, n_neg = F.sum(pos).cast("double"), F.sum(n - pos).cast("double")
    auroc = F.when((n_pos > 0) & (n_neg > 0), wins / (n_pos * n_neg)).alias("auroc_avg_rank")
    return add_rates(run.groupBy(*by).agg(*_point_aggs(thr, n, pos), auroc, *_fpr_aggs(targets)))


def metrics_full(
    df: DataFrame, by: list[str], thr: float = THRESHOLD, key: str = "id", targets=FPR_TARGETS
) -> DataFrame:
    """The full record with ordinal-rank curves: one aggregate over the ranked rows."""
    ranked = ordinal_ranks(df, by, key=key).withColumn("_bin", ece_bin(F.col("p")))
    aggs = [*_point_aggs(thr, F.lit(1).cast("long"), F.col("y")), *_curve_aggs(), *_fpr_aggs(targets)]
    return add_rates(ranked.groupBy(*by).agg(*aggs)).drop("mean_conf")


def point_metrics(df: DataFrame, by: list[str], thr: float = THRESHOLD) -> DataFrame:
    """Confusion, rates, brier, ece10 and mean confidence: everything without ranks, in one aggregate over the rows."""
    rows = scored(df).withColumn("_bin", ece_bin(F.col("p")))
    return add_rates(rows.groupBy(*by).agg(*_point_aggs(thr, F.lit(1).cast("long"), F.col("y").cast("long"))))


def metrics_by_source(
    df: DataFrame, by: list[str], thr: float = THRESHOLD, min_rows: int = MIN_PER_SOURCE
) -> DataFrame:
    """Metrics of the groups with at least ``min_rows`` scored rows."""
    return metrics_full(df, by, thr).where(F.col("n") >= min_rows)


METRIC_FIELDS = (
    "balanced_accuracy", "ai_recall", "real_recall", "false_ai_rate", "brier", "ece10",
)


def metrics_long(df: DataFrame, keys: list[str], fields=METRIC_FIELDS) -> DataFrame:
    """(keys, metric, value) rows of a metrics record."""
    return df.unpivot(keys, list(fields), "metric", "value")


def overlap_zone_auroc(
    df: DataFrame, by: list[str], clean: str = "p_clean", low: float = 0.3, high: float = 0.8
) -> DataFrame:
    """Tie-correct AUROC over all rows and over rows whose clean score is ambiguous, from the same score cells."""
    inside = F.col(clean).between(low, high)
    pos = F.col("y").cast("long")
    cells = scored(df).groupBy(*by, F.col("p").cast("double").alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(pos).alias("n_pos"),
        F.count_if(inside).alias("z"), F.sum(F.when(inside, pos).otherwise(0)).alias("z_pos"),
    )
    run = accumulate(cells, by, ["p"], ["n", "n_pos", "z", "z_pos"])

    def area(n: str, n_pos: str) -> Column:
        neg = (F.col(n) - F.col(n_pos)).cast("double")
        below = (F.col(f"cum_{n}") - F.col(f"cum_{n_pos}")).cast("double") - neg
        all_pos, all_neg = F.sum(n_pos).cast("double"), F.sum(F.col(n) - F.col(n_pos)).cast("double")
        wins = F.sum(F.col(n_pos) * (below + neg / 2))
        return F.when((all_pos > 0) & (all_neg > 0), wins / (all_pos * all_neg))

    return run.groupBy(*by).agg(
        F.sum("n").alias("n_all"), area("n", "n_pos").alias("auroc_all"),
        F.sum("z").alias("n_overlap"), area("z", "z_pos").alias("auroc_overlap"),
    )


def score_profile(df: DataFrame, by: list[str], thr: float = THRESHOLD) -> DataFrame:
    """Count, mean, extremes and share called ai per source."""
    p = F.col("p")
    return df.groupBy(*by).agg(
        F.count("p").alias("n"),
        F.avg(p).alias("mean_conf"),
        F.min(p).alias("min_conf"),
        F.max(p).alias("max_conf"),
        F.avg(F.when(p.isNotNull(), (p >= thr).cast("double"))).alias("share_ai"),
    )


