"""Reports and gates built on the metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.scalars import HIGH_CONF, LOW_CONF, THRESHOLD
from assay.operators.common import join_keys, ratio
from assay.operators.metrics import METRIC_FIELDS, metrics_long, point_metrics, rates, scored
from assay.operators.ranks import order_statistics


def shift_report(df: DataFrame, by: list[str], thr: float = THRESHOLD) -> DataFrame:
    """n, brier, ece10, rates and mean confidence per stratum, from one aggregate."""
    keep = ["n", "false_ai_rate", "ai_recall", "real_recall", "brier", "mean_conf", "ece10"]
    return point_metrics(df, by, thr).select(*by, *keep)


def degradation_report(df: DataFrame, variant: str = "variant", clean: str = "clean", thr: float = THRESHOLD) -> DataFrame:
    """Balanced accuracy per variant and its change to the clean one; a missing class counts as recall 0."""
    r = rates(df, [variant], thr)
    r = r.select(variant, ((F.col("ai_recall") + F.col("real_recall")) / 2).alias("bal"), "ai_recall", "real_recall")
    # one row per variant: a window over the whole report is small
    base = F.max(F.when(F.col(variant) == clean, F.col("bal"))).over(Window.partitionBy(F.lit(0)))
    return r.withColumn("delta", F.col("bal") - base)


def robustness_gate(
    report: DataFrame, variant: str = "variant", clean: str = "clean", hard: str = "jpeg60",
    min_clean: float = 0.98, keep: float = 0.8,
) -> DataFrame:
    """Clean balanced accuracy and ai recall kept under the hard variant."""
    def pick(name: str, col: str) -> Column:
        return F.max(F.when(F.col(variant) == name, F.col(col)))

    out = report.agg(
        pick(clean, "bal").alias("clean_bal"),
        pick(clean, "ai_recall").alias("clean_ai"),
        pick(hard, "ai_recall").alias("hard_ai"),
    )
    ok = (F.col("clean_bal") >= min_clean) & (F.col("hard_ai") >= keep * F.col("clean_ai"))
    return out.withColumn("passed", F.coalesce(ok, F.lit(False)))


def abstention_report(
    df: DataFrame, by: list[str], low: float = LOW_CONF, high: float = HIGH_CONF, thr: float = THRESHOLD
) -> DataFrame:
    """Share left undecided and error inside the decided part; both band edges count as decided."""
    p = F.col("p")
    decided = (p >= high) | (p <= low)
    wrong = decided & ((p >= thr) != (F.col("y") == 1))
    n, n_dec = F.count(F.lit(1)), F.count_if(decided)
    return scored(df).groupBy(*by).agg(
        n.alias("n"),
        n_dec.alias("n_decided"),
        (1 - n_dec / n).alias("abstain_rate"),
        F.when(n_dec > 0, F.count_if(wrong) / n_dec).alias("error_within_decided"),
    )


def abstention_cells(df: DataFrame, cell: str, thr: float = THRESHOLD) -> DataFrame:
    """Wrong decisions and abstentions per cell; ``flag`` says the asset is abstained on."""
    wrong = (F.col("p") >= thr) != (F.col("y") == 1)
    flag = F.col("flag")
    out = scored(df).groupBy(cell).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(wrong).alias("wrong_baseline"),
        F.count_if(wrong & flag).alias("wrong_abstained"),
        F.count_if(wrong & ~flag).alias("wrong_decided"),
        F.count_if(flag).alias("n_abstained"),
    )
    return out.withColumns(
        {
            "decided_error": ratio(F.col("wrong_decided"), F.col("n") - F.col("n_abstained")),
            "abstain_rate": F.col("n_abstained") / F.col("n"),
        }
    )


def abstention_gates(cells: DataFrame) -> DataFrame:
    """Aggregate rates over all cells and the three gates."""
    s = {c: F.sum(c) for c in ("n", "wrong_baseline", "wrong_abstained", "wrong_decided", "n_abstained")}
    out = cells.agg(
        ratio(s["wrong_abstained"], s["wrong_baseline"]).alias("wrong_abstained_share"),
        ratio(s["wrong_decided"], s["n"] - s["n_abstained"]).alias("decided_error"),
        ratio(s["n_abstained"], s["n"]).alias("abstain_rate"),
    )
    return out.withColumns(
        {
            "gate_abstained": F.col("wrong_abstained_share") >= 0.90,
            "gate_decided": F.col("decided_error") <= 0.05,
            "gate_rate": F.col("abstain_rate") <= 0.85,
        }
    )


def suite_line(df: DataFrame, by: list[str], thr: float = THRESHOLD) -> DataFrame:
    """The printed benchmark line; without both classes the recall of the present one stands for balance."""
    r = point_metrics(df, by, thr)
    present = F.when(F.col("n_ai") > 0, F.col("ai_recall")).otherwise(F.col("real_recall"))
    r = r.withColumn("bal_acc", F.coalesce("balanced_accuracy", present))
    return r.select(*by, "n", "n_ai", "n_real", "bal_acc", "ai_recall", "real_recall", "brier", "ece10", "mean_conf")


def latency_percentiles(df: DataFrame, by: list[str], value: str = "latency_ms") -> DataFrame:
    """p50 = sorted[n // 2], p95 = sorted[min(n - 1, floor(0.95 n))], max: exact, from value cells."""
    run = order_statistics(df, by, value)
    n = F.col("all_n")

    def pick(index: Column) -> Column:
        return F.min(F.when(F.col("cum_n") > index, F.col("v")))

    return run.groupBy(*by).agg(
        F.max("all_n").alias("n"),
        pick(F.floor(n / 2)).alias("p50"),
        pick(F.least(n - 1, F.floor(n * F.lit(0.95)))).alias("p95"),
        F.max("v").alias("max"),
    )


def with_intervals(metrics_long: DataFrame, ci: DataFrame, keys: list[str]) -> DataFrame:
    """Metric rows with their bootstrap interval where one exists."""
    return join_keys(metrics_long, ci.drop("mean"), [*keys, "metric"], "left")


def scorecard_report(df: DataFrame, by: list[str], thr: float = THRESHOLD, fields=METRIC_FIELDS, **bootstrap) -> DataFrame:
    """(by, metric, value, lo, hi): the point metrics of each group with their intervals; ece10 has none."""
    from assay.operators.bootstrap import bootstrap_ci

    values = metrics_long(point_metrics(df, by, thr), by, fields)
    return with_intervals(values, bootstrap_ci(df, by, thr, **bootstrap), by)


def bundle_report(metrics: DataFrame, by: list[str], name: str = "metrics") -> DataFrame:
    """One struct per group, ready for a nested JSON sink."""
    inner = [c for c in metrics.columns if c not in by]
    return metrics.select(*by, F.struct(*inner).alias(name))
