"""Aggregations, metrics, reports and gates (suite = language, source = document source)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions.hashing import unit_hash
from assay.operators import bootstrap, metrics, quality, ranks, reports
from assay.plans.base import query, r, rounded
from assay.plans.proxies import manifest, scores, telemetry, u_sql, with_ctes
from assay.sources import sinks

EDGES = "[" + ", ".join(repr(e) for e in metrics.ECE_EDGES) + "]"
BIN = f"least(greatest(len(list_filter({EDGES}, lambda e: e <= p)) - 1, 0), 9)"

# shared SQL pieces -------------------------------------------------------------------------------

CONF = """count(*) AS n, count(*) FILTER (y = 1) AS n_ai, count(*) FILTER (y = 0) AS n_real,
  count(*) FILTER (p >= 0.65 AND y = 1) AS tp, count(*) FILTER (p < 0.65 AND y = 0) AS tn,
  count(*) FILTER (p >= 0.65 AND y = 0) AS fp, count(*) FILTER (p < 0.65 AND y = 1) AS fn"""

RATE_COLS = """tp / greatest(1, n_ai) AS ai_recall, tn / greatest(1, n_real) AS real_recall,
  fp / greatest(1, n_real) AS false_ai_rate,
  CASE WHEN n_ai > 0 AND n_real > 0 THEN (tp / greatest(1, n_ai) + tn / greatest(1, n_real)) / 2 END AS balanced_accuracy"""


def metric_ctes(by: str, src: str = "scores") -> str:
    """conf, rate, brier, ece, curve and cut tables keyed by ``by``."""
    return f"""
conf AS (SELECT {by}, {CONF} FROM {src} GROUP BY {by}),
rate AS (SELECT *, {RATE_COLS} FROM conf),
means AS (SELECT {by}, avg((p - y) * (p - y)) AS brier, avg(p) AS mean_conf FROM {src} GROUP BY {by}),
bins AS (SELECT {by}, {BIN} AS bin, count(*) AS k, avg(p) AS mp, avg(y) AS my FROM {src} GROUP BY ALL),
ece AS (SELECT {by}, CASE WHEN sum(k) >= 10 THEN sum(k * abs(mp - my)) / sum(k) ELSE 0.0 END AS ece10
        FROM bins GROUP BY {by}),
ranked AS (SELECT {by}, y, row_number() OVER (PARTITION BY {by} ORDER BY p, md5(id::VARCHAR)) AS ra,
                  row_number() OVER (PARTITION BY {by} ORDER BY p DESC, md5(id::VARCHAR)) AS rd,
                  sum(y) OVER (PARTITION BY {by} ORDER BY p DESC, md5(id::VARCHAR) ROWS UNBOUNDED PRECEDING) AS cp
           FROM {src}),
curve AS (SELECT {by}, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN
            (sum(ra) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) END AS auroc,
            CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN sum(cp / rd) FILTER (y = 1) / sum(y) END AS auprc
          FROM ranked GROUP BY {by}),
reals AS (SELECT {by}, p, row_number() OVER (PARTITION BY {by} ORDER BY p) AS k,
                 count(*) OVER (PARTITION BY {by}) AS m FROM {src} WHERE y = 0),
cuts AS (SELECT {by}, t, max(p) FILTER (k = greatest(1, ceil((1 - t) * m))) AS cut
         FROM reals CROSS JOIN (VALUES (0.005::DOUBLE), (0.01::DOUBLE), (0.02::DOUBLE)) v(t) GROUP BY {by}, t),
fpr AS (SELECT s.{by}, t, CASE WHEN sum(y) > 0 THEN count(*) FILTER (y = 1 AND p >= cut) / sum(y) END AS rec
        FROM {src} s JOIN cuts c ON s.{by} = c.{by} GROUP BY s.{by}, t),
recall AS (SELECT {by}, max(rec) FILTER (t = 0.005) AS a, max(rec) FILTER (t = 0.01) AS b, max(rec) FILTER (t = 0.02) AS c
           FROM fpr GROUP BY {by})"""


def full_select(by: str) -> str:
    cols = ["balanced_accuracy", "ai_recall", "real_recall", "false_ai_rate", "brier", "ece10", "auroc", "auprc"]
    return f"""SELECT conf.{by}, conf.n, conf.n_ai, conf.n_real, conf.tp, conf.tn, conf.fp, conf.fn,
  {', '.join(f'{r(c)} AS {c}' for c in cols)},
  {r('recall.a')} AS ai_recall_at_fpr_0_005, {r('recall.b')} AS ai_recall_at_fpr_0_01, {r('recall.c')} AS ai_recall_at_fpr_0_02
FROM conf JOIN rate USING ({by}) JOIN means USING ({by}) JOIN ece USING ({by}) JOIN curve USING ({by})
LEFT JOIN recall USING ({by})"""


def metric_sql(by: str, body: str, src: str = "scores", extra: str = "") -> str:
    base = with_ctes("scores", body="")
    return f"{base.rstrip()},{extra}{metric_ctes(by, src)}\n{body}"


# queries -----------------------------------------------------------------------------------------


@query("confusion", with_ctes("scores", body=f"SELECT suite, source, {CONF} FROM scores GROUP BY suite, source"))
def q_confusion(spark, sf):
    return metrics.confusion(scores(spark, sf), ["suite", "source"])


@query(
    "rates",
    with_ctes(
        "scores",
        body=f"""SELECT suite, source, n, n_ai, n_real, tp, tn, fp, fn,
  {', '.join(f'{r(c)} AS {c}' for c in ('ai_recall', 'real_recall', 'false_ai_rate', 'balanced_accuracy'))}
FROM (SELECT *, {RATE_COLS} FROM (SELECT suite, source, {CONF} FROM scores GROUP BY suite, source))""",
    ),
)
def q_rates(spark, sf):
    return rounded(metrics.rates(scores(spark, sf), ["suite", "source"]))


@query("auroc_ordinal", metric_sql("suite", f"SELECT suite, conf.n, {r('auroc')} AS auroc FROM conf JOIN curve USING (suite)", "tied",
                                   "tied AS (SELECT id, suite, y, p_tied AS p FROM scores),"))
def q_auroc_ordinal(spark, sf):
    df = scores(spark, sf).drop("p").withColumnRenamed("p_tied", "p")
    return rounded(metrics.auroc_ordinal(df, ["suite"]))


@query(
    "auroc_avg_rank",
    with_ctes(
        "scores",
        body=f"""SELECT suite, count(*) AS n, {r('''CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN
  (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) END''')} AS auroc
FROM (SELECT suite, y, rank() OVER (PARTITION BY suite ORDER BY p_tied)
             + (count(*) OVER (PARTITION BY suite, p_tied) - 1) / 2 AS rk FROM scores) GROUP BY suite""",
    ),
)
def q_auroc_avg_rank(spark, sf):
    df = scores(spark, sf).drop("p").withColumnRenamed("p_tied", "p")
    return rounded(metrics.auroc_avg_rank(df, ["suite"]))


@query("auprc_step", metric_sql("suite", f"SELECT suite, conf.n, {r('auprc')} AS auprc FROM conf JOIN curve USING (suite)", "tied",
                                "tied AS (SELECT id, suite, y, p_tied AS p FROM scores),"))
def q_auprc_step(spark, sf):
    df = scores(spark, sf).drop("p").withColumnRenamed("p_tied", "p")
    return rounded(metrics.auprc_step(df, ["suite"]))


@query(
    "brier",
    with_ctes(
        "scores",
        body=f"SELECT source, count(*) AS n, {r('avg((p - y) * (p - y))')} AS brier FROM scores GROUP BY source",
    ),
)
def q_brier(spark, sf):
    return rounded(metrics.brier(scores(spark, sf), ["source"]))


@query("ece10", metric_sql("suite", f"SELECT suite, conf.n, {r('ece10')} AS ece10 FROM conf JOIN ece USING (suite)"))
def q_ece10(spark, sf):
    return rounded(metrics.ece10(scores(spark, sf), ["suite"]))


@query(
    "reliability_table",
    metric_sql("suite", f"SELECT suite, bin::INT AS bin, k AS n, {r('mp')} AS mean_p, {r('my')} AS mean_y FROM bins"),
)
def q_reliability(spark, sf):
    return rounded(metrics.reliability_table(scores(spark, sf), ["suite"]))


@query(
    "recall_at_fpr",
    metric_sql(
        "suite",
        f"""SELECT suite, {r('a')} AS ai_recall_at_fpr_0_005, {r('b')} AS ai_recall_at_fpr_0_01,
  {r('c')} AS ai_recall_at_fpr_0_02 FROM conf LEFT JOIN recall USING (suite)""",
    ),
)
def q_recall_at_fpr(spark, sf):
    return rounded(metrics.recall_at_fpr(scores(spark, sf), ["suite"]))


@query("metrics_full", metric_sql("suite", full_select("suite")))
def q_metrics_full(spark, sf):
    return rounded(metrics.metrics_full(scores(spark, sf), ["suite"]))


@query(
    "metrics_by_source",
    metric_sql("source", full_select("source") + " WHERE conf.n >= 10"),
)
def q_metrics_by_source(spark, sf):
    return rounded(metrics.metrics_by_source(scores(spark, sf), ["source"]))


@query(
    "metrics_by_suite",
    metric_sql(
        "suite",
        f"""SELECT suite, metric, {r('value')} AS value FROM (
  SELECT suite, balanced_accuracy, ai_recall, real_recall, false_ai_rate, brier, ece10
  FROM rate JOIN means USING (suite) JOIN ece USING (suite))
UNPIVOT INCLUDE NULLS (value FOR metric IN (balanced_accuracy, ai_recall, real_recall, false_ai_rate, brier, ece10))""",
    ),
)
def q_metrics_by_suite(spark, sf):
    return rounded(metrics.metrics_long(metrics.cell_metrics(scores(spark, sf), ["suite"]), ["suite"]))


def _mixed_ctes(src: str) -> str:
    """``src`` with x0 and x1 mixed in steps, so that no expression repeats itself."""
    def step(shift: int, factor: int) -> str:
        return ", ".join(f"((xor({x}, {x} >> {shift}) * {factor}) & 4294967295) AS {x}" for x in ("x0", "x1"))

    return f"""m1 AS (SELECT * EXCLUDE (x0, x1), {step(16, 0x7FEB352D)} FROM {src}),
m2 AS (SELECT * EXCLUDE (x0, x1), {step(15, 0x846CA68B)} FROM m1),
drawn AS (SELECT * EXCLUDE (x0, x1), (xor(x0, x0 >> 16) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u1,
                 (xor(x1, x1 >> 16) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u2 FROM m2)"""


def boot_ctes(replicas: int, src: str = "scores") -> str:
    """rr with the six fields of every replica of a suite, and ci with mean, lo and hi."""
    step, stream = bootstrap.REPLICA_STEP, bootstrap.STREAM_STEP
    start = [f"(base + rep * {step}::UBIGINT + (2 * (1 - y) + {k}) * {stream}::UBIGINT) & 4294967295 AS x{k}" for k in (0, 1)]
    return f"""cells AS (SELECT suite, p, y, count(*)::DOUBLE AS m,
    concat('0x', substr(md5(concat_ws(':', '0', suite, floor(p * 1099511627776.0::DOUBLE)::BIGINT)), 1, 8))::UBIGINT AS base
  FROM {src} WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY suite, p, y),
starts AS (SELECT suite, p, y, m, rep, {', '.join(start)}
  FROM (SELECT c.*, t.rep::UBIGINT AS rep FROM cells c CROSS JOIN range({replicas}) t(rep))),
{_mixed_ctes('starts')},
weighted AS (SELECT suite, p, y, rep, greatest(0.0, floor(m + sqrt(m) * z + (z * z - 1) / 6 + 0.5 - 0.025 / m)) AS w
  FROM (SELECT *, sqrt(-2.0 * ln(u1)) * cos({2 * 3.141592653589793!r} * u2) AS z FROM drawn)),
rc AS (SELECT suite, rep, p, sum(w) AS n, sum(w * y) AS pos FROM weighted GROUP BY ALL),
rw AS (SELECT *, coalesce(sum(n - pos) OVER (PARTITION BY suite, rep ORDER BY p
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM rc),
rep AS (SELECT suite, rep, coalesce(sum(pos) FILTER (p >= 0.65), 0) AS tp, coalesce(sum(pos) FILTER (p < 0.65), 0) AS fn,
       coalesce(sum(n - pos) FILTER (p >= 0.65), 0) AS fp, coalesce(sum(n - pos) FILTER (p < 0.65), 0) AS tn,
       sum(pos) AS n_ai, sum(n - pos) AS n_real,
       CASE WHEN sum(pos) > 0 AND sum(n - pos) > 0
            THEN sum(pos * (below + (n - pos) / 2)) / (sum(pos) * sum(n - pos)) END AS auroc,
       CASE WHEN sum(n) > 0 THEN sum(pos * (p - 1) * (p - 1) + (n - pos) * p * p) / sum(n) END AS brier FROM rw GROUP BY suite, rep),
rr AS (SELECT suite, rep, auroc::DOUBLE AS auroc, brier::DOUBLE AS brier, {RATE_COLS} FROM rep),
ci AS (SELECT suite, metric, avg(value) AS mean, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi
  FROM rr UNPIVOT INCLUDE NULLS (value FOR metric IN (balanced_accuracy, ai_recall, real_recall, false_ai_rate, auroc, brier))
  GROUP BY suite, metric)"""


def _boot_sql(replicas: int) -> str:
    head = with_ctes("scores", body="").rstrip()
    return f"{head},\n{boot_ctes(replicas)}\nSELECT suite, metric, {r('mean')} AS mean, {r('lo')} AS lo, {r('hi')} AS hi FROM ci"


@query("bootstrap_ci", _boot_sql(bootstrap.REPLICAS))
def q_bootstrap(spark, sf):
    return rounded(bootstrap.bootstrap_ci(scores(spark, sf), ["suite"]))


SIX = "balanced_accuracy, ai_recall, real_recall, false_ai_rate, brier, ece10"


@query(
    "scorecard_report",
    metric_sql(
        "suite",
        f"""SELECT v.suite, v.metric, {r('v.value')} AS value, {r('ci.lo')} AS lo, {r('ci.hi')} AS hi FROM (
  SELECT * FROM (SELECT suite, {SIX} FROM rate JOIN means USING (suite) JOIN ece USING (suite))
  UNPIVOT INCLUDE NULLS (value FOR metric IN ({SIX}))) v LEFT JOIN ci ON v.suite = ci.suite AND v.metric = ci.metric""",
        extra=boot_ctes(bootstrap.REPLICAS) + ",",
    ),
)
def q_scorecard(spark, sf):
    return rounded(reports.scorecard_report(scores(spark, sf), ["suite"]))


HOLES = """holes AS (SELECT id, suite, source, CASE WHEN id % 7 = 3 THEN NULL ELSE y END AS y, CASE WHEN id % 5 = 2 THEN NULL ELSE p END AS p FROM scores),
whole AS (SELECT * FROM holes WHERE p IS NOT NULL AND y IS NOT NULL),"""


@query(
    "unscored_rows",
    metric_sql(
        "source",
        f"""SELECT u.source, n_rows, n_unscored, rate.n, {', '.join(f'{r(c)} AS {c}' for c in ('ai_recall', 'real_recall', 'brier', 'ece10', 'auroc', 'auprc', 'even'))},
  {r('recall.a')} AS ai_recall_at_fpr_0_005
FROM (SELECT source, count(*) AS n_rows, count(*) FILTER (p IS NULL OR y IS NULL) AS n_unscored FROM holes GROUP BY source) u
JOIN rate USING (source) JOIN means USING (source) JOIN ece USING (source) JOIN curve USING (source) LEFT JOIN recall USING (source)
JOIN (SELECT source, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) END AS even
  FROM (SELECT source, y, rank() OVER (PARTITION BY source ORDER BY p) + (count(*) OVER (PARTITION BY source, p) - 1) / 2 AS rk FROM whole)
  GROUP BY source) USING (source)""",
        "whole",
        HOLES,
    ),
)
def q_unscored(spark, sf):
    """A fifth of the scores and a seventh of the classes are missing; ranks over rows and over cells leave them out."""
    df = scores(spark, sf).withColumn("p", F.when(F.col("id") % 5 != 2, F.col("p"))).withColumn("y", F.when(F.col("id") % 7 != 3, F.col("y")))
    record = metrics.metrics_full(df, ["source"]).select(
        "source", "n", "ai_recall", "real_recall", "brier", "ece10", "auroc", "auprc", "ai_recall_at_fpr_0_005"
    )
    even = metrics.cell_metrics(df, ["source"]).select("source", F.col("auroc_avg_rank").alias("even"))
    return rounded(metrics.unscored(df, ["source"]).join(record, "source").join(even, "source"))


@query(
    "score_profile",
    with_ctes(
        "scores",
        body=f"""SELECT d.source, count(p) AS n, {r('avg(p)')} AS mean_conf, min(p) AS min_conf, max(p) AS max_conf,
  {r('avg(CASE WHEN p IS NOT NULL THEN (p >= 0.65)::INT END)')} AS share_ai
FROM documents d LEFT JOIN scores s ON d.doc_id = s.id GROUP BY d.source""",
    ),
)
def q_score_profile(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "source")
    rows = docs.join(scores(spark, sf).select("id", "p"), "id", "left")
    return rounded(metrics.score_profile(rows, ["source"]))


@query(
    "inventory_counts",
    with_ctes("manifest", body="SELECT label, family, source, count(*) AS n FROM manifest GROUP BY ALL"),
)
def q_inventory(spark, sf):
    return quality.inventory_counts(manifest(spark, sf))


@query(
    "shift_report",
    metric_sql(
        "source",
        f"""SELECT source, rate.n, {', '.join(f'{r(c)} AS {c}' for c in ('false_ai_rate', 'ai_recall', 'real_recall', 'brier', 'mean_conf', 'ece10'))}
FROM rate JOIN means USING (source) JOIN ece USING (source)""",
    ),
)
def q_shift(spark, sf):
    return rounded(reports.shift_report(scores(spark, sf), ["source"]))


# score of an asset under a degradation: the clean score moved towards 0.5 plus hash noise
DEGRADE = (
    ("clean", 0.0), ("jpeg80", 0.1), ("jpeg60", 0.2), ("jpeg40", 0.3), ("resize0.75", 0.15), ("resize0.5", 0.3),
    ("blur1", 0.05), ("blur2", 0.1), ("noise0.02", 0.15), ("noise0.05", 0.25), ("web", 0.35),
)


def variant_scores(spark, sf):
    """(id, suite, source, y, variant, p, p_clean, flag) for every labelled document and degradation."""
    rows = scores(spark, sf).select("id", "suite", "source", "y", F.col("p").alias("p_clean"))
    kinds = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(s).alias("s")) for v, s in DEGRADE])
    rows = rows.withColumn("_k", F.explode(kinds)).select("*", "_k.variant", "_k.s").drop("_k")
    noise = unit_hash("v", F.col("variant"), F.col("id"))
    p = F.round(F.col("p_clean") * (1 - F.col("s")) + F.col("s") * noise, 6)
    flag = unit_hash("f", F.col("variant"), F.col("id")) < F.col("s") * 2
    return rows.withColumn("p", p).withColumn("flag", flag).drop("s")


VARIANT_CTE = f"""variants AS (
  SELECT id, suite, source, y, p AS p_clean, variant,
         round(p * (1 - s) + s * {u_sql("'v'", 'variant', 'id')}, 6) AS p2, {u_sql("'f'", 'variant', 'id')} < s * 2 AS flag
  FROM scores CROSS JOIN (VALUES {', '.join(f"('{v}', {s}::DOUBLE)" for v, s in DEGRADE)}) k(variant, s)),
vs AS (SELECT id, suite, source, y, p_clean, variant, p2 AS p, flag FROM variants),"""


def _deg_sql(body: str) -> str:
    return (
        with_ctes("scores", body="").rstrip()
        + ","
        + VARIANT_CTE
        + f"""
deg AS (SELECT variant, (tp / greatest(1, n_ai) + tn / greatest(1, n_real)) / 2 AS bal,
               tp / greatest(1, n_ai) AS ai_recall, tn / greatest(1, n_real) AS real_recall
        FROM (SELECT variant, {CONF} FROM vs GROUP BY variant)),
base AS (SELECT bal AS b0 FROM deg WHERE variant = 'clean')
{body}"""
    )


@query(
    "degradation_report",
    _deg_sql(
        f"""SELECT variant, {r('bal')} AS bal, {r('ai_recall')} AS ai_recall, {r('real_recall')} AS real_recall,
  {r('bal - b0')} AS delta FROM deg, base"""
    ),
)
def q_degradation(spark, sf):
    return rounded(reports.degradation_report(variant_scores(spark, sf)))


@query(
    "robustness_gate",
    _deg_sql(
        f"""SELECT {r('c')} AS clean_bal, {r('a')} AS clean_ai, {r('h')} AS hard_ai,
  coalesce(c >= 0.98 AND h >= 0.8 * a, false) AS passed
FROM (SELECT max(bal) FILTER (variant = 'clean') AS c, max(ai_recall) FILTER (variant = 'clean') AS a,
             max(ai_recall) FILTER (variant = 'jpeg60') AS h FROM deg)"""
    ),
)
def q_robustness(spark, sf):
    return rounded(reports.robustness_gate(reports.degradation_report(variant_scores(spark, sf))))


@query(
    "abstention_report",
    with_ctes(
        "scores",
        body=f"""SELECT suite, n, d AS n_decided, {r('1 - d / n')} AS abstain_rate,
  {r('CASE WHEN d > 0 THEN w / d END')} AS error_within_decided
FROM (SELECT suite, count(*) AS n, count(*) FILTER (p >= 0.65 OR p <= 0.35) AS d,
  count(*) FILTER ((p >= 0.65 OR p <= 0.35) AND (p >= 0.65) <> (y = 1)) AS w FROM scores GROUP BY suite)""",
    ),
)
def q_abstention(spark, sf):
    return rounded(reports.abstention_report(scores(spark, sf), ["suite"]))


CELLS = """cells AS (SELECT variant, count(*) AS n, count(*) FILTER ((p >= 0.65) <> (y = 1)) AS wrong_baseline,
  count(*) FILTER ((p >= 0.65) <> (y = 1) AND flag) AS wrong_abstained,
  count(*) FILTER ((p >= 0.65) <> (y = 1) AND NOT flag) AS wrong_decided, count(*) FILTER (flag) AS n_abstained
  FROM vs GROUP BY variant)"""


def _cells_sql(body: str) -> str:
    return with_ctes("scores", body="").rstrip() + "," + VARIANT_CTE + CELLS + "\n" + body


@query(
    "abstention_cells",
    _cells_sql(
        f"""SELECT *, {r('wrong_decided / greatest(1, n - n_abstained)')} AS decided_error,
  {r('n_abstained / n')} AS abstain_rate FROM cells"""
    ),
)
def q_abstention_cells(spark, sf):
    return rounded(reports.abstention_cells(variant_scores(spark, sf), "variant"))


@query(
    "abstention_gates",
    _cells_sql(
        f"""SELECT {r('a')} AS wrong_abstained_share, {r('d')} AS decided_error, {r('q')} AS abstain_rate,
  a >= 0.90 AS gate_abstained, d <= 0.05 AS gate_decided, q <= 0.85 AS gate_rate
FROM (SELECT sum(wrong_abstained) / greatest(1, sum(wrong_baseline)) AS a,
  sum(wrong_decided) / greatest(1, sum(n) - sum(n_abstained)) AS d, sum(n_abstained) / greatest(1, sum(n)) AS q FROM cells)"""
    ),
)
def q_abstention_gates(spark, sf):
    return rounded(reports.abstention_gates(reports.abstention_cells(variant_scores(spark, sf), "variant")))


@query(
    "suite_line",
    metric_sql(
        "suite",
        f"""SELECT suite, rate.n, n_ai, n_real,
  {r('coalesce(balanced_accuracy, CASE WHEN n_ai > 0 THEN ai_recall ELSE real_recall END)')} AS bal_acc,
  {', '.join(f'{r(c)} AS {c}' for c in ('ai_recall', 'real_recall', 'brier', 'ece10', 'mean_conf'))}
FROM rate JOIN means USING (suite) JOIN ece USING (suite)""",
        "one",
        # suites of one class come from splitting every suite by class as well
        "one AS (SELECT id, y, p, suite FROM scores UNION ALL SELECT id, y, p, suite || ':' || y FROM scores),",
    ),
)
def q_suite_line(spark, sf):
    base = scores(spark, sf).select("id", "y", "p", "suite")
    single = base.withColumn("suite", F.concat_ws(":", "suite", F.col("y").cast("string")))
    return rounded(reports.suite_line(base.unionByName(single), ["suite"]))


def _auc(where: str, alias: str) -> str:
    return f"""{alias} AS (SELECT variant, count(*) AS n, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN
  (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) END AS auroc
FROM (SELECT variant, y, rank() OVER (PARTITION BY variant ORDER BY p) + (count(*) OVER (PARTITION BY variant, p) - 1) / 2 AS rk
      FROM vs {where}) GROUP BY variant)"""


@query(
    "overlap_zone_auroc",
    with_ctes("scores", body="").rstrip()
    + ","
    + VARIANT_CTE
    + _auc("", "a")
    + ","
    + _auc("WHERE p_clean BETWEEN 0.3 AND 0.8", "b")
    + f"""
SELECT variant, a.n AS n_all, {r('a.auroc')} AS auroc_all, coalesce(b.n, 0) AS n_overlap, {r('b.auroc')} AS auroc_overlap
FROM a LEFT JOIN b USING (variant)""",
)
def q_overlap(spark, sf):
    return rounded(metrics.overlap_zone_auroc(variant_scores(spark, sf), ["variant"]))


@query(
    "latency_percentiles",
    with_ctes(
        "telemetry",
        body="""SELECT kind, count(*) AS n, max(v) FILTER (k = n // 2) AS p50,
  max(v) FILTER (k = least(n - 1, floor(n * 0.95::DOUBLE))) AS p95, max(v) AS max
FROM (SELECT kind, latency_ms AS v, row_number() OVER (PARTITION BY kind ORDER BY latency_ms) - 1 AS k,
             count(*) OVER (PARTITION BY kind) AS n FROM telemetry WHERE latency_ms IS NOT NULL) GROUP BY kind""",
    ),
)
def q_latency(spark, sf):
    return reports.latency_percentiles(telemetry(spark, sf), ["kind"])


@query(
    "operating_point",
    with_ctes(
        "scores",
        body=f"""SELECT suite, (arg_max(v, (v.ai, v.t))).t AS t, {r('(arg_max(v, (v.ai, v.t))).ai')} AS ai_recall,
  {r('(arg_max(v, (v.ai, v.t))).re')} AS real_recall
FROM (SELECT c.suite, CASE WHEN count(*) FILTER (s.y = 0 AND s.p < c.t) / nullif(count(*) FILTER (s.y = 0), 0) >= 0.98
   THEN {{'ai': count(*) FILTER (s.y = 1 AND s.p >= c.t) / greatest(1, count(*) FILTER (s.y = 1)), 't': c.t,
          're': count(*) FILTER (s.y = 0 AND s.p < c.t) / nullif(count(*) FILTER (s.y = 0), 0)}} END AS v
  FROM (SELECT DISTINCT suite, p AS t FROM scores) c JOIN scores s ON s.suite = c.suite GROUP BY c.suite, c.t)
GROUP BY suite""",
    ),
)
def q_operating_point(spark, sf):
    from assay.operators.sampling import operating_point

    return rounded(operating_point(scores(spark, sf), ["suite"]))


@query(
    "ordinal_ranks",
    with_ctes(
        "scores",
        body="""SELECT suite, id, row_number() OVER (PARTITION BY suite ORDER BY p_tied, md5(id::VARCHAR)) AS rank_asc,
  row_number() OVER (PARTITION BY suite ORDER BY p_tied DESC, md5(id::VARCHAR)) AS rank_desc FROM scores""",
    ),
)
def q_ordinal_ranks(spark, sf):
    df = ranks.ordinal_ranks(scores(spark, sf), ["suite"], p="p_tied")
    return df.select("suite", "id", "rank_asc", "rank_desc")


@query(
    "sink_report",
    metric_sql("suite", f"SELECT suite, {r('balanced_accuracy')} AS bal, {r('brier')} AS brier FROM rate JOIN means USING (suite)"),
)
def q_sink_report(spark, sf):
    """Write the nested report and read it back."""
    from assay.session import scratch_dir

    path = scratch_dir(spark)
    report = reports.bundle_report(rounded(metrics.cell_metrics(scores(spark, sf), ["suite"])), ["suite"])
    sinks.write_report(report, path)
    back = spark.read.schema("suite string, metrics struct<balanced_accuracy:double,brier:double>").json(path)
    return back.select("suite", F.col("metrics.balanced_accuracy").alias("bal"), F.col("metrics.brier").alias("brier"))
