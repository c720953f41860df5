"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions.provenance import SOURCE_META
from assay.operators import bootstrap, joins, reports
from assay.plans.base import query, r, rounded
from assay.plans.proxies import assets, case_sql, manifest, scores, table, with_ctes
from assay.plans.q_metrics import boot_ctes, metric_ctes


@query(
    "join_scores_labels",
    """SELECT s.doc_id AS id, s.n_chars AS score, l.quality AS y FROM documents s JOIN labels l ON s.doc_id = l.doc_id""",
)
def q_join(spark, sf):
    left = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("score"))
    right = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    return joins.join_scores_labels(left, right)


@query(
    "score_coverage",
    """SELECT CASE WHEN s.doc_id IS NULL THEN 'label_only' WHEN l.doc_id IS NULL THEN 'score_only' ELSE 'matched' END AS side,
  count(*) AS n FROM documents s FULL JOIN labels l ON s.doc_id = l.doc_id GROUP BY 1""",
)
def q_coverage(spark, sf):
    left = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    right = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return joins.score_coverage(left, right)


DONE_SQL = """done AS (SELECT DISTINCT r_name AS model, l_partkey AS prompt_id FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def done_jobs(spark, sf):
    """(model, prompt_id) pairs of a region that already supplied a part."""
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sup = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    items = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_partkey").alias("prompt_id"))
    return items.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("r_name").alias("model"), "prompt_id")


@query(
    "job_matrix",
    f"""WITH {DONE_SQL} SELECT r_name AS model, p_partkey AS prompt_id, p_name AS prompt FROM part CROSS JOIN region
WHERE NOT EXISTS (SELECT 1 FROM done WHERE model = r_name AND prompt_id = p_partkey)""",
)
def q_job_matrix(spark, sf):
    """Regions stand for models, parts for prompts."""
    prompts = table(spark, sf, "part").select(F.col("p_partkey").alias("prompt_id"), F.col("p_name").alias("prompt"))
    models = table(spark, sf, "region").select(F.col("r_name").alias("model"))
    return joins.job_matrix(prompts, models, done_jobs(spark, sf))


@query(
    "resume_filter",
    """SELECT o_orderkey AS prompt_id FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY 1 LIMIT 500""",
)
def q_resume(spark, sf):
    """Orders stand for prompts, returned items for the manifest of finished ones."""
    prompts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("prompt_id"))
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("prompt_id"))
    return joins.resume_filter(prompts, done, limit=500)


FAMILY_CASE = case_sql("source", {s: m[0] for s, m in SOURCE_META.items()}, "'unknown'")
LICENSE_CASE = case_sql("source", {s: m[1] for s, m in SOURCE_META.items()}, "'unknown'")


@query(
    "provenance_join",
    with_ctes(
        "manifest", body=f"SELECT doc_id, source, {FAMILY_CASE} AS family, {LICENSE_CASE} AS license FROM manifest"
    ),
)
def q_provenance_join(spark, sf):
    df = manifest(spark, sf).select("doc_id", "source")
    return joins.provenance_join(df).select("doc_id", "source", "family", "license")


_FIELDS = "balanced_accuracy, ai_recall, real_recall, false_ai_rate, brier, ece10"


def _long(name: str, src: str) -> str:
    """Long metric table of one model as a subquery with its own views."""
    return f"""{name} AS (WITH {metric_ctes('suite', src)}
  SELECT suite, metric, value FROM (SELECT suite, {_FIELDS} FROM rate JOIN means USING (suite) JOIN ece USING (suite))
  UNPIVOT INCLUDE NULLS (value FOR metric IN ({_FIELDS})))"""


def _intervals(name: str, src: str) -> str:
    return f"{name} AS (WITH {boot_ctes(bootstrap.REPLICAS, src)} SELECT * FROM ci)"


@query(
    "compare_models",
    with_ctes("scores", body="").rstrip()
    + ",\nsb AS (SELECT id, suite, y, p_b AS p FROM scores),\n"
    + _long("base_long", "scores")
    + ",\n"
    + _long("cand_long", "sb")
    + ",\n"
    + _intervals("base_ci", "scores")
    + ",\n"
    + _intervals("cand_ci", "sb")
    + f"""
SELECT b.suite, b.metric, {r('b.value')} AS base, {r('i.lo')} AS base_lo, {r('i.hi')} AS base_hi, {r('c.value')} AS candidate,
  {r('j.lo')} AS candidate_lo, {r('j.hi')} AS candidate_hi, {r('c.value - b.value')} AS delta
FROM base_long b JOIN cand_long c ON b.suite = c.suite AND b.metric = c.metric
LEFT JOIN base_ci i ON b.suite = i.suite AND b.metric = i.metric LEFT JOIN cand_ci j ON b.suite = j.suite AND b.metric = j.metric""",
)
def q_compare(spark, sf):
    df = scores(spark, sf)
    other = df.drop("p").withColumnRenamed("p_b", "p")
    base, cand = (reports.scorecard_report(x, ["suite"]) for x in (df, other))
    return rounded(joins.compare_models(base, cand, ["suite"]))


@query(
    "score_parity",
    with_ctes(
        "scores",
        body=f"""SELECT suite, n, missing, {r('mx')} AS max_delta, {r('sm / n')} AS mean_delta, agree,
  missing = 0 AND agree >= 0.98 * n AND sm / n < 0.05 AS passed
FROM (SELECT e.suite, count(*) AS n, count(*) FILTER (o.p IS NULL) AS missing,
  coalesce(max(abs(o.p - e.p)), 0.0) AS mx, coalesce(sum(abs(o.p - e.p)), 0.0) AS sm,
  count(*) FILTER (o.p IS NOT NULL AND (o.p >= 0.65) = (e.p >= 0.65)) AS agree
  FROM scores e LEFT JOIN (SELECT id, round(p, 2) AS p FROM scores WHERE NOT (suite = 'de' AND y = 0)) o ON e.id = o.id
  GROUP BY e.suite)""",
    ),
)
def q_parity(spark, sf):
    """Scores rounded to whole percents stand for the observed ones; one slice of a suite was never seen."""
    expected = scores(spark, sf).select("id", "suite", "p")
    seen = scores(spark, sf).where(~((F.col("suite") == "de") & (F.col("y") == 0)))
    observed = seen.select("id", F.round("p", 2).alias("p"))
    return rounded(joins.score_parity(expected, observed, "id", ["suite"]))


@query(
    "sealed_tag_join",
    """SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))""",
)
def q_sealed_passages(spark, sf):
    """Texts that contain a sealed passage; the passage table grows with the data, so it is an anchored equi-join."""
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return joins.sealed_passage_join(docs, bench, "doc_id", "text", "item_id", "text")


@query(
    "sealed_path_tags",
    with_ctes(
        "assets",
        body="""SELECT doc_id, path, tag FROM assets JOIN (VALUES ('data/eval'), ('holdout2'), ('bench_pub'), ('holdout_oos')) t(tag)
ON contains(lower(path), tag)""",
    ),
)
def q_sealed_paths(spark, sf):
    return joins.sealed_tag_hits(assets(spark, sf).select("doc_id", "path"))


NEVER_TRAIN = ("eval", "holdout_oos", "bench_pub/**", "train_extra/*/en/1?.jpg")


@query(
    "glob_policy_join",
    with_ctes(
        "assets",
        body="""SELECT doc_id, path, "glob" FROM assets JOIN (VALUES ('eval', '(.*/)?eval(/.*)?'),
  ('holdout_oos', '(.*/)?holdout_oos(/.*)?'), ('bench_pub/**', '(.*/)?bench_pub/.*'),
  ('train_extra/*/en/1?.jpg', '(.*/)?train_extra/[^/]*/en/1[^/][.]jpg')) g("glob", pattern)
ON regexp_full_match(path, pattern)""",
    ),
)
def q_glob(spark, sf):
    return joins.glob_policy_join(assets(spark, sf).select("doc_id", "path"), list(NEVER_TRAIN))


@query(
    "artifact_audit",
    with_ctes(
        "assets",
        body="""SELECT name, problem FROM (
  SELECT a.doc_id::VARCHAR AS name, unnest(list_filter([
    CASE WHEN quality IS NOT NULL AND doc_id % 7 = 0 THEN 'missing from manifest' END,
    CASE WHEN quality IS NOT NULL AND doc_id % 7 = 1 THEN 'bad sha256' END,
    CASE WHEN quality IS NOT NULL AND doc_id % 7 = 2 THEN 'input shape' END,
    CASE WHEN quality IS NOT NULL AND doc_id % 7 IN (1, 3) THEN 'hash mismatch' END,
    CASE WHEN quality IS NOT NULL AND doc_id % 7 = 4 THEN 'size mismatch' END,
    CASE WHEN quality IS NULL THEN 'not expected' END], lambda x: x IS NOT NULL)) AS problem FROM assets a)""",
    ),
)
def q_artifact_audit(spark, sf):
    """Labelled documents are the expected artifacts; their declared entries carry planted faults by id."""
    a = assets(spark, sf).withColumn("name", F.col("doc_id").cast("string"))
    kind = F.col("doc_id") % 7
    sha = F.when(kind == 1, F.substring("sha256", 1, 40)).when(kind == 3, F.reverse("sha256")).otherwise(F.col("sha256"))
    side = F.when(kind == 2, "256").otherwise("384")
    declared = a.where(~((kind == 0) & F.col("quality").isNotNull())).select(
        "name",
        (F.col("size_bytes") + (kind == 4).cast("long")).alias("size_bytes"),
        sha.alias("sha256"),
        F.array(F.lit("N"), F.lit("3"), F.lit("384"), side).alias("input_shape"),
    )
    expected = a.where(F.col("quality").isNotNull()).select("name")
    disk = a.select("name", F.col("size_bytes").alias("length"), F.col("sha256").alias("disk_sha256"))
    return joins.artifact_audit(expected, declared, disk)
