"""Dedup, splits, samples, mining and threshold search."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions.hashing import unit_hash
from assay.operators import ranks, sampling
from assay.plans.base import query, r, rounded
from assay.plans.proxies import manifest, scores, table, u_sql, with_ctes
from assay.plans.q_metrics import VARIANT_CTE, variant_scores


def rn(by: str, key: str = "path", seed: str = "0") -> str:
    return f"row_number() OVER (PARTITION BY {by} ORDER BY md5(concat_ws(':', '{seed}', {key})), {key})"


def size(by: str) -> str:
    return f"count(*) OVER (PARTITION BY {by})"


@query(
    "dedup_exact",
    with_ctes(
        "manifest",
        body="""SELECT doc_id, path, sha256 FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY NOT sealed, path) AS k
  FROM (SELECT *, CASE WHEN quality = 0 THEN '' ELSE sha256 END AS h FROM manifest)) WHERE h = '' OR k = 1""",
    ),
)
def q_dedup_exact(spark, sf):
    """Rows of quality 0 stand for rows whose hash was skipped."""
    df = manifest(spark, sf).withColumn("h", F.when(F.col("quality") == 0, "").otherwise(F.col("sha256")))
    order = [~F.col("sealed"), F.col("path")]
    return sampling.dedup_exact(df, "h", order, ["doc_id", "path", "sha256"]).drop("h")


@query(
    "dedup_prefix",
    with_ctes(
        "manifest",
        body="""SELECT doc_id, path, CASE WHEN strlen(content) > 0 THEN 1 END AS n_merged FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY path) AS k
  FROM manifest) WHERE k = 1 OR strlen(content) = 0""",
    ),
)
def q_dedup_prefix(spark, sf):
    return sampling.dedup_prefix(manifest(spark, sf), "content", [F.col("path")], ["doc_id", "path"])


@query(
    "split_stratified",
    with_ctes(
        "manifest",
        body=f"""SELECT doc_id, 'sealed' AS split FROM manifest WHERE sealed UNION ALL
SELECT doc_id, CASE WHEN {rn('source, label')} <= greatest(1, round_even({size('source, label')} * 0.2::DOUBLE, 0)) THEN 'dev' ELSE 'train' END
FROM manifest WHERE NOT sealed""",
    ),
)
def q_split(spark, sf):
    df = manifest(spark, sf).select("doc_id", "path", "source", "label", "sealed")
    out = sampling.split_stratified(df, ["source", "label"], sealed=F.col("sealed"))
    return out.select("doc_id", "split")


@query(
    "split_stratified_floor",
    with_ctes(
        "manifest",
        body=f"""SELECT doc_id, CASE WHEN {rn('doc_source')} <= greatest(1, {size('doc_source')} // 5) THEN 'val' ELSE 'train' END AS split
FROM manifest""",
    ),
)
def q_split_floor(spark, sf):
    df = manifest(spark, sf).select("doc_id", "path", "doc_source")
    return sampling.split_stratified_floor(df, ["doc_source"]).select("doc_id", "split")


@query(
    "split_fixed",
    with_ctes(
        "manifest",
        body=f"""SELECT doc_id, label, CASE WHEN k <= 150 THEN 'eval' ELSE 'train' END AS split
FROM (SELECT doc_id, label, {rn('label')} AS k FROM manifest) WHERE k <= 300""",
    ),
)
def q_split_fixed(spark, sf):
    df = manifest(spark, sf).select("doc_id", "path", "label")
    return sampling.split_fixed(df, ["label"]).select("doc_id", "label", "split")


@query(
    "sample_per_class",
    with_ctes(
        "manifest",
        body=f"""SELECT lang, doc_id, label FROM (SELECT lang, doc_id, label, {rn('lang, label')} AS k FROM (
  SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY path) AS c FROM manifest) WHERE c = 1) WHERE k <= 40""",
    ),
)
def q_sample_per_class(spark, sf):
    df = manifest(spark, sf)
    unique = sampling.dedup_exact(df, "sha256", [F.col("path")], ["doc_id", "path", "lang", "label"])
    return sampling.sample_per_class(unique, 40, by=["lang"]).select("lang", "doc_id", "label")


@query(
    "sample_case",
    with_ctes(
        "manifest",
        body="""SELECT doc_source, count(*) FILTER (l = 'ai') AS n_ai, count(*) FILTER (l = 'real') AS n_real,
  CASE WHEN count(*) FILTER (l = 'ai') > 0 AND count(*) FILTER (l = 'real') > 0 THEN 'both'
       WHEN count(*) FILTER (l = 'ai') > 0 THEN 'fake-only' WHEN count(*) FILTER (l = 'real') > 0 THEN 'real-only'
       ELSE 'label issue' END AS sample_case
FROM (SELECT doc_source, CASE WHEN family = 'unknown' THEN NULL ELSE label END AS l FROM manifest) GROUP BY doc_source""",
    ),
)
def q_sample_case(spark, sf):
    df = manifest(spark, sf).withColumn("label", F.when(F.col("family") != "unknown", F.col("label")))
    return sampling.sample_case(df, ["doc_source"])


@query(
    "sample_balanced_epoch",
    with_ctes(
        "manifest",
        body=f"""SELECT epoch, doc_id, label FROM (
  SELECT epoch, doc_id, label, {rn('epoch, label', 'ek')} AS k, least(4000,
    count(*) FILTER (label = 'ai') OVER (PARTITION BY epoch), count(*) FILTER (label = 'real') OVER (PARTITION BY epoch)) AS q
  FROM (SELECT doc_id, label, epoch, concat_ws('/', epoch, path) AS ek FROM manifest CROSS JOIN (VALUES (0), (1), (2)) e(epoch)))
WHERE k <= q""",
    ),
)
def q_sample_epoch(spark, sf):
    df = manifest(spark, sf).select("doc_id", "path", "label")
    return sampling.sample_balanced_epoch(df, 3).select("epoch", "doc_id", "label")


@query(
    "cap_per_source",
    with_ctes(
        "manifest",
        body=f"""SELECT source, doc_id FROM (SELECT source, doc_id, {rn('source')} AS k FROM manifest)
WHERE k <= CASE source WHEN 'cf_fakes' THEN 20 WHEN 'ffhq' THEN 35 WHEN 'mj2' THEN 0 ELSE 45 END""",
    ),
)
def q_cap(spark, sf):
    df = manifest(spark, sf).select("doc_id", "path", "source")
    caps = {"cf_fakes": 20, "ffhq": 35, "mj2": 0}
    return sampling.cap_per_source(df, ["source"], caps, default=45).select("source", "doc_id")


@query(
    "sample_systematic",
    """SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part)
WHERE i IN (SELECT (7 + j * (n // 100)) % n FROM range(100) t(j))""",
)
def q_systematic(spark, sf):
    return ranks.rows_at(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", 100, 7)


def scored_manifest(spark, sf):
    """(doc_id, path, source, split, label, p) of the labelled documents; label by quality."""
    m = manifest(spark, sf).where("quality is not null").select("doc_id", "path", "source", "quality", "sealed")
    s = scores(spark, sf).select(F.col("id").alias("doc_id"), "p")
    label = F.when(F.col("quality") == 1, "ai").otherwise("real")
    split = F.when(F.col("sealed"), "sealed").otherwise("dev")
    return m.join(s, "doc_id").select("doc_id", "path", "source", split.alias("split"), label.alias("label"), "p")


SCORED = """scored AS (SELECT m.doc_id, m.path, m.source, CASE WHEN m.sealed THEN 'sealed' ELSE 'dev' END AS split,
  CASE WHEN m.quality = 1 THEN 'ai' ELSE 'real' END AS label, s.p FROM manifest m JOIN scores s ON m.doc_id = s.id)"""
MINED = """mined AS (
  SELECT * FROM (SELECT * FROM scored WHERE split <> 'sealed' AND label = 'real' AND p >= 0.65 ORDER BY p DESC, path LIMIT 200)
  UNION ALL SELECT * FROM (SELECT * FROM scored WHERE split <> 'sealed' AND label = 'ai' AND p < 0.65 ORDER BY p, path LIMIT 200))"""


@query(
    "mine_hard",
    with_ctes("scores", "manifest", body="").rstrip()
    + f", {SCORED}, {MINED} SELECT path, source, split, label, {r('p', 4)} AS conf FROM mined",
)
def q_mine(spark, sf):
    out = sampling.mine_hard(scored_manifest(spark, sf))
    return rounded(out.select("path", "source", "split", "label", "conf"), 4)


LAP, BLOCK = f"{u_sql(chr(39) + 'lap' + chr(39), 'doc_id')} * 40", f"{u_sql(chr(39) + 'blk' + chr(39), 'doc_id')} * 9"
REASON = f"""reasons AS (SELECT *, CASE WHEN doc_id % 50 = 0 THEN 'review'
  WHEN lower(path) LIKE '%pair%' OR lower(path) LIKE '%matched%' OR lower(path) LIKE '%real%' THEN 'matched_pair'
  WHEN {BLOCK} > 6.0 THEN 'jpeg_artifact' WHEN {LAP} > 26.0 THEN 'camera_noise' WHEN {LAP} < 8.0 THEN 'generator'
  ELSE 'review' END AS reason FROM mined)"""


def reasons(spark, sf):
    """Mined rows with reason codes; the two signals are hash numbers, missing for every fiftieth document."""
    mined = sampling.mine_hard(scored_manifest(spark, sf))
    ok = F.col("doc_id") % 50 != 0
    lap = F.when(ok, unit_hash("lap", F.col("doc_id")) * 40)
    block = F.when(ok, unit_hash("blk", F.col("doc_id")) * 9)
    return mined.withColumn("reason", sampling.hard_reason(F.col("path"), lap, block))


_MINED_HEAD = with_ctes("scores", "manifest", body="").rstrip() + f", {SCORED}, {MINED}, {REASON}"


@query("hard_reason", _MINED_HEAD + " SELECT path, reason FROM reasons")
def q_reason(spark, sf):
    return reasons(spark, sf).select("path", "reason")


@query(
    "hard_histograms",
    _MINED_HEAD
    + """ SELECT 'reason' AS kind, reason AS value, count(*) AS n FROM reasons GROUP BY reason
UNION ALL SELECT 'source', source, count(*) FROM reasons GROUP BY source""",
)
def q_histograms(spark, sf):
    return sampling.hard_histograms(reasons(spark, sf))


@query(
    "append_hard_capped",
    _MINED_HEAD
    + f""", train AS (SELECT label, source, path FROM manifest WHERE NOT sealed AND quality IS NULL),
t AS (SELECT source, count(*) AS k FROM train GROUP BY source)
SELECT label, source, path FROM train UNION ALL
SELECT label, 'hard:' || source, path FROM (
  SELECT h.label, h.source, h.path, {rn('h.source', 'h.path')} AS k, greatest(200, 2 * greatest(1, coalesce(t.k, 0))) AS q
  FROM reasons h LEFT JOIN t ON h.source = t.source WHERE h.path <> '') WHERE k <= q""",
)
def q_append(spark, sf):
    """Unlabelled documents stand for the ordinary training rows."""
    train = manifest(spark, sf).where(~F.col("sealed") & F.col("quality").isNull()).select("label", "source", "path")
    hard = reasons(spark, sf).select("label", "source", "path", "reason")
    return sampling.append_hard_capped(train, hard)


@query(
    "threshold_sweep",
    with_ctes(
        "scores",
        body=f"""SELECT suite, t.i::INT AS i, {r('t.i / 200')} AS t,
  {r('count(*) FILTER (y = 1 AND p >= t.i / 200) / nullif(count(*) FILTER (y = 1), 0)')} AS recall,
  {r('count(*) FILTER (y = 0 AND p >= t.i / 200) / nullif(count(*) FILTER (y = 0), 0)')} AS fpr
FROM scores CROSS JOIN range(201) t(i) GROUP BY suite, t.i""",
    ),
)
def q_sweep(spark, sf):
    return rounded(sampling.threshold_sweep(scores(spark, sf), ["suite"]))


@query(
    "threshold_pick",
    with_ctes(
        "scores",
        body=f"""SELECT suite, {r('b.t')} AS t, {r('b.recall')} AS recall, {r('b.fpr')} AS fpr FROM (
  SELECT suite, max({{'recall': recall, 't': t, 'fpr': fpr}}) FILTER (fpr <= 0.03) AS b FROM (
    SELECT suite, t.i / 200 AS t, count(*) FILTER (y = 1 AND p >= t.i / 200) / nullif(count(*) FILTER (y = 1), 0) AS recall,
      count(*) FILTER (y = 0 AND p >= t.i / 200) / nullif(count(*) FILTER (y = 0), 0) AS fpr
    FROM scores CROSS JOIN range(201) t(i) GROUP BY suite, t.i) GROUP BY suite)""",
    ),
)
def q_pick(spark, sf):
    sweep = sampling.threshold_sweep(scores(spark, sf), ["suite"])
    return rounded(sampling.sweep_pick(sweep, ["suite"]))


DELTAS = ("jpeg80", "jpeg60", "resize0.5", "blur2")
CROP_VARIANTS = ("noise0.02", "noise0.05", "jpeg40", "web", "resize0.75")


def responses(spark, sf):
    """Response vectors; five of the variants stand for the crops, the last one for the centre."""
    out = sampling.response_deltas(variant_scores(spark, sf), "id", list(DELTAS), list(CROP_VARIANTS), CROP_VARIANTS[-1])
    return out.select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in out.columns])


def _max(v: str) -> str:
    return f"max(p) FILTER (variant = '{v}')"


_CLEAN = _max("clean")
_DELTA_COLS = ", ".join(r(_max(v) + " - " + _CLEAN) + " AS d_" + v.replace(".", "_") for v in DELTAS)
_IN_CROPS = "variant IN (" + ", ".join(f"'{v}'" for v in CROP_VARIANTS) + ")"


@query(
    "response_deltas",
    with_ctes("scores", body="").rstrip()
    + ","
    + VARIANT_CTE.rstrip(",")
    + f"""
, centred AS (SELECT *, max(p) FILTER (variant = 'resize0.75') OVER (PARTITION BY id) AS mid FROM vs)
SELECT id, {_CLEAN} AS p_clean,
  {_DELTA_COLS},
  {r(f'stddev_pop(p) FILTER ({_IN_CROPS})')} AS crop_std, {r(f'max(abs(p - mid)) FILTER ({_IN_CROPS})')} AS max_crop_delta
FROM centred GROUP BY id""",
)
def q_responses(spark, sf):
    return rounded(responses(spark, sf))
