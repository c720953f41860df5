"""Projections and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import scalars as s
from assay.functions.containers import has_exif_marker
from assay.functions.hashing import unit_hash
from assay.functions.provenance import classify_provenance
from assay.operators import joins, prompts
from assay.plans.base import query, r, rounded
from assay.plans.proxies import ROOT, assets, grids, jpeg_file, manifest, png_file, scores, table, u_sql, with_ctes
from assay.sources import sinks

STATE = "CASE WHEN p >= 0.65 THEN 'ai' WHEN p < 0.35 THEN 'real' ELSE 'uncertain' END"


@query(
    "encode_label",
    with_ctes("manifest", body="SELECT doc_id, label, (label = 'ai')::INT AS y FROM manifest"),
)
def q_encode(spark, sf):
    return manifest(spark, sf).select("doc_id", "label", s.encode_label(F.col("label")).alias("y"))


WORDS = "['AI', 'fake', 'Real', 'TRUE', 'synthetic', 'gen', '1', '0', 'photo']"


@query(
    "normalize_label",
    with_ctes(
        "assets",
        body=f"""SELECT doc_id, raw,
  CASE WHEN lower(raw) IN ('ai','fake','1','true','synthetic','gen') THEN 'ai' ELSE 'real' END AS bench,
  CASE WHEN lower(raw) IN ('ai','fake','1','true','synthetic') THEN 'ai' ELSE 'real' END AS extract,
  CASE WHEN quality = 1 THEN 'ai' ELSE 'real' END AS numeric_label,
  CASE WHEN quality = 1 THEN 'ai' ELSE 'real' END AS boolean_label
FROM (SELECT doc_id, quality, ({WORDS})[floor({u_sql("'w'", 'doc_id')} * 10)::INT + 1] AS raw FROM assets)""",
    ),
)
def q_normalize(spark, sf):
    words = F.array(*[F.lit(w) for w in ("AI", "fake", "Real", "TRUE", "synthetic", "gen", "1", "0", "photo")])
    raw = F.get(words, F.floor(unit_hash("w", F.col("doc_id")) * 10).cast("int"))
    df = assets(spark, sf).select("doc_id", "quality", raw.alias("raw"))
    return df.select(
        "doc_id",
        "raw",
        s.normalize_label(F.col("raw")).alias("bench"),
        s.normalize_label(F.col("raw"), variant="extract").alias("extract"),
        s.normalize_label(F.col("quality"), "int").alias("numeric_label"),
        s.normalize_label(F.col("quality") == 1, "boolean").alias("boolean_label"),
    )


@query(
    "source_of_path",
    with_ctes(
        "assets",
        body="""SELECT doc_id, path, CASE
  WHEN list_contains(p, 'real') THEN 'real:' || p[list_position(p, 'real') - 1]
  WHEN list_contains(p, 'ai') THEN 'ai:' || p[list_position(p, 'ai') - 1]
  ELSE 'unknown' END AS source FROM (SELECT doc_id, path, string_split(path, '/') AS p FROM assets)""",
    ),
)
def q_source_of_path(spark, sf):
    return assets(spark, sf).select("doc_id", "path", s.source_of_path(F.col("path")).alias("source"))


@query(
    "classify_provenance",
    with_ctes("manifest", body="SELECT doc_id, path, source, family, license, label FROM manifest"),
)
def q_classify(spark, sf):
    out = classify_provenance(assets(spark, sf), "path", [ROOT])
    return out.select("doc_id", "path", "source", "family", "license", "label")


@query("product_state", with_ctes("scores", body=f"SELECT id, p, {STATE} AS state FROM scores"))
def q_state(spark, sf):
    return scores(spark, sf).select("id", "p", s.product_state(F.col("p")).alias("state"))


@query(
    "fuse_scores",
    with_ctes(
        "scores",
        body=f"""SELECT id, max(p) AS p, {r('avg(p)', 7)} AS p_mean, count(p) AS n_models
FROM (SELECT id, p FROM scores UNION ALL SELECT id, p_b FROM scores) GROUP BY id""",
    ),
)
def q_fuse(spark, sf):
    wide = scores(spark, sf)
    long = wide.select("id", F.explode(F.array("p", "p_b")).alias("p"))
    mean = joins.fuse_scores(long, how="mean").select("id", F.col("p").alias("p_mean"))
    return rounded(joins.fuse_scores(long).join(mean, "id"), 7)


@query(
    "softmax_positive",
    with_ctes(
        "scores",
        body=f"""SELECT id, {r('exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b)))')} AS p_two,
  {r('1 / (1 + exp(-b))')} AS p_one FROM (SELECT id, 8 * (p - 0.5) AS a, 8 * (p_b - 0.5) AS b FROM scores)""",
    ),
)
def q_softmax(spark, sf):
    a, b = 8 * (F.col("p") - 0.5), 8 * (F.col("p_b") - 0.5)
    df = scores(spark, sf).select(
        "id", s.softmax_positive(F.array(a, b)).alias("p_two"), s.softmax_positive(F.array(b)).alias("p_one")
    )
    return rounded(df)


@query(
    "score_linear",
    with_ctes(
        "px",
        body=f"""SELECT id, {r('1 / (1 + exp(-(sum((v - 127.5) / (10.0 + i % 7) * (((i * 37 % 11) - 5) / 10.0)) + 0.25)))')} AS p
FROM px GROUP BY id""",
    ),
)
def q_score_linear(spark, sf):
    """A 64-weight model given by rule."""
    at = F.sequence(F.lit(0), F.lit(63))
    p = s.score_linear(
        F.col("grid"),
        F.transform(at, lambda i: F.lit(127.5)),
        F.transform(at, lambda i: 10.0 + i % 7),
        F.transform(at, lambda i: ((i * 37 % 11) - 5) / 10.0),
        F.lit(0.25),
    )
    return rounded(grids(spark, sf).select("id", p.alias("p")))


CLIP = "least(greatest(q, 1e-9), 1 - 1e-9)"


@query(
    "clipped_logit",
    with_ctes(
        "scores",
        body=f"""SELECT id, {r(f'ln({CLIP} / (1 - {CLIP}))')} AS logit
FROM (SELECT id, CASE WHEN p < 0.1 THEN 0.0 WHEN p > 0.9 THEN 1.0 ELSE p END AS q FROM scores)""",
    ),
)
def q_logit(spark, sf):
    q = F.when(F.col("p") < 0.1, 0.0).when(F.col("p") > 0.9, 1.0).otherwise(F.col("p"))
    return rounded(scores(spark, sf).select("id", s.clipped_logit(q).alias("logit")))


@query(
    "apply_temperature",
    with_ctes(
        "scores",
        body=f"""SELECT id, {r(f'1 / (1 + exp(-ln({CLIP} / (1 - {CLIP})) / 1.7))')} AS p_cal
FROM (SELECT id, p AS q FROM scores)""",
    ),
)
def q_temperature(spark, sf):
    return rounded(scores(spark, sf).select("id", s.apply_temperature(F.col("p"), 1.7).alias("p_cal")))


# link targets stand for images: side lengths come from the hash of the target
W_SQL = f"floor({u_sql(chr(39) + 'w' + chr(39), 'page_id', 'href')} * 2000)::INT"
H_SQL = f"floor({u_sql(chr(39) + 'h' + chr(39), 'page_id', 'href')} * 2000)::INT"
LINKS = f"""links AS (SELECT page_id, href, {W_SQL} AS width, {H_SQL} AS height
  FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages))"""


def links(spark, sf):
    df = prompts.page_links(table(spark, sf, "pages"))
    return df.select(
        "page_id",
        "href",
        F.floor(unit_hash("w", F.col("page_id"), F.col("href")) * 2000).cast("int").alias("width"),
        F.floor(unit_hash("h", F.col("page_id"), F.col("href")) * 2000).cast("int").alias("height"),
    )


@query(
    "image_eligible",
    f"""WITH {LINKS} SELECT page_id, href, width, height,
  least(width, height) >= 64 AND href <> '' AND NOT (starts_with(href, 'data:') AND length(href) < 800) AS eligible FROM links""",
)
def q_eligible(spark, sf):
    df = links(spark, sf)
    return df.withColumn("eligible", s.image_eligible(F.col("href"), F.col("width"), F.col("height")))


@query(
    "fit_side",
    f"""WITH {LINKS}, sized AS (SELECT page_id, href, width + 1 AS width, height + 1 AS height FROM links)
SELECT page_id, href, width, height,
  greatest(1, floor(width * least(1.0::DOUBLE, 768.0::DOUBLE / greatest(width, height)) + 0.5))::INT AS fit_w,
  greatest(1, floor(height * least(1.0::DOUBLE, 768.0::DOUBLE / greatest(width, height)) + 0.5))::INT AS fit_h FROM sized""",
)
def q_fit(spark, sf):
    df = links(spark, sf).withColumns({"width": F.col("width") + 1, "height": F.col("height") + 1})
    w, h = s.fit_side(F.col("width"), F.col("height"))
    return df.withColumn("fit_w", w).withColumn("fit_h", h)


@query(
    "resize_crop_geometry",
    f"""WITH {LINKS}, sized AS (SELECT page_id, href, width + 1 AS width, height + 1 AS height FROM links),
dims AS (SELECT *, 416.0::DOUBLE / least(width, height) AS k FROM sized),
n AS (SELECT *, greatest(1, round_even(width * k, 0))::INT AS new_w, greatest(1, round_even(height * k, 0))::INT AS new_h,
  greatest(1, floor(width * k + 0.5))::INT AS js_w, greatest(1, floor(height * k + 0.5))::INT AS js_h FROM dims)
SELECT page_id, href, new_w, new_h, floor((new_w - 384) / 2)::INT AS left_px, floor((new_h - 384) / 2)::INT AS top_px,
  js_w, js_h FROM n""",
)
def q_geometry(spark, sf):
    df = links(spark, sf).withColumns({"width": F.col("width") + 1, "height": F.col("height") + 1})
    g = s.resize_crop_geometry(F.col("width"), F.col("height"))
    js = s.resize_crop_geometry(F.col("width"), F.col("height"), half_even=False)
    return df.select(
        "page_id", "href", g["new_w"].alias("new_w"), g["new_h"].alias("new_h"), g["left"].alias("left_px"),
        g["top"].alias("top_px"), js["new_w"].alias("js_w"), js["new_h"].alias("js_h"),
    )


@query(
    "normalize_pixels",
    with_ctes("px", body=f"SELECT id, i, {r('(v / 255.0 - 0.456) / 0.224')} AS v FROM px"),
)
def q_pixels(spark, sf):
    df = grids(spark, sf).select("id", F.posexplode(s.normalize_pixels(F.col("grid"), 1)).alias("i", "v"))
    return rounded(df.select("id", F.col("i").cast("long").alias("i"), "v"))


@query(
    "badge_percent",
    with_ctes(
        "scores",
        body="""SELECT id, concat(CASE WHEN p >= 0.65 THEN 'AI' WHEN p < 0.35 THEN 'real' ELSE '?' END, ' ',
  floor(p * 100 + 0.5)::INT, '%') AS badge FROM scores""",
    ),
)
def q_badge(spark, sf):
    return scores(spark, sf).select("id", s.badge_text(F.col("p")).alias("badge"))


@query("has_exif_marker", "SELECT page_id, (page_id % 3 = 0)::INT::DOUBLE AS exif_present FROM pages")
def q_exif(spark, sf):
    """Pages as the image data of PNG and JPEG files: every third has an EXIF block, every other third the letters alone."""
    k = F.col("page_id")
    letters = F.when(k % 3 == 1, F.lit("Exif")).otherwise(F.lit(""))
    data = F.encode(F.concat(F.coalesce("html", F.lit("")), letters), "UTF-8")
    content = F.when(k % 2 == 0, png_file(data, k % 3 == 0)).otherwise(jpeg_file(data, k % 3 == 0))
    return table(spark, sf, "pages").select("page_id", has_exif_marker(content).alias("exif_present"))


@query(
    "registry_write",
    with_ctes(
        "manifest",
        body="""SELECT 1 AS schema_version, 'assay' AS generated_by, '2026-01-01T00:00:00Z' AS generated_at,
  to_json(map_from_entries(list({'k': split, 'v': {'manifest': split || '_forensic.csv', 'rows': k}} ORDER BY split)))::VARCHAR AS splits
FROM (SELECT CASE WHEN sealed THEN 'sealed' WHEN quality = 1 THEN 'dev' ELSE 'train' END AS split, count(*) AS k
      FROM manifest GROUP BY 1)""",
    ),
)
def q_registry_write(spark, sf):
    split = F.when(F.col("sealed"), "sealed").when(F.col("quality") == 1, "dev").otherwise("train")
    df = manifest(spark, sf).withColumn("split", split)
    row = sinks.registry_row(df, "assay", F.lit("2026-01-01T00:00:00Z"))
    return row.withColumn("splits", F.to_json("splits"))
