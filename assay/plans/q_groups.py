"""Near duplicates of whole grids, components over leak keys, and splits that keep them whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import components, neardup, quality
from assay.plans.base import query
from assay.plans.proxies import manifest, wide_grids, with_ctes

RADIUS = 15


def planted_grids(spark, sf):
    """Whole grids with planted copies: darker ones, and ones with a single cell turned over."""
    g = wide_grids(spark, sf)
    dark = g.where("id % 10 = 3").select((F.col("id") + 1_000_000_000).alias("id"), "h", "w", F.transform("grid", lambda v: v * 0.5 + 16).alias("grid"))
    turned = F.transform("grid", lambda v, i: F.when(i == 5, 255 - v).otherwise(v))
    edited = g.where("id % 10 = 7").select((F.col("id") + 2_000_000_000).alias("id"), "h", "w", turned.alias("grid"))
    planted = g.unionByName(dark).unionByName(edited)
    # a signature is made of the rows that are there
    there = planted.withColumn("grid", F.filter("grid", lambda v: ~F.isnan(v))).withColumn("h", F.floor(F.size("grid") / 16).cast("int"))
    return there.where("h > 0")


# the sides of these grids divide 32, so a signature repeats each cell's bit; distances count the repeats
SIGNED = """cells AS (
  SELECT id, i, v FROM wide
  UNION ALL SELECT id + 1000000000, i, v * 0.5 + 16 FROM wide WHERE id % 10 = 3
  UNION ALL SELECT id + 2000000000, i, CASE WHEN i = 5 THEN 255 - v ELSE v END FROM wide WHERE id % 10 = 7),
signed AS (SELECT id, count(*) AS k, string_agg(CASE WHEN round(v, 9) > round(g, 9) THEN '1' ELSE '0' END, '' ORDER BY i)::BIT AS bits
  FROM (SELECT *, avg(v) OVER (PARTITION BY id) AS g FROM cells) GROUP BY id)"""


@query(
    "near_dup_grids",
    with_ctes("wide", body=f", {SIGNED}\nSELECT count(*) AS n, min(id) AS first_key FROM signed GROUP BY bits, k HAVING count(*) > 1").replace("\n, ", ",\n", 1),
)
def q_near_dup_grids(spark, sf):
    """Groups of equal signatures of whole grids."""
    signed = neardup.signatures(planted_grids(spark, sf), ["id"])
    return neardup.equal_groups(signed, "id").drop("signature")


@query(
    "near_dup_radius",
    with_ctes(
        "wide",
        body=f""", {SIGNED},
near AS (SELECT a.id AS a, b.id AS b FROM signed a JOIN signed b ON a.k = b.k AND bit_count(xor(a.bits, b.bits)) * 1024 / a.k <= {RADIUS}),
reach AS (SELECT a AS id, b AS root FROM near UNION SELECT reach.id, near.b FROM reach JOIN near ON near.a = reach.root)
SELECT id, class_id, count(*) OVER (PARTITION BY class_id) AS n_class FROM (SELECT id, min(root) AS class_id FROM reach GROUP BY id)""",
    ).replace("\n, ", ",\n", 1).replace("WITH ", "WITH RECURSIVE ", 1),
)
def q_near_dup_radius(spark, sf):
    """Classes of grids within the radius; unequal shapes are compared too, but never lie that close here."""
    return neardup.near_classes(neardup.signatures(planted_grids(spark, sf), ["id"]), "id", RADIUS)


GROUPS = ["sha256", "scene", "chain"]


def grouped(spark, sf):
    """The manifest with keys that must not cross splits: the content, its opening as scene and its ending as chain."""
    m = manifest(spark, sf)
    text = F.col("content")
    return m.select(
        "doc_id", "sha256", F.substring(text, 1, 24).alias("scene"), F.reverse(F.substring(F.reverse(text), 1, 24)).alias("chain"),
        "label", F.when(F.col("sealed"), "sealed").when(F.col("quality") == 1, "dev").otherwise("train").alias("split"),
    )


KEYED = """keyed AS (SELECT doc_id, sha256, substr(content, 1, 24) AS scene, right(content, 24) AS chain, label,
  CASE WHEN sealed THEN 'sealed' WHEN quality = 1 THEN 'dev' ELSE 'train' END AS split FROM manifest),
links AS (SELECT doc_id, 'sha256' AS kind, sha256 AS value FROM keyed WHERE sha256 <> '' UNION SELECT doc_id, 'scene', scene FROM keyed WHERE scene <> ''
  UNION SELECT doc_id, 'chain', chain FROM keyed WHERE chain <> ''),
pairs AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM links a JOIN links b USING (kind, value)),
spread AS (SELECT a AS doc_id, b AS root FROM pairs UNION SELECT spread.doc_id, pairs.b FROM spread JOIN pairs ON pairs.a = spread.root),
rooted AS (SELECT k.*, coalesce(r.root, k.doc_id) AS component FROM keyed k
  LEFT JOIN (SELECT doc_id, min(root) AS root FROM spread GROUP BY doc_id) r USING (doc_id))"""


def keyed_sql(body: str) -> str:
    return with_ctes("manifest", body=f", {KEYED}\n{body}").replace("\n, ", ",\n", 1).replace("WITH ", "WITH RECURSIVE ", 1)


@query("leak_components", keyed_sql("SELECT doc_id, component, count(*) OVER (PARTITION BY component) AS n FROM rooted"))
def q_components(spark, sf):
    rows = components.with_component(grouped(spark, sf), "doc_id", GROUPS)
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(sizes, "component").select("doc_id", "component", "n")


@query(
    "leak_components_audit",
    keyed_sql(
        """SELECT component AS key, min(split) AS first_split, max(split) AS last_split, count(*) AS n FROM rooted
GROUP BY component HAVING count(DISTINCT split) > 1"""
    ),
)
def q_component_audit(spark, sf):
    """Components over all leak keys together that cross the declared splits; keys audited one by one miss chains of them."""
    rows = components.with_component(grouped(spark, sf), "doc_id", GROUPS)
    return quality.split_spans(rows, ["component"]).select(F.col("key").cast("long").alias("key"), "first_split", "last_split", "n")


SHARES = {"train": 0.7, "dev": 0.2, "test": 0.1}


@query(
    "split_by_component",
    keyed_sql(
        """SELECT label, n_rows, 0::BIGINT AS crossing, true AS within FROM
(SELECT label, count(*) AS n_rows FROM rooted GROUP BY label)"""
    ),
)
def q_split_components(spark, sf):
    """Whole components in three splits: how many cross, and whether each class has its shares within the stated bound."""
    rows = components.with_component(grouped(spark, sf), "doc_id", GROUPS)
    dealt = components.split_components(rows, "component", SHARES, F.col("label"))
    out = rows.drop("split").join(dealt, "component")
    largest = rows.groupBy("component").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("largest"), F.sum("c").alias("total"), F.lit(0).alias("one"))
    crossing = quality.split_spans(out, ["component"]).agg(F.count(F.lit(1)).alias("crossing"), F.lit(0).alias("one"))
    counts = [F.count_if(F.col("split") == s).alias(s) for s in SHARES]
    by_class = out.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), *counts).withColumn("one", F.lit(0))
    joined = by_class.join(largest, "one").join(crossing, "one")
    slack = F.col("largest") + len(SHARES) * F.greatest(F.lit(2), F.floor(F.col("total") * 0.001)) + 1
    within = [F.abs(F.col(s) - F.col("n_rows") * share) <= slack for s, share in SHARES.items()]
    return joined.select("label", "n_rows", "crossing", (within[0] & within[1] & within[2]).alias("within"))
