"""Prompt tables and page images."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import prompts
from assay.plans.base import query
from assay.plans.proxies import table, u_sql

N_PROMPTS = 300


def templates(spark, sf):
    """One template per nation with two slots: all part types and all market segments, joined from their tables."""
    def words(name, column, slot):
        return table(spark, sf, name).agg(F.array_sort(F.collect_set(column)).alias(slot)).withColumn("_one", F.lit(1))

    text = F.concat(F.lit("product photo of {0} in "), "n_name", F.lit(", {1} style"))
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("template_id"), text.alias("template"), F.lit(1).alias("_one"))
    rows = rows.join(words("part", "p_type", "a"), "_one").join(words("customer", "c_mktsegment", "b"), "_one")
    return rows.select("template_id", "template", F.array("a", "b").alias("slots"))


def _pick(values: str, slot: int) -> str:
    u = u_sql("20260813", "template_id", "draw", str(slot))
    return f"{values}[floor({u} * len({values}))::INT + 1]"


EXPAND = f"""slots AS (SELECT (SELECT list_sort(list(DISTINCT p_type)) FROM part) AS a,
  (SELECT list_sort(list(DISTINCT c_mktsegment)) FROM customer) AS b),
drawn AS (SELECT n_nationkey AS template_id, t.draw::INT AS draw,
  replace(replace('product photo of {{0}} in ' || n_name || ', {{1}} style', '{{0}}', {_pick('a', 0)}), '{{1}}', {_pick('b', 1)}) AS prompt
  FROM nation CROSS JOIN range(120) t(draw) CROSS JOIN slots)""".replace("{{", "{").replace("}}", "}")


@query(
    "expand_templates",
    f"""WITH {EXPAND}
SELECT template_id, draw, prompt FROM drawn UNION ALL SELECT -1, item_id::INT, text FROM benchmark""",
)
def q_expand(spark, sf):
    """Benchmark passages stand for the standalone extras."""
    extras = table(spark, sf, "benchmark").select(
        F.lit(-1).alias("template_id"), F.col("item_id").cast("int").alias("draw"), F.col("text").alias("prompt")
    )
    return prompts.expand_templates(templates(spark, sf), 120, 20260813, extras=extras)


@query(
    "distinct_prompts",
    f"""SELECT DISTINCT text AS prompt FROM conversations WHERE text <> ''
ORDER BY md5(concat_ws(':', '7', text)), text LIMIT {N_PROMPTS}""",
)
def q_distinct(spark, sf):
    df = table(spark, sf, "conversations").select(F.col("text").alias("prompt")).where("prompt <> ''")
    return prompts.distinct_prompts(df, N_PROMPTS, seed=7)


@query(
    "assign_aspect_seed",
    f"""SELECT row_number() OVER (ORDER BY md5(concat_ws(':', '7', prompt)), prompt) AS id, prompt,
  CASE WHEN {u_sql("'7'", "'aspect'", 'prompt')} < 0.6 THEN 'landscape_4_3' ELSE 'portrait_4_3' END AS aspect,
  floor({u_sql("'7'", "'seed'", 'prompt')} * 2147483648)::BIGINT AS seed
FROM (SELECT DISTINCT text AS prompt FROM documents)""",
)
def q_assign(spark, sf):
    df = table(spark, sf, "documents").select(F.col("text").alias("prompt")).distinct()
    return prompts.assign_aspect_seed(df, seed=7).select("id", "prompt", "aspect", "seed")


@query(
    "page_images",
    """SELECT page_id, src, width, height, least(width, height) >= 64 AND src <> '' AS eligible FROM (
  SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS src,
         (page_id * 7 % 150)::INT AS width, 90 AS height FROM pages)""",
)
def q_page_images(spark, sf):
    """The test pages hold no images: their links are rewritten to image tags first."""
    size = F.concat(F.lit('" WIDTH='), (F.col("page_id") * 7 % 150).cast("string"), F.lit(" height='90px'"))
    html = F.regexp_replace("html", F.lit('<a href="([^"]*)"'), F.concat(F.lit('<img alt=x src="$1'), size))
    return prompts.page_images(table(spark, sf, "pages").select("page_id", html.alias("html")))


@query(
    "page_links",
    """SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages""",
)
def q_page_links(spark, sf):
    return prompts.page_links(table(spark, sf, "pages"))
