"""Prompt tables and page images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.hashing import hash_hex, pick_index, unit_hash
from assay.functions.scalars import image_eligible
from assay.operators.sampling import dedup_exact, hash_index

LANDSCAPE_SHARE = 0.6


def expand_templates(
    templates: DataFrame, draws: int = 120, seed=0, pool: int | None = None, extras: DataFrame | None = None
) -> DataFrame:
    """(template_id, draw, prompt): every draw fills each slot of the template by hash.

    templates: template_id, template with {0}, {1}, ... and slots array<array<string>>. The pool keeps
    the first ``pool`` prompts in (template_id, draw) order; extras come on top.
    """
    rows = templates.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    at = F.sequence(F.lit(0), F.greatest(F.size("slots") - 1, F.lit(0)))

    def fill(text: Column, i: Column) -> Column:
        values = F.try_element_at(F.col("slots"), i + 1)
        pick = pick_index(F.size(values), seed, F.col("template_id"), F.col("draw"), i)
        value = F.try_element_at(values, pick + 1)
        mark = F.concat(F.lit("{"), i.cast("string"), F.lit("}"))
        return F.replace(text, mark, F.coalesce(value, mark))

    out = rows.select("template_id", "draw", F.aggregate(at, F.col("template"), fill).alias("prompt"))
    if pool is not None:
        out = out.orderBy("template_id", "draw").limit(pool)
    if extras is not None:
        out = out.unionByName(extras)
    return out


def assign_aspect_seed(prompts: DataFrame, text: str = "prompt", seed=0) -> DataFrame:
    """Running id in hash order, 60/40 aspect and a seed below 2^31 per distinct prompt."""
    out = hash_index(prompts, text, seed).withColumn("id", F.col("hash_idx") + 1).drop("hash_idx")
    aspect = F.when(unit_hash(seed, "aspect", F.col(text)) < LANDSCAPE_SHARE, "landscape_4_3").otherwise("portrait_4_3")
    number = F.floor(unit_hash(seed, "seed", F.col(text)) * F.lit(2147483648.0)).cast("long")
    return out.withColumn("aspect", aspect).withColumn("seed", number)


def distinct_prompts(df: DataFrame, n: int, text: str = "prompt", seed=0) -> DataFrame:
    """The first n distinct prompts in hash order; fewer when there are fewer."""
    order = [hash_hex(seed, F.col(text))]
    first = dedup_exact(df.select(text), text, order, [text])
    return first.orderBy(hash_hex(seed, F.col(text)), text).limit(n)


_IMG = r"(?is)<img\b[^>]*>"


def _attr(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*([\"'])(.*?)\1", 2)
    bare = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*([^\"'\s>]+)", 1)
    return F.when(quoted != "", quoted).otherwise(bare)


def page_images(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, src, width, height) of the image tags, with ``eligible``; every src counts once per page."""
    tags = pages.select(key, F.explode(F.regexp_extract_all(F.col(html), F.lit(_IMG), F.lit(0))).alias("_t"))
    out = tags.select(
        key,
        _attr(F.col("_t"), "src").alias("src"),
        F.coalesce(F.regexp_extract(_attr(F.col("_t"), "width"), r"^(\d+)", 1).try_cast("int"), F.lit(0)).alias("width"),
        F.coalesce(F.regexp_extract(_attr(F.col("_t"), "height"), r"^(\d+)", 1).try_cast("int"), F.lit(0)).alias("height"),
    )
    out = out.withColumn("eligible", image_eligible(F.col("src"), F.col("width"), F.col("height")))
    return out.groupBy(key, "src").agg(
        F.max("width").alias("width"), F.max("height").alias("height"), F.bool_or("eligible").alias("eligible")
    )


def page_links(pages: DataFrame, key: str = "page_id", html: str = "html", keep: list[str] = ()) -> DataFrame:
    """(key, href) of all anchors and the columns to ``keep``; one row per occurrence."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'<a href="([^"]*)"'), F.lit(1))
    return pages.select(key, *keep, F.explode(found).alias("href"))
