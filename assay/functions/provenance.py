"""Provenance of an asset from its path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Source -> (family, license).
SOURCE_META = {
    "imagenette": ("web_jpeg", "Apache-2.0 (ImageNet-derived)"),
    "picsum": ("camera_photo", "Unsplash license"),
    "ffhq": ("portrait", "FFHQ license (research)"),
    "cifake_real": ("camera_photo", "MIT (CIFAKE)"),
    "probe_real": ("camera_photo", "web scraped, research"),
    "screenshots": ("screenshot_ui", "generated in-repo"),
    "schnell": ("latent_diffusion", "fal.ai TOS (research)"),
    "xgen": ("latent_diffusion", "fal.ai TOS (research)"),
    "probe_ai": ("latent_diffusion", "fal.ai TOS (research)"),
    "mj": ("commercial_api", "web scraped (research, no redistribution)"),
    "mj2": ("commercial_api", "web scraped (research, no redistribution)"),
    "sd_db": ("latent_diffusion", "DiffusionDB research license"),
    "stylegan3": ("gan", "NVlabs StyleGAN3 license (research)"),
    "cf_fakes": ("gan", "Community Forensics research license"),
    "cifake_ai": ("latent_diffusion", "MIT (CIFAKE)"),
    "real_coco": ("camera_photo", "COCO (CC-BY-4.0) — not used in training (reverted run)"),
}

# Directory -> source.
DIR_TO_SOURCE = {
    "imagenette2-320": "imagenette",
    "picsum": "picsum",
    "ffhq": "ffhq",
    "cifake": "cifake_real",
    "probe": "probe_real",
    "screenshots": "screenshots",
    "schnell": "schnell",
    "xgen": "xgen",
    "probe_ai": "probe_ai",
    "mj": "mj",
    "mj2": "mj2",
    "sd_db": "sd_db",
    "stylegan3": "stylegan3",
    "cf_fakes": "cf_fakes",
    "holdout_oos": "mj2|sd_db",
    "ai_cf": "cf_fakes",
    "ai_cf1": "cf_fakes",
    "ai_cf2": "cf_fakes",
    "ai_cf3": "cf_fakes",
    "ai_cf4": "cf_fakes",
    "ai_cf5": "cf_fakes",
    "ai_cf6": "cf_fakes",
    "ai_mj": "mj",
    "ai_mj2_train": "mj2",
    "ai_sd_db": "sd_db",
    "ai_stylegan3": "stylegan3",
    "ai_cifake": "cifake_ai",
    "real_cifake": "cifake_real",
    "real_ffhq": "ffhq",
    "real_ffhq_dl": "ffhq",
    "real_ffhq_dl2": "ffhq",
    "real_ffhq_dl3": "ffhq",
    "real_coco": "real_coco",
}

# Families whose assets are synthetic, and all families.
SYNTHETIC_FAMILIES = (
    "latent_diffusion", "pixel_diffusion", "gan", "autoregressive", "commercial_api", "img2img", "postprocessed",
)
FAMILIES = SYNTHETIC_FAMILIES + (
    "camera_photo", "web_jpeg", "portrait", "matched_real", "screenshot_ui", "illustration_art", "unknown",
)


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    flat = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*flat), key)


def relative_path(path: Column, roots: list[str]) -> Column:
    """Path below the first matching root; unchanged when none matches."""
    out = path
    for root in reversed(roots):
        prefix = root.rstrip("/") + "/"
        cut = F.substring(path, len(prefix) + 1, 1 << 30)
        out = F.when(F.startswith(path, F.lit(prefix)), cut).otherwise(out)
    return out


def source_of_asset(rel: Column) -> Column:
    """Data source named by the directory rules; unmapped directories name themselves."""
    parts = F.split(rel, "/")
    top, second = F.element_at(parts, 1), F.try_element_at(parts, F.lit(2))
    deep = F.size(parts)
    named = F.coalesce(_lookup(DIR_TO_SOURCE, top), top)
    inner = F.coalesce(_lookup(DIR_TO_SOURCE, second), second)
    return (
        F.when((top == "holdout_oos") & (deep > 1), F.when(F.contains(second, F.lit("mj")), "mj2").otherwise("sd_db"))
        .when((top == "train_extra") & (deep > 1), inner)
        .when((top == "xgen") & (deep > 2), "xgen")
        .when(top == "train", F.when((deep > 1) & (second == "ai"), "schnell").otherwise("imagenette"))
        .when((named == "cifake_real") & (second == "ai"), "cifake_ai")
        .when((named == "probe_real") & (second == "ai"), "probe_ai")
        .otherwise(named)
    )


def family_of(source: Column) -> Column:
    return F.coalesce(_lookup({s: m[0] for s, m in SOURCE_META.items()}, source), F.lit("unknown"))


def license_of(source: Column) -> Column:
    return F.coalesce(_lookup({s: m[1] for s, m in SOURCE_META.items()}, source), F.lit("unknown"))


def classify_provenance(df: DataFrame, path: str = "path", roots: list[str] = ()) -> DataFrame:
    """Add source, family, license and label (map look-ups on fixed tables: no join, no shuffle)."""
    src = source_of_asset(relative_path(F.col(path), list(roots)))
    out = df.withColumn("source", src)
    return (
        out.withColumn("family", family_of(F.col("source")))
        .withColumn("license", license_of(F.col("source")))
        .withColumn("label", F.when(F.col("family").isin(*SYNTHETIC_FAMILIES), "ai").otherwise("real"))
    )


def provenance_table(spark: SparkSession) -> DataFrame:
    rows = [(s, fam, lic) for s, (fam, lic) in SOURCE_META.items()]
    return spark.createDataFrame(rows, "source string, family string, license string")
