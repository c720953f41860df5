"""Scans and sinks: each query writes tables derived from the inputs to the scratch folder and reads them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.plans.base import query
from assay.plans.proxies import assets, manifest, table, with_ctes
from assay.session import scratch_dir
from assay.sources import scans, sinks


def _dataset(spark, sf):
    """(split, label, path) rows: labelled documents of quality 1 are the eval split."""
    split = F.when(F.col("quality") == 1, "eval").when(F.col("quality") == 0, "dev").otherwise("train")
    return manifest(spark, sf).select(split.alias("split"), "label", "path")


_DATASET = "(SELECT CASE quality WHEN 1 THEN 'eval' WHEN 0 THEN 'dev' ELSE 'train' END AS split, label, path FROM manifest)"


@query("scan_manifest", with_ctes("manifest", body=f"SELECT split, label, path FROM {_DATASET} WHERE split = 'eval'"))
def q_scan_manifest(spark, sf):
    path = scratch_dir(spark)
    sinks.write_manifests(_dataset(spark, sf), path)
    return scans.scan_manifest(spark, path, "eval").select("split", "label", "path")


@query("sink_manifests", with_ctes("manifest", body=f"SELECT split, label, count(*) AS n FROM {_DATASET} GROUP BY ALL"))
def q_sink_manifests(spark, sf):
    path = scratch_dir(spark)
    sinks.write_manifests(_dataset(spark, sf), path)
    back = scans.scan_manifest(spark, path)
    return back.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "scan_parquet_flex",
    with_ctes(
        "assets",
        body="""SELECT sha256, size_bytes, CASE WHEN doc_id % 4 = 3 THEN NULL WHEN quality = 1 THEN 'ai' ELSE 'real' END AS label
FROM assets WHERE content IS NOT NULL""",
    ),
)
def q_flex(spark, sf):
    """Shards of four layouts in one folder; a missing folder is skipped."""
    root = scratch_dir(spark)
    a = assets(spark, sf).withColumn("raw", F.encode("content", "UTF-8"))
    word = F.when(F.col("quality") == 1, "Synthetic").otherwise("photo")
    layouts = [
        [F.struct(F.col("raw").alias("bytes"), "path").alias("image_data"), word.alias("label")],
        [F.col("raw").alias("bytes"), F.col("quality").alias("is_fake")],
        [F.col("path"), F.col("raw").alias("image"), (F.col("quality") == 1).alias("target")],
        [F.col("raw").alias("blob")],
    ]
    for i, cols in enumerate(layouts):
        a.where(F.col("doc_id") % 4 == i).select(*cols).write.mode("append").parquet(root)
    df = scans.scan_parquet_flex(spark, [root, f"{root}/missing"])
    return df.select(F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size_bytes"), "label")


def _passage_files(spark, sf):
    """A folder with one text file per benchmark item."""
    root = scratch_dir(spark)
    table(spark, sf, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(root)
    return root


def _item():
    return F.regexp_extract("path", r"item_id=(\d+)/", 1).cast("long").alias("item_id")


@query(
    "scan_asset_tree",
    "SELECT item_id, strlen(text) + 1 AS length, sha256(text || chr(10)) AS sha256 FROM benchmark",
)
def q_asset_tree(spark, sf):
    """Lengths and content hashes of the files of a tree; each file is an item and its line end."""
    tree = scans.scan_asset_tree(spark, _passage_files(spark, sf), ("txt",), ())
    return tree.select(_item(), "length", F.sha2("content", 256).alias("sha256"))


@query("scan_suite_glob", "SELECT item_id, CASE WHEN item_id < 10 THEN 'ai' ELSE 'real' END AS label FROM benchmark")
def q_suite_glob(spark, sf):
    """Items of one digit are one suite, the others two more."""
    suites = {"one": ("item_id=?/*.txt", "ai"), "two": ("item_id=??/*.txt", "real"), "more": ("item_id=???*/*.txt", "real")}
    root, parts = _passage_files(spark, sf), []
    have = table(spark, sf, "benchmark").agg(F.max("item_id")).first()[0]
    for name, least in (("one", 0), ("two", 10), ("more", 100)):
        if have is not None and have >= least:
            parts.append(scans.scan_suite_glob(spark, root, name, suites=suites).select(_item(), "label"))
    return reduce(DataFrame.unionAll, parts)


@query(
    "scan_registry",
    with_ctes(
        "manifest",
        body="""SELECT lang AS suite, 0.65::DOUBLE AS threshold, count(*) FILTER (label = 'ai') AS n_ai,
  count(*) FILTER (label = 'real') AS n_real, (CASE WHEN count(DISTINCT source) % 2 = 0 THEN 1 ELSE 2 END)::INT AS n_ai_sources
FROM manifest GROUP BY lang""",
    ),
)
def q_scan_registry(spark, sf):
    """Registry text with one suite per language; its source member is a string or an array."""
    path = scratch_dir(spark)
    per = manifest(spark, sf).groupBy("lang").agg(
        F.count_if(F.col("label") == "ai").alias("ai"),
        F.count_if(F.col("label") == "real").alias("real"),
        F.count_distinct("source").alias("k"),
    )
    sources = F.when(F.col("k") % 2 == 0, '"all"').otherwise('["a", "b"]')
    suite = F.format_string('"%s": {"role": "test", "size": {"ai": %d, "real": %d}, "ai_sources": %s}', "lang", "ai", "real", sources)
    # one row per suite of the registry
    text = per.agg(F.array_join(F.array_sort(F.collect_list(suite)), ", ").alias("s")).select(
        F.concat(F.lit('{"schema_version": 1, "policy": {"threshold": 0.65}, "suites": {'), "s", F.lit("}}")).alias("value")
    )
    text.write.text(path)
    suites = scans.registry_suites(scans.scan_benchmark_registry(spark, path))
    return suites.select(
        "suite", "threshold", F.col("size")["ai"].alias("n_ai"), F.col("size")["real"].alias("n_real"),
        F.size("ai_sources").alias("n_ai_sources"),
    )


@query("scan_path_list", with_ctes("assets", body="SELECT path FROM assets"))
def q_path_list(spark, sf):
    path = scratch_dir(spark)
    lines = assets(spark, sf).select(F.concat(F.lit("  "), "path", F.lit(" \n   ")).alias("value"))
    lines.write.text(path)
    return scans.scan_path_list(spark, path)


@query("sink_append_resumable", "SELECT doc_id, quality FROM labels")
def q_append_resumable(spark, sf):
    """A first run that wrote half of the rows, then two full runs."""
    path = scratch_dir(spark)
    rows = table(spark, sf, "labels").select("doc_id", "quality")
    for part in (rows.where("quality = 1"), rows, rows):
        sinks.append_resumable(part, path, ["doc_id"])
    return sinks.read_appended(spark, path, rows.schema)
