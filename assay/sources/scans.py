"""Scans: manifests, public shards, asset trees, suites, registries, path lists."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from assay.functions.scalars import normalize_label
from assay.sources import schemas

IMAGE_COLUMNS = ("image", "image_data", "bytes")
LABEL_COLUMNS = {
    "bench": ("label", "target", "ground_truth", "class", "is_fake", "fake"),
    "extract": ("label", "is_fake", "fake", "class"),
}
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp")
EXCLUDED_DIRS = ("eval", "holdout", "holdout2", "bench_pub", "probe", "raw")


def scan_manifest(
    spark: SparkSession,
    path: str,
    split: str | None = None,
    schema: str = schemas.DATASET_MANIFEST,
    multi_line: bool = False,
) -> DataFrame:
    """CSV manifest with a header; ``split`` filters rows (and folders, when partitioned by split).

    Fields with line breaks need ``multi_line``, which makes a file one task; keep it off for big manifests.
    """
    df = spark.read.csv(path, header=True, schema=schema, quote='"', escape='"', multiLine=multi_line)
    return df if split is None else df.where(F.col("split") == split)


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when the path or glob matches something on its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def _is_binary(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.BinaryType)


def _content(df: DataFrame, variant_columns=IMAGE_COLUMNS) -> Column:
    name = next((c for c in variant_columns if c in df.columns), df.columns[0])
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StructType) and "bytes" in dtype.names and _is_binary(dtype["bytes"].dataType):
        return F.col(f"`{name}`.bytes")
    return F.col(f"`{name}`") if _is_binary(dtype) else F.lit(None).cast("binary")


def _label(df: DataFrame, variant: str) -> Column:
    name = next((c for c in LABEL_COLUMNS[variant] if c in df.columns), None)
    if name is None:
        return F.lit("ai") if variant == "extract" else F.lit(None).cast("string")
    return normalize_label(F.col(f"`{name}`"), df.schema[name].dataType.simpleString(), variant)


def resolve_shard(df: DataFrame, variant: str = "bench") -> DataFrame:
    """(content, label) of a shard of any layout; rows without bytes are dropped."""
    return df.select(_content(df).alias("content"), _label(df, variant).alias("label")).where("content is not null")


def _layout(path: str, variant: str) -> tuple[str | None, str | None]:
    """(layout, reason) of a shard: the JSON schema of its content and label columns, or why it cannot be used."""
    try:
        if path.startswith("file:") or "://" not in path:
            files, name = fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
        else:
            files, name = fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", path))
        with files.open_input_file(name) as shard:
            found = pq.ParquetFile(shard).schema_arrow
    except (OSError, pa.ArrowException) as exc:
        return None, f"unreadable: {str(exc)[:80]}"

    def kind(name: str) -> pa.DataType:
        t = found.field(name).type
        return t.value_type if pa.types.is_dictionary(t) else t

    if not found.names:
        return None, "no bytes"
    content = next((c for c in IMAGE_COLUMNS if c in found.names), found.names[0])
    of = kind(content)
    if pa.types.is_struct(of) and of.get_field_index("bytes") >= 0 and _is_bytes(of.field("bytes").type):
        fields = [T.StructField(content, T.StructType([T.StructField("bytes", T.BinaryType())]))]
    elif _is_bytes(of):
        fields = [T.StructField(content, T.BinaryType())]
    else:
        return None, "no bytes"
    label = next((c for c in LABEL_COLUMNS[variant] if c in found.names and c != content), None)
    if label is not None:
        try:
            single = not pa.types.is_nested(kind(label)) and from_arrow_type(kind(label))
        except PySparkException:
            single = None
        if not single:
            return None, f"label of type {kind(label)}"
        fields.append(T.StructField(label, single))
    return T.StructType(fields).json(), None


def _is_bytes(t: pa.DataType) -> bool:
    return pa.types.is_binary(t) or pa.types.is_large_binary(t)


def shard_layouts(spark: SparkSession, groups: list[str | list[str]], variant: str = "bench") -> DataFrame:
    """(path, length, layout, reason) of every parquet file below the paths, each by its own footer, read in tasks."""
    paths = [p for group in groups for p in ([group] if isinstance(group, str) else group)]
    paths = [p for p in dict.fromkeys(paths) if path_exists(spark, p)]
    kind = T.StructType([T.StructField("layout", T.StringType()), T.StructField("reason", T.StringType())])
    if not paths:
        return spark.createDataFrame([], "path string, length bigint, layout string, reason string")

    @F.pandas_udf(kind)
    def layouts(shards: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_layout(p, variant) for p in shards], columns=kind.names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(paths)
    files = files.select("path", "length").distinct()
    return files.withColumn("_l", layouts("path")).select("path", "length", "_l.*")


def scan_parquet_flex(spark: SparkSession, groups: list[str | list[str]], variant: str = "bench") -> DataFrame:
    """(content, label) of shards of any layout, mixed within a folder as they come; what cannot be read is skipped.

    Every shard is resolved by its own footer. Shards of one layout are one scan of the two columns that it needs, so
    the plan has as many scans as there are layouts. Only the names of the shards come to the driver, which has to list
    the files of a scan anyhow. ``skipped_files`` names the shards left out.
    """
    shards: dict[str, list[str]] = {}
    for row in shard_layouts(spark, groups, variant).where("layout IS NOT NULL").select("path", "layout").toLocalIterator():
        shards.setdefault(row["layout"], []).append(re.sub(r"([*?{}\[\]\\])", r"\\\1", row["path"]))  # names are no globs
    parts = []
    for layout in sorted(shards):
        reader = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
        df = reader.schema(T.StructType.fromJson(json.loads(layout))).parquet(*shards[layout])
        parts.append(resolve_shard(df, variant))
    if not parts:
        return spark.createDataFrame([], "content binary, label string")
    return reduce(DataFrame.unionByName, parts)


def skipped_files(spark: SparkSession, groups: list[str | list[str]], variant: str = "bench") -> DataFrame:
    """(path, length, reason) of the shards that ``scan_parquet_flex`` passes over: no parquet footer, no column of bytes, or
    a label that is no single value. Readable shards without rows are not among them, nor files of zero bytes, which Spark
    does not list."""
    skipped = shard_layouts(spark, groups, variant).where("layout IS NULL")
    return skipped.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", "reason")


def _relative(path: Column, root: str) -> Column:
    """Path below ``root`` of a file URI."""
    base = root.rstrip("/") + "/"
    return F.substring_index(path, base, -1)


def scan_asset_tree(
    spark: SparkSession, root: str, extensions=IMAGE_EXTENSIONS, excluded=EXCLUDED_DIRS
) -> DataFrame:
    """(path, rel, length, content) of files below root outside the excluded top folders.

    ``content`` is read only when a later step selects it.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = _relative(F.col("path"), root)
    top = F.split(rel, "/")[0]
    ext = F.lower(F.element_at(F.split(rel, r"\."), -1))
    nested = F.contains(rel, F.lit("/"))
    kept = ext.isin(*extensions) & F.contains(rel, F.lit(".")) & ~(nested & top.isin(*excluded))
    return df.where(kept).select("path", rel.alias("rel"), "length", "content")


# suite name -> (glob below the data root, label or None when a manifest holds it)
SUITES = {
    "eval": (None, None),
    "holdout2": ("holdout2/ai/*/*.jpg", "ai"),
    "probe_real": ("probe/real/*.jpg", "real"),
}


def scan_suite_glob(spark: SparkSession, root: str, suite: str, manifest: str | None = None, suites=SUITES) -> DataFrame:
    """(path, label) of a named suite; an unknown name is an error."""
    if suite not in suites:
        raise ValueError(f"unknown suite: {suite}")
    glob, label = suites[suite]
    if glob is None:
        return scan_manifest(spark, manifest, suite).select("path", "label")
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{glob}")
    return files.select("path", F.lit(label).alias("label"))


def scan_path_list(spark: SparkSession, path: str) -> DataFrame:
    """One trimmed path per line, blank lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def scan_benchmark_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=schemas.BENCHMARK_REGISTRY, multiLine=True)


def text_or_array(value: Column) -> Column:
    """A JSON member that is a string or an array of strings, as an array."""
    listed = F.from_json(value, "array<string>")
    return F.when(F.startswith(F.trim(value), F.lit("[")), listed).otherwise(
        F.when(value.isNotNull(), F.array(value))
    )


def registry_suites(registry: DataFrame) -> DataFrame:
    """One row per suite with the policy threshold and normalized sources."""
    rows = registry.select(F.col("policy.threshold").alias("threshold"), F.explode("suites").alias("suite", "s"))
    return rows.select(
        "suite",
        "threshold",
        F.col("s.role").alias("role"),
        F.col("s.size").alias("size"),
        F.col("s.files").alias("files"),
        text_or_array(F.col("s.ai_sources")).alias("ai_sources"),
    )


def registry_splits(registry: DataFrame) -> DataFrame:
    """(split, manifest, rows) of a forensic registry."""
    return registry.select(F.explode("splits").alias("split", "s")).select("split", "s.manifest", "s.rows")


def scan_forensic_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=schemas.FORENSIC_REGISTRY, multiLine=True)


def scan_model_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(name, role, size_bytes, sha256, input_shape) of the declared artifacts."""
    df = spark.read.json(path, schema=schemas.MODEL_BUNDLE, multiLine=True)
    return df.select(F.explode("models").alias("name", "m")).select("name", "m.*")


def hashed_files(spark: SparkSession, root: str) -> DataFrame:
    """(name, length, disk_sha256) of the files in a folder."""
    df = spark.read.format("binaryFile").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return df.select(name.alias("name"), "length", F.sha2("content", 256).alias("disk_sha256"))


def scan_images(spark: SparkSession, root: str) -> DataFrame:
    """(path, h, w, channels, data) of decodable images; undecodable files are dropped by the reader."""
    df = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", "true").load(root)
    return df.select(
        # local files are listed as file:/x, but the image reader calls them file:///x
        F.regexp_replace("image.origin", "^file:/+", "file:/").alias("path"),
        F.col("image.height").alias("h"),
        F.col("image.width").alias("w"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    )


def images_to_grids(images: DataFrame) -> DataFrame:
    """(path, h, w, grid, red, green, blue): luma by the 601 weights; bytes are unpacked per Arrow batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            planes = []
            for data, ch in zip(b["data"], b["channels"]):
                px = np.frombuffer(data, dtype=np.uint8).reshape(-1, ch).astype(float)
                blue, green, red = (px[:, min(i, ch - 1)] for i in range(3))
                planes.append((np.floor((red * 299 + green * 587 + blue * 114) / 1000 + 0.5), red, green, blue))
            out = b[["path", "h", "w"]].copy()
            for i, name in enumerate(("grid", "red", "green", "blue")):
                out[name] = [p[i] for p in planes]
            yield out

    schema = "path string, h int, w int, grid array<double>, red array<double>, green array<double>, blue array<double>"
    return images.mapInPandas(run, schema)
