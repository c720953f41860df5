"""Sinks: split manifests, reports, appends that can be repeated, registries."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.operators.common import join_keys
from assay.sources.scans import path_exists


def write_manifests(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """One folder per split; a split without rows gets none."""
    writer = df.write.mode(mode).partitionBy("split")
    if fmt == "csv":
        writer = writer.option("header", True).option("quote", '"').option("escape", '"')
    writer.format(fmt).save(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested JSON rows (structs stay nested), null fields kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def _runs(spark: SparkSession, path: str) -> list[str]:
    """Folders of the committed runs, in order: record n of ``_commits`` is a text file that names run n."""
    if not path_exists(spark, f"{path}/_commits/*.run"):
        return []
    records = spark.read.option("pathGlobFilter", "*.run").text(f"{path}/_commits/*.run")
    return [r["value"] for r in records.select("value", "_metadata.file_name").orderBy("file_name").collect()]  # one row a run


def _commit(spark: SparkSession, path: str, number: int, run: str) -> bool:
    """Publish a run as record ``number``; false if another run took that number before.

    The record is written aside and moved whole, without replacing: atomic on HDFS and, as a hard link, on local disks.
    Object stores whose rename is a copy need one run at a time.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    draft, record = (jvm.org.apache.hadoop.fs.Path(f"{path}/_commits/{name}") for name in (f"{run}.draft", f"{number:08d}.run"))
    files = draft.getFileSystem(conf)
    out = files.create(draft, True)
    out.write(bytearray(run.encode()))
    out.close()
    try:
        if files.getScheme() == "file":
            os.link(draft.toUri().getPath(), record.toUri().getPath())
        else:
            _move(jvm, conf, draft, record)
    except FileExistsError:
        return False
    finally:
        files.delete(draft, False)
    return True


def _move(jvm, conf, draft, record) -> None:
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = SparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf).rename(draft, record, options)
    except Py4JJavaError as exc:
        if "FileAlreadyExists" in exc.java_exception.getClass().getName():
            raise FileExistsError(record.toString()) from exc
        raise


def read_appended(spark: SparkSession, path: str, schema: T.StructType | None = None, runs: list[str] | None = None) -> DataFrame:
    """The rows of all committed runs, and of plain parquet files in the folder; folders of runs without a record are not read."""
    runs = _runs(spark, path) if runs is None else runs
    plain = [f"{path}/*.parquet"] if path_exists(spark, f"{path}/*.parquet") else []
    if not runs and not plain:
        raise ValueError(f"nothing is committed in {path}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*plain, *[f"{path}/{run}" for run in runs])


def append_resumable(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append only rows whose keys are not in the target yet; a rerun writes nothing twice. Null is a key like any other.

    A run writes its rows to a folder of its own and becomes visible by one record. A run killed before it leaves
    nothing that readers see and is simply repeated. If another run commits first, the rows written here are compared with
    those of that run only, written again, and the next number is tried. Read with ``read_appended``.
    """
    spark = df.sparkSession
    todo, seen, first = df.dropDuplicates(keys), [], True
    while True:
        runs = _runs(spark, path)
        new = [run for run in runs if run not in seen]
        if new or (first and path_exists(spark, f"{path}/*.parquet")):
            # what was compared before is not compared again
            done = read_appended(spark, path, df.schema, new) if first else spark.read.schema(df.schema).parquet(*[f"{path}/{run}" for run in new])
            todo = join_keys(todo, done.select(*keys), keys, "left_anti")
        seen, first, run = runs, False, f"run-{uuid.uuid4().hex}"
        todo.write.parquet(f"{path}/{run}")
        todo = spark.read.schema(df.schema).parquet(f"{path}/{run}")
        if (runs and todo.isEmpty()) or _commit(spark, path, len(runs), run):
            return


def registry_row(
    manifest: DataFrame, generated_by: str, generated_at: Column | None = None, version: int = 1
) -> DataFrame:
    """(schema_version, generated_by, generated_at, splits map) with the rows of each split."""
    counts = manifest.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    entry = F.struct(
        F.col("split").alias("key"),
        F.struct(F.concat("split", F.lit("_forensic.csv")).alias("manifest"), "rows").alias("value"),
    )
    # three splits at most
    splits = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("splits"))
    at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX") if generated_at is None else generated_at
    return splits.select(
        F.lit(version).alias("schema_version"), F.lit(generated_by).alias("generated_by"), at.alias("generated_at"), "splits"
    )


def write_registry(row: DataFrame, path: str) -> None:
    row.write.mode("overwrite").json(path)
