"""Manifest validation: problem tables, leakage audits and the verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.containers import inspect
from assay.functions.provenance import FAMILIES

REQUIRED = ("path", "label", "family", "source", "license")
MIN_BYTES = 1024
SPLITS = ("train", "dev", "sealed")
LABELS = ("real", "ai")


def missing_provenance(df: DataFrame, key: str, fields=REQUIRED) -> DataFrame:
    """(key, field) for every empty required field."""
    tests = F.array(*[F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", F.lit(f)) for f in fields])
    return df.select(key, F.explode(F.filter(tests, lambda t: t.isNotNull())).alias("field"))


def duplicate_path(df: DataFrame, key: str, path: str = "path") -> DataFrame:
    """(path, key) of every row after the first of its path.

    The first row of each repeated path is a combined minimum; the join back to the rows is a plain
    equi-join that adaptive execution can split when one path is hot, unlike a window.
    """
    first = df.groupBy(path).agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rows = df.select(path, key).join(first.drop("_n"), path)
    return rows.where(F.col(key) != F.col("_first")).select(path, key)


def missing_file(manifest: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    return manifest.join(listing.select(path), path, "left_anti").select(path)


def corrupt_or_tiny(listing: DataFrame, decodable: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(path, kind): undecodable files are problems, small decodable ones warnings."""
    bad = listing.join(decodable.select("path"), "path", "left_anti")
    bad = bad.select("path", F.lit("corrupt").alias("kind"))
    tiny = listing.join(decodable.select("path"), "path", "left_semi").where(F.col("length") < min_bytes)
    return bad.unionByName(tiny.select("path", F.lit("tiny").alias("kind")))


def container_audit(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, length, container, state, exif) of every file from one walk over its bytes; null content is empty."""
    found = files.select(key, F.coalesce(F.octet_length(content), F.lit(0)).cast("long").alias("length"), inspect(F.col(content)).alias("_f"))
    return found.select(key, "length", "_f.*")


def damaged_or_tiny(files: DataFrame, key: str = "path", content: str = "content", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(key, kind) by the bytes themselves: files that are not whole are corrupt, whole small ones tiny. No join, one scan."""
    audit = container_audit(files, key, content)
    kind = F.when(F.col("state") != "ok", "corrupt").when(F.col("length") < min_bytes, "tiny")
    return audit.select(key, kind.alias("kind")).where("kind IS NOT NULL")


def duplicate_hash(df: DataFrame, sha: str = "sha256") -> DataFrame:
    """(sha, n) of hashes seen more than once."""
    seen = df.where(F.coalesce(F.col(sha) != "", F.lit(False)))
    return seen.groupBy(sha).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def near_dup_signature(grid: Column) -> Column:
    """One bit per cell: value above the mean of the grid, as md5 of the bit text."""
    mean = F.aggregate(grid, F.lit(0.0), lambda a, v: a + v) / F.size(grid)
    bits = F.transform(grid, lambda v: F.when(v > mean, "1").otherwise("0"))
    return F.md5(F.array_join(bits, ""))


def near_dup_groups(df: DataFrame, key: str, signature: str) -> DataFrame:
    """(signature, n, first key) of signatures shared across all splits; members are never listed in one row."""
    groups = df.groupBy(signature).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key"))
    return groups.where("n > 1")


def schema_violations(df: DataFrame, key: str) -> DataFrame:
    """(key, rule) of broken constraints: required fields, enums, hash pattern, size."""
    def absent(name: str) -> Column:
        return F.col(name).isNull()

    def outside(name: str, allowed) -> Column:
        return F.coalesce(~F.col(name).isin(*allowed), F.lit(False))

    rules = {f"required:{f}": absent(f) for f in (*REQUIRED, "split", "sha256")}
    rules |= {
        "enum:label": outside("label", LABELS),
        "enum:family": outside("family", FAMILIES),
        "enum:split": outside("split", SPLITS),
        "pattern:sha256": F.coalesce(~F.rlike("sha256", F.lit("^[0-9a-f]{64}$")), F.lit(False)),
        "minimum:size_bytes": F.coalesce(F.col("size_bytes") < 1, F.lit(False)),
    }
    tests = F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()])
    return df.select(key, F.explode(F.filter(tests, lambda t: t.isNotNull())).alias("rule"))


def split_spans(df: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """(kind, key, first_split, last_split, n) of keys that occur in more than one split, null and empty keys aside.

    One pass serves all key columns; minimum, maximum and count combine before the shuffle.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in keys])
    rows = df.select(split, F.inline(pairs)).where(F.coalesce(F.col("key") != "", F.lit(False)))
    spans = rows.groupBy("kind", "key").agg(
        F.min(split).alias("first_split"), F.max(split).alias("last_split"), F.count(F.lit(1)).alias("n")
    )
    return spans.where("first_split <> last_split")


def split_disjoint(df: DataFrame, keys: list[str]) -> DataFrame:
    """Identities, such as path and hash, shared by splits; empty when the splits are disjoint."""
    return split_spans(df, keys)


def group_leak_audit(df: DataFrame, groups: list[str]) -> DataFrame:
    """(group_key, leaking_groups, rows_in_leaks) for each declared group that crosses splits."""
    return split_spans(df, groups).groupBy(F.col("kind").alias("group_key")).agg(
        F.count(F.lit(1)).alias("leaking_groups"), F.sum("n").alias("rows_in_leaks")
    )


def verdict(problems: dict[str, DataFrame], warnings: dict[str, DataFrame]) -> DataFrame:
    """One row: PASS or FAIL with the counts of problems and warnings."""
    parts = [d.agg(F.lit("p").alias("k"), F.count(F.lit(1)).alias("n")) for d in problems.values()]
    parts += [d.agg(F.lit("w").alias("k"), F.count(F.lit(1)).alias("n")) for d in warnings.values()]
    counts = reduce(DataFrame.unionByName, parts)
    total = counts.agg(
        F.coalesce(F.sum(F.when(F.col("k") == "p", F.col("n"))), F.lit(0)).alias("n_problems"),
        F.coalesce(F.sum(F.when(F.col("k") == "w", F.col("n"))), F.lit(0)).alias("n_warnings"),
    )
    return total.select(F.when(F.col("n_problems") > 0, "FAIL").otherwise("PASS").alias("verdict"), "n_problems", "n_warnings")


def inventory_counts(df: DataFrame) -> DataFrame:
    """Row counts by (label, family, source); rolling up over family is left to the caller."""
    return df.groupBy("label", "family", "source").agg(F.count(F.lit(1)).alias("n"))


def split_reconcile(declared: DataFrame, actual: DataFrame, split: str = "split") -> DataFrame:
    """Declared against counted rows per split, both sides kept."""
    counted = actual.groupBy(split).agg(F.count(F.lit(1)).alias("actual_rows"))
    out = declared.select(split, F.col("rows").alias("declared_rows")).join(counted, split, "full")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("declared_rows", "actual_rows")})
    return out.withColumn("matches", F.col("declared_rows") == F.col("actual_rows"))


def assemble_sources(parts: list[tuple[str, str, DataFrame | None]]) -> DataFrame:
    """Union of (source, label, table) with tags; absent sources (None) are skipped, missing columns become null."""
    tagged = [
        df.withColumn("source", F.lit(source)).withColumn("label", F.lit(label))
        for source, label, df in parts
        if df is not None
    ]
    if not tagged:
        raise ValueError("no source is present")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
