"""Joins of scores, labels, jobs, policies and artifacts."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from assay.functions.provenance import provenance_table
from assay.functions.scalars import THRESHOLD
from assay.operators.common import join_keys


def fuse_scores(scores: DataFrame, key: str = "id", how: str = "max") -> DataFrame:
    """One score per asset over all models: any alarm counts (max), or the mean as an option."""
    agg = F.max("p") if how == "max" else F.avg("p")
    return scores.groupBy(key).agg(agg.alias("p"), F.count("p").alias("n_models"))


def join_scores_labels(scores: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    return scores.join(labels, key)


def score_coverage(scores: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """(side, n) of matched and one-sided keys, from one full outer join of the keys."""
    s = scores.select(F.col(key), F.lit(1).alias("_s"))
    lab = labels.select(F.col(key), F.lit(1).alias("_l"))
    both = s.join(lab, key, "full")
    side = (
        F.when(F.col("_s").isNull(), "label_only").when(F.col("_l").isNull(), "score_only").otherwise("matched")
    )
    return both.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def job_matrix(prompts: DataFrame, models: DataFrame, done: DataFrame, prompt_key: str = "prompt_id", parts: int = 32) -> DataFrame:
    """Every (model, prompt) not done yet, from a table of prompts and a table of models of any size.

    Prompts are dealt to ``parts`` keys and every model goes to each, so that the matrix is built by an equi-join.
    """
    dealt = prompts.withColumn("_part", F.pmod(F.hash(prompt_key), F.lit(parts)))
    every = models.select("model").distinct().withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    jobs = dealt.join(every, "_part").drop("_part")
    finished = done.select("model", prompt_key).distinct()
    return jobs.join(finished, ["model", prompt_key], "left_anti")


def resume_filter(
    prompts: DataFrame, manifest: DataFrame, key: str = "prompt_id", limit: int | None = None
) -> DataFrame:
    """Prompts missing from the manifest, the first ``limit`` by key when given."""
    todo = prompts.join(manifest.select(key).distinct(), key, "left_anti")
    return todo.orderBy(key).limit(limit) if limit else todo


def provenance_join(df: DataFrame, source: str = "source") -> DataFrame:
    """Add family and license from the fixed source table (16 rows: broadcast by its size)."""
    dim = provenance_table(df.sparkSession).withColumnRenamed("source", source)
    out = df.join(F.broadcast(dim), source, "left")
    return out.withColumns(
        {c: F.coalesce(F.col(c), F.lit("unknown")) for c in ("family", "license")}
    )


def compare_models(base: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """Two long metric tables side by side with the change; intervals ``lo`` and ``hi`` come along where both have them."""
    keep = [c for c in ("value", "lo", "hi") if c in base.columns and c in candidate.columns]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, "metric", *[F.col(c).alias(name if c == "value" else f"{name}_{c}") for c in keep])

    out = join_keys(side(base, "base"), side(candidate, "candidate"), [*keys, "metric"])
    return out.withColumn("delta", F.col("candidate") - F.col("base"))


def score_parity(
    expected: DataFrame, observed: DataFrame, key: str, by: list[str], thr: float = THRESHOLD
) -> DataFrame:
    """Observed against expected scores; missing ones count against the mean's divisor and the gate."""
    both = expected.withColumnRenamed("p", "_e").join(observed.withColumnRenamed("p", "_o"), key, "left")
    seen = F.col("_o").isNotNull()
    gap = F.when(seen, F.abs(F.col("_o") - F.col("_e")))
    agree = seen & ((F.col("_o") >= thr) == (F.col("_e") >= thr))
    out = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~seen).alias("missing"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("max_delta"),
        (F.coalesce(F.sum(gap), F.lit(0.0)) / F.count(F.lit(1))).alias("mean_delta"),
        F.count_if(agree).alias("agree"),
    )
    ok = (F.col("missing") == 0) & (F.col("agree") >= 0.98 * F.col("n")) & (F.col("mean_delta") < 0.05)
    return out.withColumn("passed", ok)


def artifact_audit(
    expected: DataFrame, manifest: DataFrame, on_disk: DataFrame, size: int = 384
) -> DataFrame:
    """(name, problem) rows from expected names, declared entries and hashed bytes.

    manifest: name, size_bytes, sha256, input_shape array<string>; on_disk: name, length, disk_sha256.
    A file absent on disk is not a problem by itself: bundles ship partly.
    """
    full = (
        expected.select("name", F.lit(True).alias("_x"))
        .join(manifest.withColumn("_m", F.lit(True)), "name", "full")
        .join(on_disk.withColumn("_d", F.lit(True)), "name", "full")
    )
    want = F.coalesce(F.col("_x"), F.lit(False))
    listed, present = F.coalesce("_m", F.lit(False)), F.coalesce("_d", F.lit(False))
    sha = F.coalesce("sha256", F.lit(""))
    side = F.lit(str(size))
    good_shape = (F.size("input_shape") == 4) & (F.slice("input_shape", 3, 2) == F.array(side, side))
    rules = {
        "missing from manifest": want & ~listed,
        "bad sha256": want & listed & (F.length(sha) != 64),
        "input shape": want & listed & ~F.coalesce(good_shape, F.lit(False)),
        "hash mismatch": want & listed & present & (F.col("disk_sha256") != sha),
        "size mismatch": want & listed & present & (F.col("length") != F.col("size_bytes")),
        "not expected": ~want,
    }
    checks = F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()])
    problems = F.filter(checks, lambda c: c.isNotNull())
    return full.select("name", F.explode(problems).alias("problem"))


SEALED_TAGS = ("data/eval", "holdout2", "bench_pub", "holdout_oos")


def sealed_tag_hits(df: DataFrame, path: str = "path", tags=SEALED_TAGS) -> DataFrame:
    """(row, tag) for every sealed tag inside the lower-cased path: one literal test per tag, no join."""
    low = F.lower(F.col(path))
    tests = F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in tags])
    return df.withColumn("tag", F.explode(F.filter(tests, lambda t: t.isNotNull())))


def sealed_passage_join(
    docs: DataFrame, passages: DataFrame, doc_key: str, text: str, item_key: str, passage: str, block_bytes: int = 8 << 20
) -> DataFrame:
    """Exact substring join, ignoring case, for a table of sealed texts of any size: (doc_key, item_key).

    The sealed texts are the stated query set: they go to the scans in blocks of about ``block_bytes``, and each
    scan finds all texts of its block in one walk over every document (Aho-Corasick). Nothing is shuffled, so a common
    word is no hot key, and only one block is on the driver at a time. Null and empty passages match nothing.
    """
    needles = passages.select(F.col(item_key).alias("item"), F.lower(F.col(passage)).alias("needle")).where("needle <> ''")
    size = needles.agg(F.sum(F.octet_length("needle"))).first()[0] or 0
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_key).alias("doc"), F.lower(F.col(text)).alias("text"))
    kind = T.StructType([T.StructField(doc_key, rows.schema["doc"].dataType), T.StructField(item_key, needles.schema["item"].dataType)])
    item_type = to_arrow_type(kind[item_key].dataType)
    found = None
    for block in range(blocks := max(1, -(-size // block_bytes))):
        items: dict[str, list] = {}
        for row in needles.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == block).toLocalIterator():
            items.setdefault(row["needle"], []).append(row["item"])
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def search(batches, shared=shared):
            walk = ahocorasick.Automaton()
            for needle, of in shared.value.items():
                walk.add_word(needle, of)
            walk.make_automaton()
            for batch in batches:
                places, hits = [], []
                for n, whole in enumerate(batch.column("text").to_pylist()):
                    seen = {i for _, of in walk.iter(whole) for i in of} if len(walk) else ()
                    places += [n] * len(seen)
                    hits += seen
                ids = batch.column("doc").take(pa.array(places, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(hits, item_type)], [doc_key, item_key])

        pairs = rows.mapInArrow(search, kind)
        found = pairs if found is None else found.unionAll(pairs)
    return found


def glob_regex(glob: str) -> str:
    """Anchored regex of a path glob: ``**`` crosses folders, ``*`` and ``?`` do not; a bare name covers its tree."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    tail = "" if any(c in glob for c in "*?") else "(/.*)?"
    return f"^(.*/)?{out}{tail}$"


def glob_policy_join(df: DataFrame, globs: list[str], path: str = "path") -> DataFrame:
    """(row, glob) for rows matching a forbidden glob; each glob is one compiled pattern."""
    tests = F.array(*[F.when(F.rlike(F.col(path), F.lit(glob_regex(g))), F.lit(g)) for g in globs])
    return df.withColumn("glob", F.explode(F.filter(tests, lambda t: t.isNotNull())))

