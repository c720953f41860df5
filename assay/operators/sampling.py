"""Splits, caps, samples, mining and threshold search.

Seeded shuffles become hash order (md5 of seed and key). "The first k of a group in hash order" is
decided from counts per leading hash digits: whole slices fall on one side, and only the slice that
holds the cut is ranked. A group with a third of all rows therefore never meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.hashing import hash_hex
from assay.functions.scalars import THRESHOLD
from assay.operators.common import group_key, join_keys, materialize
from assay.operators.ranks import cumulative_cells, scored

SLICE_DIGITS = 3
SPARE = 6.0  # standard deviations of rows above the wanted number


def hash_bands(
    df: DataFrame,
    by: list[str],
    key: str,
    seed,
    quotas: list[Column] | Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Add ``band``: 0 for the first quota rows of the group in hash order, 1 up to the second, and so on.

    Quotas are ascending expressions of the group size ``n_group`` (and ``by``), or a function that adds
    columns q0, q1, ... to the table of groups.
    """
    rows = df.withColumn("_g", group_key(by)).withColumn("_h", hash_hex(seed, F.col(key)))
    rows = rows.withColumn("_s", F.substring("_h", 1, SLICE_DIGITS))
    slices = rows.groupBy("_g", "_s").agg(F.count(F.lit(1)).alias("_k"))
    groups = slices.groupBy("_g").agg(F.sum("_k").alias("n_group")).select("_g", "_g.*", "n_group")
    if callable(quotas):
        groups = quotas(groups)
        names = [c for c in groups.columns if c[0] == "q" and c[1:].isdigit()]
    else:
        names = [f"q{i}" for i in range(len(quotas))]
        groups = groups.withColumns(dict(zip(names, quotas)))
    done = Window.partitionBy("_g").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    run = slices.withColumn("_before", F.coalesce(F.sum("_k").over(done), F.lit(0)))
    run = run.join(groups.select("_g", "n_group", *names), "_g")
    cuts = []
    for q in names:
        holds = (F.col("_before") < F.col(q)) & (F.col(q) <= F.col("_before") + F.col("_k"))
        none, every = F.max(F.col(q)) <= 0, F.max(F.when(holds, F.col("_s")))
        cuts += [
            F.when(none, "").otherwise(F.coalesce(every, F.lit("~"))).alias(f"_c_{q}"),
            F.max(F.when(holds, F.col(q) - F.col("_before"))).alias(f"_m_{q}"),
        ]
    # one row per group
    cut = materialize(run.groupBy("_g").agg(F.max("n_group").alias("n_group"), *cuts))
    marked = rows.join(cut, "_g")
    at_cut = F.lit(False)
    for q in names:
        at_cut = at_cut | (F.col("_s") == F.col(f"_c_{q}"))

    def band(rank: Column) -> Column:
        total = F.lit(0)
        for q in names:
            past = (F.col("_s") > F.col(f"_c_{q}")) | ((F.col("_s") == F.col(f"_c_{q}")) & (rank > F.col(f"_m_{q}")))
            total = total + F.coalesce(past, F.lit(False)).cast("int")
        return total

    clear = marked.where(~at_cut).withColumn("band", band(F.lit(0)))
    order = Window.partitionBy("_g", "_s").orderBy("_h", key)
    edge = marked.where(at_cut).withColumn("_r", F.row_number().over(order))
    edge = edge.withColumn("band", band(F.col("_r"))).drop("_r")
    drop = ["_g", "_h", "_s", *[f"_c_{q}" for q in names], *[f"_m_{q}" for q in names]]
    return clear.unionByName(edge).drop(*drop)


def hash_index(df: DataFrame, key: str, seed) -> DataFrame:
    """Zero-based ``hash_idx`` of every row in hash order, without a global window."""
    rows = df.withColumn("_h", hash_hex(seed, F.col(key))).withColumn("_s", F.substring("_h", 1, 4))
    sizes = rows.groupBy("_s").agg(F.count(F.lit(1)).alias("_k"))
    # at most 65,536 slices
    run = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_s", F.coalesce(F.sum("_k").over(run), F.lit(0)).alias("_o"))
    local = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy("_h", key)))
    return (
        local.join(offsets, "_s").withColumn("hash_idx", F.col("_o") + F.col("_r") - 1).drop("_h", "_s", "_o", "_r")
    )


def _dev_quota(fraction: float) -> Column:
    return F.greatest(F.lit(1), F.bround(F.col("n_group") * fraction, 0).cast("long"))


def split_stratified(
    df: DataFrame, by: list[str], key: str = "path", seed=0, fraction: float = 0.2, sealed: Column | None = None
) -> DataFrame:
    """dev = max(1, half-even(fraction n)) per stratum, the rest train; sealed rows stay out of both."""
    sealed = F.lit(False) if sealed is None else F.coalesce(sealed, F.lit(False))
    pool = hash_bands(df.where(~sealed), by, key, seed, [_dev_quota(fraction)])
    pool = pool.withColumn("split", F.when(F.col("band") == 0, "dev").otherwise("train")).drop("band", "n_group")
    return pool.unionByName(df.where(sealed).withColumn("split", F.lit("sealed")))


def split_stratified_floor(df: DataFrame, by: list[str], key: str = "path", seed=0, parts: int = 5) -> DataFrame:
    """val = max(1, n // parts) per source, the rest train."""
    quota = F.greatest(F.lit(1), F.floor(F.col("n_group") / parts).cast("long"))
    out = hash_bands(df, by, key, seed, [quota])
    return out.withColumn("split", F.when(F.col("band") == 0, "val").otherwise("train")).drop("band", "n_group")


def split_fixed(
    df: DataFrame, by: list[str], n_eval: int = 150, n_train: int = 150, key: str = "path", seed=0
) -> DataFrame:
    """Per class the first n_eval rows to eval and the next n_train to train; the rest is not used."""
    out = hash_bands(df, by, key, seed, [F.lit(n_eval), F.lit(n_eval + n_train)]).where("band < 2")
    return out.withColumn("split", F.when(F.col("band") == 0, "eval").otherwise("train")).drop("band", "n_group")


def cap_per_source(
    df: DataFrame, by: list[str], caps: dict[str, int], default: int | None = None, key: str = "path", seed=0
) -> DataFrame:
    """First ``caps[source]`` rows of each source in hash order; sources without a cap keep all rows."""
    quota = F.lit(default) if default is not None else F.col("n_group")
    for name, cap in caps.items():
        quota = F.when(F.col(by[0]) == name, F.lit(cap)).otherwise(quota)
    return hash_bands(df, by, key, seed, [quota.cast("long")]).where("band = 0").drop("band", "n_group")


def sample_per_class(
    df: DataFrame, k: int = 400, label: str = "label", by: list[str] = (), key: str = "path", seed=0
) -> DataFrame:
    """Up to k rows of each class, with the case of the set: both, fake-only, real-only."""
    picked = hash_bands(df.where(F.col(label).isin("ai", "real")), [*by, label], key, seed, [F.lit(k)])
    return picked.where("band = 0").drop("band", "n_group")


def sample_case(df: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """What a set can be scored on; sets without a usable label are reported too."""
    n_ai = F.count_if(F.col(label) == "ai")
    n_real = F.count_if(F.col(label) == "real")
    case = (
        F.when((n_ai > 0) & (n_real > 0), "both")
        .when(n_ai > 0, "fake-only")
        .when(n_real > 0, "real-only")
        .otherwise("label issue")
    )
    return df.groupBy(*by).agg(n_ai.alias("n_ai"), n_real.alias("n_real"), case.alias("sample_case"))


def sample_balanced_epoch(
    df: DataFrame, epochs: int, cap: int = 4000, label: str = "label", key: str = "path", seed=0
) -> DataFrame:
    """k = min(reals, ais, cap) rows of each class per epoch; every epoch has its own hash order.

    Class sizes give a threshold on the hash that somewhat more than k rows of an epoch pass. A row goes through one
    projection that keeps the epochs it may be in, so about epochs * k rows are written, whatever the size of the
    table, and the exact cut is made among them. Thresholds rise until every epoch has k rows.
    """
    rows = df.where(F.col(label).isin("ai", "real") & F.col(key).isNotNull())
    sizes = dict(rows.groupBy(label).count().collect())  # two classes
    k = min(sizes["ai"], sizes["real"], cap) if len(sizes) == 2 else 0
    epoch = F.sequence(F.lit(0), F.lit(epochs - 1))
    if k == 0:
        return rows.withColumn("epoch", F.explode(epoch)).where(F.lit(False))
    enough, tries = False, 0
    while not enough:
        spare = SPARE + 10 * tries
        shares = {c: max(0.0, k + spare * math.sqrt(k) + 4 * spare) * 2**tries / n for c, n in sizes.items()}
        # "g" comes after every hex digit
        cuts = {c: f"{int(share * 16**12):012x}" if share < 1 else "g" for c, share in shares.items()}
        cut = F.when(F.col(label) == "ai", cuts["ai"]).otherwise(cuts["real"])
        near = F.filter(epoch, lambda e: hash_hex(seed, F.concat_ws("/", e.cast("string"), F.col(key))) < cut)
        picked = materialize(rows.withColumn("epoch", F.explode(near)))
        short = picked.groupBy("epoch", label).count().where(F.col("count") >= k).count() < 2 * epochs
        enough, tries = not short, tries + 1
    picked = picked.withColumn("_ek", F.concat_ws("/", "epoch", key))
    out = hash_bands(picked, ["epoch", label], "_ek", seed, [F.lit(k)])
    return out.where("band = 0").drop("band", "n_group", "_ek")


def sample_systematic(df: DataFrame, index: str, n: str, k: int, offset: int = 0) -> DataFrame:
    """Rows (offset + i * (n // k)) mod n for i < k, selected by arithmetic on the row index.

    A table with fewer than k rows has a zero step; every row is then taken.
    """
    step = F.greatest(F.lit(1), F.floor(F.col(n) / k))
    back = F.pmod(F.col(index) - F.lit(offset), F.col(n))
    return df.where((back % step == 0) & (back / step < k))


def dedup_exact(df: DataFrame, key: str, order: list[Column], keep: list[str]) -> DataFrame:
    """First row per non-empty key in ``order``; rows without a key pass.

    A combined minimum instead of a window: copies collapse before the shuffle, so a key shared by a
    third of all rows is as cheap as any other. Copies tied in ``order`` must agree in ``keep``.
    """
    has = F.coalesce(F.col(key) != "", F.lit(False))
    ranked = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in keep])
    first = df.where(has).groupBy(key).agg(F.min(ranked).alias("_first"))
    kept = first.select(key, *[F.col(f"_first.{c}").alias(c) for c in keep if c != key])
    return kept.unionByName(df.where(~has).select(key, *[c for c in keep if c != key]))


def dedup_prefix(
    df: DataFrame, content: str, order: list[Column], keep: list[str], size: int = 256, confirm: bool = True
) -> DataFrame:
    """First row per equal leading bytes, confirmed by a hash of the whole content.

    ``confirm=False`` goes by the leading bytes alone; ``n_merged`` then counts the different contents that a kept row
    stands for, so that false merges show. Confirmed rows have 1 there; rows without content pass with null.
    """
    whole = F.sha2(F.col(content).cast("binary"), 256)
    prefix = F.hex(F.substring(F.col(content).cast("binary"), 1, size))
    key = F.when(F.length(prefix) > 0, F.concat_ws(":", prefix, whole) if confirm else prefix)
    rows = df.withColumn("_p", key).withColumn("_w", whole)
    kept = dedup_exact(rows, "_p", order, keep)
    merged = rows.where("_p IS NOT NULL").groupBy("_p").agg(F.count_distinct("_w").alias("n_merged"))
    return kept.join(merged, "_p", "left").drop("_p")


def mine_hard(df: DataFrame, k_real: int = 200, k_ai: int = 200, thr: float = THRESHOLD, key: str = "path") -> DataFrame:
    """Reals scored as ai by descending score and ais scored as real by ascending score, never from sealed.

    ``orderBy().limit()`` keeps k rows per task; no class is ever collected.
    """
    pool = df.where(F.coalesce(F.col("split") != "sealed", F.lit(True)))
    real = pool.where((F.col("label") == "real") & (F.col("p") >= thr)).orderBy(F.desc("p"), key).limit(k_real)
    ai = pool.where((F.col("label") == "ai") & (F.col("p") < thr)).orderBy("p", key).limit(k_ai)
    return real.unionByName(ai).withColumn("conf", F.round("p", 4))


def hard_reason(name: Column, lap: Column, block: Column) -> Column:
    """Reason code by ordered rules; a missing signal means the image was unreadable."""
    low = F.lower(name)
    paired = F.contains(low, F.lit("pair")) | F.contains(low, F.lit("matched")) | F.contains(low, F.lit("real"))
    return (
        F.when(lap.isNull() | block.isNull(), "review")
        .when(paired, "matched_pair")
        .when(block > 6.0, "jpeg_artifact")
        .when(lap > 26.0, "camera_noise")
        .when(lap < 8.0, "generator")
        .otherwise("review")
    )


def hard_histograms(df: DataFrame) -> DataFrame:
    """(kind, value, n) counts by reason and by source, in one pass."""
    sides = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("reason", "source")])
    return df.select(F.inline(sides)).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def append_hard_capped(
    train: DataFrame, hard: DataFrame, floor: int = 200, factor: int = 2, seed=0, reason_rule: bool = False
) -> DataFrame:
    """Append hard rows to train, at most max(floor, factor * ordinary rows of the source) each.

    ``reason_rule`` groups and looks up by the reason text instead of the true source.
    """
    rows = hard.where(F.coalesce(F.col("path") != "", F.lit(False)))
    group = F.coalesce(F.col("reason"), F.lit("review")) if reason_rule else F.col("source")
    rows = rows.withColumn("_src", group)
    ordinary = train.groupBy(F.col("source").alias("_src")).agg(F.count(F.lit(1)).alias("_t"))

    def limit(groups: DataFrame) -> DataFrame:
        seen = join_keys(groups, ordinary, ["_src"], "left")
        allowed = F.lit(factor) * F.greatest(F.lit(1), F.coalesce("_t", F.lit(0)))
        return seen.withColumn("q0", F.greatest(F.lit(floor), allowed)).drop("_t")

    kept = hash_bands(rows, ["_src"], "path", seed, limit).where("band = 0")
    kept = kept.select("label", F.concat(F.lit("hard:"), "_src").alias("source"), "path")
    return train.select("label", "source", "path").unionByName(kept)


def threshold_sweep(df: DataFrame, by: list[str], steps: int = 201) -> DataFrame:
    """(by, i, t, recall, fpr) on an even grid of thresholds.

    One histogram of p over the grid and a reverse running sum over at most ``steps`` rows per group:
    thresholds never multiply the data.
    """
    grid = F.array(*[F.lit(i / (steps - 1)) for i in range(steps)])
    # last grid threshold <= p; -1 below the grid
    guess = F.floor(F.col("p") * (steps - 1)).cast("int")
    up = F.when(F.try_element_at(grid, guess + 2) <= F.col("p"), guess + 1).otherwise(guess)
    slot = F.when(F.try_element_at(grid, F.greatest(F.lit(1), up + 1)) > F.col("p"), up - 1).otherwise(up)
    slot = F.least(F.greatest(slot, F.lit(-1)), F.lit(steps - 1))
    hist = scored(df).groupBy(*by, slot.alias("i")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("pos")
    )
    # at most steps + 1 entries per group
    entry = F.struct(F.col("i").alias("key"), F.struct("n", "pos").alias("value"))
    filled = hist.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    full = filled.select(*by, "_m", F.explode(F.sequence(F.lit(-1), F.lit(steps - 1))).alias("i"))
    cell = F.try_element_at("_m", F.col("i"))
    n, pos = F.coalesce(cell["n"], F.lit(0)), F.coalesce(cell["pos"], F.lit(0))
    full = full.select(*by, "i", pos.alias("pos"), (n - pos).alias("neg"))
    above = Window.partitionBy(*by).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    out = full.select(
        *by,
        "i",
        F.try_divide(F.sum("pos").over(above), F.sum("pos").over(whole)).alias("recall"),
        F.try_divide(F.sum("neg").over(above), F.sum("neg").over(whole)).alias("fpr"),
    )
    return out.where("i >= 0").withColumn("t", F.element_at(grid, F.col("i") + 1))


def sweep_pick(sweep: DataFrame, by: list[str], max_fpr: float = 0.03) -> DataFrame:
    """Best recall with fpr <= max_fpr, the largest threshold on ties; nulls when none qualifies."""
    ok = (F.col("fpr") <= max_fpr) & (F.col("recall") >= 0)
    best = F.max(F.when(ok, F.struct("recall", "t", "fpr")))
    return sweep.groupBy(*by).agg(best.alias("_b")).select(
        *by, F.col("_b.t").alias("t"), F.col("_b.recall").alias("recall"), F.col("_b.fpr").alias("fpr")
    )


def operating_point(df: DataFrame, by: list[str], min_real_recall: float = 0.98) -> DataFrame:
    """Score with real recall >= min_real_recall and the best ai recall; the largest one on ties."""
    run = cumulative_cells(df, by)
    n_pos = F.col("all_n_pos")
    n_neg = F.col("all_n") - n_pos
    neg_below = F.col("cum_n") - F.col("cum_n_pos") - (F.col("n") - F.col("n_pos"))
    pos_from = n_pos - F.col("cum_n_pos") + F.col("n_pos")
    real, ai = F.try_divide(neg_below, n_neg), pos_from / F.greatest(F.lit(1), n_pos)
    ok = (n_neg > 0) & (real >= min_real_recall)
    best = F.max(F.when(ok, F.struct(ai.alias("ai_recall"), F.col("p").alias("t"), real.alias("real_recall"))))
    return run.groupBy(*by).agg(best.alias("_b")).select(
        *by,
        F.col("_b.t").alias("t"),
        F.col("_b.ai_recall").alias("ai_recall"),
        F.col("_b.real_recall").alias("real_recall"),
    )


def response_deltas(df: DataFrame, key: str, variants: list[str], crops: list[str], centre: str) -> DataFrame:
    """Per asset: clean score, variant minus clean, population std of the crops, largest distance to the centre crop.

    ``df`` holds one row per (asset, variant, p); a bounded number of rows per asset, one shuffle.
    """
    def of(name: str) -> Column:
        return F.max(F.when(F.col("variant") == name, F.col("p")))

    clean = of("clean")
    is_crop = F.col("variant").isin(*crops)
    far = F.greatest(
        F.max(F.when(is_crop, F.col("p"))) - of(centre), of(centre) - F.min(F.when(is_crop, F.col("p")))
    )
    return df.groupBy(key).agg(
        clean.alias("p_clean"),
        *[(of(v) - clean).alias(f"d_{v}") for v in variants],
        F.stddev_pop(F.when(is_crop, F.col("p"))).alias("crop_std"),
        far.alias("max_crop_delta"),
    )
