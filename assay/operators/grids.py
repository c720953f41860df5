"""Feature jobs on grids (id, h, w, grid ARRAY<DOUBLE>, row-major gray values 0..255).

One pass over the rows computes any set of features: Arrow batches go to numpy kernels as stacks of
equally sized grids, in chunks of bounded memory. No job here shuffles beyond dealing out small inputs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions import kernels as k
from assay.functions.hashing import hash_hex

CHUNK_CELLS = 1 << 21
Kernel = Callable[[dict[str, np.ndarray], np.ndarray], Iterator[dict[str, np.ndarray]]]


def _stack(column: pa.Array, h: int, w: int) -> np.ndarray:
    """(n, h, w) view of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), h, w)


def _arrow(values: np.ndarray, n: int) -> pa.Array:
    if isinstance(values, str):
        return pa.array([values] * n, pa.string())
    if values.ndim == 1:
        return pa.array(values)
    flat = values.reshape(n, -1)
    offsets = pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))


def grid_job(df: DataFrame, inputs: list[str], keep: list[str], kernel: Kernel, out: str, seed=0, tasks: int = 0) -> DataFrame:
    """(keep, outputs) rows of ``kernel``, which maps stacks and per-asset hashes to columns.

    ``keep[0]`` is the asset key that seeds the noise. Rows of one batch may differ in size; they are
    stacked per size. Chunks hold about CHUNK_CELLS cells. Rows with a missing, incomplete or null plane are left out.
    ``tasks`` deals the rows out anew; by default they stay as the scan split them.
    """
    names = out.split(", ")
    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + names)
    labels = [*keep, *[n.rsplit(" ", 1)[0] for n in names]]
    base = F.conv(F.substring(hash_hex(seed, F.col(keep[0])), 1, 8), 16, 10).cast("long")
    carried = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    # every plane must be there with a value in each cell
    sound = [F.coalesce((F.size(c) == F.col("h") * F.col("w")) & ~F.exists(c, lambda v: v.isNull()), F.lit(False)) for c in inputs]
    rows = df.where(reduce(and_, sound)).select(*carried, "h", "w", *inputs, base.alias("_base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, ws = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "w"))
            for h, w in sorted(set(zip(hs.tolist(), ws.tolist()))):
                at = np.flatnonzero((hs == h) & (ws == w))
                step = max(1, CHUNK_CELLS // max(1, h * w))
                for lo in range(0, len(at), step):
                    part = batch.take(pa.array(at[lo : lo + step]))
                    stacks = {c: _stack(part.column(c), h, w) for c in inputs}
                    hashes = part.column("_base").to_numpy(zero_copy_only=False)
                    for made in kernel(stacks, hashes):
                        cols = [part.column(f"_k{i}") for i in range(len(keep))]
                        cols += [_arrow(made[c], part.num_rows) for c in labels[len(keep) :]]
                        yield pa.RecordBatch.from_arrays(cols, names=labels)

    return (rows.repartition(tasks) if tasks else rows).mapInArrow(run, schema)


# feature -> function of (gray stack, rgb stack or None, options)
_RGB = ("colorfulness", "sat_mean", "sat_std", "unique_colors")


def _compute(name: str, g: np.ndarray, rgb: np.ndarray | None, opt: dict) -> np.ndarray:
    if name.startswith("roundtrip_q") or name.startswith("ela_q"):
        return k.block_loss(g, int(name.rsplit("q", 1)[1]))
    table: dict[str, Callable[[], np.ndarray]] = {
        "noise_sigma": lambda: k.noise_sigma(g),
        "blockiness": lambda: k.block_ratio(g),
        "blockiness_phase": lambda: k.block_phase(g),
        "grain": lambda: k.grain(g),
        "hf_energy_ratio": lambda: k.spectrum(g)[0],
        "spectral_flatness": lambda: k.spectrum(g)[1],
        "hf_ratio": lambda: k.band_ratio(g, opt.get("low", (1, 16)), opt.get("high", (32, 64))),
        "grad_mean": lambda: k.sobel(g).mean(k.CELLS),
        "sharp_edges": lambda: (k.sobel(g) > opt.get("sharp", 60.0)).mean(k.CELLS),
        "flatness": lambda: (k.local_std(g) < opt.get("flat", 1.0)).mean(k.CELLS),
        "colorfulness": lambda: k.colorfulness(rgb),
        "sat_mean": lambda: k.saturation(rgb)[0],
        "sat_std": lambda: k.saturation(rgb)[1],
        "unique_colors": lambda: k.unique_colors(rgb),
        "lap": lambda: k.hard_signals(g)[0],
        "block": lambda: k.hard_signals(g)[1],
        "block_runs": lambda: k.hard_signals(g, spatial=False)[1],
    }
    return table[name]()


# Order of the feature vectors.
FEATURE_NAMES = (
    "noise_sigma", "ela_q90", "blockiness", "roundtrip_q55", "roundtrip_q75", "roundtrip_q95", "hf_energy_ratio",
    "spectral_flatness", "grad_mean", "sharp_edges", "flatness", "colorfulness", "sat_mean", "sat_std",
    "unique_colors", "exif_present",
)
DEGRADE_NAMES = ("blockiness_phase", "grain", "hf_ratio")


def grid_features(df: DataFrame, names: list[str], keep: list[str], **options) -> DataFrame:
    """(keep, one column per feature); only the colour features need red, green and blue columns."""
    colour = any(n in _RGB for n in names)
    inputs = ["grid", "red", "green", "blue"] if colour else ["grid"]

    def kernel(stacks: dict[str, np.ndarray], hashes: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        rgb = np.stack([stacks[c] for c in inputs[1:]]) if colour else None
        yield {n: np.asarray(_compute(n, stacks["grid"], rgb, options), dtype=float) for n in names}

    return grid_job(df, inputs, keep, kernel, ", ".join(f"{n} double" for n in names))


def feature_vector(df: DataFrame, names: list[str], keep: list[str], extra: list[str] = (), **options) -> DataFrame:
    """(keep, features) in the order of ``names``, which travel as column metadata.

    Names in ``extra`` are taken from columns of ``df`` instead of being computed, such as exif_present.
    """
    computed = [n for n in names if n not in extra]
    made = grid_features(df, computed, [*keep, *extra], **options)
    vector = F.array(*[F.col(n).cast("double") for n in names])
    return made.select(*keep, vector.alias("features", metadata={"feature_names": list(names)}))


def color_stats(df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, stats): the 97 colour statistics of red, green and blue."""
    def kernel(stacks: dict[str, np.ndarray], hashes: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        yield {"stats": k.color_stats(np.stack([stacks[c] for c in ("red", "green", "blue")]))}

    return grid_job(df, ["red", "green", "blue"], keep, kernel, "stats array<double>")


def view(df: DataFrame, keep: list[str], kind: str) -> DataFrame:
    """(keep, grid): 'highpass' residual or 'lowpass' version of every grid."""
    f = {"highpass": k.highpass, "lowpass": k.lowpass}[kind]

    def kernel(stacks: dict[str, np.ndarray], hashes: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        yield {"grid": f(stacks["grid"])}

    return grid_job(df, ["grid"], keep, kernel, "grid array<double>")


def quant_stability(df: DataFrame, keep: list[str], sigma: float = 0.06, bits: int = 5, draws: int = 3, seed=0) -> DataFrame:
    """(keep, flip_share) of channels in 0..255 under hash-seeded normal noise."""
    def kernel(stacks: dict[str, np.ndarray], hashes: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        rgb = np.stack([stacks[c] for c in ("red", "green", "blue")]) / 255.0
        yield {"flip_share": k.quant_flips(rgb, hashes, sigma, bits, draws)}

    return grid_job(df, ["red", "green", "blue"], keep, kernel, "flip_share double", seed)


CROPS = ("top_left", "top_right", "bottom_left", "bottom_right", "centre")


def crop_grid(df: DataFrame, size: int, key: str = "id") -> DataFrame:
    """Five size x size crops per asset: corners and centre. Slices of the array; stays in the JVM."""
    h, w = F.col("h"), F.col("w")
    zero = F.lit(0)
    mid_r, mid_c = (F.floor((x - size) / 2).cast("int") for x in (h, w))
    places = zip(CROPS, ((zero, zero), (zero, w - size), (h - size, zero), (h - size, w - size), (mid_r, mid_c)))
    crops = F.array(*[F.struct(F.lit(n).alias("crop"), t.alias("top"), le.alias("left")) for n, (t, le) in places])
    rows = df.select(key, "w", "grid", F.explode(crops).alias("_c"))
    lines = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda r: F.slice("grid", ((F.col("_c.top") + r) * F.col("w") + F.col("_c.left") + 1).cast("int"), size),
    )
    # cut first, rename after: an alias "w" beside the lambda would capture the old width
    cut = rows.select(key, F.col("_c.crop").alias("crop"), F.flatten(lines).alias("grid"))
    return cut.withColumns({"h": F.lit(size), "w": F.lit(size)})
