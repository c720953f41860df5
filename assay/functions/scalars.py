"""Scalar rules on labels, scores, sizes and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the product contract.
THRESHOLD = 0.65
LOW_CONF = 0.35
HIGH_CONF = 0.65
RESIZE_TO = 416
INPUT_SIZE = 384
MAX_SEND_SIDE = 768
MIN_SIDE = 64
MIN_DATA_URI = 800
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)

# Label spellings read as "ai".
AI_WORDS = ("ai", "fake", "1", "true", "synthetic", "gen")
AI_WORDS_EXTRACT = ("ai", "fake", "1", "true", "synthetic")


def encode_label(label: Column) -> Column:
    return F.when(label == "ai", 1).otherwise(0)


def normalize_label(value: Column, dtype: str = "string", variant: str = "bench") -> Column:
    """Map a raw label of any type to 'ai' or 'real'; null values count as real."""
    words = AI_WORDS if variant == "bench" else AI_WORDS_EXTRACT
    if dtype == "string":
        hit = F.lower(value).isin(*words)
    elif dtype == "boolean":
        hit = value
    else:
        hit = value == 1
    return F.when(F.coalesce(hit, F.lit(False)), "ai").otherwise("real")


def source_of_path(path: Column) -> Column:
    """``a/x/real/f.jpg`` -> ``real:x``; the first 'real' part wins over 'ai'."""
    parts = F.split(path, "/")

    def tagged(word: str) -> Column:
        at = F.array_position(parts, word)
        parent = F.when(at > 1, F.try_element_at(parts, (at - 1).cast("int"))).otherwise("unknown")
        # a rooted path has "/" as the part before its first name
        parent = F.when(parent == "", "/").otherwise(parent)
        return F.concat(F.lit(word + ":"), parent)

    return (
        F.when(F.array_contains(parts, "real"), tagged("real"))
        .when(F.array_contains(parts, "ai"), tagged("ai"))
        .otherwise("unknown")
    )


def product_state(p: Column, low: float = LOW_CONF, high: float = HIGH_CONF) -> Column:
    return F.when(p >= high, "ai").when(p < low, "real").otherwise(F.when(p.isNotNull(), "uncertain"))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def softmax_positive(logits: Column) -> Column:
    """Probability of the second class from two logits, or of the only one from a single logit."""
    a, b = F.element_at(logits, 1), F.element_at(logits, 2)
    top = F.greatest(a, b)
    two = F.exp(b - top) / (F.exp(a - top) + F.exp(b - top))
    return F.when(F.size(logits) == 2, two).otherwise(sigmoid(a))


def linear_logit(x: Column, mean: Column, scale: Column, coef: Column, intercept: Column) -> Column:
    centred = F.zip_with(x, mean, lambda a, m: a - m)
    scaled = F.zip_with(centred, scale, lambda a, s: a / s)
    terms = F.zip_with(scaled, coef, lambda a, c: a * c)
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t) + intercept


def score_linear(x: Column, mean: Column, scale: Column, coef: Column, intercept: Column) -> Column:
    return sigmoid(linear_logit(x, mean, scale, coef, intercept))


def clipped_logit(p: Column, eps: float = 1e-9) -> Column:
    c = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    return F.ln(c / (F.lit(1.0) - c))


def apply_temperature(p: Column, temperature) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return sigmoid(clipped_logit(p) / F.greatest(t, F.lit(1e-6)))


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def image_eligible(src: Column, width: Column, height: Column) -> Column:
    """Large enough, has a source and is not a tiny inline image ('not seen' is a dedup)."""
    small_inline = F.startswith(src, F.lit("data:")) & (F.length(src) < MIN_DATA_URI)
    ok = (F.least(width, height) >= MIN_SIDE) & (src != "") & ~small_inline
    return F.coalesce(ok, F.lit(False))


def fit_side(width: Column, height: Column, max_side: int = MAX_SEND_SIDE) -> tuple[Column, Column]:
    """Size after shrinking the longer side to ``max_side``; never enlarges."""
    scale = F.least(F.lit(1.0), F.try_divide(F.lit(float(max_side)), F.greatest(width, height)))

    def side(v: Column) -> Column:
        return F.greatest(F.lit(1), round_half_up(v * scale)).cast("int")

    return side(width), side(height)


def resize_crop_geometry(
    width: Column,
    height: Column,
    resize_to: int = RESIZE_TO,
    crop: int = INPUT_SIZE,
    half_even: bool = True,
) -> dict[str, Column]:
    """Shortest side to ``resize_to``, centre crop: new size and crop offsets."""
    scale = F.try_divide(F.lit(float(resize_to)), F.least(width, height))
    rounded = (lambda x: F.bround(x, 0)) if half_even else round_half_up
    w = F.greatest(F.lit(1), rounded(width * scale).cast("int"))
    h = F.greatest(F.lit(1), rounded(height * scale).cast("int"))
    return {
        "new_w": w,
        "new_h": h,
        "left": F.floor((w - crop) / 2).cast("int"),
        "top": F.floor((h - crop) / 2).cast("int"),
    }


def normalize_pixels(grid: Column, channel: int) -> Column:
    mean, std = CHANNEL_MEAN[channel], CHANNEL_STD[channel]
    return F.transform(grid, lambda v: (v / F.lit(255.0) - F.lit(mean)) / F.lit(std))


def badge_text(p: Column) -> Column:
    state = product_state(p)
    word = F.when(state == "ai", "AI").when(state == "real", "real").otherwise("?")
    return F.concat(word, F.lit(" "), round_half_up(p * 100).cast("int").cast("string"), F.lit("%"))
