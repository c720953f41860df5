"""Grid features: embeddings as 8x8 grids, four of them as one 16x16 grid, three as colour channels.

The SQL twins work on one row per cell with self-joins, independently of the array expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.arrays import mean
from assay.functions.kernels import dct_matrix, gaussian_weights, scaled_table
from assay.operators import grids as g
from assay.plans.base import query, r, rounded
from assay.plans.proxies import grids, rgb_grids, wide_grids, with_ctes


def rounded_present(df: DataFrame) -> DataFrame:
    """Rounded features; null where the cells that are there give none."""
    return rounded(df.select("id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in df.columns if c != "id"]))


def _values(name: str, cols: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(repr(x) if not isinstance(x, str) else f"'{x}'" for x in row) + ")" for row in rows)
    return f"{name}({cols}) AS (VALUES {body})"


# (dr, dc, kx, ky) taps of the Sobel pair
_SOBEL = _values(
    "taps", "dr, dc, kx, ky",
    [(dr, dc, dc * (2 if dr == 0 else 1), dr * (2 if dc == 0 else 1)) for dr in (-1, 0, 1) for dc in (-1, 0, 1)],
)


@query(
    "feat_gradient",
    with_ctes(
        "px",
        body=f""", {_SOBEL},
mag AS (SELECT p.id, p.i, sqrt(sum(kx * q.v) ** 2 + sum(ky * q.v) ** 2) AS m FROM px p CROSS JOIN taps
  JOIN px q ON q.id = p.id AND q.r = least(greatest(p.r + dr, 0), 7) AND q.c = least(greatest(p.c + dc, 0), 7)
  GROUP BY p.id, p.i)
SELECT id, {r('avg(m)')} AS grad_mean, {r('avg((m > 60)::INT)')} AS sharp_edges FROM mag GROUP BY id""",
    ).replace("\n, ", ",\n", 1),
)
def q_gradient(spark, sf):
    return rounded(g.grid_features(grids(spark, sf), ["grad_mean", "sharp_edges"], ["id"]))


@query(
    "feat_flatness",
    with_ctes(
        "px",
        body=f""", {_SOBEL},
sd AS (SELECT p.id, p.i, sqrt(greatest(avg(q.v * q.v) - avg(q.v) ** 2, 0)) AS s FROM px p CROSS JOIN taps
  JOIN px q ON q.id = p.id AND q.r = least(greatest(p.r + dr, 0), 7) AND q.c = least(greatest(p.c + dc, 0), 7)
  GROUP BY p.id, p.i)
SELECT id, {r('avg((s < 12.0)::INT)')} AS flatness FROM sd GROUP BY id""",
    ).replace("\n, ", ",\n", 1),
)
def q_flatness(spark, sf):
    """Limit 12: the proxy grids are noisier than photographs."""
    return rounded(g.grid_features(grids(spark, sf), ["flatness"], ["id"], flat=12.0))


@query(
    "feat_blockiness_ratio",
    with_ctes(
        "wide",
        body=f""", d AS (SELECT a.id, a.c % 8 AS m, abs(b.v - a.v) AS x, 'h' AS k FROM wide a JOIN wide b ON b.id = a.id AND b.r = a.r AND b.c = a.c + 1
  UNION ALL SELECT a.id, a.r % 8, abs(b.v - a.v), 'v' FROM wide a JOIN wide b ON b.id = a.id AND b.c = a.c AND b.r = a.r + 1)
SELECT id, {r('''(avg(x) FILTER (k = 'h' AND m = 0) + avg(x) FILTER (k = 'v' AND m = 0)) / 2
  / ((avg(x) FILTER (k = 'h' AND m = 1) + avg(x) FILTER (k = 'v' AND m = 1)) / 2 + 1e-9)''')} AS blockiness FROM d GROUP BY id""",
    ).replace("\n, ", ",\n", 1),
)
def q_block_ratio(spark, sf):
    return rounded_present(g.grid_features(wide_grids(spark, sf), ["blockiness"], ["id"]))


@query(
    "feat_blockiness_phase",
    with_ctes(
        "wide",
        body=f""", d AS (SELECT a.id, a.r, a.c, abs(b.v - a.v) AS x, 'h' AS k FROM wide a JOIN wide b ON b.id = a.id AND b.r = a.r AND b.c = a.c + 1
  UNION ALL SELECT a.id, a.r, a.c, abs(b.v - a.v), 'v' FROM wide a JOIN wide b ON b.id = a.id AND b.c = a.c AND b.r = a.r + 1),
o AS (SELECT d.*, oy, ox, (16 - oy) // 8 * 8 AS nh, (16 - ox) // 8 * 8 AS nw FROM d CROSS JOIN range(8) y(oy) CROSS JOIN range(8) z(ox)),
e AS (SELECT id, oy, ox, x, k, (CASE WHEN k = 'h' THEN c - ox ELSE r - oy END) % 8 AS m FROM o
  WHERE r >= oy AND c >= ox AND r < oy + nh AND c < ox + nw),
p AS (SELECT id, oy, ox, (avg(x) FILTER (k = 'h' AND m = 6) + avg(x) FILTER (k = 'v' AND m = 6)) / 2
  - (avg(x) FILTER (k = 'h' AND m < 6) + avg(x) FILTER (k = 'v' AND m < 6)) / 2 AS v FROM e GROUP BY id, oy, ox)
SELECT id, {r('avg(v)')} AS blockiness_phase FROM p GROUP BY id""",
    ).replace("\n, ", ",\n", 1),
)
def q_block_phase(spark, sf):
    return rounded_present(g.grid_features(wide_grids(spark, sf), ["blockiness_phase"], ["id"]))


@query(
    "feat_grain",
    with_ctes(
        "px",
        body=f""", s AS (SELECT a.id, abs(b2.v - 2 * b1.v + a.v) + abs(d2.v - 2 * d1.v + a.v) AS lap,
    abs(e.v - d1.v) + abs(e.v - b1.v) AS grad
  FROM px a JOIN px b1 ON b1.id = a.id AND b1.r = a.r AND b1.c = a.c + 1 JOIN px b2 ON b2.id = a.id AND b2.r = a.r AND b2.c = a.c + 2
  JOIN px d1 ON d1.id = a.id AND d1.c = a.c AND d1.r = a.r + 1 JOIN px d2 ON d2.id = a.id AND d2.c = a.c AND d2.r = a.r + 2
  JOIN px e ON e.id = a.id AND e.r = a.r + 1 AND e.c = a.c + 1),
v AS (SELECT id, var_pop(v) AS var FROM px GROUP BY id)
SELECT s.id, {r('avg(lap) / (avg(grad) / 2 + max(var) + 1e-6)')} AS grain FROM s JOIN v ON s.id = v.id GROUP BY s.id""",
    ).replace("\n, ", ",\n", 1),
)
def q_grain(spark, sf):
    return rounded(g.grid_features(grids(spark, sf), ["grain"], ["id"]))


def blur_sql(src: str, out: str, n: int, sigma: float, keys: str = "id") -> str:
    """Separable Gaussian with half-sample reflection on a (keys, r, c, v) table."""
    weights = gaussian_weights(sigma)
    radius = len(weights) // 2
    taps = _values(f"{out}_k", "k, x", list(zip(range(-radius, radius + 1), weights)))

    def reflect(e: str) -> str:
        return f"CASE WHEN {e} < 0 THEN -({e}) - 1 WHEN {e} >= {n} THEN {2 * n - 1} - ({e}) ELSE {e} END"

    on = " AND ".join(f"q.{k} = p.{k}" for k in keys.split(", "))
    pk = ", ".join(f"p.{k}" for k in keys.split(", "))
    return f"""{taps},
{out}_h AS (SELECT {pk}, p.r, p.c, sum(q.v * x) AS v FROM {src} p CROSS JOIN {out}_k JOIN {src} q ON {on} AND q.r = p.r AND q.c = {reflect('p.c + k')}
  GROUP BY {pk}, p.r, p.c),
{out} AS (SELECT {pk}, p.r, p.c, sum(q.v * x) AS v FROM {out}_h p CROSS JOIN {out}_k JOIN {out}_h q ON {on} AND q.c = p.c AND q.r = {reflect('p.r + k')}
  GROUP BY {pk}, p.r, p.c)"""


@query(
    "feat_noise_sigma",
    with_ctes("wide", body="").rstrip()
    + f""",
{blur_sql('wide', 'soft', 16, 1.0)},
t AS (SELECT a.id, a.r // 2 AS ty, a.c // 2 AS tx, var_pop(a.v - b.v) AS x FROM wide a JOIN soft b ON b.id = a.id AND b.r = a.r AND b.c = a.c
  GROUP BY ALL),
k AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY x) AS n FROM t)
SELECT id, {r('sqrt(avg(x))')} AS noise_sigma FROM k WHERE n <= 6 GROUP BY id""",
)
def q_noise(spark, sf):
    return rounded_present(g.grid_features(wide_grids(spark, sf), ["noise_sigma"], ["id"]))


@query(
    "feat_spectrum",
    with_ctes(
        "px",
        body=f""", z AS (SELECT id, r, c, v - avg(v) OVER (PARTITION BY id) AS v FROM px),
f AS (SELECT id, y.u, x.w, sum(v * cos(2 * pi() * (y.u * r / 8 + x.w * c / 8))) ** 2 + sum(v * sin(2 * pi() * (y.u * r / 8 + x.w * c / 8))) ** 2 AS p
  FROM z CROSS JOIN range(8) y(u) CROSS JOIN range(5) x(w) WHERE y.u + x.w > 0 GROUP BY id, y.u, x.w)
SELECT id, {r('sum(p) FILTER (u * u + w * w > 65 / 4) / (sum(p) + 1e-9)')} AS hf_energy_ratio,
  {r('exp(avg(ln(p))) / (avg(p) + 1e-12)')} AS spectral_flatness FROM f GROUP BY id""",
    ).replace("\n, ", ",\n", 1),
)
def q_spectrum(spark, sf):
    return rounded(g.grid_features(grids(spark, sf), ["hf_energy_ratio", "spectral_flatness"], ["id"]))


@query(
    "feat_hf_ratio",
    with_ctes(
        "wide",
        body=f""", z AS (SELECT id, r, c, (v - avg(v) OVER (PARTITION BY id)) * (0.5 - 0.5 * cos(2 * pi() * r / 15)) * (0.5 - 0.5 * cos(2 * pi() * c / 15)) AS v FROM wide),
a AS (SELECT id, c, y.u, sum(v * cos(2 * pi() * u * r / 16)) AS re, sum(-v * sin(2 * pi() * u * r / 16)) AS im
  FROM z CROSS JOIN range(-8, 8) y(u) GROUP BY id, c, y.u),
f AS (SELECT id, u, x.w, sum(re * cos(2 * pi() * w * c / 16) + im * sin(2 * pi() * w * c / 16)) ** 2
  + sum(im * cos(2 * pi() * w * c / 16) - re * sin(2 * pi() * w * c / 16)) ** 2 AS p FROM a CROSS JOIN range(-8, 8) x(w) GROUP BY id, u, x.w),
b AS (SELECT id, floor(sqrt(u * u + w * w))::INT AS ring, avg(p) AS p FROM f GROUP BY ALL)
SELECT id, {r('avg(p) FILTER (ring BETWEEN 5 AND 8) / (avg(p) FILTER (ring BETWEEN 2 AND 4) + 1e-9)')} AS hf_ratio FROM b GROUP BY id""",
    ).replace("\n, ", ",\n", 1),
)
def q_hf(spark, sf):
    """Bands scaled to the 16x16 grids: rings 2..4 against 5..8."""
    return rounded_present(g.grid_features(wide_grids(spark, sf), ["hf_ratio"], ["id"], low=(1, 4), high=(4, 8)))


@query(
    "feat_colorfulness",
    with_ctes(
        "rgb",
        body=f"""SELECT id, {r('sqrt(var_pop(a) + var_pop(b)) + 0.3 * sqrt(avg(a) ** 2 + avg(b) ** 2)')} AS colorfulness
FROM (SELECT id, red - green AS a, 0.5 * (red + green) - blue AS b FROM rgb) GROUP BY id""",
    ),
)
def q_colorfulness(spark, sf):
    return rounded(g.grid_features(rgb_grids(spark, sf), ["colorfulness"], ["id"]))


@query(
    "feat_saturation",
    with_ctes(
        "rgb",
        body=f"""SELECT id, {r('avg(s)')} AS sat_mean, {r('stddev_pop(s)')} AS sat_std FROM (
  SELECT id, floor((greatest(red, green, blue) - least(red, green, blue)) / greatest(red, green, blue) * 255) / 255 AS s FROM rgb) GROUP BY id""",
    ),
)
def q_saturation(spark, sf):
    return rounded(g.grid_features(rgb_grids(spark, sf), ["sat_mean", "sat_std"], ["id"]))


@query(
    "feat_unique_colors",
    with_ctes(
        "rgb",
        body=f"""SELECT id, {r("count(DISTINCT concat_ws('/', floor(red / 16), floor(green / 16), floor(blue / 16))) / 64")} AS unique_colors
FROM rgb GROUP BY id""",
    ),
)
def q_unique(spark, sf):
    """Values are coarsened to 16 levels so that some colours repeat."""
    coarse = {c: F.transform(c, lambda v: F.floor(v / 16).cast("double")) for c in ("red", "green", "blue")}
    return rounded(g.grid_features(rgb_grids(spark, sf).withColumns(coarse), ["unique_colors"], ["id"]))


_DCT = _values("dct", "u, x, a", [(u, x, float(dct_matrix()[u, x])) for u in range(8) for x in range(8)])


def _steps(name: str, quality: int) -> str:
    return _values(name, "u, w, q", [(i // 8, i % 8, float(s)) for i, s in enumerate(scaled_table(quality))])


def requant_sql(src: str, out: str, quality: int) -> str:
    """DCT round trip of an 8x8 (id, r, c, v) table as four joins with the basis table ``dct``."""
    return f"""{_steps(out + '_q', quality)},
{out}_a AS (SELECT id, r, dct.u AS w, sum((v - 128) * a) AS v FROM {src} JOIN dct ON dct.x = c GROUP BY ALL),
{out}_b AS (SELECT id, dct.u, w, sum(v * a) AS v FROM {out}_a JOIN dct ON dct.x = r GROUP BY ALL),
{out}_c AS (SELECT id, b.u, b.w, floor(v / q + 0.5) * q AS v FROM {out}_b b JOIN {out}_q s ON s.u = b.u AND s.w = b.w),
{out}_d AS (SELECT id, e.u, dct.x AS c, sum(v * a) AS v FROM {out}_c e JOIN dct ON dct.u = e.w GROUP BY ALL),
{out} AS (SELECT id, dct.x AS r, c, least(greatest(sum(v * a) + 128, 0.0), 255.0) AS v FROM {out}_d e JOIN dct ON dct.u = e.u GROUP BY ALL)"""


LOSSES = ((90, "ela_q90"), (55, "roundtrip_q55"), (75, "roundtrip_q75"), (95, "roundtrip_q95"))


@query(
    "feat_quant_loss",
    with_ctes("px", body="").rstrip()
    + ",\n"
    + _DCT
    + ",\n"
    + ",\n".join(requant_sql("px", f"j{q}", q) for q, _ in LOSSES)
    + "\nSELECT px.id, "
    + ", ".join(f"{r(f'avg(abs(px.v - j{q}.v))')} AS {n}" for q, n in LOSSES)
    + " FROM px "
    + " ".join(f"JOIN j{q} ON j{q}.id = px.id AND j{q}.r = px.r AND j{q}.c = px.c" for q, _ in LOSSES)
    + " GROUP BY px.id",
)
def q_quant_loss(spark, sf):
    return rounded(g.grid_features(grids(spark, sf), [n for _, n in LOSSES], ["id"]))


@query(
    "feat_hard_signals",
    with_ctes(
        "wide",
        body=f""", l AS (SELECT a.id, avg(abs(a.v - 2 * b.v + d.v)) AS lap FROM wide a
  JOIN wide b ON b.id = a.id AND b.r = a.r AND b.c = a.c - 1 JOIN wide d ON d.id = a.id AND d.r = a.r - 1 AND d.c = a.c GROUP BY a.id),
s AS (SELECT id, r // 8 * 2 + c // 8 AS b, r % 8 AS y, c % 8 AS x, v FROM wide),
k AS (SELECT id, i // 64 AS b, i % 64 // 8 AS y, i % 8 AS x, v FROM wide),
m AS (SELECT 's' AS kind, * FROM s UNION ALL SELECT 'k', * FROM k),
e AS (SELECT a.kind, a.id, avg(abs(n.v - a.v)) AS edge FROM m a JOIN m n ON n.kind = a.kind AND n.id = a.id AND n.b = a.b AND n.y = a.y + 1 AND n.x = a.x GROUP BY ALL),
h AS (SELECT a.kind, a.id, avg(abs(n.v - a.v)) AS inner_d FROM m a JOIN m n ON n.kind = a.kind AND n.id = a.id AND n.b = a.b AND n.y = a.y AND n.x = a.x + 1
  WHERE a.y >= 1 GROUP BY ALL)
SELECT l.id, {r('max(lap)')} AS lap, {r("max(edge - inner_d) FILTER (e.kind = 's')")} AS block, {r("max(edge - inner_d) FILTER (e.kind = 'k')")} AS block_runs
FROM l JOIN e ON e.id = l.id JOIN h ON h.id = l.id AND h.kind = e.kind GROUP BY l.id""",
    ).replace("\n, ", ",\n", 1),
)
def q_hard_signals(spark, sf):
    return rounded_present(g.grid_features(wide_grids(spark, sf), ["lap", "block", "block_runs"], ["id"]))


_CH = "SELECT id, 0 AS ch, red AS v FROM rgb UNION ALL SELECT id, 1, green FROM rgb UNION ALL SELECT id, 2, blue FROM rgb"


@query(
    "feat_color_stats",
    with_ctes(
        "rgb",
        body=f""", ch AS ({_CH}),
mom AS (SELECT id, ch, avg(v) AS mu, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi FROM ch GROUP BY ALL),
sk AS (SELECT ch.id, ch.ch, avg((v - mu) ** 3) / (max(sd) ** 3 + 1e-6) AS skew FROM ch JOIN mom USING (id, ch) GROUP BY ALL),
hist AS (SELECT id, ch, least(floor((v - lo) / (hi - lo + 1e-6) * 8), 7)::INT AS b, count(*) / 64 AS s FROM ch JOIN mom USING (id, ch) GROUP BY ALL),
hs AS (SELECT id, red AS r1, green AS g1, blue AS b1, greatest(red, green, blue) AS mx, greatest(red, green, blue) - least(red, green, blue) + 1e-9 AS d FROM rgb),
hue AS (SELECT id, CASE WHEN d > 1e-4 THEN (CASE WHEN mx = r1 THEN (((g1 - b1) / d) % 6 + 6) % 6 WHEN mx = g1 THEN (b1 - r1) / d + 2
  ELSE (r1 - g1) / d + 4 END) / 6 ELSE 0 END AS hu, CASE WHEN mx > 1e-6 THEN d / (mx + 1e-9) ELSE 0 END AS sa FROM hs),
jh AS (SELECT id, (least(floor(least(greatest(hu, 0), 1) * (8 - 1e-4)), 7) * 8 + least(floor(least(greatest(sa, 0), 1) * (8 - 1e-4)), 7))::INT AS b,
  count(*) / 64 AS s FROM hue GROUP BY ALL),
ids AS (SELECT DISTINCT id FROM rgb)
SELECT id, ch AS pos, {r('mu')} AS value FROM mom UNION ALL SELECT id, 3 + ch, {r('sd')} FROM mom
UNION ALL SELECT id, 6 + ch, {r('skew')} FROM sk
UNION ALL SELECT ids.id, (9 + c.ch * 8 + k.b)::INT, {r('coalesce(hist.s, 0)')} FROM ids CROSS JOIN range(3) c(ch) CROSS JOIN range(8) k(b)
  LEFT JOIN hist ON hist.id = ids.id AND hist.ch = c.ch AND hist.b = k.b
UNION ALL SELECT ids.id, (33 + k.b)::INT, {r('coalesce(jh.s, 0)')} FROM ids CROSS JOIN range(64) k(b) LEFT JOIN jh ON jh.id = ids.id AND jh.b = k.b""",
    ).replace("\n, ", ",\n", 1),
)
def q_color_stats(spark, sf):
    df = g.color_stats(rgb_grids(spark, sf), ["id"])
    return rounded(df.select("id", F.posexplode("stats").alias("pos", "value")))


def box_sql(src: str, out: str, radius: int) -> str:
    n = (2 * radius + 1) ** 2
    return f"""{out} AS (SELECT a.id, a.r, a.c, sum(b.v) / {n} AS v FROM {src} a JOIN {src} b ON b.id = a.id
  AND b.r BETWEEN a.r - {radius} AND a.r + {radius} AND b.c BETWEEN a.c - {radius} AND a.c + {radius} GROUP BY ALL)"""


@query(
    "view_highpass",
    with_ctes("px", body="").rstrip()
    + f""",
{box_sql('px', 'm', 2)},
d AS (SELECT px.id, px.i, px.v - m.v AS v FROM px JOIN m ON m.id = px.id AND m.r = px.r AND m.c = px.c)
SELECT id, i::INT AS pos, {r('v / (max(abs(v)) OVER (PARTITION BY id) + 1e-6)')} AS value FROM d""",
)
def q_highpass(spark, sf):
    df = g.view(grids(spark, sf), ["id"], "highpass")
    return rounded(df.select("id", F.posexplode("grid").alias("pos", "value")))


@query(
    "view_lowpass",
    with_ctes("px", body="").rstrip()
    + f""",
{box_sql('px', 'm1', 4)},
{box_sql('m1', 'm2', 4)}
SELECT id, (r * 8 + c)::INT AS pos, {r('v')} AS value FROM m2""",
)
def q_lowpass(spark, sf):
    df = g.view(grids(spark, sf), ["id"], "lowpass")
    return rounded(df.select("id", F.posexplode("grid").alias("pos", "value")))


def noise_sql(src: str, out: str, stream: str) -> str:
    """``src`` with (id, i) and a column n of standard normals: the 32-bit mix as one step per view."""
    base = "concat('0x', substr(md5(concat_ws(':', '0', id)), 1, 8))::UBIGINT"
    start = [f"({base} + i::UBIGINT * 2654435769 + (2 * ({stream}) + {k})::UBIGINT * 2246822507) & 4294967295" for k in (0, 1)]
    mask = 4294967295

    def step(shift: int, factor: int) -> str:
        return ", ".join(f"((xor({x}, {x} >> {shift}) * {factor}) & {mask}) AS {x}" for x in ("x0", "x1"))

    u = [f"((xor({x}, {x} >> 16) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)" for x in ("x0", "x1")]
    return f"""{out}_0 AS (SELECT *, {start[0]} AS x0, {start[1]} AS x1 FROM {src}),
{out}_1 AS (SELECT * EXCLUDE (x0, x1), {step(16, 2146121005)} FROM {out}_0),
{out}_2 AS (SELECT * EXCLUDE (x0, x1), {step(15, 2221713035)} FROM {out}_1),
{out} AS (SELECT * EXCLUDE (x0, x1), sqrt(-2.0 * ln({u[0]})) * cos(2 * pi() * {u[1]}) AS n FROM {out}_2)"""


NOISE_CH = noise_sql("ch", "x", "ch * 3 + draw")


@query(
    "quant_stability",
    with_ctes("rgb", body="").rstrip()
    + f""",
ch AS (SELECT id, i, ch, draw, v / 255 AS v FROM (SELECT id, i, 0 AS ch, red AS v FROM rgb UNION ALL SELECT id, i, 1, green FROM rgb
  UNION ALL SELECT id, i, 2, blue FROM rgb) CROSS JOIN range(3) t(draw)),
{NOISE_CH}
SELECT id, {r('avg((round_even(least(greatest(v + 0.06 * n, 0), 1) * 31, 0) <> round_even(least(greatest(v, 0), 1) * 31, 0))::INT)')} AS flip_share
FROM x GROUP BY id""",
)
def q_stability(spark, sf):
    return rounded(g.quant_stability(rgb_grids(spark, sf), ["id"]))


@query(
    "crop_grid",
    with_ctes(
        "px",
        body=f"""SELECT id, crop, {r('avg(v)')} AS mean_v, {r('max(v) FILTER (px.r = top_r AND px.c = left_c)')} AS first_v FROM px
CROSS JOIN (VALUES ('top_left', 0, 0), ('top_right', 0, 3), ('bottom_left', 3, 0), ('bottom_right', 3, 3), ('centre', 1, 1)) k(crop, top_r, left_c)
WHERE r >= top_r AND r < top_r + 5 AND c >= left_c AND c < left_c + 5 GROUP BY id, crop""",
    ),
)
def q_crops(spark, sf):
    df = g.crop_grid(grids(spark, sf), 5)
    return rounded(df.select("id", "crop", mean(F.col("grid")).alias("mean_v"), F.element_at("grid", 1).alias("first_v")))


VECTOR = ("grad_mean", "colorfulness", "sat_mean", "roundtrip_q75")


@query(
    "feature_vector",
    with_ctes("rgb", body="").rstrip()
    + ",\n"
    + _SOBEL
    + ",\n"
    + _DCT
    + ",\n"
    + requant_sql("px", "j75", 75)
    + f""",
mag AS (SELECT p.id, p.i, sqrt(sum(kx * q.v) ** 2 + sum(ky * q.v) ** 2) AS m FROM px p CROSS JOIN taps
  JOIN px q ON q.id = p.id AND q.r = least(greatest(p.r + dr, 0), 7) AND q.c = least(greatest(p.c + dc, 0), 7) GROUP BY p.id, p.i),
keep AS (SELECT DISTINCT id FROM rgb)
SELECT id, 0 AS pos, 'grad_mean' AS name, {r('avg(m)')} AS value FROM mag WHERE id IN (FROM keep) GROUP BY id UNION ALL
SELECT id, 1, 'colorfulness', {r('sqrt(var_pop(red - green) + var_pop(0.5 * (red + green) - blue)) + 0.3 * sqrt(avg(red - green) ** 2 + avg(0.5 * (red + green) - blue) ** 2)')}
  FROM rgb GROUP BY id UNION ALL
SELECT id, 2, 'sat_mean', {r('avg(floor((greatest(red, green, blue) - least(red, green, blue)) / greatest(red, green, blue) * 255) / 255)')}
  FROM rgb GROUP BY id UNION ALL
SELECT px.id, 3, 'roundtrip_q75', {r('avg(abs(px.v - j75.v))')} FROM px JOIN j75 ON j75.id = px.id AND j75.r = px.r AND j75.c = px.c
  WHERE px.id IN (FROM keep) GROUP BY px.id""",
)
def q_vector(spark, sf):
    df = g.feature_vector(rgb_grids(spark, sf), list(VECTOR), ["id"])
    names = F.array(*[F.lit(n) for n in df.schema["features"].metadata["feature_names"]])
    out = df.select("id", F.posexplode("features").alias("pos", "value"))
    return rounded(out.select("id", "pos", F.element_at(names, F.col("pos") + 1).alias("name"), "value"))