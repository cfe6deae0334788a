"""Per-read scaling by weighted least squares, in sums that combine on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def solve2(a: list[list[Column]], b: list[Column]) -> list[Column]:
    """Cramer's rule for two unknowns; null where the system has no single solution."""
    det = F.nullif(a[0][0] * a[1][1] - a[0][1] * a[1][0], F.lit(0.0))
    return [(b[0] * a[1][1] - a[0][1] * b[1]) / det, (a[0][0] * b[1] - b[0] * a[1][0]) / det]


def solve3(a: list[list[Column]], b: list[Column]) -> list[Column]:
    def det(m):
        return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])

    d = F.nullif(det(a), F.lit(0.0))
    return [det([[b[r] if c == k else a[r][c] for c in range(3)] for r in range(3)]) / d for k in range(3)]


def scale_shift(rows: DataFrame, key: str = "read_id") -> DataFrame:
    """shift and scale of mean = shift + scale * level_mean, weighted by 1 / level_sd**2; var: the residuals' dispersion."""
    w = 1 / (F.col("level_sd") * F.col("level_sd"))
    x, y = F.col("level_mean"), F.col("mean")
    s = rows.groupBy(key).agg(*[F.sum(e).alias(n) for n, e in {"w": w, "wx": w * x, "wxx": w * x * x, "wy": w * y, "wxy": w * x * y, "wyy": w * y * y}.items()], F.count("*").alias("n"))
    c = F.col
    shift, scale = solve2([[c("w"), c("wx")], [c("wx"), c("wxx")]], [c("wy"), c("wxy")])
    fit = s.select("*", shift.alias("shift"), scale.alias("scale"))
    rss = c("wyy") - c("shift") * c("wy") - c("scale") * c("wxy")
    return fit.select(key, "n", "shift", "scale", F.sqrt(F.greatest(rss, F.lit(0.0)) / c("n")).alias("var"))


def scale_shift_drift(rows: DataFrame, key: str = "read_id") -> DataFrame:
    """shift, scale and drift of mean = shift + scale * level_mean + drift * start, with the same weights.

    Sums are of distances from each key's weighted means, so that large times do not swallow small effects.
    """
    c = F.col
    one = rows.select(key, (1 / (c("level_sd") * c("level_sd"))).alias("w"), c("level_mean").alias("x"), c("start").alias("t"), c("mean").alias("y"))
    centre = one.groupBy(key).agg(F.count("*").alias("n"), *[(F.sum(c("w") * c(v)) / F.sum("w")).alias(f"m{v}") for v in "xty"])
    far = {v: c(v) - c(f"m{v}") for v in "xty"}
    sums = one.join(centre, key).groupBy(key, "n", "mx", "mt", "my").agg(*[F.sum(c("w") * far[p] * far[q]).alias(p + q) for p, q in ("xx", "xt", "tt", "xy", "ty")])
    scale, drift = solve2([[c("xx"), c("xt")], [c("xt"), c("tt")]], [c("xy"), c("ty")])
    fit = sums.select("*", scale.alias("scale"), drift.alias("drift"))
    return fit.select(key, "n", (c("my") - c("scale") * c("mx") - c("drift") * c("mt")).alias("shift"), "scale", "drift")


def noise_scale_shift(rows: DataFrame, key: str = "read_id") -> DataFrame:
    """shift_sd and scale_sd of stdv = shift_sd + scale_sd * noise_mean, weighted by noise_lambda / noise_mean**3."""
    w = F.col("noise_lambda") / F.pow("noise_mean", F.lit(3.0))
    x, y = F.col("noise_mean"), F.col("stdv")
    s = rows.groupBy(key).agg(*[F.sum(e).alias(n) for n, e in {"w": w, "wx": w * x, "wxx": w * x * x, "wy": w * y, "wxy": w * x * y}.items()])
    c = F.col
    shift, scale = solve2([[c("w"), c("wx")], [c("wx"), c("wxx")]], [c("wy"), c("wxy")])
    return s.select(key, shift.alias("shift_sd"), scale.alias("scale_sd"))


def gaussian_posterior(rows: DataFrame, key: str, x: str) -> DataFrame:
    """Normal-inverse-gamma statistics of data: mu, nu, alpha, beta."""
    return rows.groupBy(key).agg(F.avg(x).alias("mu"), F.count("*").cast("double").alias("nu"), ((F.count("*") - 1) / 2).alias("alpha"), (F.var_pop(x) * F.count("*") / 2).alias("beta"))
