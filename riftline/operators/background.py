"""Background model: windowed bin moments, negative-binomial fits and tails, multiple testing."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..settings import DEFAULTS
from ..storage import stored
from .annotate import ends


def bins(reads: DataFrame, size: int = DEFAULTS.bg_bin_size, length: int = DEFAULTS.contig_length) -> DataFrame:
    b = F.floor(F.col("pos") / size).cast("long")
    return ends(reads).withColumn("bin", b).where(F.col("bin").between(0, max(1, length // size) - 1)).groupBy("chrom", "bin").agg(F.count("*").alias("n"))


def window_moments(binned: DataFrame, size: int = DEFAULTS.bg_bin_size, window: int = DEFAULTS.bg_window_size, length: int = DEFAULTS.contig_length) -> DataFrame:
    """Mean and population variance per contig of all windows' sums, empty ones included, without making them."""
    h, n = (window // size) // 2, max(1, length // size)
    at = binned.withColumn("i", F.explode(F.sequence(F.greatest(F.col("bin") - h + 1, F.lit(0)), F.least(F.col("bin") + h, F.lit(n - 1))))).groupBy("chrom", "i").agg(F.sum("n").alias("w"))
    return at.groupBy("chrom").agg((F.sum("w") / n).alias("mean"), (F.sum(F.col("w") * F.col("w")) / n).alias("square")).select("chrom", "mean", (F.col("square") - F.col("mean") * F.col("mean")).alias("var"))


def nb_params(moments: DataFrame) -> DataFrame:
    """Moment fit of r and p, with the limits of degenerate cases."""
    m, v = F.col("mean"), F.col("var")
    r = F.when(m <= 0, 1e6).when(v <= m, 1e6).otherwise(F.least(F.greatest(m * m / (v - m), F.lit(0.01)), F.lit(1e8)))
    p = F.when(m <= 0, 0.999).when(v <= m, 1e6 / (1e6 + m)).otherwise(F.least(F.greatest(m / v, F.lit(1e-10)), F.lit(1 - 1e-10)))
    return moments.select("chrom", r.alias("r"), p.alias("p"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def poisson_tail(k: int, rate: float) -> float:
    """P(X >= k)."""
    if k <= 0 or rate <= 0:
        return float(k <= 0)
    if rate < k:  # the tail itself, term by term
        term, total, i = math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)), 0.0, k
        while term > total * 1e-17:
            total, i = total + term, i + 1
            term *= rate / i
        return min(total, 1.0)
    return max(0.0, 1 - math.fsum(math.exp(i * math.log(rate) - rate - math.lgamma(i + 1)) for i in range(k)))


def nb_tail(obs: float, r: float, p: float, rate: float) -> float:
    """P(X >= obs) of the contig's distribution scaled to the local rate."""
    if obs <= 0:
        return 1.0
    if rate <= 0:
        return 0.0
    if r < 1e5:
        r = max(0.01, r * rate / (r * (1 - p) / p))
        return incomplete_beta(obs, r, rate / (r + rate))
    return poisson_tail(int(obs), rate)


@F.pandas_udf(DoubleType())
def nb_p(obs: pd.Series, r: pd.Series, p: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series([nb_tail(*x) for x in zip(obs, r, p, rate, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def poisson_p(obs: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series([poisson_tail(int(k), x) for k, x in zip(obs, rate, strict=True)], dtype=float)


def local_rates(clusters: DataFrame, binned: DataFrame, size: int = DEFAULTS.bg_bin_size, window: int = DEFAULTS.bg_window_size) -> DataFrame:
    """(event_id, rate_a, rate_b): counts of the bins within half a window of each side."""
    h = (window // size) // 2
    side = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"c{s}").alias("chrom"), F.floor(F.col(f"median_{s}") / size).cast("long").alias("c")) for s in "ab"))
    at = clusters.select("event_id", F.explode(side).alias("e")).select("event_id", "e.*").withColumn("bin", F.explode(F.sequence(F.col("c") - h, F.col("c") + h)))
    got = at.join(binned, ["chrom", "bin"], "left").groupBy("event_id").agg(*(F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(f"rate_{s}") for s in "ab"))
    return got


def background(clusters: DataFrame, reads: DataFrame) -> DataFrame:
    """Adds rates and tail probabilities of both sides, and the lesser as background_p."""
    binned = stored(bins(reads))
    fit = nb_params(window_moments(binned))
    out = clusters.join(local_rates(clusters, binned), "event_id")
    for s in "ab":
        own = fit.select(F.col("chrom").alias(f"c{s}"), F.col("r").alias("r"), F.col("p").alias("p"))
        out = out.join(own, f"c{s}", "left").fillna({"r": 1e6, "p": 0.999})
        out = out.withColumn(f"p_{s}", nb_p(F.col("support").cast("double"), "r", "p", F.col(f"rate_{s}").cast("double"))).drop("r", "p")
    return out.withColumn("background_p", F.least("p_a", "p_b"))


def bh_adjusted(rows: DataFrame, p: str, out: str = "q") -> DataFrame:
    """Benjamini-Hochberg: the least of p * n / rank over this and larger p. Runs over one row per distinct p."""
    per = rows.groupBy(p).agg(F.count("*").alias("times"))
    up = Window.orderBy(F.col(p))
    scaled = per.withColumn("rank", F.sum("times").over(up)).withColumn("n", F.sum("times").over(Window.partitionBy()))
    per = scaled.withColumn(out, F.least(F.min(F.col(p) * F.col("n") / F.col("rank")).over(Window.orderBy(F.desc(p))), F.lit(1.0))).select(p, out)
    return rows.join(per, p)
