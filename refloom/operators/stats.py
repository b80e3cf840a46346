"""Statistics of rate series as aggregates: intervals, trends, baselines, resampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The interval of a proportion."""
    p, z2 = k / n, z * z
    mid, half = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return (mid - half) / (1 + z2 / n), (mid + half) / (1 + z2 / n)


def trend(series: DataFrame, x: str, y: str, group: list[str] | None = None) -> DataFrame:
    """M8: slope and intercept of a straight line, from three points on."""
    g = series.groupBy(*(group or []))
    return g.agg(F.count("*").alias("points"), F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept")).filter("points >= 3")


def _weighted_line(s: DataFrame, x: Column, y: Column, w: Column) -> DataFrame:
    sums = {"s0": w, "sx": w * x, "sy": w * y, "sxx": w * x * x, "sxy": w * x * y}
    m = s.agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    slope = (F.col("s0") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.col("s0") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
    return m.select(slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("s0")).alias("intercept"))


def excess(series: DataFrame, x: str, y: str, w: str, cut: float) -> DataFrame:
    """The weighted mean excess after ``cut`` over a flat and over a linear baseline fitted before it.

    The line is fitted with squared weights, as rows multiplied by their weight are; years are taken from ``cut``, so
    that the moments stay well conditioned.
    """
    s = series.select((F.col(x) - cut).alias("x"), F.col(y).alias("y"), F.col(w).cast("double").alias("w"))
    before, after = s.filter("x < 0"), s.filter("x >= 0")
    flat = before.agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("flat"))
    line = _weighted_line(before, F.col("x"), F.col("y"), F.col("w") * F.col("w"))
    both = after.join(F.broadcast(flat)).join(F.broadcast(line))  # one row each
    mean = lambda c: F.round(F.sum(F.col("w") * c) / F.sum("w"), 6)
    return both.agg(mean(F.col("y") - F.col("flat")).alias("over_flat"), mean(F.col("y") - F.col("slope") * F.col("x") - F.col("intercept")).alias("over_linear"), mean(F.col("y")).alias("post_mean"))


def between_spread(series: DataFrame, y: str, n: str) -> DataFrame:
    """M3: spread of the rates between periods and what binomial noise leaves of it."""
    noise = F.avg(F.col(y) * (1 - F.col(y)) / F.col(n))
    return series.agg(F.count("*").alias("periods"), F.round(F.stddev_samp(y), 6).alias("spread"), F.round(F.var_samp(y) - noise, 8).alias("excess_variance"))


def rule_of_three(bad: Column, n: Column) -> Column:
    """M6: the upper bound in percent where nothing was seen, else null."""
    return F.when((bad == 0) & (n > 0), F.round(F.lit(300.0) / n, 6))


#: The distribution function of a Poisson variable of mean one, from 0 to 8.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9)]


def poisson_weight(key: Column, replicate: Column, seed: int = 0) -> Column:
    """A Poisson(1) draw that depends on key, replicate and seed alone, by its distribution function."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), replicate.cast("string"), F.lit(str(seed))).cast("binary"))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    out = F.when(u < POISSON[0], 0)
    for k, c in enumerate(POISSON[1:], 1):
        out = out.when(u < c, k)
    return out.otherwise(9)


def cluster_bootstrap(papers: DataFrame, paper: str, bad: str, total: str, group: list[str], replicates: int = 200, seed: int = 0) -> DataFrame:
    """M1: the interval of a ratio over papers drawn again and again, without a driver's loop.

    Weights are drawn for every paper and replicate on the fly and summed at once, so the shuffle holds one row for each
    group and replicate of a partition, however many papers there are.
    """
    r = papers.select(*group, paper, bad, total, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    w = poisson_weight(F.col(paper), F.col("replicate"), seed)
    sums = r.groupBy(*group, "replicate").agg(F.sum(w * F.col(bad)).alias("b"), F.sum(w * F.col(total)).alias("t")).filter("t > 0").withColumn("rate", F.col("b") / F.col("t"))
    return sums.groupBy(*group).agg(F.count("*").alias("replicates"), F.round(F.stddev_samp("rate"), 6).alias("se"), F.round(F.percentile("rate", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("rate", F.lit(0.975)), 6).alias("high"))


def normal_cdf(x: Column) -> Column:
    """The normal distribution function by a rational approximation, exact to 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def power(effect: Column, se: Column, z: float = 1.96) -> Column:
    """M4: the power of a two-sided test of an effect with that standard error."""
    d = effect / se
    return 1 - normal_cdf(F.lit(z) - d) + normal_cdf(-F.lit(z) - d)


def detrended(series: DataFrame, x: str, y: str, cut: float) -> DataFrame:
    """M9: what every point exceeds the line by that is fitted to the points before ``cut``."""
    line = series.filter(F.col(x) < cut).agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"))
    return series.join(F.broadcast(line)).select(x, F.round(F.col(y) - F.col("a") - F.col("b") * F.col(x), 6).alias("excess"))  # one row


def year_effects(rows: DataFrame, year: str, bad: str, total: str, base: int) -> DataFrame:
    """Differences of the weighted mean rates to that of the base year, with their standard error."""
    r = F.col(bad) / F.col(total)
    g = rows.filter(F.col(total) > 0).groupBy(year).agg(F.sum(bad).alias("b"), F.sum(total).alias("t"), F.sum(F.col(total) * r * r).alias("s"), F.count("*").alias("n"))
    g = g.select(year, (F.col("b") / F.col("t")).alias("mean"), (F.col("s") / F.col("t") - (F.col("b") / F.col("t")) ** 2).alias("var"), "n")
    ref = g.filter(F.col(year) == base).select(F.col("mean").alias("m0"), F.col("var").alias("v0"), F.col("n").alias("n0"))
    return g.join(F.broadcast(ref)).select(year, F.round(F.col("mean") - F.col("m0"), 6).alias("effect"), F.round(F.sqrt(F.col("var") / F.col("n") + F.col("v0") / F.col("n0")), 6).alias("se"))  # one row


def onset_sweep(rows: DataFrame, x: str, bad: str, total: str, onsets: list[float]) -> DataFrame:
    """M5: the rate before and after each assumed onset, in one pass."""
    r = rows.select(x, bad, total, F.explode(F.array(*[F.lit(float(o)) for o in onsets])).alias("onset"))
    late = F.col(x) >= F.col("onset")
    sums = r.groupBy("onset").agg(*[F.sum(F.when(c, F.col(v))).alias(f"{v_}_{k}") for k, c in (("pre", ~late), ("post", late)) for v, v_ in ((bad, "b"), (total, "t"))])
    return sums.select("onset", F.round(F.col("b_pre") / F.col("t_pre"), 6).alias("pre"), F.round(F.col("b_post") / F.col("t_post"), 6).alias("post"), F.round(F.col("b_post") / F.col("t_post") - F.col("b_pre") / F.col("t_pre"), 6).alias("difference"))


def design_effect(boot: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """M2: the variance over clusters by that of as many independent references, and the median of all groups."""
    p = F.col("bad") / F.col("total")
    each = boot.select(key, "se").join(totals.select(key, "bad", "total"), key).withColumn("deff", F.col("se") * F.col("se") / F.nullif(p * (1 - p) / F.col("total"), F.lit(0.0)))
    return each.filter(F.col("deff").isNotNull()).agg(F.count("*").alias("groups"), F.round(F.percentile("deff", F.lit(0.5)), 3).alias("median_deff"))


RATES = (0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2, 2.0)


def excess_forms(series: DataFrame, x: str, y: str, w: str, cut: float) -> DataFrame:
    """M7: the weighted mean excess after ``cut`` over three baselines fitted before it (flat, linear, exponential to a floor
    with the rate of the least weighted error), and whether all three agree in sign."""
    s = series.select((F.col(x) - cut).alias("x"), F.col(y).alias("y"), F.col(w).cast("double").alias("w"))
    origin = s.agg(F.min("x").alias("x0"))
    s = s.join(F.broadcast(origin))  # one row
    shapes = [F.struct(F.lit("flat").alias("form"), F.lit(0.0).alias("k"), F.lit(0.0).alias("z")), F.struct(F.lit("linear").alias("form"), F.lit(0.0).alias("k"), F.col("x").alias("z"))]
    shapes += [F.struct(F.lit("exp").alias("form"), F.lit(k).alias("k"), F.exp(-k * (F.col("x") - F.col("x0"))).alias("z")) for k in RATES]
    s = s.select("x", "y", "w", F.explode(F.array(*shapes)).alias("b")).select("x", "y", "w", "b.*")
    v = F.when(F.col("form") == "flat", F.col("w")).otherwise(F.col("w") * F.col("w"))
    before = F.col("x") < 0
    m = s.filter(before).groupBy("form", "k").agg(F.sum(v).alias("s0"), F.sum(v * F.col("z")).alias("sz"), F.sum(v * F.col("y")).alias("sy"), F.sum(v * F.col("z") * F.col("z")).alias("szz"), F.sum(v * F.col("z") * F.col("y")).alias("szy"))
    det = F.col("s0") * F.col("szz") - F.col("sz") * F.col("sz")
    slope = F.when(F.col("form") == "flat", 0.0).otherwise((F.col("s0") * F.col("szy") - F.col("sz") * F.col("sy")) / F.nullif(det, F.lit(0.0)))
    fit = m.select("form", "k", slope.alias("b"), ((F.col("sy") - slope * F.col("sz")) / F.col("s0")).alias("a"))
    error = F.col("y") - F.col("a") - F.col("b") * F.col("z")
    # Few rows: one for each form and rate.
    scored = s.join(F.broadcast(fit), ["form", "k"]).groupBy("form", "k").agg(F.sum(F.when(before, F.col("w") * error * error)).alias("sse"), (F.sum(F.when(~before, F.col("w") * error)) / F.sum(F.when(~before, F.col("w")))).alias("over"))
    best = scored.groupBy("form").agg(F.min_by(F.struct("k", "over"), F.struct("sse", "k")).alias("b"))
    pick = lambda f, c: F.max(F.when(F.col("form") == f, F.col(f"b.{c}")))
    out = best.agg(pick("flat", "over").alias("f"), pick("linear", "over").alias("l"), pick("exp", "over").alias("e"), pick("exp", "k").alias("rate"))
    same = (F.signum("f") == F.signum("l")) & (F.signum("l") == F.signum("e"))
    return out.select(F.round("f", 6).alias("over_flat"), F.round("l", 6).alias("over_linear"), F.round("e", 6).alias("over_exp"), "rate", F.when(same, "same sign").otherwise("sign flips").alias("verdict"))


def extrapolated(k: Column, n: Column, population: Column) -> Column:
    """What a sample's count comes to in the population."""
    return F.round(population * k / F.nullif(n, F.lit(0))).cast("bigint")
