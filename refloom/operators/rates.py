"""Rates over resolved references: counts by paper, month, year and field, and what is made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(bad: Column, total: Column, digits: int = 6) -> Column:
    """A share, rounded so that engines agree; null for an empty denominator."""
    return F.round(bad / F.nullif(total, F.lit(0)), digits)


def citing_year(month: Column) -> Column:
    """2000 + YY."""
    return F.lit(2000) + F.substring(month, 1, 2).cast("int")


def decimal_year(month: Column, shift: float = 0.5) -> Column:
    """T1 with 0.5, T2 with 1: the month as a decimal year."""
    return F.lit(2000) + F.substring(month, 1, 2).cast("int") + (F.substring(month, 3, 2).cast("int") - F.lit(shift)) / F.lit(12.0)


def per_paper(refs: DataFrame) -> DataFrame:
    """A1: counts of every paper."""
    return refs.groupBy("paper", "month").agg(
        F.count("*").alias("total"), F.count_if("found").alias("found"), F.count_if(~F.col("found")).alias("not_found"),
        F.count_if(~F.col("found") & ~F.col("nonacademic")).alias("not_found_academic"), F.count_if("nonacademic").alias("heuristic_filtered"),
    )


def per_month(refs: DataFrame) -> DataFrame:
    """A2: counts and the unmatched rate of every month."""
    nf = F.count_if(~F.col("found") & ~F.col("nonacademic"))
    return refs.groupBy("month").agg(F.count_distinct("paper").alias("n_papers"), F.count("*").alias("sum_refs"), F.count_if(~F.col("found")).alias("sum_not_found"), nf.alias("sum_nf_academic"), rate(nf, F.count("*")).alias("unmatched_rate"))


def channels(refs: DataFrame, least: int = 50) -> DataFrame:
    """A4: of every month the three channels over academic references; months with fewer than ``least`` are left out."""
    a = refs.filter(~F.col("nonacademic"))
    titled = F.col("has_title") & ~F.col("found")
    return a.groupBy("month").agg(
        F.count("*").alias("a_total"), F.count_if(~F.col("found")).alias("a_bad"), F.count_if("has_doi").alias("b_total"), F.count_if(F.col("has_doi") & ~F.col("found")).alias("b_bad"),
        F.count_if(titled).alias("c_total"), F.count_if(titled & (F.col("reason") == "fab_candidate")).alias("c_bad"),
    ).filter(F.col("a_total") >= least)


def by_grouping_sets(refs: DataFrame) -> DataFrame:
    """A3: by year, by journal and by both, in one pass."""
    nf = F.count_if(~F.col("found"))
    sets = refs.select(citing_year(F.col("month")).alias("year"), F.coalesce("identity", F.lit("unknown")).alias("venue"), "found")
    return sets.groupingSets([["year"], ["venue"], ["year", "venue"]], "year", "venue").agg(F.count("*").alias("total"), nf.alias("not_found"), rate(nf, F.count("*")).alias("rate"))


def reason_mix(refs: DataFrame) -> DataFrame:
    """Of each year the reasons of what was not found, with their share."""
    nf = refs.filter(~F.col("found") & ~F.col("nonacademic")).groupBy(citing_year(F.col("month")).alias("year"), F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))
    # One row for each year and reason by now, so the window holds few rows; a missing year is a year of its own.
    return nf.select("year", "reason", "n", rate(F.col("n"), F.sum("n").over(Window.partitionBy("year"))).alias("share"))


def paper_level(refs: DataFrame) -> DataFrame:
    """By month the share of papers with an unmatched reference."""
    p = refs.filter(~F.col("nonacademic")).groupBy("month", "paper").agg(F.max(~F.col("found")).alias("hit"))
    return p.groupBy("month").agg(F.count("*").alias("papers"), F.count_if("hit").alias("with_unmatched"), rate(F.count_if("hit"), F.count("*")).alias("share"))


def standardised(refs: DataFrame, band: Column, least: int = 30) -> DataFrame:
    """By year the rate as it is and the rate if each year had the bands' overall mix; thin cells are left out."""
    cells = refs.filter(~F.col("nonacademic")).groupBy(citing_year(F.col("month")).alias("year"), band.alias("band")).agg(F.count("*").alias("n"), F.count_if(~F.col("found")).alias("bad"))
    overall = cells.groupBy("band").agg(F.sum("n").alias("weight"))
    kept = cells.filter(F.col("n") >= least).join(overall, "band")
    crude = cells.groupBy("year").agg(rate(F.sum("bad"), F.sum("n")).alias("crude"))
    adjusted = kept.groupBy("year").agg(F.round(F.sum(F.col("bad") / F.col("n") * F.col("weight")) / F.sum("weight"), 6).alias("adjusted"))
    return crude.join(adjusted.withColumnRenamed("year", "__year"), F.col("year").eqNullSafe(F.col("__year")), "left").drop("__year")


def histogram(values: DataFrame, column: str, group: list[str], width: float = 0.05) -> DataFrame:
    """Counts by bin; the last bin takes the upper end."""
    last = int(round(1 / width)) - 1
    return values.filter(F.col(column).isNotNull()).groupBy(*group, F.least(F.floor(F.round(F.col(column) / width, 9)).cast("int"), F.lit(last)).alias("bin")).agg(F.count("*").alias("n"))


def confusion(labelled: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts, recall, precision and false positive rate of a prediction."""
    t, p = F.col(truth), F.col(predicted)
    tp, fp, fn, tn = F.count_if(t & p), F.count_if(~t & p), F.count_if(t & ~p), F.count_if(~t & ~p)
    return labelled.filter(t.isNotNull() & p.isNotNull()).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), rate(tp, tp + fn).alias("recall"), rate(tp, tp + fp).alias("precision"), rate(fp, fp + tn).alias("fpr"))


def threshold_sweep(scores: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """At each threshold what passes of either class, in one pass."""
    t = F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold")
    s = scores.select(score, truth, t)
    return s.groupBy("threshold").agg(F.count_if(F.col(truth) & (F.col(score) >= F.col("threshold"))).alias("kept"), F.count_if(~F.col(truth) & (F.col(score) >= F.col("threshold"))).alias("leaked"))


def top_k(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values; equally frequent ones by value."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def candidate_rate(refs: DataFrame, group: list) -> DataFrame:
    """Of academic references those that nothing explains."""
    bad = F.count_if(~F.col("found") & (F.col("reason") == "fab_candidate"))
    return refs.filter(~F.col("nonacademic")).groupBy(*group).agg(F.count("*").alias("total"), bad.alias("candidates"), rate(bad, F.count("*")).alias("rate"))


def lag_controlled(refs: DataFrame, lag: int = 2) -> DataFrame:
    """By year, references to works at least ``lag`` years older than the paper, and to younger ones."""
    s = refs.filter(~F.col("nonacademic") & F.col("y").isNotNull()).withColumn("year", citing_year(F.col("month")))
    old, bad = F.col("y") <= F.col("year") - lag, ~F.col("found")
    # A missing year is neither.
    young = F.col("y") > F.col("year") - lag
    return s.groupBy("year").agg(
        F.count_if(old).alias("lagged"), F.count_if(old & bad).alias("lagged_bad"), F.count_if(young).alias("recent"), F.count_if(young & bad).alias("recent_bad"),
        F.count_if(F.col("has_title") & old & bad & (F.col("reason") == "fab_candidate")).alias("candidates"), F.count_if(F.col("has_doi") & old).alias("with_doi"),
    )


def pre_post(refs: DataFrame, field: str, cut: int, least: int = 10_000) -> DataFrame:
    """A10: of each field the rate before and since a year; fields with ``least`` references or fewer on a side are left out."""
    y = citing_year(F.col("month"))
    pre, post, bad = y < cut, y >= cut, ~F.col("found")
    g = refs.filter(~F.col("nonacademic")).groupBy(field).agg(F.count_if(pre).alias("pre_total"), F.count_if(post).alias("post_total"), rate(F.count_if(pre & bad), F.count_if(pre)).alias("pre"), rate(F.count_if(post & bad), F.count_if(post)).alias("post"))
    return g.filter((F.col("pre_total") > least) & (F.col("post_total") > least))


def shifted_shares(rows: DataFrame, period: str, kind: str) -> DataFrame:
    """Counts of each kind and how its share differs between the last period and the first."""
    n = rows.groupBy(period, kind).agg(F.count("*").alias("n"))
    # One row for each period and kind by now.
    s = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(period)))
    ends = F.broadcast(n.agg(F.min(period).alias("__a"), F.max(period).alias("__b")))  # one row
    at = lambda e: F.coalesce(F.sum(F.when(F.col(period) == F.col(e), F.col("share"))), F.lit(0.0))
    return s.join(ends).groupBy(kind).agg(F.sum("n").alias("n"), F.round(at("__b") - at("__a"), 6).alias("shift"))


def months(bounds: DataFrame, first: str, last: str) -> DataFrame:
    """(month) as YYMM from the first to the last."""
    day = lambda c: F.to_date(F.concat(F.lit("20"), F.col(c), F.lit("01")), "yyyyMMdd")
    return bounds.select(F.explode(F.sequence(day(first), day(last), F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyMM").alias("month"))
