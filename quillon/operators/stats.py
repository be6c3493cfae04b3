"""Paired tests: statistics as aggregations, p-values from them."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import adjusted_p, counted_before, joined, with_average_rank


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h


def t_p_value(t: float, df: float) -> float:
    """Two-sided."""
    if df <= 0 or math.isnan(t):
        return float("nan")
    return 0.0 if math.isinf(t) else _incomplete_beta(df / 2, 0.5, df / (df + t * t))


def wilcoxon_p_value(w: float, n: int, ties: float, zeros: int = 0) -> float:
    """Two-sided: exact for n up to 50 without ties, else by the normal law with its variance corrected for ties (sum of t^3 - t); zeros: differences of 0 that were ranked too."""
    if n == 0:
        return 1.0
    if zeros:
        m = n + zeros
        mean = (m * (m + 1) - zeros * (zeros + 1)) / 4
        var = (m * (m + 1) * (2 * m + 1) - zeros * (zeros + 1) * (2 * zeros + 1)) / 24 - ties / 48
        return math.erfc(abs(w - mean) / math.sqrt(var) / math.sqrt(2)) if var > 0 else 1.0
    if n <= 50 and not ties and w == int(w):
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(var) / math.sqrt(2)) if var > 0 else 1.0


def _t_column(t: Column, df: Column) -> Column:
    return F.pandas_udf(lambda a, b: pd.Series([t_p_value(x, y) if x == x else float("nan") for x, y in zip(a, b)], dtype=float), "double")(t, df)


def _w_column(w: Column, n: Column, ties: Column, zeros: Column) -> Column:
    return F.pandas_udf(lambda a, b, c, d: pd.Series([wilcoxon_p_value(x, int(y), z, int(u)) for x, y, z, u in zip(a, b, c, d)], dtype=float), "double")(*(x.cast("double") for x in (w, n, ties, zeros)))


def paired_t(pairs: DataFrame, *group: str) -> DataFrame:
    """Rows with a and b not null: group, n, mean_diff, t, cohens_d (infinite where all differences are equal), p."""
    d = pairs.where("a IS NOT NULL AND b IS NOT NULL").withColumn("d", F.col("b") - F.col("a"))
    out = d.groupBy(*group).agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"))
    out = out.withColumn("cohens_d", F.when(F.col("sd") == 0, F.when(F.col("mean_diff") == 0, 0.0).otherwise(F.lit(float("inf")))).otherwise(F.try_divide("mean_diff", "sd")))
    out = out.withColumn("t", F.try_divide(F.col("mean_diff"), F.col("sd") / F.sqrt("n")))
    return out.withColumn("p", _t_column(F.coalesce("t", F.lit(float("nan"))), (F.col("n") - 1).cast("double"))).drop("sd")


def wilcoxon(pairs: DataFrame, *group: str, zeros: str = "wilcox", least: int = 0) -> DataFrame:
    """Rows with a and b not null, for each group of at least `least` pairs: the signed-rank test of b against a.

    Columns: group, n_pairs, n (differences that aren't 0), n_ties (those that are), ties_pct, statistic min(W+, W-), z,
    effect_size_r (of no sign), mean_diff, p. zeros: `wilcox` leaves differences of 0 out, `pratt` ranks them and leaves
    their ranks out. z ignores ties, as the effect size is defined; p doesn't. With no difference at all the statistic
    is 0 and p is 1. Groups are ranked over their distinct differences, by ranges, never in one task.
    """
    d = pairs.where("a IS NOT NULL AND b IS NOT NULL").withColumn("d", F.col("b") - F.col("a"))
    every = d.groupBy(*group).agg(F.count("*").alias("n_pairs"), F.count_if(F.col("d") != 0).alias("n"), F.avg("d").alias("mean_diff")).where(F.col("n_pairs") >= least)
    sizes = (d if zeros == "pratt" else d.where("d <> 0")).groupBy(*group, F.round(F.abs("d"), 9).alias("size")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))
    ranked = counted_before(sizes, "t", list(group), ["size"]).withColumn("r", F.col("before") + (F.col("t") + 1) / 2.0)
    t = F.when(F.col("size") > 0, F.col("t")).otherwise(F.lit(0)).cast("double")
    sums = ranked.groupBy(*group).agg(F.least(F.sum(F.col("up") * F.col("r")), F.sum(F.col("down") * F.col("r"))).alias("statistic"), F.sum(t * t * t - t).alias("ties"), F.sum(F.when(F.col("size") == 0, F.col("t")).otherwise(F.lit(0))).alias("zeros"))
    out = joined(every, sums, list(group), "left").fillna({"statistic": 0.0, "ties": 0.0, "zeros": 0})
    n = F.col("n").cast("double")
    z = F.try_divide(F.col("statistic") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24))
    out = out.withColumn("n_ties", F.col("n_pairs") - F.col("n")).withColumn("ties_pct", F.col("n_ties") / F.col("n_pairs")).withColumn("z", z).withColumn("effect_size_r", F.coalesce(F.try_divide(F.abs("z"), F.sqrt(n)), F.lit(0.0)))
    return out.withColumn("p", _w_column(F.col("statistic"), F.col("n"), F.col("ties"), F.col("zeros"))).drop("ties", "zeros")


def by_position(a: DataFrame, b: DataFrame, order: str, value: str) -> DataFrame:
    """Pairs (position long, a, b) of the values of two runs in order of `order`; an error if they differ in length."""
    n_a, n_b = a.count(), b.count()
    if n_a != n_b:
        raise ValueError(f"{n_a} and {n_b} values can't be paired by position")
    left, right = (counted_before(x.select(F.col(order).alias("o"), F.col(value).alias("v"), F.lit(1).alias("one")), "one", [], ["o"], "position").select("position", F.col("v").alias(name)) for x, name in ((a, "a"), (b, "b")))
    return left.join(right, "position")


def configuration_pairs(scores: DataFrame, config: list[str], key: str, value: str, baseline: dict[str, str] | None = None) -> DataFrame:
    """Pairs (a_<config>..., b_<config>..., key, a, b) of the values that two configurations gave to the same key.

    Of each two configurations once, the lesser first; with a baseline only those that have it as a. Null values make no
    pair. Joined by key, so that what is joined grows with the number of configurations squared, and of these there are
    few.
    """
    known = scores.where(F.col(value).isNotNull())
    a = known.select(key, F.struct(*config).alias("ca"), F.col(value).alias("a"))
    b = known.select(key, F.struct(*config).alias("cb"), F.col(value).alias("b"))
    if baseline is None:
        both = a.join(b, key).where(F.col("ca") < F.col("cb"))
    else:
        for name, wanted in baseline.items():
            a = a.where(F.col(f"ca.{name}") == wanted)
        both = a.join(b, key).where(F.col("ca") != F.col("cb"))
    return both.select(*[F.col(f"{s}.{c}").alias(f"{n}_{c}") for s, n in (("ca", "a"), ("cb", "b")) for c in config], key, "a", "b")


def wilcoxon_of_configurations(scores: DataFrame, config: list[str], key: str, value: str, baseline: dict[str, str] | None = None, least: int = 5, alpha: float = 0.05) -> DataFrame:
    """The signed-rank test of every two configurations (or of each against the baseline) over common keys, adjusted.

    Pairs of configurations with fewer than `least` common keys are left out. Columns: a_<config>..., b_<config>...,
    those of wilcoxon(), p_adjusted, significant.
    """
    pairs = configuration_pairs(scores, config, key, value, baseline)
    names = [f"{n}_{c}" for n in ("a", "b") for c in config]
    return benjamini_hochberg(wilcoxon(pairs, *names, least=least), "p", *names, alpha=alpha)


def benjamini_hochberg(tests: DataFrame, p: str, *order: str, alpha: float = 0.05) -> DataFrame:
    """tests (one row a comparison) with p_adjusted and significant; order makes the ranks of equal p definite. Null p is left null."""
    return adjusted_p(tests, p, *order).withColumn("significant", F.coalesce(F.col("p_adjusted") <= alpha, F.lit(False)))


def _correlated(ranked: DataFrame, *group: str) -> DataFrame:
    out = ranked.groupBy(*group).agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("rho"))
    t = F.try_divide(F.col("rho") * F.sqrt(F.col("n") - 2), F.sqrt(1 - F.col("rho") * F.col("rho")))
    return out.withColumn("p", _t_column(F.coalesce(t, F.lit(float("nan"))), (F.col("n") - 2).cast("double")))


def spearman(pairs: DataFrame, *group: str) -> DataFrame:
    """Correlation of average ranks of a and b within the group, with p: group, n, rho, p."""
    both = pairs.where("a IS NOT NULL AND b IS NOT NULL")
    return _correlated(with_average_rank(with_average_rank(both, "a", "ra", *group), "b", "rb", *group), *group)


def pooled_spearman(rows: DataFrame, *group: str) -> DataFrame:
    """Correlation of automatic with expert ranks over all groups together: n, rho, p.

    rows: group, score double, position int (the expert's, from 1). Scores are ranked within their group, the greatest
    first, ties sharing their mean; the ranks of all groups are then ranked and correlated with the positions.
    """
    ranked = with_average_rank(rows.where("score IS NOT NULL AND position IS NOT NULL"), "score", "auto", *group, descending=True)
    return spearman(ranked.select(F.lit(0).alias("g"), F.col("auto").alias("a"), F.col("position").cast("double").alias("b")), "g").drop("g")
