"""Bootstrap intervals (BCa) of any statistic of sums, by group, from one aggregation.

Each row gets a weight for each resample, drawn from the Poisson distribution of mean 1 by a hash of the row's key and the
resample's number. Drawing n rows of n with replacement weights rows this way but for the total, so resamples need
no row of another task: sums by group and resample are taken before the shuffle. The jackknife leaves each row out
of its group's sums. What is gathered in one place is a group's resampled statistics, of a number that is a parameter.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.operators.evaluation import nearest, normal_cdf

# Acklam's approximation of the normal quantile, and where its tails begin.
CENTRE_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
CENTRE_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
TAIL_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
TAIL = 0.02425
#: P(X <= k) of the Poisson distribution of mean 1, as far as a hash of 52 bits tells them apart.
POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(17))
RESAMPLES, ALPHA, SEED = 1000, 0.05, 7


def polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """Of a probability above 0 and below 1."""
    low, high = F.sqrt(-2 * F.ln(p)), F.sqrt(-2 * F.ln(1 - p))
    q = p - 0.5
    tail = lambda x: polynomial(x, TAIL_C) / polynomial(x, TAIL_D)
    return F.when(p < TAIL, tail(low)).when(p > 1 - TAIL, -tail(high)).otherwise(polynomial(q * q, CENTRE_A) * q / polynomial(q * q, CENTRE_B))


def digest(key: Column, resample: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), resample.cast("string"), F.lit(":"), key.cast("string")).cast("binary"))


def times(drawn: Column) -> Column:
    """The weight that a digest stands for. Its first 13 digits over 2 ** 52 are compared with POISSON as text, the least first, so
    that few comparisons are made; the digits that follow don't change what is at or above a cut of 13. 0 for null."""
    cuts = sorted(f"{math.ceil(c * 2**52):013x}" for c in POISSON if c < 1)
    out = F.lit(len(cuts))
    for k in reversed(range(len(cuts))):
        out = F.when(drawn >= cuts[k], out).otherwise(F.lit(k))
    return out


def weight(key: Column, resample: Column, seed: int = SEED) -> Column:
    """How often a resample has the row with this key: 0, 1, 2..., of mean 1."""
    return times(digest(key, resample, seed))


def resampled(rows: DataFrame, group: str, key: str, parts: dict[str, Column], resamples: int, seed: int = SEED) -> DataFrame:
    """group, b and the weighted sum of each part, for each resample that has a row of the group. Rows are few where their
    resamples are many, so they are dealt out anew first. Digest and weight are columns of their own, and what isn't drawn
    is left out only after the sums: a filter on the weight, or a sum over its expression, would take the digest again."""
    x = rows.select(F.col(group), F.col(key).cast("string").alias("_key"), *[c.cast("double").alias(k) for k, c in parts.items()])
    x = x.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b")).withColumn("_digest", digest(F.col("_key"), F.col("b"), seed))
    x = x.withColumn("_w", times(F.col("_digest"))).groupBy(group, "b").agg(*[F.sum(F.col("_w") * F.col(k)).alias(k) for k in parts], F.sum("_w").alias("_drawn"))
    return x.where("_drawn > 0").drop("_drawn")


def bootstrap(
    rows: DataFrame, group: str, key: str, parts: dict[str, Column], statistic: Callable[[dict[str, Column]], Column],
    resamples: int = RESAMPLES, alpha: float = ALPHA, seed: int = SEED,
) -> DataFrame:
    """group, n, observed, z0, acceleration, lower, upper. parts: columns whose sums the statistic is a function of, such as
    numerator and denominator. key tells rows apart: rows with one key always have the same weight. A resample without
    any row of a group, or one that the statistic is null of, doesn't count. A group of one row has its statistic as both
    bounds. The share of resamples below the observed statistic is held within half a resample of 0 and 1."""
    of = lambda x: statistic({k: F.col(f"{x}{k}") for k in parts})
    x = rows.select(F.col(group), F.col(key), *[c.cast("double").alias(k) for k, c in parts.items()])
    whole = x.groupBy(group).agg(F.count("*").alias("n"), *[F.sum(k).alias(f"all_{k}") for k in parts]).withColumn("observed", of("all_"))
    # leaving a row out: moments of what is left around the observed statistic
    each = x.join(whole, group).select(group, *[(F.col(f"all_{k}") - F.col(k)).alias(f"less_{k}") for k in parts], "observed")
    d = of("less_") - F.col("observed")
    jack = each.groupBy(group).agg(*[F.sum(F.pow(d, F.lit(float(k)))).alias(f"d{k}") for k in (1, 2, 3)], F.count(d).alias("m"))
    mean = F.col("d1") / F.greatest("m", F.lit(1))
    square = F.col("d2") - F.col("m") * mean * mean
    cube = -(F.col("d3") - 3 * mean * F.col("d2") + 2 * F.col("m") * F.pow(mean, F.lit(3.0)))
    jack = jack.select(group, F.when(square > 1e-24, cube / (6 * F.pow(square, F.lit(1.5)))).otherwise(0.0).alias("acceleration"))
    boot = resampled(rows, group, key, parts, resamples, seed).select(group, of("").alias("s")).where("s is not null")
    boot = boot.join(whole.select(group, "observed"), group).groupBy(group).agg(
        F.sort_array(F.collect_list("s")).alias("s"), F.count_if(F.col("s") < F.col("observed") - 1e-12).alias("below"))  # resamples of them at most
    out = whole.select(group, "n", "observed").join(jack, group).join(boot, group, "left")
    drawn = F.size("s")
    share = F.least(F.greatest(F.col("below") / drawn, 0.5 / drawn), 1 - 0.5 / drawn)
    out = out.withColumn("z0", normal_quantile(share))

    def bound(q: float) -> Column:
        z = F.col("z0") + normal_quantile(F.lit(q))
        at = normal_cdf(F.col("z0") + z / (1 - F.col("acceleration") * z))
        nth = F.greatest(F.lit(0), F.least(drawn - 1, F.floor(at * drawn).cast("int")))
        return F.when((F.col("n") > 1) & (drawn > 0), F.get("s", nth)).otherwise(F.col("observed"))

    return out.select(group, "n", "observed", "z0", "acceleration", bound(alpha / 2).alias("lower"), bound(1 - alpha / 2).alias("upper"))


def ratio(numerator: Column, denominator: Column | None = None) -> tuple[dict[str, Column], Callable]:
    """parts and statistic of a ratio of sums; of a mean, without a denominator."""
    parts = {"num": numerator, "den": F.lit(1.0) if denominator is None else denominator}
    return parts, lambda s: F.when(s["den"] != 0, s["num"] / s["den"])


def rounded(found: DataFrame, digits: int = 6) -> DataFrame:
    return found.select(*[nearest(F.col(c), digits).alias(c) if kind == "double" else F.col(c) for c, kind in found.dtypes])
