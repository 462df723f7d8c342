"""Quality of rules from human labels: labels have rule_id, label (0/1), confidence, rule_version."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.sources.shared import persisted

Z = 1.96
# The normal quantile by confidence level, and a polynomial approximation of erf.
QUANTILES = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column, Column]:
    """(lower, upper, centre) of the Wilson interval, zeros without trials."""
    p = k / F.greatest(n, F.lit(1))
    d = 1 + z * z / F.greatest(n, F.lit(1))
    centre = (p + z * z / (2 * F.greatest(n, F.lit(1)))) / d
    half = z * F.sqrt(p * (1 - p) / F.greatest(n, F.lit(1)) + z * z / (4 * F.greatest(n, F.lit(1)) * F.greatest(n, F.lit(1)))) / d
    some = lambda c: F.when(n > 0, c).otherwise(0.0)
    return some(F.greatest(F.lit(0.0), centre - half)), some(F.least(F.lit(1.0), centre + half)), some(centre)


def normal_cdf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x) / math.sqrt(2))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    erf = 1 - poly * F.exp(-x * x / 2)
    return F.when(x >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def invalid(labels: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """(line, field, value) of every bad field: missing, a label not 0 or 1, a confidence outside [0, 1]."""
    bad = [F.struct(F.lit(c).alias("field"), F.col(c).alias("value"), (F.coalesce(F.trim(F.col(c)), F.lit("")) == "").alias("bad")) for c in required]
    bad.append(F.struct(F.lit("label").alias("field"), F.col("label").alias("value"), (~F.coalesce(F.trim("label"), F.lit("")).isin("", "0", "1")).alias("bad")))
    number = F.col("predicted_confidence").try_cast("double")
    outside = F.coalesce(~number.between(0, 1) | F.isnan(number), F.lit(True)) & (F.coalesce(F.trim("predicted_confidence"), F.lit("")) != "")
    bad.append(F.struct(F.lit("predicted_confidence").alias("field"), F.col("predicted_confidence").alias("value"), outside.alias("bad")))
    return labels.select("line", F.explode(F.array(*bad)).alias("x")).where("x.bad").select("line", "x.field", "x.value")


def per_rule(labels: DataFrame, group: str = "rule_id") -> DataFrame:
    y, p = F.col("label"), F.col("confidence")
    x = labels.groupBy(group).agg(
        F.count_if(y == 1).alias("tp"), F.count_if(y == 0).alias("fp"), F.count("*").alias("n"), F.avg(y.cast("double")).alias("precision"), F.avg(F.pow(p - y, F.lit(2.0))).alias("brier"),
    )
    lower, upper, centre = wilson(F.col("tp"), F.col("n"))
    warning = F.when(F.col("n") < 10, "very small sample").when(F.col("n") < 30, "small sample").otherwise("")
    return x.select(group, "tp", "fp", "n", F.round("precision", 6).alias("precision"), F.round(lower, 6).alias("lower"), F.round(upper, 6).alias("upper"), F.round(centre, 6).alias("centre"), F.round("brier", 6).alias("brier"), warning.alias("warning"))


def reliability(labels: DataFrame, bins: int = 10) -> DataFrame:
    """Equal bins of confidence, the last one closed; contributions are shares of all labels."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("confidence") * bins)).cast("long")
    x = labels.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("p"), F.avg(F.col("label").cast("double")).alias("o"))
    total = F.sum("n").over(Window.partitionBy())
    return x.select("bin", "n", F.round("p", 6).alias("predicted"), F.round("o", 6).alias("observed"), F.round(F.abs(F.col("p") - F.col("o")), 6).alias("difference"), F.round(F.abs(F.col("p") - F.col("o")) * F.col("n") / total, 6).alias("contribution"))


# The report's notes, warnings and table heads.
REPORT_NOTES = (
    "Ova evaluacija meri preciznost prijavljenih nalaza. Ne meri recall, F1 niti greške koje alat nije pronašao.",
    "Nalazi iz istog dokumenta nisu statistički nezavisni. Wilson intervali po pojedinačnim nalazima mogu potceniti stvarnu neizvesnost.",
    "Buduća evaluacija može koristiti bootstrap na nivou celog dokumenta.",
)
FEW, SOME = "Veoma mali uzorak - rezultati nepouzdani", "Mali uzorak - širok interval poverenja"
RULE_HEAD = (
    "| Rule ID | TP | FP | N | Precision | Wilson CI | Width | Brier | Versions | Warning |",
    "|---------|----|----|---|-----------|-----------|-------|-------|----------|---------|",
)
BIN_HEAD = (
    "| Bin | N | Mean predicted | Observed correct | Calibration diff | Brier contribution |",
    "|-----|---|----------------|-----------------|-----------------|-------------------|",
)


def rule_report(labels: DataFrame, group: str = "rule_id", version: str = "rule_version") -> DataFrame:
    """per_rule's figures, unrounded, with the interval's width and the rule's versions."""
    y, p = F.col("label"), F.col("confidence")
    x = labels.groupBy(group).agg(
        F.count_if(y == 1).alias("tp"), F.count_if(y == 0).alias("fp"), F.count("*").alias("n"), F.avg(y.cast("double")).alias("precision"),
        F.avg(F.pow(p - y, F.lit(2.0))).alias("brier"), F.array_join(F.array_sort(F.collect_set(version)), ", ").alias("versions"))
    lower, upper, _ = wilson(F.col("tp"), F.col("n"))
    warning = F.when(F.col("n") < 10, FEW).when(F.col("n") < 30, SOME).otherwise("-")
    return x.select("*", lower.alias("lower"), upper.alias("upper"), (upper - lower).alias("width"), warning.alias("warning"))


def bin_report(labels: DataFrame, bins: int = 10) -> DataFrame:
    """Bins of confidence with observed minus predicted, and each bin's share of the overall Brier score."""
    y, p = F.col("label"), F.col("confidence")
    b = F.least(F.lit(bins - 1), F.floor(p * bins)).cast("long")
    x = labels.groupBy(b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg((y == 1).cast("double")).alias("observed"), F.sum(F.pow(p - y, F.lit(2.0))).alias("squares"))
    total = F.sum("n").over(Window.partitionBy())  # over the bins
    return x.select("bin", "n", "predicted", "observed", (F.col("observed") - F.col("predicted")).alias("difference"), (F.col("squares") / total).alias("contribution"))


def overall(labels: DataFrame) -> DataFrame:
    """samples and overall Brier score: one row."""
    return labels.agg(F.count("*").alias("samples"), F.avg(F.pow(F.col("confidence") - F.col("label"), F.lit(2.0))).alias("brier"))


def nearest(x: Column, digits: int) -> Column:
    """x times 10 ** digits, as the double it is, to the nearest whole number (halves away from 0) and back; a 0 that comes
    of a negative number or of -0.0 keeps its sign. F.round takes the shortest decimal that stands for x, and drops that sign."""
    scale = float(10**digits)
    size = F.round(F.abs(x) * scale) / scale
    return F.when(x.cast("string").startswith("-"), -size).otherwise(size)


def report(labels: DataFrame, group: str = "rule_id", version: str = "rule_version") -> DataFrame:
    """The report in Markdown, as lines (section, key, line) in the order of section and key."""
    spark = labels.sparkSession
    fixed = [(0, "", "# Confidence Evaluation Report")] + [(1, str(k), f"> {note}") for k, note in enumerate(REPORT_NOTES)]
    fixed += [(3, "0", "## Per-rule results")] + [(3, str(k + 1), h) for k, h in enumerate(RULE_HEAD)]
    fixed += [(5, "0", "## Reliability diagram")] + [(5, str(k + 1), h) for k, h in enumerate(BIN_HEAD)]
    o = overall(labels).select(F.lit(2).alias("section"), F.explode(F.array(
        F.struct(F.lit("0").alias("key"), F.format_string("**Ukupno obeleženih uzoraka:** %d", "samples").alias("line")),
        F.struct(F.lit("1").alias("key"), F.format_string("**Ukupni Brier score:** %.4f", nearest(F.col("brier"), 4)).alias("line")))).alias("x")).select("section", "x.*")
    r = rule_report(labels, group, version).select(F.lit(4).alias("section"), F.col(group).cast("string").alias("key"), F.format_string(
        "| %s | %d | %d | %d | %.1f%% | [%.3f, %.3f] | %.3f | %.4f | %s | %s |", group, "tp", "fp", "n",
        nearest(F.col("precision") * 100, 1), *[nearest(F.col(c), 3) for c in ("lower", "upper", "width")], nearest(F.col("brier"), 4), "versions", "warning").alias("line"))
    end = F.when(F.col("bin") == 9, "1.0]").otherwise(F.format_string("0.%d)", F.col("bin") + 1))
    b = bin_report(labels).select(F.lit(6).alias("section"), F.format_string("%02d", "bin").alias("key"), F.format_string(
        "| [0.%d,%s | %d | %.3f | %.3f | %.3f | %.4f |", "bin", end, "n",
        *[nearest(F.col(c), 3) for c in ("predicted", "observed", "difference")], nearest(F.col("contribution"), 4)).alias("line"))
    return spark.createDataFrame(fixed, "section int, key string, line string").unionByName(o).unionByName(r).unionByName(b)


def mcnemar(pairs: DataFrame, group: str) -> DataFrame:
    """pairs: before and after (0/1). Continuity-corrected; no discordant pair gives p = 1."""
    x = pairs.groupBy(group).agg(F.count_if((F.col("before") == 1) & (F.col("after") == 0)).alias("b"), F.count_if((F.col("before") == 0) & (F.col("after") == 1)).alias("c"))
    n = F.col("b") + F.col("c")
    chi = F.when(n == 0, 0.0).otherwise(F.pow(F.abs(F.col("b") - F.col("c")) - 1.0, F.lit(2.0)) / F.greatest(n, F.lit(1)))
    p = F.when(n == 0, 1.0).otherwise(2 * (1 - normal_cdf(F.sqrt(chi))))
    return x.select(group, "b", "c", F.round(chi, 6).alias("chi2"), F.round(p, 6).alias("p"))


def benjamini_hochberg(tests: DataFrame, key: str, alpha: float = 0.05) -> DataFrame:
    """Step-up over p; the tests are few (one a rule), so one window holds them."""
    every = Window.partitionBy()
    x = tests.withColumn("rank", F.row_number().over(every.orderBy("p", key)).cast("long")).withColumn("m", F.count("*").over(every))
    x = x.withColumn("critical", F.col("rank") / F.col("m") * alpha)
    last = F.max(F.when(F.col("p") <= F.col("critical"), F.col("rank"))).over(every)
    return x.select(key, "p", "rank", F.round("critical", 6).alias("critical"), F.coalesce(F.col("rank") <= last, F.lit(False)).alias("significant"))


def cliffs_delta(values: DataFrame, group: str) -> DataFrame:
    """values: group, side (1 or 0), x. Pairs are counted from sums by distinct value, never formed: distinct values are dealt
    by ranges, each range knows what lies in the ranges before it, and running sums stay within a range, so one
    group may hold all rows."""
    spark = values.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = values.groupBy(group, "x").agg(F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == 0).alias("n0"))
    v = persisted(v.repartitionByRange(parts, group, "x").withColumn("_range", F.spark_partition_id()), "values")
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = v.groupBy(group, "_range").agg(F.sum("n1").alias("s1"), F.sum("n0").alias("s0"))  # a row for each group and range at most
    ranges = ranges.select(group, "_range", *[F.coalesce(F.sum(f"s{k}").over(before), F.lit(0)).alias(f"low{k}") for k in (0, 1)])
    below = Window.partitionBy(group, "_range").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    v = v.select("*", *[F.coalesce(F.sum(f"n{k}").over(below), F.lit(0)).alias(f"in{k}") for k in (0, 1)]).withColumnRenamed(group, "_g").withColumnRenamed("_range", "_r")
    v = v.join(ranges, F.col("_g").eqNullSafe(F.col(group)) & (F.col("_r") == F.col("_range")))
    less = {k: F.col(f"low{k}") + F.col(f"in{k}") for k in (0, 1)}
    s = v.groupBy(group).agg(F.sum(F.col("n1") * less[0] - F.col("n0") * less[1]).alias("d"), F.sum("n1").alias("a"), F.sum("n0").alias("b"))
    delta = F.when(F.col("a") * F.col("b") > 0, F.col("d") / (F.col("a") * F.col("b"))).otherwise(0.0)
    size = F.abs(delta)
    word = F.when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large")
    return s.select(group, F.col("a").alias("n1"), F.col("b").alias("n0"), F.round(delta, 6).alias("delta"), word.alias("effect"))


def sample_size(params: DataFrame) -> DataFrame:
    """params: p, e, level, design, per_doc -> findings by Cochran, with design effect, and documents."""
    z = F.element_at(F.create_map(*[F.lit(float(y)) for kv in QUANTILES.items() for y in kv]), F.col("level"))
    n = F.ceil(z * z * F.col("p") * (1 - F.col("p")) / (F.col("e") * F.col("e")))
    total = F.ceil(n * F.col("design"))
    return params.select("p", "e", "level", "design", "per_doc", n.alias("n"), total.alias("findings"), F.ceil(total / F.col("per_doc")).alias("documents"))


def bootstrap_bca(labels: DataFrame, group: str = "rule_id", resamples: int = 10000, alpha: float = 0.05, seed: int = 7) -> DataFrame:
    """BCa interval of each group's mean label. Labels are 0/1, so a group is its two counts: resamples
    are binomial draws and the jackknife has two values; nothing grows with the group."""
    import pandas as pd

    sums = labels.groupBy(group).agg(F.count_if(F.col("label") == 1).alias("k"), F.count("*").alias("n"))

    def run(batches):
        import numpy as np
        from statistics import NormalDist

        normal = NormalDist()
        for pdf in batches:
            out = []
            for name, k, n in pdf.itertuples(index=False):
                mean = k / n
                draws = np.sort(np.random.default_rng([seed, k, n]).binomial(n, mean, resamples) / n)
                share = ((draws < mean).sum() + 0.5 * (draws == mean).sum()) / resamples
                z0 = normal.inv_cdf(min(max(share, 1 / resamples), 1 - 1 / resamples))
                # leaving out a 1 or a 0: two values, as often as there are of each
                often = np.array([k, n - k])
                jack = np.array([k - 1, k]) / max(1, n - 1)
                d = (often * jack).sum() / n - jack
                square = (often * d**2).sum()
                a = (often * d**3).sum() / (6 * square**1.5) if n > 1 and square > 0 else 0.0

                def bound(q: float) -> float:
                    z = z0 + normal.inv_cdf(q)
                    at = normal.cdf(z0 + z / max(1e-12, 1 - a * z))
                    return float(draws[min(resamples - 1, max(0, int(at * resamples)))])

                out.append((name, int(n), round(mean, 6), round(bound(alpha / 2), 6), round(bound(1 - alpha / 2), 6)))
            yield pd.DataFrame(out, columns=[group, "n", "mean", "lower", "upper"])

    return sums.mapInPandas(run, f"{group} string, n long, mean double, lower double, upper double")
