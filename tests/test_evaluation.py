"""Intervals by resampling against numpy, effect sizes of one hot group, the report, cube and filters."""

import hashlib
import math
from statistics import NormalDist

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docaudit.operators import evaluation as E
from docaudit.operators import resampling as S
from docaudit.operators import review
from docaudit.plans import evaluation_sql

NORMAL = NormalDist()


def rows_of(n=120, seed=4):
    rng = np.random.default_rng(seed)
    return [(f"r{i % 3}", i, int(rng.random() < 0.7), float(rng.random()), int(rng.integers(1, 900))) for i in range(n)] + [("lone", 10_000, 1, 0.4, 5)]


def drawn(key, b, seed=S.SEED):
    u = int(hashlib.md5(f"{seed}:{b}:{key}".encode()).hexdigest()[:13], 16) / 2**52
    return sum(c <= u for c in S.POISSON)


def by_numpy(num, den, keys, resamples, alpha=S.ALPHA):
    num, den = np.array(num, float), np.array(den, float)
    n, seen = len(num), num.sum() / den.sum()
    boot = []
    for b in range(resamples):
        w = np.array([drawn(k, b) for k in keys])
        if w.sum() and (w * den).sum():
            boot.append((w * num).sum() / (w * den).sum())
    boot = np.sort(boot)
    jack = (num.sum() - num) / (den.sum() - den) if n > 1 else np.array([seen])
    d = jack.mean() - jack
    a = (d**3).sum() / (6 * (d**2).sum() ** 1.5) if (d**2).sum() > 1e-24 else 0.0
    share = min(max((boot < seen - 1e-12).mean(), 0.5 / len(boot)), 1 - 0.5 / len(boot))
    z0 = NORMAL.inv_cdf(share)
    out = []
    for q in (alpha / 2, 1 - alpha / 2):
        z = z0 + NORMAL.inv_cdf(q)
        at = int(NORMAL.cdf(z0 + z / (1 - a * z)) * len(boot))
        out.append(boot[max(0, at - 1) : at + 2])  # the quantiles are approximate: a neighbour is as good
    return seen, z0, a, out


@pytest.mark.parametrize("name", ["mean", "ratio", "brier"])
def test_intervals_equal_numpy(spark, name):
    rows = rows_of()
    x = spark.createDataFrame(rows, "rule_id string, doc_id long, label int, confidence double, size int")
    num, den = {"mean": ("label", None), "ratio": ("size * label", "size"), "brier": ("pow(confidence - label, 2) - pow(0.5 - label, 2)", None)}[name]
    parts, statistic = S.ratio(F.expr(num), None if den is None else F.expr(den))
    got = {r.rule_id: r for r in S.bootstrap(x, "rule_id", "doc_id", parts, statistic, resamples=200).collect()}
    for rule in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == rule]
        tops = {"mean": [y for *_, y, _, _ in mine], "ratio": [s * y for _, _, y, _, s in mine], "brier": [(c - y) ** 2 - (0.5 - y) ** 2 for _, _, y, c, _ in mine]}[name]
        downs = [s for *_, s in mine] if name == "ratio" else [1] * len(mine)
        seen, z0, a, (low, high) = by_numpy(tops, downs, [r[1] for r in mine], 200)
        r = got[rule]
        assert r.n == len(mine) and abs(r.observed - seen) < 1e-9 and abs(r.acceleration - a) < 1e-6
        if len(mine) == 1:
            assert r.lower == r.upper == r.observed
        else:
            assert abs(r.z0 - z0) < 1e-6 and np.abs(low - r.lower).min() < 1e-9 and np.abs(high - r.upper).min() < 1e-9


def test_weights_are_poisson(spark):
    w = [r.w for r in spark.range(20_000).select(S.weight(F.col("id"), F.lit(3)).alias("w")).collect()]
    assert abs(np.mean(w) - 1) < 0.03 and abs(np.var(w) - 1) < 0.05 and max(w) >= 4


def test_weights_are_those_of_the_digest_at_the_cuts(spark):
    """As text from the least cut on; a digest at a cut is above it."""
    cuts = [math.ceil(c * 2**52) for c in S.POISSON if c < 1]
    at = [(f"{v:013x}{tail}", sum(c <= v / 2**52 for c in S.POISSON)) for c in cuts for v in (c - 1, c) for tail in ("0" * 19, "f" * 19)]
    got = spark.createDataFrame(at, "d string, w int").select("w", S.times(F.col("d")).alias("got")).collect()
    assert all(r.got == r.w for r in got) and {r.w for r in got} == set(range(len(cuts) + 1))


def test_a_row_is_hashed_once_for_a_resample(spark):
    """Not for each cut, and not again in a filter or in a sum."""
    x = spark.createDataFrame(rows_of(), "rule_id string, doc_id long, label int, confidence double, size int")
    parts, _ = S.ratio(F.expr("pow(confidence - label, 2) - pow(0.5 - label, 2)"))
    plan = S.resampled(x, "rule_id", "doc_id", parts, 50)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1 and "lambda" not in plan


def test_ratio_of_rows_without_a_label_equals_the_sql(spark):
    """A resample that draws none of a group's labelled rows has a sum of 0, as in the SQL: the rows that aren't drawn count for 0."""
    rows = [("a", 1, 1, 10), ("a", 2, None, 20), ("a", 3, None, 7), ("b", 4, 0, 5), ("b", 5, 1, 9), ("b", None, 1, 3), ("c", 6, None, 4), ("c", 7, None, 4)]
    x = spark.createDataFrame(rows, "rule_id string, doc_id long, label int, n_chars int")
    got = S.rounded(S.bootstrap(x, "rule_id", "doc_id", *S.ratio(F.expr("n_chars * label"), F.expr("n_chars")), resamples=200))
    values = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in rows)
    lab = f"WITH lab AS (SELECT * FROM (VALUES {values}) t(rule_id, doc_id, label, n_chars))"
    want = duckdb.sql(evaluation_sql.bootstrap(lab, "rule_id", "doc_id", "n_chars * label", "n_chars", resamples=200)).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_few_rows_are_dealt_out_before_they_are_resampled(spark):
    """Else the resamples of all rows that lie in one partition are one task's."""
    x = spark.createDataFrame(rows_of(), "rule_id string, doc_id long, label int, confidence double, size int").coalesce(1)
    found = S.resampled(x, "rule_id", "doc_id", S.ratio(F.col("label"))[0], 50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f"RoundRobinPartitioning({spark.conf.get('spark.sql.shuffle.partitions')})" in plan[plan.index("Generate explode") :] and found.count() == 3 * 50 + sum(drawn(10_000, b) > 0 for b in range(50))


def test_intervals_of_nothing(spark):
    x = spark.createDataFrame([], "rule_id string, doc_id long, label int")
    assert S.bootstrap(x, "rule_id", "doc_id", *S.ratio(F.col("label")), resamples=20).count() == 0


def test_normal_quantile(spark):
    p = [1e-9, 0.001, 0.02425, 0.3, 0.5, 0.7, 0.99, 1 - 1e-9]
    got = [r.q for r in spark.createDataFrame([(v,) for v in p], "p double").select(S.normal_quantile(F.col("p")).alias("q")).collect()]
    assert np.allclose(got, [NORMAL.inv_cdf(v) for v in p], atol=1e-6)


def test_cliff_where_one_group_holds_all_rows(spark):
    rng = np.random.default_rng(2)
    rows = [("hot", int(rng.integers(2)), int(rng.integers(300))) for _ in range(3000)] + [(None, 1, 2), (None, 0, 1), ("one side", 1, 5)]
    got = {r.g: r for r in E.cliffs_delta(spark.createDataFrame(rows, "g string, side int, x int"), "g").collect()}
    a, b = (np.array([x for g, s, x in rows if g == "hot" and s == side]) for side in (1, 0))
    assert abs(got["hot"].delta - np.sign(a[:, None] - b[None, :]).mean()) < 1e-6 and got[None].delta == 1 and got["one side"].delta == 0


def test_report(spark):
    rows = [("b", 1, 0.9, "v2"), ("b", 0, 0.2, "v1"), ("a", 1, 1.0, "v1")]
    x = spark.createDataFrame(rows, "rule_id string, label int, confidence double, rule_version string")
    lines = [r.line for r in E.report(x).orderBy("section", "key").collect()]
    assert lines[0] == "# Confidence Evaluation Report" and "**Ukupno obeleženih uzoraka:** 3" in lines and "**Ukupni Brier score:** 0.0167" in lines
    assert "| b | 1 | 1 | 2 | 50.0% | [0.095, 0.905] | 0.811 | 0.0250 | v1, v2 | Veoma mali uzorak - rezultati nepouzdani |" in lines
    assert lines[-1] == "| [0.9,1.0] | 2 | 0.950 | 1.000 | 0.050 | 0.0033 |"


def test_cube_choices_and_filters(spark):
    rows = [(1, "OBAVEZNO", "Razmaci", "x" * 50, 0.9, "OPEN", True), (1, "OBAVEZNO", "Zagrade", "s", 0.8, "DONE", False), (2, "PROVERITI", "Zagrade", "s", 0.7, "OPEN", False)]
    x = spark.createDataFrame(rows, "doc_id long, priority string, category string, section string, confidence double, status string, auto_fixable boolean")
    sums = {(r.level, r.priority, r.category, r.section): (r.findings, r.open) for r in review.cube(x).collect()}
    assert sums[7, None, None, None] == (3, 2) and sums[5, None, "Zagrade", None] == (2, 1) and sums[0, "PROVERITI", "Zagrade", "s"] == (1, 1) and len(sums) == 3 + 2 + 2 + 2 + 3 + 2 + 3 + 1
    shown = [(r.doc_id, r.field, r.nth, r.shown) for r in review.choices(x).orderBy("doc_id", "field", "nth").collect()]
    assert shown == [(1, "category", 1, "Razmaci"), (1, "category", 2, "Zagrade"), (1, "section", 1, "s"), (1, "section", 2, "x" * 40 + "..."), (2, "category", 1, "Zagrade"), (2, "section", 1, "s")]
    assert review.filtered(x, category="Zagrade", status="done").count() == 1 and review.filtered(x, auto_only=True).count() == 1 and review.filtered(x).count() == 3


def test_rounding_takes_the_double_and_keeps_the_sign_of_zero(spark):
    """As DuckDB's round and the report's fixed digits have it; 0.52065 lies below the middle."""
    values = [0.52065, -0.52065, -0.0, 0.0, -0.00004, 0.00005, 2.5, None, float("nan"), 1e300]
    x = spark.createDataFrame([(v,) for v in values], "v double")
    assert [repr(r.v) for r in x.select(E.nearest(F.col("v"), 4).alias("v")).collect()] == ["0.5206", "-0.5206", "-0.0", "0.0", "-0.0", "0.0001", "2.5", "None", "nan", "1e+300"]
    assert [repr(r.v) for r in S.rounded(x.limit(4), 4).collect()] == ["0.5206", "-0.5206", "-0.0", "0.0"]
