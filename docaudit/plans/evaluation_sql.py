"""SQL of the evaluation's intervals and report."""

from __future__ import annotations

from docaudit.operators import resampling as S


def _polynomial(x: str, coefficients: tuple[float, ...]) -> str:
    out = repr(coefficients[0]) + "::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def quantile(p: str) -> str:
    tail = lambda x: f"({_polynomial(x, S.TAIL_C)} / {_polynomial(x, S.TAIL_D)})"
    low, high, q = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5)"
    centre = f"({_polynomial(f'({q} * {q})', S.CENTRE_A)} * {q} / {_polynomial(f'({q} * {q})', S.CENTRE_B)})"
    return f"CASE WHEN {p} < {S.TAIL} THEN {tail(low)} WHEN {p} > {1 - S.TAIL} THEN -{tail(high)} ELSE {centre} END"


def cdf(x: str) -> str:
    u = f"(1 / (1 + 0.3275911 * abs({x}) / sqrt(2.0)))"
    erf = f"(1 - (((((1.061405429 * {u} - 1.453152027) * {u} + 1.421413741) * {u} - 0.284496736) * {u} + 0.254829592) * {u}) * exp(-({x}) * ({x}) / 2))"
    return f"CASE WHEN {x} >= 0 THEN 0.5 * (1 + {erf}) ELSE 0.5 * (1 - {erf}) END"


def bootstrap(rows: str, group: str, key: str, numerator: str, denominator: str = "1.0", resamples: int = S.RESAMPLES) -> str:
    """rows: leading WITH of a table lab. The steps are those of resampling.bootstrap."""
    cuts = " + ".join(f"CAST({c!r}::DOUBLE <= u AS INT)" for c in S.POISSON)
    bound = lambda q: f"coalesce(s[1 + greatest(0, least(len(s) - 1, CAST(floor(({cdf('z' + q)}) * len(s)) AS INT)))], observed)"
    z = lambda p: f"z0 + (z0 + ({quantile(f'{p!r}::DOUBLE')})) / (1 - a * (z0 + ({quantile(f'{p!r}::DOUBLE')})))"
    return rows + f""", x AS (SELECT {group} AS g, {key} AS k, CAST({numerator} AS DOUBLE) AS num, CAST({denominator} AS DOUBLE) AS den FROM lab),
 w AS (SELECT g, count(*) AS n, sum(num) AS num, sum(den) AS den, CASE WHEN sum(den) <> 0 THEN sum(num) / sum(den) END AS observed FROM x GROUP BY 1),
 d AS (SELECT x.g, CASE WHEN w.den - x.den <> 0 THEN (w.num - x.num) / (w.den - x.den) END - observed AS d FROM x JOIN w ON x.g IS NOT DISTINCT FROM w.g),
 j0 AS (SELECT g, count(d) AS m, sum(d) AS d1, sum(d * d) AS d2, sum(d * d * d) AS d3 FROM d GROUP BY 1),
 j1 AS (SELECT g, d2 - d1 * d1 / greatest(m, 1) AS sq, -(d3 - 3 * d1 / greatest(m, 1) * d2 + 2 * m * pow(d1 / greatest(m, 1), 3)) AS cu FROM j0),
 j AS (SELECT g, CASE WHEN sq > 1e-24 THEN cu / (6 * pow(sq, 1.5)) ELSE 0.0 END AS a FROM j1),
 u AS (SELECT g, num, den, b, CAST(('0x' || substr(md5('{S.SEED}:' || b || ':' || k), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM x, range({resamples}) r(b)),
 p AS (SELECT g, b, sum(num * ({cuts})) AS num, sum(den * ({cuts})) AS den, sum({cuts}) AS drawn FROM u GROUP BY 1, 2),
 t AS (SELECT p.g, CASE WHEN p.den <> 0 THEN p.num / p.den END AS s, observed FROM p JOIN w ON p.g = w.g WHERE drawn > 0),
 b AS (SELECT g, list_sort(list(s)) AS s, count(*) FILTER (WHERE s < observed - 1e-12) AS below FROM t WHERE s IS NOT NULL GROUP BY 1),
 q AS (SELECT w.g, w.n, observed, a, s, least(greatest(below / len(s), 0.5 / len(s)), 1 - 0.5 / len(s)) AS share FROM w JOIN j ON w.g = j.g LEFT JOIN b ON w.g = b.g),
 z AS (SELECT *, {quantile('share')} AS z0 FROM q), zz AS (SELECT *, {z(S.ALPHA / 2)} AS zl, {z(1 - S.ALPHA / 2)} AS zu FROM z)
 SELECT g AS {group}, n, round(observed, 6) AS observed, round(z0, 6) AS z0, round(a, 6) AS acceleration,
 round(CASE WHEN n > 1 THEN {bound('l')} ELSE observed END, 6) AS lower, round(CASE WHEN n > 1 THEN {bound('u')} ELSE observed END, 6) AS upper FROM zz"""
