"""SQL for tail integrals, on plain grids: what the p-values of the queries are checked against."""

from __future__ import annotations

from ..functions.normal import FAR, LOWER, UPPER


def _horner(x: str, coefficients: tuple[float, ...]) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def normal_cdf(x: str) -> str:
    a = f"abs({x})"
    tail = f"CASE WHEN {a} < {FAR!r} THEN exp(-{a} * {a} / 2) * {_horner(a, UPPER)} / {_horner(a, LOWER)} ELSE 0.0::DOUBLE END"
    return f"CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END"


def dunnett_p(source: str = "tested", out: str = "ps") -> str:
    """CTE ``out`` (family, flavor, p) from ``source`` (family, flavor, n, n0, df, t): sums over an even grid."""
    return f"""{out}_sizes AS (SELECT family, n, count(*) AS c FROM {source} WHERE t IS NOT NULL GROUP BY ALL),
{out}_grid AS (SELECT s.i * 0.02::DOUBLE AS s, z.i * 0.2::DOUBLE AS z FROM range(1, 150) s(i), range(-42, 43) z(i)),
{out}_bounds AS (
  SELECT a.family, a.flavor, g.s, g.z, k.c, (a.df - 1) * ln(g.s) - a.df * (g.s * g.s - 1) / 2 - g.z * g.z / 2 AS w,
         (abs(a.t) * g.s + sqrt(k.n / (k.n + a.n0)) * g.z) / sqrt(1 - k.n / (k.n + a.n0)) AS hi,
         (-abs(a.t) * g.s + sqrt(k.n / (k.n + a.n0)) * g.z) / sqrt(1 - k.n / (k.n + a.n0)) AS lo
  FROM {source} a JOIN {out}_sizes k USING (family), {out}_grid g WHERE a.t IS NOT NULL),
{out}_points AS (
  SELECT family, flavor, s, z, exp(any_value(w)) AS w, sum(c * ln(greatest({normal_cdf('hi')} - {normal_cdf('lo')}, 1e-300))) AS l
  FROM {out}_bounds GROUP BY family, flavor, s, z),
{out} AS (SELECT family, flavor, greatest(least(1 - sum(w * exp(l)) / sum(w), 1), 0) AS p FROM {out}_points GROUP BY family, flavor)"""


def student_p(source: str, keys: str, out: str = "ps") -> str:
    """CTE ``out`` (keys, p) from ``source`` (keys, t, df): Simpson's rule over the angle."""
    step = "(pi() / 2 - start) / 2000"
    return f"""{out}_angles AS (SELECT {keys}, df, unnest([atan(abs(t) / sqrt(df)), 0.0::DOUBLE]) AS start, unnest([1, 0]) AS tail FROM {source} WHERE t IS NOT NULL),
{out}_sums AS (
  SELECT {keys}, tail, any_value({step}) * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
         * pow(greatest(cos(start + i * {step}), 1e-300), df - 1)) AS s
  FROM {out}_angles, range(0, 2001) g(i) GROUP BY {keys}, tail),
{out} AS (SELECT {keys}, least(1, max(s) FILTER (WHERE tail = 1) / max(s) FILTER (WHERE tail = 0)) AS p FROM {out}_sums GROUP BY {keys})"""


def p_text(p: str) -> str:
    return f"CASE WHEN {p} IS NULL THEN '' WHEN {p} < 0.001 THEN 'p<.001' WHEN {p} > 0.999 THEN 'p>.999' ELSE 'p=' || printf('%.3f', {p}) END"
