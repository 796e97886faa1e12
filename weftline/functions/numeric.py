"""Scalar functions as Column expressions, or as SQL text that several engines accept."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Wichura's algorithm AS241 (PPND16) for the normal quantile.
CENTRAL_NUM = (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608)
CENTRAL_DEN = (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0)
TAIL_NUM = (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734)
TAIL_DEN = (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0)


def _number(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _horner(coefficients: tuple[float, ...], r: str) -> str:
    out = _number(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {r} + {_number(c)})"
    return out


def probit_sql(p: str) -> str:
    """The standard normal quantile of ``p`` (0 < p < 1, tails down to about 1e-11) as SQL text."""
    q = f"({p} - {_number(0.5)})"
    r = f"({_number(0.180625)} - {q} * {q})"
    t = f"(sqrt(-ln(least({p}, {_number(1.0)} - {p}))) - {_number(1.6)})"
    tail = f"({_horner(TAIL_NUM, t)} / {_horner(TAIL_DEN, t)})"
    return f"(CASE WHEN abs({q}) <= {_number(0.425)} THEN {q} * {_horner(CENTRAL_NUM, r)} / {_horner(CENTRAL_DEN, r)} WHEN {q} < 0 THEN -{tail} ELSE {tail} END)"


def digamma_sql(x: str) -> str:
    """The digamma function of a positive number as SQL text: ten steps of the recurrence, then the series."""
    steps = " + ".join(f"1 / ({x} + {k})" for k in range(10))
    y = f"({x} + 10)"
    # The terms of the series are B(2k) / 2k.
    series = " - ".join(f"{_number(b)} / power({y}, {2 * k})" for k, b in enumerate((1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132, -691 / 32760), 1))
    return f"(ln({y}) - {_number(0.5)} / {y} - {series} - ({steps}))"


def digamma(x: float) -> float:
    """The digamma function of a positive number (recurrence, then asymptotic series)."""
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def spin(c: Column) -> Column:
    """1 for a positive count, else -1."""
    return F.when(c > 0, 1).otherwise(-1)


def sigmoid(x: Column, limit: float = 40.0) -> Column:
    x = F.least(F.greatest(x, F.lit(-limit)), F.lit(limit))
    return 1 / (1 + F.exp(-x))


def log_add_exp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def log_deformed_exp(x: Column, gamma: Column, floor: float = 1e-6) -> Column:
    """``ln (1 + gamma x)+^(1/gamma)``, x itself at gamma 0; the base is at least ``floor``."""
    return F.when(F.abs(gamma) < 1e-12, x).otherwise(F.log(F.greatest(1 + gamma * x, F.lit(floor))) / F.when(F.abs(gamma) < 1e-12, F.lit(None)).otherwise(gamma))


def deformed_exp(x: Column, gamma: Column, floor: float = 1e-6) -> Column:
    return F.exp(log_deformed_exp(x, gamma, floor))


def deformed_sigmoid(x: Column, gamma: Column, floor: float = 1e-6) -> Column:
    """``e(x) / (e(x) + e(-x))`` with the deformed exponential e, evaluated by the difference of logs; at gamma 0 the plain sigmoid of x."""
    gap = log_deformed_exp(x, gamma, floor) - log_deformed_exp(-x, gamma, floor)
    return F.when(F.abs(gamma) < 1e-12, sigmoid(x)).otherwise(sigmoid(gap, 700.0))


def deformed_sigmoid_slope(x: Column, gamma: Column, floor: float = 1e-6) -> Column:
    a, b = log_deformed_exp(x, gamma, floor), log_deformed_exp(-x, gamma, floor)
    s = sigmoid(a - b, 700.0)
    flat = sigmoid(x)
    return F.when(F.abs(gamma) < 1e-12, flat * (1 - flat)).otherwise(2 * s * (1 - s) / F.greatest(1 - gamma * gamma * x * x, F.lit(floor)))


def coherence_sign(*values: Column) -> Column:
    """1 if all values have one sign and none is zero, else -1."""
    total = sum((F.signum(v) for v in values[1:]), F.signum(values[0]))
    return F.when(F.abs(total) == len(values), 1).otherwise(-1)


def n_choose_r(n: Column, r: int) -> Column:
    out = F.lit(1.0)
    for i in range(r):
        out = out * (n - i) / (i + 1)
    return F.round(out).cast("long")


def combination_rank(sorted_members: list[Column]) -> Column:
    """1-based rank of a 1-based increasing combination: ``1 + sum C(c_i - 1, i)``."""
    return sum((n_choose_r(c - 1, i) for i, c in enumerate(sorted_members, 1)), F.lit(1).cast("long"))


def combination_of_rank(rank: int, size: int) -> list[int]:
    """The 1-based increasing combination with a 1-based rank (the inverse of ``combination_rank``)."""
    rest, out = rank - 1, []
    for i in range(size, 0, -1):
        c = i - 1
        while math.comb(c + 1, i) <= rest:
            c += 1
        rest -= math.comb(c, i)
        out.append(c + 1)
    return out[::-1]


def gamma_tag(gamma: Column) -> Column:
    """``gamma_p0.20`` for 0.2, ``gamma_m0.20`` for -0.2."""
    return F.concat(F.lit("gamma_"), F.translate(F.format_string("%+.2f", gamma), "+-", "pm"))


def topic_pattern(topic: str) -> str:
    """A message topic with ``+`` (one level) and ``#`` (the rest) as a regular expression."""
    import re

    return "^" + re.escape(topic).replace(r"\+", "[^/]+").replace("\\#", ".*").replace("#", ".*") + "$"


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def _unit(top: Column) -> Column:
    return F.pow(F.lit(2.0), 40 - F.rint(F.log2(F.greatest(top, F.lit(2.0**-300)))))


def exact_moments(x: Column, top: Column) -> tuple[Column, Column]:
    """Aggregates: mean and population deviation of ``x``, the same bits whatever the order of rows.

    ``top`` is the largest absolute value of the group: values become whole numbers of some 40 bits, whose sums are exact. A
    larger ``top`` would cost digits. Where it isn't finite, they are plain sums.
    """
    u, n, q = F.max(_unit(top)), F.count(x), F.floor(x * _unit(top) + 0.5).cast("decimal(13,0)")
    div = lambda a, b: F.call_function("div", a, b)
    total, whole = F.sum(q), div(F.sum(q), n)
    rest = (total - whole * n).cast("long")
    squares = F.sum(q * q) - whole.cast("decimal(13,0)") * (total + rest).cast("decimal(24,0)")
    large = n * F.lit(1 << 24)
    squares = div(squares, large).cast("double") * (1 << 24) + div((squares % large).cast("long"), n).cast("double")
    part, finite = rest.cast("double") / n.cast("double"), F.max(top) < float("inf")
    deviation = F.sqrt(F.greatest(squares - part * part, F.lit(0.0))) / u
    return F.when(finite, (whole.cast("double") + part) / u).otherwise(F.avg(x)), F.when(finite, deviation).otherwise(F.stddev_pop(x))


def exact_moments_sql(name: str, rows: str, by: str, x: str) -> str:
    """CTE ``name``: ``exact_moments`` by group as ``m`` and ``s``."""
    return f"""{name}_t AS (
  SELECT {by}, max(abs({x})) AS top, pow(2::DOUBLE, 40 - round(log2(greatest(max(abs({x})), {2.0**-300!r}::DOUBLE)))) AS u FROM {rows} GROUP BY {by}), {name}_q AS (
  SELECT {by}, {x} AS x, top, u, TRY_CAST(floor({x} * u + 0.5) AS HUGEINT) AS q FROM {rows} JOIN {name}_t USING ({by})), {name}_s AS (
  SELECT {by}, max(top) AS top, max(u) AS u, count(x) AS n, sum(q) AS total, sum(q) // count(x) AS whole, sum(q) % count(x) AS rest, sum(q * q) AS squares, avg(x) AS m, stddev_pop(x) AS s FROM {name}_q GROUP BY {by}), {name}_d AS (
  SELECT *, squares - whole * (total + rest) AS d, CAST(rest AS DOUBLE) / CAST(n AS DOUBLE) AS part FROM {name}_s), {name} AS (
  SELECT {by}, CASE WHEN top < 'infinity'::DOUBLE THEN (CAST(CAST(whole AS BIGINT) AS DOUBLE) + part) / u ELSE m END AS m, CASE WHEN top < 'infinity'::DOUBLE THEN sqrt(greatest(
    CAST(CAST(d // (n * {1 << 24}) AS BIGINT) AS DOUBLE) * {1 << 24}::DOUBLE + CAST(CAST(d % (n * {1 << 24}) // n AS BIGINT) AS DOUBLE) - part * part, 0::DOUBLE)) / u ELSE s END AS s FROM {name}_d)"""
