"""Rates, and the rate-ratio comparison for clustered failures, as column expressions.

One side of a comparison is a struct column with ``count`` (findings), ``calls`` (observed calls),
``phi`` (its dispersion), ``contributing`` (sessions with a finding) and ``units`` (sessions with a
finding or an observed call). ANSI division raises on zero, so every division is guarded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionlens.functions.text import literal_array, round_half_up

# Two-sided 95% quantiles, normal and Student's t for 1 to 30 degrees of freedom.
Z_975 = 1.959963984540054
T_975 = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228,
    2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086,
    2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
)
INFINITE = float("inf")


def _d(x) -> Column:
    return F.lit(float(x))


def rate_per_k(count: Column, calls: Column) -> Column:
    """Findings per 1,000 observed calls, two decimals, NULL without calls."""
    return round_half_up(
        F.try_divide(count.cast("double") * _d(1000), F.nullif(calls, F.lit(0)).cast("double")), 2)


def delta(rate: Column, baseline: Column) -> Column:
    """Difference of two already rounded rates."""
    return round_half_up(rate - baseline, 2)


def dispersion(k: Column, total_calls: Column, sum_x: Column, sum_x2: Column, sum_xn: Column,
               sum_n2: Column, max_x: Column) -> Column:
    """How clustered events are over sessions, from sums over the sessions; never below 1.

    k/(k-1) * sum((x - r*n)^2) / X with r = X/N, the square expanded so one pass of sums is enough.
    """
    x, n = sum_x.cast("double"), total_calls.cast("double")
    rate = F.coalesce(F.try_divide(x, F.nullif(n, _d(0))), _d(0))
    squares = sum_x2.cast("double") - _d(2) * rate * sum_xn + rate * rate * sum_n2
    spread = F.try_divide(k.cast("double"), F.nullif(k - 1, F.lit(0)).cast("double")) \
        * F.try_divide(squares, F.nullif(x, _d(0)))
    poisson = (k < 2) | (sum_x == 0) | (max_x <= 1)
    return F.when(poisson, _d(1)).otherwise(F.greatest(_d(1), spread))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body reads it.

    Chained projections of struct fields are merged into one expression that repeats each step's
    whole tree at every use; binding a step to a lambda variable keeps the expression small.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def spread(base: Column, cand: Column) -> Column:
    """``struct(phi, df)``: the factor on the log ratio's variance, the degrees of freedom behind it.

    A side that cannot show its own spread (no findings, or all from one session) is taken to spread
    at least as the other side does. The degrees of freedom follow Welch-Satterthwaite on the
    estimated excess, capped by the contributing sessions less the two rates.
    """
    x1, x2, s1, s2 = base["count"], cand["count"], base["contributing"], cand["contributing"]
    silent = (x1 == 0) & (x2 == 0)
    half = F.when((x1 == 0) | (x2 == 0), 0.5).otherwise(0.0)
    own1, own2 = F.greatest(_d(1), base["phi"]), F.greatest(_d(1), cand["phi"])
    shows1, shows2 = (x1 > 0) & (s1 >= 2), (x2 > 0) & (s2 >= 2)
    parts = F.struct(
        F.when(~silent, _d(1) / (x1 + half)).alias("inv1"),
        F.when(~silent, _d(1) / (x2 + half)).alias("inv2"),
        F.when(~shows1 & shows2, F.greatest(own1, own2)).otherwise(own1).alias("phi1"),
        F.when(shows1 & ~shows2, F.greatest(own1, own2)).otherwise(own2).alias("phi2"),
        shows1.alias("shows1"), (shows1 & shows2).alias("both"))

    def combined(p: Column) -> Column:
        variance = p["phi1"] * p["inv1"] + p["phi2"] * p["inv2"]
        return F.struct(variance.alias("variance"),
                        (variance / (p["inv1"] + p["inv2"])).alias("phi"))

    def share(excess: Column, contributing: Column, variance: Column) -> Column:
        # a side with one contributing session has no degree of freedom to divide by
        return (F.when(excess <= _d(1e-9) * variance, _d(0))
                .when(contributing <= 1, _d(INFINITE))
                .otherwise(excess * excess
                           / F.when(contributing > 1, contributing - 1).cast("double")))

    def estimated(p: Column, v: Column) -> Column:
        var = v["variance"]
        separate = (share((p["phi1"] - 1) * p["inv1"], s1, var)
                    + share((p["phi2"] - 1) * p["inv2"], s2, var))
        # both sides borrow the same phi: count its excess once, with the sessions it came from
        shared = share((v["phi"] - 1) * (p["inv1"] + p["inv2"]),
                       F.when(p["shows1"], s1).otherwise(s2), var)
        return F.when(p["both"], separate).otherwise(shared)

    cap = s1 + s2 - 2

    def with_df(v: Column, e: Column) -> Column:
        welch = (F.when(e == 0, _d(INFINITE)).when(e == _d(INFINITE), _d(0))
                 .otherwise(F.try_divide(v["variance"] * v["variance"], F.nullif(e, _d(0)))))
        df = (F.when(silent, _d(INFINITE))
              .when((cap < 1) | (base["units"] < 2) | (cand["units"] < 2), _d(0))
              .otherwise(F.least(welch, cap.cast("double"))))
        return F.struct(F.when(silent, _d(1)).otherwise(v["phi"]).alias("phi"), df.alias("df"))

    return let(parts, lambda p: let(combined(p), lambda v: let(
        estimated(p, v), lambda e: with_df(v, e))))


def t_quantile(df: Column) -> Column:
    """Two-sided 95% quantile; a fractional df rounds down, beyond the table Cornish-Fisher."""
    table = literal_array(T_975)
    z = Z_975

    def at(whole: Column) -> Column:
        beyond = (_d(z) + _d(z ** 3 + z) / (_d(4) * whole)
                  + _d(5 * z ** 5 + 16 * z ** 3 + 3 * z) / (_d(96) * whole * whole)
                  + _d(3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z)
                  / (_d(384) * whole * whole * whole))
        return F.when(whole <= len(T_975),
                      F.try_element_at(table, F.least(whole, _d(len(T_975))).cast("int"))) \
            .otherwise(beyond)

    unbounded = df.isNull() | F.isnan(df) | (df == _d(INFINITE))
    whole = F.greatest(_d(1), F.floor(F.least(df, _d(1e6))).cast("double"))
    return F.when(unbounded, _d(z)).otherwise(let(whole, at))


def rate_ratio(base: Column, cand: Column, phi: Column, df: Column) -> Column:
    """``struct(ratio, low, high, verdict)`` of the candidate's rate over the baseline's.

    The verdict reads the unrounded interval, never the point estimate.
    """
    no_data = (base["calls"] <= 0) | (cand["calls"] <= 0)
    x1, x2 = base["count"], cand["count"]
    usable = ~no_data & ~((x1 == 0) & (x2 == 0))
    half = F.when((x1 == 0) | (x2 == 0), 0.5).otherwise(0.0)
    events = F.when(usable, F.struct(
        (x1 + half).alias("x1"), (x2 + half).alias("x2"),
        base["calls"].cast("double").alias("n1"), cand["calls"].cast("double").alias("n2")))

    def interval(e: Column) -> Column:
        log_ratio = F.ln((e["x2"] / e["n2"]) / (e["x1"] / e["n1"]))
        se = F.sqrt(F.greatest(_d(1), phi) * (_d(1) / e["x1"] + _d(1) / e["x2"]))
        return F.struct(log_ratio.alias("log"),
                        F.when(df >= 1, t_quantile(df) * se).alias("reach"))

    def bounds(i: Column) -> Column:
        return F.struct(F.exp(i["log"]).alias("ratio"), F.exp(i["log"] - i["reach"]).alias("low"),
                        F.exp(i["log"] + i["reach"]).alias("high"))

    def told(b: Column) -> Column:
        return F.struct(
            round_half_up(b["ratio"], 3).alias("ratio"), round_half_up(b["low"], 3).alias("low"),
            round_half_up(b["high"], 3).alias("high"),
            F.when(no_data, "no-data").when(b["high"] < 1, "better").when(b["low"] > 1, "worse")
            .otherwise("inconclusive").alias("verdict"))

    return let(events, lambda e: let(interval(e), lambda i: let(bounds(i), told)))


def compare_sides(base: Column, cand: Column) -> Column:
    """The spread and the ratio of two sides in one struct, the spread computed once."""
    def judged(s: Column) -> Column:
        return F.struct(s["phi"].alias("phi"), s["df"].alias("df"),
                        rate_ratio(base, cand, s["phi"], s["df"]).alias("r"))

    return let(spread(base, cand), judged)
