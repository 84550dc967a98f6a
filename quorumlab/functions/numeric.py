"""Numeric column helpers shared by the rules, metrics and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(value: float) -> Column:
    return F.lit(float(value))


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, 0 where the denominator is 0 (safe under ANSI mode)."""
    den = den.cast("double")
    return F.when(den != 0, num.cast("double") / den).otherwise(lit(0))


def int_div(col: Column, divisor: int) -> Column:
    """Integer quotient of a long column, exact beyond the range of doubles."""
    return F.call_function("div", col.cast("long"), F.lit(divisor).cast("long"))


def round_to(col: Column, digits: int) -> Column:
    """Round the binary value, not its shortest decimal form.

    39.425 is stored slightly below the tie and so rounds to 39.42, as it does for
    engines that scale, round and scale back.
    """
    return F.round(col * 10.0**digits, 0) / 10.0**digits


def r4(col: Column) -> Column:
    """The four-decimal rounding every reported metric carries."""
    return round_to(col, 4)


def mean_of_r4(col: Column) -> Column:
    """Aggregate: mean of values that are already rounded to 4 decimals, rounded to 4.

    Such a mean often lies exactly on a rounding tie, where the summation order of
    doubles would decide the last digit.  Summing ten-thousandths as integers makes
    it exact and independent of the partitioning.
    """
    units = F.sum(F.round(col * 10000).cast("long"))
    n = F.count(col)
    halves = F.floor((units * 2 + n).cast("double") / (n * 2).cast("double"))
    return F.when(n > 0, halves.cast("double") / 10000)


def clip(col: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(col, lit(low)), lit(high))


def hex_int(hex_col: Column) -> Column:
    """A short hexadecimal string as a long."""
    return F.conv(hex_col, 16, 10).cast("long")


def unit_uniform(text: Column) -> Column:
    """A value in (0, 1) that depends on ``text`` alone, never on the partitioning."""
    return (hex_int(F.substring(F.md5(text), 1, 12)).cast("double") + 0.5) / float(16**12)


def gaussian(text: Column) -> Column:
    """A standard normal value that depends on ``text`` alone (Box-Muller)."""
    u1 = unit_uniform(F.concat(text, F.lit(":u")))
    u2 = unit_uniform(F.concat(text, F.lit(":v")))
    return F.sqrt(lit(-2.0) * F.ln(u1)) * F.cos(lit(6.283185307179586) * u2)


def duration_text(seconds: Column) -> Column:
    """``45s``, ``1m15s``, ``1h02m``; negative durations read ``0s``."""
    s = F.bround(F.greatest(seconds.cast("double"), lit(0)), 0).cast("long")
    minutes = F.floor(s / 60).cast("long")
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm%02ds", minutes, s % 60))
        .otherwise(F.format_string("%dh%02dm", F.floor(s / 3600).cast("long"), minutes % 60))
    )


def malicious_count(ratio_col: Column, num_clients: Column) -> Column:
    """Number of compromised clients, half-even like Python's ``round``."""
    return F.bround(ratio_col.cast("double") * num_clients, 0).cast("int")
