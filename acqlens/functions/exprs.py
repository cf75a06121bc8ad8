"""Column-expression helpers shared by every operator.

All of them are built-in Catalyst expressions (no Python UDFs), so they stay in
whole-stage codegen.

Rounding is the reference's: ``round(x, n)`` on exact numerics, half away from
zero. Ratios are evaluated exactly on scaled integers,
``round(n / d) = sign * ((2|N| + |D|) div 2|D|)``, instead of dividing decimals:
Spark's decimal division may cut the quotient to 6 digits before ``round``
sees it, which rounds twice.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUM_MONEY = T.DecimalType(28, 2)
RATIO = T.DecimalType(20, 2)
_WIDE = T.DecimalType(38, 0)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _scaled(c, scale: int, times: int = 1) -> Column:
    """``c * 10**scale * times`` as an exact DECIMAL(38,0) integer."""
    factor = (10 ** scale) * times
    return (_col(c).cast(T.DecimalType(38, scale)) * F.lit(factor).cast(_WIDE)).cast(_WIDE)


def rounded_ratio(num, den, digits: int = 2, num_scale: int = 0, den_scale: int = 0,
                  factor: int = 1) -> Column:
    """Exact ``round(factor * num / nullif(den, 0), digits)``, half away from zero.

    ``num_scale`` / ``den_scale`` are the decimal scales of the operands
    (2 for money, 0 for counts). Returns DECIMAL(20, digits); NULL when the
    denominator is 0 or NULL.
    """
    a = _scaled(num, num_scale, factor * 10 ** (den_scale + digits))
    b = _scaled(den, den_scale, 10 ** num_scale)
    q = F.call_function("div", F.abs(a) * 2 + F.abs(b), F.nullif(F.abs(b) * 2, F.lit(0).cast(_WIDE)))
    signed = F.when((a < 0) != (b < 0), -q).otherwise(q)
    unit = F.lit(Decimal(1).scaleb(-digits)) if digits > 0 else F.lit(1)
    return (signed.cast(_WIDE) * unit).cast(T.DecimalType(20, digits))


def pct2(num, den) -> Column:
    """``round(100.0 * num / nullif(den, 0), 2)`` for counts."""
    return rounded_ratio(num, den, 2, 0, 0, factor=100)


def avg_round(total, count, digits: int = 2, scale: int = 2) -> Column:
    """``round(avg(x), digits)`` from a sum and a non-null count.

    Used instead of ``round(avg(x), digits)`` because Spark's decimal ``avg``
    keeps too few digits to round once.
    """
    return rounded_ratio(total, count, digits, scale, 0)


def money_sum(c) -> Column:
    return F.sum(_col(c)).cast(SUM_MONEY)


def month_start(c) -> Column:
    """``DATE_TRUNC('month', d)::date``."""
    return F.trunc(_col(c), "month")


def month_index(c) -> Column:
    """``year * 12 + month``; differences give calendar-month distances."""
    d = _col(c)
    return F.year(d) * 12 + F.month(d)


def months_between_cal(later, earlier) -> Column:
    return month_index(later) - month_index(earlier)

