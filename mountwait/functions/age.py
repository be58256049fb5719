"""Calendar age of two timestamps, the way SQL ``AGE(a, b)`` counts it.

The result is a calendar interval (months, days, time of day), not a plain
difference: 71 days can be "2 mons 10 days".  Fields are differences of the
calendar fields of the later and the earlier value with borrowing:

* ``us``     = time-of-day(later) - time-of-day(earlier); below zero: add one
  day of micros and take one from ``days``;
* ``days``   = day-of-month(later) - day-of-month(earlier) (minus that
  borrow); below zero: add the length of the earlier value's month and take
  one from ``months``;
* ``months`` = 12 * year difference + month difference (minus that borrow).

When ``a < b`` every field is negated.  All built-in expressions, so the
whole thing stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mountwait.functions.timecols import epoch_micros

_DAY_US = 86_400 * 1_000_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def with_age(df, later, earlier, prefix: str = "age_", total: str | None = None):
    """Add ``{prefix}months``, ``{prefix}days``, ``{prefix}us`` (and ``total``,
    the exact difference in micros, when named) for ``AGE(later, earlier)``.

    Computed in a few small projections: each intermediate value is its own column
    and is computed once, so the generated code stays small (one nested expression
    would repeat its sub-trees).  Intermediate values are only referenced as columns,
    which the optimizer keeps as separate cheap projections.  The
    arithmetic is written as SQL expressions: one call to the JVM per
    projection instead of one per operator.
    """
    day = _DAY_US
    d = df.select("*", epoch_micros(_c(later)).alias("_ag_a"),
                  epoch_micros(_c(earlier)).alias("_ag_b"))
    # null when either time is (greatest and least would skip it)
    d = d.selectExpr("*", "CASE WHEN _ag_a < _ag_b THEN _ag_b WHEN _ag_a >= _ag_b THEN _ag_a END AS _ag_hi",
                     "CASE WHEN _ag_a < _ag_b THEN _ag_a WHEN _ag_a >= _ag_b THEN _ag_b END AS _ag_lo",
                     "CASE WHEN _ag_a < _ag_b THEN -1 ELSE 1 END AS _ag_sg")
    d = d.selectExpr("*", f"pmod(_ag_hi, {day}) - pmod(_ag_lo, {day}) AS _ag_us0",
                     f"date_from_unix_date(CAST(floor(_ag_hi / {day}) AS INT)) AS _ag_hd",
                     f"date_from_unix_date(CAST(floor(_ag_lo / {day}) AS INT)) AS _ag_ld")
    d = d.selectExpr("*", "dayofmonth(_ag_hd) - dayofmonth(_ag_ld) - CAST(_ag_us0 < 0 AS INT) AS _ag_d0")
    outs = {prefix + "months", prefix + "days", prefix + "us", total}
    keep = ["`" + c.replace("`", "``") + "`" for c in df.columns if c not in outs]
    exprs = [
        "CAST(((year(_ag_hd) - year(_ag_ld)) * 12 + month(_ag_hd) - month(_ag_ld)"
        f" - CAST(_ag_d0 < 0 AS INT)) * _ag_sg AS INT) AS `{prefix}months`",
        "CAST((_ag_d0 + CAST(_ag_d0 < 0 AS INT) * dayofmonth(last_day(_ag_ld))) * _ag_sg AS INT)"
        f" AS `{prefix}days`",
        f"CAST((_ag_us0 + CAST(_ag_us0 < 0 AS BIGINT) * {day}) * _ag_sg AS BIGINT) AS `{prefix}us`",
    ]
    if total:
        exprs.append(f"CAST(_ag_a - _ag_b AS BIGINT) AS `{total}`")
    return d.selectExpr(*keep, *exprs)
