"""Aggregate expressions for forecast scores.

All are algebraic, so partial aggregation runs before any shuffle and a hot series is no hot task.
Pairs with a missing side are left out, and a zero denominator gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from freshet.functions.scalars import _col, floor_zero


def _pair(y, yhat) -> tuple[Column, Column]:
    y, yhat = _col(y), _col(yhat)
    both = y.isNotNull() & yhat.isNotNull()
    return F.when(both, y), F.when(both, yhat)


def mae(y, yhat) -> Column:
    return F.avg(F.abs(_col(y) - _col(yhat)))


def rmse(y, yhat) -> Column:
    e = _col(y) - _col(yhat)
    return F.sqrt(F.avg(e * e))


def nse(y, yhat) -> Column:
    """1 - SSres/SStot; equal to R2 of the pairs."""
    y, yhat = _pair(y, yhat)
    e = y - yhat
    total = F.var_pop(y) * F.count(y)
    return F.when(total > 0, 1 - F.try_divide(F.sum(e * e), total))


def nse_log1p(y, yhat) -> Column:
    return nse(F.log1p(floor_zero(y)), F.log1p(floor_zero(yhat)))


def kge(y, yhat) -> Column:
    """Kling-Gupta efficiency with the correlation in covariance form (``corr`` raises on constants)."""
    y, yhat = _pair(y, yhat)
    sy, sp = F.stddev_pop(y), F.stddev_pop(yhat)
    r = F.try_divide(F.covar_pop(y, yhat), sy * sp)
    alpha = F.try_divide(sp, sy)
    beta = F.try_divide(F.avg(yhat), F.avg(y))
    score = 1 - F.sqrt(F.pow(r - 1, 2) + F.pow(alpha - 1, 2) + F.pow(beta - 1, 2))
    return F.when((sy > 0) & (sp > 0), score)
