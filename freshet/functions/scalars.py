"""Column helpers. Missing is always NULL: NaN is turned into NULL where data comes in."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from freshet import fixed


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    return F.nanvl(_col(c), F.lit(None).cast("double"))


def to_number(c) -> Column:
    """Tolerant number: what cannot be read, and NaN, become NULL.

    The cast would read a Java type suffix (``1.5d``) as a number; such cells are text here.
    """
    text = F.trim(_col(c).cast("string"))
    return F.when(~text.rlike(r"(?i)[0-9.][df]$"), nan_to_null(text.try_cast("double")))


#: Shapes of dates other than ISO text, and how they are read.
TIME_FORMATS = [
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "y/M/d"),
    (r"^[0-9]{8}$", "yyyyMMdd"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/y"),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "M-d-y"),
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2} [0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$", "y/M/d H:mm[:ss]"),
]


def to_time(c, kind: str = "date") -> Column:
    """Tolerant date, or ``timestamp_ntz`` for a finer panel: what cannot be read becomes NULL.

    Text in one of ``TIME_FORMATS`` is read too; of an ambiguous day and month the month comes first.
    """
    text = F.trim(_col(c).cast("string"))
    other = [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(form))).cast(kind) for shape, form in TIME_FORMATS]
    return F.coalesce(_col(c).try_cast(kind), *other)


def repair_id(c) -> Column:
    """Series id as text, without the ``.0`` a float-typed CSV column leaves behind."""
    return F.regexp_replace(_col(c).cast("string"), r"\.0$", "")


def normal_name(c) -> Column:
    return F.regexp_replace(F.lower(F.trim(_col(c))), r"[ \-./]", "_")


def normal_names(names: list[str]) -> list[str]:
    """The same rule as :func:`normal_name`, for column names."""
    return [re.sub(r"[ \-./]", "_", n.strip().lower()) for n in names]


def null_negative(c) -> Column:
    c = _col(c)
    return F.when(c < 0, F.lit(None)).otherwise(c)


def floor_zero(c) -> Column:
    """Lower bound zero that keeps NULL (``greatest`` would turn NULL into 0)."""
    c = _col(c)
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def degree_days(c, base: float) -> Column:
    return floor_zero(_col(c) - F.lit(float(base)))


def log_target(c) -> Column:
    return F.log1p(floor_zero(c))


def unlog(c) -> Column:
    return F.expm1(_col(c))


def is_zero_name(c) -> Column:
    """Does a feature name fall under the zero-imputation rule? For name columns."""
    return _col(c).rlike("|".join(f"(?:{p})" for p in fixed.ZERO_PATTERNS))


def is_zero_feature(name: str) -> bool:
    return any(re.search(p, name) for p in fixed.ZERO_PATTERNS)


def is_core_name(c) -> Column:
    return _col(c).rlike("|".join(f"(?:{p})" for p in fixed.CORE_PATTERNS))


def parse_list(c) -> Column:
    """Array of strings from its text form (``['a', 'b']``); unreadable text gives an empty array."""
    read = F.from_json(F.translate(_col(c), "'", '"'), "array<string>")
    return F.coalesce(read, F.array().cast("array<string>"))
