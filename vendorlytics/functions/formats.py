"""Column-expression helpers for the reference's scalar functions.

All are built-in Spark expressions (JVM-side, inside whole-stage codegen).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reference's TO_CHAR patterns and their Spark equivalents.
#   'DD/MM/YYYY HH24:MI' -> 'dd/MM/yyyy HH:mm'
#   'DD Mon'             -> 'dd MMM'
#   'Month'              -> 'MMMM', blank-padded to 9 characters
TS_MINUTE = "dd/MM/yyyy HH:mm"
DAY_LABEL = "dd MMM"
MONTH_NAME = "MMMM"
MONTH_PAD = 9


def money(c) -> Column:
    """``::float8`` applied after an exact decimal computation."""
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def to_char_minute(c) -> Column:
    return F.date_format(c, TS_MINUTE)


def day_label(c) -> Column:
    return F.date_format(c, DAY_LABEL)


def month_label(c) -> Column:
    """``TO_CHAR(x, 'Month')``: full month name blank-padded to 9."""
    return F.rpad(F.date_format(c, MONTH_NAME), MONTH_PAD, " ")


def slugify(c) -> Column:
    """lower -> non [a-z0-9-] to '-' -> squeeze '-' runs -> drop one '-' each end."""
    s = F.regexp_replace(F.lower(c), r"[^a-z0-9-]", "-")
    s = F.regexp_replace(s, r"-+", "-")
    return F.regexp_replace(s, r"^-|-$", "")


def digits_only(c) -> Column:
    return F.regexp_replace(c, r"\D", "")


def nonempty(c) -> Column:
    """JavaScript truthiness of a string field: not NULL and not ''."""
    return c.isNotNull() & (c != "")
