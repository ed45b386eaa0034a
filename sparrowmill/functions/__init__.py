"""Column expressions shared by the jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact(value: str) -> Column:
    """A double as a decimal: its sums do not depend on the order of rows."""
    return F.col(value).cast("decimal(18,4)")


def discounted(price: str = "l_extendedprice", discount: str = "l_discount") -> Column:
    """Price after discount, as a decimal: its sums do not depend on the order of rows."""
    return (F.col(price) * (1 - F.col(discount))).cast("decimal(18,4)")


def money(total: Column) -> Column:
    """A sum rounded to cents, as a double."""
    return F.round(total, 2).cast("double")


def utc(ts: str) -> Column:
    """A zone-less timestamp as an instant; exact while the session's zone is UTC."""
    return F.col(ts).cast("timestamp")
