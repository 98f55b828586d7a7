"""Column functions with results that do not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(column: str, kind: str) -> Column:
    """Microseconds since 1970 of a time column of type ``kind``: of a wall clock as it stands, in any session time zone."""
    own = F.col("`" + column.replace("`", "``") + "`")
    if kind != "timestamp_ntz":
        return F.unix_micros(own.cast("timestamp"))
    since = own - F.expr(_EPOCH)
    part = lambda field: F.extract(F.lit(field), since)
    whole = (part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return whole * F.lit(60_000_000).cast("long") + (part("SECOND") * 1_000_000).cast("long")


def instant(column: str, kind: str) -> Column:
    """A time column as an instant; a wall clock is taken to be in UTC."""
    return F.timestamp_micros(micros(column, kind))


def wall_clock(column: str) -> Column:
    """An instant as the wall clock in UTC."""
    return F.expr(_EPOCH) + F.make_dt_interval(secs=(F.unix_micros(F.col(column)) / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))


def quoted_columns(names: list[str]) -> list[Column]:
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def money(column: Column | str, scale: int = 2) -> Column:
    """A double that holds decimal amounts, as an exact decimal."""
    return (F.col(column) if isinstance(column, str) else column).cast(f"decimal(18,{scale})")


def exact_sum(column: Column | str, scale: int = 2) -> Column:
    """Sum of decimal amounts, exact in any order, as a double."""
    return F.sum(money(column, scale)).cast("double")


def exact_avg(column: Column | str, scale: int = 2) -> Column:
    """Mean from the exact sum."""
    own = F.col(column) if isinstance(column, str) else column
    return exact_sum(own, scale) / F.count(own)


def net_price() -> Column:
    """Extended price less discount, with four exact decimals."""
    return money("l_extendedprice") * (F.lit(1).cast("decimal(3,2)") - F.col("l_discount").cast("decimal(3,2)"))


def population_skewness(n: Column, s1: Column, s2: Column, s3: Column) -> Column:
    """Skewness from power sums, by the population formula."""
    mean, var = s1 / n, s2 / n - (s1 / n) ** 2
    return (s3 / n - 3 * mean * s2 / n + 2 * mean**3) / F.pow(var, F.lit(1.5))
