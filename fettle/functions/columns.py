"""Small column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def n_where(condition: Column) -> Column:
    """Count of the rows that satisfy ``condition``; 0 on no rows."""
    return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0).cast("bigint"))


def ratio(num: ColumnLike, den: ColumnLike) -> Column:
    """num / den, null where den is 0 (ANSI mode raises otherwise)."""
    return col(num).cast("double") / F.nullif(col(den).cast("double"), F.lit(0.0))


def percent(num: ColumnLike, den: ColumnLike, digits: int = 1) -> Column:
    """Share in percent, 0.0 on an empty base."""
    return F.coalesce(F.round(ratio(col(num) * F.lit(100.0), den), digits), F.lit(0.0))


def round_scaled(c: ColumnLike, digits: int) -> Column:
    """Half away from zero on the scaled double, as the SQL rounds.

    Spark's own ``round`` decides by the decimal digits in which a double is shown. The two differ where a mean lies half way or one last digit
    beside it: 0.0014874999999999999 shows less than a half, but times 1e6 it is one; 0.0019625 shows a half and is none.
    """
    scaled = col(c) * 10.0**digits
    return F.signum(scaled) * F.round(F.abs(scaled), 0) / 10.0**digits


def r6(c: ColumnLike) -> Column:
    return F.round(col(c), 6)


def iso(ts: ColumnLike) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def wall_micros(ts: ColumnLike) -> Column:
    """Microseconds on the wall clock since 1970, whatever the session time zone."""
    t = col(ts)
    minutes = F.unix_date(F.to_date(t)).cast("bigint") * 1440 + F.hour(t) * 60 + F.minute(t)
    return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("bigint")


def draw_hash(seed: ColumnLike | int, key: ColumnLike) -> Column:
    """Hex digest that fixes a draw order: same everywhere, whatever the partitioning."""
    s = F.lit(str(seed)) if isinstance(seed, int) else col(seed)
    return F.md5(F.concat(s, F.lit(":"), col(key).cast("string")))


def hex32(digest: Column) -> Column:
    """The first 8 hex digits of a digest as a number in [0, 2^32)."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def unit_draw(digest: Column) -> Column:
    return hex32(digest) / F.lit(4294967296.0)


def empty_to_null(c: ColumnLike) -> Column:
    return F.when(F.trim(col(c)) != "", F.trim(col(c)))


def nan_to_null(c: ColumnLike) -> Column:
    return F.when(~F.isnan(col(c)), col(c))
