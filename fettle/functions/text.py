"""Texts shown to people: sizes, pixels, times, counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def human_size(n: Column) -> Column:
    """Bytes with a binary unit and one decimal, halves to even; ``?`` when unknown or zero."""
    text = F.when(F.coalesce(n, F.lit(0)) == 0, "?")
    for power, unit in enumerate(("B", "KB", "MB", "GB")):
        text = text.when(n < 1024 ** (power + 1), F.format_string(f"%.1f{unit}", F.bround(n / float(1024**power), 1)))
    return text.otherwise(F.format_string("%.1fTB", F.bround(n / float(1024**4), 1)))


def pixels(n: Column, digits: int = 0) -> Column:
    return F.coalesce(F.concat(F.format_number(n, digits), F.lit(" px")), F.lit(DASH))


def short_time(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "dd MMM HH:mm:ss"), F.lit(DASH))


def last_segment(path: Column, separator: str = "/") -> Column:
    tidy = F.rtrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))
    return F.when(F.coalesce(path, F.lit("")) == "", DASH).otherwise(F.substring_index(tidy, separator, -1))


def short_digest(sha: Column) -> Column:
    return F.when(F.length(sha) > 10, F.concat(F.substring(sha, 1, 4), F.lit("…"), F.substring(sha, -3, 3))).otherwise(sha)


def query_string(pairs: list[tuple[str, Column]]) -> Column:
    """URL query of the non-empty values."""
    parts = [F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string")))) for k, v in pairs]
    return F.concat_ws("&", *parts)
