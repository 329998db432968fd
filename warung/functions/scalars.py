"""Column functions: time buckets, missing values and text labels.

Everything here is a built-in Spark expression, so it stays inside whole-stage
codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from warung.fixed_values import LABEL_WIDTH


# ------------------------------------------------------------------- time
def day_ts(ts: Column) -> Column:
    """Timestamp -> midnight of its day, as ``timestamp_ntz``.

    Goes through DATE so no session time zone is involved.
    """
    return ts.cast("date").cast("timestamp_ntz")


def bucket_start(ts: Column, grain: str) -> Column:
    """Left edge of the day / Monday week / month holding ``ts``.

    Weekly bins are [Monday, next Monday) labelled by their Monday; monthly
    bins are labelled by the first of the month.
    """
    d = ts.cast("date")
    if grain == "day":
        out = d
    elif grain == "week":
        out = F.trunc(d, "week")
    elif grain == "month":
        out = F.trunc(d, "month")
    else:
        raise ValueError(f"unknown grain {grain!r}")
    return out.cast("timestamp_ntz")


def grain_step(grain: str) -> Column:
    return {"day": F.expr("INTERVAL 1 DAY"), "week": F.expr("INTERVAL 7 DAYS"),
            "month": F.expr("INTERVAL 1 MONTH")}[grain]


# ---------------------------------------------------------- missing values
def as_missing(c: Column, is_double: bool = True) -> Column:
    """NaN counts as missing, like NULL (decimal and integer columns have no NaN)."""
    return F.nanvl(c, F.lit(None).cast("double")) if is_double else c


def is_present(c: Column, is_double: bool = True) -> Column:
    return (c.isNotNull() & ~F.isnan(c)) if is_double else c.isNotNull()


# ------------------------------------------------------------- arithmetic
def at_least_one(total: Column) -> Column:
    """``max(total, 1)`` with an empty total counted as 0."""
    return F.greatest(F.coalesce(total, F.lit(0)), F.lit(1))


def percent_of(part: Column, total: Column) -> Column:
    """Part / total * 100 in double, in that order of operations."""
    return part.cast("double") / total.cast("double") * F.lit(100.0)


# ------------------------------------------------------------------ text
def money_text(x: Column) -> Column:
    """P5: ``$1,234``; half-even to whole units; negatives print ``$-1,234``."""
    return F.concat(F.lit("$"), F.format_number(x, 0))


def count_text(x: Column) -> Column:
    """Thousands grouping, whole units; a count keeps all its digits."""
    return F.format_number(x, 0)


def plain_text(x: Column, decimals: int) -> Column:
    """Fixed-point text *without* thousands grouping (``{:.3f}``), rounded
    half-even like ``format_number``."""
    return F.regexp_replace(F.format_number(x.cast("double"), decimals), ",", "")


def percent_text(x: Column, decimals: int = 1) -> Column:
    """``12.3%`` / ``1234.5%`` — no grouping, half-even."""
    return F.concat(plain_text(x, decimals), F.lit("%"))


def fixed_text(x: Column, decimals: int) -> Column:
    """Fixed-point text with thousands grouping (``{:,.3f}``)."""
    return F.format_number(x.cast("double"), decimals)


def signed_text(x: Column) -> Column:
    """``+1,234`` / ``-1,234`` (the sign follows the rounded text, so
    -0.4 and -0.0 print ``-0``)."""
    t = F.format_number(x.cast("double"), 0)
    return F.concat(F.when(t.startswith("-"), F.lit("")).otherwise(F.lit("+")), t)


def count_share_text(v: Column, share: Column) -> Column:
    """P9 (status): ``"1,234  (5.6%)"``."""
    return F.concat(count_text(v), F.lit("  ("), percent_text(share), F.lit(")"))


def short_label(s: Column, width: int = LABEL_WIDTH) -> Column:
    """P10: over ``width`` chars keep the first ``width``, cut at the last
    space, add an ellipsis; without a space keep all ``width``."""
    s = s.cast("string")
    head = F.substring(s, 1, width)
    cut = F.regexp_replace(head, " [^ ]*$", "")
    return F.when(F.length(s) <= width, s).otherwise(F.concat(cut, F.lit("…")))


def key_label(name: Column, key: Column) -> Column:
    """The display name, or the key as text when there is none."""
    return F.coalesce(name, key.cast("string"))


def dash_if_missing(text: Column) -> Column:
    """A missing value prints as an em dash."""
    return F.coalesce(text, F.lit("—"))
