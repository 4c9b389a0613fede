"""Number, money, date, code and label column expressions."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendweave.params import Params

EPSILON = 2.220446049250313e-16

# Layouts tried for dates that are neither ISO nor numeric with separators.
WRITTEN_DATES = ["MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy/M/d", "yyyyMMdd"]


def round_to(value: Column, places: int) -> Column:
    """Half-up rounding of a double after adding machine epsilon."""
    factor = float(10**places)
    return F.floor((value + F.lit(EPSILON)) * F.lit(factor) + F.lit(0.5)).cast("double") / F.lit(factor)


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once a row, however many branches of ``use`` name it."""
    return F.transform(F.array(value), lambda x: use(x)).getItem(0)


def money(value: Column, style: str = "auto", minus: str = "anywhere") -> Column:
    """Amount in a free-form cell as decimal(18,2), or null.

    ``style`` is ``auto`` (the later of comma and point is the decimal mark), ``us`` or ``eu``. With
    ``minus='anywhere'`` a hyphen in any place means negative; with ``minus='leading'`` only a leading
    one does, and another hyphen makes the value unreadable.
    """

    def plain(digits: Column) -> Column:
        # a second decimal mark makes the number unreadable, whichever it is
        european, american = F.translate(digits, ",.", "."), F.translate(digits, ",", "")
        comma_last = F.substring_index(digits, ".", -1).contains(",")
        return {"auto": F.when(comma_last, european).otherwise(american), "us": american, "eu": european}[style]

    def anywhere(text: Column) -> Column:
        negative = text.startswith("(") | text.contains("-")
        number = once(
            once(F.translate(text, "()-", ""), plain),
            lambda p: F.when(p == "", F.lit("0")).otherwise(p).try_cast("decimal(18,2)"),
        )
        return F.when(text != "", F.when(negative, -number).otherwise(number))

    def leading(trimmed: Column) -> Column:
        negative = trimmed.rlike(r"^\(.*\)$") | trimmed.startswith("-")
        number = once(
            F.regexp_replace(trimmed, "[^0-9.,-]+", ""),
            lambda digits: F.when(digits != "", plain(digits).try_cast("decimal(18,2)")),
        )
        return F.when(negative, -F.abs(number)).otherwise(number)

    if minus == "anywhere":
        return once(F.regexp_replace(F.trim(value), "[^0-9.,()-]+", ""), anywhere)
    return once(F.trim(value), leading)


def iso_date(value: Column) -> Column:
    """``YYYY-MM-DD`` from mixed date spellings, or null. Numeric dates are read month first when possible."""
    text = F.trim(value)
    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})"
    numeric = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})$"

    def two(c: Column) -> Column:
        return F.lpad(c, 2, "0")

    from_iso = F.concat_ws("-", F.regexp_extract(text, iso, 1), two(F.regexp_extract(text, iso, 2)), two(F.regexp_extract(text, iso, 3)))
    first = F.regexp_extract(text, numeric, 1).try_cast("int")
    second = F.regexp_extract(text, numeric, 2).try_cast("int")
    year = F.regexp_extract(text, numeric, 3)
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    month, day = F.when(first <= 12, first).otherwise(second), F.when(first <= 12, second).otherwise(first)
    sound = text.rlike(numeric) & month.between(1, 12) & day.between(1, 31)
    from_numeric = F.concat_ws("-", year, two(month.cast("string")), two(day.cast("string")))
    written = F.coalesce(*[F.try_to_timestamp(text, F.lit(layout)) for layout in WRITTEN_DATES])
    return F.when(text.rlike(iso), from_iso).when(sound, from_numeric).otherwise(F.date_format(written, "yyyy-MM-dd"))


def is_code(value: Column) -> Column:
    return F.coalesce(F.trim(value).rlike(r"^\d{8}$"), F.lit(False))


def coerce_code(value: Column) -> Column:
    digits = F.regexp_replace(value, r"\D", "")
    return F.when(F.length(digits) == 8, digits).when(F.length(digits) == 7, F.concat(F.lit("0"), digits))


def code_prefix(value: str | None) -> str | None:
    """Digits of a code prefix given by a user, at most eight; None when there is none."""
    digits = "".join(ch for ch in value or "" if ch in "0123456789")[:8]
    return digits or None


def as_of(moment: datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def age_days(since: Column, moment: datetime) -> Column:
    """Whole days elapsed, floored, never negative (not the number of midnights between)."""
    elapsed = F.unix_micros(as_of(moment).cast("timestamp")) - F.unix_micros(since.cast("timestamp"))
    return F.greatest(F.lit(0).cast("long"), F.floor(elapsed / F.lit(86_400_000_000.0)))


def confidence_band(confidence: Column, params: Params) -> Column:
    return (
        F.when(confidence.isNull(), "none")
        .when(confidence >= params.high_confidence, "high")
        .when(confidence >= params.confidence_threshold, "medium")
        .otherwise("low")
    )


def route_tier(is_parent: Column, amount: Column, has_parent: Column, params: Params, strategy: str = "tiered") -> Column:
    """Scorer tier of a supplier: parents, large spend and rows without a parent get the accurate one."""
    if strategy in ("accurate", "bulk"):
        return F.lit(params.accurate_model if strategy == "accurate" else params.bulk_model)
    accurate = F.coalesce(is_parent, F.lit(False)) | (F.coalesce(amount, F.lit(0)) >= params.high_value_spend) | ~has_parent
    return F.when(accurate, params.accurate_model).otherwise(params.bulk_model)


def low_confidence(confidence: Column, reviewed: Column, threshold: float) -> Column:
    """Classified below the threshold and not reviewed; false when unclassified."""
    return F.coalesce((confidence < threshold) & ~reviewed, F.lit(False))
