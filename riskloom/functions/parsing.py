"""Raw text to typed columns. Every function is Column -> Column and stays in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMAT = "yyyy-MM-dd HH:mm:ss"


def money(text: Column) -> Column:
    """``"$-1,234.50"`` -> -1234.5; text that is no number becomes NULL."""
    return F.translate(text.cast("string"), "$,", "").try_cast("double")


def yes_flag(text: Column) -> Column:
    """1 for any spelling of yes, else 0; a missing value counts as not yes."""
    return F.coalesce((F.lower(F.trim(text.cast("string"))) == "yes").cast("int"), F.lit(0))


def instant(text: Column) -> Column:
    """Fixed-format timestamp; a malformed value fails the job instead of turning NULL."""
    return F.to_timestamp(text, DATE_FORMAT)


def has_error(errors: Column) -> Column:
    return (F.length(F.coalesce(errors, F.lit(""))) > 0).cast("int")


def error_kind(errors: Column, trim: bool = False) -> Column:
    """First entry of the comma list, or ``none``. Requests are trimmed, history is not."""
    first = F.split_part(F.coalesce(errors, F.lit("")), F.lit(","), F.lit(1))
    if trim:
        # A request whose error text is present but blank keeps its blank kind.
        return F.when(has_error(errors) == 1, F.trim(first)).otherwise(F.lit("none"))
    return F.when(F.length(first) > 0, first).otherwise(F.lit("none"))


def card_not_present(zip_code: Column) -> Column:
    """A missing ZIP is the signal, so it becomes a flag and is never imputed."""
    return zip_code.isNull().cast("int")


def merchant_state(state: Column) -> Column:
    return F.coalesce(state, F.lit("ONLINE"))
