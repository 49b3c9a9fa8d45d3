"""A fingerprint of a request, so that logs never hold the request itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.schema import REQUEST_FIELDS


def plain_number(x: Column) -> Column:
    """Shortest decimal text of a double without an exponent, always with a decimal point."""
    text = x.cast("string")
    wide = F.rtrim(F.translate(F.format_number(x, 16), ",", ""), F.lit("0"))
    wide = F.when(wide.endswith("."), F.concat(wide, F.lit("0"))).otherwise(wide)
    return F.when(text.contains("E"), wide).otherwise(text)


def _text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = plain_number(c.cast("double"))
    elif isinstance(kind, T.BooleanType):
        c = F.initcap(c.cast("string"))
    # concat_ws would skip NULLs and let two different requests collide.
    return F.coalesce(c.cast("string"), F.lit("None"))


def fingerprint(df: DataFrame, fields: list[str] | None = None) -> Column:
    """SHA-256 over ``name=value`` pairs in name order joined by ``|``."""
    names = sorted(fields or [f for f in REQUEST_FIELDS if f in df.columns])
    pairs = [F.concat(F.lit(f"{n}="), _text(df, n)) for n in names]
    return F.sha2(F.concat_ws("|", *pairs), 256)
