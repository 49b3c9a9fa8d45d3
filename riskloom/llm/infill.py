"""Fill-in-the-middle: cut each text at two unit borders and put its parts in another order.

DataFrame functions only. ``regexp_count`` counts a text's units; a pattern written for the row, with one possessive
counted group for the prefix and one for the middle, then finds all three parts in a single match. Possessive
groups are matched in a loop without backtracking, so a text may have any number of units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run of ASCII letters, or any other code point.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ANY_MARK = f"{PREFIX}|{SUFFIX}|{MIDDLE}"
#: Of 100 texts so many are transformed, and of 100 transformed ones so many have their suffix first.
RATE, SUFFIX_FIRST = 90, 20

#: What the match becomes, by form.
LAYOUT = {"psm": f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", "spm": f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"}
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]


def draws(key: Column, seed: str) -> list[Column]:
    """Four 32-bit numbers that depend on seed and key only; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def pattern(first: Column, second: Column) -> Column:
    """Matches a whole text; its groups are the first ``first`` units, the next ``second`` ones, and the rest."""
    group = lambda n: F.concat(F.lit(f"((?:{UNIT}){{"), n.cast("string"), F.lit("}+)"))
    return F.concat(F.lit("(?s)\\A"), group(first), group(second), F.lit("(.*)\\z"))


def parts(output: Column, form: Column) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix of an output that is not plain.

    Its text holds no mark, and no mark begins as another ends, so the marks found are those put in.
    """
    cut = F.split(output, ANY_MARK, -1)
    spm = form == "spm"
    return F.when(spm, F.get(cut, F.lit(2))).otherwise(F.get(cut, F.lit(1))), F.get(cut, F.lit(3)), F.when(spm, F.get(cut, F.lit(1))).otherwise(F.get(cut, F.lit(2)))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    return F.when(form == "plain", output).otherwise(F.concat(*parts(output, form)))


def transform(df: DataFrame, text: str = "text", key: str = "doc_id", seed: str = "1", rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Append n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output to every row.

    A null text counts as empty. Empty texts and those that hold a mark stay plain, the others are transformed by
    draws on their key; so equal keys with equal texts get equal results, and a null key draws like an empty one.
    Columns of the added names are replaced, all others are kept. No row moves between tasks.
    """
    kept = [c for c in df.columns if c not in ADDED]
    # The operator's own columns stand beside a struct of the caller's, so that no name clashes.
    h = draws(F.col("_key"), seed)
    rows = df.select(F.struct(*([F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("none")])).alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"), F.col(f"`{key}`").alias("_key"))
    whole = (F.col("_text") == "") | F.col("_text").rlike(ANY_MARK) | (h[2] % 100 >= rate)
    rows = rows.withColumns({"form": F.when(whole, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm"),
                             "n": F.regexp_count("_text", F.lit(UNIT)).cast("long"), "_x": h[0], "_y": h[1]})
    rows = rows.withColumns({"_x": F.col("_x") % (F.col("n") + 1), "_y": F.col("_y") % (F.col("n") + 1)})
    least, most = F.least("_x", "_y"), F.greatest("_x", "_y")
    layout = F.when(F.col("form") == "spm", LAYOUT["spm"]).otherwise(LAYOUT["psm"])
    rows = rows.withColumn("output", F.when(F.col("form") == "plain", F.col("_text")).otherwise(F.regexp_replace("_text", pattern(least, most - least), layout)))
    prefix, middle, _ = parts(F.col("output"), F.col("form"))
    count = lambda c: F.when(F.col("form") != "plain", F.length(c).cast("long"))
    return rows.select(*(F.col(f"_row.`{c}`").alias(c) for c in kept), "n", "form", count(prefix).alias("prefix_chars"), count(middle).alias("middle_chars"), "output")
