"""Column expressions on raw cell strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NULL_TOKENS = ["", "null", "none", "na", "nan", "n/a"]
BOOL_TOKENS = ["true", "false", "yes", "no", "0", "1", "t", "f", "y", "n"]
INT = r"^-?[0-9]+$"
NUMBER = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def is_null_token(c: Column) -> Column:
    """Null, or one of the null tokens after trimming, in any case."""
    return F.coalesce(F.lower(F.trim(c)).isin(NULL_TOKENS), F.lit(True))


def number(c: Column) -> Column:
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def dtype_vote(value: Column) -> Column:
    """An aggregate: the strictest of int, float, bool, str that all non-null values allow; str for none."""
    every = lambda c: F.coalesce(F.bool_and(c), F.lit(False))
    v = F.trim(value)
    return F.when(every(v.rlike(INT)), "int").when(every(v.rlike(NUMBER)), "float").when(every(F.lower(v).isin(BOOL_TOKENS)), "bool").otherwise("str")


def char_class(value: Column) -> Column:
    """An aggregate over non-null values: alpha, digit, alnum or mixed. Empty strings fit any class; no values are mixed."""
    fits = lambda pattern, drop: F.bool_and((value == "") | F.regexp_replace(value, drop, "").rlike(pattern))
    return F.when(F.count(value) == 0, "mixed").when(fits(r"^\p{L}+$", "[ -]"), "alpha").when(fits(r"^\p{Nd}+$", "[^\\s\\S]"), "digit").when(fits(r"^[\p{L}\p{Nd}]+$", " "), "alnum").otherwise("mixed")


def canonical(c: Column, kind: str) -> Column:
    """A cell as text that doesn't depend on the engine.

    Doubles have six decimals if that says all; others (beyond 1e12, or with more decimals) keep the
    shortest text that gives the number again, so different doubles have different texts. NaN is the
    null token it spells; infinities are values.
    """
    if kind in ("double", "float"):
        short = (F.abs(c) < 1e12) & (F.round(c, 6) == c)
        return F.when(short, F.when(short, c).cast("decimal(18,6)").cast("string")).otherwise(c.cast("string"))
    if kind.startswith("timestamp"):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return c.cast("string")
