"""Column expressions for cells of unknown cleanliness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A cell's text is of class numeric if it is an unsigned decimal; it can be read as a number in more forms.
NUMERIC_TEXT = "^[0-9]+([.][0-9]+)?$"
READABLE = "^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$"
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
#: Column names that error relations use themselves.
RESERVED = ("column_id", "error_type", "row_id", "Unnamed: 0")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def is_numeric_text(text: Column) -> Column:
    return strip(text).rlike(NUMERIC_TEXT)


def kind_of(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def number(df: DataFrame, column: str) -> Column:
    """The cell as a double; null where it cannot be read as one.  NaN is null; booleans are 0 and 1."""
    c, kind = F.col(f"`{column}`"), kind_of(df, column)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c.cast("double"))
    if isinstance(kind, NUMBERS):
        return c.cast("double")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(kind, T.StringType):
        return F.when(c.rlike(READABLE), c.try_cast("double"))
    return F.lit(None).cast("double")


def text(df: DataFrame, column: str) -> Column:
    return F.col(f"`{column}`").cast("string")


def is_missing(df: DataFrame, column: str, trimmed: bool = False) -> Column:
    """Null, NaN, or the word null or undefined; ``trimmed`` also takes blanks, outer space and any case."""
    c, kind = F.col(f"`{column}`"), kind_of(df, column)
    out = c.isNull()
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return out | F.isnan(c)
    if isinstance(kind, T.StringType):
        cell = F.lower(strip(c)) if trimmed else c
        return out | cell.isin("null", "undefined", *([""] if trimmed else []))
    return out


def half_even(x: Column, digits: int = 1) -> Column:
    return F.rint(x * 10**digits) / 10**digits


def to_fixed(x: Column) -> Column:
    """One decimal, by the exact binary value; exact ties go up, as a browser writes them."""
    tie = (x * 4 == F.floor(x * 4)) & (F.pmod(x * 4, F.lit(2.0)) == 1)
    return F.when(tie, F.floor(x * 10 + 0.5) / 10).otherwise(F.call_function("format_number", x, F.lit("0.0")).try_cast("double"))


def shortened(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def clean_name(name: Column) -> Column:
    """A table name: without .csv, other characters than letters, digits and _ as _, begun by a letter, lower case."""
    base = F.regexp_replace(F.regexp_replace(name, "\\.csv$", ""), "[^a-zA-Z0-9_]", "_")
    return F.lower(F.when(base.rlike("^[a-zA-Z]"), base).otherwise(F.concat(F.lit("table"), base)))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing here; done once, at the source."""
    return df.select(*(F.when(~F.isnan(f"`{f.name}`"), F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f"`{f.name}`") for f in df.schema.fields))
