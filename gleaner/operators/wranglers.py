"""Repairs.  Each maps a table and chosen IDs to a new table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import NUMBERS, half_even, number, to_fixed
from gleaner.sources import ID

Chosen = list | DataFrame


def _ids(df: DataFrame, chosen: Chosen) -> DataFrame:
    if isinstance(chosen, DataFrame):
        return chosen.select(F.col(chosen.columns[0]).cast("long").alias("__id")).distinct()
    return F.broadcast(df.sparkSession.createDataFrame([(int(i),) for i in set(chosen)], "__id long"))


def remove_rows(df: DataFrame, chosen: Chosen) -> DataFrame:
    """Without the chosen rows; unknown IDs do nothing."""
    ids = _ids(df, chosen)
    return df.join(ids, df[ID] == ids["__id"], "left_anti")


def average(df: DataFrame, column: str) -> DataFrame:
    """One row (value): the mean of a numeric column's positive cells to one decimal, 0 without any; else the mode."""
    kind = df.schema[column].dataType
    if isinstance(kind, (*NUMBERS, T.BooleanType)):
        n = number(df, column)
        return df.agg(F.coalesce(half_even(F.avg(F.when(n > 0, n))), F.lit(0.0)).alias("value"))
    c = F.col(f"`{column}`")
    counts = df.where(c.isNotNull()).groupBy(c.alias("value")).agg(F.count("*").alias("n"), F.min(ID).alias("first"))
    top = counts.agg(F.max_by("value", F.struct("n", -F.col("first"))).alias("value"))
    return top


def client_average(df: DataFrame, column: str) -> DataFrame:
    """One row (value): as ``average``, but to one decimal by the binary value, and of equally frequent values the last.

    Values come whole numbers first, by size, then the others by first ID.
    """
    if isinstance(df.schema[column].dataType, (*NUMBERS, T.BooleanType)):
        n = number(df, column)
        return df.agg(F.coalesce(to_fixed(F.avg(F.when(n > 0, n))), F.lit(0.0)).alias("value"))
    c = F.col(f"`{column}`")
    counts = df.where(c.isNotNull()).groupBy(c.alias("value")).agg(F.count("*").alias("n"), F.min(ID).alias("first"))
    whole = F.when(F.col("value").cast("string").rlike("^(0|[1-9][0-9]{0,9})$"), F.col("value").cast("string").try_cast("long"))
    return counts.agg(F.max_by("value", F.struct("n", whole.isNull(), whole, "first")).alias("value"))


def impute(df: DataFrame, column: str, chosen: Chosen, client: bool = False) -> DataFrame:
    """The column's average in the chosen rows, whatever they held; no average (only nulls) changes nothing."""
    ids, kind = _ids(df, chosen), df.schema[column].dataType
    value = F.broadcast((client_average if client else average)(df, column).withColumnRenamed("value", "__value"))
    whole = isinstance(kind, NUMBERS) and not isinstance(kind, (T.FloatType, T.DoubleType))
    c = F.col(f"`{column}`")
    if whole or isinstance(kind, T.BooleanType):
        c = number(df, column)
    new = F.when(F.col("__id").isNotNull() & F.col("__value").isNotNull(), F.col("__value")).otherwise(c).alias(column)
    out = df.join(ids, df[ID] == F.col("__id"), "left").crossJoin(value)  # the value is one row
    return out.select(*(new if x == column else F.col(f"`{x}`") for x in df.columns))


WRANGLERS: dict[str, Callable[..., DataFrame]] = {"remove": remove_rows, "impute": lambda df, ids, column, client=False: impute(df, column, ids, client)}


def register_wrangler(name: str, repair: Callable[..., DataFrame]) -> None:
    """``repair`` maps (table, ids, **options) to a table."""
    WRANGLERS[name] = repair
