"""Bounded, repeatable scatter samples that show rows with errors first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import number, text
from gleaner.operators.histogram import NULL, column_kinds
from gleaner.sources import ID, kept


def sample(df: DataFrame, errors: DataFrame, x: str, y: str, bad: int = 30, total: int = 100, seed: str = "0") -> DataFrame:
    """(ID, has_error): up to ``bad`` rows with an error in x or y, then others up to ``total``, by md5 of ID and seed."""
    own = kept(errors.where(F.col("column_id").isin(x, y)).select(F.col("row_id").alias(ID)).distinct())  # read twice
    order = [F.md5(F.concat(F.col(ID).cast("string"), F.lit(seed)).cast("binary")), F.col(ID)]
    first = df.select(ID).join(own, ID, "left_semi").orderBy(*order).limit(bad)
    rest = df.select(ID).join(own, ID, "left_anti").orderBy(*order).limit(total)
    taken = first.agg(F.count("*").alias("__n"))
    rest = rest.select(ID, F.md5(F.concat(F.col(ID).cast("string"), F.lit(seed)).cast("binary")).alias("__h"))
    place = F.row_number().over(_by("__h", ID))  # of at most ``total`` rows
    rest = rest.withColumn("__at", place).crossJoin(F.broadcast(taken)).where(F.col("__at") <= F.greatest(F.lit(total) - F.col("__n"), F.lit(0)))
    return first.withColumn("has_error", F.lit(True)).unionByName(rest.select(ID, F.lit(False).alias("has_error")))


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.orderBy(*columns)


def entries(df: DataFrame, errors: DataFrame, x: str, y: str, **limits) -> DataFrame:
    """(ID, xType, yType, x, y, errors) of the sample: values as text, null as the word, all errors of either column."""
    errors, kinds = kept(errors.where(F.col("column_id").isin(x, y))), column_kinds(df, [x, y])
    ids = kept(sample(df, errors, x, y, **limits))  # at most as many rows as the limits say
    own = errors.join(F.broadcast(ids.select(F.col(ID).alias("row_id"))), "row_id", "left_semi")
    lists = own.groupBy(F.col("row_id").alias(ID)).agg(F.array_sort(F.collect_list("error_type")).alias("errors"))
    value = lambda c: F.coalesce(text(df, c), F.lit(NULL))
    rows = df.select(ID, value(x).alias("x"), value(y).alias("y")).join(F.broadcast(ids.select(ID)), ID, "left_semi")
    return rows.join(lists, ID, "left").select(ID, F.lit(kinds[x]).alias("xType"), F.lit(kinds[y]).alias("yType"), "x", "y", F.coalesce("errors", F.expr("cast(array() as array<string>)")).alias("errors"))


def mixed_entries(df: DataFrame, errors: DataFrame, x: str, y: str, **limits) -> DataFrame:
    """``entries`` whose xType and yType are those of the cell: a column may mix numbers and other values."""
    out = entries(df, errors, x, y, **limits)
    kind = lambda c: F.when(number(df, c).isNotNull(), "numeric").otherwise("categorical")
    kinds = df.select(ID, kind(x).alias("xType"), kind(y).alias("yType"))
    return kinds.join(F.broadcast(out.drop("xType", "yType")), ID).select(out.columns)


def scatter_scale(df: DataFrame, column: str) -> DataFrame:
    """Numeric: (low, high), whole numbers, high one above; categorical: (label) sorted, with null's word if there are nulls."""
    if column_kinds(df, [column])[column] == "numeric":
        n = number(df, column)
        return df.agg(F.coalesce(F.min(n).cast("long"), F.lit(0)).alias("low"), F.coalesce(F.max(n).cast("long") + 1, F.lit(1)).alias("high"))
    return df.select(F.coalesce(text(df, column), F.lit(NULL)).alias("label")).distinct()


def brush(df: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float]) -> DataFrame:
    """Rows strictly inside both ranges."""
    a, b = number(df, x), number(df, y)
    return df.where((a > x_range[0]) & (a < x_range[1]) & (b > y_range[0]) & (b < y_range[1]))
