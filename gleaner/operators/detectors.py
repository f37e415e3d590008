"""Cell-level quality rules.  Each gives (row_id, column_id, error_type), one row for each suspect cell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import RESERVED, is_missing, is_numeric_text, number, strip, text
from gleaner.sources import ID

ERRORS = "row_id long, column_id string, error_type string"
#: Readable numbers that the outlier rule needs, and that the rare-value rule tolerates; a value seen less often is rare.
GATE, RARE, SIGMAS, WIDE = 10, 3, 2.0, 200


def value_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ID and c not in RESERVED]


def strings(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]


def flagged(df: DataFrame, rules: dict[str, Column], error: str) -> DataFrame:
    """One scan: a row for each column whose rule holds."""
    if not rules:
        return df.sparkSession.createDataFrame([], ERRORS)
    hits = F.array(*(F.when(rule, F.lit(c)) for c, rule in rules.items()))
    return df.select(F.col(ID).cast("long").alias("row_id"), F.explode(F.array_compact(hits)).alias("column_id")).select("row_id", "column_id", F.lit(error).alias("error_type"))


def flagged_all(df: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """One scan for all rules (column, error, condition): a row for each that holds."""
    if not rules:
        return df.sparkSession.createDataFrame([], ERRORS)
    hits = F.array(*(F.when(rule, F.struct(F.lit(c).alias("column_id"), F.lit(error).alias("error_type"))) for c, error, rule in rules))
    return df.select(F.col(ID).cast("long").alias("row_id"), F.explode(F.array_compact(hits)).alias("e")).select("row_id", "e.column_id", "e.error_type")


def profile(df: DataFrame, columns: list[str] | None = None) -> dict[str, dict]:
    """Of each column: cells, readable numbers, cells of numeric text, mean, deviation, extremes: one scan, one row to the driver."""
    columns, out = value_columns(df) if columns is None else columns, {}
    for lo in range(0, len(columns), WIDE):
        part, aggs = columns[lo : lo + WIDE], []
        for i, c in enumerate(part):
            n = number(df, c)
            numeric = F.sum(F.when(is_numeric_text(text(df, c)), 1).otherwise(0)) if isinstance(df.schema[c].dataType, T.StringType) else F.lit(None)
            stats = {"cells": F.count(f"`{c}`"), "numbers": F.count(n), "numeric": numeric, "mean": F.avg(n), "sd": F.stddev_samp(n), "min": F.min(n), "max": F.max(n)}
            aggs += [a.alias(f"{i}_{k}") for k, a in stats.items()]
        row = df.agg(*aggs).first() if aggs else {}
        for i, c in enumerate(part):
            out[c] = {k: row[f"{i}_{k}"] for k in ("cells", "numbers", "numeric", "mean", "sd", "min", "max")}
    return out


def missing_value(df: DataFrame, columns: list[str] | None = None, client: bool = False) -> DataFrame:
    """Nulls and the words null and undefined, in every column; ``client`` skips the ID and takes blanks and any case."""
    columns = (value_columns(df) if client else df.columns) if columns is None else columns
    return flagged(df, {c: is_missing(df, c, trimmed=client) for c in columns}, "missing")


def _far(df: DataFrame, stats: dict[str, dict]) -> dict[str, Column]:
    return {c: F.abs(number(df, c) - F.lit(s["mean"])) > F.lit(SIGMAS * s["sd"]) for c, s in stats.items() if s["numbers"] >= GATE and s["sd"]}


def anomaly(df: DataFrame, columns: list[str] | None = None, client: bool = False) -> DataFrame:
    """Numbers farther than two sample deviations from the column's mean, where there are ten or more that differ.

    ``client`` looks at numeric columns only, not at text that can be read as numbers.
    """
    columns = value_columns(df) if columns is None else columns
    if client:
        columns = [c for c in columns if c not in strings(df, columns)]
    return flagged(df, _far(df, profile(df, columns)), "anomaly")


def _cells(df: DataFrame, columns: list[str], value: Callable[[str], Column]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(c).alias("column_id"), value(c).alias("value")) for c in columns))
    return df.select(F.col(ID).cast("long").alias("row_id"), F.explode(rows).alias("c")).select("row_id", "c.column_id", "c.value")


def incomplete(df: DataFrame, columns: list[str] | None = None, client: bool = False, stats: dict[str, dict] | None = None) -> DataFrame:
    """Values of text columns that occur less than three times, in columns of at most ten readable numbers.

    A rare value has two rows at most, its least and greatest ID, so no join back is needed.  ``client`` trims values,
    skips blanks and numbers, and has no gate.
    """
    columns = strings(df, value_columns(df) if columns is None else columns)
    if not client:
        stats = stats or profile(df, columns)
        columns = [c for c in columns if stats[c]["numbers"] <= GATE]
    if not columns:
        return flagged(df, {}, "incomplete")
    value = (lambda c: strip(text(df, c))) if client else (lambda c: text(df, c))
    cells = _cells(df, columns, value).where("value is not null")
    if client:
        cells = cells.where((F.col("value") != "") & ~is_numeric_text(F.col("value")))
    rare = cells.groupBy("column_id", "value").agg(F.count("*").alias("n"), F.min("row_id").alias("a"), F.max("row_id").alias("b")).where(F.col("n") < RARE)
    return rare.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("row_id"), "column_id", F.lit("incomplete").alias("error_type"))


def majority(df: DataFrame, columns: list[str], stats: dict[str, dict] | None = None) -> dict[str, str]:
    """numeric or str: the class of most cells; of equally many, the one with the more frequent value, then numeric."""
    stats, out, ties = stats or profile(df, strings(df, columns)), {}, []
    for c in strings(df, columns):
        a, b = stats[c]["numeric"] or 0, stats[c]["cells"] - (stats[c]["numeric"] or 0)
        out[c] = "numeric" if a > b else "str"
        if a == b and a:
            ties.append(c)
    if ties:
        cells = _cells(df, ties, lambda c: text(df, c)).where("value is not null")
        top = cells.groupBy("column_id", "value").count().groupBy("column_id").agg(*(F.max(F.when(is_numeric_text(F.col("value")) == F.lit(k), F.col("count"))).alias(n) for k, n in ((True, "a"), (False, "b"))))
        out |= {r["column_id"]: "numeric" if r["a"] >= r["b"] else "str" for r in top.collect()}  # a row a column
    return out


def _other_class(df: DataFrame, major: dict[str, str]) -> dict[str, Column]:
    return {c: is_numeric_text(text(df, c)) != F.lit(k == "numeric") for c, k in major.items()}


def datatype_mismatch(df: DataFrame, columns: list[str] | None = None, client: bool = False) -> DataFrame:
    """Cells of text columns that are not of the majority's class; nulls are neutral, typed columns have one class.

    ``client`` flags numeric text wherever the column is not numeric.
    """
    columns = value_columns(df) if columns is None else columns
    if client:
        return flagged(df, {c: is_numeric_text(text(df, c)) for c in strings(df, columns)}, "mismatch")
    return flagged(df, _other_class(df, majority(df, columns)), "mismatch")


DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {"anomaly": anomaly, "incomplete": incomplete, "missing": missing_value, "mismatch": datatype_mismatch}


def register_detector(name: str, rule: Callable[[DataFrame], DataFrame]) -> None:
    """``rule`` maps a table with ID to (row_id, column_id, error_type)."""
    DETECTORS[name] = rule


_BUILT_IN = dict(DETECTORS)


def run_detectors(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The errors of all (or the named) registered rules; those of the ID and of reserved columns are left out.

    The rules that come with the engine share one profile and, but for rare values, one scan.
    """
    names = names or list(DETECTORS)
    own = [n for n in names if DETECTORS[n] is _BUILT_IN.get(n)]
    out, columns = None, value_columns(df)
    if own:
        stats, rules = (profile(df, columns) if set(own) - {"missing"} else {}), []
        if "missing" in own:
            rules += [(c, "missing", is_missing(df, c)) for c in columns]
        if "anomaly" in own:
            rules += [(c, "anomaly", rule) for c, rule in _far(df, stats).items()]
        if "mismatch" in own:
            rules += [(c, "mismatch", rule) for c, rule in _other_class(df, majority(df, columns, stats)).items()]
        out = flagged_all(df, rules)
        if "incomplete" in own:
            out = out.unionByName(incomplete(df, columns, stats=stats))
    for name in [n for n in names if n not in own]:
        found = DETECTORS[name](df).where(~F.col("column_id").isin(ID, *RESERVED)).select("row_id", "column_id", "error_type")
        out = found if out is None else out.unionByName(found)
    return out


def error_dict(errors: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
    """(column_id, row_id, errors sorted), every error once for each time it was found."""
    rows = errors.where(F.col("row_id") >= first) if last is None else errors.where(F.col("row_id").between(first, last))
    return rows.groupBy("column_id", "row_id").agg(F.array_sort(F.collect_list("error_type")).alias("errors"))


def errors_of(errors: DataFrame, columns: list[str]) -> DataFrame:
    return errors.where(F.col("column_id").isin(columns))
