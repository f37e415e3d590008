"""Equal-width and categorical bins, and counts of items and errors in one or two dimensions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import number, text
from gleaner.operators.detectors import majority, profile, strings
from gleaner.sources import ID

NULL = "null"


def column_kinds(df: DataFrame, columns: list[str], stats: dict[str, dict] | None = None) -> dict[str, str]:
    """numeric or categorical; a column without cells is categorical."""
    stats = stats or profile(df, columns)
    major = majority(df, columns, stats)
    return {c: "categorical" if not stats[c]["cells"] else ("numeric" if major[c] == "numeric" else "categorical") if c in strings(df, columns) else "numeric" if stats[c]["numbers"] else "categorical" for c in columns}


def edges(low: float, high: float, n: int) -> list[float]:
    """n + 1 edges; the span of a constant column is widened by a thousandth of its value to either side."""
    if low == high:
        wide = 0.001 * abs(low) or 0.001
        low, high = low - wide, high + wide
    return [low + i * (high - low) / n for i in range(n + 1)]


@dataclass(frozen=True)
class Axis:
    """A column cut into bins: ``code`` numbers a row's bin (null: none); ``labels`` (code, label, x0, x1) are all bins."""

    code: Column
    labels: DataFrame
    kind: str


def axis(df: DataFrame, column: str, n: int = 10) -> Axis:
    """Numeric: n right-closed bins from least to greatest cell; categorical: a bin a value, in order of first ID; a column
    without cells: one bin that holds every row."""
    spark, stats = df.sparkSession, profile(df, [column])
    kind, s = column_kinds(df, [column], stats)[column], stats[column]
    schema = "code long, label string, x0 double, x1 double"
    if not s["cells"]:
        return Axis(F.lit(0).cast("long"), spark.createDataFrame([(0, NULL, None, None)], schema), "categorical")
    if kind == "numeric":
        e, v = edges(s["min"], s["max"], n), number(df, column)
        code = sum((F.when(v > F.lit(x), 1).otherwise(0) for x in e[1:-1]), F.lit(0)).cast("long")
        rows = [(i, None, e[i] if i or s["min"] == s["max"] else e[0] - 0.001 * (e[-1] - e[0]), e[i + 1]) for i in range(n)]
        return Axis(F.when(v.isNotNull(), code), spark.createDataFrame(rows, schema), kind)
    value = text(df, column)
    found = df.where(value.isNotNull()).groupBy(value.alias("label")).agg(F.min(ID).alias("first"))
    labels = found.select(F.xxhash64("label").alias("code"), "label", F.lit(None).cast("double").alias("x0"), F.lit(None).cast("double").alias("x1"), "first")
    return Axis(F.when(value.isNotNull(), F.xxhash64(value)), labels, kind)


def scale(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Numeric: (x0, x1) of each bin, rounded to 3 digits and cut to whole numbers; categorical: (label) by first ID."""
    a = axis(df, column, n)
    if a.kind == "numeric":
        return a.labels.select("code", F.round("x0", 3).cast("long").alias("x0"), F.round("x1", 3).cast("long").alias("x1"))
    return a.labels.select("label")


def binned(df: DataFrame, x: str, y: str | None = None, n: int = 10, m: int = 10) -> tuple[DataFrame, list[Axis]]:
    """(ID, x_bin, y_bin) of the rows that have a bin in every dimension."""
    axes = [axis(df, x, n)] + ([axis(df, y, m)] if y else [])
    codes = [a.code.alias(k) for a, k in zip(axes, ("x_bin", "y_bin"), strict=False)]
    return df.select(ID, *codes).where(" and ".join(f"{k} is not null" for k in ("x_bin", "y_bin")[: len(axes)])), axes


def _grid(axes: list[Axis]) -> DataFrame:
    out = None
    for a, k in zip(axes, ("x", "y"), strict=False):
        one = a.labels.select(F.col("code").alias(f"{k}_bin"), F.col("label").alias(k))
        # every bin by every bin is the result's own size; only the bins of a number, which are few, are broadcast
        out = one if out is None else out.crossJoin(F.broadcast(one) if a.kind == "numeric" else one) if axes[0].kind != "numeric" else F.broadcast(out).crossJoin(one)
    return out


def histogram(df: DataFrame, errors: DataFrame, x: str, y: str | None = None, n: int = 10, m: int = 10) -> DataFrame:
    """(x_bin, x, [y_bin, y,] items, errors): every bin, empty ones too.

    ``errors`` maps an error type to the error rows of the columns shown, in rows of the bin; a row with two errors counts twice.
    Numeric bins have a number, categorical ones their value in x or y.
    """
    rows, axes = binned(df, x, y, n, m)
    keys = ["x_bin", "y_bin"][: len(axes)]
    items = rows.groupBy(*keys).agg(F.count("*").alias("items"))
    bad = _error_counts(errors, [c for c in (x, y) if c], rows, keys)
    none = F.expr("cast(map() as map<string, bigint>)")
    return _grid(axes).join(items, keys, "left").join(bad, keys, "left").withColumns({"items": F.coalesce("items", F.lit(0)), "errors": F.coalesce("errors", none)})


def _error_counts(errors: DataFrame, columns: list[str], rows: DataFrame, keys: list[str]) -> DataFrame:
    own = errors.where(F.col("column_id").isin(columns)).select(F.col("row_id").alias(ID), "error_type")
    bad = own.join(rows, ID).groupBy(*keys, "error_type").agg(F.count("*").alias("n"))
    return bad.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("error_type", "n")))).alias("errors"))


def histogram_errors(hist: DataFrame) -> DataFrame:
    """The error counts of a histogram in long form: its bins, error_type, n."""
    bins = [c for c in hist.columns if c not in ("items", "errors")]
    return hist.select(*bins, F.explode("errors").alias("error_type", "n"))


def bar_segments(hist: DataFrame) -> DataFrame:
    """Stacked bars: (bins, segment, bottom, top), errors by name from 0 up, the rest of the items as none if any is left."""
    bins = [c for c in hist.columns if c not in ("items", "errors")]
    counts = F.array_sort(F.map_entries("errors"))
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, e: a + e["value"])
    rest = F.col("items") - total
    all_ = F.concat(F.transform(counts, lambda e: F.struct(e["key"].alias("segment"), e["value"].alias("n"))), F.when(rest > 0, F.array(F.struct(F.lit("none").alias("segment"), rest.alias("n")))).otherwise(F.expr("cast(array() as array<struct<segment:string,n:bigint>>)")))
    rows = hist.select(*bins, all_.alias("all")).select(*bins, "all", F.posexplode("all").alias("i", "s"))
    bottom = F.aggregate(F.slice("all", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda a, e: a + e["n"])
    return rows.select(*bins, F.col("s.segment").alias("segment"), bottom.alias("bottom"), (bottom + F.col("s.n")).alias("top"))


def _mixed(df: DataFrame, column: str, n: int, k: str) -> list[Column]:
    """Of each cell: class, bin if it is a number, text if it is not; null cells have no class."""
    v, s = number(df, column), profile(df, [column])[column]
    e = edges(s["min"], s["max"], n) if s["numbers"] else []
    code = sum((F.when(v > F.lit(x), 1).otherwise(0) for x in e[1:-1]), F.lit(0)).cast("long")
    other = F.col(f"`{column}`").isNotNull()
    return [F.when(v.isNotNull(), "numeric").when(other, "categorical").alias(f"{k}_class"), F.when(v.isNotNull(), code).alias(f"{k}_bin"), F.when(v.isNull(), text(df, column)).alias(k)]


def mixed_histogram(df: DataFrame, column: str, n: int = 10, errors: DataFrame | None = None) -> DataFrame:
    """(class, x_bin, x, items[, errors]): numbers of a column in equal bins, and every other value as a category."""
    rows = df.select(ID, *_mixed(df, column, n, "x")).withColumnRenamed("x_class", "class").where("class is not null")
    return _with_errors(rows, errors, [column], ["class", "x_bin", "x"])


def _with_errors(rows: DataFrame, errors: DataFrame | None, columns: list[str], keys: list[str]) -> DataFrame:
    items = rows.groupBy(*keys).agg(F.count("*").alias("items"))
    if errors is None:
        return items
    bad = _error_counts(errors, columns, rows, keys)
    same = [items[k].eqNullSafe(bad[k]) for k in keys]
    none = F.expr("cast(map() as map<string, bigint>)")
    return items.join(bad, same, "left").select(*(items[k] for k in keys), "items", F.coalesce("errors", none).alias("errors"))


def mixed_histogram_2d(df: DataFrame, x: str, y: str, n: int = 10, m: int = 10, errors: DataFrame | None = None) -> DataFrame:
    """(x_class, x_bin, x, y_class, y_bin, y, items[, errors]) of columns that mix numbers and other values.

    Pairs of bins of numbers are all there, empty ones too; pairs with a category are there where they occur.
    """
    rows = df.select(ID, *_mixed(df, x, n, "x"), *_mixed(df, y, m, "y")).where("x_class is not null and y_class is not null")
    keys = ["x_class", "x_bin", "x", "y_class", "y_bin", "y"]
    found = _with_errors(rows, errors, [x, y], keys)
    spark, number_ = df.sparkSession, F.lit("numeric")
    grid = spark.range(n).select(number_.alias("x_class"), F.col("id").alias("x_bin"), F.lit(None).cast("string").alias("x")).crossJoin(F.broadcast(spark.range(m).select(number_.alias("y_class"), F.col("id").alias("y_bin"), F.lit(None).cast("string").alias("y"))))
    if not profile(df, [x, y])[x]["numbers"] or not profile(df, [y])[y]["numbers"]:
        return found
    empty = grid.join(found.where("x_class = 'numeric' and y_class = 'numeric'").select("x_bin", "y_bin"), ["x_bin", "y_bin"], "left_anti").select(*keys, F.lit(0).cast("long").alias("items"))
    return found.unionByName(empty if errors is None else empty.withColumn("errors", F.expr("cast(map() as map<string, bigint>)")))


def crosstab(df: DataFrame, a: str, g: str) -> DataFrame:
    """(a, g, n): rows of each pair of values that occurs."""
    return df.where(F.col(a).isNotNull() & F.col(g).isNotNull()).groupBy(F.col(a).alias("a"), F.col(g).alias("g")).agg(F.count(ID).alias("n"))


def crosstab_wide(df: DataFrame, a: str, g: str, values: list | None = None) -> DataFrame:
    """One column for each value of g; pairs that do not occur are null."""
    return df.groupBy(a).pivot(g, values).agg(F.count(ID))


def crosstab_bins(df: DataFrame, x: str, y: str, n: int, m: int) -> DataFrame:
    """(x_bin, y_bin, n) over all pairs of bins in which either axis has rows."""
    rows, axes = binned(df, x, y, n, m)
    counts = rows.groupBy("x_bin", "y_bin").agg(F.count("*").alias("n"))
    return _grid(axes).join(counts, ["x_bin", "y_bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rows_of_bins(df: DataFrame, chosen: DataFrame, x: str, y: str | None = None, n: int = 10, m: int = 10) -> DataFrame:
    """The rows in the chosen bins (x_bin[, y_bin])."""
    rows, axes = binned(df, x, y, n, m)
    hit = rows.join(chosen, ["x_bin", "y_bin"][: len(axes)], "left_semi").select(ID)
    return df.join(hit, ID, "left_semi")
