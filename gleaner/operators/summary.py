"""What is wrong and what is where: error shares, attribute statistics, rankings, boxes, dirty rows, predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import number, text
from gleaner.operators.detectors import profile, value_columns
from gleaner.operators.histogram import column_kinds
from gleaner.sources import ID, kept, numbered

#: Which error a cell shows that has several.
PRIORITY = ("anomaly", "mismatch", "missing", "incomplete")


def error_distribution(errors: DataFrame, df: DataFrame) -> DataFrame:
    """(error_type, column_id, fraction): errors of a column by type for each row of the table; only those that occur."""
    n = F.broadcast(df.agg(F.count(ID).alias("__n")))
    counts = errors.groupBy("error_type", F.trim("column_id").alias("column_id")).agg(F.count("*").alias("c"))
    return counts.crossJoin(n).select("error_type", "column_id", (F.col("c") / F.col("__n")).alias("fraction"))


def error_distribution_wide(errors: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each error type, a column for each of ``columns``; 0 where none occurs."""
    long = error_distribution(errors, df)
    return long.groupBy("error_type").pivot("column_id", columns).agg(F.first("fraction")).na.fill(0.0)


def error_maps(errors: DataFrame, df: DataFrame) -> DataFrame:
    """(column_id, errors: map of type to fraction) of the columns that have any."""
    return error_distribution(errors, df).groupBy("column_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("error_type", "fraction")))).alias("errors"))


def numeric_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_id, mean, min, max) over the readable numbers; one scan."""
    stats = profile(df, columns)
    return df.sparkSession.createDataFrame([(c, stats[c]["mean"], stats[c]["min"], stats[c]["max"]) for c in columns], "column_id string, mean double, min double, max double")


def categorical_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_id, distinct_values, mode): null is the value N/A; of equally frequent values the least."""
    cells = F.array(*(F.struct(F.lit(c).alias("column_id"), F.coalesce(text(df, c), F.lit("N/A")).alias("value")) for c in columns))
    counts = df.select(F.explode(cells).alias("c")).groupBy("c.column_id", "c.value").agg(F.count("*").alias("n"))
    best = counts.groupBy("column_id").agg(F.count("*").alias("distinct_values"), F.max("n").alias("n"))
    return counts.join(F.broadcast(best), ["column_id", "n"]).groupBy("column_id").agg(F.first("distinct_values").alias("distinct_values"), F.min("value").alias("mode"))


def attribute_summary(df: DataFrame, errors: DataFrame) -> dict:
    """attributes, kinds, and three small relations: error maps, numeric and categorical statistics."""
    columns = [ID, *value_columns(df)]
    kinds = column_kinds(df, columns)
    numeric, other = ([c for c in columns if (kinds[c] == "numeric") is k] for k in (True, False))
    return {"attributes": columns, "kinds": kinds, "errors": error_maps(errors, df), "numeric": numeric_stats(df, numeric), "categorical": categorical_stats(df, other) if other else None}


def mixed_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: mean, min, max of a column's numbers, and count and mode of its other values."""
    n, t = number(df, column), text(df, column)
    other = df.where(n.isNull() & t.isNotNull()).groupBy(t.alias("value")).agg(F.count("*").alias("c"))
    mode = other.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("others"), F.max_by("value", F.struct("c", "value")).alias("other_mode"))
    return df.agg(F.avg(n).alias("mean"), F.min(n).alias("min"), F.max(n).alias("max")).crossJoin(F.broadcast(mode))


def row_errors(errors: DataFrame) -> DataFrame:
    """(row_id, cells): how many cells of a row have an error."""
    return errors.groupBy("row_id").agg(F.count_distinct("column_id").alias("cells"))


def dirty_rows(df: DataFrame, errors: DataFrame, k: int = 10) -> DataFrame:
    """(ID, cells): the k rows with the most cells in error; clean rows fill up; ties by ID."""
    counts = row_errors(errors).withColumnRenamed("row_id", ID)
    return df.select(ID).join(counts, ID, "left").withColumn("cells", F.coalesce("cells", F.lit(0))).orderBy(F.desc("cells"), ID).limit(k)


def cell_priority(errors: DataFrame) -> DataFrame:
    """(row_id, column_id, error_type): the one error that a cell shows."""
    rank = F.coalesce(*(F.when(F.col("error_type") == t, i) for i, t in enumerate(PRIORITY)), F.lit(len(PRIORITY)))
    return errors.groupBy("row_id", "column_id").agg(F.min_by("error_type", F.struct(rank, "error_type")).alias("error_type"))


def ranking(errors: DataFrame, df: DataFrame, columns: list[str], by: str = "total") -> DataFrame:
    """(column_id, total, share, rank): by total error share, by that of one type and then total, or ``none``: cleanest first."""
    shares = error_distribution(errors, df)
    all_ = F.broadcast(df.sparkSession.createDataFrame([(c,) for c in columns], "column_id string"))
    own = F.sum(F.when(F.col("error_type") == by, F.col("fraction")).otherwise(0.0)).alias("share")
    out = all_.join(shares, "column_id", "left").groupBy("column_id").agg(F.coalesce(F.sum("fraction"), F.lit(0.0)).alias("total"), F.coalesce(own, F.lit(0.0)).alias("share"))
    order = {"total": [F.desc("total")], "none": [F.asc("total")]}.get(by, [F.desc("share"), F.desc("total")])
    return out.withColumn("rank", F.row_number().over(Window.orderBy(*order, "column_id")))  # a row a column


def default_attributes(errors: DataFrame, df: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    return ranking(errors, df, columns).where(F.col("rank") <= k).select("column_id")


def category_order(df: DataFrame, column: str) -> DataFrame:
    """(value, place): Low, Medium, High as such; else by leading whole number, values without one last, then by value."""
    t = text(df, column)
    values = df.where(t.isNotNull()).select(t.alias("value")).distinct()
    special = F.array_position(F.array(F.lit("Low"), F.lit("Medium"), F.lit("High")), F.col("value"))
    lead = F.regexp_extract("value", "^([0-9]+)", 1).try_cast("long")
    only = bool(values.agg(F.min(F.coalesce(special, F.lit(0)))).first()[0])
    keys = values.select("value", (special if only else F.lit(0)).alias("a"), lead.isNull().alias("b"), lead.alias("c"))
    return numbered(keys, ["a", "b", "c", "value"], "place").select("value", "place")


def quantiles(df: DataFrame, value: Column, shares: dict[str, float], group: Column | None = None) -> DataFrame:
    """(group, one column for each of ``shares``): exact interpolated quantiles of each group's values.

    Values are counted, dealt by range and summed before each range, so no task holds a group and no buffer its values.
    """
    counts = df.select(F.lit(0).alias("group") if group is None else group.alias("group"), value.alias("v")).where("v is not null").groupBy("group", "v").agg(F.count("*").alias("n"))
    rows = kept(counts.repartitionByRange("group", "v").withColumn("part", F.spark_partition_id()))
    sums = rows.groupBy("group", "part").agg(F.sum("n").alias("s"))
    parts = Window.partitionBy("group").orderBy("part")  # a row a range
    sums = sums.select(F.col("group").alias("g"), F.col("part").alias("p"), (F.sum("s").over(parts) - F.col("s")).alias("before"), F.sum("s").over(Window.partitionBy("group")).alias("total"))
    inside = F.sum("n").over(Window.partitionBy("group", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("group").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p"))
    ranked = rows.withColumn("upto", inside).join(F.broadcast(sums) if group is None else sums, same).select("group", "v", "n", "total", (F.col("before") + F.col("upto")).alias("upto"))
    aggs = []
    for name, p in shares.items():
        at = (F.col("total") - 1) * F.lit(p)
        low, high = F.floor(at), F.ceil(at)
        pick = lambda k: F.max(F.when((F.col("upto") > k) & (F.col("upto") - F.col("n") <= k), F.col("v")))
        a, b = pick(low), pick(high)
        aggs.append((a + (b - a) * F.max(at - low)).alias(name))
    return ranked.groupBy("group").agg(*aggs)


def box_overall(df: DataFrame, column: str) -> DataFrame:
    """One row: mean, deviation, median, and the median absolute deviation from the median."""
    n = number(df, column)
    one = df.agg(F.avg(n).alias("mean"), F.stddev_samp(n).alias("stdev"))
    middle = quantiles(df, n, {"median": 0.5}).first()
    m = middle["median"] if middle else None
    mad = quantiles(df, F.abs(n - F.lit(m).cast("double")), {"mad": 0.5}).first()
    return one.select("*", F.lit(m).cast("double").alias("median"), F.lit(mad["mad"] if mad else None).cast("double").alias("mad"))


def box_groups(df: DataFrame, column: str, group: str) -> DataFrame:
    """(group, min, q1, median, q3, max, mean) with exact, interpolated quartiles; a group without numbers has nulls."""
    n = number(df, column)
    rest = df.groupBy(F.col(f"`{group}`").alias("group")).agg(F.min(n).alias("min"), F.max(n).alias("max"), F.avg(n).alias("mean"))
    boxes = quantiles(df, n, {"q1": 0.25, "median": 0.5, "q3": 0.75}, F.col(f"`{group}`")).withColumnRenamed("group", "g")
    return rest.join(boxes, F.col("group").eqNullSafe(F.col("g")), "left").select("group", "min", "q1", "median", "q3", "max", "mean")


def significant_groups(df: DataFrame, column: str, group: str) -> DataFrame:
    """Groups whose median lies beyond twice the median absolute deviation from the overall median."""
    one = box_overall(df, column).select(F.col("median").alias("__median"), "mad")
    out = box_groups(df, column, group).crossJoin(F.broadcast(one)).where(F.abs(F.col("median") - F.col("__median")) > 2 * F.col("mad"))
    return out.select("group", "median")


COMPARE = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b}


def holds(df: DataFrame, column: str, op: str, value) -> Column:
    """A user's predicate; a null cell never holds.  Categorical columns know = and != only."""
    if column_kinds(df, [column])[column] == "numeric":
        return F.coalesce(COMPARE[op](number(df, column), F.lit(float(value))), F.lit(False))
    if op not in ("=", "!="):
        raise ValueError(f"{op} needs a numeric column")
    return F.coalesce(COMPARE[op](text(df, column), F.lit(str(value))), F.lit(False))


def failing(df: DataFrame, column: str, op: str, value) -> DataFrame:
    """The rows in which the predicate does not hold."""
    return df.where(~holds(df, column, op, value))


def group_filter(df: DataFrame, column: str, groups: list) -> DataFrame:
    """The rows of the chosen groups; none chosen means all."""
    return df.where(F.col(column).isin(groups)) if groups else df


def attributes(df: DataFrame, chosen: list[str], group: str | None = None) -> DataFrame:
    return df.select(*dict.fromkeys([ID, *chosen, *([group] if group else [])]))
