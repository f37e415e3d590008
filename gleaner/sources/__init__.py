"""Tables in and out, row identity, ranges and samples."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import NUMBERS, RESERVED, nan_to_null, number

ID = "ID"
_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; where that is unset and Spark runs in this process alone (tests),
    under a folder of the process.  On a cluster the setting is needed: executors would write to disks of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="gleaner-"))
        base = _local[0]
    return f"{base.rstrip('/')}/gleaner/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df``, written once to the shared folder, for results that are read several times."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_name(file_name: str) -> str:
    base = re.sub("[^a-zA-Z0-9_]", "_", file_name.removesuffix(".csv"))
    return (base if re.match("[a-zA-Z]", base) else f"table{base}").lower()


def _doc(df: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def in_file_order(df: DataFrame) -> list[Column]:
    """What sorts the rows as they lie: file, block of the file and place in it, if ``df`` is a scan of files; else the
    order in which Spark makes them."""
    place = F.monotonically_increasing_id()
    if "_metadata" not in df.columns:
        try:
            here = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), place]
            df.select(*here)
            return here
        except AnalysisException:
            pass
    return [place]


def numbered(df: DataFrame, order_by: list[str] | None = None, name: str = ID) -> DataFrame:
    """Numbers 1..n in the order of ``order_by`` (else as the rows lie), first column; columns may have any names.

    Rows are dealt by range and written once; each range then knows how many come before it, so no task sees all.
    """
    spark = df.sparkSession
    order = [F.col(f"`{c}`") for c in order_by] if order_by else in_file_order(df)
    keys = [f"k{i}" for i in range(len(order))]
    dealt = df.select(_doc(df).alias("doc"), *(c.alias(k) for c, k in zip(order, keys, strict=True)))
    dealt = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc", F.monotonically_increasing_id().alias("at"))
    rows = kept(dealt)
    part = F.shiftrightunsigned("at", 33)
    before, total = [], 0
    for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # a row a range
        before.append((r["part"], total))
        total += r["n"]
    offsets = F.broadcast(spark.createDataFrame(before, "part long, before long"))
    out = rows.withColumn("part", part).join(offsets, "part")
    here = F.col("at") - F.shiftleft(F.col("part"), 33)
    return out.select((F.col("before") + here + 1).alias(name), "doc.*")


def with_id(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """A valid ID column comes first; an invalid one (not numeric or not unique) becomes Original_ID and rows are numbered,
    in the order of ``order_by`` or else as they lie in their files."""
    if ID in df.columns:
        n = number(df, ID)
        if isinstance(df.schema[ID].dataType, NUMBERS):
            bad = df.where(n.isNull()).isEmpty() is False
        else:
            bad = not df.where(n.isNull()).isEmpty()
        if not bad and df.groupBy(ID).count().where("count > 1").isEmpty():
            return df.select(ID, *(f"`{c}`" for c in df.columns if c != ID))
        df = df.withColumnRenamed(ID, "Original_ID")
        order_by = [("Original_ID" if c == ID else c) for c in order_by] if order_by else None
    return numbered(df, order_by)


def read_csv(spark: SparkSession, path: str, typed: bool = False, **options) -> DataFrame:
    """CSV with a header; cells are text, or of the kind that all cells of a column can be read as (``typed``: one more
    scan); empty ones are null."""
    df = spark.read.options(header=True, inferSchema=typed, **options).csv(path)
    if typed:  # numbers and booleans have types, dates stay text
        kinds = [T.StructField(f.name, T.StringType() if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else f.dataType) for f in df.schema.fields]
        df = spark.read.options(header=True, **options).schema(T.StructType(kinds)).csv(path)
    if clash := [c for c in df.columns if c in RESERVED]:
        raise ValueError(f"reserved column names: {clash}")
    return nan_to_null(df)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def save(df: DataFrame, errors: DataFrame, name: str, folder: str) -> None:
    """A table and its error relation side by side; no index column is added."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    errors.write.mode("overwrite").parquet(f"{folder}/errors{name}")


def load(spark: SparkSession, name: str, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/{name}"), spark.read.parquet(f"{folder}/errors{name}")


def ingest(spark: SparkSession, path: str, folder: str, order_by: list[str] | None = None, typed: bool = True) -> str:
    """Read, number as the rows lie (or by ``order_by``), detect and save; returns the table's name."""
    from gleaner.operators.detectors import run_detectors

    df = with_id(read_csv(spark, path, typed), order_by)
    name = table_name(path.rstrip("/").rpartition("/")[2])
    save(df, run_detectors(df), name, folder)
    return name


def id_range(df: DataFrame, low: int, high: int, column: str = ID) -> DataFrame:
    return df.where(F.col(column).between(low, high))


def slice_both(df: DataFrame, errors: DataFrame, low: int, high: int) -> tuple[DataFrame, DataFrame]:
    return id_range(df, low, high), id_range(errors, low, high, "row_id")


def head(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(ID).limit(n)
