"""Folders shared by the cluster, staged tables, row numbers and joins that survive hot keys."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words as every operator of this subpackage understands them.
SPACE, WORD = "[\\x20\\x09-\\x0D]+", "[^\\x20\\x09-\\x0D]+"

#: Tasks of a stage whose number follows the data.
MOST_TASKS = 100_000

_made: list[str] = []
_own: list[str] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; where that is unset and Spark runs in this process alone (tests),
    under a folder of the process.  On a cluster the setting is needed: executors would write to disks of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="gleaner-"))
        base = _own[0]
    _made.append(f"{base.rstrip('/')}/gleaner/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clean_up(spark: SparkSession) -> None:
    """Delete every folder that ``work_dir`` has given out; results that still read them must be written before."""
    while _made:
        discard(spark, _made.pop())


def staged(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: the lineage is cut and a lost executor costs nothing.

    The driver's garbage is collected then, so that Spark's cleaner removes the shuffle files that led to the table.
    """
    df.write.options(**options).mode("overwrite").parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return a Python worker's free memory to the system: Spark keeps its workers, and the next stage needs the room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``rows``, so that a worker holds few texts as Python objects at once."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def numbered(docs: DataFrame, columns: list[str], path: str, key: str = "doc_id") -> DataFrame:
    """``columns`` of ``docs`` and a unique long ``row``.

    Where ``key`` is unique and never null it is the row number itself and nothing is copied; else the columns are
    written once with numbers, so that later scans agree on them.
    """
    df = docs.select(*columns)
    if dict(docs.dtypes)[key] in ("bigint", "int", "smallint", "tinyint"):
        odd = df.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull())
        if odd.isEmpty():
            return df.withColumn("row", F.col(key).cast("long"))
    return staged(df.withColumn("row", F.monotonically_increasing_id()), path)


def join_weighted(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner", parts: int = 1000) -> DataFrame:
    """Join ``rows`` to ``groups`` (one row per key, ``weight`` = rows that have the key) without a hot task.

    At most ``parts`` keys can hold ``total / parts`` rows each: those are broadcast, the rest is shuffled at every
    size.  ``groups`` should be a staged table, since it is read twice.  ``how`` is inner, left or left_semi.
    """
    least = max(2, total // parts)
    heavy = F.broadcast(groups.where(F.col(weight) >= least))
    light = groups.where(F.col(weight) < least)
    return rows.join(heavy, keys, "left_semi" if how == "left_semi" else "inner").unionByName(rows.join(heavy.select(*keys), keys, "left_anti").join(light.hint("merge"), keys, how))


def first_of(*cols: str | Column) -> Column:
    """The least row by the first column (nulls last), then by the others; for use as an aggregate."""
    c = F.col(cols[0]) if isinstance(cols[0], str) else cols[0]
    return F.min(F.struct(c.isNull().alias("none"), *cols))
