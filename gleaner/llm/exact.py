"""Exact dedup: a stateful stream keeps a disk-backed row for each digest; hits are checked byte for byte."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import SPACE, first_of, join_weighted, staged, work_dir

#: Session settings of the stream: state in RocksDB on the executors' disks, changes logged to the shared folder.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
}
#: Files of light rows (digests) that a micro-batch reads.
FILES = 1024


def normalised(text: str | Column) -> Column:
    """Null as empty, each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _has_places(docs: DataFrame) -> bool:
    """Whether ``docs`` is a plain scan of files whose format numbers its rows (Parquet does, text formats do not)."""
    if "_metadata" in docs.columns or docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return False
    try:
        return len(docs.select("_metadata.file_path", "_metadata.row_index").columns) == 2
    except AnalysisException:
        return False


def located(docs: DataFrame, path: str) -> DataFrame:
    """(doc, file, at): every row of ``docs`` as a struct, with the file that holds it and its place there.

    Where ``docs`` is not a plain scan of files with places, it is written under ``path`` once and read from there.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")
    if not _has_places(docs):
        return staged(docs.select(doc), path).select("doc", *place)
    return docs.select(doc, *place)


def absorb(spark: SparkSession, path: str, schema, state: str, files: int = FILES) -> DataFrame:
    """Stream the rows under ``path`` that the state does not know yet into it, and return the whole state.

    Rows hold digest, doc_id and row; a micro-batch reads ``files`` files.  The state never expires and holds, per
    digest, the first identifier, the row that locates its content, and the number of rows.  A second call, after more
    files came or after a failure, goes on from the first one's checkpoint.
    """
    old = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        seen = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).groupBy("digest").agg(first_of("doc_id", "row").alias("first"), F.count("*").alias("n"))
        seen.writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        kept = spark.read.format("statestore").load(state)
        first, n = kept.schema["value"].dataType.names[:2]
        flat = kept.select("key.digest", F.col(f"value.{first}").alias("first"), F.col(f"value.{n}").alias("n"))
        return staged(flat.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "n"), f"{state}-rows")
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _dedup(source: DataFrame, work: str, digest=sha256, files: int = FILES) -> DataFrame:
    """``exact_dedup`` of (doc, file, at), with the locators."""
    spark = source.sparkSession
    rows = source.select("doc.doc_id", digest(normalised("doc.text")).alias("digest"), "file", "at", F.monotonically_increasing_id().alias("row"))
    rows = staged(rows, f"{work}/rows")
    total = rows.count()
    if not total:
        return rows.select("row", "doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), "file", "at")
    state = absorb(spark, f"{work}/rows", rows.schema, f"{work}/state", files)
    # the bytes of every hit, by its locator
    hits = join_weighted(rows, state.where("n > 1").select("digest", "n"), ["digest"], "n", total, "left_semi")
    texts = source.select("file", "at", normalised("doc.text").alias("norm")).hint("merge").join(hits, ["file", "at"])
    clash = staged(texts.groupBy("digest", "norm").count().groupBy("digest").count().where("count > 1").select("digest"), f"{work}/clashes")
    out = join_weighted(rows, state, ["digest"], "n", total).select("row", "doc_id", "digest", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), "file", "at")
    if clash.isEmpty():
        return out
    again = staged(texts.join(clash, "digest", "left_semi"), f"{work}/again")
    groups = staged(again.groupBy("digest", "norm").agg(first_of("doc_id", "row").alias("first"), F.count("*").alias("n")), f"{work}/groups")
    split = join_weighted(again, groups, ["digest", "norm"], "n", total)
    split = split.select("row", "doc_id", "digest", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("first.row")).alias("kept"), "file", "at")
    return out.join(clash, "digest", "left_anti").select(split.columns).unionByName(split)


def exact_dedup(docs: DataFrame, digest=sha256, files: int = FILES) -> DataFrame:
    """(row, doc_id, digest, keep_id, group_size, kept, file, at) for every row of ``docs`` (doc_id, text; others are ignored).

    Texts are equal when their normalised bytes are: the stream's state finds rows of equal digest, and the texts of
    every digest that came twice, fetched by file and place, are then grouped by their full bytes.  A digest that turns
    out to stand for several texts is divided by text.  ``digest`` maps the normalised text to a binary column (tests
    use a weak one).

    Null and empty texts are equal to each other; a null doc_id sorts last; of rows that agree in doc_id and text one
    stays; an empty table gives no rows.
    """
    work = work_dir(docs.sparkSession, "exact")
    return _dedup(located(docs, f"{work}/docs"), work, digest, files)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns, whatever their names.

    Rows are told apart by their place: of repeated rows one stays, and a null or repeated doc_id takes no other text with
    it.  Null and empty texts are copies of each other.  An empty table gives no rows.
    """
    work = work_dir(docs.sparkSession, "exact")
    source = located(docs, f"{work}/docs")
    gone = staged(_dedup(source, work).where("not kept").select("file", "at"), f"{work}/gone")
    return source.join(gone, ["file", "at"], "left_anti").select("doc.*")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op5: one row for each row of ``documents``, as ``exact_dedup`` says."""
    found = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from t group by text_sha256)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, t.text_sha256 from t join g using (text_sha256)
"""
