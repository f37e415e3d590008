"""Token files: range asymmetric numeral coding with one shared static frequency table.

The format is a table of blocks (Parquet files that Spark's committer writes whole or not at all, on any file system).
A block holds whole documents of one shard in ascending order: ids and lengths of documents, and their tokens in
segments of ``SEGMENT`` tokens.  Each segment is coded alone by ``LANES`` interleaved 64-bit states that share a stream of 32-bit
words, and has a checkpoint (place of its bytes) and a checksum, so that blocks and segments can be decoded in parallel and
from the middle.  ``frequencies`` beside the blocks holds the table, ``shards`` the tokens before each shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import staged, work_dir
from gleaner.llm.tokens import default_path, word_ids

SCALE, LANES, SEGMENT, BLOCK = 20, 256, 65_536, 262_144
_LOW, _WORD = np.uint64(1 << 31), np.uint64(32)


def normalise(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2**scale, at least 1 where counts are; a single symbol leaves one slot to another."""
    counts = np.maximum(counts, 0)
    if not counts.any():
        counts = np.ones_like(counts)
    total, whole = counts.sum(), 1 << scale
    out = np.where(counts > 0, np.maximum(1, counts * whole // total), 0)
    while (off := whole - int(out.sum())) != 0:
        order = np.argsort(-out, kind="stable")[: max(1, min(abs(off), int((out > 1).sum()) or 1))]
        step = -(-abs(off) // len(order))
        move = np.minimum(step, out[order] - 1) if off < 0 else np.full(len(order), step)
        move = np.minimum(move, np.maximum(0, abs(off) - np.concatenate(([0], np.cumsum(move)[:-1]))))
        out[order] += np.sign(off) * move
    return out.astype(np.int64)


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.first = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq)), freq)
        self.fill = int(np.argmax(freq))

    def encode(self, ids: np.ndarray) -> bytes:
        """A segment: number of tokens, crc32 of the tokens as 32-bit ids, number of words, states, words."""
        n, lanes = len(ids), min(LANES, max(1, len(ids)))
        steps = -(-n // lanes)
        rows = np.full(steps * lanes, self.fill, np.int64)
        rows[:n] = ids
        x, words = np.full(lanes, _LOW, np.uint64), []
        f, c = self.freq[rows].reshape(steps, lanes), self.first[rows].reshape(steps, lanes)
        top = f << np.uint64(63 - SCALE)
        for t in range(steps - 1, -1, -1):
            full = x >= top[t]
            if full.any():
                words.append(x[full].astype(np.uint32))
                x = np.where(full, x >> _WORD, x)
            q = x // f[t]
            x = (q << np.uint64(SCALE)) + (x - q * f[t]) + c[t]
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        return struct.pack("<III", n, zlib.crc32(ids.astype("<u4").tobytes()), len(stream)) + x.astype("<u8").tobytes() + stream.astype("<u4").tobytes()

    def decode(self, data: bytes) -> np.ndarray:
        n, crc, count = struct.unpack_from("<III", data)
        lanes = min(LANES, max(1, n))
        x = np.frombuffer(data, "<u8", lanes, 12).astype(np.uint64)
        stream = np.frombuffer(data, "<u4", count, 12 + 8 * lanes).astype(np.uint64)
        steps, at, mask = -(-n // lanes), 0, np.uint64((1 << SCALE) - 1)
        out = np.empty((steps, lanes), np.uint32)
        for t in range(steps):
            slot = x & mask
            s = self.symbol[slot]
            out[t] = s
            x = self.freq[s] * (x >> np.uint64(SCALE)) + slot - self.first[s]
            short = np.flatnonzero(x < _LOW)
            if len(short):
                x[short] = (x[short] << _WORD) | stream[at : at + len(short)]
                at += len(short)
        ids = out.reshape(-1)[:n]
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("a segment's checksum is wrong")
        return ids


SORTED = "shard int, doc_id long, start long, n long, ids binary"
BLOCKS = "shard int, start long, n_docs int, n_tokens long, doc_ids array<long>, lengths array<long>, checkpoints array<long>, payload binary, crc long"


def _tokenise(content: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, at, shard = word_ids(content.value), 0, TaskContext.get().partitionId()
        width = np.dtype(ids.dtype).itemsize
        for b in batches:
            for lo, hi, data, n in ids.parts(b.column(1)):
                coded = np.insert(data, np.cumsum(n), end)
                n = n + 1
                ends = np.cumsum(n)
                places = pa.py_buffer(np.append(0, ends * width).astype(np.int32))
                texts = pa.Array.from_buffers(pa.binary(), hi - lo, [None, places, pa.py_buffer(coded)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, shard, np.int32)), b.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(at + ends - n), pa.array(n), texts], names=["shard", "doc_id", "start", "n", "ids"])
                at += int(ends[-1])

    return run


def _count(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                c = np.bincount(np.frombuffer(x, dtype), minlength=len(total))
                c[: len(total)] += total
                total = c
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["id", "n"])

    return run


def _block(coder: Coder, shard: int, rows: list, dtype: str) -> list:
    ids = np.frombuffer(b"".join(r[3] for r in rows), dtype)
    parts, places = [], [0]
    for i in range(0, len(ids), SEGMENT):
        parts.append(coder.encode(ids[i : i + SEGMENT]))
        places.append(places[-1] + len(parts[-1]))
    payload = b"".join(parts)
    return [shard, rows[0][1], len(rows), len(ids), [r[0] for r in rows], [r[2] for r in rows], places[:-1], payload, zlib.crc32(payload)]


def _encode(freq, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, rows, held, shard, follows = Coder(freq.value), [], 0, None, None
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64()]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(_block(coder, shard, rows, dtype), types, strict=True)], names=names)

        for b in batches:
            for s, doc, start, n, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and (s != shard or start != follows or held + n > BLOCK):
                    yield out()
                    rows, held = [], 0
                rows.append((doc, start, n, ids))
                shard, follows, held = s, start + n, held + n
        if rows:
            yield out()

    return run


def write_token_file(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = 2) -> DataFrame:
    """Encode every whole text of ``docs`` (doc_id, text; others are ignored) under ``path``; returns the blocks table.

    Each text's ids and then ``end`` are written in ascending doc_id order (null first; rows that share a doc_id by
    text).  Null and empty texts hold only the end id; an empty table gives no block.  Texts of any length fit, as a
    document can span segments.  The shared table has at most the tokenizer's vocabulary in rows, which bounds what the
    driver gathers and broadcasts, besides one total for each shard.
    """
    spark = docs.sparkSession
    with open(tokenizer or default_path()) as f:
        content = spark.sparkContext.broadcast(f.read())
    dtype = str(np.dtype(word_ids(content.value).dtype))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    rows = staged(ordered.mapInArrow(_tokenise(content, end), SORTED), f"{path}/sorted", compression="zstd")
    counts = rows.select("ids").mapInArrow(_count(dtype), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    table = np.zeros(max(end + 1, word_ids(content.value).tok.get_vocab_size()), np.int64)
    for r in counts.collect():  # bounded by the vocabulary
        table[r["id"]] = r["n"]
    freq = spark.sparkContext.broadcast(normalise(table))
    spark.createDataFrame([(int(i), int(freq.value[i])) for i in np.flatnonzero(freq.value)], "id long, slots long").coalesce(1).write.mode("overwrite").parquet(f"{path}/frequencies")
    before, at = [], 0
    for r in rows.groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect():  # one row for each shard
        before.append((r["shard"], at))
        at += r["n"]
    spark.createDataFrame(before, "shard int, before long").coalesce(1).write.mode("overwrite").parquet(f"{path}/shards")
    return staged(rows.mapInArrow(_encode(freq, dtype), BLOCKS), f"{path}/blocks", compression="uncompressed")


def _decode(freq, what: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq.value)
        for b in batches:
            for shard, start, docs, lengths, places, payload, crc in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if zlib.crc32(payload) != crc:
                    raise ValueError("a block's checksum is wrong")
                ids = np.concatenate([coder.decode(payload[p:q]) for p, q in zip(places, [*places[1:], len(payload)], strict=True)]) if places else np.zeros(0, np.uint32)
                n = np.array(lengths, np.int64)
                ends = np.cumsum(n)
                if what == "ids":
                    last = pa.array([ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)], pa.list_(pa.int64()))
                else:
                    raw = ids.astype("<u4").tobytes()
                    last = pa.array([zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard, np.int32)), pa.array(docs, pa.int64()), pa.array(start + ends - n), pa.array(n), last], names=["shard", "doc_id", "start", "n_tokens", "last"])

    return run


def read_token_file(spark: SparkSession, path: str, what: str = "ids") -> DataFrame:
    """(doc_id, start, n_tokens, ids array or ids_crc32) from the files under ``path``; checksums are verified."""
    table = spark.read.parquet(f"{path}/frequencies").collect()  # bounded by the vocabulary
    freq = np.zeros(max((r["id"] for r in table), default=0) + 1, np.int64)
    for r in table:
        freq[r["id"]] = r["slots"]
    name, kind = ("ids", "array<long>") if what == "ids" else ("ids_crc32", "long")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("shard", "start", "doc_ids", "lengths", "checkpoints", "payload", "crc")
    out = blocks.mapInArrow(_decode(spark.sparkContext.broadcast(freq), what), f"shard int, doc_id long, start long, n_tokens long, last {kind}")
    shards = F.broadcast(spark.read.parquet(f"{path}/shards"))  # one row for each shard
    return out.join(shards, "shard").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", F.col("last").alias(name))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "tokens")
    write_token_file(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_token_file(spark, path, "crc")
