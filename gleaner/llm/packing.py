"""Best-fit packing: pieces of documents into sequences under token, document-count and attention-cost capacities."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import give_back, staged, work_dir
from gleaner.llm.tokens import default_path, word_ids

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of a packing group; a group's bins are what one task holds.
GROUP = 8192


def pack(lengths: np.ndarray, tokens: int, docs: int, attention: int, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.02, 0.02)) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece.  A piece of n tokens demands (n, 1, n * n) of the capacities.

    Pieces come in order of falling length.  Of the bins that have room in every dimension, ``norm`` takes the one whose
    weighted residual after the piece has the smallest norm, ``dot`` the one whose residual has the largest
    weighted dot product with the demand (both relative to the capacities); of equal ones, the earliest.  Bins of
    equal residual are kept together, so the search looks at each different residual at most once, and ``norm`` stops
    where the token term alone exceeds the best.  A piece that no empty bin can hold has a bin of its own.
    """
    cap = np.array([tokens, docs, attention], float)
    wt, wd, wa = (float(w / c**2) for w, c in zip(weights, cap, strict=True))
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_: dict[int, dict[tuple[int, int], list[int]]] = defaultdict(dict)
    mask, used = 0, 0  # mask: bit r is set if a bin has r tokens of room
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        sq, best, at = n * n, float("inf"), None
        left, r = mask >> n, n
        while left:
            step = (left & -left).bit_length() - 1
            r += step
            left >>= step + 1
            if rule == "norm" and wt * (r - n) ** 2 >= best:
                break
            for rd, ra in open_[r]:
                if rd >= 1 and ra >= sq:
                    cost = wt * (r - n) ** 2 + wd * (rd - 1) ** 2 + wa * (ra - sq) ** 2 if rule == "norm" else -(wt * r * n + wd * rd + wa * ra * sq)
                    if cost < best:
                        best, at = cost, (r, rd, ra)
            r += 1
        if at is None:
            b, r, rd, ra = used, tokens, docs, attention
            used += 1
        else:
            r, rd, ra = at
            same = open_[r][rd, ra]
            b = same.pop()
            if not same:
                del open_[r][rd, ra]
                if not open_[r]:
                    mask &= ~(1 << r)
        bins[i], offsets[i] = b, tokens - r
        if (r := r - n) > 0 and rd > 1 and ra > sq:
            open_[r].setdefault((rd - 1, ra - sq), []).append(b)
            mask |= 1 << r
    return bins, offsets


def _pieces(content, end: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, names = word_ids(content.value), [x.split()[0] for x in PIECES.split(", ")]
        for b in batches:
            docs = b.column(0).cast(pa.int64()).to_pylist()
            for lo, hi, data, n in ids.parts(b.column(1)):
                out: list[tuple] = []
                whole = np.insert(data, np.cumsum(n), end).astype("<u4")
                ends = np.cumsum(n + 1).tolist()
                for doc, first, last in zip(docs[lo:hi], [0, *ends], ends, strict=False):
                    out += [(doc, k, s - first, min(size, last - s), zlib.crc32(whole[s : min(s + size, last)].tobytes())) for k, s in enumerate(range(first, last, size))]
                cols = [*zip(*out, strict=True)] or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for c, n in zip(cols, names, strict=True)], names=names)
                del out, cols
        ids.forget()
        give_back()

    return run


def cut(docs: DataFrame, size: int = 4096, tokenizer: str | None = None, end: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and ``end``, in pieces of ``size`` ids."""
    with open(tokenizer or default_path()) as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    return docs.select("doc_id", "text").mapInArrow(_pieces(content, end, size), PIECES)


def pack_pieces(pieces: DataFrame, work: str, tokens: int = 4096, docs: int | None = None, attention: int | None = None, rule: str = "norm", full: float = 0.98) -> DataFrame:
    """``pieces`` (length, any others) with sequence_id and offset, packed in ever fewer groups.

    Pieces are numbered as they are staged and fall into groups by a hash of the number, and every group is packed by ``pack``.  The pieces of bins that are less than
    ``full`` are packed once more among themselves, in groups of the same size, until one group is left.  No capacity
    is broken, no piece is dropped or cut; what one task holds is bounded by ``GROUP`` pieces of three numbers, and a
    group never depends on a source or a key.
    """
    docs, attention = docs or tokens, attention or tokens * tokens
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    number = max(own, key=len) + "_"  # a name that is not taken: equal pieces differ by it and so fall into any group
    pieces = staged(pieces.select(*own, F.monotonically_increasing_id().alias(number)), f"{work}/numbered")
    columns = [*own, number]
    schema = pieces.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0.0).alias("fill"), F.lit(0).alias("level")).schema

    def packer(level: int):
        def run(table: pa.Table) -> pa.Table:
            n, g = table.column("length").to_numpy(), table.column(number + "_")[0].as_py()
            order = pc.sort_indices(table, [(c, "ascending") for c in columns])
            table, n = table.take(order), n[order.to_numpy()]
            bins, offset = pack(n, tokens, docs, attention, rule)
            fill = np.bincount(bins, n) / tokens
            return pa.table([*(table.column(c) for c in columns), pa.array((level << 52) + (g << 24) + bins), pa.array(offset), pa.array(fill[bins]), pa.array(np.full(len(n), level, np.int32))], names=schema.names)

        return run

    rest, done, level = pieces, None, 0
    count = rest.count()
    while True:
        groups = max(1, count // GROUP)
        key = F.pmod(F.xxhash64(F.lit(level), number), F.lit(groups))
        packed = staged(rest.select(*columns, key.alias(number + "_")).groupBy(number + "_").applyInArrow(packer(level), schema), f"{work}/level-{level}")
        if groups == 1:
            last = packed
            break
        keep = packed.where(F.col("fill") >= full)
        done = keep if done is None else done.unionByName(keep)
        rest = packed.where(F.col("fill") < full)
        fewer = rest.count()
        if fewer > 0.9 * count:  # bins can hardly be filled better: pieces are that long
            last = rest
            break
        count, level = fewer, level + 1
    return (last if done is None else done.unionByName(last)).select(*own, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokens: int = 4096, tokenizer: str | None = None, end: int = 1, **limits) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs`` (doc_id, text).

    A null or empty text is one piece that holds the end id.  Texts beyond ``tokens`` ids are cut into pieces.
    Repeated rows are packed each; a null doc_id stays null; an empty table gives no rows; other columns are
    ignored.
    """
    work = work_dir(docs.sparkSession, "packing")
    return pack_pieces(cut(docs, tokens, tokenizer, end), work, tokens, **limits)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op6: one row for each piece of ``documents``, as ``pack_documents`` says."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
