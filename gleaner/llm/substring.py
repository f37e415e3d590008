"""Substring dedup by repeated-phrase automata.

1. Candidates: each window of ``size`` words has one anchor, its least ``ANCHOR``-word phrase by hash.  Anchors that occur
   once cannot belong to a repeated window; windows of the others are grouped by anchor and compared by hash, which
   gives, for each repeated window, its first place, and from consecutive ones the recurring passages.  Documents of
   the same words are copies: all but the first go whole.
2. Automata: documents that hold a recurring passage are dealt to shards with the passages' words as the first place has
   them; a shard compiles its passages into one Aho-Corasick automaton over word numbers and streams its documents through
   it, which confirms the words and locates every occurrence.  Every document has been hashed then; one without a
   recurring anchor cannot hold a recurring window, so no automaton has anything to find in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import discard, first_of, join_weighted, numbered, staged, work_dir
from gleaner.llm.words import binary, chunks, grams, hashes, scan

ANCHOR = 5
#: Documents with recurring passages in one shard.
SHARD = 1000
EMPTY = hashlib.sha256(b"").hexdigest()


def anchors(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrase hashes, and the place of the anchor of each window of ``size`` words (the leftmost least phrase in it)."""
    g = grams(h, ANCHOR)
    n, span = len(h) - size + 1, size - ANCHOR + 1
    if n <= 0:
        return g, np.zeros(0, np.int64)
    best, at = g[:n].copy(), np.arange(n)
    for i in range(1, span):
        other = g[i : i + n]
        less = other < best
        best = np.where(less, other, best)
        at = np.where(less, np.arange(i, i + n), at)
    return g, at


PROFILE = "row long, doc_id long, n_words long, sha binary, anchors array<struct<anchor:long,times:long>>"


def _profile(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = binary(b.column(2))
            for lo, hi in chunks(texts):
                buf, starts, stops, first = scan(texts, lo, hi)
                h, out, mine, times = hashes(buf, starts, stops), [], [], []
                raw = [x.split() for x in texts.slice(lo, hi - lo).to_pylist()]
                for words, p, q in zip(raw, first[:-1].tolist(), first[1:].tolist(), strict=True):
                    g, at = anchors(h[p:q], size)
                    own = np.unique(g[np.unique(at)].view(np.int64), return_counts=True)
                    mine.append(own[0])
                    times.append(own[1])
                    out.append((q - p, hashlib.sha256(b" ".join(words)).digest()))
                n, sha = zip(*out, strict=True)
                cut = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in mine]))).astype(np.int32))
                own = pa.ListArray.from_arrays(cut, pa.StructArray.from_arrays([pa.array(np.concatenate(mine)), pa.array(np.concatenate(times))], ["anchor", "times"]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), own], names=["row", "doc_id", "n_words", "sha", "anchors"])

    return run


SPANS = "anchor long, parts long, row long, doc_id long, start long, windows array<long>"


def _spans(size: int):
    """(row, doc_id, text, recurring anchors and their parts) -> runs of windows that share one, with window hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = binary(b.column(2))
            lists = b.column(3)
            cuts, wanted = lists.offsets.to_numpy(), lists.flatten()
            names, shares = wanted.field(0).to_numpy(), wanted.field(1).to_numpy()
            cuts = cuts - cuts[0]
            for lo, hi in chunks(texts):
                buf, starts, stops, first = scan(texts, lo, hi)
                h, rows, marks, many, begin, runs = hashes(buf, starts, stops), [], [], [], [], []
                for i, p, q in zip(range(lo, hi), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    g, at = anchors(h[p:q], size)
                    if not len(at):
                        continue
                    w, a = grams(h[p:q], size).view(np.int64), g[at].view(np.int64)
                    cut = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]))
                    own, share = names[cuts[i] : cuts[i + 1]], shares[cuts[i] : cuts[i + 1]]
                    order = np.argsort(own)
                    own, share = own[order], share[order]
                    place = np.minimum(np.searchsorted(own, a[cut[:-1]]), len(own) - 1)
                    want = own[place] == a[cut[:-1]]
                    for s, e, k in zip(cut[:-1][want].tolist(), cut[1:][want].tolist(), share[place[want]].tolist(), strict=True):
                        rows.append(i)
                        marks.append(a[s])
                        many.append(k)
                        begin.append(s)
                        runs.append(w[s:e])
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.array(marks, np.int64)), pa.array(many, pa.int64()), b.column(0).take(take), b.column(1).take(take), pa.array(begin, pa.int64()), pa.array(runs, pa.list_(pa.int64()))], names=[x.split()[0] for x in SPANS.split(", ")])

    return run


RUNS = "row long, start long, n long, first_row long, first_start long"
#: Places of an anchor that one task compares; an anchor of more is dealt to several keys, as many as its places need.
PLACES = 1024
FIRSTS = RUNS + ", bucket long, w array<long>, rows array<long>, docs array<long>, starts array<long>"
_RUN, _PACK = RUNS.replace(" long", "").split(", "), ["w", "rows", "docs", "starts"]


def _runs(r: np.ndarray, s: np.ndarray, fr: np.ndarray, fs: np.ndarray) -> list[np.ndarray]:
    """Consecutive windows whose first places are consecutive, as RUNS."""
    if not len(r):
        return [r, s, s, fr, fs]
    new = (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1) | (fr[1:] != fr[:-1]) | (fs[1:] != fs[:-1] + 1)
    cut = np.concatenate(([0], np.flatnonzero(new) + 1))
    return [r[cut], s[cut], np.diff(np.concatenate((cut, [len(r)]))), fr[cut], fs[cut]]


def _firsts(buckets: int):
    """Sorted spans of whole keys (about ``PLACES`` each) -> runs of windows whose first place in the key is elsewhere,
    with that place.

    Rows come sorted by key, so that a window's places stand together, least document and start first.  Only the
    rows of the last key are held back between batches.  A hot anchor is several keys: the first places found in each
    are passed on, packed by bucket of the window's hash, to ``_merge_firsts``.
    """

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        lists = t.column("windows").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        w = lists.flatten().to_numpy()
        of = np.repeat(np.arange(len(t)), size)
        inside = np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
        key, row = t.column("key").to_numpy()[of], t.column("row").to_numpy()[of]
        start, hot = t.column("start").to_numpy()[of] + inside, t.column("hot").to_numpy(zero_copy_only=False)[of]
        order = np.lexsort((np.arange(len(w)), w, key))
        new = np.concatenate(([True], (w[order][1:] != w[order][:-1]) | (key[order][1:] != key[order][:-1]))) if len(w) else np.zeros(0, bool)
        first = np.empty(len(w), np.int64)
        first[order] = order[new][np.cumsum(new) - 1] if len(w) else order
        late = np.flatnonzero(first != np.arange(len(w)))
        cols = _runs(row[late], start[late], row[first[late]], start[first[late]])
        n = len(cols[0])
        none = [pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.list_(pa.int64())) for _ in _PACK]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, cols), *none], names=[*_RUN, "bucket", *_PACK])
        own = np.flatnonzero(hot & (first == np.arange(len(w))))
        if len(own):
            bucket = w[own] % buckets
            own = own[np.argsort(bucket, kind="stable")]
            found, count = np.unique(bucket, return_counts=True)
            cut = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32))
            docs = t.column("doc_id").combine_chunks().take(pa.array(of[own]))
            packed = [pa.ListArray.from_arrays(cut, x) for x in (pa.array(w[own]), pa.array(row[own]), docs, pa.array(start[own]))]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(found), pa.int64())] * 5, pa.array(found), *packed], names=[*_RUN, "bucket", *_PACK])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            key = t.column("key").to_numpy()
            other = np.flatnonzero(key != key[-1]) if len(key) else key
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from work(t.slice(0, cut).combine_chunks())
            held = t.slice(cut)
        if held is not None and len(held):
            yield from work(held.combine_chunks())

    return run


def _merge_firsts(table: pa.Table) -> pa.Table:
    """The first places that the keys of hot anchors found, of one bucket of windows: runs of those that another precedes."""
    w, row, start = (np.concatenate([x.values.to_numpy() if x.values is not None else np.zeros(0, np.int64) for x in table.column(c)]) for c in ("w", "rows", "starts"))
    docs = pa.concat_arrays([x.values for x in table.column("docs")])
    none, doc = docs.is_null().to_numpy(zero_copy_only=False), docs.fill_null(0).to_numpy()
    order = np.lexsort((start, row, doc, none, w))
    new = np.concatenate(([True], w[order][1:] != w[order][:-1]))
    first = order[new][np.cumsum(new) - 1]
    late = order[~new]
    first = first[~new]
    back = np.lexsort((start[late], row[late]))
    cols = _runs(row[late][back], start[late][back], row[first][back], start[first][back])
    return pa.table([pa.array(x, pa.int64()) for x in cols], names=_RUN)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by document, first document, distance and start, joined where both places go on.

    A run that two batches share stays in two parts, which cover the same words.
    """
    for b in batches:
        r, s, n, fr, fs = (c.to_numpy() for c in b.columns)
        new = (r[1:] != r[:-1]) | (fr[1:] != fr[:-1]) | (s[1:] - fs[1:] != s[:-1] - fs[:-1]) | (s[1:] != s[:-1] + n[:-1])
        cut = np.concatenate(([0], np.flatnonzero(new) + 1)) if len(r) else np.zeros(0, np.int64)
        total = np.add.reduceat(n, cut) if len(r) else n
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (r[cut], s[cut], total, fr[cut], fs[cut])], names=b.schema.names)


PASSAGES = "shard long, row long, start long, text binary, doc_id long"


def _passages(size: int):
    """(first_row, first_id, text, wanted: shard, first_start, n) -> the words of each passage, for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, doc, text, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = text.encode().split()
                shard, start, n = zip(*((w["shard"], w["first_start"], w["n"]) for w in wanted), strict=True)
                parts = [b" ".join(words[s : s + k + size - 1]) for s, k in zip(start, n, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array([row] * len(shard), pa.int64()), pa.array(start, pa.int64()), pa.array(parts, pa.binary()), pa.array([doc] * len(shard), pa.int64())], names=["shard", "row", "start", "text", "doc_id"])

    return run


FOUND = "row long, n_removed long, kept_sha256 string, spans array<struct<start:long,stop:long>>"


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by shard, passages (kind 0) before documents (kind 1): compile, then locate and cut."""
    import ahocorasick

    shard, auto, numbers, lengths = None, None, {}, {}
    for b in batches:
        out = []
        for at, kind, row, doc, start, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if at != shard:
                shard, auto, numbers, places = at, None, {}, {}
            words = text.split()
            if kind == 0:
                key = tuple([numbers.setdefault(w, len(numbers) + 1) for w in words])
                place = (doc is None, doc or 0, row, start)
                places[key] = min(place, places.get(key, place))
                continue
            if auto is None:
                auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
                for key, place in places.items():
                    auto.add_word(key, (len(key), place))
                auto.make_automaton()
                places = {}
            gone = np.zeros(len(words) + 1, np.int64)
            get = numbers.get
            for end, (n, place) in auto.iter(tuple([get(w, 0) for w in words])):
                if place < (doc is None, doc or 0, row, end + 1 - n):
                    gone[end + 1 - n] += 1
                    gone[end + 1] -= 1
            cover = np.cumsum(gone[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate(([False], cover, [False])).astype(np.int8))).reshape(-1, 2)
            left = b" ".join([w for w, c in zip(words, cover.tolist(), strict=True) if not c])
            out.append((row, int(cover.sum()), hashlib.sha256(left).hexdigest(), [{"start": int(s), "stop": int(e)} for s, e in edge]))
        cols = [*zip(*out, strict=True)] or [()] * 4
        types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["row", "n_removed", "kept_sha256", "spans"])


def repeated_passages(docs: DataFrame, size: int = 20) -> DataFrame:
    """(row, doc_id, n_words, n_removed, kept_sha256, spans) for every row of ``docs`` (doc_id, text).

    Words are the runs of bytes other than ASCII white space.  A word is removed if a window of ``size`` words covers it
    whose words also start earlier: in a row of smaller doc_id (null last; then by row), or before it in the same row.
    ``spans`` are the removed ranges of words; rows without one have null there.  Null and empty texts and texts of fewer than
    ``size`` words lose nothing.  Repeated rows are copies: the first stays whole.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    work = work_dir(spark, "substring")
    texts = numbered(docs, ["doc_id", "text"], f"{work}/texts").select("row", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = staged(texts.mapInArrow(_profile(size), PROFILE), f"{work}/profile")
    total = known.count()

    # rows of equal words are copies of the least: every window of theirs starts earlier there
    same = ["n_words", "sha"]
    alike = known.where(F.col("n_words") >= size).groupBy(*same).agg(first_of("doc_id", "row").alias("first"), F.count("*").alias("m"))
    alike = staged(alike.where("m > 1").select(*same, F.col("first.row").alias("first_row"), "m"), f"{work}/alike")
    copies = staged(join_weighted(known.select("row", *same), alike, same, "m", total).where("row <> first_row").select("row"), f"{work}/copies")
    firsts = known.select("row", "doc_id", "anchors").hint("merge").join(copies, "row", "left_anti")

    # anchors that two places share
    seen = staged(firsts.where(F.size("anchors") > 0).select("row", F.explode("anchors").alias("a")).select("row", "a.*"), f"{work}/anchors")
    places = seen.agg(F.sum("times")).first()[0] or 0
    shared = staged(seen.groupBy("anchor").agg(F.sum("times").alias("m")).where("m > 1"), f"{work}/shared")
    wanted = join_weighted(seen.select("row", "anchor"), shared, ["anchor"], "m", places).groupBy("row").agg(F.collect_list(F.struct("anchor", F.ceil(F.col("m") / PLACES).alias("parts"))).alias("wanted"))
    some = staged(texts.hint("merge").join(wanted, "row"), f"{work}/texts-some", compression="zstd")

    # an earlier place of each repeated window; an anchor of many places is dealt to several keys, whose finds then
    # meet by window
    order = [F.asc_nulls_last("doc_id"), F.asc("row"), F.asc("start")]
    buckets = max(64, places // 100_000)
    spans = some.select("row", "doc_id", "text", "wanted").mapInArrow(_spans(size), SPANS)
    spans = spans.select(F.when(F.col("parts") > 1, F.xxhash64("anchor", F.pmod(F.xxhash64("row", "start"), "parts"))).otherwise(F.col("anchor")).alias("key"), "row", "doc_id", "start", "windows", (F.col("parts") > 1).alias("hot"))
    level = staged(spans.repartition("key").sortWithinPartitions("key", *order).mapInArrow(_firsts(buckets), FIRSTS), f"{work}/firsts")
    discard(spark, f"{work}/anchors", f"{work}/shared")
    light = level.where("row is not null").select(*_RUN)
    heavy = level.where("bucket is not null").select("bucket", *_PACK).groupBy("bucket").applyInArrow(_merge_firsts, RUNS)
    runs = light.unionByName(heavy).repartition("row").sortWithinPartitions("row", "first_row", F.col("start") - F.col("first_start"), "start").mapInArrow(_merge, RUNS)
    shard = F.pmod(F.xxhash64("row"), F.lit(max(1, total // SHARD)))
    runs = staged(runs.withColumn("shard", shard), f"{work}/runs")

    # passages as their first places have them, and the documents that hold later ones, by shard
    lists = runs.select("first_row", "shard", "first_start", "n").distinct().groupBy("first_row", (F.col("shard") / 64).cast("long").alias("part")).agg(F.collect_list(F.struct("shard", "first_start", "n")).alias("wanted"))
    passages = some.select(F.col("row").alias("first_row"), "doc_id", "text").hint("merge").join(lists, "first_row").select("first_row", "doc_id", "text", "wanted").mapInArrow(_passages(size), PASSAGES)
    later = some.select("row", "doc_id", "text").hint("merge").join(runs.select("row", "shard").distinct(), "row")
    streams = passages.select("shard", F.lit(0).alias("kind"), "row", "doc_id", "start", "text").unionByName(later.select("shard", F.lit(1).alias("kind"), "row", "doc_id", F.lit(0).cast("long").alias("start"), F.col("text").cast("binary").alias("text")))
    found = streams.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_stream, FOUND)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop")))
    found = found.select("row", F.lit(False).alias("copy"), "n_removed", "kept_sha256", "spans").unionByName(copies.select("row", F.lit(True).alias("copy"), F.lit(0).cast("long").alias("n_removed"), F.lit(EMPTY).alias("kept_sha256"), F.lit(None).cast("array<struct<start:long,stop:long>>").alias("spans")))
    out = known.select("row", "doc_id", "n_words", "sha").hint("merge").join(found, "row", "left")
    return out.select("row", "doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"), F.when(F.col("copy"), whole).otherwise(F.col("spans")).alias("spans"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op7: one row for each row of ``documents``, as ``repeated_passages`` says."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")
