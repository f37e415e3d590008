"""MinHash near-dedup: SuperMinHash signatures, banding, exact confirmation and union of confirmed links.

Documents of equal shingle sets are one *set* first.  Sets that share a band fall into a bucket; every member is
compared with the bucket's least set, confirmed links are united, and only buckets that still hold several components
are searched further, member against member, by signature and then by full sets inside the task.  Tasks emit links that unite
components, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import first_of, give_back, join_weighted, numbered, staged, work_dir
from gleaner.llm.components import components
from gleaner.llm.words import binary, chunks, grams, hashes, mix, scan

LANES, ROWS = 128, 4  # of the signature; lanes of a band: 32 bands miss a pair of similarity 0.8 once in 2e7
ELEMENTS = 100_000  # elements whose ranks are permuted at once
MEMBERS = 2048  # members of a bucket in one task; larger buckets are searched block against block
CHUNK = 256  # members that share a task with their bucket's least set
#: Signatures must agree this much below the threshold before full sets are compared: 7 standard errors.
MARGIN = 0.25


def superminhash(elements: np.ndarray, sizes: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """Signatures (len(sizes) x lanes, uint16) of consecutive sets of 64-bit elements; empty sets give zeros.

    Element e draws, at step j, a uniform rank r and swaps place j of its own permutation with a later one; lane p[j]
    then takes the least r + j.  A set ends at the first step after which no lane can get a smaller value.
    """
    out = np.zeros((len(sizes), lanes), np.uint16)
    first, lo = np.concatenate(([0], np.cumsum(sizes))), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + ELEMENTS, "right")) - 1)
        e, of = elements[first[lo] : first[hi]], np.repeat(np.arange(hi - lo), sizes[lo:hi])
        h = np.full((hi - lo) * lanes, np.inf)
        p = np.tile(np.arange(lanes, dtype=np.uint8 if lanes <= 256 else np.uint16), (len(e), 1))
        act = np.arange(len(e))
        with np.errstate(over="ignore"):
            for j in range(lanes):
                if not len(act):
                    break
                u = mix(e[act] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
                k = j + ((u & np.uint64(0xFFFFFF)) * np.uint64(lanes - j) >> np.uint64(24)).astype(np.int64)
                r = (u >> np.uint64(24)).astype(np.float64) * 2.0**-40 + j
                lane = p[act, k]
                p[act, k] = p[act, j]
                np.minimum.at(h, of[act] * lanes + lane, r)
                open_ = h.reshape(-1, lanes).max(axis=1) >= j + 1
                act = act[open_[of[act]]]
            v = np.where(np.isinf(h), 0.0, h).view(np.uint64)
            out[lo:hi] = (mix(v + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(48)).astype(np.uint16).reshape(-1, lanes)
            out[lo:hi][sizes[lo:hi] == 0] = 0
        lo = hi
    return out


def shingle_sets(texts: pa.Array, k: int) -> Iterator[list[np.ndarray]]:
    """Sorted distinct hashes of the k-word shingles of each document, a chunk of documents at a time.

    A document of fewer words has its whole sequence as one; without words it has none.
    """
    for lo, hi in chunks(texts):
        buf, starts, stops, first = scan(texts, lo, hi, lower=True)
        h = hashes(buf, starts, stops)
        g = grams(h, k)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            n = b - a
            out.append(np.unique(g[a : b - k + 1]) if n >= k else grams(h[a:b], n) + np.uint64(n) if n else g[:0])
        yield out


SIGNED = "row long, doc_id long, n_shingles long, d1 long, d2 long, sig array<long>"


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for sets in shingle_sets(binary(b.column(2)), k):
                n = np.array([len(x) for x in sets], np.int64)
                flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
                with np.errstate(over="ignore"):
                    cut = np.concatenate(([0], np.cumsum(n)))
                    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(flat + np.uint64(c)), dtype=np.uint64))) for c in (1, 0x5851F42D4C957F2D)]
                    d = [(s[cut[1:]] - s[cut[:-1]]).view(np.int64) for s in sums]
                sig = superminhash(flat, n).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * sig.shape[1]), pa.array(sig.reshape(-1)))
                ids = [b.column(i).slice(at, len(n)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([ids[0], ids[1].cast(pa.int64()), pa.array(n), pa.array(d[0]), pa.array(d[1]), lists], names=["row", "doc_id", "n_shingles", "d1", "d2", "sig"])
                at += len(n)
            give_back()

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sets(table: pa.Table, k: int) -> list[np.ndarray]:
    return [s for part in shingle_sets(binary(table.column("text").combine_chunks()), k) for s in part]


def _to_pivot(k: int, percent: int):
    """A group: the pivot's text and those of up to ``CHUNK`` members, more or less."""

    def run(table: pa.Table) -> pa.Table:
        nodes, pivot = table.column("node").to_numpy(), table.column("pivot")[0].as_py()
        sets = _sets(table, k)
        mine = sets[int(np.flatnonzero(nodes == pivot)[0])]
        hit = [int(n) for n, s in zip(nodes, sets, strict=True) if n != pivot and _linked(mine, s, percent)]
        return pa.table({"a": pa.array(hit, pa.int64()), "b": pa.array([pivot] * len(hit), pa.int64())})

    return run


def _close(sig: np.ndarray, others: np.ndarray, least: float) -> np.ndarray:
    return (others.view(np.uint16) == sig.view(np.uint16)).mean(axis=1) >= least


def _suspects(percent: int):
    """Members of a bucket's block pair that have a likely link to a member of another component."""

    def run(table: pa.Table) -> pa.Table:
        node, label, side = (table.column(c).to_numpy() for c in ("node", "label", "side"))
        sig = np.array(table.column("sig").to_pylist(), np.int64).reshape(len(node), -1)
        left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
        out: set[int] = set()
        for i in left.tolist():
            other = right[label[right] != label[i]]
            if len(other) and len(near := other[_close(sig[i], sig[other], percent / 100 - MARGIN)]):
                out |= {i, *near.tolist()}
        rows = np.array(sorted(out), np.int64)
        return table.take(pa.array(rows)).select(["bucket", "part", "node", "label", "side"])

    return run


def _unite(k: int, percent: int):
    """Links that unite components among the members of a block pair; a pair in one component already is not compared."""

    def run(table: pa.Table) -> pa.Table:
        node, label, side = (table.column(c).to_numpy() for c in ("node", "label", "side"))
        sets, top, found = _sets(table, k), {int(x): int(x) for x in set(label.tolist())}, []

        def root(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        size = np.array([len(s) for s in sets])
        left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
        right = right[np.argsort(size[right], kind="stable")]
        for i in left.tolist():
            a, z = np.searchsorted(size[right], (-(-percent * size[i] // 100), 100 * size[i] // percent + 1))
            for j in right[a:z].tolist():
                if (p := root(int(label[i]))) != (q := root(int(label[j]))) and _linked(sets[i], sets[j], percent):
                    top[max(p, q)] = min(p, q)
                    found.append((int(node[i]), int(node[j])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(row, doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text; others are ignored).

    Words are runs of bytes other than ASCII white space with A-Z in lower case; a document's set holds its distinct
    k-word shingles (as 64-bit hashes), the whole sequence if it has fewer words, nothing if it has none.  Documents
    whose sets meet 100 * intersection >= percent * union are linked when banding brings them together; component_id
    is the least doc_id reachable.  Null and empty texts are linked with nothing; a null doc_id is the least of no
    component unless all its doc_ids are null; repeated rows are linked like other copies; an empty table gives no rows.
    """
    spark = docs.sparkSession
    work = work_dir(spark, "minhash")
    texts = numbered(docs, ["doc_id", "text"], f"{work}/texts")
    signed = staged(texts.select("row", "doc_id", "text").mapInArrow(_sign(k), SIGNED), f"{work}/signed")
    total = signed.count()
    same = ["n_shingles", "d1", "d2"]
    sets = staged(signed.where("n_shingles > 0").groupBy(*same).agg(first_of("doc_id", "row").alias("first"), F.first("sig").alias("sig"), F.count("*").alias("n")).select(*same, F.col("first.row").alias("node"), F.col("first.doc_id").alias("node_id"), "sig", "n"), f"{work}/sets")
    bands = sets.select("node", F.posexplode("sig").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("bucket"))
    buckets = staged(bands.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("m")).where("m > 1"), f"{work}/buckets")
    members = staged(join_weighted(bands, buckets, ["bucket"], "m", total), f"{work}/members")

    # every member against the least of its bucket
    star = staged(members.where("node <> pivot").select("pivot", "node").distinct(), f"{work}/star")
    counts = staged(star.groupBy("pivot").agg(F.count("*").alias("m")), f"{work}/pivots")
    parts = F.ceil(F.col("m") / CHUNK)
    dealt = join_weighted(star, counts, ["pivot"], "m", total).select("pivot", F.pmod(F.xxhash64("node"), parts).alias("part"), "node")
    tasks = dealt.unionByName(counts.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.col("pivot").alias("node")))
    with_text = tasks.hint("merge").join(texts.select(F.col("row").alias("node"), "text"), "node")
    edges = staged(with_text.groupBy("pivot", "part").applyInArrow(_to_pivot(k, percent), "a long, b long"), f"{work}/links-1")
    labels = components(edges, f"{work}/components-1")

    # buckets of more than two members that are not of one component yet
    known = members.where("m > 2").join(labels, "node", "left").select("bucket", "node", "m", F.coalesce("label", "node").alias("label"))
    known = staged(known, f"{work}/known")
    mixed = staged(known.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size")).where("x <> y").select("bucket", "size"), f"{work}/mixed")
    if not mixed.isEmpty():
        blocks = F.ceil(F.col("size") / MEMBERS)
        block = F.pmod(F.xxhash64("node"), F.col("blocks"))
        rest = join_weighted(known.select("bucket", "node", "label"), mixed, ["bucket"], "size", total).withColumn("blocks", blocks).withColumn("block", block)
        # block i meets every block from i on: side 1 as the left one, 2 as the right one, 3 both
        others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
        pair = F.transform(others, lambda o: F.struct((F.least(o, F.col("block")) * F.col("blocks") + F.greatest(o, F.col("block"))).alias("part"), F.when(o == F.col("block"), 3).when(o > F.col("block"), 1).otherwise(2).cast("long").alias("side")))
        rest = rest.select("bucket", "node", "label", F.explode(pair).alias("p")).select("bucket", "p.part", "node", "label", "p.side")
        rest = rest.hint("merge").join(sets.select("node", "sig"), "node")
        near = staged(rest.groupBy("bucket", "part").applyInArrow(_suspects(percent), "bucket long, part long, node long, label long, side long"), f"{work}/suspects")
        if not near.isEmpty():
            near = near.hint("merge").join(texts.select(F.col("row").alias("node"), "text"), "node")
            more = staged(near.groupBy("bucket", "part").applyInArrow(_unite(k, percent), "a long, b long"), f"{work}/links-2")
            if not more.isEmpty():
                labels = components(edges.unionByName(more), f"{work}/components-2")
    linked = sets.join(labels, "node", "left").select(*same, "node_id", F.coalesce("label", "node").alias("label"), "n")
    linked = staged(linked, f"{work}/linked")
    least = staged(linked.groupBy("label").agg(F.min("node_id").alias("component_id"), F.count("*").alias("m")), f"{work}/least")
    named = staged(join_weighted(linked, least, ["label"], "m", total).select(*same, "component_id", "n"), f"{work}/named")
    rows = signed.select("row", "doc_id", *same)
    out = join_weighted(rows.where("n_shingles > 0"), named, same, "n", total).select("row", "doc_id", "n_shingles", "component_id")
    return out.unionByName(rows.where("n_shingles = 0").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``, with all columns: that of the least doc_id, nulls last.

    Rows are told apart even where doc_ids are null or repeated; of rows that agree in doc_id either stays.
    """
    work = work_dir(docs.sparkSession, "minhash-kept")
    odd = docs.groupBy("doc_id").count().where((F.col("count") > 1) | F.col("doc_id").isNull())
    if odd.isEmpty():
        found = staged(near_duplicates(docs, k, percent), f"{work}/found")
        gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    rows = staged(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), f"{work}/rows")
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), "doc.text"), k, percent)
    found = found.select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", "doc.doc_id"), "row")
    kept = staged(found.groupBy("component_id").agg(first_of("doc_id", "row").alias("first")).select("first.row"), f"{work}/kept")
    return rows.join(kept, "row", "left_semi").select("doc.*")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op4: one row for each row of ``documents``, as ``near_duplicates`` with k = 4 says."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
