"""Embedding near-dedup: hierarchical navigable small-world graphs per shard, audited beams, exact cosine, components."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import MOST_TASKS, first_of, give_back, join_weighted, staged, work_dir
from gleaner.llm.components import components

#: Vectors of a shard (one graph, built in one task), and of a slice of queries that visits a shard at once.
SHARD, SLICE = 8192, 2048
#: Shards of a label whose slices one copy of a graph serves, so that a task's queries are bounded at any size.
SERVED = 4
DEGREE, BEAM = 16, 48
#: Audited queries (and least audited links) of a slice in a shard, the share of their links that must be found, and
#: products of a matrix block when queries are compared with a whole shard.
AUDIT, RECALL, WHOLE = 64, 0.999, 1 << 21


class Graph:
    """A graph over unit vectors: layer 0 holds all with up to 2 * DEGREE links, each further layer a 16th of the last.

    Searches run for many queries at once: each step expands the best few unexpanded members of every query's beam.
    """

    def __init__(self, unit: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.unit, self.layers = unit, layers  # of each layer: members (sorted positions), links (positions in members)

    @classmethod
    def build(cls, unit: np.ndarray, seed: int = 5) -> Graph:
        n = len(unit)
        level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(DEGREE)).astype(int), 6)
        layers = []
        for k in range(int(level.max(initial=0)) + 1):
            who = np.flatnonzero(level >= k)
            layers.append((who, cls._layer(unit[who], 2 * DEGREE if k == 0 else DEGREE)))
        return cls(unit, layers)

    @staticmethod
    def _layer(x: np.ndarray, degree: int) -> np.ndarray:
        """Insert members batch by batch: each finds its nearest by beam search among those before it (and the batch's
        own), links to a diverse choice of them, and they link back, thinned by the same rule."""
        n = len(x)
        links = np.full((n, degree), -1, np.int32)
        done = min(n, 4 * degree)
        sims = x[:done] @ x[:done].T
        np.fill_diagonal(sims, -2)
        order = np.argsort(-sims, axis=1)[:, : min(done - 1, 2 * degree)]
        if done > 1:
            links[:done] = _diverse(x, np.arange(done), order.astype(np.int32), degree)
        while done < n:
            new = np.arange(done, min(n, done + min(512, done)))
            entry = np.linspace(0, done - 1, min(done, 16)).astype(np.int32)
            near, _ = beam(x, links, x[new], np.broadcast_to(entry, (len(new), len(entry))), BEAM)
            own = x[new] @ x[new].T
            np.fill_diagonal(own, -2)
            top = np.argsort(-own, axis=1)[:, : min(len(new) - 1, degree)]
            links[new] = _diverse(x, new, np.concatenate((near, new[top].astype(np.int32)), axis=1), degree)
            src, dst = np.repeat(new, degree), links[new].reshape(-1)
            src, dst = src[dst >= 0], dst[dst >= 0]
            order = np.argsort(dst, kind="stable")
            src, dst = src[order], dst[order]
            who, at, count = np.unique(dst, return_index=True, return_counts=True)
            width = int(count.max(initial=0))
            back = np.full((len(who), width), -1, np.int32)
            back[np.repeat(np.arange(len(who)), count), np.arange(len(dst)) - np.repeat(at, count)] = src
            links[who] = _diverse(x, who, np.concatenate((links[who], back), axis=1), degree)
            done = int(new[-1]) + 1
        return links

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best positions found for each query (-1: none) and their similarities, best first."""
        who, links = self.layers[-1]
        entry = np.broadcast_to(np.linspace(0, len(who) - 1, min(len(who), 8)).astype(np.int32), (len(queries), min(len(who), 8)))
        for k in range(len(self.layers) - 1, -1, -1):
            who, links = self.layers[k]
            found, sims = beam(self.unit[who], links, queries, entry, width if k == 0 else 8)
            if k:
                down = np.where(found >= 0, who[found], who[found[:, :1]])
                entry = np.searchsorted(self.layers[k - 1][0], down).astype(np.int32)
        return found, sims

    def dump(self) -> bytes:
        """The layers; the vectors are kept beside them."""
        out = io.BytesIO()
        np.savez(out, **{f"{p}{k}": a for k, pair in enumerate(self.layers) for p, a in zip("wl", pair, strict=True)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes, unit: np.ndarray) -> Graph:
        z = np.load(io.BytesIO(data))
        return cls(unit.astype(np.float32), [(z[f"w{k}"], z[f"l{k}"]) for k in range(len(z.files) // 2)])


def _diverse(x: np.ndarray, who: np.ndarray, cand: np.ndarray, degree: int) -> np.ndarray:
    """Up to ``degree`` of the candidates, nearest first, each nearer to its node than to any chosen before; then the
    nearest of the rest."""
    out = np.full((len(who), degree), -1, np.int32)
    for lo in range(0, len(who), 256):
        w, c = who[lo : lo + 256], np.sort(cand[lo : lo + 256], axis=1)
        bad = (c < 0) | (c == w[:, None]) | np.concatenate((np.zeros((len(c), 1), bool), c[:, 1:] == c[:, :-1]), axis=1)
        v = x[np.maximum(c, 0)]
        s = np.where(bad, -3.0, np.einsum("ad,acd->ac", x[w], v))
        order = np.argsort(-s, axis=1, kind="stable")
        c, s, v = np.take_along_axis(c, order, 1), np.take_along_axis(s, order, 1), np.take_along_axis(v, order[..., None], 1)
        ok, among = s > -3, np.matmul(v, v.transpose(0, 2, 1))
        chosen, worst = np.zeros(c.shape, bool), np.full(c.shape, -2.0)
        for j in range(c.shape[1]):
            take = ok[:, j] & (s[:, j] > worst[:, j]) & (chosen.sum(axis=1) < degree)
            chosen[:, j] = take
            worst = np.where(take[:, None], np.maximum(worst, among[:, j]), worst)
        rank = np.argsort(np.where(chosen, 0, np.where(ok, 1, 2)), axis=1, kind="stable")[:, :degree]
        out[lo : lo + 256, : rank.shape[1]] = np.where(np.take_along_axis(ok, rank, 1), np.take_along_axis(c, rank, 1), -1)
    return out


def beam(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search in one layer from ``entry`` (positions, one row for each query), for all queries in step."""
    n, found, sims = len(x), np.full((len(queries), width), -1, np.int32), np.full((len(queries), width), -3.0, x.dtype)
    for lo in range(0, len(queries), 256):
        q = queries[lo : lo + 256]
        rows = np.arange(len(q))
        seen = np.zeros((len(q), n + 1), bool)
        seen[:, n] = True
        best, score = np.full((len(q), width), n, np.int32), np.full((len(q), width), -3.0, x.dtype)
        fresh = np.zeros((len(q), width), bool)
        act, cand = rows, np.where(entry[lo : lo + 256] < 0, n, entry[lo : lo + 256])
        while len(act):
            cand = np.sort(cand, axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = n
            cand[seen[act[:, None], cand]] = n
            seen[act[:, None], cand] = True
            s = np.einsum("ad,acd->ac", q[act], x[np.minimum(cand, n - 1)])
            s[cand == n] = -3
            ids, sc = np.concatenate((best[act], cand), axis=1), np.concatenate((score[act], s), axis=1)
            fr = np.concatenate((fresh[act], cand < n), axis=1)
            order = np.argsort(-sc, axis=1, kind="stable")[:, :width]
            best[act], score[act] = np.take_along_axis(ids, order, 1), np.take_along_axis(sc, order, 1)
            fr = np.take_along_axis(fr, order, 1)
            pick = fr & (np.cumsum(fr, axis=1) <= expand)
            fresh[act] = fr & ~pick
            go = pick.any(axis=1)
            if not go.any():
                break
            at = np.argsort(~pick[go], axis=1, kind="stable")[:, :expand]
            heads = np.where(np.take_along_axis(pick[go], at, 1), np.take_along_axis(best[act[go]], at, 1), n)
            act = act[go]
            cand = np.where(heads[..., None] < n, links[np.minimum(heads, n - 1)], -1).reshape(len(act), -1)
            cand = np.where(cand < 0, n, cand)
        found[lo : lo + 256], sims[lo : lo + 256] = np.where(best < n, best, -1), score
    return found, sims


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)  # squares of large or small parts stay finite
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _whole(unit: np.ndarray, members: np.ndarray, least: float, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked (query, position) of the queries ``rows`` with all members, a matrix block at a time."""
    step = max(1, WHOLE // max(1, len(members)))
    for lo in range(0, len(rows), step):
        i, j = np.nonzero(unit[rows[lo : lo + step]] @ members.T >= least)
        yield rows[lo : lo + step][i], j


@dataclass
class Audit:
    """Queries compared with their whole shard, their links, and how many of these the first and the last beams found."""

    queries: int = 0
    links: int = 0
    first: int = 0
    found: int = 0


def links(graph: Graph, members: np.ndarray, unit: np.ndarray, least: float, audit: Audit, recall: float = RECALL, beam_width: int = BEAM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, position) of the links of unit vectors ``unit`` with the graph's ``members`` (unit, in double), each once.

    A query whose whole beam is linked is searched again with a wider one; a beam of over an eighth of the shard is the
    whole shard, compared as a matrix product.  Then queries are audited against the whole shard: ``AUDIT`` evenly spaced
    ones and as many that found links, and more until they have ``AUDIT`` links or are a quarter of all.  While beams miss
    more than ``recall`` allows, those of the queries not compared with the whole shard are doubled.
    """
    n, near, width = len(members), unit.astype(np.float32), min(len(members), beam_width)
    widest = max(width, n // 8)
    none = np.zeros(0, np.int64)

    def search(rows: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Verified links of the queries whose beam was wide enough, and the other queries."""
        found, sims = graph.search(near[rows], w)
        hit = (found >= 0) & (sims >= least - 1e-4)
        full = hit.all(axis=1) & (w < n)
        a, b = np.nonzero(hit & ~full[:, None])
        i, j = rows[a], found[a, b]
        good = [np.einsum("ad,ad->a", unit[i[lo : lo + 65536]], members[j[lo : lo + 65536]]) >= least for lo in range(0, len(i), 65536)]
        good = np.concatenate(good) if good else none.astype(bool)
        return i[good], j[good], rows[full]

    def audited(i: np.ndarray, j: np.ndarray, rows: np.ndarray) -> tuple[int, int, int]:
        """Queries audited, their links, and how many of these are among (i, j)."""
        own, most = np.unique(i), max(2 * AUDIT, len(unit) // 4)
        order = np.concatenate((rows[np.linspace(0, len(rows) - 1, min(AUDIT, len(rows))).astype(int)], own[:: max(1, len(own) // AUDIT)][:AUDIT], rows[:: max(1, len(rows) // most)]))
        order = order[np.sort(np.unique(order, return_index=True)[1])][:most]
        pairs, done, want, have = i * n + j, 0, 0, 0
        while done < len(order) and (done < 2 * AUDIT or want < AUDIT):
            true = np.concatenate([a * n + b for a, b in _whole(unit, members, least, order[done : done + AUDIT])])
            done, want, have = min(len(order), done + AUDIT), want + len(true), have + int(np.isin(true, pairs).sum())
        return done, want, have

    whole, todo, first = np.zeros(len(unit), bool), np.arange(len(unit)), True
    while True:
        i, j, w = none, none, width
        while len(todo) and w <= widest:
            p, q, todo = search(todo, w)
            i, j, w = np.concatenate((i, p)), np.concatenate((j, q)), 4 * w
        whole[todo] = True
        todo = np.flatnonzero(~whole)
        if not len(todo):
            break
        queries, want, have = audited(i, j, todo)
        if first:
            audit.queries, audit.links, audit.first, audit.found, first = audit.queries + queries, audit.links + want, audit.first + have, audit.found + want, False
        if have >= recall * want:
            audit.found -= want - have
            break
        width *= 2
    yield i, j
    yield from _whole(unit, members, least, np.flatnonzero(whole))


def _unite(top: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a and b in the forest ``top``, whose pointers descend and rest on roots."""
    while True:
        p, q = top[a], top[b]
        apart = p != q
        if not apart.any():
            return
        np.minimum.at(top, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while not np.array_equal(up := top[top], top):
            top[:] = up


BUILT = "part string, shard long, shards long, slice long, nodes array<long>, counts array<long>, raw binary, graph binary"
#: kind 0: node a has n links; 1: nodes a and b are linked; 2: of n links of a audited queries b were found at first, m at last.
FOUND = "kind int, a long, b long, n long, m long"


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def _build(table: pa.Table) -> pa.Table:
    """A shard's graph, as a row of slice -1, and its vectors as slices of queries."""
    table = table.take(pc.sort_indices(table, [("node", "ascending")]))
    nodes, counts = _columns(table, "node", "n")
    raw = table.column("vector").combine_chunks().flatten().to_numpy().reshape(len(nodes), -1)
    graph = Graph.build(_unit(raw).astype(np.float32))
    cut = [(0, len(nodes)), *((lo, min(lo + SLICE, len(nodes))) for lo in range(0, len(nodes), SLICE))]
    part, shard, shards = (table.column(c)[0].as_py() for c in ("part", "shard", "shards"))
    k = len(cut)
    cols = [[part] * k, [shard] * k, [shards] * k, range(-1, k - 1), [nodes[a:b] for a, b in cut], [counts[a:b] for a, b in cut], [raw[a:b].tobytes() for a, b in cut], [graph.dump(), *[None] * (k - 1)]]
    types = [pa.string(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 2, pa.binary(), pa.binary()]
    return pa.table([pa.array(v, t) for v, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in BUILT.split(", ")])


def _visit(graph: Graph, members: np.ndarray, own: np.ndarray, size: np.ndarray, nodes: np.ndarray, raw: np.ndarray, least: float) -> pa.RecordBatch:
    """A slice of queries in a shard, as FOUND: links are counted and united, not listed."""
    audit, total, top = Audit(), np.zeros(len(nodes), np.int64), np.arange(len(nodes) + len(members))
    for i, j in links(graph, members, _unit(raw), least, audit):
        other = nodes[i] != own[j]
        i, j = i[other], j[other]
        total += np.bincount(i, size[j], len(nodes)).astype(np.int64)
        _unite(top, i, len(nodes) + j)
    some, names, low = np.flatnonzero(total), np.concatenate((nodes, own)), np.flatnonzero(top != np.arange(len(top)))
    zero = np.zeros(len(some), np.int64)
    parts = [(np.zeros(len(some), np.int64), nodes[some], zero, total[some], zero)]
    parts.append((np.ones(len(low), np.int64), names[low], names[top[low]], *[np.zeros(len(low), np.int64)] * 2))
    parts.append(tuple(np.array([x]) for x in (2, audit.queries, audit.first, audit.links, audit.found)))
    kind, *rest = (np.concatenate(c) for c in zip(*parts, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), *map(pa.array, rest)], names=["kind", "a", "b", "n", "m"])


def _visits(least: float):
    """Sorted by part, shard and lane, a graph (slice -1) before the slices that are searched in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for b in batches:
            for r in range(b.num_rows):
                part, shard, lane, slice_ = (b.column(c)[r].as_py() for c in range(4))
                nodes, counts = (b.column(c)[r].values.to_numpy() for c in (4, 5))
                raw = np.frombuffer(b.column(6)[r].as_py()).reshape(len(nodes), -1)
                if slice_ < 0:
                    at, held = (part, shard, lane), (Graph.load(b.column(7)[r].as_py(), _unit(raw)), _unit(raw), nodes, counts)
                elif at == (part, shard, lane):
                    yield _visit(*held, nodes, raw, least)
        give_back()

    return run


def embedding_duplicates(vectors: DataFrame, least: float = 0.93, shard: int = SHARD) -> DataFrame:
    """(vec_id, n_links, component_id, audit_recall) for every row of ``vectors`` (vec_id, embedding, label; others are ignored).

    Vectors of equal, non-null label and equal length are linked when their cosine in double precision is at least
    ``least``; vectors that are null, empty, zero or hold null or non-finite parts, or whose label is null, are linked
    with nothing.  Equal vectors of a label are one node, so a common vector costs one search, and are linked with each
    other; n_links counts every other row.  A label's nodes are dealt to shards by hash; each shard has one graph,
    written as a row, and every slice of the label's nodes visits every shard: the slices are sent to the graphs, and a
    graph is sent to one task for ``SERVED`` shards' slices.  A vector's links are those its own searches find.
    component_id is the least vec_id reachable (nulls last); audit_recall is the share of the audited queries' links
    that were found, null where they have none.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    work = work_dir(spark, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", F.monotonically_increasing_id().alias("row"), F.coalesce(fine, F.lit(False)).alias("fine"), v.alias("vector"), F.concat_ws("/", F.col("label").cast("string"), F.size("embedding").cast("string")).alias("part"))
    rows = staged(rows.withColumn("key", F.sha2(F.concat_ws(" ", "part", F.concat_ws(",", F.col("vector").cast("array<string>"))), 256)), f"{work}/rows")
    total = rows.count()
    nodes = rows.where("fine").groupBy("key").agg(first_of("vec_id", "row").alias("first"), F.first("part").alias("part"), F.first("vector").alias("vector"), F.count("*").alias("n"))
    nodes = staged(nodes.select("key", "part", "vector", "n", F.col("first.row").alias("node"), F.col("first.vec_id").alias("node_id")), f"{work}/nodes")
    parts = staged(nodes.groupBy("part").agg(F.count("*").alias("m")).withColumn("shards", F.ceil(F.col("m") / shard)).withColumn("lanes", F.ceil(F.col("shards") / SERVED)), f"{work}/parts")
    sums = parts.agg(F.sum("shards").alias("shards"), F.sum(F.col("shards") * F.col("lanes")).alias("units")).first()
    dealt = join_weighted(nodes.select("part", "key", "node", "n", "vector"), parts.select("part", "m", "shards"), ["part"], "m", total).withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")))
    dealt = dealt.select("part", "shard", "shards", "node", "n", "vector").repartition(min(MOST_TASKS, max(1, sums["shards"] or 0)), "part", "shard", "shards")
    built = staged(dealt.groupBy("part", "shard", "shards").applyInArrow(_build, BUILT), f"{work}/graphs")
    lanes = F.ceil(F.col("shards") / SERVED)
    graphs = built.where("slice < 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), lanes - 1)).alias("lane"), F.col("shard").alias("at"))
    slices = built.where("slice >= 0").select("*", F.pmod(F.xxhash64("shard", "slice"), lanes).alias("lane"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("at"))
    met = graphs.unionByName(slices).select("part", "at", "lane", "slice", "nodes", "counts", "raw", "graph")
    met = met.repartition(min(MOST_TASKS, max(1, sums["units"] or 0)), "part", "at", "lane").sortWithinPartitions("part", "at", "lane", "slice")
    found = staged(met.mapInArrow(_visits(least), FOUND), f"{work}/found")
    seen = found.where("kind = 2").agg(F.sum("n").alias("links"), F.sum("m").alias("found")).first()
    labels = components(found.where("kind = 1").select("a", "b"), f"{work}/components")
    counted = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    known = staged(nodes.select("key", "node", "node_id", "n").join(counted, "node", "left").join(labels, "node", "left").select("key", "node_id", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("label", "node").alias("label")), f"{work}/known")
    best = staged(known.groupBy("label").agg(F.min("node_id").alias("component_id"), F.count("*").alias("m")), f"{work}/best")
    named = staged(join_weighted(known, best, ["label"], "m", total).select("key", "n", "n_links", "component_id"), f"{work}/named")
    out = join_weighted(rows.where("fine").select("vec_id", "key"), named, ["key"], "n", total).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("audit_recall", F.lit(seen["found"] / seen["links"] if seen["links"] else None).cast("double"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op2 over ``embeddings``; rows as ``embedding_duplicates`` says, ``kept`` is null for a null vec_id."""
    found = embedding_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"), "audit_recall")
