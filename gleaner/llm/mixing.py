"""Mixing sources to target weights: blocks of words, drawn per output shard and mapped by pseudorandom permutations.

Each source's words, in a fixed order of its documents, are cut into blocks of ``BLOCK`` words.  The mix is a row of slots in
output shards of ``SLOTS``; how many slots of a shard each source has is a multinomial draw, conditioned on the totals that
the targets fix.  A source's slots are numbered on through all shards, and its k-th slot takes block perm(k mod blocks) of
pass k div blocks, where every pass has its own pseudorandom permutation.  Slots and blocks are joined by index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from gleaner.llm.common import MOST_TASKS, SPACE, WORD, staged, work_dir

BLOCK, SLOTS, WEIGHTS, MOST = 256, 4096, (5, 2, 1), 3
#: Documents of four ranges: what a task numbers is a quarter of it.
BUCKET = 20_000


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the sum of sizes by weight; one that would exceed ``most`` times its size stops there and the excess
    is shared anew, by weight, among the others, until none is above."""
    out, free, rest = [0.0] * len(sizes), {i for i in range(len(sizes))}, float(sum(sizes))
    while free:
        total = sum(weights[i] for i in sorted(free))
        over = {i for i in free if rest * weights[i] / total > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = rest * weights[i] / total
            break
        for i in sorted(over):
            out[i] = float(most * sizes[i])
            rest -= out[i]
        rest, free = max(0.0, rest), free - over
    return out


def _round(seed: int, source: int, turn: int, i: int) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(f"{seed}/{source}/{turn}/{i}".encode(), digest_size=8).digest(), "little"))


def permute(x: np.ndarray, n: int, seed: int, source: int, turn: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 (or its inverse): a Feistel network whose values beyond n walk on."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, keys = np.uint64((1 << half) - 1), [_round(seed, source, turn, i) for i in range(4)]
    x, todo = x.astype(np.uint64), np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            a, b = x[todo] >> np.uint64(half), x[todo] & mask
            for key in keys[::-1] if back else keys:
                f = b if not back else a
                f = (f ^ key) * np.uint64(0x9E3779B97F4A7C15)
                f = ((f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)
                a, b = (b ^ (f & mask), a) if back else (b, a ^ (f & mask))
            x[todo] = (a << np.uint64(half)) | b
            todo = todo[x[todo] >= n]
    return x.astype(np.int64)


@dataclass(frozen=True)
class Quota:
    """A source's part of the mix: words and blocks it has, slots it gets, words of its last slot."""

    number: int
    size: int
    blocks: int
    slots: int
    last: int


def quota(number: int, size: int, target: float, seed: int, block: int = BLOCK) -> Quota:
    """As many slots as hold the target's words; the last one is cut to meet it."""
    blocks, want = -(-size // block), round(target)
    if not size or not want:
        return Quota(number, size, blocks, 0, 0)
    turns, rest = divmod(want, size)
    if not rest:
        turns, rest = turns - 1, size
    short = blocks * block - size  # that the last block lacks
    at = int(permute(np.array([blocks - 1]), blocks, seed, number, turns, back=True)[0])
    held = lambda j: j * block - (short if at < j else 0)  # noqa: E731  words of the first j slots of this pass
    j = -(-rest // block)
    j += held(j) < rest
    return Quota(number, size, blocks, turns * blocks + j, rest - held(j - 1))


def _halve(rng: np.random.Generator, counts: list[int], n: int) -> list[int]:
    """How many of n drawn slots each source has, of ``counts`` slots in all; from 1e9 slots on, where the exact draw is
    not to be had, by the normal approximation."""
    out, total = [], sum(counts)
    for c in counts:
        if n <= 0 or c <= 0:
            k = 0
        elif total < 10**9:
            k = int(rng.hypergeometric(c, total - c, n)) if total > c else n
        else:
            mean = n * (c / total)
            k = round(rng.normal(mean, max(0.0, mean * (1 - c / total) * (1 - n / total)) ** 0.5))
        k = min(max(k, n - (total - c)), c, n)
        out.append(k)
        total, n = total - c, n - k
    return out


def shard_counts(quotas: list[Quota], lo: int, hi: int, seed: int, slots: int = SLOTS) -> Iterator[tuple[int, list[int], list[int]]]:
    """(shard, first slot number of each source, slots of each source) for shards lo..hi-1.

    The totals are divided by seeded draws at each half of the row of shards, so any task finds its own shards' counts without the
    others.
    """
    total = sum(q.slots for q in quotas)
    shards = -(-total // slots)

    def down(a: int, b: int, before: list[int], counts: list[int]) -> Iterator[tuple[int, list[int], list[int]]]:
        if b <= lo or a >= hi:
            return
        if b - a == 1:
            yield a, before, counts
            return
        mid = (a + b) // 2
        rng = np.random.default_rng([seed, a, b])
        left = _halve(rng, counts, min(mid * slots, total) - a * slots)
        yield from down(a, mid, before, left)
        yield from down(mid, b, [x + y for x, y in zip(before, left, strict=True)], [x - y for x, y in zip(counts, left, strict=True)])

    if shards:
        yield from down(0, shards, [0] * len(quotas), [q.slots for q in quotas])


DRAWN = "shard long, slot int, number int, turn int, block long, words int"


def _draw(quotas: list[Quota], seed: int, block: int, slots: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"].tolist():
                for _, before, counts in shard_counts(quotas, shard, shard + 1, seed, slots):
                    parts = []
                    for q, k, c in zip(quotas, before, counts, strict=True):
                        i = np.arange(k, k + c)
                        turn = i // max(1, q.blocks)
                        b = np.zeros(c, np.int64)
                        for t in np.unique(turn):
                            b[turn == t] = permute(i[turn == t] % q.blocks, q.blocks, seed, q.number, int(t))
                        words = np.where(b == q.blocks - 1, q.size - (q.blocks - 1) * block, block)
                        words[i == q.slots - 1] = q.last
                        parts.append(pd.DataFrame({"number": q.number, "turn": turn, "block": b, "words": words}))
                    out = pd.concat(parts, ignore_index=True)
                    out = out.iloc[np.random.default_rng([seed, shard, 1]).permutation(len(out))]
                    out.insert(0, "slot", np.arange(len(out)))
                    out.insert(0, "shard", shard)
                    yield out

    return run


@dataclass
class Mix:
    """``rows``: the documents (as a struct, doc) with row, size, hash, number, source_size and target;
    ``slots``: the drawn blocks (shard, slot, number, turn, block, words); ``parts``: for each slot and document in it,
    the slot with row, and start and length of the words it takes of the document."""

    rows: DataFrame
    slots: DataFrame
    parts: DataFrame


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 17, block: int = BLOCK, slots: int = SLOTS, texts: bool = True) -> Mix:
    """Mix ``docs`` (doc_id, text, source and any other columns) so that sources share all words by weight.

    Sources in code-point order, null last, have ``weights`` in turn.  A document's size is its number of words; null and
    empty texts have none and are never taken.  No word is taken more than ``most`` times, so no document exceeds that many
    times its size.  A source's words are taken to its target exactly, rounded to a word.  Equal runs draw alike:
    documents are ordered by doc_id, size and text's hash; rows equal in all of these are interchangeable, and are
    numbered in ranges of rows like any others.  The driver and each drawing task hold one row for each source.  With ``texts`` the rows hold all columns of ``docs``, else doc_id and
    source only.  An empty table gives an empty mix.
    """
    spark = docs.sparkSession
    work = work_dir(spark, "mixing")
    own = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if texts else ["doc_id", "source"])])  # so no name of theirs clashes
    sized = docs.select(own.alias("doc"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("hash"))
    rows = staged(sized.select("*", F.monotonically_increasing_id().alias("row")), f"{work}/rows")
    found = rows.groupBy(F.col("doc.source").alias("source")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # one row for each source
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["size"] for r in found], [weights[i % len(weights)] for i in range(len(found))], most)
    quotas = [quota(i, r["size"], t, seed, block) for i, (r, t) in enumerate(zip(found, goal, strict=True))]
    total = sum(r["n"] for r in found)
    table = spark.createDataFrame([(r["source"], i, r["size"], t) for i, (r, t) in enumerate(zip(found, goal, strict=True))], "source string, number int, source_size long, target double")
    rows = rows.join(F.broadcast(table), F.col("doc.source").cast("string").eqNullSafe(F.col("source"))).drop("source")

    # the place of each document's first word: ranges of documents, sums before them, and running sums inside
    order = ["number", "doc_id", "size", "hash", "row"]
    narrow = rows.select("number", "doc.doc_id", "size", "hash", "row").repartitionByRange(min(MOST_TASKS, max(1, total // BUCKET * 4)), *order)
    narrow = staged(narrow.withColumn("part", F.spark_partition_id()), f"{work}/ranges")
    sums = narrow.groupBy("number", "part").agg(F.sum("size").alias("sum"))
    sums = sums.select("number", "part", (F.sum("sum").over(_window(["number"], "part")) - F.col("sum")).alias("before"))
    inside = F.sum("size").over(_window(["number", "part"], *order[1:])) - F.col("size")
    placed = narrow.withColumn("inside", inside).join(sums.hint("merge"), ["number", "part"]).select("row", "number", "size", (F.col("before") + F.col("inside")).alias("place"))
    placed = staged(placed, f"{work}/placed")

    shards = -(-sum(q.slots for q in quotas) // slots)
    drawn = spark.range(0, shards, 1, max(1, min(shards, 4 * spark.sparkContext.defaultParallelism))).mapInPandas(_draw(quotas, seed, block, slots), DRAWN)
    drawn = staged(drawn, f"{work}/slots")
    touched = F.sequence(F.floor(F.col("place") / block), F.floor((F.col("place") + F.col("size") - 1) / block))
    cut = placed.where("size > 0").withColumn("block", F.explode(touched))
    start = F.greatest(F.col("place"), F.col("block") * block)
    stop = F.least(F.col("place") + F.col("size"), F.col("block") * block + F.col("words"))
    parts = cut.hint("merge").join(drawn, ["number", "block"]).where(stop > start)
    parts = parts.select("shard", "slot", "turn", "row", (start - F.col("place")).alias("start"), (stop - start).alias("length"))
    return Mix(rows, drawn, parts)


def _window(by: list[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def taken_words(mixed: Mix) -> DataFrame:
    """(row, doc_id, size, source_size, target, taken) of every document, those of which nothing is taken too."""
    taken = mixed.parts.groupBy("row").agg(F.sum("length").alias("taken"))
    rows = mixed.rows.select("row", "doc.doc_id", "size", "source_size", "target")
    return rows.hint("merge").join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents with the columns of ``docs``: one row for each stretch of words that a pass over its source
    takes of a document.

    A document that a pass takes whole keeps its text; else the text is the stretch, its words joined by one space, and n_chars
    (where there is one) its length.  Documents without words are not taken.
    """
    mixed = mix(docs, **options)
    spans = mixed.parts.groupBy("row", "turn").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("spans"))
    # stretches that touch are one
    joined = F.expr(
        """aggregate(spans, cast(array() as array<struct<start:bigint,length:bigint>>), (a, s) ->
        case when size(a) > 0 and element_at(a, -1).start + element_at(a, -1).length = s.start
        then concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start as start, element_at(a, -1).length + s.length as length)))
        else concat(a, array(struct(s.start as start, s.length as length))) end)"""
    )
    spans = spans.select("row", F.explode(joined).alias("span"))
    out = mixed.rows.select("row", "doc", "size").hint("merge").join(spans, "row")
    words = F.filter(F.split("doc.text", SPACE), lambda w: w != "")
    text = F.when(F.col("span.length") == F.col("size"), F.col("doc.text")).otherwise(F.array_join(F.slice(words, (F.col("span.start") + 1).cast("int"), F.col("span.length").cast("int")), " "))
    out = out.select("doc", text.alias("text"))
    new = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    return out.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op3: one row for each row of ``documents``, as ``taken_words`` says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return taken_words(mix(docs, texts=False)).select("doc_id", "size", "source_size", "target", "taken")
