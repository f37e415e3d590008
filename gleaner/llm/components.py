"""Connected components of a distributed edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import staged


def components(edges: DataFrame, work: str) -> DataFrame:
    """``edges`` (a, b: long) -> (node, label), label the least node that is reachable; nodes that are the least of
    their component have no row.  Self links, nulls and repeated edges are ignored; no edges give no rows.

    Every node that has a smaller neighbour points at its smallest one (a forest, since pointers descend), pointers
    are doubled until they rest on roots, and edges are rewritten between roots; that repeats until none is left.
    Each round is a table in the shared folder, so nothing is collected and lineage stays short.
    """

    def ordered(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    e, labels, k = staged(ordered(edges), f"{work}/edges-0"), None, 0
    while not e.isEmpty():
        parent = staged(e.groupBy("a").agg(F.min("b").alias("p")), f"{work}/parents-{k}-0")
        j = 0
        while True:
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
            if parent.join(up, "p", "left_semi").isEmpty():
                break
            j += 1
            parent = staged(parent.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p")), f"{work}/parents-{k}-{j}")
        to = parent.select(F.col("a").alias("b"), F.col("p").alias("q"))
        e = staged(ordered(e.join(parent, "a").join(to, "b", "left").select(F.col("p").alias("a"), F.coalesce("q", "b").alias("b"))), f"{work}/edges-{k + 1}")
        if labels is not None:
            moved = labels.join(parent.select(F.col("a").alias("p"), F.col("p").alias("q")), "p", "left")
            parent = staged(moved.select("a", F.coalesce("q", "p").alias("p")).unionByName(parent), f"{work}/labels-{k}")
        labels, k = parent, k + 1
    return (e.select("a", F.col("b").alias("p")) if labels is None else labels).toDF("node", "label")
