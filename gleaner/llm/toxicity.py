"""Toxicity: nearest labelled examples by exact TF-IDF cosine through a block-max inverted index over all their words."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import give_back, slices
from gleaner.llm.labelled import chance, logistic, remainder, sample

#: Labelled examples of either label (the bound of the classifier's sample), and neighbours that vote.
EXAMPLES, NEIGHBOURS = 4096, 16
#: Log-likelihood ratio with the label at which a word's factor for it counts half.
WEAK = 10.0
#: Search: examples of a block, weights of the common words' table, texts searched at once, what single precision may lose.
BLOCK, TABLE, TEXTS, SLACK = 64, 1 << 23, 64, 1e-5
_WORD = re.compile(r"[^\W\d_]+")
#: Words in a worker's cache, which is emptied when full and after each task; that changes no result.
CACHE = 65_536
#: Words of least hash by which near copies among the examples are told.
SKETCH = 16


def _tells(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What being in ``a`` of n[1] and ``b`` of n[0] examples tells of the label: the log-likelihood ratio, less for weak ones.

    The label that has more of a word is counted one less: what a word tells of an example must come from another one.
    """
    if min(n) == 0:
        return np.zeros(len(a))
    share = n[1] / n.sum()
    more = a >= share * (a + b)
    a, b = np.maximum(0.0, a - more), np.maximum(0.0, b - ~more)
    both = np.maximum(1.0, a + b)

    def part(x, e):
        return x * np.log(np.maximum(x, 1e-300) / e)

    g = np.maximum(0.0, 2 * (part(a, both * share) + part(b, both * (1 - share))))
    return g * g / (g + WEAK)


def _spread(first: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of the lists ``t``, list after list, and the lists' sizes."""
    size = first[t + 1] - first[t]
    return np.repeat(first[t] - np.cumsum(size) + size, size) + np.arange(size.sum()), size


class BlockMax:
    """Postings of examples in blocks of ``BLOCK``, with each common word's greatest weight in each block.

    A text's bound in a block is the sum of the common words' greatest weights, times its own, and of the greatest sum of
    rare words' weights that an example of the block has: lists of rare words are shorter than a row of blocks, so
    they are read whole.  Blocks are opened from the greatest bound on, until none can hold a better example than the
    k found.
    """

    def __init__(self, first: np.ndarray, at: np.ndarray, weight: np.ndarray, n: int):
        df = np.diff(first)
        self.blocks = -(-n // BLOCK)
        top = np.argsort(-df, kind="stable")[: TABLE // max(1, n)]
        self.row = np.full(len(df), -1, np.int32)
        self.row[top] = np.arange(len(top))
        self.table = np.zeros((self.blocks, len(top), BLOCK), np.float32)  # block after block
        for i, t in enumerate(top.tolist()):
            own = at[first[t] : first[t + 1]]
            self.table[own // BLOCK, i, own % BLOCK] = weight[first[t] : first[t + 1]]
        self.most = np.ascontiguousarray(self.table.max(axis=2).T)
        rare = np.repeat(self.row < 0, df)  # the lists of common words are in the table
        self.at, self.weight = at[rare], weight[rare]
        self.first = np.concatenate(([0], np.cumsum(np.where(self.row < 0, df, 0))))

    def search(self, some: list[tuple[np.ndarray, np.ndarray]], k: int, skips: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
        """Cosines (text x example) in single precision, -1 where a block was not opened; for each text, what its k nearest
        reach at least; and how many blocks were opened."""
        b = len(some)
        q, score = np.zeros((b, len(self.most)), np.float32), np.zeros((b, self.blocks * BLOCK), np.float32)
        for i, (t, w) in enumerate(some):
            r = self.row[t]
            common = r >= 0
            q[i, r[common]] = w[common]
            place, size = _spread(self.first, t[~common])
            score[i] = np.bincount(self.at[place], np.repeat(w[~common], size) * self.weight[place], score.shape[1])
        rare = score.reshape(b, self.blocks, BLOCK)
        bound = q @ self.most + rare.max(axis=2) + np.float32(SLACK)
        out = np.full(rare.shape, -1.0, np.float32)
        flat = out.reshape(b, self.blocks * BLOCK)
        shut, least, step, opened = bound > 2 * SLACK, np.full(b, SLACK / 2, np.float32), 2, 0
        skipped = [(i, s) for i, s in enumerate(skips) if s >= 0]
        while True:
            may = shut & (bound >= least[:, None])
            if not may.any():
                return flat, least, opened
            best = None
            if step < self.blocks:  # of each text the best blocks first: they raise what others must reach
                best = np.argpartition(bound, -step, axis=1)[:, -step:]
                first = np.zeros_like(may)
                np.put_along_axis(first, best, True, axis=1)
                may &= first
            shut &= ~may
            opened += int(may.sum())
            for at in np.flatnonzero(may.any(axis=0)).tolist():
                own = np.flatnonzero(may[:, at])
                out[own, at] = rare[own, at] + q[own] @ self.table[at]
            for i, s in skipped:
                flat[i, s] = -1.0
            if best is not None and step * BLOCK > k:
                some_scores = np.take_along_axis(out, best[:, :, None], axis=1).reshape(b, -1)
                least = np.maximum(least, np.partition(some_scores, -k, axis=1)[:, -k] - 2 * np.float32(SLACK))
            step *= 4


def _clusters(first: np.ndarray, ids: np.ndarray, weight: np.ndarray, words: int, dim: int = 128, rounds: int = 8) -> np.ndarray:
    """An order of the examples in which like ones stand together: k-means over hashed vectors, then a walk by likeness."""
    n, rng = len(first) - 1, np.random.default_rng(1)
    k = max(1, n // BLOCK)
    spot, sign = rng.integers(0, dim, words), rng.choice(np.array([-1.0, 1.0], np.float32), words)
    x = np.zeros((n, dim), np.float32)
    for i, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        x[i] = np.bincount(spot[ids[lo:hi]], weight[lo:hi] * sign[ids[lo:hi]], dim)
    centre = x[rng.choice(n, k, replace=False)] if n else x
    own = np.zeros(n, np.int64)
    for _ in range(rounds if k > 1 else 0):
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
        own = np.argmax(x @ centre.T, axis=1)
        centre = np.zeros_like(centre)
        np.add.at(centre, own, x)
    left, walk = list(range(1, k)), [0]
    while left:
        walk.append(left.pop(int(np.argmax(centre[left] @ centre[walk[-1]]))))
    place = np.empty(k, np.int64)
    place[walk] = np.arange(k)
    return np.argsort(place[own], kind="stable")


class Index:
    """TF-IDF vectors of labelled examples over all their words; scores texts by their nearest examples.

    A word weighs its idf times 1 and what it tells of the label, so that words of one label lead and no word is left out.
    Words are sorted 64-bit hashes; vectors are kept by word (for the search) and by example.  Examples that can be among
    the nearest are compared in full: the result is exactly the k largest cosines (of equal ones, the least doc_ids).
    """

    def __init__(self, examples: list[tuple[int, int, str]], many: dict[int, int], k: int = NEIGHBOURS):
        self.k, self.known, self.terms, self.search = k, {}, None, None
        y = np.array([e[1] for e in examples], int)
        n = np.bincount(y, minlength=2).astype(float)
        self.weight = np.array([max(1, many.get(i, 0)) / max(1.0, n[i]) for i in (0, 1)])  # an example stands for so many rows
        # copies and near copies, whose words of least hash agree, count once, or every word of theirs would go with the label
        once = np.zeros(len(examples), bool)
        once[list({(e[1], self._sketch(e[2])): i for i, e in reversed([*enumerate(examples)])}.values())] = True
        # arrays of the examples' words are as narrow as can be and few at a time: the driver holds them
        counted = [(t, c.astype(np.uint16)) for t, c in (self._counts(e[2]) for e in examples)]
        size = np.array([len(t) for t, _ in counted], np.int64)
        hashed = np.concatenate([t for t, _ in counted]) if examples else np.zeros(0, np.uint64)
        tf = np.concatenate([c for _, c in counted]) if examples else np.zeros(0, np.uint16)
        del counted
        self.known.clear()
        self.terms, ids = np.unique(hashed, return_inverse=True)
        ids = ids.astype(np.int32)
        del hashed
        first = np.concatenate(([0], np.cumsum(size)))
        df, of = np.bincount(ids, minlength=len(self.terms)), np.repeat(once, size)
        toxic = np.repeat(y == 1, size)
        seen = [np.bincount(ids[of & (toxic == (i == 1))], minlength=len(self.terms)) for i in (0, 1)]  # an example names a word once
        del of, toxic
        self.idf = (np.log((1 + len(examples)) / (1 + df)) + 1) * (1 + _tells(seen[1], seen[0], np.bincount(y[once], minlength=2)))
        del seen
        w = np.empty(len(ids), np.float32)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            w[lo:hi] = self._vector((ids[lo:hi], tf[lo:hi].astype(float)))[1]
        del tf
        full = np.flatnonzero(size)  # examples without a word are near nothing
        order = full[_clusters(np.append(first[full], first[-1]), ids, w, len(self.terms))]
        take = _spread(first, order)[0]
        self.ids, self.y = np.array([examples[i][0] for i in order], np.int64), y[order]
        self.first, self.of, self.by_example = np.concatenate(([0], np.cumsum(size[order]))), ids[take], w[take]
        at = np.repeat(np.arange(len(order), dtype=np.uint16 if len(order) < 1 << 16 else np.int32), size[order])
        by_word = np.argsort(self.of, kind="stable")
        self.postings = np.concatenate(([0], np.cumsum(df))), at[by_word], self.by_example[by_word]
        del by_word, at, take, ids, w
        # calibration: each example is judged by the others
        cut = self.first.tolist()
        rows = [(self.of[a:b], self.by_example[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
        votes = np.array([self._vote(*x) for x in self._nearest(rows, [*range(len(rows))])])
        self.search = None
        # one row of either label that its neighbours agree on is added, so that the line rises where all examples are alike
        w = np.append(self.weight[self.y], [1.0, 1.0])
        self.line = logistic(np.append(votes, [0.0, 1.0])[:, None], np.append(self.y, [0.0, 1.0]), w, ridge=1e-4) if len(full) and n.min() > 0 else None
        empty = np.flatnonzero(size == 0)
        w = self.weight[y[empty]]
        total = self.weight[y].sum() if len(y) else 1.0
        prior = float((self.weight[y] * y).sum() / total) if len(y) else 0.0
        self.nothing = float(((w * y[empty]).sum() + prior) / (w.sum() + 1)) if len(empty) else prior

    @staticmethod
    def _sketch(text: str) -> tuple | str:
        """The words of least hash; the text itself if it has fewer than twice as many different words."""
        own = {zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in _WORD.findall(text.lower())}
        return tuple(sorted(own)[:SKETCH]) if len(own) >= 2 * SKETCH else text

    def _counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The index's words in a text, by number, and how often each is there; all words, by hash, while fitting."""
        words = Counter(_WORD.findall(text.lower())) if text else {}
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            h = np.array([zlib.crc32(b) << 32 | zlib.adler32(b) for w in new for b in (w.encode("utf-8", "surrogatepass"),)], np.uint64)
            if self.terms is not None:
                at = np.searchsorted(self.terms, h)
                h = np.where(self.terms[np.minimum(at, len(self.terms) - 1)] == h, at, -1) if len(self.terms) else np.full(len(h), -1)
            known.update(zip(new, h.tolist(), strict=True))
        if self.terms is None:
            t = np.fromiter((known[w] for w in words), np.uint64, len(words))
            c = np.fromiter(words.values(), np.int64, len(words))
            t, inverse = np.unique(t, return_inverse=True)  # words of one hash are one word
            out = t, np.minimum(np.bincount(inverse, c, len(t)), 65_535).astype(np.int64)
        else:
            t, c = np.fromiter((known[w] for w in words), np.int64, len(words)), np.fromiter(words.values(), np.int64, len(words))
            t, inverse = np.unique(t[t >= 0], return_inverse=True), c[t >= 0]
            out = t[0], np.bincount(t[1], inverse, len(t[0])).astype(np.int64)
        if len(known) > CACHE:
            known.clear()
        return out

    def _vector(self, counts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        t, c = counts
        w = (1 + np.log(c)) * self.idf[t] if len(t) else np.zeros(0)
        return t, w / np.linalg.norm(w) if len(t) else w

    def _nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], skips: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and cosines of the k examples nearest each vector, best first; only examples that share a word count."""
        if self.search is None:
            self.search, self.dense, self.opened = BlockMax(*self.postings, len(self.ids)), np.zeros(len(self.terms)), 0
        dense = self.dense
        for lo in range(0, len(vectors), TEXTS):
            some = vectors[lo : lo + TEXTS]
            rough, least, opened = self.search.search(some, self.k, skips[lo : lo + TEXTS] if skips else [-1] * len(some))
            self.opened += opened
            for (t, w), score, reach in zip(some, rough, least, strict=True):
                may = np.flatnonzero(score >= reach)
                if len(may) > self.k:
                    may = may[score[may] >= np.partition(score[may], -self.k)[-self.k] - 2 * SLACK]
                # the few that can be among the k are compared again in full precision
                dense[t] = w
                own = [slice(x, z) for x, z in zip(self.first[may].tolist(), self.first[may + 1].tolist(), strict=True)]
                exact = np.array([dense[self.of[x]] @ self.by_example[x] for x in own])
                dense[t] = 0.0
                order = np.lexsort((self.ids[may], -np.round(exact, 12)))[: self.k]
                yield may[order], exact[order]

    def forget(self) -> None:
        """Give back a worker's cache and table, which would stand beside the next stage's memory: Spark keeps its workers."""
        self.known.clear()
        self.search = None
        give_back()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "search": None, "dense": None}

    def _vote(self, at: np.ndarray, cos: np.ndarray) -> float:
        """The share of toxic among the neighbours, each weighing the less the farther it is, and for the rows it stands for."""
        if not len(at):
            return 0.5
        w = self.weight[self.y[at]] / (0.001 + np.maximum(0.0, 1 - cos))
        return float((w * self.y[at]).sum() / w.sum())

    def scores(self, texts: list[str | None]) -> Iterator[tuple[float, list[int], list[float]]]:
        """Chance that the label is 1, and the nearest three examples with their cosines, of each text."""
        for lo in range(0, len(texts), TEXTS):
            vectors = [self._vector(self._counts(t)) for t in texts[lo : lo + TEXTS]]
            if self.line is None:
                yield from [(self.nothing, [], [])] * len(vectors)
                continue
            for at, cos in self._nearest(vectors):
                p = float(chance(self.line, np.array([[self._vote(at, cos)]]))[0]) if len(at) else self.nothing
                yield p, self.ids[at[:3]].tolist(), cos[:3].tolist()


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in slices(batches):
            rows = [*index.scores(b.column(1).to_pylist())]
            p, near, cos = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(p, pa.float64()), pa.array(near, pa.list_(pa.int64())), pa.array(cos, pa.list_(pa.float64()))], names=["doc_id", "score", "evidence", "similarity"])
        index.forget()

    return run


def fit(docs: DataFrame, labels: DataFrame, learn=None, examples: int = EXAMPLES) -> Index:
    """An index of up to ``examples`` rows of either label; ``learn`` is a condition on doc_id."""
    return Index(*sample(docs, labels, "toxic", F.lit(True) if learn is None else learn, examples))


def toxicity(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, score, evidence, similarity) for every row of ``docs`` (doc_id, text; others are ignored).

    Null and empty texts, and texts without any word of an example, get the share of toxic among labelled examples
    without words, and no evidence.  Scores depend on the text alone, so repeated rows agree.  Without examples of both
    labels every score is that share.  An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by EXAMPLES and the length of their texts
    return docs.select("doc_id", "text").mapInArrow(_score(shared), "doc_id long, score double, evidence array<long>, similarity array<double>")


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``least``, with all columns; needs nothing of the doc_id.

    Rows with null or empty texts score as ``toxicity`` says and so stay unless most labelled rows without words are
    toxic; repeated rows stay or go together; an empty table, or one without labels of both kinds, loses nothing but
    what that share of toxic decides.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            text = b.column(b.schema.get_field_index("text"))
            yield b.filter(pa.array([p < least for p, _, _ in shared.value.scores(text.to_pylist())], pa.bool_()))
        shared.value.forget()

    return docs.mapInArrow(run, schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op1: held_out is false for a null doc_id, which no label names; else as ``toxicity`` says."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity(docs, fit(docs, labels, remainder(5) != 0))
    return scored.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "similarity")
