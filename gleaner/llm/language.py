"""Language ID: bit-sliced Bloom filters give all languages that contain an n-gram; corrected popcounts decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import slices, staged, work_dir
from gleaner.llm.labelled import remainder
from gleaner.llm.words import mix

#: Letters and spaces of an n-gram, hashes of a filter, bits of a filter for each n-gram of the largest language.
SIZE, HASHES, BITS = 6, 2, 16
#: Most slots of the filters (powers of two), which bounds what is broadcast; fuller filters hold every n-gram as well,
#: and their false positives are deducted.  Slots that one task sets.
MOST, RANGE = 26, 1 << 18
CHUNK = 2_000_000
_letters: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x10000)]))
    out = _letters[0][np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        out[high] = [chr(c).isalpha() for c in points[high].tolist()]
    return out


def ngrams(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of texts lo..hi: (lo, hi, hash of each n-gram, text of each n-gram), a chunk of texts at a time.

    Letters are in lower case, each run of other characters is one space, and two spaces stand at either end, so any text
    with a letter has an n-gram.
    """
    lo = 0
    while lo < len(texts):
        hi, size, parts = lo, 0, []
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= CHUNK):
            parts.append((texts[hi] or "").lower())
            size += len(parts[-1])
            hi += 1
        p = np.frombuffer("\0".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        end = p == 0
        if len(parts) > 1 and int(end.sum()) != len(parts) - 1:  # a text holds a zero character
            p = np.frombuffer("\0".join(x.replace("\0", " ") for x in parts).encode("utf-32-le", "surrogatepass"), np.uint32)
            end = p == 0
        elif len(parts) == 1:
            end = np.zeros(len(p), bool)
        word = _is_letter(p)
        of = np.cumsum(end)
        edge = ~word & ~end
        keep = word | end | (edge & ~np.concatenate(([False], edge[:-1])))
        q, word, end, of = np.where(word, p, 32)[keep], word[keep], end[keep], of[keep]
        # ends become four spaces (two of either text); spaces beside them are harmless
        times = np.where(end, 4, 1)
        at = np.concatenate((np.zeros(2, int), np.repeat(np.arange(len(q)), times), np.zeros(2, int)))
        if len(q):
            c, t = q[at].astype(np.uint64), of[at]
            real = word[at]
            c[:2] = c[-2:] = 32
            real[:2] = real[-2:] = False
            t[-2:] = of[-1]
            if end.any():
                first = np.cumsum(times)[end] - 4 + 2
                for i in (0, 1):
                    t[first + i] -= 1
            with np.errstate(over="ignore"):
                n = len(c) - SIZE + 1
                h, some, same = np.zeros(n, np.uint64), np.zeros(n, bool), np.ones(n, bool)
                for i in range(SIZE):
                    h = h * np.uint64(0x100000001B3) + c[i : i + n]
                    some |= real[i : i + n]
                    same &= t[i : i + n] == t[:n]
                use = some & same
                yield lo, hi, mix(h[use] + np.uint64(0x9E3779B97F4A7C15)), t[:n][use]
        else:
            yield lo, hi, np.zeros(0, np.uint64), np.zeros(0, int)
        lo = hi


class Filters:
    """Bloom filters of all languages, sliced by bit: for each slot, a row of language bits.

    ``table`` has the bits of languages 8 i to 8 i + 7 of each slot in column i.
    """

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table, self.slots = languages, table, len(table)
        fill = np.array([np.count_nonzero(table[:, i // 8] >> (i % 8) & 1) for i in range(len(languages))]) / max(1, self.slots)
        self.false = np.minimum(fill**HASHES, 1 - 1e-9)  # how often an n-gram that a filter does not hold seems to be in it

    def query(self, h: np.ndarray) -> np.ndarray:
        """The language bits (bytes) of each n-gram: one row of the table for each hash, and-ed."""
        out = None
        for s in places(h, self.slots):
            out = self.table[s] if out is None else out & self.table[s]
        return out

    def containing(self, h: np.ndarray) -> list[set[str]]:
        """All languages that contain each n-gram, and those that falsely seem to."""
        return [{k for i, k in enumerate(self.languages) if row[i // 8] >> (i % 8) & 1} for row in self.query(h)]

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        for lo, hi, h, of in ngrams(texts):
            n = np.bincount(of, minlength=hi - lo)[: hi - lo].astype(float)
            if not self.languages or not len(h):
                continue
            bits, hits = self.query(h), np.zeros((hi - lo, len(self.languages)))
            for i in range(len(self.languages)):
                hits[:, i] = np.bincount(of[(bits[:, i // 8] >> (i % 8) & 1).astype(bool)], minlength=hi - lo)[: hi - lo]
            # of n n-grams that are not in a filter, n * false seem to be
            true = np.clip((hits - n[:, None] * self.false) / (1 - self.false), 0, None)
            best = np.argmax(true, axis=1)
            share = true[np.arange(hi - lo), best] / np.maximum(n, 1)
            for i in np.flatnonzero(n).tolist():
                names[lo + i], scores[lo + i] = self.languages[best[i]], min(1.0, share[i])
        return names, scores


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def add(lang: str, h: np.ndarray, n: np.ndarray) -> None:
        old = held.get(lang)
        if old is not None:
            h, n = np.concatenate((old[0], h)), np.concatenate((old[1], n))
            h, inv = np.unique(h, return_inverse=True)
            n = np.bincount(inv, n).astype(np.int64)
        held[lang] = [h, n]

    for b in batches:
        langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lang in sorted(set(langs)):
            for _, _, h, _ in ngrams([t for t, k in zip(texts, langs, strict=True) if k == lang]):
                add(lang, *np.unique(h, return_counts=True))
    for lang, (h, n) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def places(h: np.ndarray, slots: int) -> list[np.ndarray]:
    """The slots of each n-gram (``slots`` is a power of two)."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return [((h + np.uint64(i) * step) & np.uint64(slots - 1)).astype(np.int64) for i in range(HASHES)]


def fit(docs: DataFrame, learn=None) -> Filters:
    """Filters of all n-grams of all documents that ``learn`` (a condition on doc_id) admits and whose lang is known.

    The cluster counts n-grams and sets the bits, ``RANGE`` slots a task; the driver holds one row a language and the
    filters, ``BITS`` bits an n-gram of the largest language and at most 2 ** ``MOST`` bytes for eight languages.
    """
    work = work_dir(docs.sparkSession, "language")
    rows = docs.where(F.lit(True) if learn is None else learn).select(F.col("lang").cast("string").alias("lang"), "text").where("lang is not null and text is not null")
    grams = staged(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), f"{work}/grams")
    known = [(r["lang"], r["n"], r["grams"]) for r in grams.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("grams")).collect()]
    known.sort(key=lambda r: (-r[1], r[0]))
    slots = 1 << min(MOST, max(10, math.ceil(math.log2(BITS * max([1, *(r[2] for r in known)])))))
    width = max(1, -(-len(known) // 8))
    number = docs.sparkSession.createDataFrame([(r[0], i) for i, r in enumerate(known)], "lang string, number int")

    def set_bits(table: pa.Table) -> pa.Table:
        at = table.column("at")[0].as_py()
        out = np.zeros((min(RANGE, slots), width), np.uint8)
        out[table.column("slot").to_numpy() - at * RANGE, table.column("byte").to_numpy()] = table.column("bits").to_numpy()
        return pa.table({"at": [at], "bits": [out.tobytes()]})

    # both terms are below the number of slots, so that nothing overflows
    step = F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1)).bitwiseAND(F.lit(slots - 1))
    slot = F.array(*[(F.col("gram").bitwiseAND(F.lit(slots - 1)) + step * i).bitwiseAND(F.lit(slots - 1)) for i in range(HASHES)])
    byte, bit = F.floor(F.col("number") / 8).alias("byte"), F.expr("shiftleft(1, number % 8)").alias("bit")
    marks = grams.join(F.broadcast(number), "lang").select(byte, bit, F.explode(slot).alias("slot"))
    # a byte of a slot comes once, so that a task holds ``RANGE`` slots at most, however many n-grams there are
    marks = marks.groupBy("slot", "byte").agg(F.bit_or("bit").alias("bits")).withColumn("at", F.floor(F.col("slot") / RANGE))
    table = np.zeros((slots, width), np.uint8)
    for r in marks.groupBy("at").applyInArrow(set_bits, "at long, bits binary").collect():  # the filters, whose size is bounded
        part = np.frombuffer(r["bits"], np.uint8).reshape(-1, width)
        table[r["at"] * RANGE : r["at"] * RANGE + len(part)] = part
    return Filters([r[0] for r in known], table)


def languages(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` (doc_id, text; others are ignored).

    ``und`` and 0 where the text is null or has no letter, or no language was learnt; else the language with the most
    n-grams, false positives deducted (of equal ones, that with more text, then by name), and the share it contains.
    Whole texts count; repeated rows agree; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 2 ** MOST bytes at most for eight languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            names, scores = shared.value.decide(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op9: held_out is false for a null doc_id, which is not learnt from; else as ``languages`` says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = languages(docs, fit(docs, remainder(3) != 1))
    return found.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
