"""Quality by compression: zstandard dictionaries of good and bad text; what each saves is a calibrated score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import slices
from gleaner.llm.labelled import chance, logistic, remainder, sample

#: Labelled rows of either label that are learnt from (texts of up to LONGEST characters), bytes of a dictionary,
#: compression level.
ROWS, LONGEST, DICTIONARY, LEVEL = 4000, 32_768, 112_640, 3
#: A text is compressed in windows of so many bytes, so that the dictionaries tell as much of its end as of its start.
WINDOW = 1024


class Compressors:
    """Two dictionaries and the line from compressed sizes to a chance.

    Half of the sample (every other row by doc_id) makes the dictionaries, the other half the calibration, where each row
    stands for its label's share of all rows.
    """

    def __init__(self, rows: list[tuple[int, int, str]], many: dict[int, int]):
        texts = {(y, h): [t.encode() for i, (_, z, t) in enumerate(r for r in rows if r[1] == y) if i % 2 == h and t] for y in (0, 1) for z in (y,) for h in (0, 1)}
        self.raw = [self._train(texts[y, 0]) for y in (0, 1)]
        total = sum(many.values()) or 1
        self.prior = many.get(1, 0) / total if many else 0.5
        self.line, self._made = None, None
        x = np.array([self.feature(t) for y in (0, 1) for t in texts[y, 1]]).reshape(-1, 1)
        y = np.repeat([0.0, 1.0], [len(texts[0, 1]), len(texts[1, 1])])
        if len(set(y.tolist())) == 2:
            w = np.where(y > 0, many[1] / max(1, len(texts[1, 1])), many[0] / max(1, len(texts[0, 1])))
            self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
            self.line = logistic((x - self.mean) / self.scale, y, w)
        self._made = None

    @staticmethod
    def _train(texts: list[bytes]) -> bytes:
        size = min(DICTIONARY, sum(map(len, texts)) // 8)
        try:
            return zstandard.train_dictionary(size, texts, level=LEVEL).as_bytes()
        except (zstandard.ZstdError, ValueError):  # too few or too short texts: their bytes are the dictionary
            return b"\n".join(texts)[-DICTIONARY:]

    def _sizes(self, text: bytes) -> list[int]:
        if self._made is None:
            self._made = []
            for raw in self.raw:
                d = zstandard.ZstdCompressionDict(raw) if raw else None
                if d is not None:
                    d.precompute_compress(level=LEVEL)
                self._made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        parts = [text[i : i + WINDOW] for i in range(0, len(text), WINDOW)]
        return [sum(len(c.compress(p)) for p in parts) for c in self._made]

    def feature(self, text: bytes) -> float:
        """The difference of the compressed sizes, a byte of text: over 0 where the good dictionary saves more."""
        bad, good = self._sizes(text)
        return (bad - good) / max(1, len(text))

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        full = [i for i, t in enumerate(texts) if t.strip()]
        if self.line is not None and full:
            x = np.array([[self.feature(texts[i])] for i in full])
            out[full] = chance(self.line, (x - self.mean) / self.scale)
        return out

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}


def fit(docs: DataFrame, labels: DataFrame, learn=None, rows: int = ROWS) -> Compressors:
    """Dictionaries from up to ``rows`` rows of either label; ``learn`` is a condition on doc_id."""
    return Compressors(*sample(docs, labels, "quality", F.lit(True) if learn is None else learn, rows, LONGEST))


def quality(docs: DataFrame, model: Compressors) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text; others are ignored): the chance of label 1.

    Null, empty and blank texts get the share of label 1 among labelled rows.  Whole texts are compressed, whatever their
    length; scores depend on the text alone.  Without rows of both labels every score is that share.  An empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(1).fill_null("").cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(shared.value.score(texts))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op8: held_out is false for a null doc_id, which no label names; else as ``quality`` says."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality(docs, fit(docs, labels, remainder(3) != 1))
    return scored.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
