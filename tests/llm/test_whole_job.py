"""Cases of a review in which an operator did less than its whole job."""

import random

import numpy as np
from pyspark.sql import functions as F

from gleaner.llm import exact, labelled, minhash, toxicity


def test_every_word_of_an_example_counts():
    """The k nearest are those of brute force over whole vectors, though blocks stay shut."""
    rnd = random.Random(8)
    texts = [" ".join([f"{'abcd'[i % 4]}{chr(97 + rnd.randrange(26))}{chr(97 + rnd.randrange(26))}" for _ in range(30)] + (["awful"] if i % 2 and i % 3 else [])) for i in range(400)]
    rare = "zorgul vextrin quamble drossit " * 3  # one toxic example, none of whose words is anywhere else
    texts += [rare, "plain words of one clean example", texts[7], "", "1 2 3"]
    examples = [(i, int(t == rare or "awful" in t), t) for i, t in enumerate(texts)]
    index = toxicity.Index(examples, {0: 271, 1: 134}, k=5)
    assert sorted(index.ids.tolist()) == list(range(403))  # all but those without words
    seen = [toxicity.Counter(toxicity._WORD.findall(t)) for t in texts]
    names = sorted(set().union(*seen))
    assert len(index.terms) == len(names)
    at = {x: int(index._counts(x)[0][0]) for x in names}
    full = np.zeros((len(texts), len(names)))
    for i, c in enumerate(seen[:403]):
        w = np.array([(1 + np.log(n)) * index.idf[at[x]] for x, n in c.items()])
        full[i, [at[x] for x in c]] = w / np.linalg.norm(w)
    place = {int(d): k for k, d in enumerate(index.ids)}
    some = [*range(60), 400, 401, 402]
    index.opened = 0
    found = list(index._nearest([index._vector(index._counts(texts[i])) for i in some], [place[i] for i in some]))
    for i, (near, cos) in zip(some, found, strict=True):
        want = full @ full[i]
        want[i] = -1
        assert np.allclose(cos, np.sort(want[want > 0])[::-1][:5], atol=1e-6)
        assert np.allclose(want[index.ids[near]], cos, atol=1e-6)
    assert index.opened < 0.9 * len(some) * index.search.blocks
    (p, near, cos), (q, _, _), (r, none, _) = index.scores([rare, "plain words of one clean example", "unknown"])
    assert p >= 0.5 and near[0] == 400 and abs(cos[0] - 1) < 1e-6 and q < 0.5 and none == [] and r == index.nothing


def test_near_copies_without_own_ids(spark):
    rnd = random.Random(9)
    a, b, c, d, e = (" ".join(f"w{rnd.randrange(500)}" for _ in range(60)) for _ in range(5))
    rows = [(1, a, 0), (None, a + " end", 1), (None, b, 2), (None, c, 3), (None, c + " end", 4), (7, d, 5), (3, d + " end", 6), (7, e, 7), (None, None, 8), (None, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = minhash.drop_near_copies(docs)
    kept = {r["row"] for r in got.collect()}
    assert got.columns == docs.columns and got.count() == len(kept)
    assert kept - {3, 4} == {0, 2, 6, 7, 8, 9} and len(kept & {3, 4}) == 1


def test_copies_in_a_format_without_places(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c")], "doc_id long, text string")
    docs.write.option("header", True).csv(str(tmp_path / "docs"))
    read = spark.read.option("header", True).schema(docs.schema).csv(str(tmp_path / "docs"))
    assert sorted(r["doc_id"] for r in exact.drop_copies(read).collect()) == [1, 3]


def test_a_repeated_doc_id_gives_one_example(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c"), (3, None), (None, "d")], "doc_id long, text string")
    own = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1)], "doc_id long, toxic int")
    assert labelled.sample(docs, own, "toxic", F.lit(True), 10)[0] == [(1, 1, "a"), (2, 0, "c")]
