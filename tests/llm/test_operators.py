"""Each operator against brute force on small tables, with nulls, empty texts, ties, repeated rows and empty tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import compression, exact, hnsw, language, minhash, mixing, packing, substring, tokenfile, tokens, toxicity
from gleaner.llm.components import components
from gleaner.llm.common import work_dir

DOCS = "doc_id long, text string, row int, lang string, source string, n_chars long"  # row clashes with an inner name
ODD = [(1, "a  b", 0), (2, "a b", 0), (3, None, 0), (4, "", 0), (None, "a b", 0), (5, "c", 0), (5, "c", 0), (6, "it's <|endoftext|> É x", 0)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "en", "s", 1) for r in ODD], DOCS)


def words(n, rnd, v=300):
    return [f"w{rnd.randrange(v)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rnd, out = random.Random(5), []
    base, passage = words(120, rnd), words(30, rnd)
    for i in range(240):
        t = list(base) if i % 3 == 0 else words(40, rnd) + passage + words(20, rnd) if i % 3 == 1 else words(60, rnd)
        if i % 3 == 0:
            for _ in range(i % 9):
                t[rnd.randrange(120)] = f"x{rnd.randrange(99)}"
        out.append((i, " ".join(t)))
    return out + [(300, "p q r " * 30), (301, "x " + "p q r " * 20), (302, None), (303, "")]


def find(p, x):
    while p[x] != x:
        x = p[x]
    return x


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(30)]
    p = {x: x for e in pairs for x in e}
    for a, b in pairs:
        a, b = find(p, a), find(p, b)
        p[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, "a long, b long"), work_dir(spark, "t")).collect()}
    assert got == {x: find(p, x) for x in p if find(p, x) != x}
    assert components(spark.createDataFrame([], "a long, b long"), work_dir(spark, "t")).count() == 0


def test_exact(spark, odd):
    for digest in (exact.sha256, lambda t: F.lit("k").cast("binary")):  # the second makes every text collide
        got = sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_dedup(odd, digest).collect())
        assert got == [(0, 1, 3, False), (1, 1, 3, True), (2, 1, 3, False), (3, 3, 2, True), (4, 3, 2, False), (5, 5, 2, False), (5, 5, 2, True), (6, 6, 1, True)]
    assert sorted(r["doc_id"] for r in exact.drop_copies(odd).collect()) == [1, 3, 5, 6]
    assert exact.drop_copies(odd).columns == odd.columns and exact.exact_dedup(odd.limit(0)).count() == 0


def test_minhash(spark, odd, corpus):
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, t in corpus for w in [(t or "").lower().split()]}
    p = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(p, i), find(p, j)
                p[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in minhash.near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string")).collect()}
    assert got == {i: (find(p, i), len(sets[i])) for i in sets}
    assert sorted(r["doc_id"] for r in minhash.drop_near_copies(odd).collect()) == [1, 3, 4, 5, 6]
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_signatures_estimate():
    rnd = np.random.default_rng(2)
    x = rnd.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = x[:2000], x[500:2500]
    sig = minhash.superminhash(np.concatenate((a, b)), np.array([2000, 2000, 0]))
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.13 and not sig[2].any()


def brute_passages(docs, k=20):
    first, out = {}, {}
    for i, x in docs:
        w = x.encode().split() if x else []
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            key = tuple(w[a : a + k])
            if key in first:
                gone[a : a + k] = [True] * k
            first.setdefault(key, i)
        out[i] = len(w), sum(gone), hashlib.sha256(b" ".join(y for y, z in zip(w, gone, strict=True) if not z)).hexdigest()
    return out


def test_substring(spark, odd, corpus):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.repeated_passages(spark.createDataFrame(corpus, "doc_id long, text string")).collect()}
    assert got == brute_passages(corpus)
    assert substring.repeated_passages(odd).where("n_removed > 0").count() == 0
    assert substring.repeated_passages(odd.limit(0)).count() == 0


def test_substring_of_hot_anchors_and_many_shards(spark, corpus, monkeypatch):
    """Anchors of many places are dealt to several keys and documents to many shards: the result is brute force's."""
    monkeypatch.setattr(substring, "PLACES", 8)  # read on the driver
    monkeypatch.setattr(substring, "SHARD", 10)
    rnd = random.Random(3)
    line, extra = " ".join(words(25, rnd)), []
    for i in range(400, 520):  # a very common line, in some texts many times
        t = words(30, rnd, 5000)
        extra.append((i, " ".join([*t[: i % 30], *[line] * (1 + (i % 10 == 0) * 40), *t[i % 30 :]])))
    extra += [(600, extra[0][1]), (601, "  " + extra[0][1].replace(" ", "\n"))]  # copies of equal words
    docs = corpus + extra
    shuffled = spark.createDataFrame(docs[::-1], "doc_id long, text string")
    got = substring.repeated_passages(shuffled)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()} == brute_passages(docs)
    # what the anchors leave out of the automata holds no repeated window
    assert got.where("spans is null and n_removed > 0").count() == 0


def test_substring_ties_and_nulls(spark):
    """Null and repeated doc_ids: the row of the least doc_id stays whole, nulls last; long texts; clashing names."""
    t = " ".join(f"a{i}" for i in range(30))
    long = " ".join(f"b{i}" for i in range(60_000))
    rows = [(None, t, 1), (7, t + " z", 2), (7, t + " y", 3), (3, long, 4), (4, long + " " + t, 5), (None, None, 6)]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string, row int").withColumn("anchor", F.lit(0)))
    out = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in got.collect())
    assert out == [(False, 3, 60_000, 0), (False, 4, 60_030, 60_000), (False, 7, 31, 30), (False, 7, 31, 30), (True, 0, 0, 0), (True, 0, 30, 30)]


def brute_links(rows, least=0.93):
    """{vec_id: (links, least vec_id reachable)} by comparing every two vectors of a label."""
    ids, p, n = [r[0] for r in rows], {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}
    for label in {r[2] for r in rows}:
        own = [k for k, r in enumerate(rows) if r[2] == label]
        x = np.array([rows[k][1] for k in own], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        hit = x @ x.T >= least
        np.fill_diagonal(hit, False)
        for k, row in zip(own, hit, strict=True):
            n[ids[k]] = int(row.sum())
            for j in np.flatnonzero(row):
                a, b = find(p, ids[k]), find(p, ids[own[j]])
                p[max(a, b)] = min(a, b)
    return {i: (n[i], find(p, i)) for i in ids}


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("many, dense, shard", [(300, 20, 64), (300, 20, 8192), (5000, 700, 1500)])
def test_embeddings(spark, many, dense, shard):
    """Pairs of near vectors, equal vectors, and a group denser than the beam and spread over shards."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=32)
    x = rng.normal(size=(many, 32))
    x[1::7] = x[0::7][: len(x[1::7])] + 0.05 * rng.normal(size=(len(x[1::7]), 32))
    x[2::70] = x[0::70][: len(x[2::70])]
    x[many - dense :] = centre + 0.15 * rng.normal(size=(dense, 32))
    rows = [(i, x[i].astype(np.float32).tolist(), 1 if many > 1000 or i >= many - dense else i % 2) for i in range(many)]
    got = hnsw.embedding_duplicates(spark.createDataFrame(rows, VECTORS), shard=shard).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute_links(rows) and got[0]["audit_recall"] >= 0.999


def test_beams_widen_until_the_audit_passes():
    """A graph without links between its members finds little; the audit notices, and in the end all is compared."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16))
    x[300:] = x[:300] + 0.02 * rng.normal(size=(300, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    broken = hnsw.Graph(x.astype(np.float32), [(np.arange(600), np.full((600, 32), -1, np.int32))])
    for graph, poor in ((broken, True), (hnsw.Graph.build(x.astype(np.float32)), False)):
        audit = hnsw.Audit()
        got = sorted((int(i), int(j)) for a, b in hnsw.links(graph, x, x, 0.93, audit) for i, j in zip(a, b, strict=True))
        assert got == sorted(zip(*(v.tolist() for v in np.nonzero(x @ x.T >= 0.93)), strict=True))
        assert audit.links >= 64 and audit.found == audit.links and (audit.first < audit.links) == poor


def test_odd_embeddings(spark):
    """Null, empty, zero and non-finite vectors, null labels and ids, huge and tiny values, repeated rows, other lengths, no rows."""
    odd = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, float("nan")], 1), (6, [1.0, 1.0], None), (7, [1.0, 1.0], 1), (8, [1.0, 1.0], 1), (8, [1.0, 1.0], 1), (None, [1e30, 1e30], 1), (9, [1.0, 1.0, 1.0], 1), (10, [float("inf"), 1.0], 1), (11, [1e-30, 1e-30], 1)]
    df = spark.createDataFrame(odd, VECTORS).withColumn("key", F.lit("x")).withColumn("row", F.lit(1)).withColumn("part", F.lit(2))
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in hnsw.embedding_duplicates(df).collect()), key=lambda r: r[0])
    assert got == [(0, 4, 7), *((i, 0, i) for i in range(1, 7)), (7, 4, 7), (8, 4, 7), (8, 4, 7), (9, 0, 9), (10, 0, 10), (11, 4, 7)]
    assert hnsw.embedding_duplicates(df.limit(0)).count() == 0


def test_targets_and_permutations():
    assert mixing.targets([10, 1000, 1000], [5, 2, 1]) == pytest.approx([30, 1980 * 2 / 3, 1980 / 3])
    for n in (1, 2, 7, 1000):
        p = mixing.permute(np.arange(n), n, 1, 2, 3)
        assert sorted(p) == list(range(n)) and (mixing.permute(p, n, 1, 2, 3, back=True) == np.arange(n)).all()


def test_mixing(spark, odd, corpus):
    rows = [(i, t, 0, "en", None if i % 5 == 0 else f"s{i % 4}", 1) for i, t in corpus]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.taken_words(mixing.mix(df, block=16)).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r["target"], r["source_size"]), []).append((r["taken"], r["size"]))
    for (target, size), rows_ in by.items():  # sources of equal size and weight share a key
        taken, sizes = (sum(x) for x in zip(*rows_, strict=True))
        assert abs(taken - target * sizes / size) <= sizes / size
    again = mixing.taken_words(mixing.mix(df, block=16)).collect()
    assert {r["doc_id"]: r["taken"] for r in got} == {r["doc_id"]: r["taken"] for r in again}
    out = mixing.mixed_documents(df, block=16)
    total = {}
    for r in out.collect():
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + len(r["text"].split())
    assert out.columns == df.columns and total == {r["doc_id"]: r["taken"] for r in got if r["taken"]}
    assert mixing.mixed_documents(odd.limit(0)).count() == 0 and mixing.mixed_documents(odd).count() > 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_pack(rule):
    rnd = np.random.default_rng(4)
    n = rnd.integers(1, 400, 900)
    for docs, attention in ((1000, 10**6), (5, 10**6), (1000, 100_000)):
        bins, at = packing.pack(n, 1000, docs, attention, rule)
        assert (np.bincount(bins, n) <= 1000).all() and np.bincount(bins).max() <= docs
        single = np.bincount(bins) == 1
        assert ((np.bincount(bins, n * n) <= attention) | single).all()
        for b in range(bins.max() + 1):
            own = np.argsort(at[bins == b])
            assert (at[bins == b][own] == np.cumsum(n[bins == b][own]) - n[bins == b][own]).all()
    bins, _ = packing.pack(n, 1000, 1000, 10**6, rule)
    assert bins.max() + 1 <= -(-n.sum() // 1000) * 1.03


def whole_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path()).encode(text or "", add_special_tokens=False).ids


def test_packing(spark, odd):
    got = packing.pack_documents(odd, tokens=4).collect()
    want = sorted((d or 0, k, zlib.crc32(np.array((whole_ids(t) + [1])[4 * k : 4 * k + 4], "<u4").tobytes())) for d, t, _ in ODD for k in range(-(-(len(whole_ids(t)) + 1) // 4)))
    assert sorted((r["doc_id"] or 0, r["piece"], r["ids_crc32"]) for r in got) == want
    assert packing.pack_documents(odd.limit(0)).count() == 0


TEXTS = ["Hello, WORLD!", "don't stop", "ÀÉ straße İx", "éa  b\x1cc", "naïve—test 12,5 %", "日本語 text", "a\tb\n\nc", "!!! ...", "'tis 'll I'm", "Σας ΣΑΣ", "<|startoftext|>x", "ª º µ x²"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_the_library_s(text):
    with open(tokens.default_path()) as f:
        assert tokens.word_ids(f.read())(text).tolist() == whole_ids(text)


def test_token_file(spark, odd):
    path = work_dir(spark, "t")
    tokenfile.write_token_file(odd, path)
    got = tokenfile.read_token_file(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 5, 5, 6]
    assert [list(r["ids"]) for r in got] == [whole_ids(t) + [2] for t in ("a b", "a b", "a b", "", "", "c", "c", ODD[-1][1])]
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    tokenfile.write_token_file(odd.limit(0), path + "-none")
    assert tokenfile.read_token_file(spark, path + "-none").count() == 0


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 70_000])
def test_coder(n):
    ids = (np.random.default_rng(n).pareto(1, n) * 3).astype(np.int64) % 500
    freq = tokenfile.normalise(np.bincount(ids, minlength=500))
    assert freq.sum() == 1 << tokenfile.SCALE
    coder = tokenfile.Coder(freq)
    data = coder.encode(ids)
    assert (coder.decode(data) == ids).all()
    if n > 300:
        assert len(data) < 1.2 * n
        with pytest.raises(ValueError):
            coder.decode(data[:-1] + bytes([data[-1] ^ 1]))


def labelled(spark, n=400):
    rnd = random.Random(6)
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        t = words(40, rnd, 2000) + (["idiot", "clown"][: 1 + i % 2] if bad else [])
        rnd.shuffle(t)
        docs.append((i, "!!! ".join(t) if i % 5 == 0 else " ".join(t), 0, "en", "s", 1))
        labels.append((i, int(i % 5 != 0), int(bad), "other"))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_classifiers(spark, odd):
    docs, labels = labelled(spark)
    learn = F.col("doc_id") % 3 != 0
    for score, y in ((toxicity.toxicity(docs, toxicity.fit(docs, labels, learn)), "toxic"), (compression.quality(docs, compression.fit(docs, labels, learn)), "quality")):
        right = score.join(labels, "doc_id").where("doc_id % 3 = 0").select(((F.col("score") >= 0.5).cast("int") == F.col(y)).cast("double").alias("r")).agg(F.avg("r")).first()[0]
        assert right > 0.95, y
    none = labels.limit(0)
    assert toxicity.toxicity(odd, toxicity.fit(odd, none)).where("score between 0 and 1").count() == len(ODD)
    assert compression.quality(odd, compression.fit(odd, none)).where("score between 0 and 1").count() == len(ODD)
    assert toxicity.drop_toxic(docs, labels).where("doc_id % 4 = 0").count() <= 5 and toxicity.drop_toxic(docs, labels).count() >= 290


def test_nearest_examples_are_exact():
    rnd = random.Random(7)
    texts = [" ".join(words(12, rnd, 30) + (["bad"] * rnd.randrange(3) if i % 2 else ["good"] * rnd.randrange(3))) for i in range(300)]
    index = toxicity.Index([(i, i % 2, t) for i, t in enumerate(texts)], {0: 150, 1: 150}, k=5)
    index_all = np.zeros((len(index.ids), len(index.terms)))
    first, at, w = index.postings
    index_all[at, np.repeat(np.arange(len(index.terms)), np.diff(first))] = w
    for t in texts[:40]:
        v = index._vector(index._counts(t))
        full = index_all[:, v[0]] @ v[1]
        want = np.sort(full[full > 0])[::-1][:5]
        assert np.allclose(next(index._nearest([v]))[1], want)


def test_quality_is_a_difference_of_plain_sizes():
    """The feature against zstandard called for each window, and held-out texts told by it."""
    import zstandard

    rnd = random.Random(2)
    rows = [(i, i % 2, " ".join(words(40, rnd, 40) if i % 2 else [f"{rnd.randrange(10**6)}" for _ in range(40)])) for i in range(400)]
    model = compression.Compressors(rows[:300], {0: 150, 1: 150})
    for y, text in [*[r[1:] for r in rows[300:]], (None, "w1 w2 " * 3000)]:
        t = text.encode()
        sizes = []
        for raw in model.raw:
            c = zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(t[i : i + compression.WINDOW])) for i in range(0, len(t), compression.WINDOW)))
        assert abs(model.feature(t) - (sizes[0] - sizes[1]) / len(t)) < 0.01
        assert y is None or (model.score([t])[0] >= 0.5) == y
    assert model.score([b"", b"  "]).tolist() == [0.5, 0.5]


def test_filters_hold_every_ngram(spark):
    """Lookups against plain sets: no language that contains an n-gram is missing, few others seem to."""
    rnd = random.Random(5)
    names = [f"l{i}" for i in range(11)]
    rows = [(i, " ".join("".join(rnd.choice("abcdefgh"[: 4 + i % 5]) for _ in range(6)) for _ in range(30)), 0, names[i % 11], "s", 1) for i in range(220)]
    model = language.fit(spark.createDataFrame(rows, DOCS))
    own = {k: {g for r in rows if r[3] == k for _, _, h, _ in language.ngrams([r[1]]) for g in h.tolist()} for k in names}
    some = sorted(set().union(*own.values()))
    false = 0
    for g, got in zip(some, model.containing(np.array(some, np.uint64)), strict=True):
        true = {k for k in names if g in own[k]}
        assert true <= got
        false += len(got - true)
    assert false <= 2 * sum(model.false[model.languages.index(k)] * (len(some) - len(own[k])) for k in names) + 5


def test_language(spark):
    sample = {"de": "der die und nicht schule straße ", "en": "the and with school street ", "fr": "le la les école avec rue "}
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).sample(sample[k].split(), 4)), 0, k, "s", 1) for i in range(90) for k in [list(sample)[i % 3]]], DOCS)
    model = language.fit(docs, F.col("doc_id") % 2 == 0)
    assert language.languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("lang_pred = lang").count() == 90
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 %% \0"), (None, "der\0die"), (5, "ß" * 100_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.languages(odd, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == ["und"] * 3 and got[None] == "de" and got[5] in sample
    assert language.languages(odd, language.fit(docs.limit(0))).where("lang_pred = 'und'").count() == 5


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark, 120)
    extra = [(500, "near copy " * 40, 0, "en", "t", 1), (501, "near copy " * 40, 0, "en", "t", 1), (502, None, 0, None, None, None)]
    docs.unionByName(spark.createDataFrame(extra, DOCS)).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert 501 not in ids and 500 in ids and not {i for i in ids if i % 4 == 0 and i < 120}
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
