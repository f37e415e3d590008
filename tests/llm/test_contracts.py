"""Every opN query and the pipeline on a small folder of tables: columns, types, and results against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import exact, minhash, mixing, packing, queries, toxicity
from gleaner.llm.common import work_dir
from gleaner.llm.labelled import sample
from gleaner.llm.tokens import default_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def crc(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


@pytest.fixture(scope="module")
def rows():
    rnd, out = random.Random(12), []
    stems = {"en": "the and with school street house ", "de": "der die und nicht schule straße haus "}
    passage = [f"p{i}" for i in range(60)]
    for i in range(260):
        lang = "en" if i % 3 else "de"
        t = [rnd.choice(stems[lang].split()) + rnd.choice(["", "s", "t", "n"]) + rnd.choice("abcdefghij") for _ in range(rnd.randrange(20, 90))]
        if i % 6 == 0:
            t += ["idiot", "scum"][: 1 + i % 4 // 2]
        if i % 10 == 1:
            t += passage[: 40 + i % 20]
        out.append([i, " ".join(t), None if i % 50 == 3 else lang, None if i % 17 == 0 else "abc"[i % 3], 0])
    for i in range(260, 300):  # copies, near copies
        t = out[i - 250][1]
        out.append([i, ["  ".join(t.split()), t + " end", t][i % 3], "en" if (i - 250) % 3 else "de", "a", 0])
    out += [[300, None, None, None, None], [301, "", "en", "b", 0], [302, " 12 \t", "en", "b", 0], [303, "x" * 300_000, "en", "c", 0], [304, "a b " * 5000, "en", "a", 0]]
    return [tuple([*r[:4], len(r[1]) if r[1] else r[4]]) for r in out]


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{top}/documents.parquet")
    labels = [(i, int(len(t or "") % 7 != 0 and i % 9 != 0), int("idiot" in (t or "") or "scum" in (t or ""))) for i, t, *_ in rows if i % 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 8))
    x[60:] = x[:60] + 0.05 * rng.normal(size=(60, 8))
    spark.createDataFrame([(i, None if i == 7 else v.tolist(), None if i == 9 else i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{top}/embeddings.parquet")
    return str(top)


def run(spark, name, sf_dir):
    df = queries.QUERIES[name](spark, sf_dir)
    return dict(df.dtypes), [r.asDict() for r in df.collect()]


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near(texts, k):
    """Index of the least text reachable by links of similarity 0.8."""
    sets, top = [shingles(t, k) for t in texts], list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * (len(a) + len(sets[j]) - both) and both:
                p, q = find(i), find(j)
                top[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("name, parts, out", [("op1_toxicity", 5, 0), ("op8_compression_quality", 3, 1)])
def test_classifier_contracts(spark, sf_dir, rows, name, parts, out):
    types, got = run(spark, name, sf_dir)
    assert [types[c] for c in ("doc_id", "held_out", "score", "predicted")] == ["bigint", "boolean", "double", "int"]
    assert sorted(r["doc_id"] for r in got) == [r[0] for r in rows]
    assert all(r["held_out"] == (crc(r["doc_id"], parts) == out) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    if name == "op1_toxicity":
        right = [("idiot" in (t or "") or "scum" in (t or "")) == p for (_, t, *_), p in zip(rows, [r["predicted"] for r in sorted(got, key=lambda r: r["doc_id"])], strict=True)]
        assert sum(right) >= 0.97 * len(rows)


def test_op2_contract(spark, sf_dir):
    types, got = run(spark, "op2_embedding_near_dedup", sf_dir)
    assert [types[c] for c in ("vec_id", "n_links", "component_id", "kept")] == ["bigint", "bigint", "bigint", "boolean"]
    by = {r["vec_id"]: r for r in got}
    assert sorted(by) == list(range(120)) and all(by[i + 60]["component_id"] == i and not by[i + 60]["kept"] for i in range(60) if i not in (7, 9))
    assert all(by[i]["n_links"] == 0 and by[i]["kept"] for i in (7, 9, 67, 69)) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_op3_contract(spark, sf_dir, rows):
    types, got = run(spark, "op3_source_mixing", sf_dir)
    assert [types[c] for c in ("doc_id", "size", "source_size", "target", "taken")] == ["bigint", "bigint", "bigint", "double", "bigint"]
    again = {r["doc_id"]: r["taken"] for r in run(spark, "op3_source_mixing", sf_dir)[1]}
    size, source = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}, {r[0]: r[3] for r in rows}
    sums = Counter()
    for i, s in source.items():
        sums[s] += size[i]
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.targets([sums[s] for s in names], [5, 2, 1, 5]), strict=True))
    assert sum(want.values()) == pytest.approx(sum(sums.values())) and all(want[s] <= 3 * sums[s] + 1e-6 for s in names)
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sums[s]) and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"] and again[r["doc_id"]] == r["taken"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)


def test_op4_and_op5_contracts(spark, sf_dir, rows):
    types, got = run(spark, "op4_minhash_near_dedup", sf_dir)
    assert [types[c] for c in ("doc_id", "n_shingles", "component_id", "kept")] == ["bigint", "bigint", "bigint", "boolean"]
    top, sizes = near([r[1] for r in rows], 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {r[0]: (n, rows[t][0], rows[t][0] == r[0]) for r, t, n in zip(rows, top, sizes, strict=True)}
    types, got = run(spark, "op5_exact_dedup", sf_dir)
    assert [types[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")] == ["bigint", "bigint", "bigint", "boolean", "string"]
    sha = {r[0]: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "").encode()).hexdigest() for r in rows}
    groups = defaultdict(list)
    for i, h in sha.items():
        groups[h].append(i)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got} == {i: (min(groups[h]), len(groups[h]), i == min(groups[h]), h) for i, h in sha.items()}


def ids_of(text, end):
    from tokenizers import Tokenizer

    ids_of.made = getattr(ids_of, "made", None) or Tokenizer.from_file(default_path())
    return np.array([*ids_of.made.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def check_pieces(got, texts):
    """Pieces of every text's ids, and sequences without gaps; ``texts`` are (doc_id, text), equal ids in any order."""
    want = Counter()
    for i, t in texts:
        ids = ids_of(t, 1)
        want.update((i, k, s, min(4096, len(ids) - s), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    return len(sequences)


def test_op6_and_op10_contracts(spark, sf_dir, rows):
    types, got = run(spark, "op6_best_fit_packing", sf_dir)
    assert [types[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")] == ["bigint", "int", *["bigint"] * 5]
    used = check_pieces(got, [(r[0], r[1]) for r in rows])
    assert used <= 1.05 * sum(r["length"] for r in got) / 4096 + 1
    types, got = run(spark, "op10_token_file", sf_dir)
    assert [types[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")] == ["bigint"] * 4
    at, want = 0, {}
    for r in rows:
        ids = ids_of(r[1], 2)
        want[r[0]] = at, len(ids), zlib.crc32(ids.tobytes())
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want


def test_op7_and_op9_contracts(spark, sf_dir, rows):
    types, got = run(spark, "op7_substring_dedup", sf_dir)
    assert [types[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")] == ["bigint", "bigint", "bigint", "string"]
    seen, want = set(), {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            key = tuple(w[a : a + 20])
            if key in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(key)
        want[i] = len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == want
    types, got = run(spark, "op9_language_id", sf_dir)
    assert [types[c] for c in ("doc_id", "held_out", "lang_pred", "score")] == ["bigint", "boolean", "string", "double"]
    by = {r["doc_id"]: r for r in got}
    assert sorted(by) == [r[0] for r in rows] and all(by[i]["lang_pred"] == "und" for i in (300, 301, 302))
    assert all(by[r[0]]["held_out"] == (crc(r[0], 3) == 1) for r in rows)
    known = [r for r in rows[:260] if r[2]]
    assert sum(by[r[0]]["lang_pred"] == r[2] for r in known) >= 0.99 * len(known)


def test_pipeline_against_brute_force(spark, sf_dir, rows):
    """Every stage against brute force on its own input, then the whole run against the last stage."""
    docs, kept, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), rows, None
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = work_dir(spark, f"test-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        before, docs = kept, spark.read.parquet(path)
        kept = [tuple(r) for r in docs.collect()]
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = sorted(r[0] for r in kept)
        if name == "toxicity":
            scores = list(toxicity.Index(*sample(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels, "toxic", F.lit(True), 4096)).scores([r[1] for r in before]))
            assert ids == [r[0] for r, (p, _, _) in zip(before, scores, strict=True) if p < 0.5]
            bad = {r[0] for r in before if "idiot" in (r[1] or "") or "scum" in (r[1] or "")}
            assert not bad & set(ids) and len(ids) >= 0.98 * (len(before) - len(bad))
        elif name == "exact_dedup":
            first = {}
            for r in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
            assert sorted(kept) == sorted(first.values())
        elif name == "minhash_near_dedup":
            own = sorted(before)
            top, _ = near([r[1] for r in own], 5)
            assert sorted(kept) == [r for i, (r, t) in enumerate(zip(own, top, strict=True)) if i == t]
        elif name == "source_mixing":
            texts, sums, want = {r[0]: WORD.findall(r[1] or "") for r in before}, Counter(), Counter()
            for r in before:
                want[r[3]] += len(texts[r[0]])
            names = sorted(want, key=lambda s: (s is None, s or ""))
            goal = mixing.targets([want[s] for s in names], [5, 2, 1, 5])
            for i, t, _, source, n in kept:
                w = WORD.findall(t)
                assert n == len(t) and any(texts[i][a : a + len(w)] == w for a in range(len(texts[i]) - len(w) + 1))
                sums[source] += len(w)
            assert all(abs(sums[s] - g) <= 1 for s, g in zip(names, goal, strict=True))
    got = [r.asDict() for r in docs.collect()]
    check_pieces(got, [(r[0], r[1]) for r in before])
    whole = corpus_pipeline.run(spark, sf_dir)
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(tuple(r[k] for k in key) for r in got) == Counter(tuple(r[k] for k in key) for r in whole.collect())


def test_stages_with_odd_ids_and_clashing_names(spark):
    """Null and repeated doc_ids with texts of their own, and columns named as inner ones are."""
    rnd = random.Random(4)
    texts = [" ".join(f"w{rnd.randrange(900)}" for _ in range(50)) for _ in range(4)]
    rows = [(1, texts[0]), (5, texts[0]), (5, texts[1]), (None, texts[0]), (None, texts[2]), (7, texts[3]), (7, texts[3]), (8, texts[3] + " end"), (9, None), (None, "")]
    names = ["found_id", "__norm", "__size", "row", "__row", "file", "at", "doc", "digest", "kept", "n", "size", "hash", "number", "span", "_metadata", "component_id", "__group"]
    docs = spark.createDataFrame([(*r, "s", *["x"] * len(names)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in names))
    got = exact.drop_copies(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == sorted([(1, texts[0]), (5, texts[1]), (0, texts[2]), (7, texts[3]), (8, texts[3] + " end"), (9, None)], key=lambda r: (r[0], r[1] or "")) or got.count() == 6
    got = minhash.drop_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"] or 0, r["text"] or "") for r in got.collect())) == sorted([(1, texts[0]), (5, texts[1]), (0, texts[2]), (7, texts[3]), (9, ""), (0, "")])
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns and got.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] == sum(len((r[1] or "").split()) for r in rows)
    assert sum(r["taken"] for r in mixing.taken_words(mixing.mix(docs)).collect()) == sum(len((r[1] or "").split()) for r in rows)
    assert mixing.mixed_documents(docs.limit(0)).count() == 0 and mixing.taken_words(mixing.mix(docs.limit(0))).count() == 0
    labels = spark.createDataFrame([(1, 0), (5, 0)], "doc_id long, toxic int")
    assert toxicity.drop_toxic(docs, labels).count() == len(rows) and toxicity.drop_toxic(docs.limit(0), labels).count() == 0


def test_state_goes_on_and_is_hit_by_later_batches(spark):
    """One file a micro-batch, then a second stream from the same checkpoint after more files came."""
    work = work_dir(spark, "t")
    schema = "digest binary, doc_id long, row long"
    first = [(bytes([i % 7]), i, i) for i in range(30)]
    spark.createDataFrame(first, schema).repartition(5).write.parquet(f"{work}/rows")
    got = exact.absorb(spark, f"{work}/rows", spark.createDataFrame([], schema).schema, f"{work}/state", files=1)
    assert {bytes(r["digest"]): (r["keep_id"], r["keep_row"], r["n"]) for r in got.collect()} == {bytes([k]): (k, k, len(range(k, 30, 7))) for k in range(7)}
    more = [(bytes([i % 9]), i - 20, i) for i in range(30, 48)]  # smaller identifiers, known and new digests
    spark.createDataFrame(more, schema).write.mode("append").parquet(f"{work}/rows")
    got = exact.absorb(spark, f"{work}/rows", spark.createDataFrame([], schema).schema, f"{work}/state", files=1)
    want = defaultdict(list)
    for d, i, r in first + more:
        want[d].append((i, r))
    assert {bytes(r["digest"]): (r["keep_id"], r["keep_row"], r["n"]) for r in got.collect()} == {d: (*min(v), len(v)) for d, v in want.items()}
    import glob

    assert len(glob.glob(f"{work}/state/commits/[0-9]*")) >= 6


def test_packing_in_several_groups(spark, monkeypatch):
    """Many groups and levels, and equal pieces: they spread over groups, and everything is packed once."""
    monkeypatch.setattr(packing, "GROUP", 50)
    rows = [(None, "a b c d e f") for _ in range(400)] + [(i, "word " * (i % 40)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.asDict() for r in packing.pack_documents(docs, tokens=64).collect()]
    fill = Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert len(got) == len(rows) and max(fill.values()) <= 64 and len(fill) <= 1.1 * sum(fill.values()) / 64
    assert len({r["sequence_id"] for r in got if r["doc_id"] is None}) > 8


def test_minhash_blocks_and_chunks(spark, monkeypatch):
    """Buckets beyond one chunk and one block: components are brute force's."""
    monkeypatch.setattr(minhash, "CHUNK", 4)
    monkeypatch.setattr(minhash, "MEMBERS", 3)
    rnd = random.Random(6)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(60):  # a chain: neighbours are near, the ends are not
        base[rnd.randrange(120)] = f"x{i}"
        base[rnd.randrange(120)] = f"y{i}"
        rows.append((i, " ".join(base)))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(near([r[1] for r in rows], 5)[0]))
