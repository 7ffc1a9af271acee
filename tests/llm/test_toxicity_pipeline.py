"""The classifier chain on held-out rows, and the pipeline against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import documents, frame, sentence

import __spark_entry__ as entry
import corpus_pipeline
from plotmerge.llm import mixing, packing, simhash, toxicity

BAD = ["grimple", "snarvok", "hurtzen"]


def labelled(n=400, seed=3):
    """Documents of which a quarter holds bad words or words that begin like one."""
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        words = sentence(rng, 60).split()
        for _ in range(4 if toxic else 0):
            words[rng.randrange(60)] = rng.choice(BAD) + rng.choice(["", "ish", "s", "!!"])
        if k % 10 == 1:
            words = [w + "###" for w in words]
        docs.append((k, " ".join(words), "en", "a", 0))
        labels.append((k, 0 if k % 10 == 1 else 1, int(toxic)))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int, text string, id long, y int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents and labels as files: labelled rows, and the hard ones without a label."""
    base = tmp_path_factory.mktemp("sf")
    docs, labels = labelled()
    extra = documents()[0][5:]
    hard = [(None if r[0] is None else r[0] + 10_000, *r[1:]) for r in documents()]
    frame(spark, [(*d, *extra) for d in docs] + hard).repartition(3).write.parquet(f"{base}/documents.parquet")
    known = [(*r, "x", 1, 1) for r in labels if r[0] % 5]  # a fifth is held out
    known += [(None, 1, 1, "x", 1, 1), (3, None, 1, "x", 1, 1), (3, 1, None, "x", 1, 1), (99_999, 1, 1, "x", 1, 1)]
    spark.createDataFrame(known, LABELS).write.parquet(f"{base}/labels.parquet")
    return str(base), dict((r[0], r[2]) for r in labels)


def read(spark, tables, name):
    return spark.read.parquet(f"{tables[0]}/{name}.parquet")


def test_chain_on_held_out_documents(spark, tables):
    got = toxicity.judge(read(spark, tables, "documents"), read(spark, tables, "labels"))
    assert got.columns == ["id", "p_low_quality", "p_toxic", "toxic"]
    rows = got.collect()
    assert len(rows) == read(spark, tables, "documents").count()
    held_out = [r for r in rows if r["id"] is not None and r["id"] < 400 and r["id"] % 5 == 0]
    assert len(held_out) == 80
    assert all(r["toxic"] == bool(tables[1][r["id"]]) for r in held_out)
    assert not any(r["toxic"] for r in rows if r["id"] is None or r["id"] >= 10_000)


def test_later_models_see_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    rows = [({0: 1.0} if k % 2 else {}, 1.0) for k in range(120)]
    first = np.array([k % 2 for k in range(120)], float)
    second = rng.integers(0, 2, 120).astype(float)
    vocabulary = toxicity.Vocabulary(["a"])
    folds = np.arange(120) % toxicity.FOLDS
    chain, held_out = toxicity.fit_chain(rows, np.column_stack([first, second]), folds, vocabulary, ["x", "y"])
    assert [len(m.dense) for m in chain.models] == [2, 3]
    x = toxicity.matrix(rows)
    for fold in range(toxicity.FOLDS):
        alone = toxicity.train(x.chosen(folds != fold), first[folds != fold], 1)
        assert np.allclose(held_out[folds == fold, 0], alone.probability(x.chosen(folds == fold)))
    assert ((held_out[:, 0] > 0.5) == (first > 0.5)).all()


@pytest.mark.parametrize("labels,p", [([], 0.0), ([(1, 1, 0)], 0.0), ([(1, 1, 1)], 1.0)])
def test_chain_without_two_kinds_of_labels(spark, docs, no_docs, labels, p):
    known = spark.createDataFrame([(*r, "x", 1, 1) for r in labels], LABELS)
    rows = toxicity.judge(docs, known).collect()
    assert len(rows) == docs.count()
    assert all(abs(r["p_toxic"] - p) < 1e-6 for r in rows)
    assert toxicity.drop_toxic(docs, known).columns == docs.columns
    assert toxicity.judge(no_docs, known).count() == 0


def test_pipeline(spark, tables):
    sf_dir, toxic = tables
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, steps = given, [given.collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{sf_dir}/out-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        steps.append(docs.collect())
    raw, clean, distinct, apart, mixed, packed = steps
    # Toxic documents are gone, clean ones are all there.
    bad = {i for i, t in toxic.items() if t}
    assert Counter(clean) == Counter(r for r in raw if r["doc_id"] not in bad)
    # The largest id of each text.
    best = defaultdict(list)
    for r in clean:
        best[r["text"] or ""].append(r["doc_id"])
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in best.items()}
    assert Counter((r["doc_id"], r["text"] or "") for r in distinct) == Counter((i, t) for t, i in largest.items())
    # The smallest id of each component of close fingerprints.
    fps = [simhash.fingerprint(r["text"] or "") for r in distinct]
    label = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    groups = defaultdict(list)
    for r, root in zip(distinct, label, strict=True):
        groups[root].append(r["doc_id"])
    kept = [min((i for i in ids if i is not None), default=None) for ids in groups.values()]
    assert Counter(r["doc_id"] for r in apart) == Counter(kept)
    # Whole documents, at most twice, with every source near its target.
    words = lambda r: len((r["text"] or "").encode().split())
    assert max(Counter(mixed).values()) <= 2 and set(mixed) <= set(apart)
    apart_frame = spark.read.parquet(f"{sf_dir}/out-simhash_near_dedup")
    targets = {r["source"]: r["target"] for r in mixing.mix(apart_frame).select("source", "target").distinct().collect()}
    taken, largest_doc = Counter(), Counter()
    for r in mixed:
        taken[r["source"]] += words(r)
    for r in apart:
        largest_doc[r["source"]] = max(largest_doc[r["source"]], words(r))
    assert all(abs(taken[s] - t) <= largest_doc[s] + 1 for s, t in targets.items())
    # Every token of the mix, once for each time a document was drawn.
    want = Counter()
    for r in mixed:
        ids = np.append(packing.token_ids(r["text"] or ""), 0).astype("<u4")
        for k, (start, length) in enumerate(packing.cuts(len(ids), 2048)):
            want[r["doc_id"], k, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    assert Counter(tuple(r[:5]) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}
    assert {n for n in entry.oracle_sql() if n.startswith("op")} == {
        "op2_warc_revisits", "op8_norm_bucket_top_k", "op9_exact_dedup"}
