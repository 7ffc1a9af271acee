"""Importance resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plotmerge.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]  # noqa: B905


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def brute(docs, targets):
    """Rows (doc_id, n_features, weight, score, rank) of the contract."""
    raw = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    aim = Counter(bucket(f) for t in targets for f in features(t)[1])
    s, t = sum(raw.values()), sum(aim.values())
    rows = []
    for doc_id, text in docs:
        n_words, found = features(text)
        gains = [math.floor(1000 * math.log((aim[bucket(f)] + 1) * (s + 10_000)
                 / ((raw[bucket(f)] + 1) * (t + 10_000)))) for f in found]
        weight = sum(gains) // len(found) if found else 0
        name = "7:" + ("" if doc_id is None else str(doc_id))
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, n_words])
    order = sorted(
        (r for r in rows if r[4] >= 20),
        key=lambda r: (-r[3], 2**63 - 1 if r[0] is None else r[0], r[1], r[2]),
    )
    ranks = {id(r): k + 1 for k, r in enumerate(order[: 25 * len(order) // 100])}
    return sorted((tuple(r[:4]) + (ranks.get(id(r)),) for r in rows), key=repr)


def rows(df):
    return sorted(
        ((r["id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=repr
    )


@pytest.fixture(scope="module")
def target(spark):
    texts = ["The river was under the house", None, "", "Zu Ähren of the stone"]
    return spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "id long, text string, rank int")


@pytest.mark.parametrize("most_runs, segment_rows", [(512, 16_384), (512, 3), (4, 1)])
def test_resample_matches_brute_force(spark, docs, target, most_runs, segment_rows):
    got = resampling.resample(docs, target, most_runs=most_runs, segment_rows=segment_rows)
    texts = [r["text"] for r in target.collect()]
    assert rows(got) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], texts)


def test_ties_and_many_runs(spark, target):
    """Few scores for many rows: splitters share scores and ids decide."""
    scored = spark.range(4000, numPartitions=7).selectExpr(
        "id % 1500 as id", "25L as n_words", "id as n_features", "id % 3 as weight", "id % 3 as score"
    )
    got = resampling.rank_highest(scored, percent=60, segment_rows=50).collect()
    order = sorted(got, key=lambda r: (-r["score"], r["id"], r["n_features"]))
    assert [r["rank"] for r in order] == list(range(1, 2401)) + [None] * 1600


def test_segments_are_even(spark):
    from pyspark.sql import functions as F

    runs = spark.range(20_000, numPartitions=9).select(
        F.pmod(F.xxhash64("id"), F.lit(1000)).alias("score"), F.col("id").alias("_id")
    )
    rows = sorted(((r["score"], r["_id"]) for r in runs.collect()), key=lambda r: (-r[0], r[1]))
    cut = resampling._with_segment(runs, resampling._splitters(rows[::20], 10))
    sizes = [n for _, n in cut.groupBy("_segment").count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 2 * 2000


def test_empty_tables(spark, docs, no_docs, target):
    assert resampling.resample(no_docs, target).count() == 0
    got = resampling.resample(docs, target.limit(0))
    assert rows(got) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [])
    few = docs.where("doc_id < 3")
    assert resampling.resample(few, target).where("rank is not null").count() == 0


def test_drawn_documents_keep_their_columns(docs, target):
    got = resampling.drawn(docs, target)
    ranked = resampling.resample(docs, target).where("rank is not null")
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == {r["id"] for r in ranked.collect()}


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_words_and_buckets(text):
    n_words, found = features(text)
    words = resampling.words(text.encode())
    assert len(words) == n_words
    assert sorted(resampling.feature_buckets(words).tolist()) == sorted(map(bucket, found))
