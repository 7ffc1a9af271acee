"""Importance resampling: documents drawn so that their features come to resemble a target.

Features are runs of words, hashed to buckets. Bucket counts of all documents and of all target
texts give each bucket a gain, the logarithm of how much likelier it is in the target; a
document's weight is the mean gain of its features, looked up in the array of gains. Weight plus
seeded Gumbel noise is its score, and the highest scores are a draw without replacement in
proportion to the importance weights.

The scores are ranked exactly by parallel sorting with regular sampling. Every partition is sorted
where it lies (a run) and stored with its places; rows at regular places of all runs give regular
splitters, between which no segment holds more than about twice its share; counts per segment are
summed up to prefixes; the segments that the draw reaches are exchanged, merged locally, and a
row's rank is its place in its segment behind the prefix. Rows behind the draw, and documents that
take no part in it, are never exchanged.

What reaches the driver is bounded by parameters: ``buckets`` counts, at most ``RUNS`` run lengths
and segment counts, and at most 2 * ``RUNS`` squared samples.

Defined results: null text has no words and weight 0; a null id hashes as the empty text and
sorts last; repeated rows take part each, those equal in score and id in the order of their
feature number and weight; without target texts all weights follow from the counts alone; an
empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotmerge.llm.common import stored, whole_text

BUCKETS = 10_000
LONGEST_FEATURE = 2
MIN_WORDS = 20
PERCENT = 25
SEED = 7
#: Sorted runs, and segments, at most.
RUNS = 512
#: Rows of a segment, on average, as long as there are fewer than ``RUNS`` segments.
SEGMENT_ROWS = 16_384

#: ASCII letters in lower case, digits and all bytes of other characters stay; the rest parts words.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)

SCORED = "id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"


def words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, A-Z in lower case."""
    return text.translate(_WORD_BYTES).split()


def feature_buckets(
    found: list[bytes], buckets: int = BUCKETS, longest: int = LONGEST_FEATURE
) -> np.ndarray:
    """The bucket of every run of up to ``longest`` words; checksums go on from run to run."""
    crc = zlib.crc32
    sums = [crc(w) for w in found]
    every = [np.array(sums, np.uint32)]
    for n in range(1, longest):
        sums = [crc(w, crc(b" ", c)) for c, w in zip(sums, found[n:])]  # noqa: B905
        every.append(np.array(sums, np.uint32))
    return np.concatenate(every) % np.uint32(buckets)


def bucket_counts(
    texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST_FEATURE
) -> np.ndarray:
    """How many features of all texts fall into each bucket; one array per task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch[0]:
                counts += np.bincount(
                    feature_buckets(words(text.as_py()), buckets, longest), minlength=buckets
                )
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    found = texts.select(whole_text(text_col).cast("binary").alias("text")).mapInArrow(
        count, "bucket bigint, n bigint"
    )
    counts = np.zeros(buckets, np.int64)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket, in thousandths, from the counts of all documents and of the target."""
    s, t = int(raw.sum()) + len(raw), int(target.sum()) + len(target)
    return np.array(
        [math.floor(1000 * math.log(((b + 1) * s) / ((a + 1) * t)))
         for a, b in zip(raw.tolist(), target.tolist(), strict=True)],
        np.int64,
    )


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Seeded Gumbel noise of a document, in thousandths."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    target_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST_FEATURE, seed: int = SEED,
) -> DataFrame:
    """One row per document: id, n_words, n_features, weight and score."""
    gains = bucket_gains(
        bucket_counts(docs, text_col, buckets, longest),
        bucket_counts(target, target_col, buckets, longest),
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch[0].to_pylist(), batch[1], strict=True):
                found = words(text.as_py())
                at = feature_buckets(found, buckets, longest)
                weight = int(gains[at].sum()) // len(at) if len(at) else 0
                rows.append((doc_id, len(found), len(at), weight, weight + noise(doc_id, seed)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                ["id", "n_words", "n_features", "weight", "score"],
            )

    return docs.select(
        F.col(id_col).cast("long").alias("id"), whole_text(text_col).cast("binary").alias("text")
    ).mapInArrow(score, SCORED)


def _splitters(samples: list[tuple], segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The samples that part the segments, as arrays of score and id (null as the largest)."""
    samples.sort(key=lambda s: (-s[0], s[1]))
    picked = [samples[len(samples) * k // segments] for k in range(1, segments)]
    return np.array([-s for s, _ in picked], np.int64), np.array([i for _, i in picked], np.int64)


def _with_segment(runs: DataFrame, splitters: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Add the number of splitters that do not lie behind a row."""
    by_score, by_id = splitters

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = -batch["score"].to_numpy(), batch["_id"].to_numpy()
            low, high = np.searchsorted(by_score, keys), np.searchsorted(by_score, keys, "right")
            segment = high.copy()
            for value in np.unique(keys[low < high]):  # splitters of this score: the id decides
                here = keys == value
                a, b = np.searchsorted(by_score, value), np.searchsorted(by_score, value, "right")
                segment[here] = a + np.searchsorted(by_id[a:b], ids[here], "right")
            yield batch.append_column("_segment", pa.array(segment.astype(np.int32)))

    return runs.mapInArrow(cut, T.StructType([*runs.schema, T.StructField("_segment", T.IntegerType())]))


def rank_highest(
    scored: DataFrame, percent: int = PERCENT, most_runs: int = RUNS, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Add the rank of the ``percent`` highest scores (floored), ties to smaller ids; else null."""
    last = F.lit(2**63 - 1)
    order = [F.desc("score"), F.asc("_id"), F.asc_nulls_last("id"), "n_features", "weight"]
    runs = stored(
        scored.withColumn("_id", F.coalesce("id", last)).coalesce(most_runs)
        .sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()),
        "sorted-runs",
    )
    run, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    sizes = {r["run"]: r["n"] for r in runs.groupBy(run.alias("run")).agg(F.count("*").alias("n")).collect()}
    drawn = sum(sizes.values()) * percent // 100
    if not drawn:
        return runs.drop("_id", "_at").withColumn("rank", F.lit(None).cast("long"))
    segments = min(most_runs, -(-sum(sizes.values()) // segment_rows))
    steps = scored.sparkSession.createDataFrame(
        [(k, max(1, n // segments)) for k, n in sizes.items()], "_run bigint, _step bigint"
    )
    # At most RUNS rows.
    regular = runs.join(F.broadcast(steps), run == F.col("_run")).where(place % F.col("_step") == 0)
    samples = [(r["score"], r["_id"]) for r in regular.select("score", "_id").collect()]
    cut = _with_segment(runs, _splitters(samples, segments))
    held = dict(cut.groupBy("_segment").agg(F.count("*")).collect())
    before, reached = {}, 0
    for segment in range(segments):
        if reached < drawn:
            before[segment] = reached
        reached += held.get(segment, 0)
    prefixes = scored.sparkSession.createDataFrame(list(before.items()), "_part int, _before bigint")
    behind = F.col("_segment") > max(before)
    place_in_segment = F.row_number().over(Window.partitionBy("_segment").orderBy(*order))
    # At most RUNS rows.
    merged = (
        cut.where(~behind).repartitionById(len(before), F.col("_segment"))
        .withColumn("_place", place_in_segment)
        .join(F.broadcast(prefixes), F.col("_segment") == F.col("_part"))
        .withColumn("_rank", F.col("_before") + F.col("_place"))
        .withColumn("rank", F.when(F.col("_rank") <= drawn, F.col("_rank")))
    )
    left = cut.where(behind).withColumn("rank", F.lit(None).cast("long"))
    columns = [*scored.columns, "rank"]
    return merged.select(*columns).unionByName(left.select(*columns))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    target_col: str = "text", min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
    buckets: int = BUCKETS, longest: int = LONGEST_FEATURE, most_runs: int = RUNS,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Every document with its score, and its rank if it is drawn.

    ``percent`` of the documents of at least ``min_words`` words are drawn.
    """
    scored = stored(
        scores(docs, target, id_col, text_col, target_col, buckets, longest, seed), "scores"
    )
    ranked = rank_highest(scored.where(F.col("n_words") >= min_words), percent, most_runs, segment_rows)
    short = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(short)


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents drawn, all their columns; rows that share an id are drawn together."""
    ids = resample(docs, target, id_col, **options).where(F.col("rank").isNotNull()).select(
        F.col("id").alias("_drawn_id")
    )
    return docs.join(ids, F.col(id_col).cast("long").eqNullSafe(F.col("_drawn_id")), "left_semi")
