"""Exact dedup against a minimal perfect hash of the digests seen earlier.

The index of the earlier rows is a table with one row per partition of the digest
space: the bit levels of a minimal perfect hash, and one slot per distinct digest that
holds the whole digest, the locator of the row that stays, and the number of its copies.
A looked-up digest always lands in some slot, so its bytes are compared with those in the
slot: equal is a repeat, anything else is new, and new digests are grouped on their own.

Copies are folded to one row per digest before they are shuffled, so a group of copies of
any size costs one lookup, and a partition holds about ``PART_ROWS`` digests at any scale.

Defined results: null text counts as empty; rows that repeat an id and its text are
copies, of which one stays; a null id stays only if no copy has an id; an empty table
gives no rows. Columns other than the two named are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotmerge.llm.common import free_name, partitions, stored, whole_text

#: Distinct digests in one partition of the index, on average.
PART_ROWS = 200_000
#: Bits per digest still without a slot, in each level of the hash.
BITS_PER_DIGEST = 2
_DIGEST_BYTES = 32

INDEX_SCHEMA = (
    "part int, levels array<binary>, digests array<binary>,"
    " ids array<bigint>, rows array<bigint>, counts array<bigint>"
)


def digest_table(docs: DataFrame, id_col: str, text_col: str, earlier: Column | None) -> DataFrame:
    """(id, row, digest, earlier): one row per document; ``row`` tells equal ids apart."""
    flag = F.lit(False) if earlier is None else F.coalesce(earlier, F.lit(False))
    return docs.select(
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(whole_text(text_col), 256)).alias("digest"),
        flag.alias("earlier"),
    )


def groups(digests: DataFrame) -> DataFrame:
    """(digest, id, row, n): the row that stays of each digest, and how many have it."""
    best = F.max(F.struct("id", "row"))
    return digests.groupBy("digest").agg(best.alias("w"), F.count("*").alias("n")).select(
        "digest", F.col("w.id").alias("id"), F.col("w.row").alias("row"), "n"
    )


def _words(column: pa.ChunkedArray) -> np.ndarray:
    """Digests as rows of four unsigned words."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, _DIGEST_BYTES // 8)


def _spot(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of each digest in a level: its four words mixed with odd multipliers."""
    h = np.full(len(words), (0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1), np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(size)).astype(np.int64)


def _build(table: pa.Table) -> pa.Table:
    """Minimal perfect hash of one partition: digests alone on a bit of a level own it."""
    words = _words(table["digest"])
    left, slot, used, levels = np.arange(len(words)), np.empty(len(words), np.int64), 0, []
    while len(left):
        size = max(64, BITS_PER_DIGEST * len(left))
        size += -size % 8
        at = _spot(words[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        slot[left[alone[at]]] = used + (np.cumsum(alone) - 1)[at[alone[at]]]
        used += int(alone.sum())
        levels.append(np.packbits(alone).tobytes())
        left = left[~alone[at]]
    order = pa.array(np.argsort(slot))
    row = {"part": pa.array([table["part"][0].as_py()], pa.int32()), "levels": pa.array([levels], pa.list_(pa.binary()))}
    for name, source in (("digests", "digest"), ("ids", "id"), ("rows", "row"), ("counts", "n")):
        values = table[source].combine_chunks().take(order)
        row[name] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.table(row)


def build_index(history: DataFrame, parts: int) -> DataFrame:
    """The index of ``groups()`` of the earlier rows; write it to use it again."""
    part = F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int")
    return history.withColumn("part", part).groupBy("part").applyInArrow(_build, INDEX_SCHEMA)


def _slots(words: np.ndarray, levels: list[bytes]) -> np.ndarray:
    """The slot of each digest, -1 for a digest that no level has a bit for."""
    slot, left, used = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for level, packed in enumerate(levels):
        bits = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        at = _spot(words[left], level, len(bits))
        hit = bits[at]
        slot[left[hit]] = used + (np.cumsum(bits) - 1)[at[hit]]
        used += int(bits.sum())
        left = left[~hit]
    return slot


def _look_up(probes: pa.Table, index: pa.Table) -> pa.Table:
    n = probes.num_rows
    found = {k: pa.nulls(n, pa.int64()) for k in ("ids", "rows", "counts")}
    known = pa.array(np.zeros(n, bool))
    if n and index.num_rows:
        slot = _slots(_words(probes["digest"]), index["levels"][0].as_py())
        slot = pa.array(slot, mask=slot < 0)
        kept = index["digests"][0].values.take(slot)
        known = pc.fill_null(pc.equal(kept, probes["digest"].combine_chunks()), False)
        slot = pc.if_else(known, slot, pa.scalar(None, pa.int64()))
        found = {k: index[k][0].values.take(slot) for k in found}
    return pa.table(
        {"digest": probes["digest"], "id": probes["id"], "row": probes["row"], "n": probes["n"],
         "known": known, "old_id": found["ids"], "old_row": found["rows"], "old_n": found["counts"]}
    )


def look_up(probes: DataFrame, index: DataFrame, parts: int, copies: int = 1) -> DataFrame:
    """``groups()`` of new rows, each with what the index has for its digest.

    ``copies`` deals the probes of a partition to so many tasks, for deliveries that are
    much larger than the history.
    """
    part = F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int")
    deal = F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(copies)).cast("int")
    left = probes.withColumn("part", part).withColumn("deal", deal).groupBy("part", "deal")
    right = index.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).groupBy("part", "deal")
    return left.cogroup(right).applyInArrow(
        _look_up,
        "digest binary, id bigint, row bigint, n bigint, known boolean,"
        " old_id bigint, old_row bigint, old_n bigint",
    )


def earlier_half(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """Rows in the lower half of the id range: the delivery that came first."""
    low, high = docs.agg(F.min(id_col), F.max(id_col)).first()
    return F.lit(False) if low is None else F.col(id_col) <= F.lit((low + high) // 2)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", earlier: Column | None = None
) -> DataFrame:
    """(id, row, digest, keep_id, group_size, kept): the verdict on every row.

    Rows where ``earlier`` holds are the history that is indexed; the others are looked
    up in it. Of equal texts the row with the largest id stays, wherever it came from.
    """
    table = stored(digest_table(docs, id_col, text_col, earlier), "digests")
    history = stored(groups(table.where("earlier")), "history")
    fresh = stored(groups(table.where("not earlier")), "fresh")
    n_old, n_new = history.count(), fresh.count()
    parts = partitions(n_old, PART_ROWS)
    index = stored(build_index(history, parts), "index")
    looked = stored(look_up(fresh, index, parts, partitions(n_new, PART_ROWS * parts)), "looked-up")
    repeats = looked.where("known").select(
        "digest",
        F.greatest(F.struct("id", "row"), F.struct(F.col("old_id").alias("id"), F.col("old_row").alias("row"))).alias("w"),
        (F.col("n") + F.col("old_n")).alias("n"),
    )
    new = looked.where("not known").groupBy("digest").agg(
        F.max(F.struct("id", "row")).alias("w"), F.sum("n").alias("n")
    )
    untouched = history.join(repeats, "digest", "left_anti").select(
        "digest", F.struct("id", "row").alias("w"), "n"
    )
    winners = repeats.union(new).union(untouched).select(
        "digest", F.col("w.id").alias("keep_id"), F.col("w.row").alias("keep_row"),
        F.col("n").alias("group_size"),
    )
    return table.join(winners, "digest").select(
        "id", "row", "digest", "keep_id", "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
    )


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    They are found again by id and digest. Only where one id has the same text in several
    rows is that not enough, and those few are reduced to one by their id and digest.
    """
    verdict = exact_dedup(docs, id_col, text_col, earlier_half(docs, id_col))
    same = verdict.groupBy("id", "digest").agg(
        F.max("kept").alias("kept"), F.count("*").alias("n")
    ).where("kept")
    id_name, digest_name, own = (free_name(docs, c) for c in ("_id", "_keep", "_digest"))
    keep = stored(
        same.select(F.col("id").alias(id_name), F.col("digest").alias(digest_name), "n"), "kept"
    )
    marked = docs.withColumn(own, F.unhex(F.sha2(whole_text(text_col), 256)))

    def those(chosen: DataFrame) -> DataFrame:
        # Ids are as many as documents: both sides are dealt by key at every size.
        chosen = chosen.drop("n").hint("merge")
        on = F.col(id_col).eqNullSafe(F.col(id_name)) & (F.col(own) == F.col(digest_name))
        return marked.join(chosen, on, "left_semi")

    out = those(keep.where("n = 1"))
    if not keep.where("n > 1").isEmpty():
        out = out.union(those(keep.where("n > 1")).dropDuplicates([id_col, own]))
    return out.drop(own)
