"""SimHash near-duplicates: pivot distance tables over candidates, links, components.

Equal fingerprints are one node from the start, so copies cost nothing further. Two
fingerprints within ``MOST_BITS`` bits differ in at most that many of ``BLOCKS`` blocks of
bits, hence agree in some ``BLOCKS - MOST_BITS`` of them: every such choice of blocks is a
key, and nodes meet at equal keys (random fingerprints are too evenly far from any pivot
for the tables alone to leave fewer than all pairs). Inside a key the Hamming distances to
``PIVOTS`` reference fingerprints are computed once per node. By the triangle inequality
a pair whose distances to some pivot differ by more than ``MOST_BITS`` is too far apart;
such pairs go, pivot by pivot, and the survivors are verified bit by bit. No link is lost.

Keys with more than ``GROUP`` nodes are dealt by hash into chunks of about that many, and
every two chunks meet in a task, so no task holds more than two chunks. A task returns a spanning forest of its
links, not the links, and the forests are joined by a distributed union.

Defined results: null text and text without words have fingerprint zero and link as any
other; texts of fewer words than a shingle are one shingle; the component of a document is
the smallest id in it; rows that share an id are one document each, judged by their own
text; an empty table gives no rows. Columns other than the two named are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotmerge.llm.common import components, free_name, stored, whole_text

WORDS = 4
SEED = 42
MOST_BITS = 4
BLOCKS = 6
PIVOTS = 24
#: Nodes of one key that one task compares.
GROUP = 2048
_BITS = 64
_STEP = 1 << 15


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """The 64 majority bits of the hashes of all word shingles, repeats included."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII rules on bytes
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), seed)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[: -words] + 1)).tolist()
    ends = ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)), ">u8", len(ends)
    )
    votes = np.zeros(_BITS, np.int64)
    for k in range(0, len(hashes), _STEP):
        bits = np.unpackbits(hashes[k : k + _STEP].view(np.uint8)).reshape(-1, _BITS)
        votes += bits.sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_h, fp): a hash and the fingerprint of every document's text, as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch[2]), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch[0], batch[1], pa.array(found.view(np.int64))], ["id", "text_h", "fp"]
            )

    text = whole_text(text_col)
    return docs.select(F.col(id_col).cast("long"), F.xxhash64(text), text).mapInArrow(
        run, "id bigint, text_h bigint, fp bigint"
    )


def _block_masks(blocks: int) -> list[int]:
    edges = [round(k * _BITS / blocks) for k in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def key_masks(blocks: int = BLOCKS, most_bits: int = MOST_BITS) -> list[int]:
    """The bits of each choice of blocks that two close fingerprints may agree in."""
    return [sum(c) for c in combinations(_block_masks(blocks), blocks - most_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def meetings(nodes: DataFrame, group: int = GROUP) -> DataFrame:
    """(choice, bits, a, b, fp): the nodes that one task compares share the first four.

    Keys of one node are left out; larger keys than ``group`` meet chunk by chunk.
    """
    keys = F.explode(F.array(*[
        F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits"))
        for k, m in enumerate(key_masks())
    ]))
    rows = nodes.select("fp", keys.alias("k")).select("fp", "k.choice", "k.bits")
    counts = rows.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / group).cast("int")
    rows = rows.join(counts.withColumn("chunks", chunks), ["choice", "bits"])
    rows = rows.withColumn("c", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.select(
        "choice", "bits", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), "fp"
    )


def _pivots() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2**64, PIVOTS, np.uint64)


def _union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give linked rows the smallest label of their component."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def forest(fps: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger, smaller fingerprint) that span the components inside each group.

    Rows of a group lie side by side, so all groups are compared at once: every row with
    the row one further, then two, until no two rows that far apart share a group.
    """
    table = np.bitwise_count(fps[:, None] ^ _pivots()[None, :]).astype(np.int16)
    label = np.arange(len(fps))
    rows = np.arange(len(fps))
    for shift in range(1, len(fps)):
        rows = rows[: np.searchsorted(rows, len(fps) - shift)]
        rows = rows[group[rows] == group[rows + shift]]
        if not len(rows):
            break
        pairs = rows
        for pivot in table.T:  # the largest coordinate difference, pivot by pivot
            pairs = pairs[np.abs(pivot[pairs] - pivot[pairs + shift]) <= MOST_BITS]
        pairs = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + shift]) <= MOST_BITS]
        _union(label, pairs, pairs + shift)
    linked = label != np.arange(len(fps))
    return fps[linked], fps[label[linked]]


def links(nodes: DataFrame, group: int = GROUP) -> DataFrame:
    """(u, v): links that connect what is within ``MOST_BITS`` bits, directly or by others."""
    place = ["choice", "bits", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last group of a batch may go on in the next
        for batch in _with_end(batches):
            if batch is not None:
                here = np.column_stack([batch[c].to_numpy() for c in place] + [batch["fp"].to_numpy()])
                held = here if held is None else np.concatenate([held, here])
            if held is None or not len(held):
                continue
            starts = np.concatenate(([True], (held[1:, :4] != held[:-1, :4]).any(axis=1)))
            whole = len(held) if batch is None else np.flatnonzero(starts)[-1]
            if whole:
                u, v = forest(held[:whole, 4].astype(np.int64).view(np.uint64), np.cumsum(starts[:whole]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"]
                )
            held = held[whole:]

    met = meetings(nodes, group).repartition(*place).sortWithinPartitions(*place, "fp")
    return met.mapInArrow(run, "u bigint, v bigint")


def _with_end(batches):
    yield from batches
    yield None


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_h, fp, root, component_id) of every document; the root names the component."""
    found = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = stored(found.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    roots = components(links(nodes.select("fp")), "simhash").select(F.col("u").alias("fp"), F.col("v").alias("root"))
    nodes = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = stored(nodes.join(least, "root").select("fp", "root", "component_id"), "simhash-components")
    return found.join(of_fp, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): every document with the smallest id of its component."""
    return _judged(docs, id_col, text_col).select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns: one with the smallest id.

    Rows are found again by id and text. Where several rows of a component have its smallest
    id, the text with the least hash stays, and rows that repeat both are reduced to one.
    """
    rows = _judged(docs, id_col, text_col).groupBy("root", "id", "text_h").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_h", "n")).alias("first")
    name = {k: free_name(docs, f"_kept_{k}") for k in ("id", "text", "own")}
    kept = stored(rows.groupBy("root").agg(first).select(
        F.col("first.id").alias(name["id"]), F.col("first.text_h").alias(name["text"]), F.col("first.n").alias("n")
    ), "simhash-kept")
    marked = docs.withColumn(name["own"], F.xxhash64(whole_text(text_col)))
    on = F.col(id_col).eqNullSafe(F.col(name["id"])) & (F.col(name["own"]) == F.col(name["text"]))

    def those(chosen: DataFrame) -> DataFrame:
        # Ids are as many as documents: both sides are dealt by key at every size.
        return marked.join(chosen.drop("n").hint("merge"), on, "left_semi")

    out = those(kept.where("n = 1"))
    if not kept.where("n > 1").isEmpty():
        out = out.union(those(kept.where("n > 1")).dropDuplicates([id_col, name["own"]]))
    return out.drop(name["own"])
