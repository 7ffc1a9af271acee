"""Alignment of two tokenizers: where their tokens end together, and how often which ones do.

A text is encoded by a byte-level vocabulary (A, with a space in front) and by a piece vocabulary
(B, which adds that space). Byte offsets where tokens of both end cut them into groups, and the two
tokens that end there are linked. How often two ids are linked in all documents is counted by
external spilling:

1. a task collects (pair, document, times) records; a full buffer is sorted by B id, then A id, cut
   by the low bits of the B id (the radix), and spilled as one zstd run per radix into the
   shared folder;
2. the runs of a partition are merged by a heap into runs of counts, and these again, at most
   ``FAN_IN`` at a time, until each radix has one run of totals. It is ordered by B id first, so the
   highest count of every B id is known when its last pair has passed;
3. the runs of a radix, in as many slices as their bytes ask for, stream past its totals once more
   and give back what each document's links contribute; a document's contributions are summed.

A pair that half of all links hold has one record per document and is merged before it is shuffled;
its runs lie in many slices. A run of totals is bounded by the two vocabularies (at most a
``RADICES``-th of all pairs), a slice by ``SLICE_BYTES``, a buffer by ``SPILL_RECORDS``.

Defined results: texts that are null or empty, and those whose A or B bytes are not the space and
the text (the piece vocabulary may alter them), have no tokens: numbers 0 and an empty digest; repeated
rows count each; null ids stay; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotmerge.llm.common import stored, whole_text

A_VOCABULARY = "byte_bpe_50k"
B_VOCABULARY = "piece_bpe_32k"
#: Parts by the low bits of the B id; a power of two.
RADICES = 64
#: Records of a task before they are sorted and spilled.
SPILL_RECORDS = 2_000_000
#: Records of one compressed block of a run.
BLOCK = 65_536
#: Runs that are merged at a time.
FAN_IN = 64
#: Bytes of runs that stream past one copy of the totals.
SLICE_BYTES = 8_000_000
#: A key is radix, B id and A id in 16, 24 and 24 bits.
_B, _A = 24, (1 << 24) - 1

SPILLED = (
    "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint,"
    " groups_sha256 string, radix int, first_row bigint, run binary"
)
COUNTED = "radix int, part bigint, run binary"


class Tokenizers:
    """Both vocabularies with the bytes of every token."""

    def __init__(self, a_name: str, b_name: str):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(public_tokenizers.path(f"{a_name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self._a_path = public_tokenizers.path(f"{a_name}.json")
        self._ranked = tiktoken.Encoding(
            a_name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.a_bytes[rank] = token
        pieces = sentencepiece.SentencePieceProcessor(
            model_file=public_tokenizers.path(f"{b_name}.model")
        )
        self._pieces = pieces
        self.b_bytes = [
            bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i)
            else pieces.id_to_piece(i).replace("▁", " ").encode()
            for i in range(pieces.get_piece_size())
        ]
        self.a_lengths = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_lengths = np.array(list(map(len, self.b_bytes)), np.int64)
        # Spelling of an id inside a group and at its end, A then B.
        self.spelled = [f"{i}{end}".encode() for i in range(len(self.a_bytes)) for end in ",|"]
        self.spelled += [f"{i}{end}".encode() for i in range(len(self.b_bytes)) for end in ",;"]

    def a_ids(self, text: str) -> np.ndarray:
        """Ids of A; the strings of special tokens are plain text."""
        try:
            return self._ranked.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        except ValueError:  # the split pattern gives up on white space of megabytes
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(self._a_path)
            slow.encode_special_tokens = True
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.int64)

    def b_ids(self, text: str) -> np.ndarray:
        return np.array(self._pieces.encode(text), np.int64)


@cache
def tokenizers(a_name: str = A_VOCABULARY, b_name: str = B_VOCABULARY) -> Tokenizers:
    return Tokenizers(a_name, b_name)


def align(text: str | None, both: Tokenizers) -> tuple | None:
    """(A ids, B ids, last A of each group, last B of each group), or None without tokens."""
    if not text:
        return None
    data = f" {text}".encode()
    a, b = both.a_ids(f" {text}"), both.b_ids(text)
    if b"".join(map(both.a_bytes.__getitem__, a.tolist())) != data:
        return None
    if b"".join(map(both.b_bytes.__getitem__, b.tolist())) != data:
        return None
    a_ends, b_ends = np.cumsum(both.a_lengths[a]), np.cumsum(both.b_lengths[b])
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return a, b, np.searchsorted(a_ends, common), np.searchsorted(b_ends, common)


def spell(a, b, a_last, b_last, both: Tokenizers) -> bytes:
    """The groups as decimal ids: ``a1,a2|b1;a3|b2,b3``."""
    codes = np.empty(len(a) + len(b), np.int64)
    a_group = np.searchsorted(a_last, np.arange(len(a)))
    b_group = np.searchsorted(b_last, np.arange(len(b)))
    a_at = np.arange(len(a)) + np.concatenate([[0], b_last + 1])[a_group]
    b_at = np.arange(len(b)) + (a_last + 1)[b_group]
    codes[a_at], codes[b_at] = a * 2, (b + len(both.a_bytes)) * 2
    codes[a_at[a_last]] += 1
    codes[b_at[b_last]] += 1
    return b"".join(map(both.spelled.__getitem__, codes.tolist()))[:-1]


def pack_run(*columns: np.ndarray) -> bytes:
    """Columns of equal length, the first ascending, as blocks of one zstd frame each."""
    out, squeeze = [], zstandard.ZstdCompressor(level=1).compress
    for k in range(0, len(columns[0]), BLOCK):
        keys, *rest = (c[k : k + BLOCK] for c in columns)
        parts = [np.diff(keys, prepend=np.uint64(0)).tobytes()] + [c.tobytes() for c in rest]
        frame = squeeze(b"".join(parts))
        out += [struct.pack("<II", len(keys), len(frame)), frame]
    return b"".join(out)


def blocks(run: bytes, *kinds: type) -> Iterator[list[np.ndarray]]:
    """The blocks of a run, one decompressed at a time."""
    at, unpack = 0, zstandard.ZstdDecompressor().decompress
    while at < len(run):
        n, size = struct.unpack_from("<II", run, at)
        data, at, begin = unpack(run[at + 8 : at + 8 + size]), at + 8 + size, n * 8
        found = [np.cumsum(np.frombuffer(data, np.uint64, n), dtype=np.uint64)]
        for kind in kinds:
            found.append(np.frombuffer(data, kind, n, begin))
            begin += n * np.dtype(kind).itemsize
        yield found


def _combined(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys once each, with the sums of their counts."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def merge(streams: list[Iterator]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k-way merge of ascending (keys, counts) blocks; a key comes out once, with its sum.

    The heap holds the last key of the block that each stream is at. The lowest bounds
    what may go: up to it, no stream has anything behind its block. A key that two blocks
    of one stream share waits for the second.
    """
    heads: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def refill(k: int, kept: tuple | None = None) -> None:
        block = next(streams[k], None)
        if block is not None:
            keys, counts = block[0], block[1].astype(np.int64)
            if kept is not None:
                keys, counts = np.concatenate([kept[0], keys]), np.concatenate([kept[1], counts])
        elif kept is not None:
            keys, counts = kept
        else:
            heads.pop(k, None)
            return
        heads[k] = keys, counts
        heapq.heappush(heap, (int(keys[-1]) if block is not None else 1 << 63, k))

    for k in range(len(streams)):
        refill(k)
    while heap:
        bound, k = heap[0]
        taken = []
        for j, (keys, counts) in list(heads.items()):
            n = int(np.searchsorted(keys, np.uint64(bound)))  # the last key may go on in the next block
            taken.append((keys[:n], counts[:n]))
            heads[j] = keys[n:], counts[n:]
        keys = np.concatenate([t[0] for t in taken])
        counts = np.concatenate([t[1] for t in taken])
        if len(keys):
            order = np.argsort(keys, kind="stable")
            yield _combined(keys[order], counts[order])
        if bound == 1 << 63:
            return
        heapq.heappop(heap)
        refill(k, heads[k])


def merged_run(runs: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All runs as one pair of arrays, keys ascending, merged ``FAN_IN`` at a time."""
    parts: list = [lambda r=r: blocks(r, kind) for r in runs]
    while True:
        groups = [parts[k : k + FAN_IN] for k in range(0, len(parts), FAN_IN)]
        done = []
        for group in groups:
            found = list(merge([part() for part in group]))
            done.append(tuple(np.concatenate(c) for c in zip(*found, strict=True)))
        if len(done) == 1:
            return done[0]
        parts = [lambda d=d: iter([d]) for d in done]


def spill(
    docs: DataFrame, id_col: str, text_col: str, a_name: str, b_name: str, records: int
) -> DataFrame:
    """One row per document, and rows with a radix that hold a run; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a_name, b_name)
        buffer: list[tuple[np.ndarray, np.ndarray, int]] = []
        held = 0

        def rows(columns: list, more: dict) -> pa.RecordBatch:
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links"]
            n = len(columns[0]) if columns else len(more["radix"])
            arrays = [pa.array(c, pa.int64()) for c in columns[:6]] or [pa.nulls(n, pa.int64())] * 6
            arrays += [
                pa.array(columns[6] if columns else [None] * n, pa.string()),
                pa.array(more.get("radix", [None] * n), pa.int32()),
                pa.array(more.get("first_row", [None] * n), pa.int64()),
                pa.array(more.get("run", [None] * n), pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(arrays, [*names, "groups_sha256", "radix", "first_row", "run"])

        def spilled() -> Iterator[pa.RecordBatch]:
            first_row = buffer[0][2]
            keys = np.concatenate([k for k, _, _ in buffer])
            times = np.concatenate([n for _, n, _ in buffer])
            of = np.repeat(
                np.array([r - first_row for *_, r in buffer], np.uint32), [len(k) for k, *_ in buffer]
            )
            order = np.argsort(keys, kind="stable")
            keys, times, of = keys[order], times[order], of[order]
            cuts = np.searchsorted(keys, np.arange(RADICES + 1, dtype=np.uint64) << np.uint64(48))
            for radix in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[radix], cuts[radix + 1])
                packed = pack_run(keys[part], times[part], of[part])
                yield rows([], {"radix": [int(radix)], "first_row": [first_row], "run": [packed]})

        for batch in batches:
            found = []
            for row, doc_id, text in zip(
                batch[0].to_pylist(), batch[1].to_pylist(), batch[2], strict=True
            ):
                aligned = align(text.as_py(), both)
                if aligned is None:
                    found.append((row, doc_id, 0, 0, 0, 0, ""))
                    continue
                a, b, a_last, b_last = aligned
                digest = hashlib.sha256(spell(*aligned, both)).hexdigest()
                found.append((row, doc_id, len(a), len(b), len(a_last), len(a_last), digest))
                b_id = b[b_last]
                keys = ((b_id & (RADICES - 1)) << 48 | b_id << _B | a[a_last]).astype(np.uint64)
                keys, times = np.unique(keys, return_counts=True)
                buffer.append((keys, times.astype(np.uint32), row))
                held += len(keys)
                if held >= records:
                    yield from spilled()
                    buffer, held = [], 0
            if found:
                yield rows(list(zip(*found, strict=True)), {})
        if buffer:
            yield from spilled()

    texts = docs.select(
        F.monotonically_increasing_id(), F.col(id_col).cast("long"), whole_text(text_col)
    )
    return stored(texts.mapInArrow(run, SPILLED), "alignment-runs")


def _one_run(radix: int, part: int, *columns: np.ndarray) -> pa.Table:
    return pa.table({
        "radix": pa.array([radix], pa.int32()), "part": pa.array([part], pa.int64()),
        "run": pa.array([pack_run(*columns)], pa.binary()),
    })


def _counts_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the runs of one partition to one run of counts per radix."""
    held, part = defaultdict(list), None
    for batch in batches:
        for radix, first_row, run in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held[radix].append(run)
            part = first_row if part is None else min(part, first_row)
    for radix in sorted(held):
        yield from _one_run(radix, part, *merged_run(held.pop(radix), np.uint32)).to_batches()


def _merge_counts(table: pa.Table) -> pa.Table:
    runs = table["run"].to_pylist()
    radix, part = table["radix"][0].as_py(), min(table["part"].to_pylist())
    return _one_run(radix, part, *merged_run(runs, np.int64))


def _totals_of_radix(table: pa.Table) -> pa.Table:
    """The last merge: the highest count of a B id ends with its pairs, as they come B first."""
    keys, counts = merged_run(table["run"].to_pylist(), np.int64)
    side = keys >> np.uint64(_B)
    first = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
    highest = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(keys))))
    return _one_run(table["radix"][0].as_py(), 0, keys, counts, (counts == highest).astype(np.uint8))


def count_pairs(runs: DataFrame) -> DataFrame:
    """One run of totals per radix: pair, count, and whether it is the highest of its B id."""
    parts = stored(runs.select("radix", "first_row", "run").mapInArrow(_counts_of_partition, COUNTED),
                   "alignment-counts")
    while True:
        most = parts.groupBy("radix").count().agg(F.max("count")).first()[0] or 0
        if most <= FAN_IN:
            break
        slot = F.pmod(F.xxhash64("part"), F.lit(-(-most // FAN_IN))).alias("slot")
        parts = stored(
            parts.groupBy("radix", slot).applyInArrow(_merge_counts, COUNTED), "alignment-counts"
        )
    return stored(parts.groupBy("radix").applyInArrow(_totals_of_radix, COUNTED), "alignment-totals")


def pairs(totals: DataFrame) -> DataFrame:
    """The table of linked ids: a_id, b_id, n, and whether n is the highest of the B id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch[0]:
                for keys, counts, best in blocks(run.as_py(), np.int64, np.uint8):
                    b_id = keys >> np.uint64(_B) & np.uint64(_A)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((keys & np.uint64(_A)).astype(np.int64)),
                         pa.array(b_id.astype(np.int64)), pa.array(counts), pa.array(best == 1)],
                        ["a_id", "b_id", "n", "best"],
                    )

    return totals.select("run").mapInArrow(rows, "a_id bigint, b_id bigint, n bigint, best boolean")


def _contributions(runs: pa.Table, totals: pa.Table) -> pa.Table:
    """What the links of one slice add to each document."""
    empty = [np.empty(0, np.int64)]
    found, best, sums = list(empty), list(empty), list(empty)
    if runs.num_rows:
        every = zip(*blocks(totals["run"][0].as_py(), np.int64, np.uint8), strict=True)
        all_keys, all_counts, all_best = (np.concatenate(c) for c in every)
    for first_row, run in zip(runs["first_row"].to_pylist(), runs["run"], strict=True):
        for keys, times, of in blocks(run.as_py(), np.uint32, np.uint32):
            at = np.searchsorted(all_keys, keys)
            order = np.argsort(of, kind="stable")
            at, times, of = at[order], times[order].astype(np.int64), of[order]
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            found.append(of[first] + np.int64(first_row))
            best.append(np.add.reduceat(times * all_best[at], first))
            sums.append(np.add.reduceat(times * all_counts[at], first))
    return pa.table({
        "row": np.concatenate(found), "n_best": np.concatenate(best), "count_sum": np.concatenate(sums),
    })


def contributions(runs: DataFrame, totals: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Rows (row, n_best, count_sum), several per document."""
    spark = runs.sparkSession
    sizes = runs.groupBy("radix").agg(F.sum(F.octet_length("run")).alias("n")).collect()

    def slices() -> DataFrame:  # at most RADICES rows
        rows = [(r["radix"], -(-r["n"] // slice_bytes)) for r in sizes]
        return F.broadcast(spark.createDataFrame(rows, "radix int, slices bigint"))

    dealt = runs.select("radix", "first_row", "run").join(slices(), "radix").withColumn(
        "slice", F.pmod(F.xxhash64("first_row"), F.col("slices"))
    )
    copies = totals.select("radix", "run").join(slices(), "radix").withColumn(
        "slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))
    )
    return dealt.groupBy("radix", "slice").cogroup(copies.groupBy("radix", "slice")).applyInArrow(
        _contributions, "row bigint, n_best bigint, count_sum bigint"
    )


def align_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_name: str = A_VOCABULARY,
    b_name: str = B_VOCABULARY, spill_records: int = SPILL_RECORDS, slice_bytes: int = SLICE_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(documents with their numbers, table of linked ids)."""
    spilled = spill(docs, id_col, text_col, a_name, b_name, spill_records)
    runs = spilled.where(F.col("radix").isNotNull())
    totals = count_pairs(runs)
    given_back = contributions(runs, totals, slice_bytes)
    numbers = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    per_document = spilled.where(F.col("radix").isNull()).select(
        "row", *numbers, "groups_sha256", *[F.lit(0).cast("long").alias(c) for c in ("n_best", "count_sum")]
    )
    every = per_document.unionByName(given_back, allowMissingColumns=True)
    documents = every.groupBy("row").agg(
        *[F.max(c).alias(c) for c in numbers], F.sum("n_best").alias("n_best"),
        F.sum("count_sum").alias("count_sum"), F.max("groups_sha256").alias("groups_sha256"),
    )
    return documents, pairs(totals)
