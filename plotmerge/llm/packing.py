"""Best-fit packing of tokenised documents into sequences of bounded length.

Texts are tokenised once, and only the lengths and checksums of their pieces go on.
Pieces are range-sorted by length and ranked exactly; gaps are kept sorted by size. Both
are held as runs: the pieces of one length from a rank on, and the sequences with one gap
from a number on. In each superstep, from the longest length down, a successor sweep
matches a run of pieces to the smallest gaps that hold them, as many of the length to a
gap as fit; equal pieces that compete for equal gaps are told apart by rank; the gaps
are updated and serve the next superstep, and pieces without a gap open new sequences.
This is best-fit decreasing for every single piece. Lengths are whole numbers up to the
capacity, so the sweep sees at most ``capacity`` counts however many documents there are;
each piece then finds its run by its length and rank, in the task that holds it.

Defined results: null text is empty, and an empty document is one piece with only the
end token; repeated rows are packed each; equal lengths are packed in a seeded order; an
empty table gives no rows. Columns other than the two named are never read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotmerge.llm.common import rank_in_class, stored, whole_text

#: Tokens of one sequence.
CAPACITY = 2048
#: Token behind each document.
END_ID = 0
VOCABULARY = "byte_bpe_50k"
SEED = 1

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PIECES_WITH_IDS = PIECES + ", ids array<bigint>"


@cache
def tokenizer_by_merges(vocabulary: str):
    """The tokenizer file itself."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))


@cache
def tokenizer_by_ranks(vocabulary: str):
    """The same vocabulary, split pattern and special token as ranks: the same ids, faster."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(
        vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
        special_tokens={"<|endoftext|>": len(ranks)},
    )


def token_ids(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Ids of a text as unsigned 32-bit numbers, without special tokens added."""
    try:
        return tokenizer_by_ranks(vocabulary).encode_to_numpy(text, allowed_special="all")
    except ValueError:  # the split pattern gives up on white space of megabytes
        ids = tokenizer_by_merges(vocabulary).encode(text, add_special_tokens=False).ids
        return np.asarray(ids, np.uint32)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first takes what is over."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY, with_ids: bool = False,
) -> DataFrame:
    """One row per piece, with its token ids on demand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch[0].to_pylist(), batch[1], strict=True):
                ids = np.append(token_ids(text.as_py(), vocabulary), END_ID).astype("<u4")
                for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                    part = ids[start : start + length]
                    row = (doc_id, piece, start, length, zlib.crc32(part.tobytes()))
                    rows.append((*row, part.astype(np.int64)) if with_ids else row)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (5 + with_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            kinds += [pa.list_(pa.int64())] * with_ids
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )

    texts = docs.select(F.col(id_col).cast("long"), whole_text(text_col))
    return texts.mapInArrow(run, PIECES_WITH_IDS if with_ids else PIECES)


def best_fit_runs(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, rank, n, fold, sequence, offset): where runs of pieces go.

    The n pieces of this length from this rank on lie ``fold`` to a sequence, from this
    sequence and offset on.
    """
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # runs (sequence, n)
    open_sizes = 0  # bit g is set if some sequence has a gap of g
    runs: list[tuple[int, ...]] = []
    sequences = 0
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[length]
        while left:
            fitting = open_sizes >> length
            if fitting:
                gap = length + (fitting & -fitting).bit_length() - 1
                at, many = gaps[gap].pop()
                if not gaps[gap]:
                    open_sizes ^= 1 << gap
            else:
                gap, at, many = capacity, sequences, -(-left // (capacity // length))
                sequences += many
            fold = gap // length
            full = min(many, left // fold)
            parts = [(full, fold), (1, left % fold)] if full < many and left % fold else [(full, fold)]
            used = 0
            for n, each in parts:
                if not n:
                    continue
                runs.append((length, rank, n * each, each, at + used, capacity - gap))
                rest = gap - each * length
                if rest:
                    gaps[rest].append((at + used, n))
                    open_sizes |= 1 << rest
                rank, left, used = rank + n * each, left - n * each, used + n
            if used < many:
                gaps[gap].append((at + used, many - used))
                open_sizes |= 1 << gap
    return np.array(runs, np.int64).reshape(-1, 6)


def pack(found: DataFrame, capacity: int = CAPACITY, seed: int = SEED) -> DataFrame:
    """Add sequence_id and offset to pieces (any table with doc_id, piece and length)."""
    found = stored(found, "pieces")
    ranked = rank_in_class(
        found.withColumn("_h", F.xxhash64("doc_id", "piece", F.lit(seed))), ["length"], "pieces-ranked"
    ).drop("_h")
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError("a piece is empty or longer than a sequence")
    runs = best_fit_runs(counts, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    lengths, from_ranks = runs[:, 0], runs[:, 1]
    starts = np.searchsorted(lengths, np.arange(capacity + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            run = np.empty(len(rank), np.int64)
            for k in np.unique(length):
                here, a, b = length == k, starts[k], starts[k + 1]
                run[here] = a + np.searchsorted(from_ranks[a:b], rank[here], "right") - 1
            _, first, _, fold, sequence, offset = runs[run].T
            nth = rank - first
            kept = batch.drop_columns(["_rank"])
            yield kept.append_column("sequence_id", pa.array(sequence + nth // fold)).append_column(
                "offset", pa.array(offset + nth % fold * length)
            )

    schema = ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack."""
    return pack(pieces(docs, id_col, text_col))
