"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are range-sorted by length (norm), longest first, and cut into buckets of
similar length; queries come in blocks. Each query first meets the bucket of the longest
vectors, which gives it a score that its k-th best cannot be below. A block of queries and
a bucket then meet only if the longest vector of the bucket could reach some query's
score. Inside, the score and the lengths give each query a local cosine threshold: over 1
the bucket is done for it. Otherwise the bucket is pruned by length (vectors too short for
the threshold), or, where thresholds are high, by coordinate (vectors whose value in the
query's strongest coordinate rules the cosine out); what is left is verified by integer
products, and the score rises. Pruning only drops what is strictly below the k-th score,
so ties stay exact.

Vectors are integers: floor(256 * x) of each component. Defined results: vectors that are
null, empty, or hold a null or non-finite component take no part; shorter vectors count as
ending in zeros; rows with the query's id are the query's own; repeated queries count
once, repeated candidates each; an empty table gives no rows; products must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotmerge.llm.common import stored

K = 5
SCALE = 256
#: Vectors of a bucket, queries of a block, buckets that one task meets with one block.
BUCKET, BLOCK, RUN = 2048, 1024, 32
#: Median local cosine threshold from which on coordinates prune better than lengths.
COORDINATE = 0.6
_SLACK = 1 + 1e-9


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v, norm) of the vectors that take part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    ints = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(finite & (F.size(v) > 0), ints).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return given.where("v is not null and id is not null").withColumn("norm", norm)


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(block, longest, ids, sizes, flat): runs of ``size`` rows of the range-sorted input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def out(table: pa.Table) -> pa.RecordBatch:
            v = table["v"].combine_chunks()
            return pa.RecordBatch.from_arrays([
                pa.array([table["at"][0].as_py()], pa.int64()), pa.array([table["norm"][0].as_py()], pa.float64()),
                pa.array([table["id"].to_pylist()], pa.list_(pa.int64())),
                pa.array([v.value_lengths().to_pylist()], pa.list_(pa.int32())),
                pa.array([v.flatten()], pa.list_(pa.int64())),
            ], ["block", "longest", "ids", "sizes", "flat"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                table = pa.Table.from_batches(held)
                yield out(table.slice(0, size))
                held, n = table.slice(size).to_batches(), n - size
        if n:
            yield out(pa.Table.from_batches(held))

    ordered = rows.repartitionByRange(F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id")
    return ordered.withColumn("at", F.monotonically_increasing_id()).mapInArrow(
        run, "block bigint, longest double, ids array<bigint>, sizes array<int>, flat array<bigint>"
    )


def _dense(sizes: np.ndarray, flat: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _matrix(table: pa.Table, row: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids, sizes, flat = (table[c][row].values.to_numpy(zero_copy_only=False) for c in ("ids", "sizes", "flat"))
    return ids, _dense(sizes, flat, width)


def _width(*tables: pa.Table) -> int:
    return max(max(s.values.to_numpy().max() for s in t["sizes"]) for t in tables)


class Best:
    """The k best candidates of each query of a block so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.vectors, self.k, self.floor = ids, vectors, k, floor.copy()
        exact = vectors.astype(float)
        self.norms = np.sqrt((exact**2).sum(axis=1))
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]
        strongest = np.abs(exact).argmax(axis=1) if vectors.shape[1] else np.zeros(len(ids), int)
        self.focus = strongest
        self.focus_cos = exact[np.arange(len(ids)), strongest] / np.maximum(self.norms, 1e-300)

    def meet(self, ids: np.ndarray, vectors: np.ndarray, coordinate: float = COORDINATE) -> None:
        """Try a bucket, sorted by length, longest first."""
        exact = vectors.astype(float)
        norms = np.sqrt((exact**2).sum(axis=1))
        longest = norms.max() * _SLACK
        reach = self.norms * longest
        with np.errstate(divide="ignore", invalid="ignore"):
            # The least cosine with the longest vector that reaches the floor.
            local = np.where(reach > 0, self.floor / reach, np.where(self.floor > 0, 2.0, -1.0))
        active = np.flatnonzero(~(local > 1))
        if not len(active):
            return
        small = longest * max(self.norms.max(), 1.0) < 2.0**52  # then float products are exact
        if np.median(np.maximum(local[active], -1)) >= coordinate:
            cosines = exact / np.maximum(norms, 1e-300)[:, None]
            for q in active:
                t, f = max(local[q], 0.0) / _SLACK, abs(self.focus_cos[q])
                spread = np.sqrt(max(0.0, 1 - t * t) * max(0.0, 1 - f * f)) * _SLACK + 1e-9
                c = cosines[:, self.focus[q]] * (1 if self.focus_cos[q] >= 0 else -1)
                # Not further from the coordinate's axis than the query and the threshold allow.
                wide = local[q] < 0 or norms == 0
                rows = np.flatnonzero((c >= f * t - spread) | wide)
                self._verify(q, ids[rows], vectors[rows] @ self.vectors[q])
            return
        # By length: the shortest vector that could still reach the least floor.
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(self.norms[active] > 0, self.floor[active] / self.norms[active], -np.inf).min()
        n = int((norms * _SLACK >= least).sum()) if least > 0 else len(norms)
        if small:
            scores = (self.vectors[active].astype(float) @ exact[:n].T).astype(np.int64)
        else:
            scores = self.vectors[active] @ vectors[:n].T
        for q, s in zip(active, scores, strict=True):
            rows = np.flatnonzero(s >= self.floor[q])
            self._verify(q, ids[rows], s[rows])

    def _verify(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Keep the k best: higher score first, then the smaller id."""
        good = (scores >= self.floor[q]) & (ids != self.ids[q])
        ids, scores = ids[good], scores[good]
        if not len(ids):
            return
        if len(ids) > self.k:
            order = np.lexsort((ids, -scores))[: self.k]
            ids, scores = ids[order], scores[order]
        both = self.found[q] + list(zip((-scores).tolist(), ids.tolist(), strict=True))
        self.found[q] = sorted(both)[: self.k]
        if len(self.found[q]) == self.k:
            self.floor[q] = max(self.floor[q], -self.found[q][-1][0])


_NO_FLOOR = -(2.0**63)
_BLOCK = ["block", "longest", "ids", "sizes", "flat"]


def first_floors(queries: DataFrame, head: DataFrame, k: int) -> DataFrame:
    """Query blocks with ``floors``: for each query a score its k-th best is not below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            floors = []
            for row in range(table.num_rows):
                one = table.slice(row, 1)
                other = one.select([f"h_{c}" for c in _BLOCK]).rename_columns(_BLOCK)
                width = _width(one, other)
                ids, vectors = _matrix(one, 0, width)
                best = Best(ids, vectors, np.full(len(ids), _NO_FLOOR), k)
                best.meet(*_matrix(other, 0, width))
                floors.append(best.floor.tolist())
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in _BLOCK], pa.array(floors, pa.list_(pa.float64()))], [*_BLOCK, "floors"]
            )

    head = head.select(F.lit(0).alias("one"), *[F.col(c).alias(f"h_{c}") for c in _BLOCK])
    met = queries.withColumn("one", F.lit(0)).join(F.broadcast(head), "one").drop("one")  # one bucket
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema.fields}
    return met.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in _BLOCK) + ", floors array<double>")


def _meet(k: int):
    def run(queries: pa.Table, buckets: pa.Table) -> pa.Table:
        width = _width(queries, buckets)
        ids, vectors = _matrix(queries, 0, width)
        best = Best(ids, vectors, queries["floors"][0].values.to_numpy(), k)
        for row in np.argsort(-buckets["longest"].to_numpy(), kind="stable"):
            best.meet(*_matrix(buckets, int(row), width))
        rows = [(q, c, -s) for q, found in zip(ids.tolist(), best.found, strict=True) for s, c in found]
        columns = zip(*rows, strict=True) if rows else [(), (), ()]
        names = ["query_id", "vec_id", "score"]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of each query, all if fewer."""
    given = stored(integers(vectors, id_col, vector_col), "topk-integers")
    chosen = integers(vectors.where(is_query), id_col, vector_col).distinct()
    buckets = stored(blocks(given, BUCKET), "topk-buckets")
    queries = blocks(chosen, BLOCK)
    head = buckets.orderBy("block").limit(1)
    queries = stored(first_floors(stored(queries, "topk-queries"), head, k), "topk-floors")
    # A run is ``RUN`` buckets in a row; a block and a run meet if some product could count.
    run = (F.col("block") - F.pmod("block", F.lit(BUCKET * RUN))).alias("run")
    runs = buckets.groupBy(run).agg(F.max("longest").alias("run_longest"))
    reach = F.col("longest") * F.col("run_longest") * F.lit(_SLACK)
    pairs = queries.select("block", "longest", F.array_min("floors").alias("least")).join(
        F.broadcast(runs), reach >= F.col("least")  # one row per 65,536 vectors
    ).select("block", "run")
    left = queries.join(pairs, "block").select(*_BLOCK, "floors", "run")
    right = buckets.withColumn("run", run).join(pairs.select("run", F.col("block").alias("with")), "run")
    met = left.groupBy("block", "run").cogroup(right.groupBy("with", "run")).applyInArrow(
        _meet(k), "query_id bigint, vec_id bigint, score bigint"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
