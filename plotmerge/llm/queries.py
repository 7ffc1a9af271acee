"""The registered queries of the operators, with comparison SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotmerge.llm import (
    alignment,
    exact_dedup,
    html_text,
    license_scan,
    line_dedup,
    mixing,
    packing,
    pii,
    resampling,
    simhash,
    topk,
    toxicity,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row of its text that stays."""
    docs = table(spark, sf_dir, "documents")
    return exact_dedup.exact_dedup(docs, earlier=exact_dedup.earlier_half(docs)).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE_SQL["op9_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words the mix takes of it."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and its component."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
    )


@query
def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the probabilities of the chain and the verdict."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.judge(docs, labels).withColumnRenamed("id", "doc_id")


@query
def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the deduplicated archives."""
    return warc.archive(table(spark, sf_dir, "pages"))


ORACLE_SQL["op2_warc_revisits"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload) AS response FROM p
)
SELECT page_id,
       CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < response THEN response END AS refers_to
FROM g
"""


@query
def op7_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op8_norm_bucket_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE_SQL["op8_norm_bucket_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank,
         vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op3_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document with the line of its class that stays."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "line", F.col("keep_id").alias("keep_doc_id"), "keep_line",
        "class_size", "kept",
    )


@query
def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by surrogates."""
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its importance weight and, if drawn, its rank."""
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resampling.resample(docs, target).select(
        F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank"
    )


#: The checksum of a feature, byte by byte over the table of all byte checksums.
ORACLE_SQL["op11_importance_resampling"] = r"""
WITH crc AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))
), texts AS (
  SELECT 'd' AS side, row_number() OVER () AS n, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
), split AS MATERIALIZED (
  SELECT side, n, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), features AS MATERIALIZED (
  SELECT side, n, unnest(w || list_transform(range(1, len(w)),
    lambda i: w[i] || ' ' || w[i + 1])) AS f
  FROM split
), buckets AS MATERIALIZED (
  SELECT f, xor(list_reduce([4294967295] || list_transform(range(octet_length(encode(f))),
      lambda i: CAST('0x' || substr(hex(encode(f)), CAST(2 * i + 1 AS INT), 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM features), crc
), counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t
  FROM features JOIN buckets USING (f) GROUP BY bucket
), totals AS (SELECT sum(s) AS s, sum(t) AS t FROM counts
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((c.t + 1) * (a.s + 10000) AS DOUBLE)
    / CAST((c.s + 1) * (a.t + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM counts c, totals a
), weights AS (
  SELECT n, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
  FROM features JOIN buckets USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY n
), scored AS (
  SELECT n, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
    coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8)
      AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM split LEFT JOIN weights USING (n) WHERE side = 'd'
), ranked AS (
  SELECT n, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS total
  FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * total // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (n)
"""


@query
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its licences."""
    return license_scan.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _values(rows) -> str:
    def cell(value):
        return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)

    return "VALUES " + ", ".join("(" + ", ".join(map(cell, row)) + ")" for row in rows)


#: Votes of rare words by relative position, then the key phrases read at their places.
ORACLE_SQL["op12_license_scan"] = r"""
WITH base(label, p) AS (
  SELECT label, regexp_extract_all(text, '[a-z0-9]+') FROM (%(base)s) b(label, text)
), templates(t, label, p) AS (
  SELECT t, label, regexp_extract_all(lower(text), '[a-z0-9]+') FROM (%(templates)s) b(t, label, text)
), keys(t, p) AS (
  SELECT t, regexp_extract_all(text, '[a-z0-9]+') FROM (%(keys)s) b(t, text)
), d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), words AS MATERIALIZED (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d
), places AS MATERIALIZED (
  SELECT r, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(p)] = p)) AS pos
  FROM d, base
), passages AS (
  SELECT t, unnest(p) AS word, generate_subscripts(p, 1) - 1 AS q FROM templates
), held AS (
  SELECT word, count(DISTINCT r) AS n FROM words
  WHERE word IN (SELECT word FROM passages) GROUP BY word
), idf AS (
  SELECT word, CAST(floor(1000 * ln(CAST(1 + (SELECT count(*) FROM d) AS DOUBLE)
    / (1 + coalesce(n, 0)))) AS BIGINT) AS idf
  FROM (SELECT DISTINCT word FROM passages) LEFT JOIN held USING (word)
), ordered AS (
  SELECT t, word, idf, row_number() OVER (PARTITION BY t ORDER BY idf DESC, word) AS k,
    count(*) OVER (PARTITION BY t) AS n
  FROM (SELECT DISTINCT t, word FROM passages) JOIN idf USING (word)
), postings AS (
  SELECT t, word, q, idf FROM passages JOIN ordered USING (t, word)
  WHERE k <= least(%(rare)d, (n + 1) // 2)
), totals AS (SELECT t, sum(idf) AS total FROM postings GROUP BY t
), votes AS (
  SELECT r, t, pos - q AS position, sum(idf) AS mass
  FROM words JOIN postings USING (word) GROUP BY ALL
), checks AS (
  SELECT t, p, list_filter(range(len(whole)), lambda i: whole[i + 1:i + len(p)] = p)[1] AS q
  FROM keys JOIN (SELECT t, p AS whole FROM templates) USING (t)
), found AS (
  SELECT r, label, CAST(mass AS DOUBLE) / CAST(total AS DOUBLE) AS score
  FROM votes v JOIN totals USING (t) JOIN templates USING (t) JOIN d USING (r)
  WHERE mass * 2 >= total AND v.t NOT IN (
    SELECT c.t FROM checks c WHERE c.t = v.t
      AND (position + q < 0 OR w[position + q + 1:position + q + len(c.p)] <> c.p))
), own AS (SELECT r, list(label) AS labels, max(score) AS score FROM found GROUP BY r
), b AS (
  SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(label) AS labels
  FROM places GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(list_distinct(coalesce(b.labels, []))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(coalesce(b.labels, []) || coalesce(own.labels, []))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(own.score, 0.0) END AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN own USING (r)
""" % {
    "base": _values(license_scan.BASE),
    "templates": _values((t, x.label, x.text) for t, x in enumerate(license_scan.TEMPLATES)),
    "keys": _values((t, key) for t, x in enumerate(license_scan.TEMPLATES) for key in x.keys),
    "rare": license_scan.RARE_WORDS,
}


@query
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the numbers of its aligned tokens and links."""
    documents, _ = alignment.align_documents(table(spark, sf_dir, "documents"))
    return documents.drop("row")
