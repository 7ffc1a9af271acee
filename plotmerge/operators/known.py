"""Which URLs are stored already: a filter first, an exact look-up for what it lets through.

The filter is a Bloom filter kept as a table, one row per 64-bit word that has a bit set. A key
sets ``BITS`` bits of one word, so building is a ``bit_or`` per word with partial sums before the
shuffle, and asking is one join on a number; the filter is broadcast where Spark finds it small, and
meets the asking side by word where it is not. Only candidates are compared by URL.

``KnownUrls`` keeps what a stream has stored, folder by folder: the filter of every folder, and
its keys sorted by hash. A look-up reads all filters, and of the keys only those of folders with
hits, at the hit hashes.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotmerge.operators.frontier import KEYS
from plotmerge.session import materialize

#: Bits that a key sets in its word.
BITS = 4
#: Keys to a word, on average; a key that is not there passes about once in 1,500 times.
KEYS_PER_WORD = 2
#: Hit hashes that are handed to the scan of the keys as a list; more of them are joined.
LISTED_HITS = 10_000

_FILTERS = "folder string, words bigint, word bigint, bits bigint"
_KEYS = "h bigint, source_name string, url string"


def key_hash(source_name: Column | str = "source_name", url: Column | str = "url") -> Column:
    return F.xxhash64(source_name, url)


def mask(h: Column) -> Column:
    """The bits of a key in its word."""
    other = F.xxhash64(h)
    out = F.lit(0).cast("bigint")
    for k in range(BITS):
        bit = F.shiftright(other, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return out


def word_count(keys: int) -> int:
    """Words of a filter for so many keys: a power of two, so that few sizes occur."""
    return 1 << max(0, (keys // KEYS_PER_WORD - 1)).bit_length()


def build_filter(hashes: DataFrame, words: int) -> DataFrame:
    """Rows (word, bits) of the keys whose hashes are in column ``h``."""
    word = F.pmod("h", F.lit(words)).alias("word")
    return hashes.groupBy(word).agg(F.bit_or(mask(F.col("h"))).alias("bits"))


def passes(h: Column, bits: Column) -> Column:
    return mask(h).bitwiseAND(bits) == mask(h)


def stored_urls(known: DataFrame) -> DataFrame:
    """Rows (source_name, url) of stored sources, as declared and as discovered."""
    out = known.select("source_name", F.col("source_url").alias("url"))
    if "ref_url" in known.columns:
        out = out.unionByName(known.select("source_name", F.col("ref_url").alias("url")))
    return out.where(F.col("url").isNotNull())


def flag_known_filtered(frontier: DataFrame, known: DataFrame) -> DataFrame:
    """Add ``known`` like ``frontier.flag_known``; URLs that the filter rules out are not shuffled.

    The frontier is stored with its verdicts, as it is read twice.
    """
    stored = stored_urls(known)
    hashes = materialize(stored.select(key_hash().alias("h")).distinct(), "known-hashes")
    words = word_count(hashes.count())
    bloom = materialize(build_filter(hashes, words), "known-filter").withColumnRenamed("word", "_word")
    h = key_hash()
    asked = materialize(
        frontier.join(bloom, F.pmod(h, F.lit(words)) == F.col("_word"), "left")
        .withColumn("_maybe", F.coalesce(passes(h, F.col("bits")), F.lit(False)))
        .drop("_word", "bits"),
        "asked",
    )
    ruled_out = asked.where(~F.col("_maybe")).drop("_maybe").withColumn("known", F.lit(False))
    candidates = asked.where("_maybe").drop("_maybe")
    wanted = candidates.select(*KEYS).distinct()
    hits = stored.join(wanted, KEYS, "left_semi").distinct().withColumn("known", F.lit(True))
    exact = candidates.join(hits, KEYS, "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return ruled_out.unionByName(exact.select(ruled_out.columns))


class KnownUrls:
    """The stored URLs of a stream, by folder (one per micro-batch)."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def add(self, urls: DataFrame, folder: str) -> None:
        """Index (source_name, url) rows as one folder; the same folder again is replaced."""
        keys = urls.where(F.col("url").isNotNull()).select(key_hash().alias("h"), *KEYS).distinct()
        path = f"{self.base}/keys/{folder}"
        keys.repartitionByRange("h").sortWithinPartitions("h").write.mode("overwrite").parquet(path)
        hashes = self.spark.read.schema(_KEYS).parquet(path).select("h")
        words = word_count(hashes.count())
        build_filter(hashes, words).select(
            F.lit(folder).alias("folder"), F.lit(words).cast("bigint").alias("words"), "word", "bits"
        ).repartitionByRange("word").write.mode("overwrite").parquet(f"{self.base}/filters/{folder}")

    def filters(self, but: str | None = None) -> DataFrame | None:
        """The filters of all folders, but for the one named."""
        try:
            found = self.spark.read.schema(_FILTERS).option("recursiveFileLookup", "true").parquet(
                f"{self.base}/filters"
            )
        except AnalysisException as e:  # nothing is stored yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return found if but is None else found.where(F.col("folder") != but)

    def hits(self, hashes: DataFrame, but: str | None = None) -> DataFrame | None:
        """Rows (h, folder): where the filters let a hash pass."""
        filters = self.filters(but)
        if filters is None:
            return None
        # A few sizes, as they are powers of two.
        sizes = [r["words"] for r in filters.select("words").distinct().collect()]
        if not sizes:
            return None
        asked = hashes.select("h").distinct().select(
            "h", F.explode(F.array(*[F.lit(s).cast("bigint") for s in sorted(sizes)])).alias("words")
        ).withColumn("word", F.pmod("h", F.col("words")))
        return asked.join(filters, ["words", "word"]).where(passes(F.col("h"), F.col("bits"))).select(
            "h", "folder"
        )

    def look_up(self, hits: DataFrame) -> DataFrame | None:
        """The stored (source_name, url) at the hits: only folders with hits are read."""
        folders = [r["folder"] for r in hits.select("folder").distinct().collect()]
        if not folders:
            return None
        keys = self.spark.read.schema(_KEYS).parquet(*[f"{self.base}/keys/{f}" for f in sorted(folders)])
        wanted = hits.select("h").distinct()
        few = wanted.limit(LISTED_HITS + 1).collect()
        if len(few) <= LISTED_HITS:  # the sorted files are skipped by their ranges of h
            return keys.where(F.col("h").isin([r["h"] for r in few])).select(*KEYS).distinct()
        return keys.join(wanted, "h", "left_semi").select(*KEYS).distinct()

    def flag(self, landed: DataFrame, but: str | None = None) -> DataFrame:
        """Add ``known`` to rows with source_name and url."""
        hits = self.hits(landed.select(key_hash().alias("h")), but)
        found = None if hits is None else self.look_up(materialize(hits, "known-hits"))
        if found is None:
            return landed.withColumn("known", F.lit(False))
        return landed.join(found.withColumn("known", F.lit(True)), KEYS, "left").withColumn(
            "known", F.coalesce("known", F.lit(False))
        )
