"""Text filter by an index of trigrams: look up candidates, then check the text literally.

The index is two tables beside the rows: for each trigram of the lower-case text the rows that
have it, in files sorted by trigram and row, and how many they are. A search reads the postings of
the pattern's ``RAREST`` rarest trigrams, intersects them by row, reads these rows and looks for the
pattern in their text, so it finds what ``listing_filter(text=...)`` finds. A pattern shorter than a
trigram takes the rows of all trigrams that contain it; a text shorter than a trigram is
indexed as a whole.

The rows of a trigram lie in at most ``SPREAD`` files; row groups without it are skipped. One that most
rows have is read only if the pattern has no rarer ones. Null texts hold nothing; an empty pattern sets no condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
#: Trigrams of a pattern whose postings are intersected.
RAREST = 4
#: Parts that the rows of a trigram are dealt into, so that no task holds all of a common one.
SPREAD = 16
#: Candidates that are handed to the scan of the rows as a list; more of them are joined.
LISTED = 10_000

_POSTINGS = "gram string, row bigint"
_COUNTS = "gram string, n bigint"


def grams(text: Column) -> Column:
    """The distinct trigrams of a lower-case text, or the text itself if it is shorter."""
    every = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
    return F.when(F.char_length(text) < GRAM, F.array(text)).otherwise(F.array_distinct(every))


def pattern_grams(text: str) -> list[str]:
    """The distinct trigrams of a pattern, in their order."""
    lower = text.lower()
    return list(dict.fromkeys(lower[k : k + GRAM] for k in range(len(lower) - GRAM + 1)))


class TextIndex:
    """Rows and their trigram index below one base path."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def build(self, df: DataFrame, columns: list[str]) -> TextIndex:
        """Write the rows, and the index of the text columns."""
        numbered = df.withColumn("_row", F.monotonically_increasing_id())
        numbered.write.parquet(f"{self.base}/rows")
        rows = self.spark.read.schema(numbered.schema).parquet(f"{self.base}/rows")
        none = F.array().cast("array<string>")
        held = F.array_distinct(F.concat(*[F.coalesce(grams(F.lower(F.col(c))), none) for c in columns]))
        postings = rows.select(F.explode(held).alias("gram"), F.col("_row").alias("row"))
        # Dealt by hash: ranges would be found by cutting all texts once more.
        dealt = postings.repartition("gram", F.pmod("row", F.lit(SPREAD)))
        dealt.sortWithinPartitions("gram", "row").write.parquet(f"{self.base}/postings")
        counts = self._postings().groupBy("gram").agg(F.count("*").alias("n"))
        counts.sort("gram").write.parquet(f"{self.base}/counts")
        self.spark.createDataFrame([(c,) for c in columns], "name string").coalesce(1).write.parquet(
            f"{self.base}/columns"
        )
        return self

    def _postings(self) -> DataFrame:
        return self.spark.read.schema(_POSTINGS).parquet(f"{self.base}/postings")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/rows")

    def columns(self) -> list[str]:
        return [r["name"] for r in self.spark.read.schema("name string").parquet(f"{self.base}/columns").collect()]

    def candidates(self, text: str) -> DataFrame:
        """Rows (row) that may hold the pattern: all that do, and few others."""
        wanted = pattern_grams(text)
        if not wanted:
            return self._postings().where(F.col("gram").contains(text.lower())).select("row").distinct()
        counts = self.spark.read.schema(_COUNTS).parquet(f"{self.base}/counts")
        found = {r["gram"]: r["n"] for r in counts.where(F.col("gram").isin(wanted)).collect()}
        if len(found) < len(wanted):  # a trigram that no row has
            return self._postings().limit(0).select("row")
        rarest = sorted(wanted, key=lambda g: (found[g], g))[:RAREST]
        held = self._postings().where(F.col("gram").isin(rarest))
        if len(rarest) == 1:
            return held.select("row")
        return held.groupBy("row").count().where(F.col("count") == len(rarest)).select("row")

    def search(self, text: str) -> DataFrame:
        """The rows with the pattern in any of the indexed columns."""
        rows = self.rows()
        if not text:
            return rows.drop("_row")
        candidates = self.candidates(text)
        few = candidates.limit(LISTED + 1).collect()
        if len(few) <= LISTED:  # files and row groups are skipped by their ranges of rows
            read = rows.where(F.col("_row").isin([r["row"] for r in few])) if few else rows.limit(0)
        else:
            read = rows.join(candidates.withColumnRenamed("row", "_row"), "_row", "left_semi")
        holds = F.lit(False)
        for c in self.columns():
            holds = holds | F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False))
        return read.where(holds).drop("_row")
