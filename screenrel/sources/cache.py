"""Results kept by the hash of what made them, as JSON files dealt by the first two digits of their key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "key string, meta string, value string, stored timestamp, prefix string"


def key_of(*parts: Column) -> Column:
    """SHA-256 of the parts, each with a zero byte after it."""
    zero = F.decode(F.unhex(F.lit("00")), "UTF-8")
    return F.sha2(F.concat(*[x for p in parts for x in (p.cast("string"), zero)]), 256)


class ResultCache:
    """A table of results; one that is not enabled holds nothing and stores nothing."""

    def __init__(self, spark: SparkSession, root: str, enabled: bool = True):
        self.spark, self.root, self.enabled = spark, root, enabled
        self.path = spark._jvm.org.apache.hadoop.fs.Path(root)
        self.files = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def entries(self) -> DataFrame:
        """All entries, the newest of each key."""
        if not self.enabled or not self.files.exists(self.path):
            return self.spark.createDataFrame([], ENTRY).drop("prefix")
        rows = self.spark.read.schema(ENTRY).json(self.root)
        return rows.groupBy("prefix", "key").agg(F.max_by(F.struct("meta", "value", "stored"), "stored").alias("e")).select("key", "e.*")

    def put(self, rows: DataFrame) -> None:
        """Stores rows (key, value, and meta if they have it)."""
        if self.enabled:
            meta = F.col("meta") if "meta" in rows.columns else F.lit(None).cast("string").alias("meta")
            rows.select("key", meta, "value", F.current_timestamp().alias("stored"), F.substring("key", 1, 2).alias("prefix")).write.mode("append").partitionBy("prefix").json(self.root)

    def get(self, keys: DataFrame) -> DataFrame:
        """key and value of each of the keys (key), null where there is none."""
        return keys.select("key").distinct().join(self.entries(), "key", "left").select("key", "value")

    def has(self, keys: DataFrame) -> DataFrame:
        return self.get(keys).select("key", F.col("value").isNotNull().alias("present"))

    def status(self) -> dict:
        return {"entries": self.entries().count(), "root": self.root}

    def clear(self) -> None:
        if self.enabled:
            self.files.delete(self.path, True)
