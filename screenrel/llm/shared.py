"""What the operators share: the folder that every machine sees, cut points in the lineage, and reading tables."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


MAX_BITS = 1 << 25


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a session on one machine (as in tests) gets one of its own; a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(name: str, taken: list[str]) -> str:
    """The name, with underscores before it until no column of these has it in any case of letters."""
    have = {x.lower() for x in taken}
    while name.lower() in have:
        name = "_" + name
    return name


def probable(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key is, or by a hash collision may be, among wanted (one column, key). Only a bitmap is broadcast: MAX_BITS / 64 rows at most; a full one lets more rows through, no fewer."""
    bits = min(MAX_BITS, max(1 << 12, 1 << (16 * wanted.count()).bit_length()))
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    words = wanted.select(slot.alias("_slot")).groupBy(F.expr("_slot div 64").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_slot % 64 as int)))").alias("_mask"))
    marked = rows.withColumn("_slot", slot).join(F.broadcast(words), F.expr("_slot div 64 = _word"))
    return marked.where("_mask & shiftleft(1L, cast(_slot % 64 as int)) <> 0").select(*rows.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of queries whose results are written: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(df: DataFrame) -> None:
    """Deletes a written table that nothing reads any more."""
    files = df.inputFiles()
    if files:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
