"""New pages as a stream: each micro-batch of component files goes through the same batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from screenrel.engine import Engine


def run_on_new_pages(spark: SparkSession, source: str, schema: StructType, operator: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Watches a folder of Parquet components and appends the operator's rows for each batch of pages."""

    def batch(df: DataFrame, batch_id: int) -> None:
        Engine(df.sparkSession, {"components": df}).run(operator).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
