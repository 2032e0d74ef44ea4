"""The bulk parser on a stream of messages: stateless, one result per message, results and rejects apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..jobs.parse import parse, prepare

RESULTS, REJECTS = "results", "rejects"


def parse_stream(messages: DataFrame, label: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start the query: messages (message_id, text) -> prepared -> label() adds tokens -> parsed rows below out_path.

    Each micro-batch is parsed in one pass into out_path/batch=<id>, with a folder for results and one for rejects (rows with an
    error code). The batch id is the key of the write: a batch that is repeated after a restart replaces what it left.
    """

    def write(parsed: DataFrame, batch_id: int) -> None:
        kind = F.when(F.col("error_code").isNull(), RESULTS).otherwise(REJECTS)
        parsed.withColumn("kind", kind).write.partitionBy("kind").mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    writer = parse(label(prepare(messages))).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_parsed(spark: SparkSession, out_path: str, kind: str | None = None) -> DataFrame:
    """What parse_stream has written: results, rejects or (kind null) both, with the batch of each row."""
    rows = spark.read.parquet(out_path)
    return rows if kind is None else rows.filter(F.col("kind") == kind).drop("kind")
