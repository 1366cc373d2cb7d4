"""Row-wise cleaning on a stream.

The reference has no streaming; its inputs are finite files. The row-wise
operators (broken-row flag, labels, text scalars) are built-in expressions,
so the same functions apply unchanged to a streaming DataFrame: new
annotation CSV files dropped into a folder are flagged and appended to a
parquet sink, with the checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from evtab.operators.clean import binary_label, flag_broken


def annotation_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return (spark.readStream.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(folder))


def flagged_stream(stream: DataFrame, answer: str | None = None) -> DataFrame:
    out = flag_broken(stream)
    return binary_label(out, answer) if answer else out


def start_flagging(spark: SparkSession, folder: str, schema, sink: str, checkpoint: str,
                   answer: str | None = None, available_now: bool = True) -> StreamingQuery:
    q = (flagged_stream(annotation_stream(spark, folder, schema), answer).writeStream
         .format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append"))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")
    return q.start()
