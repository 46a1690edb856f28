"""Transcripts as a stream: files that arrive, delivered-again rows dropped, calls counted in windows.

The batch operators stay the reference for results; a stream gives running views
of what arrives, with the lateness that its watermark allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.instants import instant_micros
from ..functions.transcripts import clean_tool

RECORD = (
    "record_type string, uuid string, parent_uuid string, ts string, session_id string, cwd string, message struct<role: string, content: array<struct<type: string,"
    " text: string, thinking: string, name: string, id: string, input: string, tool_use_id: string, content: string, is_error: boolean>>>, ingested_at timestamp"
)


def read_records(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def first_deliveries(records: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Rows by ``uuid`` once; state is kept as long as the watermark of ``ingested_at`` allows."""
    return records.withWatermark("ingested_at", lateness).dropDuplicatesWithinWatermark(["uuid"])


def calls_per_window(records: DataFrame, window: str = "1 hour", lateness: str = "7 days") -> DataFrame:
    """Calls and failed results per tool call window and session: window start, tool, calls."""
    at = F.timestamp_micros(instant_micros(F.col("ts")))
    blocks = records.select(at.alias("at"), F.explode("message.content").alias("b")).where("b.type = 'tool_use' and at is not null")
    marked = blocks.select("at", clean_tool(F.col("b.name")).alias("tool")).withWatermark("at", lateness)
    return marked.groupBy(F.window("at", window).alias("w"), "tool").agg(F.count("*").alias("calls")).select(F.col("w.start").alias("window_start"), "tool", "calls")


def write_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Write what is there now and stop; the checkpoint makes the next run go on from here."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
