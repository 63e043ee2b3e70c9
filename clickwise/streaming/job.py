"""STR-9 / STR-11: the named aggregation job.

``run_aggregation`` reads click events, splits late ones off and keeps the minute
and rollup tables, in one query: the tables see exactly the rows the splitter
accepts.  Its checkpoint folder holds offsets and the commit log per micro-batch
(the exactly-once role of the reference's periodic checkpoints); the trigger
interval plays the checkpoint-cadence role.  A failed task, and so a failed
insert, is retried by Spark (``spark.task.maxFailures``, 4 attempts by default).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from clickwise.config import JobConfig
from clickwise.schemas import CLICK_EVENT
from clickwise.sources.streams import click_event_stream, kafka_values, start_dead_letters
from clickwise.streaming.minutes import MinuteTables
from clickwise.streaming.splitter import start_splitter


@dataclass
class AggregationPaths:
    events: str          # click-event folder (when not reading Kafka)
    split_base: str      # splitter outputs: late/, late_text/, ledger/ (accepted/ if kept)
    tables_base: str     # clicks_1min/, clicks_hourly/, clicks_daily/
    checkpoint_root: str


def run_aggregation(spark: SparkSession, cfg: JobConfig, paths: AggregationPaths, fmt: str = "json",
                    use_kafka: bool = False, encoding: str = "json", part_col: str | None = None,
                    trigger: dict | None = None, max_files_per_trigger: int | None = None,
                    keep_accepted: bool = False, jdbc: dict | None = None, writers: dict[int, str] | None = None):
    """Start the job; returns its StreamingQuery.  ``jdbc`` (see ``JobConfig.jdbc``)
    also appends each minute-row version to a database table.  ``writers`` (schema id -> Avro schema):
    the topic's values are decoded by the schema their frame names, and ``dead_letters`` under the
    split folder keeps those that cannot be, by a second query."""
    events = click_event_stream(spark, cfg, paths.events, fmt, max_files_per_trigger=max_files_per_trigger,
                                use_kafka=use_kafka, encoding=encoding, writers=writers)
    if use_kafka and writers:
        start_dead_letters(kafka_values(spark, cfg, cfg.raw_clicks_topic), f"{paths.split_base}/dead_letters",
                           f"{paths.checkpoint_root}/dead_letters", CLICK_EVENT, writers,
                           trigger=trigger or {"processingTime": f"{cfg.trigger_seconds} seconds"})
    tables = MinuteTables(paths.tables_base, cfg, jdbc if jdbc is not None else cfg.jdbc)
    return start_splitter(events, paths.split_base, f"{paths.checkpoint_root}/splitter", cfg, part_col, trigger,
                          keep_accepted=keep_accepted, tables=tables,
                          late_topic_servers=cfg.kafka_bootstrap_servers if use_kafka else None)
