"""Message-shaped outputs: late-record text (SNK-2), aggregates as JSON
(SNK-3), click events keyed by ad (SNK-4).

Each returns a ``key``/``value`` DataFrame, the shape the Kafka sink takes.
Where the Kafka / Avro packages are on the class path the same frame goes to
``format("kafka")``; otherwise it is written as files (see ``write_messages``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clickwise.functions.timefmt import late_text
from clickwise.sources.streams import add_frame, avro_schema

AGGREGATE_FIELDS = ["window_start_ms", "window_end_ms", "ad_id", "advertiser_id", "country",
                    "device_type", "click_count", "unique_sessions"]


def late_messages(late_rows: DataFrame) -> DataFrame:
    """PRJ-5 / SNK-2: ``LATE:<click id> adId=<ad id>``, no key."""
    return late_rows.select(F.lit(None).cast("string").alias("key"),
                            late_text("click_id", "ad_id").alias("value"))


def aggregate_messages(aggregates: DataFrame) -> DataFrame:
    """SNK-3: key = ad id, value = JSON of the aggregate."""
    return aggregates.select(F.col("ad_id").alias("key"),
                             F.to_json(F.struct(*AGGREGATE_FIELDS)).alias("value"))


def event_messages(events: DataFrame, use_avro: bool = False, fields=None, keep=(), schema_id: int = 1) -> DataFrame:
    """SNK-4: key = ad id (same ad -> same partition), value = the event.

    JSON keeps null fields (as the Avro record does) so every message has
    the same field set; Avro values carry the registry frame that readers strip.
    ``keep`` columns pass through beside key/value."""
    value = F.struct(*(fields or [c for c in events.columns if c not in keep]))
    if use_avro:
        from pyspark.sql.avro.functions import to_avro  # needs the spark-avro package
        encoded = add_frame(to_avro(value, avro_schema()), schema_id)
    else:
        encoded = F.to_json(value, {"ignoreNullFields": "false"})
    return events.select(*keep, F.col("ad_id").alias("key"), encoded.alias("value"))


def kafka_available(spark) -> bool:
    try:
        spark.sparkContext._jvm.java.lang.Class.forName(
            "org.apache.spark.sql.kafka010.KafkaSourceProvider")
        return True
    except Exception:
        return False


def write_messages(df: DataFrame, topic: str, bootstrap: str | None, path: str | None) -> None:
    """Batch write to Kafka when configured, else to JSON files under ``path``."""
    if bootstrap:
        (df.write.format("kafka").option("kafka.bootstrap.servers", bootstrap)
           .option("topic", topic).save())
    else:
        df.write.mode("append").json(f"{path.rstrip('/')}/{topic}")
