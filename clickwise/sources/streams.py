"""Stream sources (SRC-1, SRC-2, SRC-3).

With a Kafka bootstrap configured and the Kafka package on the class path the
raw-click topic is read from the earliest offset (the checkpoint replaces the
consumer group); values are registry-framed Avro (5-byte frame stripped, then
``from_avro``) or JSON.  Without Kafka, the same schema is read from a folder
of JSON / parquet files — the path every test takes.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from clickwise.config import JobConfig
from clickwise.schemas import CLICK_EVENT, CLICK_REQUEST

# Schema-registry frame (magic byte 0, 4-byte schema id) and the
# symbols of the device type enum, in their encoded order.
REGISTRY_FRAME_BYTES = 5
DEVICE_SYMBOLS = ["DESKTOP", "MOBILE", "TABLET", "UNKNOWN"]


def avro_schema(schema: T.StructType = CLICK_EVENT) -> str:
    """The record's Avro schema: required fields plain, optional ones a union with
    null, the device type an enum (encoded as the symbol's number, not as text)."""
    kinds = {T.StringType: "string", T.LongType: "long", T.IntegerType: "int", T.BooleanType: "boolean"}
    fields = []
    for f in schema.fields:
        t = {"type": "enum", "name": "DeviceType", "symbols": DEVICE_SYMBOLS} if f.name == "device_type" else kinds[type(f.dataType)]
        fields.append({"name": f.name, "type": ["null", t], "default": None} if f.nullable else {"name": f.name, "type": t})
    return json.dumps({"type": "record", "name": "ClickEvent", "namespace": "clickwise", "fields": fields})


def add_frame(value: Column, schema_id: int) -> Column:
    """Put the registry frame before an Avro body."""
    return F.concat(F.unhex(F.lit(f"00{schema_id:08x}")), value)


def strip_frame(value: Column) -> Column:
    """An Avro body without its registry frame."""
    return F.substring(value, REGISTRY_FRAME_BYTES + 1, F.length(value) - REGISTRY_FRAME_BYTES)


def frame_schema_id(value: Column) -> Column:
    """The schema id that a value's frame names; null where there is no frame."""
    framed = (F.length(value) >= REGISTRY_FRAME_BYTES) & (F.substring(value, 1, 1) == F.unhex(F.lit("00")))
    return F.when(framed, F.conv(F.hex(F.substring(value, 2, REGISTRY_FRAME_BYTES - 1)), 16, 10).cast("long"))


# A body, the schema it was written with and the one to read it as -> a struct (null fields where unreadable).
Decoder = Callable[[Column, str, str], Column]


def avro_body(body: Column, writer: str, reader: str) -> Column:
    """An Avro body resolved from its writer's schema to the reader's."""
    from pyspark.sql.avro.functions import from_avro  # needs the spark-avro package
    return from_avro(body, writer, {"avroSchema": reader, "mode": "PERMISSIVE"})


def _by_writer(raw: DataFrame, schema: T.StructType, writers: Mapping[int, str], decoder: Decoder) -> DataFrame:
    """value, source_partition, schema_id, r (the record), reason (why it is none, else null)."""
    body, reader = strip_frame(F.col("value")), avro_schema(schema)
    record = F.lit(None).cast(schema)
    for number, writer in writers.items():
        record = F.when(F.col("schema_id") == F.lit(number), decoder(body, writer, reader)).otherwise(record)
    missing = F.lit(False)
    for f in schema.fields:
        if not f.nullable:
            missing = missing | F.col("r")[f.name].isNull()
    reason = (F.when(F.col("schema_id").isNull(), "no frame")
               .when(~F.col("schema_id").isin(*writers), "unknown schema")
               .when(F.col("r").isNull() | missing, "unreadable"))
    return (raw.select("value", F.col("partition").alias("source_partition"), frame_schema_id(F.col("value")).alias("schema_id"))
               .withColumn("r", record).withColumn("reason", reason))


def decode_versions(raw: DataFrame, schema: T.StructType, writers: Mapping[int, str], decoder: Decoder = avro_body) -> DataFrame:
    """SRC-2 for producers of several versions: each value by the writer schema (``writers``: id ->
    Avro schema) that its frame names, as columns of ``schema``; the rest is in ``dead_letters``."""
    return _by_writer(raw, schema, writers, decoder).filter(F.col("reason").isNull()).select("r.*", "source_partition")


def dead_letters(raw: DataFrame, schema: T.StructType, writers: Mapping[int, str], decoder: Decoder = avro_body) -> DataFrame:
    """The values that ``decode_versions`` leaves out: no frame (null and short values too), an unknown
    schema id, or a required field missing; as they came, with the reason."""
    return (_by_writer(raw, schema, writers, decoder).filter(F.col("reason").isNotNull())
            .select("value", "source_partition", "schema_id", "reason"))


def start_dead_letters(raw: DataFrame, path: str, checkpoint: str, schema: T.StructType, writers: Mapping[int, str],
                       decoder: Decoder = avro_body, trigger: dict | None = None):
    """A query of its own over the raw topic that keeps its dead letters, exactly once, at ``path``."""
    return (dead_letters(raw, schema, writers, decoder).writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def decode_values(raw: DataFrame, schema: T.StructType, encoding: str = "json") -> DataFrame:
    """SRC-2: Kafka ``value`` bytes -> typed columns, with the Kafka partition kept."""
    if encoding == "avro":
        from pyspark.sql.avro.functions import from_avro  # needs the spark-avro package
        rec = from_avro(strip_frame(F.col("value")), avro_schema(schema))
    else:
        rec = F.from_json(F.col("value").cast("string"), schema)
    return raw.select(rec.alias("r"), F.col("partition").alias("source_partition")).select("r.*", "source_partition")


def kafka_values(spark: SparkSession, cfg: JobConfig, topic: str) -> DataFrame:
    """SRC-1: the topic's raw values from the earliest offset, a bounded number of records per micro-batch."""
    return (spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", cfg.kafka_bootstrap_servers)
            .option("maxOffsetsPerTrigger", cfg.max_offsets_per_trigger)
            .option("subscribe", topic).option("startingOffsets", "earliest").load())


def kafka_stream(spark: SparkSession, cfg: JobConfig, topic: str, schema: T.StructType,
                 encoding: str = "json", writers: Mapping[int, str] | None = None) -> DataFrame:
    """The topic's records; with ``writers``, framed Avro of several writer schemas."""
    raw = kafka_values(spark, cfg, topic)
    return decode_versions(raw, schema, writers) if writers else decode_values(raw, schema, encoding)


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json",
                max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def click_event_stream(spark: SparkSession, cfg: JobConfig, path: str | None = None, fmt: str = "json",
                       schema: T.StructType = CLICK_EVENT, max_files_per_trigger: int | None = None,
                       use_kafka: bool = False, encoding: str = "json",
                       writers: Mapping[int, str] | None = None) -> DataFrame:
    """Click events from Kafka (when asked for) or from files."""
    if use_kafka:
        return kafka_stream(spark, cfg, cfg.raw_clicks_topic, schema, encoding, writers)
    return file_stream(spark, path, schema, fmt, max_files_per_trigger)


def request_log_stream(spark: SparkSession, path: str, fmt: str = "json",
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """SRC-3: intake requests as a stream of files (the HTTP intake re-aimed)."""
    return file_stream(spark, path, CLICK_REQUEST, fmt, max_files_per_trigger)
