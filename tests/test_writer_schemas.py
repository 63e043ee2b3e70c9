"""Values of several writer schemas, told apart by their frames; dead letters.

The Avro package is not on the class path here, so bodies are written as the fields in
their writer's order, joined by ``|``: like Avro, they cannot be read by another schema."""

import json
import os

from pyspark.sql import functions as F, types as T

from clickwise.sources.streams import add_frame, avro_schema, dead_letters, decode_versions, frame_schema_id, start_dead_letters

READER = T.StructType([T.StructField("click_id", T.StringType(), False), T.StructField("ad_id", T.StringType()),
                       T.StructField("timestamp_ms", T.LongType(), False)])


def writer(*names):
    return json.dumps({"type": "record", "name": "C", "fields": [{"name": n, "type": "string"} for n in names]})


WRITERS = {1: writer("click_id", "ad_id", "timestamp_ms"), 70000: writer("timestamp_ms", "extra", "click_id")}


def positional(body, written, reader):
    names = [f["name"] for f in json.loads(written)["fields"]]
    parts = F.split(body.cast("string"), r"\|")
    kinds = {"string": "string", "long": "long"}
    fields = []
    for f in json.loads(reader)["fields"]:
        kind = kinds[f["type"][1] if isinstance(f["type"], list) else f["type"]]
        value = F.get(parts, names.index(f["name"])).try_cast(kind) if f["name"] in names else F.lit(None).cast(kind)
        fields.append(value.alias(f["name"]))
    return F.struct(*fields)


def values(spark):
    rows = [(1, "a|x|5"), (70000, "6|no|b"), (2, "a|x|7"), (1, "c|x|late"), (None, "plain"), (1, "")]
    raw = spark.createDataFrame([(n, body.encode(), i) for i, (n, body) in enumerate(rows)], "n long, body binary, partition int")
    framed = F.col("body")
    for n in (1, 2, 70000):
        framed = F.when(F.col("n") == n, add_frame(F.col("body"), n)).otherwise(framed)
    return raw.select(framed.alias("value"), "partition").unionByName(
        spark.createDataFrame([(None, 6), (b"", 7), (b"\x00\x00", 8)], "value binary, partition int"))


def test_each_value_by_its_own_schema(spark):
    got = decode_versions(values(spark), READER, WRITERS, positional)
    assert got.columns == ["click_id", "ad_id", "timestamp_ms", "source_partition"]
    assert sorted(map(tuple, got.collect())) == [("a", "x", 5, 0), ("b", None, 6, 1)]


def test_all_others_are_dead_letters(spark):
    raw = values(spark)
    got = {r.source_partition: (r.schema_id, r.reason) for r in dead_letters(raw, READER, WRITERS, positional).collect()}
    assert got == {2: (2, "unknown schema"), 3: (1, "unreadable"), 4: (None, "no frame"), 5: (1, "unreadable"),
                   6: (None, "no frame"), 7: (None, "no frame"), 8: (None, "no frame")}
    assert dead_letters(raw.limit(0), READER, WRITERS, positional).count() == 0


def test_ids_over_the_whole_range(spark):
    raw = spark.createDataFrame([(b"\x00\xff\xff\xff\xff",), (b"\x00\x00\x00\x01\x02x",), (b"\x01\x00\x00\x00\x01",)], "value binary")
    assert [r[0] for r in raw.select(frame_schema_id(F.col("value"))).collect()] == [2**32 - 1, 258, None]
    assert json.loads(avro_schema(READER))["fields"][1]["type"] == ["null", "string"]


def test_dead_letters_of_a_stream_are_kept_once(spark, tmp):
    topic, out, ckpt = (os.path.join(tmp, n) for n in ("topic", "dead", "ckpt"))
    for n in (1, 2):
        values(spark).write.mode("append").parquet(topic)
        raw = spark.readStream.schema("value binary, partition int").parquet(topic)
        start_dead_letters(raw, out, ckpt, READER, WRITERS, positional).awaitTermination()
        assert spark.read.parquet(out).count() == 7 * n


def test_schemas_from_the_command_line(tmp):
    from clickwise.__main__ import _writers
    path = os.path.join(tmp, "a=b.avsc")
    with open(path, "w", encoding="utf-8") as f:
        f.write(WRITERS[1])
    assert _writers([f"7={path}"]) == {7: WRITERS[1]} and _writers([]) == {}
