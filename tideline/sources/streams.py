"""The telemetry topic: reading records, building records, record headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.text import partition_key, rfc3339_nano
from tideline.schema import STREAM_RECORD, WIRE_FIELDS

# fixed values: record headers
SCHEMA_VERSION_HEADER = "schema-version"
CONTENT_TYPE_HEADER = "content-type"
KAFKA_DEFAULTS = {"startingOffsets": "earliest", "includeHeaders": "true", "failOnDataLoss": "true", "maxOffsetsPerTrigger": "20000000"}


def read_event_stream(spark: SparkSession, fmt: str = "kafka", path: str | None = None, **options: str) -> DataFrame:
    """Stream records from the topic, or from files that carry the same columns.

    Kafka starts at the earliest offset, keeps headers, and gives a trigger ``maxOffsetsPerTrigger`` records at most
    (pass another number to size a batch); the rest come in the triggers after it.
    Offsets advance through the query's checkpoint, after the sink has written the batch.
    """
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        return reader.options(**{**KAFKA_DEFAULTS, **options}).load().select(*STREAM_RECORD.fieldNames())
    return reader.schema(STREAM_RECORD).options(**options).load(path)


def header_value(headers: str | Column, key: str) -> Column:
    """The first header with this key as text, empty when there is none."""
    hits = F.filter(headers, lambda h: h["key"] == key)
    return F.coalesce(F.try_element_at(hits, F.lit(1))["value"].cast("string"), F.lit(""))


def wire_json(df: DataFrame) -> Column:
    """An event as its JSON wire text; empty attributes are left out."""
    attributes = F.when(F.coalesce(F.col("attributes"), F.lit("{}")) != "{}", F.try_parse_json(F.col("attributes")))
    members = [
        rfc3339_nano(F.col("event_timestamp")).alias("timestamp") if name == "timestamp"
        else attributes.alias("attributes") if name == "attributes"
        else F.col(name)
        for name in WIRE_FIELDS
    ]
    return F.to_json(F.struct(*members))


def to_stream_records(df: DataFrame, topic: str, version_header: str = SCHEMA_VERSION_HEADER) -> DataFrame:
    """Records for ``writeStream``/``write`` to Kafka: one tenant's service stays in order on one key."""
    header = "struct<key:string,value:binary>"
    headers = F.array(
        F.struct(F.lit(version_header), F.encode("schema_version", "UTF-8")).cast(header),
        F.struct(F.lit(CONTENT_TYPE_HEADER), F.encode(F.lit("application/json"), "UTF-8")).cast(header),
    )
    return df.select(
        F.encode(partition_key(F.col("tenant_id"), F.col("service_name")), "UTF-8").alias("key"),
        F.encode(wire_json(df), "UTF-8").alias("value"),
        F.lit(topic).alias("topic"),
        headers.alias("headers"),
    )
