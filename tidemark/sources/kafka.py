"""Message-bus source: connector options and a pure decode step.

The connector jar is supplied at submit time; decoding works on any frame with
``key`` and ``value`` columns.
"""

from ..functions import json_codec
from ..schemas import TRADES
from .files import source


def source_options(brokers, topic, group_id=None, offset_reset="earliest", max_per_trigger=None):
    """Reader options of the Kafka connector."""
    opts = {
        "kafka.bootstrap.servers": brokers,
        "subscribe": topic,
        "startingOffsets": offset_reset,
    }
    if group_id:
        opts["kafka.group.id"] = group_id
    if max_per_trigger:
        opts["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return opts


def read_stream(spark, brokers, topic, schema=TRADES, **options):
    """Stream of decoded rows from a JSON topic."""
    raw = spark.readStream.format("kafka").options(**source_options(brokers, topic, **options)).load()
    return decode_json(raw, schema)


def read_batch(spark, brokers, topic, schema=TRADES, **options):
    """Batch twin of ``read_stream``: everything currently in the topic."""
    opts = source_options(brokers, topic, **options)
    opts.pop("maxOffsetsPerTrigger", None)
    return decode_json(spark.read.format("kafka").options(**opts).load(), schema)


def decode_json(records, schema=TRADES):
    """Checked source rows from raw records."""
    return source(json_codec.decode(records, schema), schema)
