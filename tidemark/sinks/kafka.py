"""Message-bus sink: a pure encode step and connector options."""

from ..functions import json_codec


def encode_json(df, key=None, columns=None):
    """Records with a JSON value and, if named, the key column as text."""
    return json_codec.encode(df, key, columns)


def sink_options(brokers, topic):
    return {"kafka.bootstrap.servers": brokers, "topic": topic}


def write_stream(df, brokers, topic, checkpoint, key=None, mode="append", trigger=None):
    """Stream rows to a JSON topic."""
    return (
        encode_json(df, key).writeStream.format("kafka").outputMode(mode)
        .options(**sink_options(brokers, topic)).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def write_batch(df, brokers, topic, key=None):
    encode_json(df, key).write.format("kafka").options(**sink_options(brokers, topic)).save()
