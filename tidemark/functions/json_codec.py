"""JSON payloads of message-bus records."""

from pyspark.sql import functions as F, types as T


def decode(df, schema, value="value", keep=()):
    """Payload rows of ``df``; a record that does not parse gives nulls, for the source check to reject."""
    # A declared-not-null field may still be absent from a payload.
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    return parsed_once(df, F.from_json(F.col(value).cast("string"), loose), "_body", keep).select(*keep, "_body.*")


def parsed_once(df, body, name, keep=()):
    """``df`` with the struct column ``body``; its text is parsed once a row, not once for every field and filter."""
    # A generator: Spark neither copies what it makes into later steps nor moves filters before it.
    line = F.explode(F.array(F.struct(body.alias("body")))).alias("_line")
    return df.select(*keep, line).select(*keep, F.col("_line.body").alias(name))


def encode(df, key=None, columns=None):
    """``key`` and JSON ``value`` columns, as a message-bus writer expects them."""
    cols = columns or df.columns
    out = [F.to_json(F.struct(*cols)).alias("value")]
    if key:
        out.insert(0, F.col(key).cast("string").alias("key"))
    return df.select(*out)


def field(json_col, path, dtype):
    """One typed field out of a JSON text column."""
    return F.get_json_object(json_col, path).cast(dtype)
