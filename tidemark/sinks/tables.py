"""Result tables."""

from pyspark.sql import functions as F


def stream_to_table(df, path, checkpoint, name=None, partition_by=(), trigger=None, fmt="parquet"):
    """Named append-mode sink of a stream; the file log makes it exactly-once."""
    writer = (
        df.writeStream.outputMode("append").format(fmt)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    )
    if name:
        writer = writer.queryName(name)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.start(path)


def write_table(df, path, partition_by=(), mode="overwrite", fmt="parquet", files_per_partition=None):
    """Partitioned table.

    Rows are first spread over the table's partitions so that each writes few
    files; ``files_per_partition`` splits large partitions by a hash of the row.
    """
    out = df
    if partition_by:
        extra = []
        if files_per_partition:
            extra = [F.pmod(F.xxhash64(*df.columns), F.lit(files_per_partition))]
        out = df.repartition(*partition_by, *extra) if files_per_partition else df.hint(
            "rebalance", *partition_by
        )
    writer = out.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
