"""Fan-out to several sinks, and callbacks."""

from contextlib import contextmanager

from pyspark import StorageLevel


@contextmanager
def kept(batch):
    """Hold a micro-batch while several steps read it."""
    batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield batch
    finally:
        batch.unpersist()


def table_target(path, fmt="parquet", transform=None):
    """A fan-out target that writes each micro-batch to its own sub-folder.

    A repeated batch overwrites its folder, so restarts leave no duplicates.
    """
    def write(batch, batch_id):
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").format(fmt).save(f"{path}/batch_id={batch_id}")
    return write


def fan_out(df, targets, checkpoint, mode="append", trigger=None, name=None):
    """Feed several targets from one stream; each micro-batch is computed once."""
    def each(batch, batch_id):
        with kept(batch):
            for target in targets:
                target(batch, batch_id)
    return for_each_batch(df, each, checkpoint, mode, trigger, name)


def for_each_batch(df, fn, checkpoint, mode="append", trigger=None, name=None):
    """Call ``fn(batch DataFrame, batch id)`` per micro-batch on the driver; rows stay distributed."""
    writer = (
        df.writeStream.outputMode(mode).foreachBatch(fn)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    )
    return (writer.queryName(name) if name else writer).start()


class Stopped(Exception):
    """A row callback asked to stop."""


class _RowCallback:
    def __init__(self, fn):
        self.fn = fn

    def open(self, partition_id, epoch_id):
        return True

    def process(self, row):
        if self.fn(row) is False:
            raise Stopped("the row callback returned False")

    def close(self, error):
        pass


def for_each_row(df, fn, checkpoint, mode="append", trigger=None):
    """Call ``fn(row)`` per result row on the executors.

    Returning False stops the query before its micro-batch is committed, so no row
    is lost: a query that is started again on the checkpoint gets the whole
    micro-batch once more. ``stopped`` tells such an end from a failure.
    """
    return (
        df.writeStream.outputMode(mode).foreach(_RowCallback(fn))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stopped(query):
    """Whether a row callback has stopped the query."""
    error = query.exception()
    return error is not None and Stopped.__name__ in str(error)
