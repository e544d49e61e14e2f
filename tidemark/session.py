"""Session settings and the shared scratch folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_local = {}
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app="tidemark", master=None, **conf):
    """A session with adaptive execution on; ``master`` and ``conf`` are for tests and benches."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), str(v))
    return b.getOrCreate()


def is_local(spark):
    return spark.sparkContext.master.startswith("local")


def pin(df):
    """Compute a small frame once and keep it in the shared checkpoint folder.

    Plans that use it several times then read the stored rows, also after an
    executor is lost.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch(spark, "pinned"))
    return df.checkpoint()


def scratch(spark, name):
    """A fresh sub-folder name under the folder that all executors share.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
    local session, where driver and executors are one process, may fall back to
    a temporary folder.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not is_local(spark):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by the cluster")
        base = _local.get("folder") or tempfile.mkdtemp(prefix="tidemark-")
        _local["folder"] = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
