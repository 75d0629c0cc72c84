"""Where a run keeps its files, and the settings its queries start with."""

import tempfile
import threading
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Names of Spark settings. RocksDB keeps state off the heap and
# uploads the changes of a batch instead of the whole state. Not counting its rows
# saves a second lookup of every key that is written.
ROCKSDB_STATE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session may do without the setting; it gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="postlark-")
    raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")


def new_run(spark: SparkSession, name: str) -> str:
    """A path nobody has used yet, so that a run starts from zero."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


_SETTINGS = threading.RLock()


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Set session options for the block and put the old ones back.

    A streaming query copies the options when it starts, so starting it inside
    the block is enough. One block runs at a time, as the options are shared.
    """
    with _SETTINGS:
        before = {key: spark.conf.get(key, None) for key in values}
        for key, value in values.items():
            spark.conf.set(key, value)
        try:
            yield
        finally:
            for key, value in before.items():
                if value is None:
                    spark.conf.unset(key)
                else:
                    spark.conf.set(key, value)
