"""The language lookup: a CSV with a header and the columns code and name."""

import threading

from pyspark.sql import DataFrame, SparkSession

from postlark.operators.languages import single_names
from postlark.schemas import LANGUAGE_NAMES
from postlark.streaming.files import Directory


def read_language_names(spark: SparkSession, path: str) -> DataFrame:
    """Read code -> name rows. Columns bind by position, whatever the header says."""
    return (
        spark.read.schema(LANGUAGE_NAMES)
        .options(header=True, escape='"', enforceSchema=True)
        .csv(path)
    )


class Lookup:
    """A lookup file that is prepared once per version and read anew when it changes.

    A version is what a listing tells of the files: their names, sizes and times. As long as
    it stays, ``current`` gives the same prepared table, one row per code, written below
    ``prepared``; a stream that asks in every batch neither parses nor deduplicates it
    again. Older versions stay readable for batches that began with them until ``keep``
    newer ones exist.
    """

    def __init__(self, spark: SparkSession, path: str, prepared: str, keep: int = 2):
        self.spark = spark
        self.path = path
        self.prepared = prepared
        self.keep = max(keep, 1)
        self._files = Directory(spark, path)
        self._copies = Directory(spark, prepared)
        self._lock = threading.Lock()
        self._version: str | None = None

    def version(self) -> str:
        """What the files are now, as a name."""
        return self._files.fingerprint()

    def current(self, spark: SparkSession | None = None) -> DataFrame:
        """``code, name`` with one row per code, as the files are now."""
        version = self.version()
        copy = f"version={version}"
        with self._lock:
            if version != self._version:
                if not self._copies.exists(f"{copy}/_SUCCESS"):
                    rows = single_names(read_language_names(spark or self.spark, self.path))
                    rows.write.mode("overwrite").parquet(f"{self.prepared}/{copy}")
                    self._copies.put(f"{copy}/_SUCCESS")
                self._version = version
                self._drop_old(copy)
        return (spark or self.spark).read.schema(LANGUAGE_NAMES).parquet(f"{self.prepared}/{copy}")

    def _drop_old(self, newest: str) -> None:
        times = {name: self._copies.times(name).get("_SUCCESS") for name in self._copies.names()}
        old = sorted((t, name) for name, t in times.items() if t is not None and name != newest)
        for _, name in old[: len(old) - self.keep] if len(old) > self.keep else []:
            self._copies.remove(name)
