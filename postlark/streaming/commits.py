"""The commit log of a result table: which runs it has had, and what each has finished.

Runs are entries ``_runs/<number>``, put there only if absent and never changed, so two
writers cannot both be run 0; the highest number is the current run. A checkpoint holds
the id of its writer, which its run's entry repeats: starting a checkpoint again, also
after a crash between the two, finds the same run.

Inside a run a piece of data counts once a marker of that name is in ``_commits``, put
there after the data. One listing of the markers tells what is there and since when.
"""

import re
import uuid

from pyspark.sql import SparkSession

from postlark.streaming.files import Directory

_NUMBER = re.compile(r"\d{6,}")
_WRITER = "writer"


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self._files = Directory(spark, path)

    def runs(self) -> list[str]:
        """Names of all runs, oldest first."""
        numbers = sorted(name for name in self._files.names("_runs") if _NUMBER.fullmatch(name))
        return [self._files.text(f"_runs/{number}") for number in numbers]

    def newest(self) -> str | None:
        numbers = [name for name in self._files.names("_runs") if _NUMBER.fullmatch(name)]
        return self._files.text(f"_runs/{max(numbers, key=int)}") if numbers else None

    def run_of(self, checkpoint: str) -> str:
        """The run of a checkpoint; the first time, a new one."""
        notes = Directory(self.spark, f"{checkpoint}/snapshots")
        notes.put_if_absent(_WRITER, uuid.uuid4().hex)
        return self.claim(notes.text(_WRITER))

    def claim(self, writer: str) -> str:
        """The run of a writer; the first time, a new one after all others."""
        while True:
            runs = self.runs()
            for run in runs:
                if run.endswith(f"-{writer}"):
                    return run
            number = f"{len(runs):06d}"
            run = f"run={number}-{writer}"
            if self._files.put_if_absent(f"_runs/{number}", run):
                return run

    def times(self, run: str) -> dict[str, float]:
        """The markers of a run and when each was put there."""
        return self._files.times(f"{run}/_commits")

    def mark(self, run: str, name: str) -> None:
        self._files.put(f"{run}/_commits/{name}", name)

    def remove(self, run: str, name: str) -> None:
        """Remove data; first the marker, so that nobody begins to read what goes."""
        self._files.remove(f"{run}/_commits/{name}")
        self._files.remove(f"{run}/{name}")

    def size(self, run: str, name: str) -> int:
        return self._files.size(f"{run}/{name}")

    def remove_all(self) -> None:
        self._files.remove()
