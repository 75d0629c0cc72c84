"""Result tables that a stream writes batch by batch.

A table may be used by several runs one after the other; ``commits`` says how a run is
begun and what makes a batch of it count. Every checkpoint has a run folder of its own, so
a run continues its own batches and neither sees nor removes those of another. Readers
follow the newest run, also one that begins after they were opened.

A replayed batch overwrites its own output and starts from what was before it, so
replaying changes nothing.
"""

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postlark.streaming.commits import CommitLog


class SnapshotTable:
    """Numbered full copies of a result.

    A copy is removed when ``keep`` newer ones exist and it is ``keep_seconds`` older than
    the newest, so a reader has at least that long, however fast batches follow. Ages are
    those of the markers. ``files`` limits the files of a copy; without it there is one
    per partition of the result.
    """

    format = "parquet"
    _write_options: dict = {}
    _read_options: dict = {}

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: StructType,
        keep: int = 20,
        keep_seconds: float = 600,
        files: int | None = None,
        rows_per_file: int = 1_000_000,
    ):
        if keep < 2:
            raise ValueError("keep at least two snapshots: a replay reads the one before it")
        self.spark = spark
        self.path = path
        self.schema = schema
        self.keep = keep
        self.keep_seconds = keep_seconds
        self.files = files
        self.rows_per_file = rows_per_file
        self._log = CommitLog(spark, path)
        self._run: str | None = None

    # --- runs ---

    def bind(self, checkpoint: str) -> None:
        """Write to the run of a checkpoint; the first time, begin a new run."""
        self._run = self._log.run_of(checkpoint)

    @property
    def run(self) -> str | None:
        """The run that this object writes, or else the newest, if there is one."""
        return self._run or self._log.newest()

    def _own_run(self) -> str:
        """The run to write; without a checkpoint, one of this object's own."""
        if self._run is None:
            self._run = self._log.claim(uuid.uuid4().hex)
        return self._run

    def remove(self) -> None:
        """Delete the table with all its runs. No query may still be writing."""
        self._log.remove_all()
        self._run = None

    # --- batches ---

    def _marked(self, kind: str = "batch_id", run: str | None = None) -> dict[int, float]:
        """The complete batches of the run, oldest first, and when they were committed."""
        run = run or self.run
        times = self._log.times(run) if run else {}
        found = {int(name.removeprefix(f"{kind}=")): t for name, t in times.items() if name.startswith(f"{kind}=")}
        return dict(sorted(found.items()))

    def committed(self, kind: str = "batch_id") -> list[int]:
        """The complete batches of the run, oldest first."""
        return list(self._marked(kind))

    def _reader(self, spark: SparkSession | None):
        return (spark or self.spark).read.schema(self.schema).format(self.format).options(**self._read_options)

    def _load(self, run: str, names: list[str], spark: SparkSession | None) -> DataFrame:
        return self._reader(spark).load([f"{self.path}/{run}/{name}" for name in names])

    def latest(
        self, before: int | None = None, spark: SparkSession | None = None
    ) -> DataFrame | None:
        """The newest snapshot, or the newest one older than batch ``before``."""
        run = self.run
        for batch in reversed(self._marked(run=run)):
            if before is None or batch < before:
                return self._load(run, [f"batch_id={batch}"], spark)
        return None

    def read(self) -> DataFrame:
        """The newest snapshot; no rows before there is one."""
        newest = self.latest()
        return self.spark.createDataFrame([], self.schema) if newest is None else newest

    def _store(self, result: DataFrame, name: str, files: int | None) -> None:
        run = self._own_run()
        result = result.select([column.name for column in self.schema])
        if files is not None:
            result = result.coalesce(files)
        (
            result.write.mode("overwrite")
            .format(self.format)
            .options(**self._write_options)
            .option("maxRecordsPerFile", self.rows_per_file)
            .save(f"{self.path}/{run}/{name}")
        )
        self._log.mark(run, name)

    def _save(self, result: DataFrame, batch_id: int, kind: str = "batch_id") -> None:
        self._store(result, f"{kind}={batch_id}", self.files)

    def write(self, result: DataFrame, batch_id: int) -> None:
        """Store a result as the snapshot of a batch."""
        self._save(result, batch_id)
        marked = self._marked()
        self._expire(list(marked)[: -self.keep], marked, marked[batch_id])

    def _expire(self, old: list[int], marked: dict[int, float], now: float, kind: str = "batch_id") -> None:
        """Remove those of some batches that are old enough."""
        for batch in old:
            if now - marked[batch] >= self.keep_seconds:
                self._log.remove(self._own_run(), f"{kind}={batch}")


class ChangeTable(SnapshotTable):
    """Totals that only grow, kept as the rows each batch changed.

    What a batch writes follows the batch, not the table. Every ``compact_every`` batches
    the changes so far are merged to one copy, ``whole_id=<n>``, and older changes may
    expire. A reader merges the newest copy and the changes after it: totals never fall,
    so the largest one of a key is its newest.
    """

    merge = staticmethod(F.max)

    def __init__(self, *args, key: str, total: str, compact_every: int = 50, **options):
        super().__init__(*args, **options)
        self.key, self.total, self.compact_every = key, total, compact_every

    def latest(
        self, before: int | None = None, spark: SparkSession | None = None
    ) -> DataFrame | None:
        return self._merged(before, before, spark)

    def _merged(self, before: int | None, copies_before: int | None, spark: SparkSession | None) -> DataFrame | None:
        """Copies and changes up to a batch, merged; ``None`` stands for no limit."""
        run = self.run
        names = self._log.times(run) if run else {}

        def numbers(kind: str, limit: int | None) -> list[int]:
            found = sorted(int(n.removeprefix(f"{kind}=")) for n in names if n.startswith(f"{kind}="))
            return [n for n in found if limit is None or n < limit]

        whole = numbers("whole_id", copies_before)[-1:]
        after = whole[0] if whole else -1
        parts = [f"whole_id={batch}" for batch in whole]
        parts += [f"batch_id={batch}" for batch in numbers("batch_id", before) if batch > after]
        if not parts:
            return None
        rows = self._load(run, parts, spark)
        return rows.groupBy(self.key).agg(self.merge(self.total).alias(self.total))

    def write(self, result: DataFrame, batch_id: int) -> None:
        """Store the changed rows of a batch."""
        self._save(result, batch_id)
        if (batch_id + 1) % self.compact_every == 0:
            self._save(self._merged(batch_id + 1, batch_id, result.sparkSession), batch_id, "whole_id")
        # What the copy before the newest holds has been readable from it for long.
        wholes = self._marked("whole_id")
        for whole in list(wholes)[:-1][-1:]:
            marked = self._marked()
            now = marked[batch_id]
            self._expire([b for b in marked if b <= whole], marked, now)
            self._expire([b for b in wholes if b < whole], wholes, now, "whole_id")


class SumTable(ChangeTable):
    """Totals as the sums of what each batch adds.

    Batches need no state: each stores its own counts, once per batch id, so a replay
    replaces what it counted before. Compaction and readers add them up.
    """

    merge = staticmethod(F.sum)


class AppendTable(SnapshotTable):
    """Rows that only ever come in, in a number of files and markers that stays bounded.

    Batch ``n`` is a segment of its own. Whenever ``fan`` segments of a size are there, at
    fixed batch numbers, they are merged into one of the next size, so a row is copied once
    per size and ``B`` batches leave at most ``fan - 1`` segments of each of ``log(B) /
    log(fan)`` sizes, besides those merged within the last ``keep_seconds``, which readers
    may still use. Segments beyond ``segment_bytes`` are not copied any more; from there
    on the number follows the volume. The merged markers are the whole manifest.
    """

    def __init__(
        self,
        *args,
        fan: int = 16,
        segment_bytes: int = 1 << 30,
        file_bytes: int = 128 << 20,
        format: str = "parquet",
        write_options: dict | None = None,
        read_options: dict | None = None,
        **options,
    ):
        super().__init__(*args, **options)
        if fan < 2:
            raise ValueError("merge at least two segments at a time")
        self.fan, self.segment_bytes, self.file_bytes = fan, segment_bytes, file_bytes
        self.format = format
        self._write_options, self._read_options = write_options or {}, read_options or {}

    _SEGMENT = re.compile(r"segment=(\d+)-(\d+)-(\d+)")

    @staticmethod
    def _name(level: int, first: int, last: int) -> str:
        return f"segment={level}-{first}-{last}"

    def _segments(self, run: str | None = None) -> dict[tuple[int, int, int], float]:
        """``level, first, last`` batch of each committed segment, and since when."""
        run = run or self.run
        times = self._log.times(run) if run else {}
        found = ((self._SEGMENT.fullmatch(name), t) for name, t in times.items())
        return {tuple(map(int, match.groups())): t for match, t in found if match}

    @staticmethod
    def _cover(segments) -> list[tuple[int, int, int]]:
        """Segments that hold every batch once: the largest, and what none of them holds."""
        chosen, covered = [], -1
        for segment in sorted(segments, key=lambda s: (s[1], -s[2])):
            if segment[1] > covered:
                chosen.append(segment)
                covered = segment[2]
        return chosen

    def committed(self, kind: str = "batch_id") -> list[int]:
        """The batches whose rows are in the table, oldest first."""
        return [batch for _, first, last in self._cover(self._segments()) for batch in range(first, last + 1)]

    def latest(self, before: int | None = None, spark: SparkSession | None = None) -> DataFrame | None:
        """All rows, or those of the batches before ``before``, which must begin a segment."""
        run = self.run
        cover = self._cover(s for s in self._segments(run) if before is None or s[2] < before)
        return self._load(run, [self._name(*segment) for segment in cover], spark) if cover else None

    def write(self, result: DataFrame, batch_id: int) -> None:
        """Add the rows of a batch; a batch that is there already is replaced or left."""
        segments = self._segments()
        if any(level and first <= batch_id <= last for level, first, last in segments):
            return  # a replay of a batch that has been merged
        self._store(result, self._name(0, batch_id, batch_id), self.files)
        level, width = 0, 1
        while (batch_id + 1) % (width * self.fan) == 0:
            width *= self.fan
            first = batch_id + 1 - width
            if not self._merge(level + 1, first, batch_id, result.sparkSession):
                break
            level += 1
        self._clean()

    def _merge(self, level: int, first: int, last: int, spark: SparkSession) -> bool:
        """Copy the segments between two batches into one, unless they are large already."""
        parts = [s for s in self._cover(self._segments()) if first <= s[1] and s[2] <= last]
        if [s for s in parts if s[0] != level - 1] or not parts:
            return False
        size = sum(self._log.size(self._own_run(), self._name(*part)) for part in parts)
        if size > self.segment_bytes:
            return False
        rows = self._load(self._own_run(), [self._name(*part) for part in parts], spark)
        self._store(rows, self._name(level, first, last), 1 + size // self.file_bytes)
        return True

    def _clean(self) -> None:
        """Remove segments that have been part of a larger one for long enough."""
        segments = self._segments()
        now, top = max(segments.values()), max(level for level, _, _ in segments)
        for level, first, last in segments:
            for above in range(level + 1, top + 1):
                width = self.fan**above
                start = first // width * width
                merged = segments.get((above, start, start + width - 1))
                if merged is not None:
                    if now - merged >= self.keep_seconds:
                        self._log.remove(self._own_run(), self._name(level, first, last))
                    break
