"""Files that tasks write and read themselves, on any file system pyarrow.fs can reach.

A task writes under a name nobody else uses and then yields a row that names the file.
Those rows become a manifest, a table that Spark commits: files of failed or repeated
attempts are not in it, so a lost executor leaves no half or double result.
"""

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs


def _located(path: str):
    path = re.sub(r"^file:/(?!/)", "file:///", path)
    return pafs.FileSystem.from_uri(path)


def unique_name(prefix: str, suffix: str) -> str:
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"


def create(folder: str, name: str):
    """An output stream for a new file; use as a context manager."""
    system, base = _located(folder)
    system.create_dir(base, recursive=True)
    return system.open_output_stream(f"{base}/{name}", compression=None)


def open_stream(path: str):
    system, base = _located(path)
    return system.open_input_stream(base, compression=None, buffer_size=1 << 20)


def each_row(run: Callable, schema: pa.Schema, rows: int = 10_000):
    """A function for ``mapInArrow``: ``run(rows)`` takes and yields plain tuples."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def taken():
            for batch in batches:
                columns = [column.to_pylist() for column in batch.columns]
                yield from zip(*columns)

        held: list[tuple] = []
        for row in run(taken()):
            held.append(row)
            if len(held) >= rows:
                yield _batch(held, schema)
                held = []
        if held:
            yield _batch(held, schema)

    return apply


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(column, field.type) for column, field in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)
