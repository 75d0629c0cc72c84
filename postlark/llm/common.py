"""Helpers of the training-data operators: stored tables, word dictionaries, byte classes."""

import ctypes
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlark.streaming.files import Directory
from postlark.streaming.runs import new_run

# Fixed value: a word, as every operator here but decontamination understands it.
WORD = r"[^\x20\x09-\x0D]+"

# How much text a Python step works on at once.
SLICE_BYTES = 8 << 20

# Rows that Python steps get at once: texts of usual length then fill a slice, and neither
# the JVM nor the worker holds several slices.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


@contextmanager
def scratch(spark: SparkSession, name: str = "scratch") -> Iterator[str]:
    """A folder for all tables that operators store inside the block, removed at its end.

    Results read those tables, so write or collect them before the block ends.
    """
    folder = new_run(spark, name)
    token = _FOLDER.set(folder)
    try:
        yield folder
    finally:
        _FOLDER.reset(token)
        Directory(spark, folder).remove()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path nobody has used yet, inside the scratch folder if there is one."""
    folder = _FOLDER.get()
    return new_run(spark, name) if folder is None else f"{folder}/{name}-{uuid.uuid4().hex}"


_SMALL_LOCK = threading.Lock()
_SMALL: dict[int, tuple[int, dict]] = {}


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Set ``SMALL_BATCHES`` while any block of a session runs; blocks do not wait."""
    key = id(spark)
    with _SMALL_LOCK:
        running, before = _SMALL.get(key, (0, {}))
        if not running:
            before = {name: spark.conf.get(name, None) for name in SMALL_BATCHES}
            for name, value in SMALL_BATCHES.items():
                spark.conf.set(name, value)
        _SMALL[key] = running + 1, before
    try:
        yield
    finally:
        with _SMALL_LOCK:
            running, before = _SMALL.pop(key)
            if running > 1:
                _SMALL[key] = running - 1, before
            else:
                for name, value in before.items():
                    spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage, so that losing executors later costs no recomputation, and
    gives the planner the true size of the table.
    """
    spark = frame.sparkSession
    path = new_folder(spark, name)
    with _small_batches(spark):
        frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def unused(wanted: str, names: list[str]) -> str:
    """A column name like ``wanted`` that no column has, in any case."""
    taken = {name.lower() for name in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def word_count(text: Column) -> Column:
    """Number of words of a text as long; NULL counts 0.

    Runs of white space become one blank, so the words are the blanks plus one.
    """
    packed = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    blanks = F.length(packed) - F.length(F.replace(packed, F.lit(" "), F.lit("")))
    return F.when(F.length(packed) > 0, blanks + 1).otherwise(0).cast("long")


def byte_table(keep, lower: bool = True) -> bytes:
    """A translation of UTF-8 bytes: lower-case A-Z, and blank what ``keep`` refuses.

    Bytes of characters beyond ASCII are always kept.
    """
    out = bytearray(range(256))
    for byte in range(128):
        if lower and 65 <= byte <= 90:
            out[byte] = byte + 32
        if not keep(out[byte]):
            out[byte] = 32
    return bytes(out)


LOWER_WORDS = byte_table(lambda byte: not (byte == 0x20 or 0x09 <= byte <= 0x0D))


def release() -> None:
    """Give memory that is free inside this process back to the machine.

    Two workers and a JVM share an executor's memory, so what one worker's allocators
    keep for later is missing elsewhere.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch, column: str | int = "text", size: int = SLICE_BYTES):
    """Cut a batch into runs of rows holding about ``size`` bytes of text.

    A text longer than that is a run of its own; none is ever cut.
    """
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(
        zero_copy_only=False
    )
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
        yield batch.slice(start, stop - start)
        release()
        start = stop


@dataclass
class Words:
    """The words of some texts: ``codes`` point into ``dictionary``; text ``i`` has
    ``codes[offsets[i]:offsets[i + 1]]``."""

    codes: np.ndarray
    dictionary: pa.Array
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def dictionary_words(texts: pa.Array, translation: bytes | None = LOWER_WORDS) -> Words:
    """Split texts at ASCII white space and number the different words.

    ``translation`` is applied to the UTF-8 bytes first. NULL has no words.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    texts = pa.concat_arrays([texts])
    _, ends, data = texts.buffers()
    raw = data.to_pybytes() if data is not None else b""
    if translation is not None:
        raw = raw.translate(translation)
    texts = pa.LargeStringArray.from_buffers(
        len(texts), ends, pa.py_buffer(raw), offset=texts.offset
    )
    lists = pc.ascii_split_whitespace(texts)
    flat, bounds = lists.flatten(), lists.offsets.to_numpy()
    del texts, data, raw  # each as large as the texts
    coded, offsets = flat.dictionary_encode(), (bounds - bounds[0]).astype(np.int64)
    del flat
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32, copy=False)
    dictionary = coded.dictionary
    blank = pc.index(dictionary, "").as_py()
    if blank >= 0:  # what stands before a first and after a last blank
        full = codes != blank
        kept = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(full, out=kept[1:])
        offsets, codes = kept[offsets], codes[full]
        codes -= codes > blank
        dictionary = pa.concat_arrays([dictionary[:blank], dictionary[blank + 1 :]])
    return Words(codes, dictionary, offsets)


def concat_range(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``[s, s+1, ... s+n-1]`` for every start ``s`` and length ``n``, joined."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(
        int(lengths.sum())
    )


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (a bijection), so that every bit depends on all."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
