"""Token ids in files of independently coded blocks.

A file is a run of groups. A group holds whole documents in ascending order: a header
(checksummed; document ids, numbers of ids, the order-0 distribution that every block
starts from, and length and checksum of each block), then the blocks. Any block can be
read without the others. Ids are coded by ``coder``, nothing is lost.

Documents are dealt out by ranges of ``doc_id``, so file ``n`` holds smaller ids than
file ``n + 1``, and a document's place in the whole stream is its place in its file plus
the sizes of the files before, which a manifest of one row per file tells. A group's size
bounds the memory of reader and writer; only a document larger than that makes a larger
group.

Defined cases: a NULL or empty text is the end id alone. Rows with a NULL ``doc_id`` come
first. Repeated ids are kept, in the order of a hash of their texts. Ranges are cut by
id and that hash, so many rows with one id are still spread. An empty table makes no
file and no rows. Extra columns are not read. A damaged file raises ``ValueError``.
"""

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlark.llm.coder import Prior, block_lengths, decode_blocks, encode_blocks
from postlark.llm.common import release, slices, stored
from postlark.llm.files import create, each_row, open_stream, unique_name
from postlark.llm.tokens import WordEncoder, forget

# Fixed values of the format.
MAGIC = b"PLTOKEN2"
BLOCK_IDS = 1024
# Some 4,000 blocks are coded side by side, which keeps the time of a numpy call small per id.
GROUP_IDS = 1 << 22
END_ID = 2
# Text that is encoded at once: splitting it takes some twelve times its size.
TEXT_BYTES = 2 << 20

_HEAD = struct.Struct("<8sIIqqq")

_MANIFEST = "file long, path string, docs long, ids long"
_MANIFEST_ARROW = pa.schema(
    [("file", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]
)
_DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"
_DOCS_ARROW = pa.schema(
    [(name, pa.int64()) for name in ("doc_id", "start", "n_tokens", "ids_crc32")]
)


def pack_group(doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A group of documents as bytes."""
    prior = Prior.of(ids)
    lengths = block_lengths(len(ids), BLOCK_IDS)
    blocks = encode_blocks(ids, prior, lengths)
    known = np.array([doc_id is not None for doc_id in doc_ids])
    numbers = np.array([doc_id or 0 for doc_id in doc_ids], "<i8")
    parts = [
        known.astype("u1").tobytes(),
        numbers.tobytes(),
        sizes.astype("<i8").tobytes(),
        struct.pack("<iq", prior.bits, len(prior.symbols)),
        np.diff(prior.symbols, prepend=0).astype("<u4").tobytes(),
        prior.freqs.astype("<u4").tobytes(),
        np.array([len(block) for block in blocks], "<i8").tobytes(),
        np.array([zlib.crc32(block) for block in blocks], "<u4").tobytes(),
    ]
    info = zlib.compress(b"".join(parts), 6)
    body = b"".join(blocks)
    head = _HEAD.pack(MAGIC, zlib.crc32(info), len(info), len(doc_ids), len(ids), len(body))
    return head + info + body


def read_groups(stream) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Document ids, numbers of ids, and all ids of each group of a file."""
    while head := stream.read(_HEAD.size):
        if len(head) < _HEAD.size:
            raise ValueError("a token file ends inside a header")
        magic, crc, size, docs, count, body_size = _HEAD.unpack(head)
        info, body = stream.read(size), stream.read(body_size)
        if magic != MAGIC or zlib.crc32(info) != crc or len(body) != body_size:
            raise ValueError("a token file's header is damaged")
        info, at = zlib.decompress(info), 0

        def take(kind, n):
            nonlocal at
            values = np.frombuffer(info, kind, n, at)
            at += values.nbytes
            return values

        known, numbers, sizes = take("u1", docs), take("<i8", docs), take("<i8", docs)
        bits, symbols = struct.unpack_from("<iq", info, at)
        at += 12
        prior = Prior(
            np.cumsum(take("<u4", symbols), dtype=np.int64), take("<u4", symbols).astype(np.int64), bits
        )
        lengths = block_lengths(count, BLOCK_IDS)
        stops = np.cumsum(take("<i8", len(lengths)))
        starts = np.concatenate([[0], stops[:-1]])
        blocks = [body[a:b] for a, b in zip(starts, stops)]
        if any(zlib.crc32(block) != told for block, told in zip(blocks, take("<u4", len(lengths)))):
            raise ValueError("a block of a token file is damaged")
        doc_ids = [int(n) if k else None for n, k in zip(numbers, known)]
        yield doc_ids, sizes, decode_blocks(blocks, prior, lengths)


def _groups(batches: Iterator[pa.RecordBatch], encoder: WordEncoder, end_id: int):
    """Encoded documents, gathered to groups of about ``GROUP_IDS`` ids.

    The ids of a group are valid until the next one is asked for: all share one array.
    """
    doc_ids, sizes, held = [], [], 0
    group = np.empty(GROUP_IDS, np.uint32)
    for batch in batches:
        for piece in slices(batch, size=TEXT_BYTES):
            ids, counts = encoder.encode(piece.column("text"))
            whole = np.full(len(ids) + len(counts), end_id, np.uint32)
            ends = np.cumsum(counts + 1)
            keep = np.ones(len(whole), bool)
            keep[ends - 1] = False
            whole[keep] = ids
            del ids, keep
            names = piece.column("doc_id").to_pylist()
            start = 0
            while start < len(names):
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + GROUP_IDS - held, "right")))
                doc_ids += names[start:stop]
                sizes.append(counts[start:stop] + 1)
                more = whole[base : ends[stop - 1]]
                if held + len(more) > len(group):  # a document larger than a group
                    group = np.concatenate([group[:held], more])
                else:
                    group[held : held + len(more)] = more
                held += len(more)
                start = stop
                if held >= GROUP_IDS or start < len(names):
                    yield doc_ids, np.concatenate(sizes), group[:held]
                    doc_ids, sizes, held = [], [], 0
                    if len(group) > GROUP_IDS:
                        group = np.empty(GROUP_IDS, np.uint32)
    if doc_ids:
        yield doc_ids, np.concatenate(sizes), group[:held]


def write_tokens(documents: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encode ``doc_id, text`` to files; returns the manifest ``file, path, docs, ids``.

    ``tokenizer`` is the path of its file, the same on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        file, docs, count = None, 0, 0
        for doc_ids, sizes, ids in _groups(batches, WordEncoder(tokenizer), end_id):
            if file is None:
                name = unique_name(f"tokens-{part:06d}", ".bin")
                file = create(folder, name)
            file.write(pack_group(doc_ids, sizes, ids))
            docs, count = docs + len(doc_ids), count + len(ids)
            del ids
            release()
        if file is not None:
            file.close()
            row = [[part], [f"{folder}/{name}"], [docs], [count]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip(row, _MANIFEST_ARROW)], schema=_MANIFEST_ARROW
            )

    order = [F.asc_nulls_first("doc_id"), F.col("text_hash").asc()]
    dealt = (
        documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    return stored(dealt.mapInArrow(run, _MANIFEST), "token-manifest")


def _documents(rows):
    """What files hold per document; ``rows`` have a path and the number of ids before it."""
    forget()  # workers are used again, and neither this nor what follows needs the words
    release()
    for path, base in rows:
        with open_stream(path) as file:
            for doc_ids, sizes, ids in read_groups(file):
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                start = 0
                for doc_id, size in zip(doc_ids, sizes.tolist()):
                    crc = zlib.crc32(data[4 * start : 4 * (start + size)])
                    yield doc_id, base + start, size, crc
                    start += size
                base += start
                del ids, data
                release()


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it. One window runs over the
    manifest, which has a row per file.
    """

    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = (
        manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long")))
        .select("path", "base")
        .repartition(tasks, F.xxhash64("path"))
    )
    return work.mapInArrow(each_row(_documents, _DOCS_ARROW), _DOCS)
