"""Token ids as Arrow files of fixed-size-list batches, and reading them back.

A data set is a folder of file pairs. ``N.ids.arrow`` is an Arrow IPC stream with a footer whose batches hold
``ids``, a fixed-size list of ``length`` unsigned integers, and ``mask``, a fixed-size list of as many booleans:
true for a token, false for padding after a file's last token. All sequences are of one length and nothing is
compressed, so sequence ``k`` is an offset into a memory map. ``N.documents.arrow`` lists the documents in the
order of their tokens: ``doc_id``, ``start`` in the file's tokens and ``n_tokens``. Files follow one another in
the order of the document ids; a manifest table names those that count.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from patquarry.llm import scratch
from patquarry.llm.tokens import encoder

MANIFEST = "part long, file string, n_tokens long, n_documents long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _open(uri: str, mode: str):
    """A file of any file system that Arrow knows; a local one is memory-mapped for reading."""
    system, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        system.create_dir(path.rpartition("/")[0], recursive=True)
        return system.open_output_stream(path)
    return pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)


class SequenceWriter:
    """Writes one pair of files; holds one batch of sequences at most."""

    def __init__(self, uri: str, length: int, width: int, batch: int = 256) -> None:
        self.length, self.type = length, np.dtype(f"<u{width}")
        ids = pa.list_(pa.from_numpy_dtype(self.type), length)
        self.schema = pa.schema([("ids", ids), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.files = [_open(f"{uri}.ids.arrow", "w"), _open(f"{uri}.documents.arrow", "w")]
        self.ids, self.index = pa.ipc.new_file(self.files[0], self.schema), pa.ipc.new_file(self.files[1], self.index_schema)
        self.most = batch * length * width
        self.held, self.rows, self.n_tokens, self.n_documents = bytearray(), [], 0, 0

    def add(self, doc_id: int | None, raw: bytes) -> None:
        n = len(raw) // self.type.itemsize
        self.rows.append((doc_id, self.n_tokens, n))
        self.n_tokens += n
        self.n_documents += 1
        self.held += raw
        while len(self.held) >= self.most:
            self._put(bytes(self.held[: self.most]), self.most // self.type.itemsize)
            del self.held[: self.most]
        if len(self.rows) >= 65_536:
            self._put_rows()

    def _put(self, raw: bytes, n: int) -> None:
        values = np.frombuffer(raw, self.type)
        mask = np.arange(len(values)) < n
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (values, mask)]
        self.ids.write_batch(pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, self.schema, strict=True)], schema=self.schema))

    def _put_rows(self) -> None:
        columns = zip(*self.rows, strict=True)
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=self.index_schema))
        self.rows = []

    def close(self) -> None:
        if self.held:
            n = len(self.held) // self.type.itemsize
            pad = -n % self.length
            self._put(bytes(self.held) + bytes(pad * self.type.itemsize), n)
        if self.rows:
            self._put_rows()
        for x in (self.ids, self.index, *self.files):
            x.close()


def read_documents(uri: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """Each document of a pair of files: its id, its start in the file and its ids, sliced from the mapped batches."""
    with _open(f"{uri}.ids.arrow", "r") as f, _open(f"{uri}.documents.arrow", "r") as g:
        data, index = pa.ipc.open_file(f), pa.ipc.open_file(g)
        length = data.schema.field("ids").type.list_size
        batches = (data.get_batch(i) for i in range(data.num_record_batches))
        held, base, end = [], 0, 0  # arrays that cover the tokens base to end
        for i in range(index.num_record_batches):
            for doc_id, start, n in zip(*(c.to_pylist() for c in index.get_batch(i).columns), strict=True):
                while end < start + n:
                    batch = next(batches)
                    values = batch.column(0).flatten().to_numpy(zero_copy_only=True)
                    used = batch.column(1).flatten().true_count if batch.num_rows * length else 0
                    held.append(values[:used])
                    end += used
                while held and base + len(held[0]) <= start:
                    base += len(held.pop(0))
                parts, at = [], base
                for values in held:
                    if at < start + n and at + len(values) > start:
                        parts.append(values[max(0, start - at) : start + n - at])
                    at += len(values)
                yield doc_id, start, parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, data.schema.field("ids").type.value_type.to_pandas_dtype())


def read_sequence(uri: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence ``k`` of a file, without reading the others."""
    with _open(f"{uri}.ids.arrow", "r") as f:
        data = pa.ipc.open_file(f)
        first = data.get_batch(0).num_rows  # all batches but the last are of one size
        batch = data.get_batch(k // first)
        length, at = data.schema.field("ids").type.list_size, k % first
        ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)[at * length : (at + 1) * length]
        return ids, np.asarray(batch.column(1).flatten().slice(at * length, length))


def write(df: DataFrame, folder: str, path: str, end_id: int, length: int = 2048, width: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id`` and write the ids in ascending order of the key.

    Returns the manifest, a row for each file that counts, as a table in the shared folder. A file that a lost or
    repeated task has left is not named there. ``folder`` is a URI that driver and executors share; ``width`` is
    the bytes of an id.

    A null text counts as empty and has the end id alone. Null keys come first; rows that repeat a key are kept,
    in the order of their texts' checksums. Other columns are not read. An empty table gives an empty manifest.
    The range partitioning has the key, the checksum and a row number, so a repeated key is spread, too.
    """
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("_row"))
    order = ["doc_id", "_sum", "_row"]
    rows = rows.withColumn("_sum", F.xxhash64("text"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    end = np.array([end_id], f"<u{width}").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        encode, part = encoder(path, width).encode, TaskContext.get().partitionId()
        uri = f"{folder}/{part:06d}-{uuid.uuid4().hex}"
        out = SequenceWriter(uri, length, width)
        for batch in itertools.chain([first], batches):
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out.add(doc_id, encode(x.as_py()) + end)
        out.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "file": [uri], "n_tokens": pa.array([out.n_tokens], pa.int64()), "n_documents": pa.array([out.n_documents], pa.int64())})

    return scratch.table(ranged.mapInArrow(run, MANIFEST), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """A row for each document from the files: ``doc_id``, ``start`` among all ids, ``n_tokens`` and ``ids_crc32``
    (of the ids as little-endian unsigned 32-bit integers). The manifest has a row a file, not a document."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("part", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = ((i, row["base"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for i, start, ids in read_documents(row["file"]))
                while part := list(itertools.islice(found, 20_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a stated number of partitions, which adaptive execution does not merge: about a task a file
    return files.repartitionByRange(max(1, manifest.count()), "part").mapInArrow(run, ROWS)
