"""Token ids of a corpus in Arrow files of equal-length rows, and their way back.

Each part file holds a contiguous range of the corpus in ascending id order: record batches of fixed-size lists `ids`
(16 bits if the vocabulary fits, else 32) and `mask` (8 bits each; 0: padding after the part's last id), so row r of batch b
is at a known place of a memory map and both are read without a copy. An index file beside it says where each document
begins in the part.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import encode, shared

#: Ids in a row of a file, and rows in one of its record batches.
ROW_IDS, BATCH_ROWS = 2048, 64
#: UTF-8 bytes of text for a file, about; a small corpus has two files for each core, so that all are busy.
PART_BYTES = 64 << 20
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64())])
_MANIFEST = "part int, path string, n_ids long, n_docs long"


def _file_schema(row_ids: int, kind: type) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), row_ids)), ("mask", pa.list_(pa.uint8(), row_ids))])


class _Rows:
    """Cuts a stream of ids into rows and writes full record batches."""

    def __init__(self, sink: pa.NativeFile, row_ids: int, most: int):
        self.kind = np.uint16 if most < 1 << 16 else np.uint32
        self.row_ids, self.schema, self.held, self.total = row_ids, _file_schema(row_ids, self.kind), bytearray(), 0
        self.writer = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: bytes) -> None:
        self.held += ids
        self.total += len(ids) // 4
        full = BATCH_ROWS * self.row_ids * 4
        at = 0
        while len(self.held) - at >= full:
            self._write(bytes(self.held[at : at + full]))
            at += full
        del self.held[:at]

    def _write(self, ids: bytes) -> None:
        n = len(ids) // 4
        rows = -(-n // self.row_ids)
        flat = np.zeros(rows * self.row_ids, self.kind)
        flat[:n] = np.frombuffer(ids, "<u4")
        mask = (np.arange(len(flat)) < n).astype(np.uint8)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.row_ids) for x in (flat, mask)]
        self.writer.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._write(bytes(self.held))
        self.writer.close()


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, spaces: bool, row_ids: int = ROW_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files; returns the manifest (part, path, n_ids, n_docs), already computed.

    A null text is empty, so its document is the end id alone. Equal ids keep an order by text. Rows without an id come
    first. Other columns are not read. An empty table gives no part with documents. A task that runs again writes files
    of its own name; the manifest names those of the attempt that counted.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    size, rows = chosen.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    parts = max(1, min(rows, max(-(-size // PART_BYTES), 2 * docs.sparkSession.sparkContext.defaultParallelism)))
    ordered = chosen.repartitionByRange(parts, "doc", "tie").sortWithinPartitions("doc", "tie").select("doc", "text")
    end = encode.as_bytes([end_id])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}"
        store.create_dir(root, recursive=True)
        to_ids = encode.encoder(tokenizer, spaces)
        n_docs = 0
        with store.open_output_stream(f"{root}/{name}.arrow") as sink, store.open_output_stream(f"{root}/{name}.index.arrow") as side:
            rows, index = _Rows(sink, row_ids, max(to_ids.most, end_id)), pa.ipc.new_file(side, _INDEX)
            for batch in batches:
                for b in encode.slices(batch):
                    starts, sizes = [], []
                    for ids in to_ids(b.column(1)):
                        starts.append(rows.total)
                        rows.add(ids + end)
                        sizes.append(rows.total - starts[-1])
                    index.write_batch(pa.record_batch([b.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=_INDEX))
                    n_docs += len(b)
            rows.close()
            index.close()
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([name]), pa.array([rows.total], pa.int64()), pa.array([n_docs], pa.int64())], ["part", "path", "n_ids", "n_docs"])

    return shared.stash(ordered.mapInArrow(write, _MANIFEST), "manifest")


class TokenFile:
    """One part file: rows by number, or spans of ids by their place in the part, without copying the file where it is local."""

    def __init__(self, folder: str, name: str):
        store, root = fs.FileSystem.from_uri(folder)
        if isinstance(store, fs.LocalFileSystem):
            store = fs.LocalFileSystem(use_mmap=True)
        self.file = pa.ipc.open_file(store.open_input_file(f"{root}/{name}.arrow"))
        self.index = pa.ipc.open_file(store.open_input_file(f"{root}/{name}.index.arrow"))
        self.row_ids, self._held = self.file.schema.field("ids").type.list_size, (-1, None)

    def _batch(self, i: int) -> np.ndarray:
        if self._held[0] != i:
            self._held = (i, self.file.get_batch(i).column(0).flatten().to_numpy())
        return self._held[1]

    def row(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of row r, as views of the file."""
        batch, at = self.file.get_batch(r // BATCH_ROWS), r % BATCH_ROWS
        return tuple(batch.column(c)[at].values.to_numpy(zero_copy_only=True) for c in (0, 1))

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from start to start + n in pieces that lie in one record batch each."""
        size = BATCH_ROWS * self.row_ids
        while n > 0:
            i, at = divmod(start, size)
            piece = self._batch(i)[at : at + n]
            yield piece
            start, n = start + len(piece), n - len(piece)


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document as the files hold them."""
    spark, rows, offset = manifest.sparkSession, [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):  # one row for each file
        rows.append((r["part"], r["path"], offset))
        offset += r["n_ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, before in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                part = TokenFile(folder, name)
                for i in range(part.index.num_record_batches):
                    ix = part.index.get_batch(i)
                    sums = []
                    for start, n in zip(ix.column(1).to_pylist(), ix.column(2).to_pylist(), strict=True):
                        crc = 0
                        for piece in part.span(start, n):
                            crc = zlib.crc32(np.ascontiguousarray(piece, "<u4"), crc)
                        sums.append(crc)
                    yield pa.record_batch([ix.column(0), pa.array(ix.column(1).to_numpy() + before), ix.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(rows, "part int, path string, before long").repartition(max(1, len(rows)), "part")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
