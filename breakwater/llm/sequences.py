"""Operator 7: token ids in Arrow stream-file format, as fixed-size lists with zero-copy random access.

Documents are dealt by ranges of doc_id and sorted. Each task writes one file of equal-length sequences, `ids` and `mask` as fixed-size
lists in batches of `BATCH` sequences, and beside it an index file with each document's place. The ids of one file run on through its
sequences; only its last sequence is padded, and mask is 0 there, else 1, a bit a place. So sequence k is row k % BATCH of batch k // BATCH, a view of the
mapped file (its mask is unpacked). Ids take 16 bits where the vocabulary allows.

A task writes under a name of its own and reports it when it is done: what a lost or repeated attempt leaves is never read. The driver
gets one row a file.

Edge cases: null and empty texts are the end id alone; a null id comes before all others; rows with one id are ordered by a hash of the
text, then by the text; an empty table gives no files and no rows; only the id and text columns are read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path
from .tokens import default_vocabulary, encoder

BATCH = 256
FILES = "part int, path string, documents long, tokens long"


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _opened(uri: str) -> pa.ipc.RecordBatchFileReader:
    fs, path = _at(uri)
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path))


class SequenceFile:
    """Random access to the sequences of one file, and to its documents."""

    def __init__(self, uri: str) -> None:
        self.reader = _opened(uri + ".arrow")
        self.length = self.reader.schema.field("ids").type.list_size
        self.index = _opened(uri + ".index.arrow").read_all()

    def _batch(self, k: int, column: str) -> np.ndarray:
        flat = self.reader.get_batch(k).column(column).flatten()
        if column == "mask":  # eight places a byte
            return np.unpackbits(np.frombuffer(flat.buffers()[1], np.uint8), count=flat.offset + len(flat), bitorder="little")[flat.offset :]
        return flat.to_numpy(zero_copy_only=True)

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(k % BATCH * self.length, (k % BATCH + 1) * self.length)
        return self._batch(k // BATCH, "ids")[at], self._batch(k // BATCH, "mask")[at]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Each document's id, its place in the file's ids, and its ids; one batch is mapped at a time."""
        span, now, ids = BATCH * self.length, -1, np.zeros(0)
        for b in self.index.to_batches():
            for doc, first, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts = []
                for k in range(first // span, (first + n - 1) // span + 1):
                    if k != now:
                        now, ids = k, self._batch(k, "ids")
                    parts.append(ids[max(0, first - k * span) : first + n - k * span])
                yield doc, first, parts[0] if len(parts) == 1 else np.concatenate(parts)


def _writer(folder: str, vocabulary: str, length: int, end: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        kind = np.dtype("<u2" if tool.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        tail = np.asarray([end], "<u4").tobytes()
        fs, base = _at(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        about = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("tokens", pa.int64())])
        span, rest, done, docs = BATCH * length, np.zeros(0, kind), 0, 0
        sink = index = None

        def put(flat: np.ndarray, real: int) -> None:
            mask = pa.array(np.arange(len(flat)) < real)
            sink.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(flat), length), pa.FixedSizeListArray.from_arrays(mask, length)], schema=schema))

        for b in batches:
            if not b.num_rows:
                continue
            if sink is None:
                fs.create_dir(base, recursive=True)
                files = [fs.open_output_stream(f"{base}/{name}{x}") for x in (".arrow", ".index.arrow")]
                sink, index = (pa.ipc.new_file(f, s) for f, s in zip(files, (schema, about), strict=True))
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                got = [np.frombuffer(tool.ids(t.as_py()) + tail, "<u4").astype(kind) for t in some.column(1)]
                sizes = np.fromiter(map(len, got), np.int64, len(got))
                firsts = done + np.cumsum(sizes) - sizes
                index.write_batch(pa.RecordBatch.from_arrays([some.column(0), pa.array(firsts), pa.array(sizes)], schema=about))
                done, docs = done + int(sizes.sum()), docs + len(got)
                rest = np.concatenate((rest, *got))
                for k in range(len(rest) // span):
                    put(rest[k * span : (k + 1) * span], span)
                rest = rest[len(rest) // span * span :].copy()
        if sink is None:
            return
        if len(rest):
            put(np.concatenate((rest, np.zeros(-len(rest) % length, kind))), len(rest))
        for x in (sink, index, *files):
            x.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([docs]), pa.array([done])], ["part", "path", "documents", "tokens"])

    return of


def write_sequences(docs: DataFrame, folder: str, vocabulary: str | None = None, length: int = 1024, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> list:
    """Writes the files and returns a row for each, in order: part, path, documents, tokens."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    dealt = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return sorted(dealt.mapInArrow(_writer(folder, vocabulary or default_vocabulary(), length, end), FILES).collect())


def read_documents(spark: SparkSession, files: list) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, from the files."""
    starts = np.concatenate(([0], np.cumsum([f.tokens for f in files]))).tolist()
    listed = spark.createDataFrame([(f.path, s) for f, s in zip(files, starts, strict=False)], "path string, start long").repartition(max(1, len(files)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc, first, ids in SequenceFile(path).documents():
                    rows.append((doc, start + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return listed.mapInArrow(of, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read_back(docs: DataFrame, vocabulary: str | None = None, length: int = 1024, end: int = 0) -> DataFrame:
    spark = docs.sparkSession
    return read_documents(spark, write_sequences(docs, shared_path(spark, "sequences"), vocabulary, length, end))
