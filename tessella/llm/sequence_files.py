"""Token ids in Arrow files of equal-length sequences, with masks.

A file holds one range of documents in doc_id order as one stream of ids, cut into fixed-size lists of `width` ids; the
last list is padded, and a second column of fixed-size lists of booleans tells ids from padding. All batches of a file
but the last have the same number of lists, so the list, batch and offset of the n-th id follow by division: a reader
maps the file and slices it, without copying or reading what lies before. An index file beside it has a row for each
document. Ids take 16 bits where the vocabulary allows it, else 32.

Tasks write files of their own names into the shared folder and return one manifest row each; a repeated task leaves a
file that no manifest names. File starts are running totals over the manifest: one number for each file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import as_bytes, batch, map_batches, new_folder, ordered_ids
from tessella.llm.tokens import encoder

WIDTH, LISTS = 2048, 64


def id_type(vocabulary: int) -> pa.DataType:
    return pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()


class Writer:
    """Writes one stream of ids as fixed-size lists."""

    def __init__(self, sink, kind: pa.DataType, width: int = WIDTH, lists: int = LISTS):
        self.kind, self.width, self.lists = kind, width, lists
        self.schema = pa.schema([("ids", pa.list_(kind, width)), ("mask", pa.list_(pa.bool_(), width))], {"width": str(width), "lists": str(lists)})
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n += len(ids)
        if self.n_held >= (size := self.width * self.lists):
            stream = np.concatenate(self.held)
            whole = len(stream) - len(stream) % size
            for i in range(0, whole, size):
                self.batch(stream[i : i + size])
            self.held, self.n_held = [stream[whole:]], len(stream) - whole

    def batch(self, ids: np.ndarray) -> None:
        pad = -len(ids) % self.width
        values = np.concatenate([ids, np.zeros(pad, ids.dtype)]).astype(self.kind.to_pandas_dtype())
        mask = np.arange(len(values)) < len(ids)
        self.file.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(values, self.kind), self.width), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.width)], schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            self.batch(np.concatenate(self.held))
        self.file.close()


class SequenceFile:
    """Random access to the sequences, masks and documents of one file."""

    def __init__(self, uri: str):
        fs, path = FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        meta = self.file.schema.metadata
        self.width, self.lists = int(meta[b"width"]), int(meta[b"lists"])
        self.at, self.held = -1, None

    def batch(self, i: int) -> pa.RecordBatch:
        if i != self.at:
            self.at, self.held = i, self.file.get_batch(i)
        return self.held

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of the i-th sequence."""
        ids, mask = (self.batch(i // self.lists).column(c)[i % self.lists].values for c in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from a place in the stream; a view of the file if they lie in one batch."""
        size, parts = self.width * self.lists, []
        while n:
            values = self.batch(start // size).column(0).values.to_numpy()
            part = values[start % size : start % size + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)

    def close(self) -> None:
        self.held = None
        self.source.close()


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files and returns their manifest: (part, first_ord, uri, index_uri, n_ids, n_docs, start)."""
    spark = docs.sparkSession
    rows, _ = ordered_ids(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part, out = TaskContext.get().partitionId(), None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
                fs, path = FileSystem.from_uri(f"{name}.arrow")
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                sink, index_sink = fs.open_output_stream(path), fs.open_output_stream(path.removesuffix(".arrow") + ".index.arrow")
                index = pa.ipc.new_file(index_sink, pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())]))
                out, n_docs, first = Writer(sink, id_type(enc.size)), 0, b.column(0)[0].as_py()
            encoded = [x + end for x in enc.encode(as_bytes(b.column(2)))]
            n = np.array([len(x) // 4 for x in encoded], np.int64)
            index.write_batch(batch(["doc_id", "start", "n"], pa.array(b.column(1).to_pylist(), pa.int64()), out.n + np.cumsum(n) - n, n))
            for x in encoded:
                out.add(np.frombuffer(x, "<u4"))
            n_docs += len(n)
        if out is not None:
            out.close()
            index.close()
            sink.close()
            index_sink.close()
            yield batch(["part", "first_ord", "uri", "index_uri", "n_ids", "n_docs"], [part], [first], [f"{name}.arrow"], [f"{name}.index.arrow"], [out.n], [n_docs])

    ordered = rows.repartitionByRange("ord").sortWithinPartitions("ord")
    files = map_batches(ordered, run, "part long, first_ord long, uri string, index_uri string, n_ids long, n_docs long").collect()
    start, manifest = 0, []
    for f in sorted(files, key=lambda f: f["part"]):  # parts are ranges of ord
        manifest.append((*f, start))
        start += f["n_ids"]
    return spark.createDataFrame(manifest, "part long, first_ord long, uri string, index_uri string, n_ids long, n_docs long, start long")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, index_uri, first in zip(*(b.column(i).to_pylist() for i in range(3))):
                file = SequenceFile(uri)
                fs, path = FileSystem.from_uri(index_uri)
                with fs.open_input_file(path) as source:
                    index = pa.ipc.open_file(source)
                    for i in range(index.num_record_batches):
                        x = index.get_batch(i)
                        sums = [zlib.crc32(file.ids(s, n).astype("<u4").tobytes()) for s, n in zip(x.column(1).to_pylist(), x.column(2).to_pylist())]
                        yield batch(["doc_id", "start", "n_tokens", "ids_crc32"], x.column(0), x.column(1).to_numpy() + first, x.column(2), pa.array(sums, pa.int64()))
                file.close()

    n = max(1, manifest.count())
    return map_batches(manifest.select("uri", "index_uri", "start").repartition(n, F.col("uri")), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1) -> DataFrame:
    """Writes all documents' ids and returns what the files hold: one row for each row of docs.

    Documents are ordered by doc_id (null first; repeated ids by text). A null or empty text has its end id alone. An
    empty table writes no file and gives no rows. Files are written when this is called, into `folder`, where they
    stay, or into a new one in the folder that executors share, which is deleted when the session's process ends.
    """
    return read(write(docs, folder or new_folder(docs.sparkSession, "sequences"), tokenizer, end_id))
