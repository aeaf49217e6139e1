"""Token ids in Arrow stream files of equal-length sequences with masks, and their way back."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from walkweave.session import cut

from .common import rows_of, shared_folder, texts_of
from .pretokens import loaded

#: Tokens of a sequence and sequences of a record batch: every batch of a file but the last has the same size in bytes.
SEQUENCE, BATCH = 2048, 128
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "part int, tokens_file string, docs_file string, n_docs long, n_tokens long"


def schema_of(length: int, width: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.field("item", width, False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), length))])


class Writer:
    """Writes a stream of ids as sequences of equal length; the last one is filled up with zeros that its mask marks.

    Ids of a vocabulary of up to 65,536 take two bytes, others four.
    """

    def __init__(self, sink, length: int = SEQUENCE, batch: int = BATCH, vocabulary: int = 1 << 32):
        self.length, self.batch = length, batch
        self.schema = schema_of(length, pa.uint16() if vocabulary <= 1 << 16 else pa.uint32())
        self.out = ipc.new_stream(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.size = self.total = 0

    def write(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        self.total += len(ids)
        block = self.length * self.batch
        if self.size >= block:
            flat = np.concatenate(self.held)
            whole = self.size - self.size % block
            for at in range(0, whole, block):
                self._put(flat[at:at + block], block)
            self.held, self.size = [flat[whole:].copy()], self.size - whole

    def _put(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.out.write_batch(pa.record_batch([
            pa.FixedSizeListArray.from_arrays(pa.array(ids, self.schema.field("ids").type.value_type), type=self.schema.field("ids").type),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), type=self.schema.field("mask").type)], schema=self.schema))

    def close(self) -> None:
        if self.size:
            flat = np.concatenate(self.held)
            full = np.zeros(-(-self.size // self.length) * self.length, np.uint32)
            full[:self.size] = flat
            self._put(full, self.size)
        self.out.close()


class Reader:
    """Random access to the sequences of a file: batches have one size, so the place of any is known without reading the others."""

    def __init__(self, source, length: int = SEQUENCE, batch: int = BATCH):
        self.source, self.length, self.batch = source, length, batch
        self.schema = ipc.read_schema(ipc.read_message(source))
        self.first, self.stride, self.at, self.ids = source.tell(), None, -1, None

    def ids_of(self, k: int) -> np.ndarray:
        """Ids of batch ``k``, one after another, as a view of the file's own bytes where it is memory-mapped."""
        if k != self.at:
            if k and self.stride is None:
                self.source.seek(self.first)
                ipc.read_message(self.source)
                self.stride = self.source.tell() - self.first
            self.source.seek(self.first + k * (self.stride or 0))
            found = ipc.read_record_batch(ipc.read_message(self.source), self.schema)
            self.at, self.ids = k, found.column(0).flatten().to_numpy(zero_copy_only=True)
        return self.ids

    def span(self, start: int, n: int):
        """The ids [start, start + n) of the stream, in views."""
        block = self.length * self.batch
        while n:
            k, at = divmod(start, block)
            view = self.ids_of(k)[at:at + n]
            yield view
            start, n = start + len(view), n - len(view)

    def sequence(self, k: int) -> np.ndarray:
        return np.concatenate(list(self.span(k * self.length, self.length)))


def opened(path: str):
    """A file for reading: memory-mapped where local, through Arrow's file systems elsewhere."""
    system, inner = fs.FileSystem.from_uri(path)
    return pa.memory_map(inner) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(inner)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text",
                      partitions: int | None = None, length: int = SEQUENCE, batch: int = BATCH) -> DataFrame:
    """Writes the ids of all texts in ascending order of doc_id (nulls first) below ``folder``; returns the manifest.

    A range of ids is a pair of files: the token stream and the index (doc_id, start in that stream, n_tokens). A task
    writes under names of its own attempt, and only files that the manifest lists belong to the table, so a lost executor
    or a second attempt leaves no half file in it. Rows with equal ids are spread over ranges in the order they are read.
    Null text is empty (the end id alone); an empty table gives a manifest without documents.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
               .repartitionByRange(n, "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text"))

    def run(batches):
        task = TaskContext.get()
        system, inner = fs.FileSystem.from_uri(folder)
        system.create_dir(inner, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        tool, end = loaded(tokenizer), np.array([end_id], "<u4")
        n_docs = 0
        with system.open_output_stream(f"{inner}/{name}.tokens.arrows") as a, system.open_output_stream(f"{inner}/{name}.docs.arrows") as b:
            tokens, index = Writer(a, length, batch, max(end_id, tool.tokenizer.get_vocab_size() - 1) + 1), ipc.new_stream(b, INDEX)
            for rows in rows_of(batches):
                starts, sizes = [], []
                for ids in tool.encode(texts_of(rows)):
                    starts.append(tokens.total)
                    sizes.append(len(ids) + 1)
                    tokens.write(np.concatenate((ids, end)))
                index.write_batch(pa.record_batch([rows.column("doc_id"), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=INDEX))
                n_docs += rows.num_rows
            tokens.close()
            index.close()
        yield pa.record_batch([pa.array([task.partitionId()], pa.int32()), pa.array([f"{folder}/{name}.tokens.arrows"]), pa.array([f"{folder}/{name}.docs.arrows"]),
                               pa.array([n_docs], pa.int64()), pa.array([tokens.total], pa.int64())],
                              ["part", "tokens_file", "docs_file", "n_docs", "n_tokens"])

    return cut(ordered.mapInArrow(run, MANIFEST))


def read_token_files(manifest: DataFrame, length: int = SEQUENCE, batch: int = BATCH) -> DataFrame:
    """One row per document, from the files alone: doc_id, start in the whole stream, n_tokens, ids_crc32.

    The manifest has a row for each pair of files; their places in the stream are its running sum.
    """
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).repartition(n)

    def run(batches):
        for rows in batches:
            for f in rows.to_pylist():
                with opened(f["docs_file"]) as b, opened(f["tokens_file"]) as a:
                    tokens = Reader(a, length, batch)
                    for index in ipc.open_stream(b):
                        crcs = []
                        for start, size in zip(index.column("start").to_pylist(), index.column("n_tokens").to_pylist(), strict=True):
                            crc = 0
                            for view in tokens.span(start, size):
                                crc = zlib.crc32(view.astype("<u4"), crc)
                            crcs.append(crc)
                        yield pa.record_batch([index.column("doc_id"), pa.array(index.column("start").to_numpy() + f["base"]), index.column("n_tokens"), pa.array(crcs, pa.int64())],
                                              ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the files into the shared folder and reads them back."""
    return read_token_files(write_token_files(docs, tokenizer, shared_folder(spark, "token-files")))
