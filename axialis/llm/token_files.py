"""Token ids as Arrow files of equal-length sequences.

Each file is an Arrow IPC file whose record batches hold `tokens: fixed_size_list<uint16>[length]` and
`mask: fixed_size_list<bool>[length]` (true: a real id, false: padding after a file's last id). All batches but the
last have the same number of sequences, so sequence k is in batch k // ROWS, found through the file's footer
and read by memory map without a copy. Ids fit 16 bits, which is checked against the vocabulary. A second Arrow
file beside it has each document's id, first place and number of ids in that file.

Documents are range-partitioned and sorted by doc_id (or by other columns, such as a training order); one task
writes one pair of files under its partition number, first under a name of its own, then renamed, so a task that
runs again leaves the same files. The list of files is a table in the shared folder; a file's first place in all ids
is a two-level cumulative sum over it. Defined cases: a null text is an empty document (its end id only); null ids
come first; rows with equal doc_id are ordered by the MD5 of their text; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, stored, text_chunks
from .tokenizing import BYTE_SPLIT, NOT_PLAIN, Memo, as_bytes, by_model, kept_in_process, load, special

LENGTH = 2048
ROWS = 256
BYTES_A_FILE = 32 << 20
FILES_A_GROUP = 1000


def place(folder: str):
    """The file system of a folder's address and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder.replace("file:///", "/") if folder.startswith("file:///") else folder)


def encoder(path: str, end: int):
    """A function from texts to the little-endian 16-bit ids of each, its end id appended."""
    tok = load(path)
    if tok.get_vocab_size() > 1 << 16:
        raise ValueError("ids need more than 16 bits")
    marks, memo, stop = special(tok), Memo(by_model(tok), as_bytes), as_bytes([end])

    def run(texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        slow = []
        memo.trim()
        for i, text in enumerate(texts):
            if NOT_PLAIN.search(text) or ("<" in text and marks.search(text)):
                slow.append(i)
            else:
                out[i] = b"".join(map(memo.__getitem__, BYTE_SPLIT.findall(text))) + stop
        if slow:
            for i, got in zip(slow, tok.encode_batch([texts[i] for i in slow], add_special_tokens=False), strict=True):
                out[i] = as_bytes(got.ids) + stop
        return out

    return run


class Sequences:
    """Writes a stream of ids as fixed-size-list batches."""

    def __init__(self, sink, length: int):
        self.length, self.left, self.size = length, [], 0
        kinds = [("tokens", pa.list_(pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))]
        self.writer = pa.ipc.new_file(sink, pa.schema(kinds))

    def add(self, data: bytes) -> None:
        self.left.append(data)
        self.size += len(data)
        block = 2 * self.length * ROWS
        if self.size >= block:
            data = b"".join(self.left)
            whole = len(data) // block * block
            for at in range(0, whole, block):
                self.put(np.frombuffer(data, "<u2", block // 2, at), block // 2)
            self.left, self.size = [data[whole:]], len(data) - whole

    def put(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, ["tokens", "mask"]))

    def close(self) -> None:
        ids = np.frombuffer(b"".join(self.left), "<u2")
        if len(ids):
            full = -(-len(ids) // self.length) * self.length
            self.put(np.concatenate([ids, np.zeros(full - len(ids), np.uint16)]), len(ids))
        self.writer.close()


def own_copy(column: pa.Array) -> pa.Array:
    """A column without its batch: all columns of a batch share one buffer, so kept ids would keep the texts too."""
    return column.take(pa.array(np.arange(len(column))))


def write_tokens(docs: DataFrame, folder: str, path: str, end: int = 2, length: int = LENGTH, order: list[Column] | None = None) -> DataFrame:
    """Writes the files; returns file, n_docs, n_ids of each, in the documents' order: that of `order`, else of doc_id."""
    by = order or [F.col("doc_id").cast("long"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))]
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[c.alias(f"by{i}") for i, c in enumerate(by)])
    by = [f"by{i}" for i in range(len(by))]
    n = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-n // BYTES_A_FILE))

    def run(batches):
        part = TaskContext.get().partitionId()
        where, top = place(folder)
        name, own = f"part-{part:06d}", f"{top}/.{part:06d}-{uuid.uuid4().hex}"
        where.create_dir(top, recursive=True)
        encode, ids, starts, counts, at = kept_in_process(f"ids:{path}:{end}", lambda: encoder(path, end)), [], [], [], 0
        with where.open_output_stream(own) as sink:
            out = Sequences(sink, length)
            for batch in text_chunks(batches):
                ids.append(own_copy(batch.column(0)))
                for data in encode(batch.column(1).to_pylist()):
                    starts.append(at)
                    counts.append(len(data) // 2)
                    at += len(data) // 2
                    out.add(data)
            out.close()
        if not starts:
            where.delete_file(own)
            return
        index = pa.table({"doc_id": pa.concat_arrays(ids), "start": pa.array(starts, pa.int64()), "n": pa.array(counts, pa.int64())})
        with where.open_output_stream(f"{own}.i") as sink, pa.ipc.new_file(sink, index.schema) as writer:
            writer.write_table(index)
        where.move(f"{own}.i", f"{top}/{name}.index.arrow")
        where.move(own, f"{top}/{name}.arrow")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(starts)], pa.int64()), pa.array([at], pa.int64())], ["file", "n_docs", "n_ids"])

    dealt = slim.repartitionByRange(files, *by).sortWithinPartitions(*by).select("doc_id", "text")
    return stored(dealt.mapInArrow(run, "file string, n_docs long, n_ids long"), "files")


def open_tokens(folder: str, name: str):
    """The Arrow file reader and the document index of one file; by memory map on a file system of this machine."""
    where, top = place(folder)
    source = pa.memory_map(f"{top}/{name}.arrow") if where.type_name == "local" else where.open_input_file(f"{top}/{name}.arrow")
    with where.open_input_file(f"{top}/{name}.index.arrow") as f:
        index = pa.ipc.open_file(f).read_all()
    return pa.ipc.open_file(source), index


def sequence(reader, k: int) -> np.ndarray:
    """Sequence k, without a copy."""
    batch = reader.get_batch(k // ROWS)
    length = batch.schema.field(0).type.list_size
    at = k % ROWS * length
    return batch.column(0).values.to_numpy()[at : at + length]


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, file of each document, read from the files."""

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, index = open_tokens(folder, name)
                starts, counts = index["start"].to_numpy(), index["n"].to_numpy()
                ends, sums = starts + counts, np.zeros(len(starts), np.int64)
                doc, at, crc = 0, 0, 0
                for k in range(reader.num_record_batches):
                    got = reader.get_batch(k)
                    ids = got.column(0).values.to_numpy()[: got.column(1).values.true_count]
                    wide, to = ids.astype("<u4"), at + len(ids)
                    while doc < len(ends) and starts[doc] < to:
                        crc = zlib.crc32(wide[max(0, starts[doc] - at) : ends[doc] - at].data, crc)
                        if ends[doc] > to:
                            break
                        sums[doc], crc, doc = crc, 0, doc + 1
                    at = to
                if doc < len(ends):
                    raise ValueError(f"{name} ends early")
                yield pa.RecordBatch.from_arrays([index["doc_id"].combine_chunks(), pa.array(starts + base), pa.array(counts), pa.array(sums), pa.array([name] * len(starts))], ["doc_id", "start", "n_tokens", "ids_crc32", "file"])

    number = F.regexp_extract("file", "([0-9]+)$", 1).cast("long")
    grouped = files.withColumn("group", F.floor(number / FILES_A_GROUP))
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = grouped.groupBy("group").agg(F.sum("n_ids").alias("n_ids"))
    groups = groups.select("group", before(Window.orderBy("group")).alias("first"))
    based = grouped.withColumn("inside", before(Window.partitionBy("group").orderBy(number))).join(groups, "group")
    based = based.select("file", (F.col("first") + F.col("inside")).alias("base"))
    n = max(1, files.count())
    return based.repartition(n, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def tokens_round_trip(docs: DataFrame, path: str, end: int = 2, order: list[Column] | None = None) -> DataFrame:
    folder = shared_folder(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, path, end, order=order), folder)
