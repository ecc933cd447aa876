"""Token ids in files of fixed-width bits.

A file: the magic, then blocks, then a footer of JSON (width, blocks as [offset, documents, ids]) and its length in 8 bytes. A block holds
the doc_ids and the lengths of its documents as signed and unsigned 64-bit numbers, a byte for each that is 1 where the doc_id is null (its
number is 0), and then its ids, each in the least number of bits that the vocabulary needs; 64 ids fill as many 64-bit words as an id has bits, so numpy unpacks whole blocks and any document by itself.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import file_system, fresh_dir, map_rows, note, spread, store, struct, tidy
from tessera.llm.words import WORD_BPE, word_encoder

MAGIC = b"TESSPK02"
BLOCK_IDS = 1 << 20
END_ID = 1
FILES = 3  # that a task reads back
HEAD = 17  # bytes of a block for each document, before its ids


def bits(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids (below 2**width, width at most 32), low bits first; the last group of 64 is filled with zeros."""
    n = -(-len(ids) // 64)
    v = np.zeros(n * 64, np.uint64)
    v[: len(ids)] = ids
    v = v.reshape(n, 64)
    out = np.zeros((n, width), "<u8")
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[:, word] |= v[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= v[:, j] >> np.uint64(64 - shift)
    return out.tobytes()


def unpack(data: bytes, width: int, count: int, first: int = 0) -> np.ndarray:
    """count ids as unsigned 32-bit, from the id numbered first on; only the groups of 64 that hold them are read."""
    low, high = first // 64, -(-(first + count) // 64)
    words = np.frombuffer(data, "<u8", (high - low) * width, low * width * 8).reshape(high - low, width)
    out = np.empty((high - low, 64), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        v = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | words[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = v & mask
    return out.reshape(-1)[first - low * 64 : first - low * 64 + count]


class Writer:
    """Blocks go out as they fill, so memory holds one of them. The file appears under its name only once it is whole."""

    def __init__(self, uri: str, width: int):
        self.fs, self.path = file_system(uri)
        self.file, self.width = self.fs.open_output_stream(self.path), width
        self.file.write(MAGIC)
        self.at, self.blocks = len(MAGIC), []
        self.keys: list[int | None] = []
        self.sizes: list[int] = []
        self.parts: list[bytes] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: unsigned 32-bit, little-endian."""
        self.keys.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.parts.append(ids)
        self.held += len(ids) // 4
        if self.held >= BLOCK_IDS:
            self._flush()

    def _flush(self) -> None:
        none = np.array([k is None for k in self.keys], np.uint8)
        keys = np.array([k or 0 for k in self.keys], "<i8")
        data = keys.tobytes() + np.array(self.sizes, "<u8").tobytes() + none.tobytes() + pack(np.frombuffer(b"".join(self.parts), "<u4"), self.width)
        self.blocks.append([self.at, len(self.keys), self.held])
        self.file.write(data)
        self.at += len(data)
        self.keys, self.sizes, self.parts, self.held = [], [], [], 0

    def close(self) -> None:
        if self.keys:
            self._flush()
        footer = json.dumps({"width": self.width, "blocks": self.blocks}).encode()
        self.file.write(footer + len(footer).to_bytes(8, "little"))
        self.file.close()


class Reader:
    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n = int.from_bytes(self.file.read_at(8, size - 8), "little")
        footer = json.loads(self.file.read_at(n, size - 8 - n))
        if self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is no packed file")
        self.width, self.blocks, self.end = footer["width"], footer["blocks"], size - 8 - n

    def block(self, k: int) -> tuple[list[int | None], np.ndarray, np.ndarray]:
        """doc_ids, lengths and ids of one block."""
        at, docs, ids = self.blocks[k]
        upto = self.blocks[k + 1][0] if k + 1 < len(self.blocks) else self.end
        data = self.file.read_at(upto - at, at)
        none = np.frombuffer(data, np.uint8, docs, docs * 16).tolist()
        keys = [None if no else i for i, no in zip(np.frombuffer(data, "<i8", docs).tolist(), none, strict=True)]
        return keys, np.frombuffer(data, "<u8", docs, docs * 8), unpack(memoryview(data)[docs * HEAD :], self.width, ids)

    def document(self, k: int, i: int) -> np.ndarray:
        """The ids of document i of block k, without unpacking its neighbours."""
        at, docs, _ = self.blocks[k]
        sizes = np.frombuffer(self.file.read_at(docs * 8, at + docs * 8), "<u8")
        first, count = int(sizes[:i].sum()), int(sizes[i])
        low, high = first // 64 * self.width * 8, -(-(first + count) // 64) * self.width * 8
        return unpack(self.file.read_at(high - low, at + docs * HEAD + low), self.width, count, first % 64)


MANIFEST = struct("part int, uri string, docs long, ids long")


def write_packed(df: DataFrame, folder: str, text: str = "text", key: str = "doc_id", tokenizer: str = WORD_BPE, end_id: int | None = END_ID) -> DataFrame:
    """Encodes df's texts and writes a file for each partition, in ascending order of key, null first; rows of one key by a hash of their
    text and by the text, so a key with many rows may be spread over files. A null text is empty; rows that repeat both are written as often
    as they stand there; other columns are not read. Returns the manifest, one row for each file (none for an empty table), as a stored table:
    it names the files of the attempts that counted, so lost and repeated tasks do no harm."""
    spark = df.sparkSession
    clean = df.select(F.col(key).cast("long").alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    clean = clean.withColumn("h", F.xxhash64("text"))
    ordered = clean.repartitionByRange("key", "h").sortWithinPartitions("key", "h", "text").select("key", "text")
    arrow = to_arrow_schema(MANIFEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_encoder(tokenizer), b"" if end_id is None else end_id.to_bytes(4, "little")
        part, writer, docs, ids = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            step = max(1, int(batch.num_rows * 8e6 // max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                if writer is None:
                    uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.bin"
                    writer = Writer(uri, bits(max(encode.vocab_size, (end_id or 0) + 1)))
                for k, data in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist()), strict=True):
                    writer.add(k, data + end)
                    docs, ids = docs + 1, ids + (len(data) + len(end)) // 4
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((part, uri, docs, ids), arrow, strict=True)], schema=arrow)

    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    spark.sparkContext.setJobDescription("write packed token files")
    try:
        return store(ordered.mapInArrow(run, MANIFEST).repartition(1), "manifest")  # a row a file
    finally:
        spark.sparkContext.setJobDescription(None)


DOCUMENTS = struct("doc_id long, start long, n_tokens long, ids_crc32 long")


def read_packed(manifest: DataFrame) -> DataFrame:
    """Each document of the manifest's files, read back: doc_id, start (ids of all before it), n_tokens and the crc32 of its ids as
    little-endian unsigned 32-bit numbers. The manifest has a row a file, so its running sum in one task is small; files are read by
    as many tasks as there are, up to the session's partitions."""
    files = manifest.select("part", "uri", (F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("ids")).alias("base"))

    def make() -> Callable[[dict], Iterator[tuple]]:
        def one(row: dict) -> Iterator[tuple]:
            reader, start = Reader(row["uri"]), row["base"]
            for k in range(len(reader.blocks)):
                keys, sizes, ids = reader.block(k)
                at = 0
                for key, n in zip(keys, sizes.tolist(), strict=True):
                    yield key, start, n, zlib.crc32(ids[at : at + n])
                    at, start = at + n, start + n

        return one

    n, docs = manifest.agg(F.count("*"), F.coalesce(F.sum("docs"), F.lit(0))).first()
    rows = map_rows(spread(files, -(-n // FILES), "part"), make, DOCUMENTS)
    return rows.repartition(max(1, -(-docs // 500_000)))  # four numbers a document, read by many tasks, go to few files


@tidy
def op6_token_files(documents: DataFrame) -> DataFrame:
    """Writes the documents as packed files and reads them back (see write_packed for nulls, repeats and order); the files go once the
    result is stored."""
    return read_packed(write_packed(documents, note(fresh_dir(documents.sparkSession, "packed"))))
