"""Token counts from flat token files without any index: the end-of-document ids are searched block by block, and a prefix scan over
the blocks stitches the documents that cross their boundaries."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import file_system, files_of, fresh_dir, map_rows, note, spread, store, struct, tidy
from tessera.llm.words import WORD_BPE, word_encoder

END_OF_DOCUMENT = 49407
BLOCK_BYTES = 4 << 20
CHUNK = 1024  # blocks of a file that the prefix scan's first level takes together
PLACES = struct("uri string, bytes long, ordinal long, doc_id long")


def write_flat(df: DataFrame, folder: str, text: str = "text", key: str = "doc_id", tokenizer: str = WORD_BPE, end_id: int = END_OF_DOCUMENT) -> DataFrame:
    """Ids of df's texts (null: empty) as bare little-endian unsigned 16-bit numbers, end_id behind each document; a file for each
    partition. Special tokens' strings in a text are ordinary text, so end_id stands nowhere else. Returns the stored side table
    (uri, bytes so far, ordinal, doc_id), which the count does not use and by which its rows find their documents."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    arrow = to_arrow_schema(PLACES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, at, ordinal = word_encoder(tokenizer, special=False), None, 0, 0
        if max(encode.vocab_size - 1, end_id) >= 1 << 16:
            raise ValueError(f"ids of {tokenizer} do not fit in 16 bits")
        for batch in batches:
            step = max(1, int(batch.num_rows * 8e6 // max(batch.nbytes, 1)))
            for i in range(0, batch.num_rows, step):
                some = batch.slice(i, step)
                if out is None:
                    uri = f"{folder}/flat-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
                    fs, path = file_system(uri)
                    out = fs.open_output_stream(path)
                ids = [np.frombuffer(x + end_id.to_bytes(4, "little"), "<u4") for x in encode(some.column(1).to_pylist())]
                out.write(np.concatenate(ids).astype("<u2").tobytes())
                ends = (at + 2 * np.cumsum([len(x) for x in ids])).tolist()
                cols = [[uri] * len(ids), ends, list(range(ordinal, ordinal + len(ids))), some.column(0)]
                at, ordinal = ends[-1], ordinal + len(ids)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(cols, arrow, strict=True)], schema=arrow)
        if out:
            out.close()

    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    return store(rows.mapInArrow(run, PLACES), "places")


BLOCKS = struct("uri string, block long, n_ids long, ends longs")


def search_blocks(files: DataFrame, end_id: int, width: int, block_bytes: int) -> DataFrame:
    """files (uri, bytes) to blocks: how many ids each has, and the file-wide places behind its end-of-document ids."""
    size = block_bytes // width * width
    last = F.greatest(F.floor((F.col("bytes") - 1) / size), F.lit(0)).cast("long")
    blocks = files.where("bytes > 0").select("uri", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))

    def make() -> Callable[[dict], Iterator[tuple]]:
        def one(row: dict) -> Iterator[tuple]:
            fs, path = file_system(row["uri"])
            at = row["block"] * size
            with fs.open_input_file(path) as f:
                ids = np.frombuffer(f.read_at(min(size, row["bytes"] - at), at), f"<u{width}")
            yield row["uri"], row["block"], len(ids), (np.flatnonzero(ids == end_id) + 1 + at // width).tolist()

        return one

    n_blocks = files.agg(F.sum(last + 1)).first()[0] or 0
    return map_rows(spread(blocks, n_blocks, "uri", "block"), make, BLOCKS)


def count_tokens(files: DataFrame, end_id: int = END_OF_DOCUMENT, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """files (uri, bytes) to documents: uri, ordinal, start, n_tokens (without the end id), closed. A file may end in a document without its
    end id (closed is false); an empty file has none.

    The prefix scan has two levels and reads a block's numbers, not its places: sums and last ends over the blocks of a chunk, and over the
    chunks of a file, so a file of any size is scanned by many tasks."""
    if block_bytes < width:
        raise ValueError("a block must hold an id")
    found = store(search_blocks(files, end_id, width, block_bytes), "blocks")
    n, last = F.size("ends").cast("long"), F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0))
    info = found.select("uri", "block", "n_ids", n.alias("n"), last.alias("end"), F.floor(F.col("block") / CHUNK).alias("chunk"))
    chunks = info.groupBy("uri", "chunk").agg(F.sum("n").alias("n"), F.max("end").alias("end"), F.sum("n_ids").alias("n_ids"), F.max("block").alias("last"))
    upto = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda f, c, w: F.coalesce(f(c).over(w), F.lit(0))
    file, chunk = upto("uri", "chunk"), upto("uri", "chunk", "block")
    whole = Window.partitionBy("uri")
    chunks = chunks.select(
        "uri", "chunk", so_far(F.sum, "n", file).alias("first"), so_far(F.max, "end", file).alias("carry"),
        F.max("last").over(whole).alias("last"), F.sum("n_ids").over(whole).alias("total"),
    )
    before = info.select("uri", "chunk", "block", so_far(F.sum, "n", chunk).alias("n"), so_far(F.max, "end", chunk).alias("end")).join(chunks, ["uri", "chunk"])
    before = before.select("uri", "block", (F.col("first") + F.col("n")).alias("first"), F.greatest("carry", "end").alias("carry"), "last", "total")
    stitched = found.select("uri", "block", "ends").join(before, ["uri", "block"])
    at = F.greatest("carry", last)
    open_ = F.when((F.col("block") == F.col("last")) & (at < F.col("total")), F.array(F.col("total") + 1))  # as if an end id came next
    ends = F.concat("ends", F.coalesce(open_, F.array().cast("array<bigint>")))
    each = stitched.select("uri", "first", "total", "carry", ends.alias("ends")).select("uri", "first", "total", "carry", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("carry")).otherwise(F.try_element_at("ends", F.col("i")))
    return each.select(
        "uri", (F.col("first") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("end") - start - 1).alias("n_tokens"), (F.col("end") <= F.col("total")).alias("closed")
    )


def flat_sizes(places: DataFrame) -> DataFrame:
    return places.groupBy("uri").agg(F.max("bytes").alias("bytes"))


def flat_files(spark: SparkSession, uris: list[str]) -> DataFrame:
    """(uri, bytes) of files by name."""
    sizes = []
    for uri in uris:
        fs, path = file_system(uri)
        sizes.append((uri, fs.get_file_info(path).size))
    return spark.createDataFrame(sizes, "uri string, bytes bigint")


@tidy
def op10_token_counts(documents: DataFrame) -> DataFrame:
    """Writes the documents as flat files, counts them there, and gives each count its doc_id: doc_id, n_tokens. One row for each row, null
    doc_ids and repeated rows too; null and empty texts have 0; an empty table gives none; other columns are not read. The files go once
    the result is stored."""
    places = write_flat(documents, note(fresh_dir(documents.sparkSession, "flat")))
    counts = count_tokens(flat_sizes(places))
    named = counts.where("closed").join(places.select("uri", "ordinal", "doc_id"), ["uri", "ordinal"]).select("doc_id", "n_tokens")
    return files_of(named, places.count())
