"""Token counts of documents in flat, unindexed token files (operator 10).

A token file is nothing but little-endian ids, with an end-of-document id after each document. Files
are cut into blocks of equal size without regard to documents. Each block is searched for the end
identifier with one vectorised comparison; it reports the tokens up to its first end, those of
the documents it holds whole, and those after its last end. A prefix scan over the blocks of a file
then adds what earlier blocks left open, and numbers the documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, materialise, rows, shared_folder, table
from tidemark.llm.tokens import encoder

DTYPE = "<u2"  # vocabularies below 65,536 ids
MANIFEST_DDL, MANIFEST = "part int, ordinal long, doc_id long, bytes long", pa.schema([("part", pa.int32()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("bytes", pa.int64())])
BLOCK_DDL = "part int, block long, ends array<long>, tail long"
BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("ends", pa.list_(pa.int64())), ("tail", pa.int64())])


def _store(uri: str):
    """The file system of a URI and the path in it; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else fs.FileSystem.from_uri("file://" + uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1))


def file_name(folder: str) -> F.Column:
    """The file of a part. Rows carry the number: a path on each would shrink to nothing on disk, and look small enough to broadcast."""
    return F.format_string(f"{folder.replace('%', '%%')}/part-%06d.tok", "part")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Tokenise ``docs`` into one flat file for each task in the shared ``folder``.

    Returns the manifest (part, ordinal, doc_id, bytes of the file so far), which the reader of the
    files doesn't need. A repeated task writes the same bytes beside the file and moves them onto it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encode, task = encoder(tokenizer, DTYPE, specials_are_text=True).encode, TaskContext.get()
        end, name, size, ordinal = np.array([end_id], DTYPE).tobytes(), f"{folder}/part-{task.partitionId():06d}.tok", 0, 0
        store, path = _store(name)
        beside = f"{path}.{task.taskAttemptId()}"
        with store.open_output_stream(beside) as out:
            for batch in rows(batches):
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = encode(text or "") + end
                    out.write(ids)
                    size += len(ids)
                    yield task.partitionId(), ordinal, doc_id, size
                    ordinal += 1
        store.move(beside, path)  # before the task ends, so before its rows count

    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    return materialise(map_rows(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")), run, MANIFEST_DDL, MANIFEST))


def scan_blocks(spark: SparkSession, files: DataFrame, end_id: int, block_ids: int = 1 << 20, dtype: str = DTYPE) -> DataFrame:
    """(part, block, ends, tail): the lengths that end in each block, the first without what earlier blocks left open.

    ``files`` has (part, file, bytes). A length counts a document's tokens without its end.
    """
    width = np.dtype(dtype).itemsize
    size = block_ids * width
    blocks = files.select("part", "file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("bytes") - 1) / size)).cast("long"))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for part, file, total, block in zip(*(c.to_pylist() for c in batch.columns)):
                store, path = _store(file)
                with store.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(min(size, total - block * size), block * size), dtype)
                at = np.flatnonzero(ids == end_id)
                ends = np.diff(at, prepend=-1) - 1
                yield part, block, ends.tolist(), len(ids) - (int(at[-1]) + 1 if len(at) else 0)

    return map_rows(blocks.repartition("part", "block"), run, BLOCK_DDL, BLOCK)


def stitch(blocks: DataFrame) -> DataFrame:
    """(part, ordinal, n_tokens) of every document.

    The carry into a block is the tail of the last block before it that holds an end, plus all the
    tails since. Both are running sums over the blocks of a file, of which there are few numbers.
    """
    w = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    n = F.size("ends").cast("long")
    slim = blocks.select("part", "block", n.alias("n"), "tail")
    open_sum = F.coalesce(F.sum("tail").over(w), F.lit(0))  # tails so far
    at_end = F.coalesce(F.last(F.when(F.col("n") > 0, F.col("so_far")), ignorenulls=True).over(w), F.lit(0))
    carried = slim.withColumn("so_far", F.coalesce(F.sum("tail").over(w), F.lit(0))).select(
        "part", "block", (open_sum - at_end).alias("carry"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("first")
    )
    joined = blocks.where(F.size("ends") > 0).join(carried, ["part", "block"])
    found = joined.select("part", "first", "carry", F.posexplode("ends").alias("k", "length"))
    return found.select("part", (F.col("first") + F.col("k")).alias("ordinal"), (F.col("length") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"))


def count_tokens(spark: SparkSession, files: DataFrame, end_id: int, block_ids: int = 1 << 20, dtype: str = DTYPE) -> DataFrame:
    """(part, ordinal, n_tokens) of the documents in token files, from the files alone.

    ``files`` has (part, file, bytes): a number for each file, its path and its size. An empty document counts zero; ids after the last end are no
    document; an empty file or table of files gives no rows.
    """
    return stitch(materialise(scan_blocks(spark, files, end_id, block_ids, dtype)))


def token_counts(docs: DataFrame, tokenizer: str, end_id: int, block_ids: int = 1 << 20) -> DataFrame:
    """One row for each row of ``docs``: doc_id, part, ordinal, n_tokens, counted in flat files that are written first.

    A null or empty text counts zero; repeated rows are documents of their own; a null doc_id stays
    null; very long texts are encoded in slices and searched in blocks; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write_token_files(docs, folder, tokenizer, end_id)
    files = manifest.groupBy("part").agg(F.max("bytes").alias("bytes")).withColumn("file", file_name(folder))
    counted = materialise(count_tokens(spark, files, end_id, block_ids))
    store, path = _store(folder)
    store.delete_dir(path)
    return manifest.join(counted, ["part", "ordinal"]).select("doc_id", "part", "ordinal", "n_tokens")


def op10_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, part, ordinal, n_tokens; see ``token_counts``."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 49407)
