"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise, shared_folder, shuffled, table

__all__ = ["free_names", "map_rows", "materialise", "rows", "salted", "shared_folder", "shuffled", "small", "table", "text_key", "without_rows"]

#: What counts as white space in the text contracts: space and tab to carriage return.
SPACES = r"[ \t-\r]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rows(batches: Iterable[pa.RecordBatch], step: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``step`` rows, so that Python objects exist for a few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


_CUT = {str: re.compile(r"[ \t-\r]"), bytes: re.compile(rb"[ \t-\r]")}


def slices(text: str | bytes, size: int = 1 << 22) -> Iterator[str | bytes]:
    """The whole text in slices of about ``size``, cut before white space, so that no word is cut and only one slice's words exist at a time."""
    at = 0
    while len(text) - at > size and (cut := _CUT[type(text)].search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def batched(made: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of ``schema``."""
    held: list[tuple] = []
    for row in made:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, type=f.type) for col, f in zip(zip(*held), schema)], schema=schema)


def map_rows(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], ddl: str, schema: pa.Schema, size: int = 4096) -> DataFrame:
    """``mapInArrow`` with a function that yields tuples, ``size`` of which make a batch; ``ddl`` and ``schema`` describe the same columns.

    Workers are used again by later tasks, so what Arrow holds of a task's texts is given back at its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(make(batches), schema, size)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, ddl)


def small(held: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``held`` marked for broadcast if it has ``most`` rows at most. They are counted, so what is sent has a bound; a larger table is joined by a shuffle."""
    return F.broadcast(held) if held.limit(most + 1).count() <= most else shuffled(held)


def salted(left: DataFrame, right: DataFrame, key: str, spread: str, salts: int = 16) -> DataFrame:
    """Inner join by ``key``, of which ``right`` has one row each. A key with many rows on the left is dealt over ``salts`` tasks by ``spread``."""
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))
    return left.withColumn("__salt", F.pmod(F.xxhash64(F.lit(salts), spread), F.lit(salts))).join(shuffled(copies), [key, "__salt"]).drop("__salt")


def free_names(docs: DataFrame, *wanted: str) -> list[str]:
    """The ``wanted`` names, each with as many underscores behind it as no column of ``docs`` has."""
    taken, found = {c.lower() for c in docs.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id and ``text_key`` are in ``gone`` (written, distinct); nulls match nulls. Columns stay those of ``docs`` and may have any names."""
    of_id, of_text = free_names(docs, "__gone_id", "__gone_text")
    named = gone.select(F.col("doc_id").alias(of_id), F.col("text_key").alias(of_text))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(of_id)) & text_key(docs["text"]).eqNullSafe(F.col(of_text))
    return docs.join(small(named), same, "left_anti")


def text_key(text: Column) -> Column:
    """Tells apart the texts of rows that share a doc_id."""
    return F.xxhash64(text.cast("string"))
