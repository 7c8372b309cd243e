"""Exact dedup against history through a minimal perfect hash (operator 9).

Digests (SHA-256 of the normalised text) of the historical documents are made distinct with their
winner and count, dealt into shards by digest, and each shard gets a minimal perfect hash: levels of
bit arrays, where a digest that falls alone on its position stays and the others go on to the next
level. The rank of its bit is a digest's slot; slots hold the full digest, the winner's locator
(doc_id) and the count. New documents, pre-aggregated by digest, are looked up in their shard; a hit
counts only if all 32 bytes agree. What is no member forms groups of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, free_names, materialise, shuffled, small, table

GAMMA = 2.0  # positions for each digest of a level
FOUND = "digest binary, keep_id long, group_size long, keep_rows long, known boolean"
FOUND_SCHEMA = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("keep_rows", pa.int64()), ("known", pa.bool_())])
INDEX = "shard int, sizes array<long>, bits binary, digests binary, locators array<long>, counts array<long>, keep_rows array<long>"
INDEX_SCHEMA = pa.schema([("shard", pa.int32()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("digests", pa.binary()), ("locators", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("keep_rows", pa.list_(pa.int64()))])


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of each row; a null text counts as empty."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(docs["text"]), 256)).alias("digest"))


def _groups(found: DataFrame) -> DataFrame:
    """Distinct digests with the smallest doc_id, the rows, and how many of them carry that doc_id."""
    by_id = found.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return by_id.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), F.coalesce(F.min_by("n", "doc_id"), F.sum("n")).alias("keep_rows"))


def _words(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit words of each 32-byte digest; the shard uses others."""
    words = keys.view("<u8").reshape(-1, 4)
    return words[:, 1], words[:, 2] | np.uint64(1)


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    """Positions at a level; all 64 bits are mixed, so that two digests don't meet at every level."""
    x = a + np.uint64(level) * b
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


def _keys(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def build_levels(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels, their bits end to end, and the slot of each of the distinct ``keys``."""
    a, b = _words(keys)
    left, sizes, bits, at = np.arange(len(keys)), [], [], np.zeros(len(keys), np.int64)
    base = 0
    while left.size:
        size = max(8, int(GAMMA * left.size))
        place = _place(a[left], b[left], len(sizes), size)
        alone = np.bincount(place, minlength=size) == 1
        stays = alone[place]
        at[left[stays]] = base + place[stays]
        left, base = left[~stays], base + size
        sizes.append(size)
        bits.append(alone)
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    return sizes, flat, (np.cumsum(flat) - 1)[at] if len(keys) else at


def look_up(keys: np.ndarray, sizes: list[int], flat: np.ndarray) -> np.ndarray:
    """The slot that each key would have; -1 where it falls on no bit. The caller compares digests."""
    a, b = _words(keys)
    rank, slot, left, base = np.cumsum(flat) - 1, np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        if not left.size:
            break
        place = base + _place(a[left], b[left], level, size)
        hit = flat[place]
        slot[left[hit]] = rank[place[hit]]
        left, base = left[~hit], base + size
    return slot


def _build(group: pa.Table) -> pa.Table:
    keys = _keys(group["digest"])
    sizes, flat, slot = build_levels(keys)
    order = np.argsort(slot)
    taken = group.take(pa.array(order))
    made = [[group["shard"][0].as_py()], [sizes], [np.packbits(flat).tobytes()], [keys[order].tobytes()], *([taken[c].to_pylist()] for c in ("keep_id", "group_size", "keep_rows"))]
    return pa.Table.from_arrays([pa.array(x, type=f.type) for x, f in zip(made, INDEX_SCHEMA)], schema=INDEX_SCHEMA)


def _least(a: int | None, na: int, b: int | None, nb: int) -> tuple[int | None, int]:
    if a is None or b is None or a == b:
        return (b if a is None else a), (na if b is None and a is not None else nb if a is None and b is not None else na + nb)
    return (a, na) if a < b else (b, nb)


def _look_up(index: pa.Table, new: pa.Table) -> pa.Table:
    out: list[tuple] = []
    slots = np.full(new.num_rows, -1, np.int64)
    member = np.zeros(new.num_rows, bool)
    keys = _keys(new["digest"]) if new.num_rows else np.zeros((0, 32), np.uint8)
    held, locators, counts, keep_rows = np.zeros((0, 32), np.uint8), [], [], []
    if index.num_rows:
        sizes = index["sizes"][0].as_py()
        flat = np.unpackbits(np.frombuffer(index["bits"][0].as_py(), np.uint8), count=sum(sizes)).astype(bool)
        held = np.frombuffer(index["digests"][0].as_py(), np.uint8).reshape(-1, 32)
        locators, counts, keep_rows = (index[c][0].as_py() for c in ("locators", "counts", "keep_rows"))
        if new.num_rows:
            slots = look_up(keys, sizes, flat)
            member = slots >= 0
            member[member] = (held[slots[member]] == keys[member]).all(axis=1)
    ids, sizes_new, rows_new = (new[c].to_pylist() for c in ("keep_id", "group_size", "keep_rows"))
    for i in np.flatnonzero(member):
        at = slots[i]
        locators[at], keep_rows[at] = _least(locators[at], keep_rows[at], ids[i], rows_new[i])
        counts[at] += sizes_new[i]
    out += [(held[i].tobytes(), locators[i], counts[i], keep_rows[i], True) for i in range(len(held))]
    out += [(keys[i].tobytes(), ids[i], sizes_new[i], rows_new[i], False) for i in np.flatnonzero(~member)]
    columns = list(zip(*out)) or [[]] * len(FOUND_SCHEMA)
    return pa.Table.from_arrays([pa.array(x, type=f.type) for x, f in zip(columns, FOUND_SCHEMA)], schema=FOUND_SCHEMA)


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    return groups.withColumn("shard", F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int"))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The minimal perfect hash of the distinct digests of ``history`` (doc_id, digest): one row a shard."""
    return _sharded(_groups(history), shards).groupBy("shard").applyInArrow(_build, INDEX)


def exact_groups(new: DataFrame, history: DataFrame, per_shard: int = 50_000) -> DataFrame:
    """Groups of equal documents over both inputs of (doc_id, digest) rows.

    One row for each distinct digest: keep_id is the smallest doc_id, keep_rows how many rows carry
    it, known whether history holds the digest. ``per_shard`` bounds the digests that a task holds;
    SHA-256 spreads them evenly, however large the groups are.
    """
    most = new.unionByName(history).agg(F.approx_count_distinct("digest")).first()[0]
    shards = max(1, -(-2 * most // per_shard))
    index = build_index(history, shards)
    asked = _sharded(_groups(new), shards)
    return index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_look_up, FOUND)


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, keep_rows.

    Without ``history``, the rows up to the middle of the doc_id range serve as history for the rest;
    either half is read whole. Otherwise winners can lie in ``history``, whose rows count but are not
    returned. A null text equals an empty one. A null doc_id never wins over another; a group of null
    ids only is kept whole. Rows that repeat the winning doc_id are all marked kept (keep_rows says
    how many). An empty table gives no rows; other columns are ignored.
    """
    found = materialise(digests(docs))
    if history is None:
        low, high = found.agg(F.min("doc_id"), F.max("doc_id")).first()
        old = F.coalesce(F.col("doc_id") <= F.lit(((low or 0) + (high or 0)) // 2), F.lit(False))
        groups = exact_groups(found.where(~old), found.where(old))
    else:
        groups = exact_groups(found, digests(history))
    return found.join(shuffled(groups), "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "keep_rows", "known",
    )


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, in the columns of ``docs``.

    Null and empty texts are equal; of a group without any doc_id one row stays, as of rows that repeat the winning doc_id. Only
    names of rows are joined, by doc_id and digest; the texts of a group move only where several of its rows carry the winning doc_id. An
    empty table stays empty. Columns may have any names.
    """
    own = free_names(docs, "__repeats_digest", "__repeats_id")
    found = materialise(exact_dedup(docs).select("doc_id", "text_sha256", "kept", "keep_rows"))
    named = lambda rows: materialise(rows.select(F.col("doc_id").alias(own[1]), F.unhex("text_sha256").alias(own[0])).distinct())
    digest = F.unhex(F.sha2(normalised(docs["text"]), 256))
    same = (digest == F.col(own[0])) & docs["doc_id"].cast("long").eqNullSafe(F.col(own[1]))
    left = docs.join(small(named(found.where("NOT kept"))), same, "left_anti")
    several = named(found.where("kept AND keep_rows > 1"))
    if several.isEmpty():
        return left
    doubled = left.join(small(several), same, "left_semi")
    # Equal texts may still differ in white space, and rows in other columns: any one row stays.
    once = doubled.withColumn(own[0], digest).dropDuplicates(["doc_id", own[0]]).drop(own[0])
    return left.join(small(several), same, "left_anti").unionByName(once)


def op9_perfect_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256; see ``exact_dedup``."""
    return exact_dedup(table(spark, sf_dir, "documents")).drop("keep_rows", "known")


ORACLE_SQL = {
    "op9_perfect_hash_dedup": r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
}
