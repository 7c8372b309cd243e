"""Merkle manifest of a dataset (operator 13).

Rows become leaves, which are numbered within their group; each level hashes runs of ``fanout``
consecutive nodes into the nodes of the next, until a group has one: its subroot. The subroots make the
root in the same way. Each level is a DataFrame, written before the next is made of it. Going back from
the root, each run is joined with the path of the node that it makes, so that a leaf ends with its whole
path: for each level the digests of its run and its place among them.

A digest is 64 characters, so a run is one string of digests, and a place is an offset in it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_LOWER, ASCII_UPPER, materialise, small, table
from tidemark.operators.ordered import RN, TOTAL, beside, ranked

FANOUT, DIGEST = 16, 64
PATH = "array<struct<run:string,at:int>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows that a task numbers.
ROWS_PER_RANGE = 200_000


def coded(value: Column) -> Column:
    """A value so that it can't run into the next: its bytes' number, a colon and the value; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(coded, fields)), 256)


def manifest(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """One row for each row of ``leaves``: key, group, leaf, subroot, root, path, folded_root.

    ``leaves`` has the columns key (of a type that has an order), group (a text), leaf (64 characters) and other: a digest to be
    checked in the leaf's place, or null for the leaf itself. ``path`` has a run of digests and a place in it for each level from the
    leaf to the root; folded_root is what ``other`` gives along it. Null is a group of its own and comes first; so do null keys in
    their group. Rows of one key stand in the order of leaf and other, so only equal rows could change places. An empty table has an
    empty manifest. Further columns are left out. A hot group is numbered in many ranges, and its runs are spread like any others.
    """
    rows = materialise(leaves.select("key", F.col("group").cast("string").alias("group"), "leaf", "other"))
    ranges = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_RANGE))
    by = [F.asc_nulls_first(c) for c in ("key", "leaf", "other")]
    below = _levels(ranked(rows, ["group"], by, ranges).select("group", RN, TOTAL, F.col("leaf").alias("digest"), F.struct("key", "leaf", "other").alias("of")), fanout)
    subroots = materialise(reduce(DataFrame.unionByName, [x.where(F.col(TOTAL) <= fanout).select("group", F.col("digest").alias("subroot")) for x in below]))
    tops = subroots.select(F.lit("").alias("all"), "group", "subroot")
    placed = ranked(tops, ["all"], [F.asc_nulls_first("group")], ranges).select(F.col("all").alias("group"), RN, TOTAL, F.col("subroot").alias("digest"), F.struct("group", "subroot").alias("of"))
    above = _levels(placed, fanout)
    top = above[-1].first()  # one digest
    trunk = rows.sparkSession.range(1).select(F.lit("").alias("group"), F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"))
    named = _paths(above, trunk, fanout).select("of.group", "of.subroot", "path")
    found = _paths(below, materialise(named), fanout)
    folded = F.aggregate("path", F.coalesce("of.other", "of.leaf"), lambda now, x: F.sha2(F.concat(*_around(x, now)), 256))
    return found.select("of.key", "group", "of.leaf", "subroot", F.lit(top["digest"] if top else None).cast("string").alias("root"), "path", folded.alias("folded_root"))


def proof(path: Column) -> Column:
    """SHA-256 of all siblings along a path: the others of each run, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(*_around(x))), ""), 256)


def _around(x: Column, *node: Column) -> tuple[Column, ...]:
    """What stands before a place in a run, ``node``, and what stands after it."""
    return F.substr(x["run"], F.lit(1), x["at"]), *node, F.substr(x["run"], x["at"] + DIGEST + 1)


def _levels(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """Runs of each level: (group, __rn and digest of the node that the run makes, __rows of the level, run); the first also has ``of``, what its nodes stand for.

    A single node isn't hashed again. A group with at most ``fanout`` nodes ends with the run that holds them.
    """
    made: list[DataFrame] = []
    left = None
    while left is None or left > fanout:
        if made:
            more = F.ceil(F.col(TOTAL) / fanout).cast("long")
            nodes = made[-1].where(F.col(TOTAL) > fanout).select("group", RN, more.alias(TOTAL), "digest")
        kept = [c for c in ("of",) if c in nodes.columns]
        runs = nodes.groupBy("group", F.floor(F.col(RN) / fanout).cast("long").alias(RN)).agg(F.max(TOTAL).alias(TOTAL), F.array_sort(F.collect_list(F.struct(RN, "digest", *kept))).alias("nodes"))
        run = F.array_join(F.transform("nodes", lambda x: x["digest"]), "")
        of = [F.transform("nodes", lambda x: x["of"]).alias("of")] if kept else []
        made.append(materialise(runs.select("group", RN, TOTAL, run.alias("run"), F.when(F.col(TOTAL) == 1, run).otherwise(F.sha2(run, 256)).alias("digest"), *of)))
        left = made[-1].agg(F.max(TOTAL)).first()[0] or 0 if left is None else -(-left // fanout)
    return made


def _paths(levels: Sequence[DataFrame], groups: DataFrame, fanout: int) -> DataFrame:
    """(group, __rn, of, path, subroot): one row for each node of the first level. ``groups`` has the path of each group's last node, and its subroot, which is carried along."""
    known = None
    for runs in reversed(levels):
        held = beside(runs.where(F.col(TOTAL) <= fanout), small(groups), ["group"])
        if known is not None:
            held = held.unionByName(beside(runs.where(F.col(TOTAL) > fanout), known, ["group", RN]))
        of = ["of"] if "of" in runs.columns else []
        nodes = F.posexplode("of" if of else F.sequence(F.lit(0), F.floor(F.length("run") / DIGEST).cast("int") - 1))
        each = held.select("group", RN, TOTAL, "run", "path", "subroot", nodes.alias("place", "of"))
        own = F.when(F.col(TOTAL) == 1, F.array().cast(PATH)).otherwise(F.array(F.struct("run", (F.col("place") * DIGEST).cast("int").alias("at"))))
        known = each.select("group", (F.col(RN) * fanout + F.col("place")).alias(RN), F.concat(own, "path").alias("path"), "subroot", *of)
    return known


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is made of the five columns of ``documents``; groups are sources. Where 5 divides the crc32 of doc_id, the text is
    checked in lower case; a null doc_id has no crc32, so its text is checked as it is. See ``manifest`` for repeated rows, nulls and empty tables.
    """
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf(*map(F.col, FIELDS[:-1]), F.translate("text", ASCII_UPPER, ASCII_LOWER)))
    made = leaf(*map(F.col, FIELDS))
    found = manifest(docs.select(F.col("doc_id").alias("key"), F.col("source").alias("group"), made.alias("leaf"), F.nullif(tampered, made).alias("other")))
    return found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(levels: int = 8) -> str:
    """Levels and proofs are written out, one query each: sixteen to the power of ``levels`` leaves a source."""
    code = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"
    fields = " || ".join(map(code, FIELDS[:-1]))
    crc = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda a, k: xor(a >> 1, 3988292384 * (a & 1)), xor(c, b)), 4294967295), 4294967295)"
    lower = code(f"translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}')")
    parts = [f"""d AS (
  SELECT doc_id, source, sha256({fields} || {code('text')}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({fields} || {lower}) ELSE sha256({fields} || {code('text')}) END AS other FROM documents
), p0 AS (
  SELECT doc_id, leaf, other AS now, '' AS proof, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d
), l0 AS (
  SELECT source, i, n, leaf AS h FROM p0
)"""]
    # Once up the trees of the sources, once up the tree of their subroots.
    for tree, key, path in (("l", "source", "p"), ("t", "top", "q")):
        if tree == "t":
            ends = " UNION ALL ".join(f"SELECT source, h FROM l{k} WHERE n = 1" for k in range(levels + 1))
            parts.append(f"""s AS ({ends}
), tops AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM s
), t0 AS (
  SELECT 0 AS top, i, n, subroot AS h FROM tops
), q0 AS (
  SELECT doc_id, leaf, now, proof, 0 AS top, subroot, tops.i FROM p{levels} p JOIN tops ON p.source IS NOT DISTINCT FROM tops.source
)""")
        for k in range(levels):
            left, right = "substr(run, 1, 64 * CAST(p.i % 16 AS BIGINT))", "substr(run, 64 * CAST(p.i % 16 AS BIGINT) + 65)"
            parts.append(f"""g{tree}{k} AS (
  SELECT {key}, i // 16 AS i, n, string_agg(h, '' ORDER BY i) AS run FROM {tree}{k} WHERE n > 1 GROUP BY {key}, i // 16, n
), {tree}{k + 1} AS (
  SELECT {key}, i, (n + 15) // 16 AS n, sha256(run) AS h FROM g{tree}{k}
), {path}{k + 1} AS (
  SELECT doc_id, leaf, CASE WHEN run IS NULL THEN now ELSE sha256({left} || now || {right}) END AS now, proof || coalesce({left} || {right}, '') AS proof, p.{key}, {'subroot, ' * (tree == 't')}p.i // 16 AS i
  FROM {path}{k} p LEFT JOIN g{tree}{k} g ON p.{key} IS NOT DISTINCT FROM g.{key} AND p.i // 16 = g.i
)""")
    roots = " UNION ALL ".join(f"SELECT h FROM t{k} WHERE n = 1" for k in range(levels + 1))
    return "WITH " + ", ".join(parts) + f", r AS ({roots})\nSELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = r.h AS verified FROM q{levels} CROSS JOIN r"


ORACLE_SQL = {"op13_merkle_manifest": _sql()}
