"""Repair of the structure of conversations (operator 11).

A forward Viterbi search over four states of the grammar (system? (user assistant)+)?: nothing yet, after
system, after user, after assistant. Each state holds the least (cost, audit string) by which the turns so
far can end in it; a turn is kept, given another role or deleted, and its layer is closed with the inserts
that lead from one state to the next, two at most.

Conversations are dealt in ranges, so a long one is cut into segments. A segment is searched from each of the
four states at once; its table of least (cost, audit) from state to state takes the place of its turns when
the segments of a conversation are put together.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, materialise, rows, small, table
from tidemark.operators.ordered import beside, in_ranges

WHITE = " \t\n\x0b\x0c\r"
INITIALS = ("", "s", "u", "a")
ROLES = ("", "system", "user", "assistant")
#: (from, to): the states that a kept or inserted turn leads between.
MOVES = ((0, 1), (0, 2), (1, 2), (3, 2), (2, 3))
LEGAL = frozenset(("su", "ua", "au"))
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Turns that a task holds.
ROWS_PER_RANGE = 50_000

Best = tuple[int, str] | None
Layer = list[Best]


def _better(a: Best, b: Best) -> Best:
    return b if a is None else a if b is None else min(a, b)


def closed(layer: Layer) -> Layer:
    """A layer with what inserted turns add: a user after anything but a user, an assistant after a user."""
    insert = lambda best: None if best is None else (best[0] + INSERT, best[1] + "I")
    out = list(layer)
    for state in (0, 1, 3):
        out[2] = _better(out[2], insert(layer[state]))
    out[3] = _better(out[3], insert(out[2]))
    return out


def step(layer: Layer, initial: str, fault: str) -> Layer:
    """The layer after one more turn. ``fault``: blank, duplicate, truncated or empty."""
    out: Layer = [None if best is None else (best[0] + DELETE, best[1] + "D") for best in layer]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault else 0
        for start, end in MOVES:
            if layer[start] is None:
                continue
            cost, audit = layer[start]
            if initial == INITIALS[end]:
                out[end] = _better(out[end], (cost + more, audit + "K"))
            elif end >= 2:
                out[end] = _better(out[end], (cost + more + REROLE, audit + "R"))
    out = closed(out)
    if out[3] is not None:
        # From after an assistant all can be done that can be done from after a system turn; from nothing, a system turn besides, whose deletion costs two.
        for state, more in ((0, DELETE), (1, 0)):
            if out[state] is not None and out[state][0] > out[3][0] + more:
                out[state] = None
    return out


class Search:
    """The search from one state. What all states' audits begin with is put aside now and then, so that they stay short."""

    def __init__(self, start: int):
        self.layer: Layer = closed([(0, "") if s == start else None for s in range(4)])
        self.common: list[str] = []
        self.steps = 0

    def add(self, initial: str, fault: str) -> None:
        self.layer = step(self.layer, initial, fault)
        self.steps += 1
        if self.steps % 256 == 0:
            shared = os.path.commonprefix([best[1] for best in self.layer if best])
            self.common.append(shared)
            self.layer = [best and (best[0], best[1][len(shared) :]) for best in self.layer]

    def ends(self) -> Layer:
        before = "".join(self.common)
        return [best and (best[0], before + best[1]) for best in self.layer]


def edits(turns: Iterator[tuple[str, str]], audit: str, state: int = 0) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of a repaired conversation; ``state`` is where it begins."""
    for letter in audit:
        role, text = next(turns) if letter != "I" else ("", "")
        if letter == "D":
            continue
        state = INITIALS.index(role[:1]) if letter == "K" else 3 if state == 2 else 2
        yield role if letter == "K" else ROLES[state], text, letter


def joined(tables: list[list[Best]]) -> tuple[int, list[tuple[int, str]]]:
    """The least cost of segments' tables (four starts by four ends), and for each segment where it begins and its audit."""
    known: list[tuple[int, str, list] | None] = [(0, "", []), None, None, None]
    for found in tables:
        options: list[list] = [[], [], [], []]
        for start, before in enumerate(known):
            for end in range(4):
                if before is not None and (best := found[4 * start + end]) is not None:
                    options[end].append((before[0] + best[0], before[1] + best[1], [*before[2], (start, best[1])]))
        known = [min(x) if x else None for x in options]
    cost, _, parts = min(x for x in (known[0], known[3]) if x is not None)
    return cost, parts


# The tables

_PIECES = "array<struct<place:long,start:long,audit:string>>"
_COUNTS = ("n", "blank", "duplicate", "truncated", "illegal", "turns")
SEGMENT = f"conv string, place long, {', '.join(f'{c} long' for c in _COUNTS)}, first string, last string, low long, high long, costs array<long>, audits array<string>, sha string"
_SEGMENT = pa.schema([("conv", pa.string()), ("place", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("sha", pa.string())])
FOUND = f"conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, sha string, pieces {_PIECES}"
_FOUND = pa.schema([("conv", pa.string()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("sha", pa.string()), ("pieces", pa.list_(pa.struct([("place", pa.int64()), ("start", pa.int64()), ("audit", pa.string())])))])
TURNS = "conv string, place long, nth long, role string, text string, edit string"
_TURNS = pa.schema([("conv", pa.string()), ("place", pa.int64()), ("nth", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])


def placed(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text, digest, place, part): the turns of ``turns`` (conv_id, turn, role, text), written in ranges of (conv_id, turn, role, digest of text)."""
    held = turns.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]).withColumn("digest", F.sha2("text", 256))
    held = materialise(held)
    ranges = max(held.sparkSession.sparkContext.defaultParallelism, -(-held.count() // ROWS_PER_RANGE))
    order = [F.asc_nulls_first(c) for c in ("conv", "turn", "role", "digest")]
    return in_ranges(held, order, ranges).withColumnRenamed("__place", "place").withColumn("part", F.shiftright("place", 33))


def _in_order(df: DataFrame, by: str = "part") -> DataFrame:
    return df.repartition(by).sortWithinPartitions("place")


def segments(turns: DataFrame) -> DataFrame:
    """One row for each range that a conversation has turns in; see ``placed`` for ``turns``.

    Turns are repeats within a segment if it has seen them, and in later segments if an earlier one has them: only such texts are joined.
    """
    seen = turns.groupBy("conv", "role", "digest").agg(F.min("part").alias("since"), F.max("part").alias("until")).where("since < until").drop("until")
    flagged = beside(turns, small(materialise(seen)), ["conv", "role", "digest"], "left")
    again = F.coalesce(F.col("part") > F.col("since"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = None
        for batch in rows(batches):
            for conv, turn, role, text, digest, place, part, again in zip(*[c.to_pylist() for c in batch.columns]):
                if held is None or held.key != (conv, part):
                    if held is not None:
                        yield held.row()
                    held = _Segment(conv, part, place)
                held.add(turn, role, text, digest, again)
        if held is not None:
            yield held.row()

    return map_rows(_in_order(flagged.select("conv", "turn", "role", "text", "digest", "place", "part", again.alias("again"))), run, SEGMENT, _SEGMENT, 64)


class _Segment:
    """What there is to say of a conversation's turns in one range."""

    def __init__(self, conv: str | None, part: int, place: int):
        self.key, self.place = (conv, part), place
        self.searches = [Search(s) for s in range(4)]
        self.counts, self.seen, self.texts = dict.fromkeys(_COUNTS, 0), set(), []
        self.first = self.last = self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, digest: str, again: bool) -> None:
        counts, initial, bare = self.counts, role[:1], text.rstrip(WHITE)
        fault = "blank" if not bare else "duplicate" if again or (role, digest) in self.seen else "" if bare[-1] in ".!?" else "truncated"
        self.seen.add((role, digest))
        counts["n"] += 1
        if fault:
            counts[fault] += 1
        if self.last is None:
            self.first = initial
        else:
            counts["illegal"] += self.last + initial not in LEGAL
        self.last = initial
        if turn is not None:
            counts["turns"] += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        for search in self.searches:
            search.add(initial, fault)
        self.texts.append((role, text))

    def row(self) -> tuple:
        best = [x for search in self.searches for x in search.ends()]
        audit = min(x for x in (best[0], best[3]) if x)[1]
        sha, between = hashlib.sha256(), b""
        for role, text, _ in edits(iter(self.texts), audit):
            sha.update(between + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            between = b"\n"
        return self.key[0], self.place, *self.counts.values(), self.first, self.last, self.low, self.high, [x[0] if x else -1 for x in best], [x[1] if x else "" for x in best], sha.hexdigest()


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Segments of a conversation, in order, to one row."""
    for batch in rows(batches, 64):
        for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total = {c: sum(p[c] for p in parts) for c in _COUNTS}
            total["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(parts, parts[1:]))
            timed = [p for p in parts if p["low"] is not None]
            turns = total["turns"] - sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:]))
            gaps = timed[-1]["high"] - timed[0]["low"] + 1 - turns if timed else 0
            cost, ways = joined([[(c, a) if c >= 0 else None for c, a in zip(p["costs"], p["audits"])] for p in parts])
            pieces = [{"place": p["place"], "start": start, "audit": audit} for p, (start, audit) in zip(parts, ways)]
            yield conv, gaps, *[total[c] for c in ("blank", "duplicate", "truncated", "illegal")], cost, "".join(a for _, a in ways), parts[0]["sha"] if len(parts) == 1 else None, pieces


def audits(turns: DataFrame) -> DataFrame:
    """One row for each conversation of ``placed`` turns: counts, cost, audit, and the audit's pieces by segment. ``sha`` is null where there are several."""
    held = segments(turns)
    fields = [c for c in held.columns if c not in ("conv", "place")]
    return map_rows(held.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("place", *fields)))), _fold, FOUND, _FOUND, 64)


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The turns of repaired conversations, in order of (conv, place, nth): conv, place, nth, role, text, edit (K kept, R another role, I inserted)."""
    pieces = found.select(F.explode("pieces").alias("p")).select("p.*")
    begun = turns.join(pieces, "place", "left").select("conv", "part", "place", "role", "text", "start", "audit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: tuple | None = None
        for batch in rows(batches):
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[6] is not None:
                    if held:
                        yield from made(*held)
                    held = (row[0], row[5], row[6], [])
                held[3].append((row[2], row[3], row[4]))
        if held:
            yield from made(*held)

    def made(conv, start, audit, texts):
        places = iter(texts)
        at, nth = texts[0][0], 0

        def told():
            nonlocal at, nth
            for place, role, text in places:
                at, nth = place, 0 if place != at else nth  # inserts may stand before the first turn
                yield role, text

        for role, text, edit in edits(told(), audit, start):
            nth += 1
            yield conv, at, nth, role, text, edit

    return map_rows(_in_order(begun), run, TURNS, _TURNS, 256)


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, pieces, sha) and their repaired turns (see ``repaired``).

    ``turns``: conv_id, turn, role, text; other columns are left out. A null conv_id is a conversation; null roles and texts are one
    space, so such a text is blank; null turns come first. Turns of one number stand in the order of role and digest of text; of equal
    turns each but the first is a duplicate. Roles count by their first letter, in lower case only; any other has to be given up. conv is the
    text of conv_id. No turns: no conversations. Very long texts are held one conversation and range at a time. sha is the
    SHA-256 of the repaired conversation's ``role:text``, joined by newlines; for a conversation in several ranges its turns are
    streamed through one task for this, since each step of a digest needs the one before.
    """
    held = placed(turns)
    found = materialise(audits(held))
    fixed = repaired(held, found)
    cut = found.where(F.size("pieces") > 1).select("conv")
    long = beside(fixed, small(cut), ["conv"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, sha = None, None
        for batch in rows(batches):
            for key, role, text in zip(*[c.to_pylist() for c in batch.columns[:3]]):
                if sha is None or key != conv:
                    if sha is not None:
                        yield conv, sha.hexdigest()
                    conv, sha = key, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if sha is not None:
            yield conv, sha.hexdigest()

    streamed = long.repartition("conv").sortWithinPartitions("conv", "place", "nth").select("conv", "role", "text")
    digests = map_rows(streamed, run, "conv string, long_sha string", pa.schema([("conv", pa.string()), ("long_sha", pa.string())]))
    none = F.lit(hashlib.sha256().hexdigest())
    whole = beside(found, small(materialise(digests)), ["conv"], "left").withColumn("sha", F.coalesce("sha", "long_sha", none)).drop("long_sha")
    return whole, fixed


# The query


def damaged(conversations: DataFrame) -> DataFrame:
    """The faults that the query repairs, by crc32 of ``conv_id:turn``; null is one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    held = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind != 0")
    hurt = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    made = held.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), hurt.alias("text"), "kind")
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return made.withColumn("copy", F.explode(copies)).drop("copy", "kind")


def op11_conversation_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each conv_id of ``conversations``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; see ``damaged`` and ``repair``."""
    given = table(spark, sf_dir, "conversations")
    found, _ = repair(damaged(given))
    every = given.select("conv_id").distinct().withColumn("conv", F.col("conv_id").cast("string"))
    named = beside(every, found.drop("pieces"), ["conv"], "left")
    zero: list[Column] = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return named.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _sql() -> str:
    """The same search, a step for each turn of all conversations; a state is (cost, audit, repaired lines)."""
    crc = "xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda a, k: xor(a >> 1, 3988292384 * (a & 1)), xor(c, b)), 4294967295), 4294967295)"
    way = lambda s, cost, letter, line="''": f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 'r': {s}.r || {line}}}"
    least = lambda *xs: "list_min([" + ", ".join(xs) + "])"
    keep = lambda s, initial: way(s, f"more + CASE WHEN initial = '{initial}' THEN 0 ELSE 1000000000 END", "K", "chr(10) || role || ':' || text")
    rerole = lambda s, role: way(s, "more + 1", "R", f"chr(10) || '{role}:' || text")
    insert = lambda s, role: way(s, 5, "I", f"chr(10) || '{role}:'")
    none = "{'c': 1000000000, 'a': '~', 'r': ''}"
    start = ["{'c': 0, 'a': '', 'r': ''}", none, "{'c': 5, 'a': 'I', 'r': chr(10) || 'user:'}", "{'c': 10, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}"]
    gone = "{'c': CAST({}.c + 2 AS BIGINT), 'a': {}.a || 'D', 'r': {}.r}"
    delete = lambda s: gone.replace("{}", s)
    cast = lambda x: f"CAST({x} AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR))"
    layer = [
        cast(delete("s0")),
        cast(least(delete("s1"), keep("s0", "s"))),
        cast(least(delete("s2"), *[x for s in ("s0", "s1", "s3") for x in (keep(s, "u"), rerole(s, "user"))])),
        cast(least(delete("s3"), keep("s2", "a"), rerole("s2", "assistant"))),
    ]
    white = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations
), hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM raw, (VALUES (1), (2)) v(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)
), o AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, {white}) AS bare, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM hurt
), p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM o
), f AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM p
), g AS (
  SELECT *, CASE fault WHEN 'truncated' THEN 5 WHEN '' THEN 0 ELSE 1000000000 END AS more FROM f
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n FROM f GROUP BY conv_id
), dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {', '.join(f'{cast(x)} AS s{k}' for k, x in enumerate(start))} FROM sums
  UNION ALL
  SELECT conv_id, i, s0, s1, s2, {cast(least('s3', insert('s2', 'assistant')))} AS s3 FROM (
    SELECT conv_id, i, s0, s1, {cast(least('s2', insert('s0', 'user'), insert('s1', 'user'), insert('s3', 'user')))} AS s2, s3 FROM (
      SELECT dp.conv_id, g.i, {', '.join(f'{x} AS s{k}' for k, x in enumerate(layer))} FROM dp JOIN g ON dp.conv_id IS NOT DISTINCT FROM g.conv_id AND g.i = dp.i + 1))
), ended AS (
  SELECT dp.conv_id, {least('s0', 's3')} AS best FROM dp JOIN sums ON dp.conv_id IS NOT DISTINCT FROM sums.conv_id AND dp.i = sums.n
), every AS (
  SELECT DISTINCT conv_id FROM conversations
)
SELECT every.conv_id, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))}, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
FROM every LEFT JOIN sums ON every.conv_id IS NOT DISTINCT FROM sums.conv_id LEFT JOIN ended ON every.conv_id IS NOT DISTINCT FROM ended.conv_id
"""


ORACLE_SQL = {"op11_conversation_structure_repair": _sql()}
