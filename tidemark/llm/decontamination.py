"""Benchmark decontamination by one Aho-Corasick automaton (operator 7).

Items are normalised to words; each run of ``window`` consecutive item words (or a shorter item as a
whole) is a pattern. Words of the items become symbols, all other words share one more, so a document
becomes a short string in which position k is its k-th word. One scan finds every occurrence of every
pattern; word k maps back to its characters in the original text. A symbol is one character, or two of different
alphabets if there are more words than characters.

At its root the automaton tries the first words of all patterns one by one, and most steps end there, so it scans only
where a pattern may stand. Of the n - 3 runs of four in a pattern of n words one begins at a place of the document that
n - 3 divides: the runs at these places are looked up among those of the items, and the words around the ones found are scanned.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_LOWER, ASCII_UPPER, map_rows, materialise, rows, slices, small, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans(ASCII_UPPER, ASCII_LOWER)  # keeps every character's place
_FIRST = 0x10000  # symbols start above the surrogates
_AUTOMATA: dict[str, Automaton] = {}

#: Characters of the items that one automaton holds; each worker builds it, and takes about 120 bytes a character.
MOST_CHARS = 1_000_000
#: Words of a run that is looked up (or a shorter pattern as a whole); as many in a row are seldom the same by chance.
RUN = 4
SPAN = "array<struct<start:long,end:long>>"
DDL = f"doc_id long, n_words long, hits {SPAN}, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", _SPANS), ("items", pa.list_(pa.string()))])


#: Lower-cases A-Z and blanks what isn't part of a word; in UTF-8 all bytes of other characters are above 127.
_FLAT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def flat(text: str | None) -> bytes:
    """The words of a text in UTF-8, with blanks between."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FLAT)


class Automaton:
    """All windows of some items. ``items``: (item_id or None, text)."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int, symbols: int = 0x110000 - _FIRST):
        import ahocorasick

        words = {w: None for _, text in items for w in flat(text).split()}
        self.width = 1 if len(words) < symbols else 2
        half = symbols // 2
        make = (lambda n: chr(_FIRST + n)) if self.width == 1 else (lambda n: chr(_FIRST + n // half) + chr(_FIRST + half + n % half))
        self.symbol = {w: make(n) for n, w in enumerate(words)}
        owners: dict[str, set[str]] = defaultdict(set)
        for item_id, text in items:
            line = [self.symbol[w] for w in flat(text).split()]
            for at in range(max(1, len(line) - window + 1) if line else 0):
                owners["".join(line[at : at + window])] |= {item_id} - {None}
        self.machine = ahocorasick.Automaton()
        values: dict[tuple, tuple] = {}  # patterns of an item share one
        while owners:  # which go as the machine grows
            pattern, ids = owners.popitem()
            value = len(pattern) // self.width, tuple(ids)
            self.machine.add_word(pattern, values.setdefault(value, value))
        if values:
            self.machine.make_automaton()
        self.runs: dict[int, set[tuple[bytes, ...]]] = defaultdict(set)  # by the words of a pattern
        held = dict(zip(words, words))  # runs share one object a word
        for _, text in items:
            own = [held[w] for w in flat(text).split()]
            if own:
                n = min(len(own), window)
                self.runs[n].update(zip(*[own[i:] for i in range(min(n, RUN))]))

    def near(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Merged stretches [first, last) of words, within which all patterns stand that there are."""
        found = []
        for n, runs in self.runs.items():
            size = min(n, RUN)
            step = n - size + 1
            for k, run in enumerate(zip(*[words[i::step] for i in range(size)])):
                if run in runs:
                    found.append((max(0, (k - 1) * step + 1), k * step + n))
        return merged(found)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """How many words there are, the merged runs [first, last) of hit ones, and the item_ids."""
        symbol, none, longest = self.symbol.get, "\0" * self.width, max(self.runs, default=1)
        seen, rest, hits, ids = 0, [], [], set()
        for part in slices(flat(text)):
            words = part.split()
            words[:0] = rest  # a pattern may begin in the slice before
            start = seen - len(rest)
            for first, last in self.near(words):
                line = "".join([symbol(w, none) for w in words[first:last]])
                for at, (n, owners) in self.machine.iter(line):
                    end = start + first + (at + 1) // self.width
                    if end > seen:
                        extend(hits, end - n, end)
                        ids.update(owners)
            seen, rest = start + len(words), words[max(0, len(words) - longest + 1) :]
        return seen, hits, ids


def extend(runs: list[tuple[int, int]], a: int, b: int) -> None:
    """Adds [a, b) to merged runs; these come in order of their starts, or of their ends."""
    while runs and a <= runs[-1][1]:
        first, last = runs.pop()
        a, b = min(a, first), max(b, last)
    runs.append((a, b))


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        extend(out, a, b)
    return out


def automaton(items: list[tuple], window: int, key: str) -> Automaton:
    """One automaton for each Python worker and set of items."""
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = Automaton(items, window)
    return _AUTOMATA[key]


def _item_parts(benchmark: DataFrame, most_chars: int) -> Iterator[list[tuple]]:
    """The items in parts of at most ``most_chars`` characters (an item is never cut), read one at a time.

    The size is checked before anything reaches the driver, which holds one part at a time.
    """
    chars = F.coalesce(F.length("text"), F.lit(0))
    n, total = benchmark.agg(F.count(F.lit(1)), F.coalesce(F.sum(chars), F.lit(0))).first()
    parts = max(1, -(-(total + 64 * n) // most_chars))
    dealt = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    part = F.pmod(F.xxhash64("text", "item_id"), F.lit(parts))
    for k in range(parts):
        yield [tuple(r) for r in (dealt.where(part == k) if parts > 1 else dealt).collect()]


def _shared(docs: DataFrame, items: list[tuple], window: int):
    """A function that gives a task the automaton of the items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    key = hashlib.sha256(repr((items, window)).encode("utf-8", "surrogatepass")).hexdigest()
    return lambda: automaton(shared.value, window, key)


def _scan(docs: DataFrame, items: list[tuple], window: int) -> DataFrame:
    machine_of = _shared(docs, items, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        machine = machine_of()
        for batch in rows(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, runs, ids = machine.scan(text)
                yield doc_id, n, [{"start": a, "end": b} for a, b in runs], sorted(ids)

    return map_rows(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")), run, DDL, SCHEMA)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_chars: int = MOST_CHARS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, hits (runs of word positions), items, n_hit, contaminated.

    ``most_chars`` bounds the items that one automaton holds; a larger benchmark takes one scan for
    each part, whose runs are then merged by row. A null text has no words; an item without words
    matches nothing; an item with a null item_id hits words but isn't listed; repeated rows and items
    change nothing else. Very long texts are split into words in slices. Empty tables give no rows or no hits; other columns are ignored.
    """
    parts = _item_parts(benchmark, most_chars)
    items, more = next(parts), next(parts, None)
    if more is None:
        found = _scan(docs, items, window)
    else:
        # Written once: numbers must not change from scan to scan, whatever stands above ``docs``.
        numbered = materialise(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()))
        scan = lambda part: materialise(_scan(numbered.select(F.col("row").alias("doc_id"), "text"), part, window))
        every = scan(items).unionByName(scan(more))
        for part in parts:
            every = every.unionByName(scan(part))
        gathered = every.withColumnRenamed("doc_id", "row").groupBy("row").agg(
            F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
        )
        step = lambda acc, x: F.when((F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x)))
        hits = F.aggregate("all", F.array().cast(SPAN), step)
        found = numbered.select("row", "doc_id").join(gathered, "row").select("doc_id", "n_words", hits.alias("hits"), "items")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", n_hit > 0)


def hit_characters(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of word positions as [start, end) code points of the original text."""
    at = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_chars: int = MOST_CHARS) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window, in the columns of ``docs``, whatever their names; texts are not shuffled.

    Whether a row goes depends on its text alone, so only two hashes of the texts that go come back from the scan, and rows are dropped by
    these. Null and empty texts, repeated rows and rows of one doc_id are each judged by their own text and stay where it is clean. An empty
    table stays empty; with an empty benchmark every row stays.
    """
    text = docs["text"].cast("string")
    keys = [F.xxhash64(text), F.xxhash64(F.lit(1), text)]
    texts = docs.select(text.alias("text"), *[k.alias(f"key{i}") for i, k in enumerate(keys)])
    schema = pa.schema([("key0", pa.int64()), ("key1", pa.int64())])
    found = None
    for items in _item_parts(benchmark, most_chars):

        def run(batches: Iterator[pa.RecordBatch], machine_of=_shared(docs, items, window)) -> Iterator[tuple]:
            machine = machine_of()
            for batch in rows(batches):
                for text, *key in zip(*[c.to_pylist() for c in batch.columns]):
                    if machine.scan(text)[1]:
                        yield tuple(key)

        part = map_rows(texts, run, "key0 long, key1 long", schema)
        found = part if found is None else found.unionByName(part)
    gone = materialise(found.distinct())
    return docs.join(small(gone), (keys[0] == gone["key0"]) & (keys[1] == gone["key1"]), "left_anti")


def op7_aho_corasick_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; see ``contamination``."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = {
    "op7_aho_corasick_decontamination": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM p
), x AS (
  SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT d.r, d.w, sizes.n, unnest(range(1, len(d.w) - sizes.n + 2)) AS i FROM d, sizes WHERE len(d.w) >= sizes.n)
), m AS (
  SELECT x.r, x.n, x.i, p.item_id FROM x JOIN p ON x.n = p.n AND x.s = p.s
), h AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM m) GROUP BY r
), t AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
}
