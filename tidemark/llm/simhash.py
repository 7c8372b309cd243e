"""SimHash near-duplicates through a segment-popcount embedding (operator 8).

A 64-bit fingerprint maps to the bit counts of its sixteen 4-bit segments. Flipping one bit moves one
count by one, so the Manhattan distance of the counts is at most the Hamming distance: two
fingerprints within 2 bits have counts within 2, and then some grid cell lies within 1 of both. Each
distinct fingerprint visits the cells within 1 of its counts (33 at most); the range-join keeps the
visits of cells that another fingerprint visits too.

Exact verification makes no pairs. Two fingerprints differ in at most 2 bits exactly if some 64-bit
centre differs from either in at most one, and a centre's counts name one of the shared cells. So
each surviving visit lists the centres of its cell (4 at most), and fingerprints are grouped by
centre. A group holds 65 fingerprints at most, all within 2 bits of each other: it links its members
to the smallest. Components follow by alternating large-star and small-star steps over these links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import free_names, map_rows, materialise, rows, salted, shuffled, slices, small, table

SEED = 42
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)  # [byte, bit]
_DDL, _SCHEMA = "doc_id long, fp long", pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprint(text: str | None, shingle: int = 3, size: int = 1 << 20) -> int:
    """The unsigned SimHash of a text: bit i is set if over half of its shingles' hashes have it. Long texts are read in slices."""
    ones, n, before, digest = np.zeros(64, np.int64), 0, [], xxhash.xxh64_intdigest
    for part in slices((text or "").encode("utf-8", "surrogatepass").lower(), size):
        words = before + part.split()
        if len(words) >= shingle:
            ones += _ones([digest(s, SEED) for s in map(b" ".join, zip(*(words[k:] for k in range(shingle))))])
            n += len(words) - shingle + 1
        before = words[max(0, len(words) - shingle + 1) :] if shingle > 1 else []
    if not n and before:
        ones, n = _ones([digest(b" ".join(before), SEED)]), 1
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _ones(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit."""
    data = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(data[:, k], minlength=256) @ _BITS for k in range(8)])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in rows(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fp = fingerprint(text, shingle)
                yield doc_id, fp - (1 << 64) if fp >> 63 else fp

    return map_rows(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")), run, _DDL, _SCHEMA)


def _nibble_counts(half: Column) -> Column:
    """Bit counts of the eight 4-bit segments of a 32-bit value, each in its own nibble."""
    less = lambda bits, mask: F.shiftright(half, bits).bitwiseAND(F.lit(mask))
    return half - less(1, 0x77777777) - less(2, 0x33333333) - less(3, 0x11111111)


def embedding(fp: Column) -> Column:
    """The bit counts of all sixteen segments, packed as nibbles."""
    upper, lower = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(_nibble_counts(upper), 32).bitwiseOR(_nibble_counts(lower))


def _visits(nodes: DataFrame) -> DataFrame:
    """(node, fp, segment, step, cell): the grid cells within Manhattan distance 1; segment -1 is the own cell."""
    moves = [(-1, 0, 0)] + [(s, step, step * (1 << 4 * s)) for s in range(16) for step in (1, -1)]
    count = lambda c, s: F.shiftrightunsigned(c, 4 * s).bitwiseAND(F.lit(15))
    cell = F.col("counts")
    options = []
    for segment, step, change in moves:
        made = F.struct(F.lit(segment).alias("segment"), F.lit(step).alias("step"), (cell + F.lit(change)).alias("cell"))
        inside = F.lit(True) if segment < 0 else count(cell, segment) < 4 if step > 0 else count(cell, segment) > 0
        options.append(F.when(inside, made))
    visited = nodes.withColumn("counts", embedding(F.col("fp"))).withColumn("v", F.explode(F.array_compact(F.array(*options))))
    return visited.select("node", "fp", "v.segment", "v.step", "v.cell")


def _centres(visits: DataFrame) -> DataFrame:
    """(centre, node): every centre in the visited cell within one bit of the fingerprint."""
    fp, segment = F.col("fp"), F.col("segment")
    flips = [F.when(segment < 0, fp)]
    for k in range(4):
        # Flipping an unset bit steps up, flipping a set bit steps down.
        bit = F.expr(f"shiftleft(1L, 4 * segment + {k})")
        is_set = fp.bitwiseAND(bit) != 0
        flips.append(F.when((segment >= 0) & (is_set == (F.col("step") < 0)), fp.bitwiseXOR(bit)))
    return visits.select("node", "fp", F.explode(F.array_compact(F.array(*flips))).alias("centre"))


def links(nodes: DataFrame) -> DataFrame:
    """(u, v), u < v: a star over each set of fingerprints that share a centre. ``nodes`` has distinct (node, fp)."""
    visits = _visits(nodes)
    shared = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cell")
    near = _centres(visits.join(shuffled(shared), "cell"))
    groups = near.groupBy("centre").agg(F.collect_list(F.struct("node", "fp")).alias("members")).where(F.size("members") > 1)
    star = groups.select(F.array_min("members").alias("root"), F.explode("members").alias("m"))
    exact = F.bit_count(F.col("root.fp").bitwiseXOR(F.col("m.fp"))) <= 2
    return star.where(exact & (F.col("root.node") < F.col("m.node"))).select(F.col("root.node").alias("u"), F.col("m.node").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge: root is the smallest node reachable.

    Alternating large-star and small-star steps; each round is written to the shared folder, and the
    rounds grow with the logarithm of the largest component. Stars around their smallest nodes need none.
    """
    edges = materialise(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v"))
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted(edges, least, "u", "v").select(F.col("m").alias("u"), "v").where("u < v")
        # Now every edge points from the larger v to the smaller u.
        down = large.withColumn("m", F.min("u").over(Window.partitionBy("v")))
        edges = materialise(down.select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u < v").distinct())
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each larger end has one edge, and is no smaller end of another."""
    ends = edges.select(F.col("u").alias("node"), F.lit(0).alias("below")).unionByName(edges.select(F.col("v").alias("node"), F.lit(1).alias("below")))
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.count(F.lit(1)).alias("n")).where("below > 1 OR below = 1 AND n > 1").isEmpty()


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at 2 or fewer differing bits; component_id is the smallest doc_id reachable.
    Null and white-space-only texts have fingerprint zero and link like any other. Copies and
    repeated rows share a fingerprint, hence a component. A row with a null doc_id counts as no name
    for a component; a component of such rows only has a null component_id. Very long texts are read
    in slices. An empty table gives no rows; other columns are ignored.
    """
    found = materialise(fingerprints(docs, shingle))
    names = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("name")))
    # A fingerprint is known by its smallest doc_id; one without any by itself, behind all that have one.
    node = F.struct(F.col("name").isNull().alias("nameless"), F.coalesce("name", "fp").alias("id"))
    nodes = names.select(node.alias("node"), "fp")
    named = nodes.join(shuffled(components(links(nodes))), "node", "left").select("fp", F.coalesce("root", "node").alias("least"))
    component = F.when(~F.col("least.nameless"), F.col("least.id")).alias("component_id")
    return found.join(shuffled(named), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component)


# Similar documents: a Jaccard similarity at which segment counts alone no longer tell anything apart

ROWS, BANDS = 6, 20  # least values of a band, and bands: a pair at 0.8 shares a band with probability 0.998
_DRAWN = np.random.default_rng(8).integers(0, 1 << 32, (2, ROWS * BANDS), dtype=np.uint32)
_XOR, _TIMES = _DRAWN[0], _DRAWN[1] | np.uint32(1)
SEGMENTS = 1024  # in which the shingles of a set are counted
_SKETCH_DDL = "node long, fp long, whole binary, size long, odd array<long>, keys array<long>"
_SKETCH = pa.schema([("node", pa.int64()), ("fp", pa.int64()), ("whole", pa.binary()), ("size", pa.int64()), ("odd", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])
_VISIT_DDL, _VISIT = "key long, u long, v long", pa.schema([("key", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])
_SET_DDL, _SET = "node long, hashes array<long>", pa.schema([("node", pa.int64()), ("hashes", pa.list_(pa.int64()))])


def shingle_hashes(text: str | None, shingle: int, size: int = 1 << 20) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; of all its words if there are fewer, none without words."""
    found, before, digest = [], [], xxhash.xxh64_intdigest
    for part in slices((text or "").encode("utf-8", "surrogatepass").lower(), size):
        words = before + part.split()
        if len(words) >= shingle:
            found.append(np.unique(np.array([digest(s, SEED) for s in map(b" ".join, zip(*(words[k:] for k in range(shingle))))], np.uint64)))
        before = words[max(0, len(words) - shingle + 1) :] if shingle > 1 else []
    if not found and before:
        found.append(np.array([digest(b" ".join(before), SEED)], np.uint64))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def set_fingerprint(hashes: np.ndarray) -> int:
    """The signed SimHash of a set of shingles."""
    data = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(data[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def odd_segments(hashes: np.ndarray) -> np.ndarray:
    """Which segments hold an odd number of the set's hashes, as bits.

    A shingle that only one of two sets has turns one bit, so the Manhattan distance of the bits is a lower bound of how many there are.
    """
    odd = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % SEGMENTS, minlength=SEGMENTS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def band_keys(hashes: np.ndarray, block: int = 1 << 10) -> np.ndarray:
    """One key for each band: a hash of the least values of its orders of the set. Sets share a least value with the probability of their similarity."""
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(folded), block):
        np.minimum(least, ((folded[at : at + block, None] ^ _XOR) * _TIMES).min(axis=0), out=least)
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(bands[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


def sketches(docs: DataFrame, shingle: int, key_bits: int = 64) -> DataFrame:
    """(node, fp, whole, size, odd, keys): the SimHash of the set of shingles, a digest of the set, its size, its odd segments, and its band keys, of which ``key_bits`` are used.

    Rows without a doc_id or words have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in rows(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = shingle_hashes(text, shingle)
                if doc_id is not None and len(hashes):
                    yield doc_id, set_fingerprint(hashes), xxhash.xxh3_128_digest(hashes.tobytes()), len(hashes), odd_segments(hashes), band_keys(hashes) >> (64 - key_bits)

    return map_rows(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")), run, _SKETCH_DDL, _SKETCH)


def run_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, node) rows in order: (key, u, v) with u the first node of the key in this partition, for each other node v.

    The first and the last key may go on in another partition: their first nodes come with a null v as well.
    """
    key = head = None
    none = pa.array([None], pa.int64())
    bound = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([head], pa.int64()), none], schema=_VISIT)
    for batch in rows(batches, 1 << 16):
        keys, nodes = (batch.column(k).to_numpy() for k in (0, 1))
        if not len(keys):
            continue
        new = np.append(key is None or keys[0] != key, keys[1:] != keys[:-1])
        place = np.cumsum(new) - 1
        heads = nodes[new][place] if new[0] else np.append(head, nodes[new])[place + 1]
        first, key, head = key is None, int(keys[-1]), int(heads[-1])
        if first:
            yield pa.RecordBatch.from_arrays([pa.array(keys[:1]), pa.array(nodes[:1]), none], schema=_VISIT)
        other = heads != nodes
        yield pa.RecordBatch.from_arrays([pa.array(keys[other]), pa.array(heads[other]), pa.array(nodes[other])], schema=_VISIT)
    if key is not None:
        yield bound()


def stars(visits: DataFrame) -> DataFrame:
    """(key, u, v), u < v: each node of a key with the smallest, or the smallest of the same part, which then goes with the smallest itself.

    Rows are dealt by ranges of key and node, so the nodes of one key may lie in many partitions, and nothing is held but the head of a run.
    """
    made = materialise(visits.repartitionByRange("key", "node").sortWithinPartitions("key", "node").mapInArrow(run_heads, _VISIT_DDL))
    heads = made.where("v IS NULL").select("key", "u").distinct()
    least = heads.groupBy("key").agg(F.min("u").alias("m"))
    across = heads.join(shuffled(least), "key").where("m < u").select("key", F.col("m").alias("u"), F.col("u").alias("v"))
    return made.where("v IS NOT NULL").unionByName(across)


def mixed_keys(visits: DataFrame, block: int = 4096) -> DataFrame:
    """(key, main, minor, blocks) of the keys of ``visits`` (key, root, node) with several roots: the most frequent, and how many nodes have others."""
    sizes = visits.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main")).where("n > main.n")
    return sizes.select("key", F.col("main.root").alias("main"), (F.col("n") - F.col("main.n")).alias("minor"), F.expr(f"n div {block} + 1").alias("blocks"))


def minor_pairs(visits: DataFrame, mixed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v), u < v: the nodes that share a key, are of different roots and that two bounds allow: by size, and by the Manhattan distance of segments.

    In each key the nodes outside its main root meet all others, which are dealt in blocks: nodes of the main root, however many, don't
    meet each other, and no task holds a whole key. The bounds are checked where two nodes meet, so what is too far apart makes no row.
    """
    here = salted(visits, mixed, "key", "node").join(shuffled(sets.select("node", "size", "odd")), "node")
    every = here.select("key", F.col("root").alias("r"), F.col("node").alias("a"), F.col("size").alias("n"), F.col("odd").alias("x"), F.pmod(F.xxhash64(F.lit(1), "node"), "blocks").alias("i"))
    minor = here.where("root != main").select("key", F.col("root").alias("q"), F.col("node").alias("b"), F.col("size").alias("m"), F.col("odd").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i"))
    met = (minor["key"] == every["key"]) & (minor["i"] == every["i"]) & (F.col("r") != F.col("q")) & (F.col("a") != F.col("b"))
    pairs = minor.join(shuffled(every), met & allowed(F.col("n"), F.col("m"), F.col("x"), F.col("y"), similarity))
    return pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def shingle_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of the documents in ``nodes``, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in rows(batches):
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield node, shingle_hashes(text, shingle).view(np.int64)

    texts = docs.select(docs["doc_id"].cast("long").alias("node"), docs["text"].cast("string").alias("text"))
    return materialise(map_rows(texts.join(small(nodes), "node", "left_semi"), run, _SET_DDL, _SET, size=256))


def _beside(pairs: DataFrame, side: str, values: DataFrame, salts: int = 64) -> DataFrame:
    """``pairs`` with the columns of ``values`` for the node in ``side``. A node in many pairs is dealt over ``salts`` groups."""
    dealt = pairs.withColumn("__salt", F.pmod(F.xxhash64("v" if side == "u" else "u"), F.lit(salts)))
    held = dealt.select(side, "__salt").distinct().join(shuffled(values.withColumnRenamed("node", side)), side)
    return dealt.join(shuffled(held), [side, "__salt"]).drop("__salt")


def allowed(n: Column, m: Column, x: Column, y: Column, similarity: float) -> Column:
    """Whether sets of n and m shingles with the parities x and y may have a Jaccard similarity of ``similarity``: such sets differ in (1 - s) / (1 + s) (n + m) shingles at most."""
    apart = reduce(lambda a, b: a + b, (F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(SEGMENTS // 64)))
    most = F.lit((1 - similarity) / (1 + similarity) + 1e-9) * (n + m)
    return (F.least(n, m) >= F.lit(similarity - 1e-9) * F.greatest(n, m)) & (apart <= most)


def likely_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` that two bounds allow: by the sizes of the sets, and by the Manhattan distance of their segments. No near pair is lost."""
    of = lambda n, odd: sets.select("node", F.col("size").alias(n), F.col("odd").alias(odd))
    both = _beside(_beside(pairs, "v", of("__m", "__b")), "u", of("__n", "__a"))
    return both.where(allowed(F.col("__n"), F.col("__m"), F.col("__a"), F.col("__b"), similarity)).select(*pairs.columns)


def similar_pairs(pairs: DataFrame, sets: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` whose sets of shingles have a Jaccard similarity of ``similarity`` or more: by the bounds first, then exactly."""
    pairs = materialise(likely_pairs(pairs, sets, similarity))
    return exact_pairs(pairs, sets_of_pairs(pairs, docs, shingle), similarity)


def sets_of_pairs(pairs: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of both ends of ``pairs``, which are written."""
    nodes = materialise(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    return shingle_sets(docs, nodes, shingle)


def exact_pairs(pairs: DataFrame, hashes: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` whose ``hashes`` have a Jaccard similarity of ``similarity`` or more."""
    of = lambda name: hashes.withColumnRenamed("hashes", name)
    common = F.size(F.array_intersect("a", "b"))
    near = _beside(_beside(pairs, "v", of("b")), "u", of("a")).select("u", "v", common.alias("common"), (F.size("a") + F.size("b")).alias("both"))
    return near.where(F.col("common") >= F.lit(similarity) * (F.col("both") - F.col("common"))).select("u", "v").distinct()


def rare_visits(nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(key, node): the rarest shingles of each document of ``nodes``, so many that any two documents that are near share one.

    A set of n shingles that is near another shares at least ``similarity`` n of them, so one at least is among its first
    n - similarity n + 1 in any order that all sets have in common. Here the order is by how many of ``nodes`` hold a shingle;
    those that one document holds only take their places but make no visit.
    """
    sets = shingle_sets(docs, nodes, shingle).dropDuplicates(["node", "hashes"])
    each = sets.select("node", F.size("hashes").alias("size"), F.explode("hashes").alias("key"))
    held = salted(each, each.groupBy("key").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1"), "key", "node")
    listed = held.groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("holders", "key"))).alias("x"))
    places = F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - 1e-9) + 1 - (F.col("size") - F.size("x"))
    return listed.where(places > 0).select("node", F.explode(F.slice("x", F.lit(1), places.cast("int"))).alias("x")).select("x.key", "node").distinct()


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, crowd: int = 64, key_bits: int = 64) -> DataFrame:
    """(node, root) of each document that is near another: root is the smallest doc_id of its group.

    Documents are near if their sets of shingles have a Jaccard similarity of ``similarity`` or more. Equal sets are joined first, by
    a digest, and one document of each goes on. Candidates, which pass the bound of the Manhattan distance of segments and are then compared exactly, are SimHash fingerprints within 2 bits, by the grid of segment
    counts, and documents that share a band of least values with the smallest that has it, where a pair at 0.8 shares one with
    probability 0.998, a pair at 0.85 with 0.9999: first each with the one it shares most with, and then all that share a band or are linked
    and aren't in one group yet. In a band with more than ``crowd`` documents outside its main group the last are compared by their rarest
    shingles instead, which loses no pair and makes none of documents that merely share a template.
    """
    found = materialise(sketches(docs, shingle, key_bits))
    firsts = [F.first(c).alias(c) for c in ("fp", "size", "odd", "keys")]
    sets = materialise(found.groupBy("whole").agg(F.min("node").alias("node"), *firsts, F.count(F.lit(1)).alias("n")))
    equal = salted(found, sets.where("n > 1").select("whole", F.col("node").alias("rep")), "whole", "node").where("rep < node").select("node", "rep")
    linked = links(sets.groupBy("fp").agg(F.min("node").alias("node")))
    starred = stars(sets.select(F.explode(F.concat("keys", F.array("fp"))).alias("key"), "node").distinct())
    often = materialise(linked.unionByName(starred.select("u", "v")).groupBy("u", "v").agg(F.count(F.lit(1)).alias("times")))
    # Most often a document is near the one with which it shares most; pairs whose ends are in one group by then needn't be compared.
    most = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("times"), "u")) == 1
    likely = materialise(likely_pairs(often, sets, similarity).select("u", "v", most.alias("most")))
    hashes = sets_of_pairs(likely, docs, shingle)
    best = materialise(exact_pairs(likely.where("most").select("u", "v"), hashes, similarity))
    others = apart(likely.where("NOT most").select("u", "v"), best.withColumnsRenamed({"v": "node", "u": "root"}))
    near = best.unionByName(materialise(exact_pairs(materialise(others), hashes, similarity)))
    roots = materialise(components(near))
    placed = lambda some: materialise(some.join(shuffled(roots), "node", "left").select("key", F.coalesce("root", "node").alias("root"), "node"))
    shared = placed(starred.select("key", F.explode(F.array("u", "v")).alias("node")).distinct())
    mixed = materialise(mixed_keys(shared))
    rest = minor_pairs(shared, mixed.where(F.col("minor") <= crowd), sets, similarity)
    crowded = mixed.where(F.col("minor") > crowd).select("key")
    if not crowded.isEmpty():
        members = materialise(salted(shared, crowded, "key", "node").select("node").distinct())
        visits = placed(rare_visits(members, docs, shingle, similarity))
        rest = rest.unionByName(minor_pairs(visits, materialise(mixed_keys(visits)), sets, similarity)).distinct()
    rest = materialise(rest)
    found_last = exact_pairs(rest, sets_of_pairs(rest, docs, shingle), similarity)
    every = components(roots.select(F.col("root").alias("u"), F.col("node").alias("v")).unionByName(found_last))
    below = equal.join(shuffled(every.withColumnRenamed("node", "rep")), "rep", "left").select("node", F.coalesce("root", "rep").alias("root"))
    return every.unionByName(below)


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose ends aren't in one group."""
    of = lambda end, root: shuffled(roots.withColumnsRenamed({"node": end, "root": root}))
    named = pairs.join(of("u", "r"), "u", "left").join(of("v", "q"), "v", "left")
    return named.where("coalesce(r, u) != coalesce(q, v)").select("u", "v")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with the smallest doc_id of each of the ``similar_groups``, in the columns of ``docs``.

    Rows without a doc_id and texts without a word stay. Rows that share a doc_id stay or go together. Very long texts are
    read in slices. An empty table stays empty. Columns may have any names.
    """
    (of_id,) = free_names(docs, "__gone")
    gone = materialise(similar_groups(docs, shingle, similarity).select(F.col("node").alias(of_id)).distinct())
    return docs.join(small(gone), docs["doc_id"] == F.col(of_id), "left_anti")


def op8_segment_popcount_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, fingerprint, component_id; see ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"))
