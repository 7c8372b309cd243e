"""Operators 1, 3, 5, 7, 8, 9 and 10 against brute force on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import common, decontamination, exact_dedup, importance, licences, packing, simhash, token_scan, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LINE = "one two three four five six seven eight nine ten eleven twelve"


def docs_of(spark, texts, start=0):
    """Documents with extra columns whose names the operators use themselves."""
    rows = [(start + i, t, "en", "s", 0) for i, t in enumerate(texts)]
    clash = {"digest": F.lit(1), "fp": F.lit("x"), "node": F.lit(2), "row": F.lit(3), "kept": F.lit(False), "shard": F.lit(0), "good": F.lit(1), "__extra": F.lit(1)}
    return spark.createDataFrame(rows, DOCS).withColumns(clash)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i} y" for i in range(20_000))
    texts = [None, "", " \t\n", "a b", "A  b", "a\u00a0b", LINE, LINE, long, "x" * 5000, "Ünïcode <|endoftext|> 'll don't 42 c'est\x1cmot…", "été naïve", "Don't!!", "end.", "END?"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(6, LINE), (None, LINE), (None, "only here")]
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# Packing


def truth(text):
    return [*Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids, 2]


def test_pieces_hold_every_id_once(spark, odd):
    pieces = packing.pack(odd.repartition(3), TOKENIZER, max_open=4).collect()
    by_doc = {}
    for r in odd.collect():
        by_doc.setdefault(r["doc_id"], []).append(truth(r["text"]))
    for doc_id in (i for i in by_doc if len(by_doc[i]) == 1):
        mine = sorted((p for p in pieces if p["doc_id"] == doc_id), key=lambda p: p["start"])
        ids = np.frombuffer(b"".join(bytes(p["ids"]) for p in mine), "<u4").tolist()
        assert ids == by_doc[doc_id][0]
        at = 0
        for p in mine:
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
    assert sum(p["length"] for p in pieces) == sum(len(t) for ts in by_doc.values() for t in ts)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == 4096 or at & (at - 1) == 0 and at < 4096


def test_level_choice_minimises_the_sum_of_squares():
    rng = np.random.default_rng(1)
    packer, counts = packing.LevelPacker(16), np.zeros(17, int)
    for s in rng.integers(1, 16, 400):
        options = {}
        for h in range(17 - s):
            if h == 0 or counts[h]:
                after = counts.copy()
                if h:
                    after[h] -= 1
                if h + s < 16:
                    after[h + s] += 1
                options[h] = int((after[:16] ** 2).sum())
        level = packer._best(int(s))
        assert options[level] == min(options.values())
        list(packer.add(packing.Piece(0, 0, bytes(4 * int(s)), int(s))))
        if level:
            counts[level] -= 1
        if level + s < 16:
            counts[level + s] += 1


def test_windows_of_documents_that_fit_nowhere():
    """Documents longer than half a window each open one; the bound holds, every id comes out once, and only powers of two are short."""
    packer, out = packing.LevelPacker(64, max_open=10), []
    for i in range(500):
        out += packer.add(packing.Piece(i, 0, memoryview(bytes(4 * (33 + i % 5))), 0))
        assert packer.n_open <= 10 and packer.n_open == sum(map(len, packer.open.values()))
    out += packer.finish()
    sizes = [sum(map(len, w)) for w in out]
    assert sum(sizes) == sum(33 + i % 5 for i in range(500)) and all(n == 64 or n & (n - 1) == 0 for n in sizes) and len([n for n in sizes if n < 64]) <= 6


def test_very_long_documents_are_cut_in_linear_time():
    import time

    def seconds(n):
        start = time.perf_counter()
        list(packing.LevelPacker(4096).add(packing.Piece(0, 0, memoryview(bytes(4 * n)), n)))
        return time.perf_counter() - start

    seconds(1 << 20)
    assert seconds(1 << 25) < 1.0


def test_pieces_without_ids_are_the_same(odd):
    docs = odd.coalesce(1)
    whole, bare = packing.pack(docs, TOKENIZER), packing.pack(docs, TOKENIZER, with_ids=False)
    assert bare.columns == whole.columns[:-1]
    assert bare.collect() == whole.drop("ids").collect()


@pytest.mark.parametrize("most", [0, 6, 150_000])
def test_ids_do_not_depend_on_what_is_remembered(most):
    """Chunks that are forgotten, taken over from the old ones or too long to be kept give the ids of the whole tokenizer."""
    texts = ["one two three One, two.", "three four five six seven", "two Two, " + "z" * 70, "eight nine one two. " + "Z" * 70 + ".", "été naïve one, 42 don't", "", "two. été one"]
    encode = tokens.ChunkEncoder(TOKENIZER, most=most)
    for text in texts * 3:
        assert np.frombuffer(encode.encode(text), "<u4").tolist() == truth(text)[:-1]
        assert len(encode.known) <= most // 2 + 20 and not any(len(c) > 64 for c in encode.known)


def test_packing_of_nothing(empty):
    assert packing.pack(empty, TOKENIZER).count() == 0
    assert packing.pack(empty, TOKENIZER, with_ids=False).count() == 0


# Exact dedup


def normal(text):
    return re.sub("[ \t-\r]+", " ", text or "")


def test_exact_groups(odd):
    rows = odd.collect()
    groups = {}
    for r in rows:
        groups.setdefault(normal(r["text"]), []).append(r["doc_id"])
    want = sorted(((r["doc_id"], min((i for i in g if i is not None), default=None), len(g)) for r in rows for g in [groups[normal(r["text"])]]), key=repr)
    got = exact_dedup.exact_dedup(odd)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got.collect()), key=repr) == want
    assert {r["text_sha256"] for r in got.collect()} == {hashlib.sha256(t.encode()).hexdigest() for t in groups}


def test_history_wins_and_is_not_returned(spark):
    history, new = docs_of(spark, ["a b", "c"], 100), docs_of(spark, ["a  b", "d", "d"])
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["known"]) for r in exact_dedup.exact_dedup(new, history.withColumn("doc_id", F.col("doc_id") - 200)).collect()}
    assert got == {0: (-100, 2, False, True), 1: (1, 2, True, False), 2: (1, 2, False, False)}


def test_one_row_of_each_group_stays(odd):
    kept = exact_dedup.drop_repeats(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"], normal(r["text"])) for r in kept.where("doc_id is not null").collect()) == sorted({(False, min(i for i in ids if i is not None), t) for t, ids in grouped(odd).items() if any(i is not None for i in ids)})
    assert kept.where("doc_id is null").count() == 1


def grouped(docs):
    out = {}
    for r in docs.collect():
        out.setdefault(normal(r["text"]), []).append(r["doc_id"])
    return out


def test_perfect_hash_is_one_to_one():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 256, (5000, 32), dtype=np.uint8)
    keys[:100, 8:24] &= 1  # poor words still part
    keys = np.unique(keys, axis=0)
    sizes, flat, slot = exact_dedup.build_levels(keys)
    assert sorted(slot) == list(range(len(keys)))
    assert (exact_dedup.look_up(keys, sizes, flat) == slot).all()


def test_exact_dedup_of_nothing(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


# SimHash


def brute_fingerprint(text, k=3):
    words = [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(odd):
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64)) for r in simhash.fingerprints(odd).collect()), key=repr) == sorted(((r["doc_id"], brute_fingerprint(r["text"])) for r in odd.collect()), key=repr)
    long = " ".join(f"w{i}" for i in range(5000))
    assert simhash.fingerprint(long, size=700) == brute_fingerprint(long)
    assert simhash.fingerprint(long, 5, size=9) == brute_fingerprint(long, 5)


def brute_components(fps):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_components_lose_no_link(spark):
    rng = np.random.default_rng(2)
    fps = {}
    for chain in range(6):
        x = int(rng.integers(0, 1 << 63)) * 2 + chain % 2
        for step in range(12):
            fps[len(fps)] = x
            for _ in range(int(rng.integers(0, 4))):
                x ^= 1 << int(rng.integers(0, 64))
    order = rng.permutation(len(fps)).tolist()
    fps = {order[i]: x for i, x in fps.items()}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    distinct = {}
    for i in sorted(fps):
        distinct.setdefault(fps[i], i)
    nodes = spark.createDataFrame([(i, signed(x)) for x, i in distinct.items()], "node long, fp long")
    links = simhash.links(nodes)
    for r in links.collect():
        assert bin(fps[r["u"]] ^ fps[r["v"]]).count("1") <= 2
    got = {i: i for i in distinct.values()} | {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert got == brute_components({i: x for x, i in distinct.items()})


def test_long_chains_meet(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "u long, v long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_near_duplicates_of_odd_rows(odd):
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()}
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in odd.where("doc_id is not null").collect()}
    roots = brute_components(fps)
    assert {(i, f"{fps[i]:016x}", roots[i]) for i in fps} == {g for g in got if g[0] is not None}
    assert (None, f"{brute_fingerprint('only here'):016x}", None) in got
    assert (None, f"{fps[6]:016x}", 6) in got


def edited_texts(rng):
    """Texts with copies in which more and more words are changed."""
    vocabulary, texts = [f"w{i}" for i in range(4000)], []
    for _ in range(60):
        words = list(rng.choice(vocabulary, int(rng.integers(3, 400))))
        texts.append(" ".join(words))
        for edits in (1, 2, 4, 8, 16):
            changed = list(words)
            for at in rng.integers(0, len(words), max(1, len(words) * edits // 400)):
                changed[at] = str(rng.choice(vocabulary))
            texts.append(" ".join(changed))
    return texts


# With 3 bits strangers share a key as well; keys with more than ``crowd`` others are compared by their rarest shingles.
@pytest.mark.parametrize("key_bits, crowd", [(64, 64), (3, 1000), (3, 64), (64, 1)])
def test_similar_documents(spark, key_bits, crowd):
    texts = edited_texts(np.random.default_rng(9))
    root, alike = jaccard_groups(texts)
    docs = docs_of(spark, texts)
    groups = {r["node"]: r["root"] for r in simhash.similar_groups(docs, crowd=crowd, key_bits=key_bits).collect()}
    assert {i: groups.get(i, i) for i in range(len(texts))} == dict(enumerate(root))
    if key_bits == 64 == crowd:
        pairs, sets = spark.createDataFrame(list(alike), "u long, v long"), simhash.materialise(simhash.sketches(docs, 5))
        near, likely = {p for p, s in alike.items() if s >= 0.8}, simhash.likely_pairs(pairs, sets, 0.8).count()
        assert {tuple(r) for r in simhash.similar_pairs(pairs, sets, docs, 5, 0.8).collect()} == near
        assert len(near) <= likely <= 1.2 * len(near) < len(alike)
        assert {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()} == {i for i, r in enumerate(root) if i == r}


def test_bands_find_pairs_at_the_bound():
    """Of pairs at 0.80 to 0.82 all but a few in a hundred share a band; hardly any at 0.2 do."""
    rng, found = np.random.default_rng(12), {0.2: 0, 0.81: 0}
    for similarity in found:
        for _ in range(400):
            both = int(1000 * similarity)
            x = rng.integers(0, 1 << 64, 1000, dtype=np.uint64)
            own = (1000 - both) // 2
            a, b = np.sort(x[: both + own]), np.sort(np.append(x[:both], x[both + own :]))
            found[similarity] += bool((simhash.band_keys(a) == simhash.band_keys(b)).any())
    assert found[0.81] >= 392 and found[0.2] <= 4


def jaccard_groups(texts, least=0.8):
    """Brute force: the smallest index of each group linked by a similarity of ``least``, and the similarities."""
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) or {t} for t in texts]
    alike = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a & b}
    root = list(range(len(texts)))
    for (i, j), s in sorted(alike.items()):
        if s >= least:
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = [new if r == old else r for r in root]
    return root, alike


def test_documents_of_one_template(spark):
    """Pairs at 0.6 to 0.75 are not near, and the near pairs among them are found."""
    rng = np.random.default_rng(5)
    template, texts = [f"t{i}" for i in range(400)], []
    for k in range(120):
        own = [f"d{k}x{i}" for i in range(100)]
        texts.append(" ".join(template + own))
        if k % 4 == 0:
            changed = list(own)
            changed[int(rng.integers(10, 90))] = "other"
            texts.append(" ".join(template + changed))
    root, alike = jaccard_groups(texts)
    assert sum(0.6 <= s <= 0.75 for s in alike.values()) > 5000 and sum(s >= 0.8 for s in alike.values()) == 30
    docs = docs_of(spark, texts)
    assert {r["node"]: r["root"] for r in simhash.similar_groups(docs).collect()} == {i: r for i, r in enumerate(root) if i != r}


def test_every_pair_of_a_key_is_compared(spark):
    """Pairs whose key has a third document as its smallest, and none within a root."""
    rows = [(7, i, i) for i in range(6)] + [(7, 1, 9), (7, 1, 8), (8, 3, 3), (8, 3, 10), (9, 4, 4)]
    visits = spark.createDataFrame(rows, "key long, root long, node long")
    seven = [(r, n) for k, r, n in rows if k == 7]
    odd = np.zeros(simhash.SEGMENTS // 64, np.int64).tolist()
    sets = spark.createDataFrame([(n, 50, odd) for n in {n for _, _, n in rows}], "node long, size long, odd array<long>")
    want = {(min(a, b), max(a, b)) for r, a in seven for q, b in seven if r != q}
    for block in (1, 2, 4096):
        mixed = simhash.mixed_keys(visits, block)
        assert [(r["key"], r["main"], r["minor"]) for r in mixed.collect()] == [(7, 1, 5)]
        pairs = [tuple(r) for r in simhash.minor_pairs(visits, mixed, sets, 0.8).collect()]
        assert len(pairs) == len(want) and set(pairs) == want


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_stars_over_partitions(spark, parts):
    """One key that fills most partitions, and many small ones: all nodes of a key hang together, and pairs are few."""
    rows = [(7, i) for i in range(500)] + [(100 + i // 3, i) for i in range(60)] + [(1000, 4)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    pairs = [tuple(r) for r in simhash.stars(spark.createDataFrame(rows, "key long, node long")).collect()]
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert all(u < v for _, u, v in pairs) and len(pairs) == len(set(pairs)) <= len(rows)
    for key in {k for k, _ in rows}:
        mine = {n for k, n in rows if k == key}
        roots = brute_roots(mine, [(u, v) for k, u, v in pairs if k == key])
        assert set(roots.values()) == {min(mine)}


def brute_roots(nodes, edges):
    root = {n: n for n in nodes}
    for _ in nodes:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    return root


def test_segments_bound_the_difference_from_below():
    rng = np.random.default_rng(15)
    for n in (5, 50, 500, 5000):
        x = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        a, b = x[: 4 * n // 5], x[n // 5 :]
        bits = np.unpackbits((simhash.odd_segments(a) ^ simhash.odd_segments(b)).view(np.uint8)).sum()
        assert bits <= 2 * (n // 5) and (n > 500 or bits >= 0.7 * 2 * (n // 5))


def test_hashes_do_not_depend_on_slices():
    text = " ".join(f"w{i % 700}" for i in range(3000))
    hashes = simhash.shingle_hashes(text, 5)
    assert (simhash.shingle_hashes(text, 5, size=50) == hashes).all()
    assert (simhash.band_keys(hashes, block=100) == simhash.band_keys(hashes)).all()
    ones = [b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes.tolist()) > len(hashes)]
    assert simhash.set_fingerprint(hashes) % (1 << 64) == sum(1 << b for b in ones)


def test_similar_documents_of_odd_rows(odd, empty):
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # A no-break space is no white space here, so text 5 is a word of its own.
    assert {0, 1, 2, 3, 5, 6, 8, 9} <= set(ids) and not {4, 7} & set(ids) and ids.count(None) == 2 and ids.count(6) == 2
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_names_of_components_may_be_large(spark):
    docs = spark.createDataFrame([((1 << 63) - 1, "a b c d"), (1 << 62, "e f g h"), (None, "x y z"), (-5, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {((1 << 63) - 1, (1 << 63) - 1), (1 << 62, 1 << 62), (None, None), (-5, -5)}


def test_near_duplicates_of_nothing(empty):
    assert simhash.near_duplicates(empty).count() == 0


# Decontamination


def brute_hits(text, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words_of = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = words_of(text), set(), set()
    for item_id, item in items:
        iw = words_of(item)
        for i in range(max(1, len(iw) - window + 1) if iw else 0):
            w = iw[i : i + window]
            for j in range(len(words) - len(w) + 1):
                if words[j : j + len(w)] == w:
                    hit |= set(range(j, j + len(w)))
                    found.add(item_id)
    return len(words), len(hit), sorted(x for x in found if x is not None)


@pytest.mark.parametrize("most_chars", [16_000_000, 200])
def test_hits(spark, odd, most_chars):
    items = [("1", LINE), ("2", "Four, FIVE six!"), ("10", "seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"), ("3", None), ("4", "..."), (None, "a b"), ("2", "four five six")]
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(docs_of(spark, ["Intro: " + LINE + " thirteen. " + LINE, "seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"], 50).select(odd.columns))
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontamination.contamination(docs, benchmark, most_chars=most_chars).collect()}
    assert got == {r["doc_id"]: brute_hits(r["text"], items) for r in docs.collect()}
    dirty = {i for i, x in got.items() if x[1]}
    kept = decontamination.drop_contaminated(docs, benchmark, most_chars=most_chars)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(got) - dirty


def test_more_words_than_characters():
    """With an alphabet of 8 symbols, words take two; hits and items are the same."""
    rng, vocabulary = np.random.default_rng(14), [f"w{i}" for i in range(15)]
    for _ in range(200):
        items = [(str(i), " ".join(rng.choice(vocabulary, int(rng.integers(1, 7))))) for i in range(4)]
        text = " ".join(rng.choice(vocabulary, 60))
        small, large = (decontamination.Automaton(items, 3, symbols) for symbols in (8, 1000))
        assert large.width == 1 and small.scan(text) == large.scan(text) and small.scan("") == (0, [], set())
        n, runs, ids = small.scan(text)
        assert (n, sum(b - a for a, b in runs), sorted(ids)) == brute_hits(text, items, 3)
    assert small.width == 2


def test_patterns_of_all_lengths_at_all_places(monkeypatch):
    """Runs are looked up at some places only, and texts come in slices; no hit is lost or added, whatever the lengths of items."""
    rng, taken = np.random.default_rng(5), 0
    for size in [4, 30, 1 << 22] * 100:
        vocabulary = [f"w{i}" for i in range(int(rng.integers(2, 30)))]
        items = [(str(i), " ".join(rng.choice(vocabulary, int(rng.integers(0, 15))))) for i in range(int(rng.integers(0, 5)))] + [(None, None), ("9", "..."), (None, "w0 w1 w0")]
        words = [*rng.choice(vocabulary, int(rng.integers(0, 40))), "else"]
        at = int(rng.integers(0, len(words)))
        text = " ".join([*words[:at], items[0][1] or "", *words[at:]])
        monkeypatch.setattr(decontamination, "slices", lambda t, size=size: common.slices(t, size))
        for window in (1, 4, 10):
            machine = decontamination.Automaton([*items, *items], window)
            n, runs, ids = machine.scan(text)
            assert (n, sum(b - a for a, b in runs), sorted(ids)) == brute_hits(text, items, window)
            assert all(b < a for (_, b), (a, _) in zip(runs, runs[1:])) and machine.scan(None) == machine.scan("") == (0, [], set())
            taken += bool(runs)
    assert taken > 300


def test_automaton_scans_around_runs_of_items_only():
    """Words that items have, too, but in another order, aren't scanned; around a hit a few words are."""
    line = [f"w{i}" for i in range(40)]
    made, steps = decontamination.Automaton([("1", " ".join(line)), ("2", "other words")], 10), []
    machine = made.machine
    made.machine = type("Counted", (), {"iter": lambda self, line: steps.append(len(line)) or machine.iter(line)})()
    mixed = " ".join(np.random.default_rng(6).permutation(line * 50))
    assert made.scan(f"{mixed} else {mixed}") == (4001, [], set())
    assert sum(steps) < 200
    steps.clear()
    assert made.scan(" ".join(["else"] * 1000 + line[7:17] + ["else"] * 1000)) == (2010, [(1000, 1010)], {"1"})
    assert 10 <= sum(steps) <= 40


def test_hits_map_to_characters():
    text = "Ünder: One, two -- THREE."
    assert [text[a:b] for a, b in decontamination.hit_characters(text, [(1, 3)])] == ["One, two"]


def test_no_benchmark(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(odd, none).where("contaminated").count() == 0
    assert decontamination.contamination(empty, none).count() == 0


# Importance resampling


@pytest.fixture(scope="module")
def quality(spark):
    rng = np.random.default_rng(3)
    words = ["the", "and", "of", "ring", "stone", "water", "lamp", "river", "under", "light"]
    good = [" ".join(rng.choice(words, 60)) for _ in range(80)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choice(words, 60)) for _ in range(20)] + [" ".join([w] * 60) for w in words]
    docs = docs_of(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(0, 110, 2)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels, len(good)


def test_sample_keeps_clean_documents(quality):
    docs, labels, n = quality
    got = importance.resample(docs, labels).collect()
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert len(got) == 110 and len(kept & set(range(n))) >= 0.95 * n and len(kept - set(range(n))) <= 2
    assert importance.drop_rejected(docs, labels).columns == docs.columns


def test_clean_documents_with_unseen_words_stay(spark):
    """Good documents without a label, with an address or number that no labelled document has."""
    rng = np.random.default_rng(6)
    words = ["the", "and", "of", "ring", "stone", "water", "lamp", "river", "under", "light"]
    seen = [" ".join(rng.choice(words, 60)) for _ in range(1200)]
    own = [" ".join([*rng.choice(words, 30), f"{rng.integers(1 << 60):x}@q{k}.example", str(rng.integers(1 << 60)), *rng.choice(words, 30)]) for k in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choice(words, 60)) for _ in range(10)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1200)] + [(i, 1, 0) for i in range(1200, 1260, 3)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in importance.resample(docs_of(spark, seen + own + bad), labels).where("kept").collect()}
    assert kept == set(range(1260))


@pytest.mark.parametrize("text", [None, "", "a", "one two one two two two", "über " * 50, "x" * 900, "a b c d " * 60 + "z" * 300 + " a a a a a b"])
def test_slices_change_no_feature(text):
    whole = np.concatenate(list(importance.features(text)))
    for size in (1000, 97, 40):
        parts = np.concatenate(list(importance.features(text, size)))
        if "z" * 90 not in (text or "") and "x" * 90 not in (text or "") or size > 400:
            assert sorted(parts) == sorted(whole)
        assert sorted(parts[parts < importance.BUCKETS]) == sorted(whole[whole < importance.BUCKETS])


def test_shares_of_a_sample_match_the_weights(spark):
    """Of five documents, drawn one at a time, each wins as often as its weight says."""
    weights = np.array([0.05, 0.1, 0.15, 0.3, 0.4])
    one = spark.range(20_000).select(F.col("id").alias("draw"), F.posexplode(F.array(*[F.lit(float(np.log(w))) for w in weights])).alias("which", "log_weight"))
    keyed = importance.with_gumbel_key(one.withColumn("doc_id", F.col("draw") * 5 + F.col("which")))
    won = dict(keyed.groupBy("draw").agg(F.max_by("which", "sample_key").alias("w")).groupBy("w").count().collect())
    assert all(abs(won[i] / 20_000 - w) < 4 * np.sqrt(w * (1 - w) / 20_000) for i, w in enumerate(weights))


def test_the_sample_is_no_threshold(spark):
    """Graded weights: heavier documents are kept more often, but no bound on the weight gives the sample."""
    keyed = importance.with_gumbel_key(spark.range(5000).select(F.col("id").alias("doc_id"), (-F.col("id") / 1000).alias("log_weight")))
    kept = np.zeros(5000, bool)
    kept[[r["doc_id"] for r in importance.top_k(keyed, 2000).where("kept").collect()]] = True
    shares = kept.reshape(5, 1000).mean(axis=1)
    assert (np.diff(shares) < 0).all() and 0.05 < shares[4] and shares[0] < 0.95


def test_the_query_draws_by_chance_among_good_documents(spark):
    """Of the registered query: the sample lies within what is kept, differs from the heaviest as many by a tenth at least, and leans to the heavier half."""
    got = importance.op3_importance_resampling(spark, "/root/testdata/sf0.01").where("kept").toPandas().sort_values("log_weight", ascending=False)
    k, sampled = round(len(got) * 0.5), got["sampled"].to_numpy()
    assert sampled.sum() == k == sampled[np.argsort(-got["sample_key"].to_numpy(), kind="stable")[:k]].sum()
    assert 0.1 * k < k - sampled[:k].sum() < 0.5 * k


def brute_ratio(texts, good):
    """Mean log ratio of each text by the counts of all texts and of the good ones, one n-gram at a time."""
    grams = [np.concatenate(list(importance.features(t))).tolist() for t in texts]
    def ratio(gram, fit, raw):
        same = lambda g: (g < importance.BUCKETS) == (gram < importance.BUCKETS)
        expected = raw.count(gram) / sum(map(same, raw)) * sum(map(same, fit))
        return np.log((fit.count(gram) + 5) / (expected + 5))

    raw = sum(grams, [])
    return [sum(ratio(g, sum((grams[j] for j in good(i)), []), raw) for g in x) / (len(x) + 50) for i, x in enumerate(grams)]


def test_weights_by_brute_force(spark):
    texts = ["the ring of the river", "water under the light", "THE!! RING!! OF", "a a a a a a a", "the lamp and the stone", ""]
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (4, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    folds = {r["doc_id"]: r["fold"] for r in importance.with_fold(docs_of(spark, texts), importance.target_ids(labels, 10)).collect()}
    want = brute_ratio(texts, lambda i: [j for j in (0, 1, 4) if i not in (0, 1, 4) or folds[j] != folds[i]])
    got = {r["doc_id"]: r["log_weight"] for r in importance.resample(docs_of(spark, texts), labels, sharpness=1.0, allowance=0.0).collect()}
    assert [got[i] for i in range(6)] == pytest.approx(want)


def test_rows_of_one_id_are_judged_by_their_text(quality):
    docs, labels, n = quality
    twice = docs.withColumn("doc_id", F.when(F.col("doc_id") >= n, 2 * (F.col("doc_id") - n) + 1).otherwise(F.col("doc_id")))  # ids without a label
    kept = importance.drop_rejected(twice, labels)
    assert kept.columns == docs.columns and 0.95 * n <= kept.count() <= n + 2


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(4)
    keys = np.round(rng.standard_normal(3000) * 2, 2).tolist()
    keyed = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "doc_id long, sample_key double")
    for k in (0, 1, 777, 2999, 3000, 5000):
        want = {i for i, _ in sorted(enumerate(keys), key=lambda x: (-x[1], x[0]))[:k]}
        assert {r["doc_id"] for r in importance.top_k(keyed, k, bins=7).where("kept").collect()} == want


def test_sample_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert importance.resample(odd, labels).where("kept").count() == odd.count()
    assert importance.resample(empty, labels).count() == 0
    assert importance.draw(importance.resample(odd, labels)).where("sampled AND kept").count() == odd.count() // 2
    assert importance.draw(importance.resample(empty, labels)).count() == 0


# Licences


def test_licences(spark, odd):
    bsd = "Copyright. Redistribution and use in source and binary forms, with or without\n modification, are permitted provided that the following conditions are met:\n"
    lines = dict(licences.SENTENCES)
    full = f"{lines['BSDGrant']}:\n{lines['BSDSource']}.\n{lines['BSDBinary']}.\n"
    docs = docs_of(spark, ["x. Released under the MIT License. Y", full, full + lines["BSDEndorse"] + ".", bsd, "Licensed under CC BY-NC 4.0.\nAll  rights reserved!", None, "mit license", "Some title\nReleased under the MIT License\nby someone"])
    got = [r["licences"] for r in licences.recognise(docs).orderBy("doc_id").collect()]
    assert got == [["MIT"], ["BSD-2-Clause"], ["BSD-3-Clause"], ["UNKNOWN"], ["CC-BY-NC-4.0", "Proprietary"], [], [], ["MIT"]]
    assert licences.recognise(odd).where(F.size("licences") > 0).count() == 0
    alone = docs_of(spark, [lines["BSDSource"] + "."])
    assert licences.recognise(alone).first()["licences"] == ["UNKNOWN"]


# Notices and titles as they stand in files, wrapped; the long ones are wrapped at several widths and behind comment marks.
WRAPPED = {
    "MIT": ["MITGrant", "MITNotice", "MITDisclaimer", "MITLiability"],
    "BSD-2-Clause": ["BSDGrant", "BSDSource", "BSDBinary", "BSDDisclaimer", "BSDLiability"],
    "BSD-3-Clause": ["BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse", "BSDDisclaimer", "BSDLiability"],
    "ISC": ["ISCGrant", "ISCDisclaimer"],
    "0BSD": ["ZeroBSDGrant", "ISCDisclaimer"],
    "Zlib": ["ZlibAsIs", "ZlibGrant"],
}
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License."""
GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU {1}General Public License as published by
the Free Software Foundation{2} either version {3} of the License, or
(at your option) any later version."""
NOTICES = {
    "Apache-2.0": [APACHE, "\n                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS"],
    "GPL-2.0-or-later": [GPL.format(";", "", ";", "2")],
    "GPL-3.0-or-later": [GPL.format(":", "", ",", "3")],
    "LGPL-2.1-or-later": [GPL.format(";", "Lesser ", ";", "2.1")],
    "LGPL-3.0-or-later": [GPL.format(":", "Lesser ", ",", "3")],
    "AGPL-3.0-or-later": [GPL.format(":", "Affero ", ",", "3")],
    "GPL-3.0-only": ["                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright"],
    "GPL-2.0-only": ["                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright"],
    "MPL-2.0": ["Mozilla Public License Version 2.0\n==================================\n\n1. Definitions", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"],
}


def test_wrapped_licences(spark):
    import textwrap

    forms, texts = dict(licences.SENTENCES), []
    for licence, ids in WRAPPED.items():
        for width, mark in ((80, ""), (72, " * "), (60, "# "), (40, "// ")):
            blocks = [textwrap.wrap(("1. " if i in ("BSDSource", "BSDBinary") else "") + forms[i] + ".", width) for i in ids]
            lines = ["Copyright (c) 2020 Some One", "", *(x for b in blocks for x in [*b, ""])]
            texts.append((licence, "\n".join(mark + x for x in lines)))
            texts.append((licence, "\r\n".join(mark + x for x in lines)))
    for licence, found in NOTICES.items():
        for text in found:
            texts += [(licence, text), (licence, "\n".join("# " + x for x in text.split("\n"))), (licence, "Words before.\n\n" + text + "\n\nWords after.")]
    got = [r["licences"] for r in licences.recognise(docs_of(spark, [t for _, t in texts])).orderBy("doc_id").collect()]
    assert got == [[x] for x, _ in texts]


# Licences that a sentence refers to by name.
REFERRING = [
    ("SPDX-License-Identifier: MIT", ["MIT"]),
    ("// SPDX-License-Identifier: Apache-2.0\npackage main\n", ["Apache-2.0"]),
    ("# spdx-license-identifier: (MIT OR Apache-2.0)\nimport os", ["Apache-2.0", "MIT"]),
    ("/* SPDX-License-Identifier: GPL-2.0-or-later */", ["GPL-2.0-or-later"]),
    ("/* SPDX-License-Identifier: GPL-2.0 */\n#include <x.h>", ["GPL-2.0-only"]),
    ("This project is licensed under the MIT License - see the LICENSE file for details.", ["MIT"]),
    ("Our tool is licensed under\nthe Apache License, Version 2.0, and so is the other.", ["Apache-2.0"]),
    ("It is released under the terms of the GNU General Public License version 3 or later; enjoy.", ["GPL-3.0-or-later"]),
    ("The data are available under a CC BY-SA 4.0 licence and the code is distributed under the BSD 3-Clause License", ["BSD-3-Clause", "CC-BY-SA-4.0"]),
    ("Dual licensed under the MIT license or the Apache License 2.0.", ["Apache-2.0", "MIT"]),
    ("Released under the Mitre plan", []),
    ("MIT is a university, licensed under nothing", []),
    ("SPDX-License-Identifier: LicenseRef-Own", []),
]


def test_licences_by_name(spark):
    got = licences.recognise(docs_of(spark, [t for t, _ in REFERRING])).orderBy("doc_id").collect()
    assert [(t, r["licences"]) for (t, _), r in zip(REFERRING, got)] == REFERRING


def test_licence_sql_on_wrapped_texts(spark):
    import duckdb

    rows = [(i, t) for i, t in enumerate([APACHE, *(x for v in NOTICES.values() for x in v), *(t for t, _ in REFERRING), "a. b\nAll rights reserved\nc", "All rights\nreserved.", None, ""])]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(con.execute("SELECT doc_id, sentence_ids, licences FROM (" + licences.ORACLE_SQL["op5_sentence_rule_licences"] + ")").fetchall())
    found = licences.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], ",".join(r["sentence_ids"]), ",".join(r["licences"])) for r in found) == want


def test_every_sentence_is_found(spark):
    docs = docs_of(spark, [s + "." for _, s in licences.SENTENCES])
    got = [r["sentence_ids"] for r in licences.recognise(docs).orderBy("doc_id").collect()]
    assert got == [[i] for i, _ in licences.SENTENCES]


# Token counts


@pytest.mark.parametrize("block_ids", [1 << 20, 7, 1])
def test_token_counts(odd, block_ids):
    if block_ids < 100:
        odd = odd.where("text is null or length(text) < 200")
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    want = sorted(((r["doc_id"], len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect()), key=repr)
    got = token_scan.token_counts(odd.coalesce(2), TOKENIZER, 49407, block_ids)
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got.collect()), key=repr) == want


def test_token_counts_of_nothing(empty):
    assert token_scan.token_counts(empty, TOKENIZER, 49407).count() == 0


def test_leaks_are_dropped_by_text_alone(spark):
    """Whatever columns and ids there are, and in however many parts the benchmark is scanned."""
    rows = [("a3", LINE), ("a3", "clean words"), (None, LINE.upper()), (None, None), ("b", ""), ("c", "clean words")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumns({"key0": F.lit(1), "key1": F.lit(2), "text_key": F.lit(3), "__gone_id": F.lit(4)})
    benchmark = spark.createDataFrame([(1, LINE), (2, "else " * 12)], "item_id long, text string")
    for most_chars in (1_000_000, 70):
        kept = decontamination.drop_contaminated(docs, benchmark, most_chars=most_chars)
        assert kept.columns == docs.columns and sorted((r["doc_id"] or "", r["text"] or "") for r in kept.collect()) == [("", ""), ("a3", "clean words"), ("b", ""), ("c", "clean words")]


def test_helper_names_may_be_taken(quality):
    """Columns that are called like the helpers of the stages, whatever their case."""
    docs, labels, n = quality
    taken = ["__repeats_digest", "__repeats_id", "__REPEATS_ID_", "__gone", "__Gone_id", "__gone_text", "key0", "key1", "text_key"]
    clash = docs.unionByName(docs.limit(5)).withColumns({c: F.lit(i) for i, c in enumerate(taken)})
    items = clash.sparkSession.createDataFrame([(1, "no such words")], "item_id long, text string")
    stages = [lambda d: importance.drop_rejected(d, labels), exact_dedup.drop_repeats, simhash.drop_near_duplicates, lambda d: decontamination.drop_contaminated(d, items)]
    for stage in stages:
        kept = stage(clash)
        assert kept.columns == clash.columns and kept.count() >= 0.95 * n


def test_pairs_of_a_key_meet_the_bound_of_all_segments(spark):
    """Two sets that differ in many segments, but in no parity of four segments folded to one, make no row."""
    visits = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (7, 3, 3)], "key long, root long, node long")
    none, many = [0] * (simhash.SEGMENTS // 64), [(1 << 40) - 1] * (simhash.SEGMENTS // 64)
    sets = spark.createDataFrame([(1, 50, none), (2, 50, many), (3, 50, none)], "node long, size long, odd array<long>")
    assert [tuple(r) for r in simhash.minor_pairs(visits, simhash.mixed_keys(visits), sets, 0.8).collect()] == [(1, 3)]


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """What is a star around its smallest node is written once; a path takes rounds, and either end of an edge may come first."""
    written, write = [], simhash.materialise
    monkeypatch.setattr(simhash, "materialise", lambda df: written.append(1) or write(df))
    of = lambda edges: {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert of([(1, 5), (4, 1), (2, 3), (7, 7)]) == {5: 1, 4: 1, 3: 2} and len(written) == 1
    assert of([(1, 5), (4, 5), (2, 4), (1, 5)]) == {5: 1, 4: 1, 2: 1} and len(written) > 2
    assert of([]) == {}
