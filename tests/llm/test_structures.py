"""Operators 11, 12 and 13 against brute force on small tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, conversations, merkle

TURNS = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256().hexdigest()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Repair: all edits of short conversations, tried one by one


def by_all_edits(turns):
    """(cost, audit, repaired) of the cheapest edits among all."""
    seen, faults = set(), []
    for role, text in turns:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("bd" if not bare or (role, text) in seen else "" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    found = []

    def go(i, cost, audit, out, inserts):
        if cost > 2 * len(turns):  # all deleted
            return
        if i == len(turns):
            if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
                found.append((cost, audit, tuple(out)))
        else:
            role, text = turns[i]
            go(i + 1, cost + 2, audit + "D", out, 0)
            if faults[i] != "bd":
                more = 5 * (faults[i] == "t")
                go(i + 1, cost + more, audit + "K", [*out, (role, text)], 0)
                for new in ("user", "assistant"):
                    go(i + 1, cost + more + 1, audit + "R", [*out, (new, text)], 0)
        if inserts < 2:
            for new in ("user", "assistant"):
                go(i, cost + 5, audit + "I", [*out, (new, "")], inserts + 1)

    go(0, 0, "", [], 0)
    return min(found)


ROLES = ["user", "assistant", "system", "tool", "", " ", "User"]


def talk(rng, n):
    texts = ["Yes.", "No!", "Why? ", "half", " \t", "", "a b\n", "Ünï?", "x."]
    weights = [6, 6, 2, 1, 1, 1, 1]
    return [(rng.choices(ROLES, weights)[0], rng.choice(texts) if rng.random() < 0.5 else f"Word {rng.random()}{rng.choice(['.', '!', ''])}") for _ in range(n)]


def search(turns, start=0):
    held, seen = conversations.Search(start), set()
    for role, text in turns:
        bare = text.rstrip(conversations.WHITE)
        held.add(role[:1], "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return held.ends()


def test_the_search_finds_the_cheapest_edits():
    rng = random.Random(7)
    for k in range(150):
        turns = talk(rng, k % 6)
        ends = search(turns)
        cost, audit = min(x for x in (ends[0], ends[3]) if x)
        want = by_all_edits(turns)
        assert (cost, audit) == want[:2]
        assert tuple((r, t) for r, t, _ in conversations.edits(iter(turns), audit)) == want[2]


@pytest.mark.parametrize("size", [1, 2, 7, 300])
def test_segments_join_to_the_whole(size):
    """Cut anywhere, tables from state to state give what one search gives; long ones put their common beginnings aside."""
    rng = random.Random(size)
    for n in (0, 1, 9, 700):
        turns = [(r, t + str(i) + rng.choice(".?")) for i, (r, t) in enumerate(talk(rng, n))]  # no repeats, which only the tables know
        ends = search(turns)
        tables = [[x for s in range(4) for x in search(turns[i : i + size], s)] for i in range(0, n, size)]
        cost, parts = conversations.joined(tables)
        best = min(x for x in (ends[0], ends[3]) if x)
        assert (cost, "".join(a for _, a in parts)) == best
        whole = list(conversations.edits(iter(turns), best[1]))
        assert whole == [e for k, (start, audit) in enumerate(parts) for e in conversations.edits(iter(turns[k * size :]), audit, start)]


def expected(rows):
    """What ``repair`` says of the rows of one conversation."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, " " if r[2] is None else r[2], sha(" " if r[3] is None else r[3])))
    turns = [(" " if r is None else r, " " if t is None else t) for _, _, r, t in rows]
    seen, counts = set(), dict(blank=0, duplicate=0, truncated=0)
    for role, text in turns:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
    times = [r[1] for r in rows if r[1] is not None]
    gaps = max(times) - min(times) + 1 - len(set(times)) if times else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    ends = search(turns)
    cost, audit = min(x for x in (ends[0], ends[3]) if x)
    out = "\n".join(f"{r}:{t}" for r, t, _ in conversations.edits(iter(turns), audit))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha(out)


@pytest.mark.parametrize("rows_per_range", [50_000, 40])
def test_repair(spark, monkeypatch, rows_per_range):
    """Hot, short, null and repeated; with few rows a range the hot one takes many, and its repeats are seen across them."""
    monkeypatch.setattr(conversations, "ROWS_PER_RANGE", rows_per_range)
    rng = random.Random(3)
    rows = [(1, i // 2, *t) for i, t in enumerate(talk(rng, 400))] + [(c, i, *t) for c in (2, 3, None) for i, t in enumerate(talk(rng, 7))]
    rows += [(4, None, None, None), (4, None, "user", "Hi."), (4, 9, "user", "Hi."), (4, 3, "assistant", "Yes."), (5, 0, "user", "x." * 200_000), (5, 1, "assistant", "Ok."), (6, None, "user", " ")]
    df = spark.createDataFrame(rows, TURNS).withColumns({"place": F.lit("x"), "part": F.lit(1), "conv": F.lit(2), "digest": F.lit(0), "audit": F.lit(1)}).repartition(5)
    found, fixed = conversations.repair(df)
    got = {r["conv"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha")) for r in found.collect()}
    if rows_per_range < 100:
        assert found.where("conv = '1' and size(pieces) > 3").count() == 1
    keys = {r[0] for r in rows}
    for k in keys:
        assert got[None if k is None else str(k)] == expected([r for r in rows if r[0] == k])
    assert len(got) == len(keys)
    lines = fixed.orderBy("conv", "place", "nth").collect()
    for k in keys:
        conv = None if k is None else str(k)
        assert sha("\n".join(f"{r['role']}:{r['text']}" for r in lines if r["conv"] == conv)) == got[conv][-1]


def test_repair_of_nothing(spark):
    found, fixed = conversations.repair(spark.createDataFrame([], TURNS))
    assert found.count() == fixed.count() == 0


def test_damage(spark, tmp_path):
    """The whole query against its definition, with conversations of which nothing is left."""
    rng = random.Random(5)
    rows = [(c, i, *t) for c in range(60) for i, t in enumerate(talk(rng, rng.randint(1, 6)))] + [(None, None, None, None), (None, 1, "user", "Hm.")]
    alone = next(c for c in itertools.count(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((alone, 0, "user", "Gone."))
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for c in {r[0] for r in rows}:
        hurt = []
        for _, turn, role, text in (r for r in rows if r[0] == c):
            role, text = role if role is not None else " ", text if text is not None else " "
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            hurt += [(c, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        want[c] = expected(hurt) if hurt else (0, 0, 0, 0, 0, 0, "", EMPTY)
    got = conversations.op11_conversation_structure_repair(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r["conv_id"]: tuple(r)[1:] for r in got} == want
    assert want[alone] == (0, 0, 0, 0, 0, 0, "", EMPTY)


# Reply trees

MESSAGES = "tree long, id long, parent long, role string, text string, score double"
HARD = ["\\### Assistant: </turn> ok", "<turn user>\n", "\n</turn>\n", "\\</turn", "\\\\\\<turn", "ends in \\", "\n", "", None, "\\" * 50_000, "é<turn>\U0001f600</turn>\r\n", "<TURN </ turn"]


def paths_of(rows, branches):
    """The best paths of each tree, as lists of rows, by walking up from every leaf."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0))
    first = {}
    for k, r in enumerate(order):
        if r[1] is not None:
            first.setdefault((r[0], r[1]), k)
    up = [first.get((r[0], r[2])) if r[2] is not None else None for r in order]
    found = {}
    for k, r in enumerate(order):
        path, at = [k], up[k]
        while at is not None and at not in path:
            path.insert(0, at)
            at = up[at]
        if at is None and k not in up:
            found.setdefault(r[0], []).append((-sum(order[i][5] or 0.0 for i in path) / len(path), k, [order[i] for i in path]))
    return {(t, b + 1): p for t, ps in found.items() for b, (_, _, p) in enumerate(sorted(ps)[:branches])}


def test_reply_trees(spark):
    """A chain, a bush, several roots, circles, missing and repeated ids, and texts that look like marks."""
    rng = random.Random(11)
    rows = [(1, i, i - 1 if i else None, ("user", "assistant")[i % 2], HARD[i % len(HARD)], 0.0) for i in range(70)]
    rows += [(2, i, rng.randrange(i) if i else None, rng.choice(["user", "assistant", "a b>\n&é", None]), rng.choice(HARD), float(rng.randrange(5))) for i in range(120)]
    rows += [(None, 0, None, "user", "r", 1.0), (None, 1, 0, "assistant", "x", None), (3, 5, 99, "user", "lost", 1.0), (3, 6, None, "user", "root", 1.0), (3, 7, 6, "assistant", "y", 1.0)]
    rows += [(4, 1, 2, "user", "circle", 0.0), (4, 2, 1, "user", "circle", 0.0), (4, 3, 2, "user", "behind it", 0.0), (4, 4, 4, "user", "itself", 0.0), (5, None, None, "user", "no id", 0.0), (5, 1, None, "user", "a", 3.0)]
    df = spark.createDataFrame(rows, MESSAGES).repartition(4).withColumns({"node": F.lit(1), "up": F.lit("x"), "path": F.lit(2), "depth": F.lit(0)})
    for branches in (1, 3):
        want = paths_of(rows, branches)
        got = {(r["tree"], r["branch"]): r for r in chat.read_back(chat.format_trees(df, branches)).collect()}
        assert set(got) == set(want) and not [k for k in want if k[0] == 4]
        for k, path in want.items():
            r = got[k]
            assert [(t["role"], t["text"]) for t in r["turns"]] == [(role or "", text or "") for _, _, _, role, text, _ in path]
            assert r["learned"] == "".join(text or "" for _, _, _, role, text, _ in path if role == "assistant")
            spans = [r["formatted"][m["start"] : m["end"]] for m in r["mask"]]
            assert [re.sub(r"\\(\\*</?turn)", r"\1", s) for s in spans] == [text or "" for _, _, _, _, text, _ in path]
            assert r["score"] == pytest.approx(sum(x[5] or 0.0 for x in path) / len(path))
            assert r["formatted"].count("\n</turn>\n") == len(path) and not re.search(r"[^\\\n]</turn", r["formatted"].replace("\n\\</turn", ""))


def test_repeated_ids(spark):
    rows = [(1, 0, None, "user", "a", 0.0), (1, 1, 0, "assistant", "b", 1.0), (1, 1, 0, "assistant", "b", 1.0), (1, 2, 1, "user", "c", 9.0)]
    got = chat.read_back(chat.format_trees(spark.createDataFrame(rows, MESSAGES), 9)).collect()
    assert sorted("".join(t["text"] for t in r["turns"]) for r in got) == ["ab", "abc"]
    assert chat.format_trees(spark.createDataFrame([], MESSAGES)).count() == 0


def test_formatting_is_native(spark, tmp_path):
    rows = [(None, None, None, None), (1, 2, "user", "x"), (1, 2, "user", "x"), (1, None, "assistant", "first"), (2, 0, "assistant", "<turn")]
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    made = chat.op12_reply_tree_formatting(spark, str(tmp_path))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Python", "Pandas", "Arrow", "ExistingRDD") if w in plan]
    got = {r["conv_id"]: r for r in made.collect()}
    hard = "\\### Assistant: </turn> ok"
    want = {None: [("", "")], 1: [("assistant", "first"), ("user", "x"), ("user", "x")], 2: [("assistant", "<turn")], -7: [("user", hard), ("assistant", hard)]}
    assert set(got) == set(want)
    for k, turns in want.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert (got[k]["n_turns"], got[k]["turns_sha256"], got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned))


# Merkle manifest


def tree(leaves, fanout):
    """The root, and for each leaf its runs and places, from a list in memory."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for k, i in enumerate(at):
            paths[k].append((runs[i // fanout], i % fanout))
        level, at = [sha("".join(r)) for r in runs], [i // fanout for i in at]
    return level[0], paths


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest(spark, fanout):
    sizes = {"a": 100, "é": 1, None: 17, "": 2, "b": 16, "Z": 33}
    leaves = [(None if i == 3 else i // 2, g, sha(f"{g}{i}"), sha(f"other{i}") if i % 7 == 0 else None) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(leaves, "key long, group string, leaf string, other string").repartition(3).withColumn("n", F.lit(1)).withColumn("path", F.lit(2))
    got = {(r["group"], r["leaf"]): r for r in merkle.manifest(df, fanout).withColumn("proof", merkle.proof(F.col("path"))).collect()}
    assert len(got) == len(leaves)
    order = sorted(sizes, key=lambda g: (g is not None, (g or "").encode()))
    mine = {g: sorted((x for x in leaves if x[1] == g), key=lambda x: (x[0] is not None, x[0] or 0, x[2])) for g in order}
    below = {g: tree([x[2] for x in mine[g]], fanout) for g in order}
    root, above = tree([below[g][0] for g in order], fanout)
    for k, g in enumerate(order):
        for x, path in zip(mine[g], below[g][1]):
            r = got[g, x[2]]
            whole = path + above[k]
            now = x[3] or x[2]
            for run, at in whole:
                now = sha("".join(run[:at]) + now + "".join(run[at + 1 :]))
            assert (r["key"], r["subroot"], r["root"], r["folded_root"]) == (x[0], below[g][0], root, now)
            assert r["proof"] == sha("".join(d for run, at in whole for i, d in enumerate(run) if i != at))
            assert (now == root) == (x[3] is None)


def test_manifest_of_one_and_none(spark):
    shape = "key long, group string, leaf string, other string"
    assert merkle.manifest(spark.createDataFrame([], shape)).count() == 0
    one = merkle.manifest(spark.createDataFrame([(1, None, sha("x"), None)], shape)).withColumn("proof", merkle.proof(F.col("path"))).first()
    assert (one["root"], one["subroot"], one["folded_root"], one["proof"], one["path"]) == (sha("x"), sha("x"), sha("x"), EMPTY, [])


def test_leaves(spark):
    """Fields can't run into each other; lengths are in bytes; the same row twice is two leaves."""
    rows = [(1, "s", None, 3, "é:"), (None, None, None, None, None), (2, "s", "", 0, "A" * 100_000), (2, "s", "", 0, "A" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = [r[0] for r in df.select(merkle.leaf(*[F.col(c) for c in merkle.FIELDS])).collect()]
    assert got[:2] == [sha("1:11:s-1:33:é:"), sha("-----")] and got[2] == got[3]
    found = merkle.manifest(df.select(F.col("doc_id").alias("key"), F.col("source").alias("group"), merkle.leaf(*[F.col(c) for c in merkle.FIELDS]).alias("leaf"), F.lit(None).cast("string").alias("other")))
    assert found.count() == 4 and found.where("folded_root = root").count() == 4
