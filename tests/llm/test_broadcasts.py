"""Spark sizes a table by its compressed files, before an explode, so it would broadcast all of these small tables: none may be broadcast by that guess."""

from __future__ import annotations

from functools import partial

import numpy as np
import pytest

from tests.llm.test_operators import docs_of, edited_texts
from tidemark.llm import common, exact_dedup, simhash


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written(monkeypatch):
    """Plans of the tables that an operator writes; what it counts before a broadcast counts as too large for one."""
    plans = []

    def materialise(df):
        plans.append(plan_of(df))
        return common.materialise(df)

    for module in (simhash, exact_dedup):
        monkeypatch.setattr(module, "materialise", materialise)
        monkeypatch.setattr(module, "small", lambda held: common.small(held, -1))
    return plans


def test_large_tables_are_not_broadcast(spark):
    held = common.materialise(spark.range(9))
    assert "Broadcast" in plan_of(held.join(common.small(held, 9), "id"))
    assert "Broadcast" not in plan_of(held.join(common.small(held, 8), "id", "left_anti"))
    assert "Broadcast" not in plan_of(common.salted(held, held, "id", "id"))


def test_near_copies_broadcast_nothing_uncounted(spark, written, monkeypatch):
    docs = common.materialise(docs_of(spark, edited_texts(np.random.default_rng(9))[:120]))
    monkeypatch.setattr(simhash, "similar_groups", partial(simhash.similar_groups, crowd=1))
    plan = plan_of(simhash.drop_near_duplicates(docs))
    assert sum("SortMergeJoin" in p for p in written) >= 8
    assert not [p for p in [*written, plan] if "Broadcast" in p]


def test_grid_cells_are_not_broadcast(spark):
    """The visits, 33 a fingerprint, were broadcast where the fingerprints' file was small enough."""
    nodes = common.materialise(spark.createDataFrame([(i, i * i) for i in range(40)], "node long, fp long"))
    assert "SortMergeJoin" in plan_of(simhash.links(nodes)) and "Broadcast" not in plan_of(simhash.links(nodes))


def test_exact_copies_broadcast_nothing_uncounted(spark, written):
    docs = common.materialise(docs_of(spark, ["a b", "a  b", "c", None]))
    assert {r["doc_id"] for r in exact_dedup.drop_repeats(docs).collect()} == {0, 2, 3}
    assert written and not [p for p in [*written, plan_of(exact_dedup.exact_dedup(docs))] if "Broadcast" in p]


def test_fingerprints_are_not_broadcast(spark, written):
    docs = common.materialise(docs_of(spark, edited_texts(np.random.default_rng(9))))
    plan = plan_of(simhash.near_duplicates(docs))
    assert plan.count("SortMergeJoin") == 2
    assert not [p for p in [*written, plan] if "Broadcast" in p]
