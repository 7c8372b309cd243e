"""Formulas against pandas, and blocks of any size against one block."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tidemark.functions.formulas import FUNCTIONS, ColumnSpec, FormulaEngine, FormulaError, _functions, _Run, in_order, parse, wrap
from tidemark.operators import ordered

N = 157


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(0)
    a, b = rng.normal(100, 20, N), rng.normal(90, 30, N)
    gaps = rng.random(N) < 0.2
    gaps[:3] = True
    return pd.DataFrame({"ts": np.cumsum(rng.integers(1, 90_000, N)), "a": np.where(gaps, np.nan, a.round(1)), "b": b, "c": rng.integers(0, 9, N).astype(float)})


@pytest.fixture(scope="module")
def df(spark, frame):
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in frame.sample(frac=1, random_state=1).astype({"ts": int}).itertuples(index=False, name=None)]
    return spark.createDataFrame([(int(t), *r) for t, *r in rows], "ts long, a double, b double, c double")


def run(df, rows_per_block=1_000_000, **formulas):
    made = FormulaEngine(rows_per_block=rows_per_block).select_new(df, [ColumnSpec(*x) for x in formulas.items()])
    return made.orderBy("ts").toPandas()


def same(got, want):
    np.testing.assert_allclose(pd.to_numeric(got).astype(float).to_numpy(), want.astype(float).to_numpy(), rtol=1e-9, atol=1e-9)


def by_pandas(f):
    a, b, c = f["a"], f["b"], f["c"]
    filled = a.ffill()
    return {
        "lag": ("LAG(a, 2)", a.shift(2)), "lead": ("LAG(b, -3)", b.shift(-3)), "diff": ("DIFF(b, 5)", b - b.shift(5)), "pct": ("PCT_CHANGE(b)", b / b.shift(1) - 1), "logret": ("LOGRET(a, 2)", np.log(a) - np.log(a.shift(2))),
        "mean": ("ROLL_MEAN(a, 4)", a.rolling(4).mean()), "std": ("ROLL_STD(b, 9)", b.rolling(9).std()), "total": ("ROLL_SUM(b, 30)", b.rolling(30).sum()), "z": ("ROLL_ZSCORE(b, 6)", (b - b.rolling(6).mean()) / (b.rolling(6).std() + 1e-12)),
        "nested": ("ROLL_MEAN(LAG(ROLL_SUM(b, 5), 3), 7)", b.rolling(5).sum().shift(3).rolling(7).mean()), "mixed": ("ROLL_MEAN(LAG(b, -2) - LAG(b, 2), 3)", (b.shift(-2) - b.shift(2)).rolling(3).mean()),
        "cumsum": ("CUMSUM(a)", a.cumsum()), "cumprod": ("CUMPROD(a / 100)", (a / 100).cumprod()), "ffill": ("FILL_FFILL(a)", filled), "bfill": ("FILL_BFILL(a)", a.bfill()), "zero": ("FILL_ZERO(a)", a.fillna(0)),
        "ema": ("EMA(b, 10)", b.ewm(span=10, adjust=False).mean()), "ema_gaps": ("EMA(a, 5)", a.ewm(span=5, adjust=False).mean().where(a.notna())),
        "after": ("ROLL_MEAN(CUMSUM(b), 3) - LAG(FILL_FFILL(a), 1)", b.cumsum().rolling(3).mean() - filled.shift(1)),
        "zscore": ("ZSCORE(a)", (a - a.mean()) / (a.std() + 1e-12)), "minmax": ("MINMAX(a)", (a - a.min()) / (a.max() - a.min() + 1e-12)), "rank": ("RANK_NORM(c)", (c.rank() - 1) / (N - 1 + 1e-12)), "rank_null": ("RANK_NORM(a)", (a.rank() - 1) / (N - 1 + 1e-12)),
        "winsor": ("WINSORIZE(a, 0.1, 0.8)", a.clip(*[np.sort(a.dropna())[math.floor((a.count() - 1) * p + 0.5)] for p in (0.1, 0.8)])),
        "robust": ("ROBUST_Z(a)", (a - a.median()) / ((a - a.median()).abs().median() * 1.4826 + 1e-12)),
    }


@pytest.mark.parametrize("rows_per_block", [1_000_000, 40, 7])
def test_ordered_functions(df, frame, rows_per_block):
    wanted = by_pandas(frame)
    got = run(df, rows_per_block, **{k: f for k, (f, _) in wanted.items()})
    for k, (_, want) in wanted.items():
        same(got[k], want)


@pytest.mark.parametrize("rows_per_block", [1_000_000, 40])
def test_keys(spark, frame, rows_per_block):
    other = frame.assign(b=frame["b"] * 2, a=frame["a"].iloc[::-1].to_numpy())
    both = pd.concat([frame.assign(k="x"), other.assign(k="y")])
    rows = [(r.k, int(r.ts), None if math.isnan(r.a) else r.a, r.b, r.c) for r in both.sample(frac=1, random_state=2).itertuples()]
    df = spark.createDataFrame(rows, "k string, ts long, a double, b double, c double")
    wanted = {k: by_pandas(f) for k, f in (("x", frame), ("y", other))}
    made = FormulaEngine(partition_by=["k"], rows_per_block=rows_per_block).select_new(df, [ColumnSpec(n, f) for n, (f, _) in wanted["x"].items()]).orderBy("k", "ts").toPandas()
    for k in "xy":
        part = made[made["k"] == k]
        for n, (_, want) in wanted[k].items():
            same(part[n], want)


def one(spark, formula, **values):
    df = spark.createDataFrame([(0, *values.values())], "ts long, " + ", ".join(f"{k} double" for k in values))
    return FormulaEngine().select_new(df, [ColumnSpec("y", formula)]).first()["y"]


@pytest.mark.parametrize(
    ("formula", "want"),
    [
        ("a / zero", math.inf), ("-a / zero", -math.inf), ("zero / zero", math.nan), ("a % zero", math.nan), ("LOG(zero)", -math.inf), ("LOG(-a)", math.nan), ("SQRT(-a)", math.nan), ("a / none", None), ("LOG(none)", None), ("EXP(a * 1000)", math.inf),
        ("SIGN(none)", 0), ("SIGN(-a)", -1), ("ROUND(2.5 + zero)", 3.0), ("ROUND(-2.5 + zero)", -3.0), ("FLOOR(-0.5 + zero)", -1.0), ("CEIL(a / 2)", 1.0), ("-5 % (a + 1)", -2.0), ("a ** 0.5", math.sqrt(2)),
        ("CLIP(none, 0, 1)", None), ("CLIP(a, 0, 1)", 1), ("MIN(none, a)", 2.0), ("MAX(none, a)", 2.0), ("IF(none > 1, 1, a)", 2.0), ("ISNA(none)", True), ("ISFINITE(a / zero)", False), ("ISFINITE(none)", None), ("COALESCE(none, a)", 2.0),
        ("a > 1 and not a > 3", True), ("a > 5 or a == 2", True), ("1 < a <= 2", True), ("a if a > 5 else zero", 0.0), ("a if 1 else zero", 2.0), ("-a + +a", 0.0),
        ("ROW_SUM(none)", 0.0), ("ROW_MEAN(none)", None), ("ROW_STD(a)", None), ("ROW_MEDIAN(a, zero, none)", 1.0), ("ROW_QUANTILE(SET(a, zero), 0.9)", 0.0), ("ROW_TOPK_MEAN(SET(none), 3)", None), ("ROW_TOPK_MEAN(SET(a, zero), 9)", 1.0), ("ROW_BOTTOMK_MEAN(SET(a, zero), 1)", 0.0),
        ("ROW_COUNT_VALID(a, none, 3)", 1), ("ROW_MAX(a)", 2.0), ("ROW_MIN()", None), ("ROW_SUM([a, (a, zero)])", 4.0),
        ("XS_RANK(none, SET(a, zero))", 0.5), ("XS_RANK(a, SET(none))", None), ("XS_RANK(a, SET(a, zero))", 2.0), ("XS_PCTRANK(a, SET(a))", 0.0), ("XS_DEMEAN(a, SET(a, zero))", 1.0), ("SOFTMAX_WEIGHT(zero, SET(zero, zero))", 0.5), ("ROW_SUM(COLS('^(a|zero)$'))", 2.0), ("COL('a')", 2.0),
    ],
)
def test_one_row(spark, formula, want):
    got = one(spark, formula, a=2.0, zero=0.0, none=None)
    assert got is None if want is None else math.isnan(got) if isinstance(want, float) and math.isnan(want) else got == pytest.approx(want)


@pytest.mark.parametrize("formula", ["", "a +", "a.b", "a[0]", "lambda: a", "__import__('os')", "a // 2", "a & 1", "f(x=1)", "[x for x in a]", "ABS(a, n=2)", "3", "SET(a)", "'text'", "b", "COL('b')", "COLS('(')", "LAG(a, 1.5)", "ROLL_MEAN(a, 0)", "WINSORIZE(a, 0.9, 0.1)", "ROW_QUANTILE(a, 2)", "SOFTMAX_WEIGHT(a, SET(), 1)", "SOFTMAX_WEIGHT(a, SET(a), 0)", "ABS()", "nothing(a)", "1 / 0 + a", "a + SET(a)", "{'a': a}", "a := 3", "ROW_TOPK_MEAN(a, 0)"])
def test_rejected(spark, formula):
    df = spark.createDataFrame([(0, 1.0)], "ts long, a double")
    made, errors = FormulaEngine().apply(df, [ColumnSpec("good", "a + 1"), ColumnSpec("bad", formula)])
    assert list(errors) == ["bad"] and made.columns == ["ts", "a", "good"]


def test_all_functions_are_there(spark):
    df = spark.createDataFrame([(0, 1.0)], "ts long, a double")
    assert len(_functions(_Run(FormulaEngine(), df))) == FUNCTIONS


def test_order_and_circles(spark):
    specs = [ColumnSpec("z", "y + 1"), ColumnSpec("y", "x * 2"), ColumnSpec("x", "a"), ColumnSpec("p", "q"), ColumnSpec("q", "COL('p')"), ColumnSpec("s", "s + 1"), ColumnSpec("t", "ROW_SUM(COLS('^[xyz]$'))"), ColumnSpec("a", "1")]
    ordered, circle = in_order(specs[:-1])
    assert [s.name for s in ordered][:4] == ["x", "y", "z", "t"] and circle == {"p", "q", "s"}
    df = spark.createDataFrame([(0, 1.0)], "ts long, a double")
    made, errors = FormulaEngine().apply(df, specs)
    assert set(errors) == {"p", "q", "s", "a"} and made.columns == ["ts", "a", "z", "y", "x", "t"]
    assert made.first()["t"] == 6.0
    with pytest.raises(FormulaError):
        FormulaEngine().apply(df, [ColumnSpec("n", "a"), ColumnSpec("n", "a + 1")])


def test_wrap():
    specs = [ColumnSpec("x", "a + 1"), ColumnSpec("y", "a")]
    assert wrap(specs, ["x"], "ABS({x})") == [ColumnSpec("x", "ABS((a + 1))"), specs[1]]
    assert wrap(specs, ["x"], "ABS({x})", "_abs") == [specs[0], ColumnSpec("x_abs", "ABS(x)"), specs[1]]
    with pytest.raises(FormulaError):
        wrap(specs, ["x"], "ABS(x)")


def test_parse_rejects_deeply():
    with pytest.raises(FormulaError):
        parse("ABS(a.__class__)")


def test_column_hides_function(spark):
    df = spark.createDataFrame([(0, 1.0)], "ts long, ABS double")
    made, errors = FormulaEngine().apply(df, [ColumnSpec("x", "ABS + 1"), ColumnSpec("y", "ABS(x)")])
    assert made.first()["x"] == 2.0 and list(errors) == ["y"]


def test_odd_column_names(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0)], "ts long, `a.b` double, `c d` double")
    made, errors = FormulaEngine().apply(df, [ColumnSpec("s", "COL('a.b') + COL('c d')")])
    assert not errors and made.first()["s"] == 3.0


def test_global_order_is_not_one_task(df):
    plan = FormulaEngine(rows_per_block=40).select_new(df, [ColumnSpec("x", "ROLL_MEAN(LAG(b, 2), 5)")])._jdf.queryExecution().executedPlan().toString()
    # But for the counts of ranges, of which there is one row a range, no window lacks a partition.
    windows = [line for line in plan.splitlines() if "Window [" in line and "__range" not in line]
    assert windows and all("__block" in w for w in windows)


def test_no_task_holds_a_hot_key(spark):
    """Nine rows of ten have one key; half of the rest has none."""
    df = spark.range(1000).select(F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 > 0, "x").alias("k"), (F.col("id") * 3).alias("ts"), F.col("id").cast("double").alias("v"))
    placed, many = ordered.number(df, "ts", ["k"], rows_per_block=50)
    assert many
    rows = placed.orderBy("k", "ts").collect()
    for k in (None, "hot", "x"):
        mine = [r for r in rows if r["k"] == k]
        assert [r[ordered.RN] for r in mine] == list(range(len(mine))) and {r[ordered.BLOCK] for r in mine} == set(range(-(-len(mine) // 50)))
    specs = [ColumnSpec("total", "CUMSUM(v)"), ColumnSpec("mean", "ROLL_MEAN(v, 60)"), ColumnSpec("ema", "EMA(v, 9)"), ColumnSpec("mid", "ROBUST_Z(v)"), ColumnSpec("rank", "RANK_NORM(v)")]
    small, large = (FormulaEngine(partition_by=["k"], rows_per_block=n).select_new(df, specs).orderBy("k", "ts").toPandas() for n in (50, 10**6))
    pd.testing.assert_frame_equal(small, large, rtol=1e-9)
    assert len(small) == 1000 and small["k"].isna().sum() == 50


def test_tasks_don_t_grow_with_small_blocks(spark, monkeypatch):
    """36 million rows in blocks of a thousand take no 72,000 tasks; ranges of more than one block number rows all the same."""
    assert [ordered.ranges_of(*x) for x in ((150, 50), (10**5, 1000), (36 * 10**6, 1000), (10**9, 1000), (10**9, 10**6), (10**7, 4 * 10**6))] == [6, 200, 200, 2000, 2000, 6]
    dealt, deal = [], ordered.in_ranges
    monkeypatch.setattr(ordered, "in_ranges", lambda df, by, ranges: dealt.append(ranges) or deal(df, by, ranges))
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 3000).alias("ts"))
    rows = ordered.number(df, "ts", ["k"], rows_per_block=10)[0].orderBy("k", "ts").collect()
    assert dealt == [200] and [(r[ordered.RN], r[ordered.BLOCK]) for r in rows] == [(i, i // 10) for i in range(1500)] * 2


@pytest.mark.parametrize("kind", ["one minute", "one time", "nulls"])
def test_no_range_holds_a_burst(spark, kind):
    """Ranges follow a sample of the rows, not the length of time: nine rows of ten in a minute, at one time or at none."""
    burst = {"one minute": F.lit(10**9) + F.col("id") % 60, "one time": F.lit(10**9), "nulls": F.lit(None)}[kind].cast("long")
    df = spark.range(2000).select(F.when(F.col("id") % 10 == 0, F.col("id") * 10**7).otherwise(burst).alias("ts"), F.col("id").alias("v"))
    sizes = ordered.in_ranges(df, [F.asc_nulls_first("ts")], 40).groupBy(F.shiftright("__place", 33)).count().toPandas()["count"]
    assert sizes.sum() == 2000 and sizes.max() <= 100
    placed, _ = ordered.number(df, "ts", rows_per_block=100)
    rows = placed.orderBy(ordered.RN).collect()
    assert [r[ordered.RN] for r in rows] == list(range(2000))
    times = [-1 if r["ts"] is None else r["ts"] for r in rows]
    assert times == sorted(times)


@pytest.mark.parametrize("span", [1, 2, 30, 5000])
def test_long_exponential_means(spark, span):
    """Many chunks of steps, runs of nulls longer than a chunk, and values that aren't numbers from some row on."""
    rng = np.random.default_rng(span)
    x = pd.Series(rng.normal(5, 2, 3000)).mask(rng.random(3000) < 0.3)
    x[700:1900] = np.nan
    df = spark.createDataFrame([(i, None if math.isnan(v) else float(v)) for i, v in enumerate(x)], "ts long, x double")
    want = x.ewm(span=span, adjust=False).mean().where(x.notna())
    for rows in (10**6, 800):
        same(run(df, rows, y=f"EMA(x, {span})")["y"], want)
    odd = df.withColumn("x", F.when(F.col("ts") == 2500, F.lit(math.nan)).otherwise(F.col("x")))
    for rows in (10**6, 800):
        got = [r["y"] for r in FormulaEngine(rows_per_block=rows).select_new(odd, [ColumnSpec("y", f"EMA(x, {span})")]).orderBy("ts").collect()]
        assert [y is not None and math.isnan(y) for y in got] == [i == 2500 or i > 2500 and not math.isnan(v) for i, v in enumerate(x)]


def test_exponential_means_stay_in_the_jvm(df):
    plan = FormulaEngine(rows_per_block=40).select_new(df, [ColumnSpec("x", "EMA(b, 5)")])._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Pandas", "Python", "Arrow") if w in plan]
