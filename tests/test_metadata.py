"""Schemas, archives, recipes, the catalog, builds and the entry points."""

from __future__ import annotations

import subprocess
import sys
import zipfile
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.plans import builder, catalog
from tidemark.sources import archives, recipes, schemas

# Schemas


@pytest.mark.parametrize(
    ("line", "dataset", "names", "header"),
    [
        ("id,price,qty,quote_qty,time,is_buyer_maker", "trades", ["id", "price", "qty", "quote_qty", "time", "is_buyer_maker"], True),
        ("1,2.5,3,7.5,1700000000000,true", "trades", ["id", "price", "qty", "quote_qty", "time", "is_buyer_maker"], False),
        ("1,2.5", "trades", ["col_0", "col_1"], False),
        ("create_time,sum_open_interest,1", "metrics", ["create_time", "sum_open_interest", "1"], True),
        ("2024,true,-1.5e3", "metrics", ["col_0", "col_1", "col_2"], False),
    ],
)
def test_headers(spark, line, dataset, names, header):
    assert schemas.column_names(line, dataset) == (names, header)


def test_registry_unions_columns(spark):
    registry = schemas.SchemaRegistry(spark)
    registry.register(schemas.RegisteredSchema("klines", ["open_time", "open"], {"open": "str"}, "open_time", None, {"a": "b"}))
    registry.register(schemas.RegisteredSchema("klines", ["close", "open"], {"open": "float64"}, None, "open_time"))
    got = registry.get("klines")
    assert got.columns == ["open_time", "open", "close"] and got.dtypes == {"open": "float64"} and got.primary_time_key == got.join_key == "open_time" and got.field_notes == {}
    assert schemas.SchemaRegistry.from_df(registry.to_df()).get("klines") == got
    registry.add_sample("klines", "https://x/BTC-1h-2024-01.zip", True)
    registry.add_sample("klines", "https://x/odd", True)
    assert [r["sample_date"] for r in registry.samples_df().collect()] == ["2024-01", "unknown"]


def test_inspection(spark):
    df = spark.createDataFrame([(1, 2.0, "x", True)], "time long, price double, s string, b boolean")
    found = schemas.inspect(df, "other")
    assert found["dtypes"] == {"time": "int64", "price": "float64", "s": "str", "b": "bool"} and found["primary_time_key"] == "time" and found["validation_status"] == "unknown"
    assert schemas.validation("bookDepth", ["timestamp", "percentage", "depth", "notional"]) == "valid" and schemas.validation("bookDepth", ["depth"]) == "invalid"


def test_union_and_conform(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2**40, "s")], "x long, y string")
    assert {tuple(r) for r in schemas.union([a, b]).collect()} == {(1, None), (2**40, "s")}
    made = schemas.conform(spark.createDataFrame([("7", "bad", "z")], "timestamp string, depth string, more string"), schemas.known_schema("bookDepth"))
    assert made.first().asDict() == {"timestamp": 7, "percentage": None, "depth": None, "notional": None, "more": "z"}


# Archives


@pytest.fixture(scope="module")
def zips(tmp_path_factory):
    folder = tmp_path_factory.mktemp("zips")
    with zipfile.ZipFile(folder / "BTC-trades-2024-01-01.zip", "w") as z:
        z.writestr("a.csv", "id,price,qty,quote_qty,time,is_buyer_maker\n1,10,1,10,1704067200000,true\n2,11,1,11,1704067260000,false\n")
        z.writestr("b.csv", "3,12,1,12,1704067320000,true\n")
        z.writestr("readme.txt", "no")
    (folder / "bad.zip").write_text("not a zip")
    with zipfile.ZipFile(folder / "none.zip", "w") as z:
        z.writestr("readme.txt", "no")
    return folder


def test_archives(spark, zips):
    rows = archives.read_archives(spark, [f"{zips}/BTC-trades-2024-01-01.zip", f"{zips}/bad.zip"], "trades")
    assert [(r["id"], r["price"], r["time"], r["is_buyer_maker"]) for r in rows.orderBy("id").collect()] == [(1, 10.0, 1704067200000, True), (2, 11.0, 1704067260000, False), (3, 12.0, 1704067320000, True)]
    assert sorted(r["rows"] for r in archives.member_manifest(rows, "id").collect()) == [1, 2]
    assert [r["path"].rsplit("/", 1)[1] for r in archives.bad_archives(spark, [f"{zips}/*.zip"]).collect()] == ["bad.zip"]
    with pytest.raises(ValueError):
        archives.read_archives(spark, [f"{zips}/none.zip"], "trades")


def test_hashes(spark, zips):
    (zips / "h.txt").write_text("abc")
    assert archives.file_hashes(spark, [f"{zips}/h.txt"]).first()[1:] == (3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")


def test_cache(spark, tmp_path):
    root = f"{tmp_path}/cache"
    base = {"market": "um", "dataset_type": "trades", "interval": "-", "cadence": "daily"}
    for symbol in ("A", "B"):
        df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "id long, date string")
        archives.write_cache(df, root, symbol=symbol, **base)
    archives.write_cache(spark.createDataFrame([(9, "2024-01-02")], "id long, date string"), root, symbol="A", **base)
    scan = archives.scan_cache(spark, root, ["id", "gone"], ("2024-01-02", "2024-01-31"), symbol="A")
    assert [tuple(r) for r in scan.collect()] == [(9,)]
    assert archives.scan_cache(spark, root, symbol="B").count() == 2
    assert "PartitionFilters: [isnotnull(symbol" in scan._jdf.queryExecution().executedPlan().toString()


# Recipes


RECIPE = {"name": "r", "symbols": ["A", "B"], "time_range": {"start": "2024-01-01", "end": "2024-01-31"}, "inputs": [{"dataset_type": "klines", "interval": "1h", "columns": ["close"]}]}


@pytest.mark.parametrize("suffix", ["json", "yaml"])
def test_recipe_round_trip(tmp_path, suffix):
    if suffix == "yaml":
        pytest.importorskip("yaml")
    recipe = recipes.Recipe(**RECIPE)
    recipes.save_recipe(recipe, f"{tmp_path}/r.{suffix}")
    assert recipes.load_recipe(f"{tmp_path}/r.{suffix}") == recipe
    assert recipe.join_policy == {"key": "open_time", "missing": "drop"}


def test_bad_recipes(tmp_path):
    (tmp_path / "r.toml").write_text("")
    with pytest.raises(ValueError):
        recipes.load_recipe(f"{tmp_path}/r.toml")
    for change in ({"output_format": "cube"}, {"time_range": {}}):
        with pytest.raises(ValueError):
            recipes.Recipe(**RECIPE | change)


def test_validation(spark):
    files = spark.createDataFrame([("um", "klines", "A", "1h", "daily", "2024-01-02", False), ("um", "klines", "B", "1h", "daily", "2024-01-02", True)], "market string, dataset_type string, symbol string, interval string, cadence string, date string, exists boolean")
    registry = schemas.SchemaRegistry(spark)
    recipe = recipes.Recipe(**RECIPE)
    assert [e.split(":")[0] for e in builder.validate(recipe, files, registry)] == ["A klines", "klines"]
    registry.register(schemas.RegisteredSchema("klines", ["ts", "open"], primary_time_key="ts"))
    errors = builder.validate(recipe, files.where("exists"), registry)
    assert errors == ["klines: no columns close", "klines: no join key open_time; ts may serve"]


def test_execution(spark, tmp_path):
    new_year = 1_704_067_200_000
    bars = {s: spark.createDataFrame([(new_year + i * 86_400_000, float(i) + k) for i in range(3)], "open_time long, close double") for k, s in enumerate("AB")}
    depth = spark.createDataFrame([(new_year, 5.0), (new_year + 172_800_000, 7.0)], "timestamp long, depth double")
    recipe = recipes.Recipe(**RECIPE | {"inputs": [*RECIPE["inputs"], {"dataset_type": "bookDepth", "columns": ["depth"]}], "join_policy": {"key": "open_time", "missing": "ffill"}})
    read = lambda symbol, i: bars[symbol] if i.dataset_type == "klines" else depth
    out, manifest = builder.execute(recipe, read, output=f"{tmp_path}/out")
    assert manifest["row_count"] == 6 and sorted(map(tuple, out.collect())) == [(s, new_year + i * 86_400_000, i + k + 0.0, d) for k, s in enumerate("AB") for i, d in enumerate((5.0, 5.0, 7.0))]
    assert spark.read.parquet(f"{tmp_path}/out/symbol=A/date=2024-01-02").count() == 1
    wide = builder.execute(recipes.Recipe(**RECIPE | {"output_format": "wide"}), read)[0]
    assert wide.columns == ["open_time", "A_close", "B_close"] and wide.count() == 3
    with pytest.raises(ValueError):
        builder.execute(recipes.Recipe(**RECIPE | {"inputs": [{"dataset_type": "klines", "columns": ["none"]}]}), read)


# Builds


def test_build(spark, tmp_path):
    day = 86_400_000
    a = spark.createDataFrame([(d * day // 1000, float(d), 0.0) for d in range(5)] + [(2 * day // 1000, 99.0, 0.0)], "open_time long, close double, ignore double")
    b = spark.createDataFrame([("1970-01-02 00:00:00", 1), ("1970-01-04", 3)], "create_time string, oi int")
    read = lambda s: a if s.symbol == "A" else b
    sel = [builder.Selection("um", "klines", "A", "1970-01-01", "1970-01-04", "1d"), builder.Selection("um", "metrics", "B", "1970", "1970", columns=["oi"])]
    out, report = builder.build(builder.BuildConfig(sel, 0, "ffill", f"{tmp_path}/w"), read)
    assert out.columns == ["A_klines_1d_close", "B_metrics_oi", "ts"]
    assert sorted(map(tuple, out.collect()), key=lambda r: r[2]) == [(0.0, None, 0), (1.0, 1, day), (99.0, 1, 2 * day), (3.0, 3, 3 * day)]
    assert report["rows"] == 4 and report["nulls"]["B_metrics_oi"] == {"before": 2, "after": 1, "filled": 1}
    assert spark.read.parquet(f"{tmp_path}/w").count() == 4
    builder.write_report(report, f"{tmp_path}/r.json")
    with pytest.raises(ValueError):
        builder.build(builder.BuildConfig([builder.Selection("um", "klines", "A", "2000", "2000")]), read)
    with pytest.raises(ValueError):
        builder.build(builder.BuildConfig([], 0), read)


# Catalog


def test_dates(spark):
    assert [r[0] for r in catalog.dates(spark, "2024-02-28", "2024-03-01").collect()] == ["2024-02-28", "2024-02-29", "2024-03-01"]
    assert [r[0] for r in catalog.dates(spark, "2023-12-31", "2024-02-01", "monthly").collect()] == ["2023-12", "2024-01", "2024-02"]
    assert catalog.dates(spark, "2024-01-02", "2024-01-01").count() == 0


@pytest.mark.parametrize("gone", [0, 1, 2, 37, 99, 100])
def test_first_available(gone):
    low, asked = date(2024, 1, 1), []

    def exists(day):
        asked.append(day)
        return day >= low + timedelta(days=gone)

    assert catalog.first_available(exists, low, low + timedelta(days=99)) == (low + timedelta(days=gone) if gone < 100 else None)
    assert len(asked) <= 16


def test_first_available_month():
    assert catalog.first_available(lambda d: d >= date(2023, 11, 1), date(2020, 1, 15), date(2024, 3, 9), "monthly") == date(2023, 11, 1)
    assert catalog.first_available(lambda d: False, date(2020, 1, 1), date(2024, 1, 1), "monthly") is None


def test_periods():
    assert catalog.period("2024") == (date(2024, 1, 1), date(2024, 12, 31)) and catalog.period("2024-12") == (date(2024, 12, 1), date(2024, 12, 31)) and catalog.period("2024-02-03") == (date(2024, 2, 3),) * 2


def test_probe_and_upsert(spark):
    files = catalog.expected_files(spark, "um", ["A"], [("trades", None), ("klines", "1h")], "2024-01-01", "2024-01-02", "daily", "http://b")

    def probe(url):
        if "klines" in url:
            raise OSError("down")
        return {"remote_size": 5, "etag": "e"} if url.endswith("01.zip") else None

    found = catalog.with_probe(files, probe)
    assert {(r["dataset_type"], r["date"]): (r["exists"], r["remote_size"]) for r in found.collect()} == {("trades", "2024-01-01"): (True, 5), ("trades", "2024-01-02"): (False, None), ("klines", "2024-01-01"): (False, None), ("klines", "2024-01-02"): (False, None)}
    old = catalog.upsert(spark.createDataFrame([], catalog.FILES_DDL), found)
    again = catalog.upsert(old, found.withColumn("etag", F.lit(None).cast("string")).withColumn("exists", F.lit(False)))
    assert again.count() == 4 and again.where("exists").count() == 0 and again.where("etag = 'e'").count() == 1
    covered = catalog.coverage(old)
    assert [(r["num_files"], r["num_missing"], r["missing_dates"], r["total_size_estimate"]) for r in covered.collect()] == [(1, 1, ["2024-01-02"], 5)]
    assert catalog.coverage_of(covered, "um", "trades", "A").count() == 1
    assert catalog.upsert_coverage(covered, covered).count() == 1
    assert [r["date"] for r in catalog.to_download(old, "um", "trades", "A", "2024-01-01", "2024-12-31").collect()] == ["2024-01-01"]


def test_migration(spark):
    made = catalog.migrate(spark.createDataFrame([(1, None)], "a int, b string"), {"b": ("string", ""), "c": ("long", None), "d": ("int", 3)})
    assert made.first().asDict() == {"a": 1, "b": "", "c": None, "d": 3}


# Entry points


def test_every_query_has_a_name_and_sql_is_of_queries():
    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 40


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["vol", "ret", "c", "xs", "ts"]


def test_core_needs_no_language_model_package():
    code = "import sys; import tidemark.catalog_of_queries; assert not [m for m in sys.modules if m.startswith('tidemark.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__spark_entry__.ROOT)


def test_the_last_row_of_the_source_stays(spark, tmp_path):
    """Of a repeated ts the row that stands last, not the one with the largest value; files in the order of their names."""
    for name, rows in (("a", [(0, 9.0), (0, 5.0), (60, 1.0)]), ("b", [(60, 0.5), (120, 2.0)])):
        rows = [(1_600_000_000_000 + 1000 * t, x) for t, x in rows]
        spark.createDataFrame(rows, "open_time long, close double").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    read = lambda s: spark.read.parquet(f"{tmp_path}/a", f"{tmp_path}/b") if s.symbol == "A" else spark.read.parquet(f"{tmp_path}/{s.symbol}")
    picks = [builder.Selection("um", "klines", "A", "2020", "2021", "1m"), builder.Selection("um", "klines", "none", "2020", "2021", "1m")]
    out, report = builder.build(builder.BuildConfig(picks, 0), read)
    assert [(x, t - 1_600_000_000_000) for x, t in out.orderBy("ts").collect()] == [(5.0, 0), (0.5, 60_000), (2.0, 120_000)]
    assert report["heights"] == {0: 3} and [e["selection"] for e in report["errors"]] == [1]


def test_formulas_as_lines(tmp_path):
    from tidemark.functions.formulas import ColumnSpec

    builder.write_formulas([ColumnSpec("a", "click + 1"), ColumnSpec("b", "LAG(a)")], f"{tmp_path}/f.tsv")
    assert (tmp_path / "f.tsv").read_text(encoding="utf-8") == "a\tclick + 1\nb\tLAG(a)\n"


def test_symbols_of_files(spark):
    names = spark.createDataFrame([("BTCUSDT-bookTicker-2023-01-01.zip",), ("/x/y-z/ETHUSDT-1m-2023-01.csv",), ("plain",)], "name string")
    assert [r[0] for r in names.select(schemas.symbol_of_file(F.col("name"))).collect()] == ["BTCUSDT", "ETHUSDT", "plain"]


def test_sums_of_whole_numbers_stay_whole(spark):
    from tidemark.functions.formulas import ColumnSpec, FormulaEngine

    df = spark.createDataFrame([(i, (1 << 60) + i) for i in range(7)], "ts long, x long")
    for rows in (2, 100):
        got = FormulaEngine(rows_per_block=rows).select_new(df, [ColumnSpec("s", "CUMSUM(x)")])
        assert dict(got.dtypes)["s"] == "bigint" and [r["s"] for r in got.orderBy("ts").collect()] == [(k + 1) * (1 << 60) + k * (k + 1) // 2 for k in range(7)]
