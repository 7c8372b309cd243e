"""The commands, end to end."""

from __future__ import annotations

import json
import zipfile

import pytest

from tidemark import cli
from tidemark.sources import archives, schemas


def test_formulas(spark, tmp_path, capsys):
    spark.createDataFrame([(1, 1.0), (2, 3.0)], "ts long, a double").write.parquet(f"{tmp_path}/t")
    (tmp_path / "f.tsv").write_text("d\tDIFF(a)\nbad\tNOPE(a)\n")
    assert cli.main(["formulas", "--table", f"{tmp_path}/t", "--formulas", f"{tmp_path}/f.tsv", "--output", f"{tmp_path}/o", "--only-new"], spark) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["columns"] == ["d", "ts"] and said["rows"] == 2 and list(said["errors"]) == ["bad"]
    assert [r["d"] for r in spark.read.parquet(f"{tmp_path}/o").orderBy("ts").collect()] == [None, 2.0]


def test_inspection(spark, tmp_path, capsys):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("x.csv", "timestamp,percentage,depth,notional\n1,2,3,4\n")
    cli.main(["schema-inspect", "--dataset", "bookDepth", f"{tmp_path}/x.zip"], spark)
    assert json.loads(capsys.readouterr().out)["validation_status"] == "valid"


@pytest.mark.parametrize("exists", [True, False])
def test_recipes(spark, tmp_path, capsys, exists):
    bars = spark.createDataFrame([(1_704_067_200_000, 5.0, "2024-01-01")], "open_time long, close double, date string")
    archives.write_cache(bars, f"{tmp_path}/cache", market="um", dataset_type="klines", symbol="A", interval="1h", cadence="daily")
    spark.createDataFrame([("um", "klines", "A", "1h", "daily", "2024-01-01", exists, 1)], "market string, dataset_type string, symbol string, interval string, cadence string, date string, exists boolean, remote_size long").write.parquet(f"{tmp_path}/files")
    registry = schemas.SchemaRegistry(spark)
    registry.register(schemas.RegisteredSchema("klines", ["open_time", "close"], primary_time_key="open_time"))
    registry.to_df().write.parquet(f"{tmp_path}/schemas")
    recipe = {"name": "r", "symbols": ["A"], "time_range": {"start": "2024-01-01", "end": "2024-01-02"}, "inputs": [{"dataset_type": "klines", "interval": "1h", "columns": ["close"]}]}
    (tmp_path / "r.json").write_text(json.dumps(recipe))
    common = ["--recipe", f"{tmp_path}/r.json", "--files", f"{tmp_path}/files", "--schemas", f"{tmp_path}/schemas"]
    assert cli.main(["recipe-check", *common], spark) == int(not exists)
    run = ["recipe-execute", *common, "--cache", f"{tmp_path}/cache", "--output", f"{tmp_path}/out"]
    assert cli.main(run, spark) == int(not exists)
    assert cli.main([*run, "--force"], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1
    cli.main(["coverage", "--files", f"{tmp_path}/files", "--symbol", "A"], spark)
    assert ("2024-01-01" in capsys.readouterr().out.split("start_date")[1]) == exists


def test_cache_and_menu_from_the_command_line(spark, tmp_path, capsys):
    import json
    import zipfile

    from tidemark.cli import main

    for day in ("2024-01-01", "2024-01-02"):
        folder = tmp_path / "zips/um/daily/trades/A"
        folder.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(folder / f"A-trades-{day}.zip", "w") as z:
            z.writestr("x.csv", "1,10,1,10,1704067200000,true\n")
    source = ["--market", "um", "--start", "2024-01-01", "--end", "2024-01-03"]
    assert main(["cache-build", *source, "--archives", f"{tmp_path}/zips", "--cache", f"{tmp_path}/cache", "--dataset", "trades", "--symbol", "A"], spark) == 0
    assert json.loads(capsys.readouterr().out)["summary"] == {"ok": 2, "missing": 1, "missing_404": 0, "network_error": 0, "error": 0, "skipped": 0}
    assert main(["menu-build", *source, "--archives", f"{tmp_path}/zips/um", "--store", f"{tmp_path}/store", "--dataset", "trades", "--symbol", "A", "B"], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"jobs": 2, "searched": 2, "skipped": 0, "found": 1, "uncertain": 0}
