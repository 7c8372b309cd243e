"""Command line: ``python -m tidemark.cli COMMAND ...``.

formulas        columns from formulas over a Parquet table
coverage        coverage of a catalog table of files
schema-inspect  what a CSV archive holds
cache-build     the files of a source and range, from a folder of archives into the cache
menu-build      ranges of all sources of a menu, recorded as they are found
recipe-check    a recipe against a catalog and registered schemas
recipe-execute  a recipe over the cache
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.formulas import ColumnSpec, FormulaEngine
from tidemark.plans import builder, cache, catalog
from tidemark.plans.store import SnapshotStore
from tidemark.session import session
from tidemark.sources import archives, recipes, schemas


def read_formulas(path: str) -> list[ColumnSpec]:
    """Lines of a name and a formula with a tab between."""
    return [ColumnSpec(*line.split("\t", 1)) for line in Path(path).read_text(encoding="utf-8").splitlines() if line.strip()]


def formulas(spark: SparkSession, a: argparse.Namespace) -> None:
    engine = FormulaEngine(a.order, a.partition_by or [])
    df, specs = spark.read.parquet(a.table), read_formulas(a.formulas)
    made, errors = engine.apply(df, specs)
    if a.only_new:
        made = made.select(*[c for c in made.columns if c not in df.columns], *engine.partition_by, a.order)
    made.write.mode("overwrite").parquet(a.output)
    print(json.dumps({"columns": made.columns, "rows": spark.read.parquet(a.output).count(), "errors": errors}, indent=2))


def coverage(spark: SparkSession, a: argparse.Namespace) -> None:
    covered = catalog.coverage(spark.read.parquet(a.files))
    if a.symbol:
        covered = covered.where(F.col("symbol").isin(a.symbol))
    covered.orderBy("symbol", "dataset_type", "interval", "cadence").show(a.rows, truncate=False)


def schema_inspect(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = archives.read_archives(spark, a.archives, a.dataset, first_member_only=True).drop("_member", archives.ORDINAL)
    print(json.dumps(schemas.inspect(rows, a.dataset), indent=2))


def cache_build(spark: SparkSession, a: argparse.Namespace) -> None:
    held = cache.RawCache(spark, a.cache, a.archives, a.base)
    tasks = held.plan(a.market, a.dataset, a.symbol, a.start, a.end, a.interval, a.cadence, a.prefer_monthly)
    print(json.dumps(held.build(tasks, a.force, f"cache_{a.market}_{a.symbol}_{a.dataset}_{a.cadence}"), indent=2))


def menu_build(spark: SparkSession, a: argparse.Namespace) -> None:
    jobs = catalog.menu_jobs(spark, {a.market: a.dataset}, a.symbol or catalog.SYMBOLS, a.interval or ("1h",), a.monthly)
    low, high = catalog.period(a.start)[0], catalog.period(a.end)[1]
    print(json.dumps(catalog.menu_build(SnapshotStore(spark, a.store), jobs, catalog.folder_probe(a.base, a.archives), a.base, low, high), indent=2))


def _registry(spark: SparkSession, path: str | None) -> schemas.SchemaRegistry:
    return schemas.SchemaRegistry.from_df(spark.read.parquet(path)) if path else schemas.SchemaRegistry(spark)


def recipe_check(spark: SparkSession, a: argparse.Namespace) -> int:
    errors = builder.validate(recipes.load_recipe(a.recipe), spark.read.parquet(a.files), _registry(spark, a.schemas))
    print("\n".join(errors) or "valid")
    return int(bool(errors))


def recipe_execute(spark: SparkSession, a: argparse.Namespace) -> int:
    recipe, registry = recipes.load_recipe(a.recipe), _registry(spark, a.schemas)
    if a.files and not a.force and (errors := builder.validate(recipe, spark.read.parquet(a.files), registry)):
        print("\n".join(errors))
        return 1

    def read(symbol: str, source: recipes.InputSource) -> DataFrame:
        where = {"dataset_type": source.dataset_type, "symbol": symbol} | ({"interval": source.interval} if source.interval else {})
        return archives.scan_cache(spark, a.cache, dates=(recipe.time_range["start"], recipe.time_range["end"]), **where)

    _, manifest = builder.execute(recipe, read, registry, a.output)
    print(json.dumps(manifest, indent=2))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(required=True)

    def command(name: str, run, *options: tuple) -> None:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for flags, more in options:
            c.add_argument(*flags.split(), **more)

    need, flag = {"required": True}, {"action": "store_true"}
    command("formulas", formulas, ("--table", need), ("--formulas", need), ("--output", need), ("--order", {"default": "ts"}), ("--partition-by", {"nargs": "*"}), ("--only-new", flag))
    command("coverage", coverage, ("--files", need), ("--symbol", {"nargs": "*"}), ("--rows", {"type": int, "default": 100}))
    command("schema-inspect", schema_inspect, ("--dataset", need), ("archives", {"nargs": "+"}))
    source = [("--market", need), ("--archives", need), ("--base", {"default": ""}), ("--start", need), ("--end", need)]
    command("cache-build", cache_build, *source, ("--cache", need), ("--dataset", need), ("--symbol", need), ("--interval", {}), ("--cadence", {"default": "daily", "choices": ["daily", "monthly"]}), ("--prefer-monthly", flag), ("--force", flag))
    command("menu-build", menu_build, *source, ("--store", need), ("--dataset", need | {"nargs": "+"}), ("--symbol", {"nargs": "*"}), ("--interval", {"nargs": "*"}), ("--monthly", flag))
    command("recipe-check", recipe_check, ("--recipe", need), ("--files", need), ("--schemas", {}))
    command("recipe-execute", recipe_execute, ("--recipe", need), ("--cache", need), ("--output", need), ("--files", {}), ("--schemas", {}), ("--force", flag))
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    return a.run(spark or session("tidemark-cli"), a) or 0


if __name__ == "__main__":
    raise SystemExit(main())
