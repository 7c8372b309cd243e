"""Datasets from selections (anchored wide tables) and from recipes (joined long tables)."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import align, processors
from tidemark.plans import catalog
from tidemark.session import materialise
from tidemark.sources.recipes import InputSource, Recipe
from tidemark.sources.schemas import SchemaRegistry


@dataclass
class Selection:
    """One source of a wide table."""

    market: str
    dataset_type: str
    symbol: str
    start: str
    end: str
    interval: str | None = None
    cadence: str = "daily"
    columns: list[str] | None = None
    time_key: str | None = None


@dataclass
class BuildConfig:
    selections: list[Selection]
    anchor_index: int = 0
    fill: str = "none"
    output: str | None = None
    extra: dict = field(default_factory=dict)


Reader = Callable[[Selection], DataFrame]


#: Where a row stands in its source. A reader that knows better than file and line gives this column itself.
ORDINAL = "__ordinal"


def with_ordinal(raw: DataFrame) -> DataFrame:
    """``raw`` with ORDINAL: the reader's own, else file and line where rows come straight from Parquet files, else the order of partitions."""
    if ORDINAL in raw.columns:
        return raw
    try:
        placed = raw.withColumn(ORDINAL, F.struct("_metadata.file_path", "_metadata.row_index"))
        placed.schema  # noqa: B018 - an unknown column shows here
        return placed
    except AnalysisException:
        return raw.withColumn(ORDINAL, F.monotonically_increasing_id())


def source(selection: Selection, read: Reader) -> DataFrame:
    """A selection's rows: epoch-ms ``ts``, in range, without repeats of a ts (the last row in the source stays), under prefixed names."""
    raw = with_ordinal(read(selection))
    key = align.infer_time_key([c for c in raw.columns if c != ORDINAL], selection.time_key)
    timed = align.normalise_time(raw, key)
    ranged = align.in_range(timed, catalog.period(selection.start)[0], catalog.period(selection.end)[1])
    wanted = [c for c in align.features(ranged, [c for c in selection.columns if c != key] if selection.columns else None) if c != ORDINAL]
    unique = align.dedup(ranged.select("ts", ORDINAL, *wanted), ["ts"], [ORDINAL], "last").select("ts", *wanted)
    return align.prefixed(unique, align.prefix(selection.symbol, selection.dataset_type, selection.interval))


def build(config: BuildConfig, read: Reader) -> tuple[DataFrame, dict]:
    """The wide table, ts last, and a report. Written to ``config.output`` if that is set.

    A selection that can't be read is left out and named in the report's errors, but the anchor must be there. The joined table is
    written once, so that neither the report's counts, before the fill and after it, nor the result read the sources again; the rows of all
    selections are counted in one pass.
    """
    if not config.selections or not 0 <= config.anchor_index < len(config.selections):
        raise ValueError("there is no anchor selection")
    sources, errors = {}, []
    for i, s in enumerate(config.selections):
        try:
            sources[i] = source(s, read)
        except (AnalysisException, OSError, ValueError, KeyError) as e:
            if i == config.anchor_index:
                raise
            errors.append({"selection": i, "error": str(e)})
    counted = reduce(DataFrame.unionByName, [x.select(F.lit(i).alias("i")) for i, x in sources.items()]).groupBy("i").count()
    heights = {i: 0 for i in sources} | {r["i"]: r["count"] for r in counted.collect()}
    if not sum(heights.values()):
        raise ValueError("no selection has rows in its range")
    if not heights[config.anchor_index]:
        raise ValueError("the anchor has no rows in its range")
    anchor = sources[config.anchor_index]
    joined = materialise(align.join_on_anchor(anchor, [x for i, x in sources.items() if i != config.anchor_index]))
    filled = align.fill(joined, config.fill)
    values = align.numeric(filled, ["ts"])
    before = align.null_counts(joined, values).first().asDict()
    after = align.null_counts(filled, values).first().asDict() if config.fill != "none" else before
    out = filled.select(*[c for c in filled.columns if c != "ts"], "ts")
    report = {
        "selections": [asdict(s) for s in config.selections], "anchor_index": config.anchor_index, "fill": config.fill,
        "heights": heights, "errors": errors, "rows": before["rows"], "columns": out.columns,
        "nulls": {c: {"before": before[c], "after": after[c], "filled": before[c] - after[c]} for c in values},
    }
    if config.output:
        out.write.mode("overwrite").parquet(config.output)
    return out, report


def validate(recipe: Recipe, files: DataFrame, registry: SchemaRegistry, market: str | None = None) -> list[str]:
    """What stands against a recipe: missing dates, unknown schemas or columns, and sources without the join key."""
    errors = []
    key = recipe.join_policy.get("key", "open_time")
    scope = files.where(F.col("market") == market) if market else files
    start, end = recipe.time_range["start"], recipe.time_range["end"]
    wanted = {(s, i.dataset_type, i.interval): None for s in recipe.symbols for i in recipe.inputs}
    gone = scope.where(~F.col("exists") & F.col("date").between(start, end)).groupBy("symbol", "dataset_type", "interval").agg(F.array_sort(F.collect_set("date")).alias("dates"))
    found = {(r["symbol"], r["dataset_type"], r["interval"]): r["dates"] for r in gone.where(F.col("symbol").isin(recipe.symbols)).collect()}
    for symbol, dataset, interval in wanted:
        if dates := found.get((symbol, dataset, interval)):
            errors.append(f"{symbol} {dataset}: missing dates {', '.join(dates[:10])}{' ...' if len(dates) > 10 else ''}")
    for i in recipe.inputs:
        schema = registry.get(i.dataset_type)
        if schema is None:
            errors.append(f"{i.dataset_type}: no schema is registered")
            continue
        if unknown := sorted(set(i.columns) - set(schema.columns)):
            errors.append(f"{i.dataset_type}: no columns {', '.join(unknown)}")
        if key not in schema.columns:
            hint = schema.join_key or schema.primary_time_key
            errors.append(f"{i.dataset_type}: no join key {key}" + (f"; {hint} may serve" if hint else ""))
    return errors


def recipe_input(recipe: Recipe, source: InputSource, read: Callable[[str, InputSource], DataFrame], registry: SchemaRegistry | None = None) -> DataFrame:
    """All symbols of one input, with a symbol column and the recipe's join key."""
    key = recipe.join_policy.get("key", "open_time")
    made = None
    for symbol in recipe.symbols:
        raw = processors.process(source.dataset_type, read(symbol, source), source.resample_freq or "1m" if source.resample else None)
        if key not in raw.columns:
            schema = registry.get(source.dataset_type) if registry else None
            own = (schema.join_key or schema.primary_time_key) if schema else None
            own = own if own in raw.columns else align.infer_time_key(raw.columns)
            raw = raw.withColumnRenamed(own, key)
        columns = [c for c in source.columns if c in raw.columns and c not in (key, "symbol")]
        if source.columns and not columns:
            raise ValueError(f"{source.dataset_type} has none of {source.columns}")
        one = raw.select(F.lit(symbol).alias("symbol"), key, *columns)
        made = one if made is None else made.unionByName(one, allowMissingColumns=True)
    return made


def execute(recipe: Recipe, read: Callable[[str, InputSource], DataFrame], registry: SchemaRegistry | None = None, output: str | None = None) -> tuple[DataFrame, dict]:
    """Joins a recipe's inputs on (symbol, key) and gives the result and its manifest.

    A wide result has one row for each key and a column for each symbol and value. A written long result is
    partitioned as the recipe says; ``date`` is derived from an epoch-ms key.
    """
    key = recipe.join_policy.get("key", "open_time")
    inputs = [recipe_input(recipe, i, read, registry) for i in recipe.inputs]
    out = align.join_sources(inputs, ["symbol", key], recipe.join_policy.get("missing", "drop"), order=key)
    if recipe.output_format == "wide":
        values = [c for c in out.columns if c not in ("symbol", key)]
        grouped = out.groupBy(key).pivot("symbol", recipe.symbols).agg(*[F.first(c, ignorenulls=True).alias(c) for c in values])
        out = grouped if len(values) > 1 else grouped.select(key, *[F.col(s).alias(f"{s}_{values[0]}") for s in recipe.symbols])
    manifest = {"name": recipe.name, "recipe": recipe.to_dict(), "columns": out.columns, "row_count": out.count()}
    if output:
        partition = [p for p in recipe.output_store.get("partition_by", []) if p == "date" or p in out.columns]
        made = out.withColumn("date", F.date_format(F.timestamp_millis(align.epoch_ms(F.col(key))), "yyyy-MM-dd")) if "date" in partition and "date" not in out.columns else out
        made.write.mode("overwrite").partitionBy(*partition).parquet(output)
    return out, manifest


def write_report(report: dict, path: str) -> None:
    Path(path).write_text(json.dumps(report, indent=2, ensure_ascii=False, default=str), encoding="utf-8")


def write_formulas(specs: Sequence, path: str) -> None:
    """Formulas as name and formula, a tab between."""
    Path(path).write_text("".join(f"{s.name}\t{s.formula}\n" for s in specs), encoding="utf-8")

