"""The Parquet cache of raw archives: which files hold a range of days, building what isn't there yet, and reading it.

The ledger is a table of the snapshot store with one row a file: its status, rows, bytes, digest and notes. Files are built in batches,
each of which is recorded when it is written, so a build that was stopped goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.plans import catalog
from tidemark.plans.store import SnapshotStore
from tidemark.session import materialise, scratch
from tidemark.sources import archives, zip_source

#: What a fetch says of a file. ``here`` is one that can be read; the others are final states.
OK, MISSING, MISSING_404, NETWORK, ERROR, SKIPPED = "ok", "missing", "missing_404", "network_error", "error", "skipped"
STATES = (OK, MISSING, MISSING_404, NETWORK, ERROR, SKIPPED)
LEDGER = "raw_files"
SOURCE = ("market", "dataset_type", "symbol", "interval")
PREVIEW = 20

#: (url, path) -> None if the file now is at the path, or one of the states above. What it raises is a network error.
Fetch = Callable[[str, str], str | None]


def cover(requests: DataFrame, files: DataFrame | None = None, cadence: str = "daily", prefer_monthly: bool = False) -> DataFrame:
    """The fewest files that hold all days of ``requests`` (market, dataset_type, symbol, interval, start, end; both days included).

    With ``prefer_monthly`` a month that is asked for whole is one monthly file, unless ``files`` records that there is none; the
    days of other months are daily files. Else all files have the ``cadence``, and a month is taken whole if any of its days is.
    Requests may overlap: a day is taken once. (market, dataset_type, symbol, interval, cadence, date, first_day, last_day, days)
    """
    if cadence not in ("daily", "monthly"):
        raise ValueError(f"unknown cadence {cadence!r}")
    first, last = F.col("start").cast("date"), F.col("end").cast("date")
    days = requests.where(first <= last).select(*SOURCE, F.explode(F.sequence(first, last)).alias("day")).distinct()
    month = F.date_format("day", "yyyy-MM")
    monthly: Column = F.lit(cadence == "monthly")
    if prefer_monthly:
        in_month = F.count(F.lit(1)).over(ordered.Window.partitionBy(*SOURCE, "month"))
        days = days.withColumn("month", month).withColumn("whole", in_month == F.day(F.last_day("day"))).withColumn("gone", F.lit(False))
        if files is not None:
            gone = files.where("cadence = 'monthly' AND NOT exists").select(*SOURCE, F.col("date").alias("month"), F.lit(True).alias("known_gone")).distinct()
            days = ordered.beside(days, gone, [*SOURCE, "month"], "left").withColumn("gone", F.coalesce("known_gone", F.lit(False)))
        monthly = F.col("whole") & ~F.col("gone")
    placed = days.select(*SOURCE, F.when(monthly, "monthly").otherwise("daily").alias("cadence"), F.when(monthly, month).otherwise(F.date_format("day", "yyyy-MM-dd")).alias("date"), "day")
    return placed.groupBy(*SOURCE, "cadence", "date").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days"))


def outstanding(tasks: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """The tasks that aren't recorded as built."""
    if ledger is None:
        return tasks
    built = ledger.where(F.col("status") == OK).select(*catalog.FILE_KEY, F.lit(True).alias("__built"))
    return ordered.beside(tasks, built, catalog.FILE_KEY, "left").where("__built IS NULL").drop("__built")


@dataclass
class RawCache:
    """Tasks, status and scans of one cache.

    ``root``: the Parquet table, with the store beside it. ``archive_root``: where archives lie, in a folder for each market,
    below it as below ``base_url``. ``fetch``, if given, brings those that aren't there.
    """

    spark: SparkSession
    root: str
    archive_root: str
    base_url: str = ""
    fetch: Fetch | None = None
    batch: int = 500
    manifests: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.store = SnapshotStore(self.spark, f"{self.root.rstrip('/')}_ledger")

    # Plan

    def plan(self, market: str, dataset_type: str, symbol: str, start: str, end: str, interval: str | None = None, cadence: str = "daily", prefer_monthly: bool = False, files: DataFrame | None = None) -> DataFrame:
        """Tasks of one source; ``start`` and ``end`` are YYYY, YYYY-MM or YYYY-MM-DD."""
        days = [str(catalog.period(start)[0]), str(catalog.period(end)[1])]
        return self.plan_all(self.spark.createDataFrame([(market, dataset_type, symbol, interval, *days)], ", ".join(f"{c} string" for c in (*SOURCE, "start", "end"))), cadence, prefer_monthly, files)

    def plan_all(self, requests: DataFrame, cadence: str = "daily", prefer_monthly: bool = False, files: DataFrame | None = None) -> DataFrame:
        """``cover`` with where each file is, there and here."""
        tasks = cover(requests, files, cadence, prefer_monthly)
        below = catalog.url("", *[F.col(c) for c in ("cadence", "dataset_type", "symbol", "interval", "date")])
        return tasks.withColumns({"remote_url": F.concat(F.lit(self.base_url.rstrip("/")), below), "path": F.concat(F.lit(self.archive_root.rstrip("/") + "/"), "market", below)})

    def ledger(self) -> DataFrame | None:
        return self.store.read(LEDGER)

    # Build

    def build(self, tasks: DataFrame, force_rebuild: bool = False, manifest_name: str = "cache") -> dict:
        """Builds what isn't recorded as built (all with ``force_rebuild``) and gives the counts of each state, and the first urls of each.

        A file that couldn't be had or read is tried again by the next build. A date is written again whole, so a batch that was stopped
        leaves nothing twice.
        """
        tasks = materialise(tasks)
        left = materialise(tasks if force_rebuild else outstanding(tasks, self.ledger()))
        placed, _ = ordered.number(left, "date", ties=[c for c in catalog.FILE_KEY if c != "date"], rows_per_block=self.batch)
        placed = materialise(placed.drop(ordered.RN))
        parts = (placed.agg(F.max(ordered.BLOCK)).first()[0] or 0) + 1 if not placed.isEmpty() else 0
        for part in range(parts):
            with scratch(self.spark):
                self._build(placed.where(F.col(ordered.BLOCK) == part).drop(ordered.BLOCK))
        known = self.ledger()
        states = dict.fromkeys(STATES, 0)
        previews: dict[str, list[str]] = {s: [] for s in STATES}
        if known is not None:
            ended = ordered.beside(left.select(*catalog.FILE_KEY, "remote_url"), known.select(*catalog.FILE_KEY, "status"), catalog.FILE_KEY)
            for r in ended.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_list("remote_url")), 1, PREVIEW).alias("urls")).collect():
                states[r["status"]], previews[r["status"]] = r["n"], r["urls"]
        states[SKIPPED] = tasks.count() - left.count()
        manifest = {"name": manifest_name, "ledger_version": self.store.version(LEDGER), "summary": states, **{f"{s}_preview": previews[s] for s in STATES if s != SKIPPED}}
        self.manifests.append(manifest)
        return manifest

    def _build(self, tasks: DataFrame) -> None:
        """One batch: fetched, decoded once, written, recorded."""
        located = materialise(self._located(tasks))
        told: list[DataFrame] = []
        for (dataset,) in located.where("status = 'here'").select("dataset_type").distinct().collect():
            here = located.where((F.col("status") == "here") & (F.col("dataset_type") == dataset)).select("path", *catalog.FILE_KEY)
            paths = [r[0] for r in here.select("path").collect()]  # a batch at most
            every = materialise(zip_source.read(self.spark, paths, dataset))
            told.append(archives.manifest_of(every))
            failed = [r[0] for r in told[-1].where("error IS NOT NULL").select("path").distinct().collect()]
            rows = archives.rows_of(every, dataset).drop("_member", *archives.PARTITIONS).withColumn("path", F.col(f"{archives.ORDINAL}._path"))
            archives.write_cache(rows.where(~F.col("path").isin(failed)).join(F.broadcast(here), "path").drop("path"), self.root)
        ends = told[0] if told else None
        for more in told[1:]:
            ends = ends.unionByName(more)
        self.store.upsert(LEDGER, self._ended(located, ends), always=("status", "rows", "bytes", "digest", "note", "error", "remote_url", "path", "built_at"))

    def _located(self, tasks: DataFrame) -> DataFrame:
        """``tasks`` with status (here, or why not) and error. Files are fetched by the tasks of a job, several at a time."""
        fetch = self.fetch

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [_locate(u, p, fetch) for u, p in zip(batch["remote_url"], batch["path"])]
                yield batch.assign(status=[s for s, _ in found], error=pd.Series([e for _, e in found], index=batch.index, dtype="object"))

        kept = tasks.select(*catalog.FILE_KEY, "remote_url", "path")
        spread = max(1, min(self.spark.sparkContext.defaultParallelism, self.batch))
        return kept.repartition(spread).mapInPandas(run, ", ".join(f"{c} string" for c in (*kept.columns, "status", "error")))

    def _ended(self, located: DataFrame, ends: DataFrame | None) -> DataFrame:
        """The ledger's rows of a batch."""
        counts = {"rows": "long", "bytes": "long", "digest": "string", "note": "string"}
        if ends is None:
            done = located.withColumns({c: F.lit(None).cast(t) for c, t in counts.items()})
        else:
            of = ends.groupBy("path").agg(
                F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.array_join(F.array_sort(F.collect_list("digest")), " ").alias("digest"),
                F.array_join(F.array_sort(F.collect_set("note")), "; ").alias("note"), F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("failed"), F.count("member").alias("members"),
            )
            here, failed = F.col("status") == "here", F.coalesce("failed", F.lit(""))
            joined = located.join(of, "path", "left").withColumn("error", F.when(here & (failed != ""), failed).when(here & (F.coalesce("members", F.lit(0)) == 0), "no CSV member").otherwise(F.col("error")))
            done = joined.withColumn("status", F.when(here & F.col("error").isNull(), OK).when(here, ERROR).otherwise(F.col("status")))
        return done.select(*catalog.FILE_KEY, "status", *counts, "error", "remote_url", "path", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("built_at"))

    # Scan

    def scan(self, market: str, dataset_type: str, symbol: str, start: str, end: str, interval: str | None = None, cadence: str | None = None, columns: Sequence[str] | None = None) -> DataFrame | None:
        """Rows of the files that hold days of a range, lazily; None if there are none. Without a ``cadence`` a month's file goes before those of its days, so no day comes twice.

        Only the source's own folder is listed, and the filter falls on its partitions. A monthly file gives all its days.
        """
        known = self.ledger()
        if known is None:
            return None
        own = (F.col("market") == market) & (F.col("dataset_type") == dataset_type) & (F.col("symbol") == symbol) & F.col("interval").eqNullSafe(F.lit(interval)) & (F.col("status") == OK) & (F.col("rows") > 0)
        first, last = str(catalog.period(start)[0]), str(catalog.period(end)[1])
        within = F.col("date").between(F.lit(first).substr(F.lit(1), F.length("date")), F.lit(last).substr(F.lit(1), F.length("date")))
        picks = [tuple(r) for r in known.where(own & within).select("cadence", "date").collect()]  # the files of one source
        if cadence:
            picks = [p for p in picks if p[0] == cadence]
        months = {d for c, d in picks if c == "monthly"}
        days = [d for c, d in picks if c == "daily" and d[:7] not in months]
        if not months and not days:
            return None
        folder = f"market={market}/dataset_type={dataset_type}/symbol={symbol}/interval={interval if interval is not None else '__HIVE_DEFAULT_PARTITION__'}"
        rows = self.spark.read.option("basePath", self.root).option("mergeSchema", "true").parquet(f"{self.root}/{folder}")
        date = F.col("date").cast("string")
        wanted = rows.where(((F.col("cadence") == "monthly") & date.isin(sorted(months))) | ((F.col("cadence") == "daily") & date.isin(days)))
        return wanted.select(*[c for c in columns if c in wanted.columns]) if columns else wanted.drop(*archives.PARTITIONS)

    def reader(self, prefer_monthly: bool = False) -> Callable:
        """A reader for ``builder.build``: plans, builds and scans each selection. Manifests are kept in ``manifests``."""

        def read(s) -> DataFrame:
            tasks = self.plan(s.market, s.dataset_type, s.symbol, s.start, s.end, s.interval, s.cadence, prefer_monthly)
            manifest = self.build(tasks, manifest_name=f"cache_{s.market}_{s.symbol}_{s.dataset_type}_{s.cadence}")
            found = self.scan(s.market, s.dataset_type, s.symbol, s.start, s.end, s.interval, None if prefer_monthly else s.cadence)
            if found is None:
                raise ValueError(f"no file of {s.symbol} {s.dataset_type} from {s.start} to {s.end}: {manifest['summary']}")
            return found

        return read


def _locate(url: str, path: str, fetch: Fetch | None) -> tuple[str, str | None]:
    """Where a file stands: here, or why not."""
    try:
        system, inner = zip_source.file_system(path)
        if system.get_file_info(inner).type == pa.fs.FileType.File:
            return "here", None
        if fetch is None:
            return MISSING, None
        return fetch(url, path) or "here", None
    except Exception as e:  # noqa: BLE001  whatever a fetch meets, the file can't be had now
        return NETWORK, str(e) or type(e).__name__
