"""The file catalog as DataFrames: expected files, upserts, coverage and missing dates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.session import materialise

#: The symbols that menus are built for unless others are named.
SYMBOLS = ("BTCUSDT", "ETHUSDT", "BNBUSDT", "SOLUSDT", "XRPUSDT", "ADAUSDT", "DOGEUSDT", "TRXUSDT", "AVAXUSDT", "TONUSDT")
#: Datasets of single events; others are bars or snapshots.
EVENT_STREAMS = ("trades", "aggTrades", "bookTicker")

KEY = ("market", "dataset_type", "symbol", "interval", "cadence")
FILE_KEY = (*KEY, "date")
FILES_DDL = "market string, dataset_type string, symbol string, interval string, cadence string, date string, remote_url string, exists boolean, remote_size long, last_modified string, etag string, local_path string, local_size long, downloaded_at string, notes string"


def dates(spark: SparkSession, start: str, end: str, cadence: str = "daily") -> DataFrame:
    """(date): YYYY-MM-DD of each day, or YYYY-MM of each month, both ends included."""
    if cadence not in ("daily", "monthly"):
        raise ValueError(f"unknown cadence {cadence!r}")
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    step = "interval 1 day" if cadence == "daily" else "interval 1 month"
    if cadence == "monthly":
        first, last = F.trunc(first, "month"), F.trunc(last, "month")
    days = spark.range(1).select(F.when(first <= last, F.sequence(first, last, F.expr(step))).alias("d"))
    return days.select(F.explode("d").alias("d")).select(F.date_format("d", "yyyy-MM-dd" if cadence == "daily" else "yyyy-MM").alias("date"))


def url(base: str, cadence: Column, dataset: Column, symbol: Column, interval: Column, day: Column) -> Column:
    """Where a file lies: bars have a folder for each interval, other datasets don't."""
    name = F.coalesce(interval, dataset)
    folder = F.concat_ws("/", F.lit(base.rstrip("/")), cadence, dataset, symbol, interval)
    return F.concat(folder, F.lit("/"), F.concat_ws("-", symbol, name, day), F.lit(".zip"))


def expected_files(spark: SparkSession, market: str, symbols: Sequence[str], datasets: Sequence[tuple[str, str | None]], start: str, end: str, cadence: str, base: str) -> DataFrame:
    """Every file that a menu asks for: symbols x (dataset, interval) x dates, from two driver-side lists."""
    jobs = spark.createDataFrame([(market, d, s, i, cadence) for s in symbols for d, i in datasets], "market string, dataset_type string, symbol string, interval string, cadence string")
    days = dates(spark, start, end, cadence).agg(F.collect_list("date").alias("days"))
    days_list = days.first()["days"]  # one entry a day
    made = jobs.withColumn("date", F.explode(F.array(*[F.lit(d) for d in days_list]) if days_list else F.array().cast("array<string>")))
    return made.withColumn("remote_url", url(base, F.col("cadence"), F.col("dataset_type"), F.col("symbol"), F.col("interval"), F.col("date")))


def with_probe(files: DataFrame, probe: Callable[[str], dict | None]) -> DataFrame:
    """Adds exists, remote_size, last_modified and etag from ``probe(url)``; None or an error is a file that doesn't exist."""
    fields = ("remote_size", "last_modified", "etag")

    @F.pandas_udf("exists boolean, remote_size long, last_modified string, etag string")
    def ask(urls: pd.Series) -> pd.DataFrame:
        rows = []
        for u in urls:
            try:
                found = probe(u)
            except Exception:  # noqa: BLE001  whatever goes wrong, the file can't be had
                found = None
            rows.append((found is not None, *[(found or {}).get(f) for f in fields]))
        return pd.DataFrame(rows, columns=["exists", *fields]).astype({"remote_size": "Int64"})

    return files.withColumn("__p", ask("remote_url")).select(*files.columns, "__p.*")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str] = FILE_KEY, always: Sequence[str] = ("exists", "remote_url")) -> DataFrame:
    """Rows of both by key; where both have one, new values win unless they are null. ``always`` columns are taken from the new row as they are."""
    value = [c for c in old.columns if c not in key]
    new = new.select(*key, *[F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in value])
    a, b = old.withColumn("__old", F.lit(True)).alias("a"), new.withColumn("__new", F.lit(True)).alias("b")
    same = None
    for k in key:
        test = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        same = test if same is None else same & test
    joined = a.join(b, same, "full")
    is_new = F.col("b.__new").isNotNull()
    pick = lambda c: F.when(is_new, F.col(f"b.{c}") if c in always else F.coalesce(f"b.{c}", f"a.{c}")).otherwise(F.col(f"a.{c}"))
    return joined.select(*[F.when(is_new, F.col(f"b.{k}")).otherwise(F.col(f"a.{k}")).alias(k) for k in key], *[pick(c).alias(c) for c in value])


def register(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Adds the rows whose key isn't there yet."""
    return old.unionByName(new.dropDuplicates(list(key)).join(old, list(key), "left_anti").select(*old.columns))


def migrate(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Adds missing columns, and fills nulls with their defaults: name -> (type, default)."""
    for name, (kind, default) in columns.items():
        c = F.col(name) if name in df.columns else F.lit(None).cast(kind)
        df = df.withColumn(name, c if default is None else F.coalesce(c, F.lit(default).cast(kind)))
    return df


def coverage(files: DataFrame) -> DataFrame:
    """One row for each source that has a file: first and last date, counts, missing dates in order, total size."""
    there = F.col("exists")
    grouped = files.groupBy(*KEY).agg(
        F.min(F.when(there, F.col("date"))).alias("start_date"), F.max(F.when(there, F.col("date"))).alias("end_date"),
        F.count_if(there).alias("num_files"), F.count_if(~there).alias("num_missing"),
        F.array_sort(F.collect_list(F.when(~there, F.col("date")))).alias("missing_dates"),
        F.sum(F.when(there, F.coalesce("remote_size", F.lit(0)))).alias("total_size_estimate"),
    )
    return grouped.where("num_files > 0").withColumn("size_mb", F.round(F.coalesce("total_size_estimate", F.lit(0)) / 1024 / 1024, 2))


def upsert_coverage(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, KEY, [c for c in old.columns if c not in KEY])


def coverage_of(covered: DataFrame, market: str, dataset: str, symbol: str, interval: str | None = None) -> DataFrame:
    """The first row of a source, whatever its cadence."""
    return covered.where((F.col("market") == market) & (F.col("dataset_type") == dataset) & (F.col("symbol") == symbol) & F.col("interval").eqNullSafe(F.lit(interval))).orderBy("cadence").limit(1)


def missing_dates(files: DataFrame, dataset: str, symbol: str, start: str, end: str, interval: str | None = None) -> DataFrame:
    """Recorded dates without a file. A date that was never looked at isn't missing."""
    wanted = (F.col("dataset_type") == dataset) & (F.col("symbol") == symbol) & F.col("date").between(start, end) & ~F.col("exists")
    return files.where(wanted & F.col("interval").eqNullSafe(F.lit(interval))).select("date").distinct().orderBy("date")


def to_download(files: DataFrame, market: str, dataset: str, symbol: str, start: str, end: str, interval: str | None = None) -> DataFrame:
    """Existing files of a range that aren't there in full."""
    wanted = (F.col("market") == market) & (F.col("dataset_type") == dataset) & (F.col("symbol") == symbol) & F.col("date").between(start, end) & F.col("exists")
    here = F.coalesce(F.col("local_size") == F.col("remote_size"), F.lit(False))
    return files.where(wanted & F.col("interval").eqNullSafe(F.lit(interval)) & ~here).orderBy("date")


def schema_samples(covered: DataFrame, base: str) -> DataFrame:
    """One file to inspect for each dataset, interval and cadence: the first date of the first symbol that has any."""
    w = Window.partitionBy("dataset_type", "interval", "cadence").orderBy("symbol", "market")
    first = covered.where("coalesce(start_date, '') != ''").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return first.withColumn("remote_url", url(base, F.col("cadence"), F.col("dataset_type"), F.col("symbol"), F.col("interval"), F.col("start_date")))


def first_true(holds: Callable[[int], bool], low: int, high: int) -> int | None:
    """The first number of ``[low, high]`` that holds, if all from there to ``high`` do: doubling steps back, then halving."""
    if not holds(high):
        return None
    step, known = 1, high
    while known > low:
        at = max(low, known - step)
        if holds(at):
            known, step = at, step * 2
            continue
        low = at + 1
        while low < known:
            middle = low + (known - low) // 2
            low, known = (low, middle) if holds(middle) else (middle + 1, known)
    return known


def edge(holds: Callable[[int], bool], start: int, stop: int) -> int | None:
    """The number nearest to ``start``, in the direction of ``stop``, that holds, if from there on all do as far as the first that is met: doubling steps, then halving."""
    sign, at, step, miss = 1 if stop >= start else -1, start, 1, None
    while not holds(at):
        if at == stop:
            return None
        miss, at, step = at, min(at + step, stop) if sign > 0 else max(at - step, stop), step * 2
    while miss is not None and abs(at - miss) > 1:
        middle = miss + sign * (abs(at - miss) // 2)
        at, miss = (middle, miss) if holds(middle) else (at, middle)
    return at


#: Days of a month that are asked for where steps have met nothing; and its last one.
SCAN_DAYS = (1, 8, 15, 22)


def scan_months(holds: Callable[[int], bool], start: int, stop: int) -> int | None:
    """As ``edge`` for days (ordinals) that steps would pass over: the first month, from ``start`` on, in which one of five days holds is searched day by day."""
    forward = stop >= start
    low, high = min(start, stop), max(start, stop)
    months = range((first := date.fromordinal(low)).year * 12 + first.month - 1, (last := date.fromordinal(high)).year * 12 + last.month)
    for m in months if forward else reversed(months):
        begin, end = date(m // 12, m % 12 + 1, 1).toordinal(), date((m + 1) // 12, (m + 1) % 12 + 1, 1).toordinal() - 1
        asked = [n for n in dict.fromkeys([*[begin + d - 1 for d in SCAN_DAYS], end]) if low <= n <= high]
        if any(holds(n) for n in asked):
            days = range(max(begin, low), min(end, high) + 1)
            return next(n for n in (days if forward else reversed(days)) if holds(n))
    return None


def find_range(exists: Callable[[date], bool], low: date, high: date, cadence: str = "daily") -> tuple[date, date] | None:
    """The first and last day, or first of a month, with a file between ``low`` and ``high``; None if none is met.

    Steps from both ends find the edges of files that run on without a gap. Where they meet nothing (few days among many), months are
    scanned by five of their days, so a source without a file on any of these isn't found. A date is asked for once.
    """
    if cadence not in ("daily", "monthly"):
        raise ValueError(f"unknown cadence {cadence!r}")
    day = date.fromordinal if cadence == "daily" else lambda n: date(n // 12, n % 12 + 1, 1)
    number = date.toordinal if cadence == "daily" else lambda d: d.year * 12 + d.month - 1
    known: dict[int, bool] = {}

    def holds(n: int) -> bool:
        if n not in known:
            known[n] = exists(day(n))
        return known[n]

    first, last = number(low), number(high)
    if first > last:
        return None
    ends = []
    for start, stop in ((last, first), (first, last)):
        found = edge(holds, start, stop)
        if found is None and cadence == "daily":
            found = scan_months(holds, start, stop)
        if found is None:
            return None
        ends.append(found)
    return day(min(ends)), day(max(ends))


def discover(sources: DataFrame, probe: Callable[[str], dict | None], base: str, low: date, high: date) -> DataFrame:
    """``sources`` (KEY) with start_date, end_date (empty if there is no file), probes, network_errors and last_error. Each source is searched in a task of its own; ``probe`` gives None for a file that isn't there, and raises if it can't tell."""
    sources = sources.select(*KEY)
    ddl = ", ".join(f"{k} string" for k in KEY) + ", start_date string, end_date string, probes long, network_errors long, last_error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                asked, errors = [0], []

                def exists(day: date, row=row, asked=asked, errors=errors) -> bool:
                    asked[0] += 1
                    text = day.isoformat()[: 10 if row.cadence == "daily" else 7]
                    parts = [row.cadence, row.dataset_type, row.symbol, *([row.interval] if row.interval else [])]
                    try:
                        return probe(f"{base.rstrip('/')}/{'/'.join(parts)}/{row.symbol}-{row.interval or row.dataset_type}-{text}.zip") is not None
                    except Exception as e:  # noqa: BLE001  whatever goes wrong, the file can't be seen
                        errors.append(str(e) or type(e).__name__)
                        return False

                found = find_range(exists, low, high, row.cadence)
                ends = [d.isoformat()[: 10 if row.cadence == "daily" else 7] for d in found] if found else ["", ""]
                yield pd.DataFrame([[*row, *ends, asked[0], len(errors), errors[-1] if errors else None]], columns=[*KEY, "start_date", "end_date", "probes", "network_errors", "last_error"]).astype(object)

    tasks = max(1, sources.sparkSession.sparkContext.defaultParallelism)
    return sources.repartition(tasks).mapInPandas(run, ddl)


def _ordinal(cadence: Column, day: Column) -> Column:
    """Dates of a cadence as numbers without a gap."""
    whole = F.to_date(F.rpad(day, 10, "-01"))
    return F.when(cadence == "daily", F.datediff(whole, F.lit("1970-01-01").cast("date"))).otherwise(F.year(whole) * 12 + F.month(whole))


def islands(files: DataFrame) -> DataFrame:
    """(KEY, start_date, end_date, n): runs of dates, one after another, that have files."""
    there = files.where("exists").select(*KEY, "date").distinct().withColumn("at", _ordinal(F.col("cadence"), F.col("date")))
    run = F.col("at") - F.row_number().over(Window.partitionBy(*KEY).orderBy("at"))
    return there.withColumn("run", run).groupBy(*KEY, "run").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count(F.lit(1)).alias("n")).drop("run")


def gaps(files: DataFrame) -> DataFrame:
    """(KEY, after, before, n): between one island and the next, the dates with files on either side and how many are without."""
    w = Window.partitionBy(*KEY).orderBy("start_date")
    held = islands(files).withColumn("before", F.lead("start_date").over(w)).where("before IS NOT NULL").withColumnRenamed("end_date", "after")
    n = _ordinal(F.col("cadence"), F.col("before")) - _ordinal(F.col("cadence"), F.col("after")) - 1
    return held.select(*KEY, "after", "before", n.cast("long").alias("n"))


def menu_jobs(spark: SparkSession, markets: dict[str, Sequence[str]], symbols: Sequence[str] = SYMBOLS, intervals: Sequence[str] = ("1h",), monthly: bool = False) -> DataFrame:
    """(KEY): every source that a menu may list: for each market its datasets, by interval where they are bars."""
    jobs = [
        (market, dataset, symbol, interval, cadence)
        for market, datasets in markets.items() for symbol in symbols for dataset in datasets
        for interval in (intervals if "klines" in dataset.lower() else [None]) for cadence in (["daily", "monthly"] if monthly else ["daily"])
    ]
    return spark.createDataFrame(jobs, ", ".join(f"{k} string" for k in KEY))


def menu_build(store, jobs: DataFrame, probe: Callable[[str], dict | None], base: str, low: date, high: date, batch: int = 50, name: str = "coverage") -> dict[str, int]:
    """Finds the ranges of ``jobs`` and records them in the store's table, ``batch`` at a time; a run that was stopped goes on with what isn't recorded.

    A source without files is recorded with an empty range. One whose search met network errors is recorded, and searched again by the next run.
    """
    spark, recorded = jobs.sparkSession, store.read(name)
    done = recorded.where("network_errors = 0").select(*KEY, F.lit(True).alias("done")) if recorded is not None else None
    left = jobs.distinct() if done is None else ordered.beside(jobs.distinct(), done, KEY, "left").where("done IS NULL").select(*KEY)
    waiting = [tuple(r) for r in left.orderBy(*KEY).collect()]  # a menu: markets by symbols by datasets
    total = jobs.distinct().count()
    for at in range(0, len(waiting), batch):
        part = spark.createDataFrame(waiting[at : at + batch], ", ".join(f"{k} string" for k in KEY))
        store.upsert(name, materialise(discover(part, probe, base, low, high)), KEY, ("start_date", "end_date", "probes", "network_errors", "last_error"))
    now = store.read(name)
    counts = ordered.beside(jobs.distinct(), now, KEY).agg(F.count_if(F.col("start_date") != "").alias("found"), F.count_if(F.col("network_errors") > 0).alias("uncertain")).first() if now is not None else None
    return {"jobs": total, "searched": len(waiting), "skipped": total - len(waiting), "found": counts["found"] if counts else 0, "uncertain": counts["uncertain"] if counts else 0}


def menu_row(covered: DataFrame, dataset: str, cadence: str, interval: str | None = None, symbol: str | None = None) -> DataFrame:
    """The row of a menu that a choice of dataset, cadence and interval names, if there is one; only bars have an interval."""
    chosen = interval if "klines" in dataset.lower() else None
    same = (F.col("dataset_type") == dataset) & (F.col("cadence") == cadence) & F.col("interval").eqNullSafe(F.lit(chosen).cast("string"))
    return covered.where(same & (F.col("symbol") == symbol if symbol else F.lit(True))).orderBy("market", "symbol").limit(1)


def folder_probe(base: str, folder: str) -> Callable[[str], dict | None]:
    """A probe of a mirror: the file below ``folder`` that lies where the url lies below ``base``."""

    def probe(url: str) -> dict | None:
        from tidemark.sources.zip_source import file_system

        system, inner = file_system(folder.rstrip("/") + "/" + url.removeprefix(base.rstrip("/")).lstrip("/"))
        info = system.get_file_info(inner)
        return {"remote_size": info.size} if info.is_file else None

    return probe


def first_available(exists: Callable[[date], bool], low: date, high: date, cadence: str = "daily") -> date | None:
    """The first day, or first of a month, with a file; files are taken to run on without a gap to ``high``."""
    if cadence == "daily":
        found = first_true(lambda n: exists(date.fromordinal(n)), low.toordinal(), high.toordinal())
        return date.fromordinal(found) if found else None
    month = lambda n: date(n // 12, n % 12 + 1, 1)
    found = first_true(lambda n: exists(month(n)), low.year * 12 + low.month - 1, high.year * 12 + high.month - 1)
    return month(found) if found else None


def period(text: str) -> tuple[date, date]:
    """First and last day of YYYY, YYYY-MM or YYYY-MM-DD."""
    parts = [int(p) for p in text.split("-")]
    if len(parts) == 1:
        return date(parts[0], 1, 1), date(parts[0], 12, 31)
    if len(parts) == 2:
        following = date(parts[0] + parts[1] // 12, parts[1] % 12 + 1, 1)
        return date(*parts, 1), following - timedelta(days=1)
    return date(*parts), date(*parts)
