"""Archives as a data source, the snapshot store, and the cache of raw files."""

from __future__ import annotations

import hashlib
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import processors
from tidemark.plans import builder
from tidemark.sources import archives, zip_source

TRADES = "id,price,qty,quote_qty,time,is_buyer_maker\n"


def packed(path, **members):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/") + ".csv", text)
    return str(path)


@pytest.fixture
def folder(tmp_path):
    packed(f"{tmp_path}/a.zip", one=TRADES + "1,10,1,10,1704067200000,true\n2,x,1,11,,false\n", two="3,12,1,12,1704067320000,true\n4,12,1\n5,13,1,13,1704067330000,false", deep__three="price,id,extra\n7.5,6,z\n")
    packed(f"{tmp_path}/sub/b.zip", one="", two=TRADES, three="9,9\n", four="﻿" + TRADES + '8,"1.5",2,3,1704067320000,TRUE\r\n')
    (tmp_path / "bad.zip").write_bytes(b"PK not a zip")
    (tmp_path / "none.zip").write_bytes(b"PK\x05\x06" + bytes(18))
    (tmp_path / "note.txt").write_text("no")
    return tmp_path


def test_members_are_decoded_by_their_own_headers(spark, folder):
    told = zip_source.read(spark, [str(folder)], "trades")
    assert told.rdd.getNumPartitions() == 9  # seven members, a bad archive, one without members
    rows = archives.rows_of(told, "trades")
    got = sorted((r["id"], r["price"], r["qty"], r["time"], r["is_buyer_maker"]) for r in rows.collect())
    t = 1704067200000
    assert got == [(1, 10.0, 1.0, t, True), (2, None, 1.0, None, False), (3, 12.0, 1.0, t + 120_000, True), (5, 13.0, 1.0, t + 130_000, False), (6, 7.5, None, None, None), (8, 1.5, 2.0, t + 120_000, True)]
    bad = [r["_note"] for r in told.where("_kind = 'bad'").collect()]
    assert bad == ["3 fields where 6 are named: 4,12,1"]
    rest = {(r["path"].rsplit("/", 1)[1], r["member"]): r for r in archives.manifest_of(told).collect()}
    assert len(rest) == 9
    one = TRADES + "1,10,1,10,1704067200000,true\n2,x,1,11,,false\n"
    r = rest["a.zip", "one.csv"]
    assert (r["rows"], r["bytes"], r["digest"], r["note"], r["error"]) == (2, len(one), hashlib.md5(one.encode()).hexdigest()[:8], None, None)
    assert (rest["a.zip", "two.csv"]["rows"], rest["a.zip", "two.csv"]["note"]) == (2, "1 lines left out")
    assert rest["a.zip", "deep/three.csv"]["note"] == "without qty, quote_qty, time, is_buyer_maker; left out extra"
    assert (rest["b.zip", "one.csv"]["note"], rest["b.zip", "two.csv"]["rows"], rest["b.zip", "three.csv"]["error"]) == ("empty", 0, "2 fields where 6 are declared, and no header")
    assert rest["bad.zip", None]["error"] and rest["none.zip", None]["note"] == "no CSV member"


def test_undeclared_columns_are_those_of_all_members(spark, tmp_path):
    packed(f"{tmp_path}/m.zip", a="create_time,oi\n1,2\n", b="oi,`odd` name\n3,4\n", c="5,6\n")
    rows = archives.read_archives(spark, [f"{tmp_path}/*.zip"], "metrics")
    assert [c for c in rows.columns if c[0] != "_"] == ["create_time", "oi", "`odd` name", "col_0", "col_1"]
    assert sorted((r[0], r[1], r[2], r[3], r[4]) for r in rows.fillna("-").collect()) == [("-", "-", "-", "5", "6"), ("-", "3", "4", "-", "-"), ("1", "2", "-", "-", "-")]
    with pytest.raises(ValueError):
        archives.read_archives(spark, [f"{tmp_path}/nothing"], "metrics")


def test_a_member_is_a_stream(spark, tmp_path, monkeypatch):
    """A member of many blocks, read with each block's memory only; a cut one gives its rows and its error."""
    n = 400_000
    text = TRADES + "".join(f"{i},1.5,2,3,{1_700_000_000_000 + i},true\n" for i in range(n))
    path = packed(f"{tmp_path}/long.zip", long=text)
    assert len(text) > 3 * zip_source.BLOCK_BYTES
    told = zip_source.read(spark, ["file://" + path], "trades")
    assert told.where("_kind = 'row'").agg(F.count("id"), F.sum(F.col("id").cast("long")), F.max("_line")).first()[:] == (n, n * (n - 1) // 2, n - 1)
    assert archives.manifest_of(told).select("rows", "bytes", "note").first()[:] == (n, len(text), None)
    whole = open(path, "rb").read()
    at = whole.rindex(b"PK\x01\x02")
    broken = whole[: at // 2] + bytes(64) + whole[at // 2 + 64 :]
    (tmp_path / "broken.zip").write_bytes(broken)
    told = zip_source.read(spark, [f"{tmp_path}/broken.zip"], "trades")
    assert archives.manifest_of(told).where("error is not null").count() == 1
    # Blocks are read a few ahead of what is asked for, and no further.
    monkeypatch.setattr(zip_source, "BLOCK_BYTES", 1 << 14)
    with zip_source.opened(path) as z, z.open("long.csv") as data:
        counted = zip_source._Counted(data)
        reader = zip_source.ZipCsvReader(["id"], "trades", [])
        first = next(reader._rows(path, "long.csv", counted))
        assert first.num_rows and counted.size < len(text) / 3


def test_the_last_row_of_an_archive_stays(spark, tmp_path):
    """In a build, of two rows of one time the later of member and line stays, whatever its values."""
    t = 1704067200000
    path = packed(f"{tmp_path}/x.zip", a=TRADES + f"1,9,1,9,{t},true\n2,5,1,5,{t},true\n", b=TRADES + f"3,1,1,1,{t + 1000},true\n4,0.5,1,1,{t + 1000},true\n")
    made, _ = builder.build(builder.BuildConfig([builder.Selection("um", "trades", "X", "2024-01", "2024-01", columns=["id", "price"])]), lambda s: archives.read_archives(spark, [path], "trades").drop("_member").repartition(3))
    assert sorted(map(tuple, made.collect())) == [(2, 5.0, t), (4, 0.5, t + 1000)]


def test_symbols_and_notes(spark, tmp_path):
    path = packed(f"{tmp_path}/ETHUSDT-bookTicker-2024-01-01.zip", a="1,1.0,1,2.0,1,1704067200000,1704067200001\n")
    book = processors.process("bookTicker", archives.read_archives(spark, [path], "bookTicker"))
    assert book.select("symbol", "mid", "ts").first()[:] == ("ETHUSDT", 1.5, 1704067200001)
    five = packed(f"{tmp_path}/five.zip", a="transact_time,price,quantity,first_trade_id,last_trade_id\n1,2,3,4,5\n1,2,3,4,5\n", b="agg_trade_id,price,quantity,first_trade_id,last_trade_id,transact_time,is_buyer_maker\n", c="price,quantity,transact_time,is_buyer_maker\n1,2,3,true\n1,2,3,true\n")
    notes = {r["member"]: r["note"] or "" for r in archives.manifest_of(zip_source.read(spark, [five], "aggTrades")).collect()}
    assert "no key" not in notes["a.csv"] and notes["b.csv"] == "" and notes["c.csv"].endswith("no key tells repeats; in order of time only")
    rows = spark.createDataFrame([(1, 2.0, 3.0, 4, 5), (1, 2.0, 3.0, 4, 5), (2, 2.0, 3.0, 4, 5)], "transact_time long, price double, quantity double, first_trade_id long, last_trade_id long")
    assert processors.process("aggTrades", rows).count() == 2 and processors.process("aggTrades", rows.drop("first_trade_id")).count() == 3


# The store


def test_two_writers_lose_nothing(spark, tmp_path):
    import threading

    from tidemark.plans.store import ConflictError, SnapshotStore

    store = SnapshotStore(spark, f"{tmp_path}/store")
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v long, w string")
    assert store.read("t") is None and store.version("t") == 0 and store.tables() == []
    assert store.commit("t", rows(("a", 1, "x")), 0) == 1
    with pytest.raises(ConflictError):
        store.commit("t", rows(("b", 2, "y")), 0)
    assert store.read("t").collect() == [("a", 1, "x")] and len([n for n in os.listdir(tmp_path / "store/t") if n.startswith("s-")]) == 1

    # Both have read version 1 before either commits.
    gate, seen, failed = threading.Barrier(2), [], []

    def write(k):
        first = True

        def change(old):
            nonlocal first
            seen.append(old.count())
            if first:
                first = False
                gate.wait(60)
            return old.unionByName(rows((k, 5, None)))

        try:
            store.update("t", change)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    writers = [threading.Thread(target=write, args=(k,)) for k in "bc"]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    assert not failed and sorted(seen) == [1, 1, 2] and store.version("t") == 3
    assert sorted(r["k"] for r in store.read("t").collect()) == ["a", "b", "c"]

    # Null leaves a value as it is, but for columns that are always taken; new columns are added.
    store.upsert("t", spark.createDataFrame([("a", None, None, 7), ("d", 4, "z", 8)], "k string, v long, w string, n int"), ["k"], ["w"])
    assert {tuple(r) for r in store.read("t").collect()} == {("a", 1, None, 7), ("b", 5, None, None), ("c", 5, None, None), ("d", 4, "z", 8)}
    assert store.read("t", 1).count() == 1 and store.read("t", 9) is None
    store.prune("t", 2)
    assert store.versions("t") == [3, 4] and store.read("t", 1) is None and store.read("t", 3).count() == 3 and store.tables() == ["t"]


def test_registry_in_the_store(spark, tmp_path):
    from tidemark.plans.store import SnapshotStore
    from tidemark.sources.schemas import RegisteredSchema, SchemaRegistry

    store, registry = SnapshotStore(spark, f"{tmp_path}/store"), SchemaRegistry(spark)
    registry.register(RegisteredSchema("klines", ["open_time"], {"open_time": "int64"}, "open_time"))
    store.upsert("schemas", registry.to_df(), ["dataset_type"], ["field_notes", "validation_status"])
    registry.register(RegisteredSchema("klines", ["open"], {"open": "float64"}))
    store.upsert("schemas", registry.to_df(), ["dataset_type"], ["field_notes", "validation_status"])
    assert SchemaRegistry.from_df(store.read("schemas")).get("klines") == registry.get("klines")


# The cache


def zipped_day(root, symbol, day, rows, cadence="daily"):
    text = "".join(f"{i},{p},1,1,{t},true\n" for i, p, t in rows)
    return packed(f"{root}/um/{cadence}/trades/{symbol}/{symbol}-trades-{day}.zip", x=text)


def test_cover_is_the_fewest_files(spark):
    from tidemark.plans.cache import cover

    rows = [("um", "trades", "A", None, "2024-01-30", "2024-04-02"), ("um", "trades", "A", None, "2024-02-10", "2024-02-20"), ("um", "klines", "B", "1h", "2024-02-01", "2024-02-29"), ("um", "klines", "C", "1h", "2024-03-02", "2024-03-01")]
    asked = spark.createDataFrame(rows, "market string, dataset_type string, symbol string, interval string, start string, end string")
    files = lambda *, gone=None, **more: sorted((r["symbol"], r["cadence"], r["date"], r["days"]) for r in cover(asked, gone, **more).collect())
    edges = [("A", "daily", d, 1) for d in ("2024-01-30", "2024-01-31", "2024-04-01", "2024-04-02")]
    assert files(prefer_monthly=True) == sorted([*edges, ("A", "monthly", "2024-02", 29), ("A", "monthly", "2024-03", 31), ("B", "monthly", "2024-02", 29)])
    gone = spark.createDataFrame([("um", "trades", "A", None, "monthly", "2024-02", False), ("um", "trades", "A", None, "monthly", "2024-03", True), ("um", "klines", "B", None, "monthly", "2024-02", False)], "market string, dataset_type string, symbol string, interval string, cadence string, date string, exists boolean")
    held = files(gone=gone, prefer_monthly=True)
    assert len(held) == 4 + 29 + 1 + 1 and ("A", "daily", "2024-02-29", 1) in held and ("B", "monthly", "2024-02", 29) in held
    assert [x for x in files(cadence="monthly") if x[0] == "A"] == [("A", "monthly", "2024-01", 2), ("A", "monthly", "2024-02", 29), ("A", "monthly", "2024-03", 31), ("A", "monthly", "2024-04", 2)]
    assert len(files()) == 64 + 29


def test_a_stopped_build_goes_on(spark, tmp_path):
    """Every state once; a second build does only what is left; a forced one does all."""
    from tidemark.plans.cache import RawCache

    t, day = 1704067200000, 86_400_000
    source = tmp_path / "remote"
    for d in range(1, 8):
        zipped_day(source, "A", f"2024-01-0{d}", [(d, 10 + d, t + (d - 1) * day), (d, 20 + d, t + (d - 1) * day)])
    (source / "um/daily/trades/A/A-trades-2024-01-04.zip").write_bytes(b"broken")
    calls = tmp_path / "calls"
    calls.mkdir()
    down = tmp_path / "down"
    down.write_text("")

    def fetch(url, path, source=str(source), calls=str(calls), down=str(down)):
        import os
        import shutil
        import uuid

        open(f"{calls}/{uuid.uuid4().hex}", "w").close()
        if url.endswith("05.zip") and os.path.exists(down):
            raise OSError("line is down")
        found = source + "/um/" + url.split("//b/")[1]
        if not os.path.exists(found):
            return "missing_404"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        shutil.copy(found, path)
        return None

    cache = RawCache(spark, f"{tmp_path}/cache", f"{tmp_path}/zips", "https://b", fetch, batch=3)
    tasks = cache.plan("um", "trades", "A", "2024-01-01", "2024-01-09")
    assert cache.scan("um", "trades", "A", "2024", "2024") is None

    # The first build stops in its second batch.
    whole, batches = RawCache._build, []

    def stops(self, part):
        if len(batches) == 1:
            raise KeyboardInterrupt
        batches.append(1)
        whole(self, part)

    RawCache._build = stops
    try:
        with pytest.raises(KeyboardInterrupt):
            cache.build(tasks)
    finally:
        RawCache._build = whole
    assert cache.ledger().count() == 3 and len(list(calls.iterdir())) == 3
    first = cache.build(tasks)
    assert first["summary"] == {"ok": 2, "missing": 0, "missing_404": 2, "network_error": 1, "error": 1, "skipped": 3}
    assert first["missing_404_preview"] == [f"https://b/daily/trades/A/A-trades-2024-01-0{d}.zip" for d in (8, 9)] and len(list(calls.iterdir())) == 9
    assert {r["date"]: r["error"] for r in cache.ledger().where("error is not null").collect()}["2024-01-05"] == "line is down"
    down.unlink()
    zipped_day(source, "A", "2024-01-04", [(4, 14, t + 3 * day), (4, 24, t + 3 * day)])
    (tmp_path / "zips/um/daily/trades/A/A-trades-2024-01-04.zip").unlink()
    second = cache.build(tasks)
    assert second["summary"] == {"ok": 2, "missing": 0, "missing_404": 2, "network_error": 0, "error": 0, "skipped": 5}
    assert cache.build(tasks, force_rebuild=True)["summary"]["ok"] == 7
    kept = cache.ledger().where("date = '2024-01-04'").first()
    assert (kept["status"], kept["rows"], kept["error"]) == ("ok", 2, None) and len(kept["digest"]) == 8

    # No day twice, whatever was built twice; partitions beside the range aren't read.
    rows = cache.scan("um", "trades", "A", "2024-01-03", "2024-01-05", columns=["id", "price", "gone"])
    assert sorted(map(tuple, rows.collect())) == [(3, 13.0), (3, 23.0), (4, 14.0), (4, 24.0), (5, 15.0), (5, 25.0)]
    assert "PartitionFilters: [" in rows._jdf.queryExecution().executedPlan().toString()
    made, report = builder.build(builder.BuildConfig([builder.Selection("um", "trades", "A", "2024-01-02", "2024-01-03", columns=["price"])]), cache.reader())
    assert [r[0] for r in made.orderBy("ts").collect()] == [22.0, 23.0] and report["heights"] == {0: 2}  # the last of each day's two rows
    assert cache.manifests[-1]["summary"]["skipped"] == 2
    _, report = builder.build(builder.BuildConfig([builder.Selection("um", "trades", "A", "2024-01-02", "2024-01-03"), builder.Selection("um", "trades", "B", "2024-01-02", "2024-01-03")]), cache.reader())
    assert "missing_404': 2" in report["errors"][0]["error"]


def test_months_go_before_their_days(spark, tmp_path):
    from tidemark.plans.cache import RawCache

    t, day = 1704067200000, 86_400_000
    zips = tmp_path / "zips"
    zipped_day(zips, "A", "2024-01", [(d, d, t + d * day) for d in range(31)], "monthly")
    for d in range(29, 33):
        stamp = f"2024-01-{d + 1}" if d < 31 else f"2024-02-0{d - 30}"
        zipped_day(zips, "A", stamp, [(100 + d, d, t + d * day)])
    cache = RawCache(spark, f"{tmp_path}/cache", str(zips))
    everything = cache.plan("um", "trades", "A", "2024-01", "2024-02-03", prefer_monthly=True)
    assert cache.build(everything)["summary"] == {"ok": 3, "missing": 1, "missing_404": 0, "network_error": 0, "error": 0, "skipped": 0}
    cache.build(cache.plan("um", "trades", "A", "2024-01-30", "2024-01-31"))
    assert cache.scan("um", "trades", "A", "2024-01-01", "2024-02-29").count() == 33
    assert cache.scan("um", "trades", "A", "2024-01-01", "2024-02-29", cadence="daily").count() == 4
    assert cache.scan("um", "trades", "A", "2024-01", "2024-01", cadence="monthly").count() == 31


# Ranges and menus


@pytest.mark.parametrize(("first", "last"), [(0, 699), (0, 0), (699, 699), (130, 420), (300, 333), (31, 45), (None, None)])
def test_ranges_from_both_ends(first, last):
    from datetime import date, timedelta

    from tidemark.plans import catalog

    low, asked = date(2022, 1, 31), []

    def exists(day):
        asked.append(day)
        return first is not None and first <= (day - low).days <= last

    want = None if first is None else (low + timedelta(days=first), low + timedelta(days=last))
    assert catalog.find_range(exists, low, low + timedelta(days=699)) == want
    assert len(asked) == len(set(asked)) and len(asked) <= (40 if first in (0, 130, 699) else 200)


def test_sparse_and_monthly_ranges():
    from datetime import date

    from tidemark.plans import catalog

    days = {date(2022, 5, 8), date(2022, 5, 9), date(2022, 5, 11), date(2023, 8, 31), date(2023, 8, 2)}
    assert catalog.find_range(days.__contains__, date(2020, 1, 1), date(2024, 3, 7)) == (date(2022, 5, 8), date(2023, 8, 31))
    assert catalog.find_range(lambda d: date(2021, 11, 1) <= d <= date(2022, 2, 1), date(2017, 1, 9), date(2024, 3, 7), "monthly") in (None, (date(2021, 11, 1), date(2022, 2, 1)))
    assert catalog.find_range(lambda d: date(2020, 11, 1) <= d <= date(2024, 1, 1), date(2017, 1, 9), date(2024, 3, 7), "monthly") == (date(2020, 11, 1), date(2024, 1, 1))
    assert catalog.find_range(lambda d: True, date(2024, 1, 2), date(2024, 1, 1)) is None


def test_islands_and_gaps(spark):
    from tidemark.plans import catalog

    there = [("daily", d, d != "2024-02-28") for d in ("2024-02-26", "2024-02-27", "2024-02-28", "2024-02-29", "2024-03-01", "2024-03-05")] + [("monthly", m, True) for m in ("2023-12", "2024-01", "2024-04")]
    files = spark.createDataFrame([("um", "trades", "A", None, *x) for x in there], "market string, dataset_type string, symbol string, interval string, cadence string, date string, exists boolean")
    runs = sorted(tuple(r[c] for c in ("start_date", "end_date", "n")) for r in catalog.islands(files).collect())
    assert runs == [("2023-12", "2024-01", 2), ("2024-02-26", "2024-02-27", 2), ("2024-02-29", "2024-03-01", 2), ("2024-03-05", "2024-03-05", 1), ("2024-04", "2024-04", 1)]
    assert sorted(tuple(r[c] for c in ("after", "before", "n")) for r in catalog.gaps(files).collect()) == [("2024-01", "2024-04", 2), ("2024-02-27", "2024-02-29", 1), ("2024-03-01", "2024-03-05", 3)]


def test_a_menu_goes_on_where_it_stopped(spark, tmp_path):
    from datetime import date

    from tidemark.plans import catalog
    from tidemark.plans.store import SnapshotStore

    for day in ("2024-01-06", "2024-01-07", "2024-01-08"):
        packed(f"{tmp_path}/m/daily/trades/A/A-trades-{day}.zip", x="1")
        packed(f"{tmp_path}/m/daily/klines/B/1h/B-1h-{day}.zip", x="1")
    mirror = catalog.folder_probe("https://b", f"{tmp_path}/m")
    down = tmp_path / "down"
    down.write_text("")

    def probe(url, down=str(down)):
        if "/klines/A/" in url and os.path.exists(down):
            raise OSError("down")
        return mirror(url)

    store = SnapshotStore(spark, f"{tmp_path}/store")
    jobs = catalog.menu_jobs(spark, {"um": ["trades", "klines"]}, ["A", "B"])
    assert sorted(r["interval"] or "" for r in jobs.collect()) == ["", "", "1h", "1h"]
    upsert, calls = store.upsert, []

    def stops(*a):
        if calls:
            raise KeyboardInterrupt
        calls.append(1)
        return upsert(*a)

    store.upsert = stops
    with pytest.raises(KeyboardInterrupt):
        catalog.menu_build(store, jobs, probe, "https://b", date(2024, 1, 1), date(2024, 1, 31), 2)
    store.upsert = upsert
    assert store.read("coverage").count() == 2
    run = lambda: catalog.menu_build(store, jobs, probe, "https://b", date(2024, 1, 1), date(2024, 1, 31), 2)
    again = run()
    assert again == {"jobs": 4, "searched": again["searched"], "skipped": 4 - again["searched"], "found": 2, "uncertain": 1} and again["searched"] in (2, 3)
    down.unlink()
    assert run() == {"jobs": 4, "searched": 1, "skipped": 3, "found": 2, "uncertain": 0}
    assert run()["searched"] == 0
    rows = {(r["dataset_type"], r["symbol"]): (r["start_date"], r["end_date"]) for r in store.read("coverage").collect()}
    assert rows == {("trades", "A"): ("2024-01-06", "2024-01-08"), ("klines", "B"): ("2024-01-06", "2024-01-08"), ("trades", "B"): ("", ""), ("klines", "A"): ("", "")}
    row = catalog.menu_row(store.read("coverage").where("start_date != ''"), "klines", "daily", "1h")
    assert [r["symbol"] for r in row.collect()] == ["B"] and catalog.menu_row(store.read("coverage"), "trades", "daily", "1h", "A").count() == 1 and catalog.menu_row(store.read("coverage"), "klines", "daily").count() == 0
    assert catalog.schema_samples(store.read("coverage"), "https://b").count() == 2
