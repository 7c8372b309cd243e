"""CSV files in ZIP archives as a data source: ``spark.read.format("zipcsv").option("dataset", ...).load(path)``.

Each CSV member of each archive is a partition, which is decoded as a stream: neither an archive nor a member is
ever held whole. Whether a member begins with a header is decided for each, and its columns are found by name, so members
may differ in both. What can't be read stands beside the rows. Columns are texts, and are followed by

_kind    row; bad (a line with too few or many fields, in _note); member (at the end of each, with its rows, bytes, digest
         and what there is to note); error (an archive or member that can't be read, or not to its end)
_path, _member, _line    where a row stands: the archive, the file in it, and its number there
_note, _rows, _bytes, _digest

Archives lie where pyarrow's file systems reach: local, hdfs, s3, gs. Options: ``dataset``; ``paths``, a JSON list in place
of one path; ``firstMember``: only the first CSV of each archive; ``threads``, which list archives at a time.
"""

from __future__ import annotations

import fnmatch
import hashlib
import io
import json
import zipfile
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.csv
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources import schemas

FORMAT = "zipcsv"
PLACE = (("_kind", pa.string()), ("_path", pa.string()), ("_member", pa.string()), ("_line", pa.int64()), ("_note", pa.string()), ("_rows", pa.int64()), ("_bytes", pa.int64()), ("_digest", pa.string()))
#: Characters of a member's MD5 that are told.
DIGEST = 8
BLOCK_BYTES = 1 << 20


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def archives(path: str) -> list[str]:
    """The archives that a path names: itself, those below a folder, or those that fit a pattern of its last parts."""
    system, inner = file_system(path)
    start = path[: len(path) - len(inner)] if path.endswith(inner) else "file://"
    base = inner
    while any(c in base for c in "*?["):
        base = base.rpartition("/")[0]
    info = system.get_file_info(base)
    if base == inner and info.type != pa.fs.FileType.Directory:
        return [path]
    found = system.get_file_info(pa.fs.FileSelector(base, allow_not_found=True, recursive=True))
    names = [f.path for f in found if f.type == pa.fs.FileType.File and f.path.lower().endswith(".zip")]
    return sorted(start + n for n in names if base == inner or fnmatch.fnmatch(n, inner))


class _File(io.RawIOBase):
    """A file of any of those systems as Python's zipfile wants it: a place before the beginning is an OSError."""

    def __init__(self, raw):
        self.raw = raw

    def readable(self) -> bool:
        return True

    seekable = readable

    def readinto(self, into) -> int:
        data = self.raw.read(len(into))
        into[: len(data)] = data
        return len(data)

    def tell(self) -> int:
        return self.raw.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            return self.raw.seek(offset, whence)
        except pa.ArrowInvalid as e:
            raise OSError(str(e)) from e


@contextmanager
def opened(path: str) -> Iterator[zipfile.ZipFile]:
    system, inner = file_system(path)
    with system.open_input_file(inner) as raw, zipfile.ZipFile(io.BufferedReader(_File(raw), 1 << 20)) as archive:
        yield archive


def members(paths: Sequence[str], first_only: bool = False, threads: int = 32) -> list[tuple[str, str | None, str | None]]:
    """(archive, CSV member, None); (archive, None, error) if it can't be listed; (archive, None, None) if it has no CSV."""

    def of(path: str) -> list[tuple[str, str | None, str | None]]:
        try:
            with opened(path) as archive:
                names = [m for m in archive.namelist() if m.lower().endswith(".csv")]
        except (OSError, zipfile.BadZipFile, pa.ArrowException) as e:
            return [(path, None, str(e) or type(e).__name__)]
        return [(path, m, None) for m in (names[:1] if first_only else names)] or [(path, None, None)]

    with ThreadPoolExecutor(threads) as pool:
        every = [a for found in pool.map(archives, paths) for a in found]
        return [m for found in pool.map(of, every) for m in found]


class _Counted:
    """A member's bytes, counted and hashed as they pass."""

    def __init__(self, raw):
        self.raw, self.size, self.md5, self.held, self.closed = raw, 0, hashlib.md5(usedforsecurity=False), b"", False

    def _passed(self, data: bytes) -> bytes:
        self.size += len(data)
        self.md5.update(data)
        return data

    def first_line(self) -> str:
        self.held = self._passed(self.raw.readline(1 << 20))
        return self.held.decode("utf-8-sig", "replace").strip("\r\n")

    def read(self, n: int = -1) -> bytes:
        if not self.held:
            return self._passed(self.raw.read(n))
        n = len(self.held) if n < 0 else n
        out, self.held = self.held[:n], self.held[n:]
        return out

    def readable(self) -> bool:
        return True

    def close(self) -> None:
        self.closed = True


def names_of(line: str, dataset: str) -> tuple[list[str], bool]:
    """A member's columns by its first line, and whether that is a header."""
    return schemas.column_names(line, dataset)


class ZipCsvSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _members(self) -> list[tuple[str, str | None, str | None]]:
        o = self.options
        paths = json.loads(o["paths"]) if "paths" in o else [o["path"]]
        return members(paths, str(o.get("firstMember", "")).lower() == "true", int(o.get("threads", 32)))

    def schema(self) -> T.StructType:
        """Declared columns; of an undeclared dataset, those of all members, in the order in which they are met."""
        dataset = self.options.get("dataset", "")
        known = schemas.known_schema(dataset)
        names = known.names if known else list(dict.fromkeys(n for found in self._headers(dataset) for n in found))
        place = [T.StructField(n, T.LongType() if pa.types.is_integer(t) else T.StringType()) for n, t in PLACE]
        return T.StructType([*[T.StructField(n, T.StringType()) for n in names], *place])

    def _headers(self, dataset: str) -> Iterator[list[str]]:
        def of(place) -> list[str]:
            path, member, _ = place
            if member is None:
                return []
            try:
                with opened(path) as archive, archive.open(member) as data:
                    return names_of(_Counted(data).first_line(), dataset)[0]
            except (OSError, zipfile.BadZipFile, RuntimeError):
                return []  # the partition tells

        with ThreadPoolExecutor(int(self.options.get("threads", 32))) as pool:
            yield from pool.map(of, self._members())

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ZipCsvReader([n for n in schema.names if n not in dict(PLACE)], self.options.get("dataset", ""), self._members())


class ZipCsvReader(DataSourceReader):
    def __init__(self, columns: list[str], dataset: str, places: list):
        self.columns, self.dataset, self.places = columns, dataset, places

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.places] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        path, member, error = partition.value
        if member is None:
            yield self._told(path, None, "error" if error else "member", error or "no CSV member", 0)
            return
        try:
            with opened(path) as archive, archive.open(member) as data:
                yield from self._rows(path, member, _Counted(data))
        except (OSError, EOFError, RuntimeError, NotImplementedError, zipfile.BadZipFile, zipfile.zlib.error, pa.ArrowException) as e:
            yield self._told(path, member, "error", str(e) or type(e).__name__)

    def _rows(self, path: str, member: str, data: _Counted) -> Iterator[pa.RecordBatch]:
        first = data.first_line()
        names, header = names_of(first, self.dataset) if first else (self.columns, True)
        known = schemas.known_schema(self.dataset)
        if known and not header and names != known.names:
            yield self._told(path, member, "error", f"{len(names)} fields where {len(known)} are declared, and no header")
            return
        notes, bad, at = self._notes(names, bool(first)), [], 0
        if header:
            data.held = b""
        elif data.held.startswith(b"\xef\xbb\xbf"):
            data.held = data.held[3:]

        def unfit(row) -> str:
            bad.append(f"{row.actual_columns} fields where {row.expected_columns} are named: {row.text}")
            return "skip"

        try:
            found = pa.csv.open_csv(
                pa.PythonFile(data, mode="r"), pa.csv.ReadOptions(use_threads=False, block_size=BLOCK_BYTES, column_names=names),
                pa.csv.ParseOptions(newlines_in_values=True, invalid_row_handler=unfit), pa.csv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False),
            )
        except pa.ArrowInvalid as e:
            if "Empty CSV" not in str(e):
                raise
            found = ()
        for batch in found:
            if batch.num_rows:
                yield self._batch(batch.num_rows, {n: batch.column(names.index(n)) for n in self.columns if n in names}, _kind="row", _path=path, _member=member, _line=pa.array(range(at, at + batch.num_rows), pa.int64()))
            at += batch.num_rows
            for note in bad:
                yield self._told(path, member, "bad", note)
            notes += [f"{len(bad)} lines left out"] if bad else []
            bad.clear()
        for note in bad:
            yield self._told(path, member, "bad", note)
        notes += [f"{len(bad)} lines left out"] if bad else []
        yield self._told(path, member, "member", "; ".join(notes) or None, at, data.size, data.md5.hexdigest()[:DIGEST])

    def _notes(self, names: list[str], any_line: bool) -> list[str]:
        if not any_line:
            return ["empty"]
        lacks, more = [n for n in self.columns if n not in names], [n for n in names if n not in self.columns]
        notes = [f"without {', '.join(lacks)}"] if lacks else []
        notes += [f"left out {', '.join(more)}"] if more else []
        return notes + schemas.key_notes(self.dataset, names)

    def _told(self, path: str, member: str | None, kind: str, note: str | None, n: int | None = None, size: int | None = None, digest: str | None = None) -> pa.RecordBatch:
        return self._batch(1, {}, _kind=kind, _path=path, _member=member, _note=note, _rows=n, _bytes=size, _digest=digest)

    def _batch(self, n: int, found: dict[str, pa.Array], **place) -> pa.RecordBatch:
        data = [found.get(c, pa.nulls(n, pa.string())) for c in self.columns]
        more = [x if isinstance(x := place.get(c), pa.Array) else pa.array([x] * n, t) for c, t in PLACE]
        return pa.RecordBatch.from_arrays([*data, *more], names=[*self.columns, *[c for c, _ in PLACE]])


def read(spark: SparkSession, paths: Sequence[str], dataset: str, first_member_only: bool = False) -> DataFrame:
    """All that the source tells of ``paths``."""
    spark.dataSource.register(ZipCsvSource)
    return spark.read.format(FORMAT).option("dataset", dataset).option("paths", json.dumps(list(paths))).option("firstMember", str(first_member_only)).load()
