"""Bulk files: zips of record files, their `counts` header, listings and daily names."""

from __future__ import annotations

import datetime as dt
import hashlib
import html
import io
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.parameters import QueryError, daily_code
from .scratch import ship

MAX_SMALL_ENTRY = 65_536


def group_path(root: str, group: str) -> str:
    """Where a group's weekly snapshot is."""
    if group not in codes.SERVICE_GROUPS:
        raise QueryError("unknown_group", group)
    return f"{root}/complete/l_{group}.zip"


@dataclass(frozen=True)
class Counts:
    """A `counts` file: when the snapshot was made (UTC ISO text) and how many lines each record type has."""

    created_at: str
    lines: dict[str, int]


def parse_counts(text: str) -> Counts:
    """Reads `File Creation Date: Sun Sep 27 09:38:53 EDT 2026` and `<count> <path>/<TYPE>.dat` lines."""
    head = re.search(r"File Creation Date:\s+\w{3} (\w{3}) +(\d{1,2}) (\d{2}:\d{2}:\d{2}) (EDT|EST) (\d{4})", text)
    if not head:
        raise QueryError("bad_counts", "no creation date")
    wall = dt.datetime.strptime(f"{head[5]} {head[1]} {head[2]} {head[3]}", "%Y %b %d %H:%M:%S")
    utc = wall + dt.timedelta(hours=4 if head[4] == "EDT" else 5)
    found = re.findall(r"^\s*(\d+)\s+\S*?([A-Za-z0-9]+)\.dat\s*$", text, re.M)
    return Counts(utc.strftime("%Y-%m-%dT%H:%M:%SZ"), {t.upper(): int(n) for n, t in found})


@dataclass(frozen=True)
class Entry:
    """An entry of a zip by its central directory: where its local header begins, and what it must inflate to."""

    name: str
    offset: int
    packed: int
    size: int
    method: int
    crc: int


#: What a zip's lines are staged as. _seq orders lines by the place of their zip in the build, then as filed. A line of
#: type ERROR says why a zip, or an entry of it, could not be read.
STAGED = "path string, place int, record_type string, _seq long, value string"
COUNTS, ERROR = "counts", "!error"
_ROWS, _CHUNK, _INFLATED = 20_000, 1 << 20, 4 << 20
_MAX_LINE = 16_384


def opened(path: str) -> BinaryIO:
    """A file by Arrow's own file systems (local, HDFS, S3, GCS), to seek in; raises ArrowInvalid for other schemes."""
    fs, name = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.open_input_file(name)


def central_directory(file: BinaryIO) -> list[Entry]:
    """The entries of a zip, from its last bytes alone.

    Raises bad_zip for what readers of the feed don't take: more than one disk, ZIP64, an encrypted entry, a method
    besides stored and deflated, or no end of the central directory.
    """
    length = file.seek(0, 2)
    length = file.tell() if length is None else length
    file.seek(max(0, length - 65_557))
    tail = file.read()
    at = tail.rfind(b"PK\x05\x06")
    if at < 0 or len(tail) < at + 22:
        raise QueryError("bad_zip", "no end of central directory")
    disk, first, here, entries, size, offset = struct.unpack_from("<HHHHII", tail, at + 4)
    if disk or first or here != entries:
        raise QueryError("bad_zip", "more than one disk")
    if entries == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        raise QueryError("bad_zip", "ZIP64")
    file.seek(offset)
    directory, found, place = file.read(size), [], 0
    for _ in range(entries):
        if len(directory) < place + 46 or directory[place : place + 4] != b"PK\x01\x02":
            raise QueryError("bad_zip", "a malformed central directory")
        flags, method = struct.unpack_from("<HH", directory, place + 8)
        crc, packed, inflated, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", directory, place + 16)
        (local,) = struct.unpack_from("<I", directory, place + 42)
        name = directory[place + 46 : place + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        if flags & 1:
            raise QueryError("bad_zip", "an encrypted entry")
        if method not in (0, 8):
            raise QueryError("bad_zip", f"{name}: neither stored nor deflated")
        if 0xFFFFFFFF in (packed, inflated, local):
            raise QueryError("bad_zip", "ZIP64")
        found.append(Entry(name, local, packed, inflated, method, crc))
        place += 46 + n_name + n_extra + n_comment
    return found


def inflated(file: BinaryIO, entry: Entry) -> Iterator[bytes]:
    """An entry's bytes in pieces: its own range of the file is read, a megabyte at a time; its length and CRC are checked."""
    file.seek(entry.offset)
    header = file.read(30)
    if len(header) < 30 or header[:4] != b"PK\x03\x04":
        raise QueryError("bad_zip", f"{entry.name}: no local header")
    n_name, n_extra = struct.unpack_from("<HH", header, 26)
    file.seek(entry.offset + 30 + n_name + n_extra)
    left, crc, size, inflate = entry.packed, 0, 0, zlib.decompressobj(-15) if entry.method else None
    while left:
        packed = file.read(min(_CHUNK, left))
        if not packed:
            raise QueryError("bad_zip", f"{entry.name}: cut short")
        left -= len(packed)
        while packed:
            try:
                piece = inflate.decompress(packed, _INFLATED) if inflate else packed
            except zlib.error as e:
                raise QueryError("bad_zip", f"{entry.name}: {e}") from e
            packed = inflate.unconsumed_tail if inflate else b""
            crc, size = zlib.crc32(piece, crc), size + len(piece)
            if piece:
                yield piece
    if (last := inflate.flush() if inflate else b""):
        crc, size = zlib.crc32(last, crc), size + len(last)
        yield last
    if size != entry.size or crc != entry.crc:
        raise QueryError("bad_zip", f"{entry.name}: length or checksum differ")


def small_entry(file: BinaryIO, entry: Entry) -> str:
    """A small text entry; larger ones are refused."""
    if entry.size > MAX_SMALL_ENTRY:
        raise QueryError("bad_entry", entry.name)
    return b"".join(inflated(file, entry)).decode("utf-8", "replace")


def entry_lines(file: BinaryIO, entry: Entry) -> Iterator[list[tuple[int, str]]]:
    """(number, line) of a record file, some at a time.

    Lines are split at line feeds only, one trailing carriage return is cut, empty ones are left out, malformed UTF-8 is
    replaced; a line of over 16,384 characters is no record and raises bad_line. Of the entry a piece and the line that
    it ends in are held.
    """
    too_long = QueryError("bad_line", f"{entry.name}: a line of over {_MAX_LINE} characters is no record")
    rest, number = b"", 0
    for piece in chain(inflated(file, entry), (None,)):
        *whole, rest = (rest + piece).split(b"\n") if piece is not None else (rest, b"")
        if len(rest) > 4 * _MAX_LINE:
            raise too_long
        found = []
        for line in whole:
            if text := line.removesuffix(b"\r").decode("utf-8", "replace"):
                if len(text) > _MAX_LINE:
                    raise too_long
                found.append((number, text))
            number += 1
        yield found


def _type_of(entry: Entry) -> str | None:
    """The record type of an entry's file, COUNTS, or None for other files."""
    name = entry.name.rsplit("/", 1)[-1].lower()
    return COUNTS if name == COUNTS else name.removesuffix(".dat").upper() if name.endswith(".dat") else None


def _staged(path: str, place: int, open_: Callable[[], BinaryIO], entry: Entry | None, error: str | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of one entry, or of what could not be read."""

    def batch(type_: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
        n = len(rows)
        numbers = pa.array([place << 40 | i for i, _ in rows], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([place] * n, pa.int32()), pa.array([type_] * n), numbers, pa.array([t for _, t in rows], pa.string())], names=["path", "place", "record_type", "_seq", "value"])

    try:
        if error is None:
            type_ = _type_of(entry)
            with open_() as file:
                if type_ == COUNTS:
                    yield batch(COUNTS, [(0, small_entry(file, entry))])
                elif type_:
                    for lines in entry_lines(file, entry):
                        for i in range(0, len(lines), _ROWS):
                            yield batch(type_, lines[i : i + _ROWS])
    except (QueryError, OSError) as e:
        error = f"{e.reason}: {e}" if isinstance(e, QueryError) else str(e)
    if error is not None:
        yield batch(ERROR, [(0, error)])


@dataclass(frozen=True)
class ZipPlan:
    """What is read of one zip: its entries, or why it can't be read; identity is that of its content and time."""

    path: str
    entries: list[Entry]
    error: str | None
    identity: str


def plan_zip(path: str, modified_at: str) -> ZipPlan | None:
    """A zip's plan from its central directory; None where only Spark's readers reach the path.

    Two zips have one identity if their names, times and all entries' names, lengths and checksums are equal.
    """
    name = path.rsplit("/", 1)[-1]
    try:
        with opened(path) as file:
            entries, error = central_directory(file), None
    except QueryError as e:
        entries, error = [], f"{e.reason}: {e}"
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return None
    seen = json.dumps([name, modified_at, error, *[(e.name, e.size, e.crc) for e in entries]])
    return ZipPlan(path, entries, error, hashlib.sha256(seen.encode()).hexdigest()[:32])


def read_zips(spark: SparkSession, paths: list[str], plans: list[ZipPlan | None] | None = None) -> DataFrame:
    """The lines of zips, each read once for all its record types, as STAGED says; paths are in the order of the build.

    Each entry is a task that reads its own range and inflates it piece by piece, so the largest entry sets the time, and
    no task holds one. Paths that Arrow's file systems don't know are read by Spark's reader of whole files, a zip a task,
    up to its limit of 2 GiB. What can't be read is a line of type ERROR.
    """
    ship(spark)
    plans = [plan_zip(p, "") for p in paths] if plans is None else plans
    tasks = [(p.path, i, e, p.error) for i, p in enumerate(plans) if p for e in (p.entries if p.error is None else [None]) if e is None or _type_of(e)]
    out = spark.createDataFrame([], STAGED)
    if tasks:

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number in (n for batch in batches for n in batch.column(0).to_pylist()):
                path, place, entry, error = tasks[number]
                yield from _staged(path, place, lambda: opened(path), entry, error)  # noqa: B023

        out = spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(one, STAGED)
    if whole := [p for p, plan in zip(paths, plans, strict=True) if plan is None]:
        at = {p.rsplit("/", 1)[-1]: i for i, p in enumerate(paths)}
        place = F.create_map(*[x for n, i in at.items() for x in (F.lit(n), F.lit(i))])
        files = spark.read.format("binaryFile").load(whole).select("path", F.element_at(place, F.substring_index("path", "/", -1)).alias("place"), "content")

        def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for path, place, content in (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                file = lambda: io.BytesIO(content)  # noqa: B023, E731
                try:
                    entries, error = central_directory(file()), None
                except QueryError as e:
                    entries, error = [None], f"{e.reason}: {e}"
                for entry in entries:
                    yield from _staged(path, place, file, entry, error)

        out = out.unionByName(files.mapInArrow(every, STAGED)) if tasks else files.mapInArrow(every, STAGED)
    return out


def read_bulk(spark: SparkSession, root: str, type_: str, groups: list[str] | None = None) -> DataFrame:
    """service_group, _seq and value of every line of a record type in the weekly snapshots of groups.

    Raises missing_zip if a group that is named has no zip, or none of the default ones has; a zip that can't be read
    fails the read.
    """
    paths = snapshot_paths(spark, root, groups)
    lines = read_zips(spark, list(paths.values())).where(F.col("record_type").isin(type_, ERROR))
    lines = lines.withColumn("value", F.when(F.col("record_type") == ERROR, F.raise_error("value")).otherwise(F.col("value")))
    names = F.regexp_extract("path", r"l_([^/]+)\.zip$", 1).alias("service_group")
    return lines.select(names, "_seq", "value").repartition(max(1, spark.sparkContext.defaultParallelism), "service_group", "_seq")


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path) as the JVM has them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def snapshot_paths(spark: SparkSession, root: str, groups: list[str] | None = None) -> dict[str, str]:
    """The weekly zips of groups, in the order of the build; of the default groups those that there are."""
    found = {g: group_path(str(root), g) for g in (codes.DEFAULT_SERVICE_GROUPS if groups is None else groups)}
    there = {g: p for g, p in found.items() if (fs := file_system(spark, p))[0].exists(fs[1])}
    if not there or (groups is not None and len(there) < len(found)):
        raise QueryError("missing_zip", ", ".join(p for g, p in found.items() if g not in there))
    return there


def modified(spark: SparkSession, path: str) -> dt.datetime:
    """When a file was last modified."""
    fs, p = file_system(spark, path)
    return dt.datetime.fromtimestamp(fs.getFileStatus(p).getModificationTime() // 1000, dt.UTC)


def daily_files(spark: SparkSession, root: str) -> list[tuple[str, dt.datetime]]:
    """(path, when last modified) of every daily zip under a root."""
    fs, p = file_system(spark, f"{root}/daily")
    if not fs.exists(p):
        return []
    found = [(str(s.getPath().toString()), dt.datetime.fromtimestamp(s.getModificationTime() // 1000, dt.UTC)) for s in fs.listStatus(p)]
    return sorted(x for x in found if daily_code(x[0].rsplit("/", 1)[-1]) is not None)


@dataclass(frozen=True)
class Listed:
    """A file of a directory listing; modified is UTC, None if it can't be resolved."""

    name: str
    modified: dt.datetime | None


def parse_listing(page: str) -> list[Listed]:
    """Zips that a directory page links to, by name; a name listed with conflicting times has none."""
    from ..functions.parameters import eastern_wall_time

    seen: dict[str, set] = {}
    for m in re.finditer(r"""<a\s[^>]*href=["']([^"']+)["'][^>]*>.*?</a>([^<]*(?:<(?!a\s)[^>]*>[^<]*)*)""", page, re.I | re.S):
        name = html.unescape(m[1]).rsplit("/", 1)[-1]
        if not name.lower().endswith(".zip"):
            continue
        at = re.search(r"(\d{4})-(\d{2})-(\d{2})\s+(\d{2}):(\d{2})", m[2])
        seen.setdefault(name, set()).add(eastern_wall_time(dt.datetime(*map(int, at.groups()))) if at else None)
    return [Listed(n, t.pop() if len(t) == 1 else None) for n, t in sorted(seen.items())]


def daily_group(file_name: str) -> tuple[str | None, str | None]:
    """(code, group) of a daily file; a code without a group is kept, frc is never built."""
    code = daily_code(file_name)
    group = codes.DAILY_CODE_GROUPS.get(code or "")
    return code, None if group == "frc" else group
