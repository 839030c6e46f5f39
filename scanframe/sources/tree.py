"""Source trees, object stores and archives as file tables."""

from __future__ import annotations

import io
import os
import zipfile
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from scanframe.functions import text
from scanframe.functions.cluster import counted, materialize
from scanframe.operators.numbering import running_totals

SUFFIXES = (".py", ".java")
PART_BYTES = 128 << 20  # content per reading task
PART_FILES = 20_000  # files per reading task, however small; opening one counts as its share of PART_BYTES
BATCH_BYTES = 8 << 20
MEMBER_BYTES = 1 << 30  # most that a member of an archive may unpack to
_LISTED = "path string, kind string, size bigint"
_READ = pa.schema([("path", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("problem", pa.string())])

# why a file has no content
TOO_LARGE, UNREADABLE, NO_FOLDER, DAMAGED = "too large", "unreadable", "unreadable folder", "damaged archive member"


def _store(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or of a plain path, and the path inside it."""
    return pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), os.path.abspath(root))


def _entries(fs: pafs.FileSystem, folder: str, suffixes: tuple):
    """What a folder holds: sub-folders and wanted files, hidden and empty ones too; links to folders are left out."""
    try:
        found = fs.get_file_info(pafs.FileSelector(folder))
    except OSError:  # gone or not to be read: a row of its own
        yield folder, NO_FOLDER, 0
        return
    for info in found:
        if info.type == pafs.FileType.Directory:
            if not (isinstance(fs, pafs.LocalFileSystem) and os.path.islink(info.path)):
                yield info.path, "folder", 0
        elif os.path.splitext(info.base_name)[1] in suffixes:
            yield info.path, "file", info.size or 0


def list_tree(spark: SparkSession, root: str, suffixes: tuple = SUFFIXES) -> DataFrame:
    """(path, kind, size) of all wanted files below a folder; ``kind`` is 'file' or says what is wrong.

    Folders are listed by tasks, level by level, each once; the driver only starts as many
    rounds as the tree is deep. A single file is taken whatever its suffix.
    """
    fs, start = _store(root)
    info = fs.get_file_info(start)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(root)
    if info.type == pafs.FileType.File:
        return spark.createDataFrame([(start, "file", info.size)], _LISTED)

    def listed(batches):
        store, _ = _store(root)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                rows = list(_entries(store, folder, suffixes))
                for k in range(0, len(rows), 10_000):
                    part = list(zip(*rows[k:k + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1]), pa.array(part[2], pa.int64())], ["path", "kind", "size"])

    level, n = spark.createDataFrame([(start,)], "path string"), 1
    files = None
    while n:
        width = max(1, min(n, 8 * spark.sparkContext.defaultParallelism))
        seen = Observation()
        found = materialize(level.repartition(width).mapInArrow(listed, _LISTED).observe(seen, F.count_if(F.col("kind") == "folder").alias("folders")))
        here = found.where("kind <> 'folder'")
        files = here if files is None else files.unionAll(here)
        level, n = found.where("kind = 'folder'").select("path"), seen.get["folders"]
    return files


def deal(listed: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, int]:
    """Add ``part``, the task that is to read a file, and return the number of tasks.

    The files in order of their paths are cut by running weight into shares of equal weight:
    bytes to read plus a fixed cost per file. A file heavier than half a share is a task of its
    own, so no other task exceeds one and a half shares. There are at most three times as many
    tasks as shares, since every file that stands alone takes half a share.
    """
    cost = max(1, PART_BYTES // PART_FILES)
    reads = F.col("kind") == "file"
    if max_bytes:
        reads = reads & (F.col("size") <= max_bytes)
    columns = listed.columns
    weighed = listed.select("*", (F.when(reads, F.col("size")).otherwise(0) + cost).cast("long").alias("weight"))
    total = weighed.agg(F.count("*").alias("n"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    shares = max(1, -(-total["weight"] // PART_BYTES), min(total["n"], listed.sparkSession.sparkContext.defaultParallelism))
    if shares == 1:
        return weighed.withColumn("part", F.lit(0)).drop("weight"), 1
    share = -(-total["weight"] // shares)
    alone = F.col("weight") * 2 > share
    placed = running_totals(
        weighed.withColumn("light", F.when(alone, 0).otherwise(F.col("weight")).cast("long")), ["path"], "light", "before")
    light = placed.where(~alone).withColumn("part", F.floor(F.col("before") / share).cast("int"))
    heavy, n_heavy = counted(placed.where(alone).select(*columns).withColumn("one", F.lit(1).cast("long")))
    if not n_heavy:
        return light.select(*columns, "part"), shares
    heavy = running_totals(heavy, ["path"], "one", "place").withColumn("part", (F.col("place") + shares).cast("int"))
    return light.select(*columns, "part").unionByName(heavy.select(*columns, "part")), shares + n_heavy


def read_files(listed: DataFrame, root: str, max_bytes: int | None = None) -> DataFrame:
    """(path, kind, size) to (path, size, content, problem), dealt evenly by bytes (``deal``), several files per batch.

    No file is dropped: one that is too large, gone or not to be read has no content and says why.
    """
    def one(store, r):
        if r["kind"] != "file":
            return r["path"], r["size"], None, r["kind"]
        if max_bytes and r["size"] > max_bytes:
            return r["path"], r["size"], None, TOO_LARGE
        try:
            with store.open_input_stream(r["path"]) as f:
                return r["path"], r["size"], f.read(), None
        except OSError:
            return r["path"], r["size"], None, UNREADABLE

    return _read(listed, ["path", "kind", "size"], root, max_bytes, one)


def _read(listed: DataFrame, columns: list[str], root: str, max_bytes: int | None, one) -> DataFrame:
    """Rows of a listing, dealt by bytes, to (path, size, content, problem) by a function of store and row."""

    def read(batches):
        store, _ = _store(root)
        rows, held = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                rows.append(one(store, r))
                held += len(rows[-1][2] or b"")
                if held >= BATCH_BYTES or len(rows) >= 10_000:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    dealt, parts = deal(listed, max_bytes)
    return dealt.repartitionById(parts, "part").select(*columns).mapInArrow(read, "path string, size bigint, content binary, problem string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)


def decode_files(raw: DataFrame, project) -> DataFrame:
    """(path, content bytes[, problem]) -> files table; ``is_utf8`` is false where strict finders stay silent."""
    columns = ["problem"] if "problem" in raw.columns else []
    return raw.select(
        "path", F.lit(project).alias("project"), text.language(F.col("path")).alias("lang"),
        text.tolerant_text(F.col("content")).alias("content"),
        F.coalesce(text.strict_ok(F.col("content")), F.lit(False)).alias("is_utf8"), *columns)


def read_tree(
    spark: SparkSession, root: str, suffixes: tuple = SUFFIXES, max_file_bytes: int | None = None,
    project: str | None = None, archives: bool = False,
) -> DataFrame:
    """Files below ``root`` (or the single file ``root``): a path that all executors mount, or a URI of a store.

    With ``archives``, the wanted members of zip files below it as well.
    """
    wanted = tuple(suffixes) + ((".zip",) if archives else ())
    listed = list_tree(spark, root, wanted)
    if archives:
        is_zip = (text.suffix(F.col("path")) == ".zip") & (F.col("kind") == "file")
        members = list_members(listed.where(is_zip).select("path"), root, suffixes)
        raw = read_files(listed.where(~is_zip), root, max_file_bytes).unionByName(
            read_members(members, root, min(max_file_bytes or MEMBER_BYTES, MEMBER_BYTES)))
    else:
        raw = read_files(listed, root, max_file_bytes)
    return decode_files(raw.drop("size"), project or os.path.basename(root.rstrip("/")))


def allowed_file(path, suffixes: tuple = (".py", ".java", ".zip")):
    """Upload allow-list: suffix in any case."""
    return F.lower(text.suffix(path)).isin(*suffixes)


_MEMBERS = pa.schema([
    ("path", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("archive", pa.string()), ("at", pa.int64()),
    ("packed", pa.int64()), ("method", pa.int32()), ("flags", pa.int32()), ("crc", pa.int64())])


def list_members(archives: DataFrame, root: str, suffixes: tuple = SUFFIXES) -> DataFrame:
    """(path) of zip files to one row per member with a wanted suffix: what it is called and where its bytes lie.

    Only the directory at the end of an archive is read. An archive without a readable one is a
    row of its own that says so.
    """

    def listed(batches):
        store, _ = _store(root)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    with store.open_input_file(path) as f:  # a small one is read at once
                        rows = _directory(io.BytesIO(f.read()) if f.size() <= 1 << 16 else f, path, suffixes)
                except OSError:
                    rows = [_no_archive(path, UNREADABLE)]
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[k:k + 10_000], schema=_MEMBERS)

    n = max(1, min(archives.count(), 8 * archives.sparkSession.sparkContext.defaultParallelism))
    kinds = "path string, kind string, size bigint, archive string, at bigint, packed bigint, method int, flags int, crc bigint"
    return materialize(archives.select("path").repartition(n).mapInArrow(listed, kinds))


def _no_archive(path: str, problem: str) -> dict:
    return {"path": path, "kind": problem, "size": 0, "archive": path, "at": 0, "packed": 0, "method": 0, "flags": 0, "crc": 0}


def _directory(file, path: str, suffixes: tuple) -> list[dict]:
    try:
        with zipfile.ZipFile(file) as archive:
            return [
                {"path": f"{path}!{i.filename}", "kind": "file", "size": i.file_size, "archive": path, "at": i.header_offset,
                 "packed": i.compress_size, "method": i.compress_type, "flags": i.flag_bits, "crc": i.CRC}
                for i in archive.infolist() if not i.is_dir() and os.path.splitext(i.filename)[1] in suffixes]
    except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError):
        return [_no_archive(path, DAMAGED)]


def read_members(members: DataFrame, root: str, max_bytes: int = MEMBER_BYTES) -> DataFrame:
    """``list_members`` to (path, size, content, problem), dealt evenly by unpacked bytes.

    A task opens an archive at a member's place and unpacks that member alone, so one archive is
    read by as many tasks as its bytes ask for. What unpacks to more than ``max_bytes``, whatever
    its directory says, is a row without content; so is one that is damaged or encrypted.
    """
    def one(store, r):
        if r["kind"] != "file":
            return r["path"], r["size"], None, r["kind"]
        if r["size"] > max_bytes:
            return r["path"], r["size"], None, TOO_LARGE
        try:
            with store.open_input_file(r["archive"]) as f:
                return r["path"], r["size"], *_member(f, r, max_bytes)
        except OSError:
            return r["path"], r["size"], None, UNREADABLE

    return _read(members, _MEMBERS.names, root, max_bytes, one)


def _member(file, r: dict, max_bytes: int) -> tuple[bytes | None, str | None]:
    """(content, problem) of a member, unpacked as it is read and no further than the limit."""
    try:
        file.seek(r["at"])
        header = file.read(30)  # of the member: signature first, lengths of name and extra field last
        if r["flags"] & 1 or header[:4] != b"PK\3\4":
            return None, DAMAGED
        file.seek(r["at"] + 30 + int.from_bytes(header[26:28], "little") + int.from_bytes(header[28:30], "little"))
        info = zipfile.ZipInfo(r["path"])
        info.file_size, info.compress_size, info.compress_type, info.CRC = r["size"], r["packed"], r["method"], r["crc"]
        content = zipfile.ZipExtFile(file, "r", info).read(max_bytes + 1)
        return (None, TOO_LARGE) if len(content) > max_bytes else (content, None) if len(content) == r["size"] else (None, DAMAGED)
    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError, ValueError):
        return None, DAMAGED


def expand_archives(archives: DataFrame, suffixes: tuple = SUFFIXES, max_bytes: int = MEMBER_BYTES) -> DataFrame:
    """(path, content bytes of a zip) -> (path, content, problem), for archives that are cells of a table already.

    One row per member with a wanted suffix, as from ``read_members``; nothing is written to disk.
    """

    def expand(batches):
        schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("problem", pa.string())])
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                file = io.BytesIO(data.as_py() or b"")
                for r in _directory(file, path, suffixes):
                    content, problem = (None, r["kind"]) if r["kind"] != "file" else _member(file, r, max_bytes)
                    yield pa.RecordBatch.from_pydict({"path": [r["path"]], "content": [content], "problem": [problem]}, schema=schema)

    return archives.select("path", "content").mapInArrow(expand, "path string, content binary, problem string")
