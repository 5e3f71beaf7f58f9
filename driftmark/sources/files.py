"""Data set files, listed through Spark's file systems."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

from ..errors import InputError

#: Supported suffixes and the reader of each.
FORMATS = {".jsonl": "lines", ".ndjson": "lines", ".json": "json", ".csv": "csv", ".parquet": "parquet"}


@dataclass(frozen=True)
class DataFile:
    """One file: its URI, its path inside the data set, its place in reading order, its format and its bytes."""

    uri: str
    label: str
    rank: int
    format: str
    length: int = 0

    @property
    def hidden(self) -> bool:
        """Whether Spark's readers pass over it without a word."""
        return self.label.rpartition("/")[2][0] in "_."


def _format(name: str) -> str | None:
    return FORMATS.get("." + name.rpartition(".")[2].lower()) if "." in name.lstrip(".") or name.startswith(".") and name.count(".") > 1 else None


def _system(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system, wherever it is looked up from."""
    system, target = _system(spark, path)
    return system.makeQualified(target).toString()


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _system(spark, path)
    return system.exists(target)


def is_file(spark: SparkSession, path: str) -> bool:
    system, target = _system(spark, path)
    return system.exists(target) and system.getFileStatus(target).isFile()


def head(spark: SparkSession, uri: str, size: int) -> bytes:
    """The first bytes of a file."""
    system, target = _system(spark, uri)
    stream = system.open(target)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def first_line(spark: SparkSession, uri: str) -> bytes:
    """The first line of a file, without its end."""
    size = 1 << 16
    while True:
        data = head(spark, uri, size)
        line, end, _ = data.partition(b"\n")
        if end or len(data) < size:
            return line.rstrip(b"\r")
        size *= 8


@dataclass
class Parts:
    """The part files of a folder in order, less the last ``drop`` bytes; then ``close``, if there were any bytes."""

    folder: str
    drop: int
    close: bytes = b""


Piece = bytes | Parts


def joined(spark: SparkSession, path: str, pieces: list[Piece]) -> None:
    """Write ``path``: constant bytes, and part files copied inside the JVM."""
    system, where = _system(spark, path)
    system.setWriteChecksum(False)  # the file may be edited by other programs
    try:
        out = system.create(where, True)
    finally:
        system.setWriteChecksum(True)
    try:
        for piece in pieces:
            if isinstance(piece, bytes):
                out.write(bytearray(piece))
            else:
                _copy(spark, piece, out)
    finally:
        out.close()


def _copy(spark: SparkSession, piece: Parts, out: Any) -> None:
    source, folder = _system(spark, piece.folder)
    parts = [(s.getPath(), s.getLen()) for s in source.listStatus(folder) if s.getPath().getName().startswith("part-") and s.getLen()]
    parts.sort(key=lambda x: x[0].getName())
    for i, (part, size) in enumerate(parts):
        stream = source.open(part)
        some = spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, size - piece.drop if i == len(parts) - 1 else size)
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(some, out, 1 << 16, False)
        stream.close()
    if parts:
        out.write(bytearray(piece.close))


def renamed(spark: SparkSession, folder: str, old: str, new: str) -> None:
    """Give the part files of ``folder`` that end in ``old`` the ending ``new``; only names change."""
    system, target = _system(spark, folder)
    for status in system.listStatus(target):
        path = status.getPath()
        if path.getName().startswith("part-") and path.getName().endswith(old):
            system.rename(path, path.getParent().suffix("/" + path.getName().removesuffix(old) + new))


def moved(spark: SparkSession, old: str, new: str) -> None:
    """Give a file or folder another path of the same file system."""
    system, target = _system(spark, new)
    system.mkdirs(target.getParent())
    system.rename(_system(spark, old)[1], target)


def input_files(spark: SparkSession, path: str) -> list[DataFile]:
    """The file itself, or the supported files below a directory by relative path."""
    system, target = _system(spark, path)
    if not system.exists(target):
        raise InputError(f"{path}: no such file or directory")
    status = system.getFileStatus(target)
    if status.isFile():
        kind = _format(target.getName())
        if kind is None:
            raise InputError(f"{path}: unsupported file type (use {', '.join(FORMATS)})")
        found = [(status.getPath().toUri().toString(), target.getName(), kind, status.getLen())]
    else:
        root = status.getPath().toUri().getPath().rstrip("/") + "/"
        found, files = [], system.listFiles(target, True)
        while files.hasNext():
            status = files.next()
            each = status.getPath()
            kind = _format(each.getName())
            if kind:
                found.append((each.toUri().toString(), each.toUri().getPath().removeprefix(root), kind, status.getLen()))
        if not found:
            raise InputError(f"{path}: no {', '.join(FORMATS)} files found")
    return [DataFile(uri, label, rank, kind, size) for rank, (uri, label, kind, size) in enumerate(sorted(found, key=lambda x: x[1]))]
