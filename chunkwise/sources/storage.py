"""Whole objects and byte ranges by their address, over any file system that Arrow knows: paths, file, s3, gs, hdfs; http only for reading."""

from __future__ import annotations

import hashlib
import urllib.request

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def _at(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url) if "://" in url else (fs.LocalFileSystem(), url)


def _web(url: str) -> bool:
    return url.startswith(("http://", "https://"))


def size(url: str) -> int:
    if _web(url):
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD")) as r:
            return int(r.headers["Content-Length"])
    where, path = _at(url)
    info = where.get_file_info(path)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(url)
    return info.size


def read_range(url: str, start: int, end: int) -> bytes:
    """Bytes from start up to but not including end; none where that is empty."""
    if end <= start:
        return b""
    if _web(url):
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Range": f"bytes={start}-{end - 1}"})) as r:
            data = r.read()
            return data if r.status == 206 else data[start:end]
    where, path = _at(url)
    with where.open_input_file(path) as f:
        f.seek(start)
        return f.read(end - start)


def read_all(url: str) -> bytes:
    if _web(url):
        with urllib.request.urlopen(url) as r:
            return r.read()
    where, path = _at(url)
    with where.open_input_stream(path) as f:
        return f.read()


def md5(url: str, portion: int = 32 << 20) -> str:
    """In hexadecimal digits; read portion by portion."""
    out, total = hashlib.md5(usedforsecurity=False), size(url)
    for at in range(0, total, portion):
        out.update(read_range(url, at, min(at + portion, total)))
    return out.hexdigest()


def write(url: str, data: bytes) -> None:
    if _web(url):
        raise ValueError("http addresses can't be written to")
    where, path = _at(url)
    where.create_dir(path.rpartition("/")[0] or ".", recursive=True)
    with where.open_output_stream(path) as f:
        f.write(data)


def write_parts(url: str, parts) -> None:
    """Write bytes one after the other, so that they needn't be in memory together."""
    if _web(url):
        raise ValueError("http addresses can't be written to")
    where, path = _at(url)
    where.create_dir(path.rpartition("/")[0] or ".", recursive=True)
    with where.open_output_stream(path) as f:
        for part in parts:
            f.write(part)


def delete(url: str) -> None:
    """Best effort: what isn't there or can't be removed is left alone."""
    try:
        where, path = _at(url)
        where.delete_file(path)
    except OSError:
        pass


def delete_folder(url: str) -> None:
    """Best effort, and only if it is empty or holds nothing but leftovers of parts."""
    try:
        where, path = _at(url)
        where.delete_dir(path)
    except OSError:
        pass


def delete_all(url: str) -> None:
    """Best effort: a folder or file, and files beside it whose names begin with it and a dot."""
    try:
        where, path = _at(url)
        above, _, name = path.rpartition("/")
        for f in where.get_file_info(fs.FileSelector(above)):
            if f.base_name == name or f.base_name.startswith(name + "."):
                (where.delete_dir if f.type == fs.FileType.Directory else where.delete_file)(f.path)
    except OSError:
        pass


def listed(url: str) -> list[tuple[str, int]]:
    """Path and size of each file of a folder, or of the one file that this is."""
    where, path = _at(url)
    info = where.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(url)
    return sorted((f.path, f.size) for f in where.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File)


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of files; content isn't read unless it is used."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def part_name(out: str, part: int) -> str:
    return f"{out}.parts/part-{part:06d}"
