"""Small file operations on whatever file system a path belongs to, through Spark's own client."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.sql import SparkSession

# Files that are opened at a time.
OPENED = 32


def _place(spark: SparkSession, path: str):
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(context._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    where, files = _place(spark, path)
    files.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _place(spark, path)
    return files.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    where, files = _place(spark, path)
    if not files.exists(where):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(where))


def listed(spark: SparkSession, paths: list[str]) -> list[str]:
    """All data files at or below the given paths and patterns, hidden ones left out."""
    out = []
    for path in paths:
        where, files = _place(spark, path)
        found = files.globStatus(where)
        if found is None or not len(found):
            raise FileNotFoundError(path)
        stack = sorted(found, key=lambda s: s.getPath().toString())
        while stack:
            status = stack.pop(0)
            name = status.getPath().getName()
            if name.startswith(("_", ".")):
                continue
            if status.isDirectory():
                below = files.listStatus(status.getPath())
                stack[:0] = sorted(below, key=lambda s: s.getPath().toString())
            else:
                out.append(status.getPath().toString())
    return out


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    where, files = _place(spark, path)
    stream = files.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def first_lines(spark: SparkSession, paths: list[str], size: int = 1 << 14) -> list[str | None]:
    """The first line of each file that is not blank, from its first bytes alone; None without one.

    More bytes are taken only where ``size`` of them hold no such line. Files are opened by several
    threads at a time, and compressed ones are unpacked by their codec.
    """
    context = spark.sparkContext
    codecs = context._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(context._jsc.hadoopConfiguration())

    def first(path: str) -> str | None:
        where, files = _place(spark, path)
        stream = files.open(where)
        codec = codecs.getCodec(where)
        try:
            text = codec.createInputStream(stream) if codec is not None else stream
            held, ended = b"", False
            while True:
                more = bytes(text.readNBytes(size))
                held, ended = held + more, len(more) < size
                *lines, rest = held.replace(b"\r", b"\n").split(b"\n")
                for line in [*lines, rest] if ended else lines:
                    if line.removeprefix(b"\xef\xbb\xbf").strip():
                        return line.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")
                if ended:
                    return None
        finally:
            stream.close()

    with ThreadPool(min(OPENED, max(1, len(paths)))) as pool:
        return pool.map(first, paths)


def swap_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file in one step: readers see the old text or the new one."""
    jvm = spark.sparkContext._jvm
    fresh, files = _place(spark, f"{path}.new")
    stream = files.create(fresh, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    overwrite = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(overwrite, 1)
    how[0] = overwrite.OVERWRITE
    target = jvm.org.apache.hadoop.fs.Path(path)
    uri = files.makeQualified(fresh)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(uri, files.makeQualified(target), how)
