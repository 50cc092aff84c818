"""Stores by URI: providers by scheme, formats, partitioned files, and writes that run together."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

from lattica.errors import BadStore, DuplicateStore, StoreExists, UnknownScheme

#: Schemes that Hadoop file systems serve.
FILE_SCHEMES = ("", "file", "hdfs", "viewfs", "wasb", "wasbs", "abfs", "abfss", "azureblob", "s3a", "gs")
FORMATS = {".parquet": "parquet", ".txt": "text", ".json": "json", ".csv": "csv", ".orc": "orc"}


@dataclass
class Provider:
    """How a scheme's stores are read, written and tested."""

    read: Callable[..., DataFrame]
    write: Callable[..., None]
    exists: Callable[[SparkSession, str], bool]


_PROVIDERS: dict[str, Provider] = {}


def register(scheme: str, provider: Provider) -> None:
    """Serves a scheme's URIs by the provider; a later one replaces an earlier."""
    _PROVIDERS[scheme] = provider


def _provider(uri: str) -> Provider:
    scheme = urlparse(uri).scheme
    if scheme not in _PROVIDERS:
        raise UnknownScheme(f"no provider for {scheme!r}")
    return _PROVIDERS[scheme]


def _path(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _format(uri: str, format: str | None) -> str:
    return format or FORMATS.get(posixpath.splitext(uri.rstrip("/"))[1], "parquet")


def _translated(uri: str) -> str:
    return uri.replace("azureblob://", "wasbs://", 1)


def _read_files(spark: SparkSession, uri: str, format: str | None = None, schema=None, deserializer=None, **options) -> DataFrame:
    """A file or folder.  A deserializer maps batches of (path, content) to rows of ``schema``."""
    if deserializer is not None:
        return spark.read.format("binaryFile").load(_translated(uri)).select("path", "content").mapInPandas(deserializer, schema)
    reader = spark.read.format(_format(uri, format)).options(**options)
    frame = (reader.schema(schema) if schema is not None else reader).load(_translated(uri))
    return frame.withColumnRenamed("value", "line") if _format(uri, format) == "text" else frame


def _write_files(df: DataFrame, uri: str, replace: bool, format: str | None = None, compression: str | None = None, serializer=None, **options) -> None:
    """Folder of part files.  A serializer maps batches of rows to one string column ``line``, written as text."""
    kind = _format(uri, format)
    if serializer is not None:
        df, kind = df.mapInPandas(serializer, "line string"), "text"
    writer = df.write.format(kind).mode("overwrite" if replace else "errorifexists").options(**options)
    if compression is not None:
        writer = writer.option("compression", compression)
    writer.save(_translated(uri))


def _exists_file(spark: SparkSession, uri: str) -> bool:
    path, system = _path(spark, _translated(uri))
    return system.exists(path)


def _index_lines(lines: list[str]) -> tuple[str, list[list[str]]]:
    lines = [line.strip() for line in lines if line.strip()]
    if len(lines) < 2 or not lines[1].isdigit():
        raise BadStore("an index starts with the base path and the partition count")
    parts = [line.split(",", 2) for line in lines[2:]]
    if len(parts) != int(lines[1]) or not all(p[0].isdigit() and len(p) > 1 for p in parts):
        raise BadStore("an index has a line for each partition")
    return lines[0], parts


def read_partfile_index(lines: list[str]) -> tuple[str, list[int]]:
    """(base path, partition numbers) of an index: the base, the count, then ``number,size[,machine[:path]]`` lines."""
    base, parts = _index_lines(lines)
    return base, [int(p[0]) for p in parts]


def partfile_paths(lines: list[str]) -> list[str]:
    """Where an index's partitions lie: at their own paths, where their lines name one, else at the base's with their numbers.

    Which machine holds a partition is the file system's concern.
    """
    base, parts = _index_lines(lines)
    own = [p[2].partition(":")[2] if len(p) > 2 else "" for p in parts]
    return [path or f"{base}.{int(p[0]):08x}" for p, path in zip(parts, own, strict=True)]


def _index(uri: str) -> str:
    """partfile:///path is a local path; partfile:hdfs://host/path is one in another file system."""
    inner = uri.removeprefix("partfile:")
    return "file://" + urlparse(uri).path if inner.startswith("//") else inner


def _read_partfile(spark: SparkSession, uri: str, format: str = "text", schema=None, **options) -> DataFrame:
    lines = [r["value"] for r in spark.read.text(_index(uri)).coalesce(1).toLocalIterator()]
    reader = spark.read.format(format).options(**options)
    frame = (reader.schema(schema) if schema is not None else reader).load(partfile_paths(lines))
    return frame.withColumnRenamed("value", "line") if format == "text" else frame


def _write_partfile(df: DataFrame, uri: str, replace: bool, format: str = "text", compression: str | None = None, **options) -> None:
    """One file per partition of df, named base.XXXXXXXX, and the index.

    A compressed partition's name ends in its codec's suffix, which readers tell
    it by; its line in the index then names its path.
    """
    spark, index = df.sparkSession, _index(uri)
    base = posixpath.splitext(index)[0]
    folder = f"{base}.{uuid.uuid4().hex}"
    writer = df.write.format(format).options(**options)
    (writer.option("compression", compression) if compression else writer).save(folder)
    path, system = _path(spark, folder)
    parts = sorted((s.getPath().getName(), s) for s in system.listStatus(path) if s.getPath().getName().startswith("part-"))
    lines = [base, str(len(parts))]
    for n, (name, status) in enumerate(parts):
        suffix = posixpath.splitext(name)[1] if compression and format == "text" else ""
        suffix = "" if suffix == ".txt" else suffix
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{base}.{n:08x}{suffix}")
        system.delete(target, False)
        system.rename(status.getPath(), target)
        lines.append(f"{n},{status.getLen()}" + (f",any:{base}.{n:08x}{suffix}" if suffix else ""))
    system.delete(path, True)
    out = system.create(spark._jvm.org.apache.hadoop.fs.Path(index), replace)
    out.write(bytearray("\n".join(lines) + "\n", "utf-8"))
    out.close()


def _exists_partfile(spark: SparkSession, uri: str) -> bool:
    return _exists_file(spark, _index(uri))


for _scheme in FILE_SCHEMES:
    register(_scheme, Provider(_read_files, _write_files, _exists_file))
register("partfile", Provider(_read_partfile, _write_partfile, _exists_partfile))


def read_store(spark: SparkSession, uri: str, **options) -> DataFrame:
    return _provider(uri).read(spark, uri, **options)


@dataclass
class Write:
    """A prepared write: nothing runs before submit()."""

    frame: DataFrame
    uri: str
    replace: bool = False
    options: dict = field(default_factory=dict)

    def run(self) -> None:
        _provider(self.uri).write(self.frame, self.uri, self.replace, **self.options)


class Job:
    """Writes under way."""

    def __init__(self, spark: SparkSession, tag: str, futures: list[Future]):
        self._spark, self._tag, self._futures = spark, tag, futures

    def wait(self) -> None:
        for future in self._futures:
            future.result()

    def cancel(self) -> None:
        self._spark.sparkContext.cancelJobsWithTag(self._tag)

    def done(self) -> bool:
        return all(f.done() for f in self._futures)


def submit(spark: SparkSession, writes: Iterable[Write]) -> Job:
    """Starts writes together; shared inputs are worth a persist() by the caller.

    Fails before anything runs if a store is named twice, or exists and isn't to be replaced.
    """
    writes = list(writes)
    if len({w.uri for w in writes}) < len(writes):
        raise DuplicateStore("each write needs a store of its own")
    for w in writes:
        if not w.replace and _provider(w.uri).exists(spark, w.uri):
            raise StoreExists(w.uri)
    tag = f"lattica-{uuid.uuid4().hex}"

    def run(write: Write) -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            write.run()
        finally:
            spark.sparkContext.removeJobTag(tag)

    pool = ThreadPoolExecutor(max_workers=max(1, len(writes)))
    job = Job(spark, tag, [pool.submit(run, w) for w in writes])
    pool.shutdown(wait=False)
    return job
