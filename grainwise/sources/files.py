"""One table per Parquet, CSV or TSV file of a folder."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, count

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from grainwise.errors import AuditError
from grainwise.sources.names import sanitize_name

SUFFIXES = (".parquet", ".csv", ".tsv", ".txt")
DELIMITERS = ",\t;|"
#: Bytes of a text table that are read to find its header line.
HEADER_BYTES = 1 << 16


@dataclass
class LoadedFolder:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)


def file_system(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The Hadoop file system a path lies on, and the path as that system's object."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def data_files(spark: SparkSession, path: str) -> Iterator[JavaObject]:
    """The non-empty files of a table, itself a file or a folder that Spark wrote."""
    system, target = file_system(spark, path)
    for status in sorted(system.listStatus(target), key=lambda s: s.getPath().getName()):
        if status.isFile() and status.getLen() and not status.getPath().getName().startswith(("_", ".")):
            yield status.getPath()


def header_line(spark: SparkSession, path: str) -> str:
    """The first line of a text table, from the start of its first file: no job runs."""
    for file in data_files(spark, path):
        codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(
            spark.sparkContext._jsc.hadoopConfiguration())
        codec = codecs.getCodec(file)
        stream = file_system(spark, path)[0].open(file)
        try:
            stream = codec.createInputStream(stream) if codec else stream
            head = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(
                spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, HEADER_BYTES)))
        finally:
            stream.close()
        lines = head.decode("utf-8-sig", "replace").splitlines()
        return next((line for line in lines if line.strip()), "")
    raise AuditError("No columns to read: the file is empty")


def sniff_delimiter(header: str) -> str:
    """The delimiter of a text table, judged by its header line."""
    try:
        return csv.Sniffer().sniff(header, DELIMITERS).delimiter
    except csv.Error:
        return ","


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               multiline: bool = False) -> DataFrame:
    """Parquet as is; text with a header line, types inferred unless ``schema`` is given.

    A quote inside a quoted value is doubled.  Values that hold line breaks need
    ``multiline``, which reads each file in one task.  Inference reads the file once more,
    so state the schema for large files."""
    if path.rstrip("/").lower().endswith(".parquet"):
        return spark.read.parquet(path)
    reader = (spark.read.option("header", True).option("sep", sniff_delimiter(header_line(spark, path)))
              .option("escape", '"').option("multiLine", multiline))
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Table paths directly under ``folder`` on any file system Spark reads; a table
    written by Spark is a folder with a known suffix.  File contents are not read."""
    system, target = file_system(spark, folder)
    names = sorted(status.getPath().getName() for status in system.listStatus(target))
    return [f"{folder.rstrip('/')}/{n}" for n in names if n.lower().endswith(SUFFIXES)]


def load_folder(spark: SparkSession, folder: str, schemas: dict[str, T.StructType | str] | None = None,
                multiline: bool = False) -> LoadedFolder:
    """Every readable table of a folder; an unreadable file becomes an error, not a failure.

    Of files that would share a name, the first keeps it and the next get ``_2``, ``_3``."""
    out = LoadedFolder()
    given: set[str] = set()
    for path in list_files(spark, folder):
        file = path.rsplit("/", 1)[-1]
        base = sanitize_name(file.rsplit(".", 1)[0])
        name = next(n for n in chain([base], (f"{base}_{k}" for k in count(2))) if n not in given)
        given.add(name)
        try:
            out.tables[name] = read_table(spark, path, (schemas or {}).get(name), multiline)
        except Exception as e:  # readers raise whatever their format does
            out.errors.append(f"{file}: {str(e).splitlines()[0]}")
    return out
