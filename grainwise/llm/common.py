"""Helpers shared by the operators: kept tables, blocks of words, set-up inside tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from grainwise.plans.storage import new_folder

#: Bytes of a text that are cut into words at once.
BLOCK_BYTES = 1 << 20
#: The contract's blanks: space and the five control characters 0x09 to 0x0D.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
_BLANK = re.compile(b"[\x20\x09-\x0d]")
#: Rows that :func:`map_rows` turns into Python values, and sends back, at a time.
IN_ROWS, OUT_ROWS = 256, 10_000
#: Rows up to which a small table is broadcast.
BROADCAST_ROWS = 50_000


def keep(df: DataFrame) -> DataFrame:
    """``df`` written once to shared storage and read back: lost executors lose none of it,
    and what follows starts from a plain scan.  The files go when the session ends; folders of
    one machine are refused on a cluster (:func:`~grainwise.plans.storage.new_folder`)."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attach(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", salts: int = 32) -> DataFrame:
    """Joins a kept ``table`` (one row per key) to ``df``.  It is counted first: up to
    ``BROADCAST_ROWS`` rows it is broadcast; a larger one is repeated per salt, so that the
    rows of a frequent key meet it in ``salts`` tasks."""
    if table.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(table), keys, how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.lit(salts)).cast("int")
    return df.withColumn("_salt", spread).join(salted, [*keys, "_salt"], how).drop("_salt")


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; NULL counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def map_rows(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterator[tuple]], ddl: str) -> DataFrame:
    """Rows that ``fn`` makes of each partition's rows.  Values arrive and leave as they are
    (an integer stays one beside NULLs), and few rows are held at a time."""
    schema = T.StructType.fromDDL(ddl)
    layout = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for start in range(0, batch.num_rows, IN_ROWS):
                yield from zip(*(c.to_pylist() for c in batch.slice(start, IN_ROWS).columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = fn(rows(batches))
        while out := list(islice(made, OUT_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), layout)], schema=layout)

    return df.mapInArrow(run, schema)


def word_blocks(text: bytes, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, A-Z in lower case, in blocks of about ``size`` bytes."""
    start = 0
    while start < len(text):
        end = len(text)
        if end - start > size:
            cut = _BLANK.search(text, start + size)
            end = cut.start() if cut else end
        yield text[start:end].lower().split()
        start = end
