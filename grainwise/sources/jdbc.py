"""Live databases through Spark's JDBC reader."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from grainwise.errors import AuditError

SAMPLE_ROWS = 50_000

# How each kind of database takes the first n rows of a table.
FIRST_ROWS = {
    "netezza": "SELECT * FROM {table} LIMIT {n}",
    "databricks": "SELECT * FROM {table} TABLESAMPLE ({n} ROWS)",
    "oracle": "SELECT * FROM {table} FETCH FIRST {n} ROWS ONLY",
    "sqlserver": "SELECT TOP ({n}) * FROM {table}",
}


@dataclass(frozen=True)
class JdbcSource:
    """One database.  ``options`` go to the reader as they are (user, password, driver)."""

    spark: SparkSession
    kind: str
    url: str
    options: Mapping[str, str] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        if self.kind not in FIRST_ROWS:
            raise AuditError(f"Unknown database kind {self.kind!r}; one of {', '.join(FIRST_ROWS)}.")

    def _reader(self):
        return self.spark.read.format("jdbc").options(**self.options).option("url", self.url)

    def query(self, sql: str) -> DataFrame:
        """A query the database runs; its result is read over one connection."""
        return self._reader().option("query", trimmed(sql)).load()

    def table(self, name: str, partition_column: str | None = None, lower: int | None = None,
              upper: int | None = None, partitions: int | None = None) -> DataFrame:
        """A whole table; with a partition column, executors read ranges of it in parallel.
        Rows outside the bounds still belong to the first and last range."""
        reader = self._reader().option("dbtable", name)
        if partition_column is not None:
            if None in (lower, upper, partitions):
                raise AuditError("A partitioned read needs lower, upper and partitions.")
            reader = (reader.option("partitionColumn", partition_column).option("lowerBound", lower)
                      .option("upperBound", upper).option("numPartitions", partitions))
        return reader.load()

    def sample(self, table: str, n: int = SAMPLE_ROWS) -> DataFrame:
        return self.query(FIRST_ROWS[self.kind].format(table=table, n=int(n)))

    def row_count(self, table: str) -> int:
        """Counted by the database; one number is transferred."""
        return int(self.query(f"SELECT COUNT(*) AS n FROM {table}").first()[0])

    def query_row_count(self, sql: str) -> int:
        return int(self.query(counting(sql)).first()[0])


def trimmed(sql: str) -> str:
    return sql.strip().rstrip(";").rstrip()


def counting(sql: str) -> str:
    return f"SELECT COUNT(*) AS n FROM ({trimmed(sql)}) counted"


def query_row_count(spark: SparkSession, sql: str) -> int:
    """The same for a query over catalog tables."""
    return int(spark.sql(counting(sql)).first()[0])
