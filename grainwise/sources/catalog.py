"""Named tables, with one to three name parts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from grainwise.errors import AuditError
from grainwise.plans.spec import Join, JoinChain


def _whole(name: str) -> str:
    return f"`{name}`"


def register_tables(spark: SparkSession, tables: Mapping[str, DataFrame], copy: bool = False) -> None:
    """Makes tables known under their names of one to three parts.

    Nothing is copied: a temporary view bears the whole name, dots included, and
    :func:`named_table` finds it before the catalog's tables, which stay as they are.
    ``copy`` writes names of two or three parts as tables of the catalog (the session must
    have it) instead, so that SQL text can name them; a table that exists is an error.
    """
    for name, df in tables.items():
        parts = name.split(".")
        if len(parts) > 3:
            raise AuditError(f"{name!r} has more than three name parts.")
        if not copy or len(parts) == 1:
            df.createOrReplaceTempView(_whole(name))
            continue
        schema, target = (".".join(map(_whole, ps)) for ps in (parts[:-1], parts))
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
        try:
            df.write.mode("errorifexists").saveAsTable(target)
        except AnalysisException as e:
            raise AuditError(f"{name!r} was not written: {str(e).splitlines()[0]}") from e


def named_table(spark: SparkSession, name: str) -> DataFrame:
    """The view registered under the whole name, else the catalog's table."""
    try:
        return spark.table(_whole(name))
    except AnalysisException:
        return spark.table(name)


def table_chain(spark: SparkSession, driving: str, alias: str, joins: list[dict], **chain) -> JoinChain:
    """A chain over named tables: each join gives ``table`` instead of ``df``."""
    bound = []
    for j in joins:
        options = dict(j)
        table = options.pop("table")
        bound.append(Join(named_table(spark, table), name=table, **options))
    return JoinChain(named_table(spark, driving), alias, bound, name=driving, **chain)
