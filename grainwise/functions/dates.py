"""Date functions that join conditions use."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def next_month(d: Column | str) -> Column:
    """First day of the month after ``d``, as a date."""
    return F.add_months(F.trunc(d, "MM"), 1)


def register_functions(spark: SparkSession) -> None:
    """Makes ``next_month`` callable in SQL text, such as a join condition."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION next_month(d DATE) RETURNS DATE "
              "RETURN add_months(trunc(d, 'MM'), 1)")
