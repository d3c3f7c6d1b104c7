"""Assertions inside a plan: a job fails where rows break what they have to keep, without an action of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guarded(rows: DataFrame, checked: DataFrame, broken: Column, message: Column | str) -> DataFrame:
    """``rows``; reading them fails with ``message`` (of a row of ``checked``) if ``broken`` holds for any.

    What is broken is part of the expression that fails: a filter of its own could be evaluated after it. All columns of
    the failing rows fail too: constants could be found to be dropped later on.
    """
    message = F.lit(message) if isinstance(message, str) else message
    failing = checked.where(F.when(broken, F.raise_error(message).cast("boolean")).otherwise(False))
    return rows.unionByName(failing.select(*[F.when(broken, F.raise_error(message)).cast(f.dataType).alias(f.name) for f in rows.schema.fields]))


def not_empty(rows: DataFrame, message: str) -> DataFrame:
    """``rows``; reading them fails if there are none."""
    return guarded(rows, rows.limit(1).agg(F.count("*").alias("n")), F.col("n") == 0, message)


def unique(rows: DataFrame, key: str) -> DataFrame:
    """``rows``; reading them fails if a ``key`` occurs twice."""
    message = F.concat(F.lit(f"{key} occurs more than once: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return guarded(rows, rows.groupBy(key).agg(F.count("*").alias("n")), F.col("n") > 1, message)
