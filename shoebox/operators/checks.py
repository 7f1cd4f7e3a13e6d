"""Table checks: rules on columns, uniqueness, references; and what deletions take along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def required(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c).cast("string") == "")


def too_long(c: str, most: int) -> Column:
    return F.length(c) > most


def out_of_range(c: str, low=None, high=None) -> Column:
    out = F.lit(False)
    out = out if low is None else out | (F.col(c) < low)
    return out if high is None else out | (F.col(c) > high)


def not_one_of(c: str, *values) -> Column:
    return F.col(c).isNotNull() & ~F.col(c).isin(*values)


def violations(df: DataFrame, id: str, rules: dict[str, Column]) -> DataFrame:
    """id, rule for every rule (name: condition of a fault) that a row breaks. A null condition is no fault."""
    broken = F.array_compact(F.array(*[F.when(fault, F.lit(name)) for name, fault in rules.items()]))
    return df.select(F.col(id).alias("id"), F.explode(broken).alias("rule"))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dangling(df: DataFrame, key: str, parent: DataFrame, id: str = "id") -> DataFrame:
    """Rows whose key is set and has no parent."""
    return df.where(F.col(key).isNotNull()).join(parent.select(F.col(id).alias(key)), key, "left_anti")


def cascade(children: DataFrame, key: str, deleted: DataFrame, id: str = "id") -> DataFrame:
    """children without those of deleted parents."""
    return children.join(deleted.select(F.col(id).alias(key)), key, "left_anti")


def clear_reference(children: DataFrame, key: str, deleted: DataFrame, id: str = "id") -> DataFrame:
    """children with the key of deleted parents set to null."""
    gone = deleted.select(F.col(id).alias(key)).distinct().withColumn("_gone", F.lit(True))
    return children.join(gone, key, "left").select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == key else F.col(c) for c in children.columns])
