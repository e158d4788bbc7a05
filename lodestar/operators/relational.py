"""Joins, aggregation, ordering and set operations with the dialect's rules for nulls.

Catalyst picks the physical form: a broadcast only where statistics bound the size, else a sort-merge join that adaptive
execution splits at skewed keys; aggregates are partial before their shuffle; ordered limits are top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RowBudgetExceeded


def ordered(*keys: tuple[str | Column, str]) -> list[Column]:
    """Sort keys from (column, "asc" or "desc"): nulls come last ascending and first descending."""
    columns = [(F.col(c) if isinstance(c, str) else c, way) for c, way in keys]
    return [c.asc_nulls_last() if way == "asc" else c.desc_nulls_first() for c, way in columns]


def join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Any of inner, left, right, full on any predicate; both sides keep all their columns."""
    return left.join(right, on, how)


def join_using(left: DataFrame, right: DataFrame, *names: str) -> DataFrame:
    """USING: equal on the names, but neither side's columns are merged."""
    on = F.lit(True)
    for n in names:
        on &= left[n] == right[n]
    return left.join(right, on)


def semi(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """column IN (SELECT ...): values has one column."""
    return df.join(values.toDF("__in"), F.col(column) == F.col("__in"), "left_semi")


def null_aware_anti(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """column NOT IN (SELECT ...): no row passes if the values hold a null, all rows if there are no values.

    Two facts about the values decide the nulls; the rest is a shuffled anti join on equality, which scales where a null-aware
    anti join on the raw values would have to broadcast them.
    """
    values = values.toDF("__in")
    facts = values.agg(F.count("*").alias("__n"), F.count_if(F.col("__in").isNull()).alias("__nulls"))
    left = df.join(F.broadcast(facts)).where("__nulls = 0").where((F.col("__n") == 0) | F.col(column).isNotNull())
    return left.join(values.where("__in is not null"), F.col(column) == F.col("__in"), "left_anti").drop("__n", "__nulls")


def aggregate(df: DataFrame, by: list[str | Column], *aggs: Column, having: Column | None = None) -> DataFrame:
    """Group and aggregate; no keys give one row even over no rows."""
    out = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return out if having is None else out.where(having)


def distinct_ordered(df: DataFrame, columns: list[str], *keys: tuple[str | Column, str]) -> DataFrame:
    """SELECT DISTINCT columns ORDER BY keys that may be hidden: each row stands where it would first appear.

    Keys of one direction are compared as one tuple, whose least (greatest) Spark finds with partial aggregates. Keys of
    both directions have no such tuple: equal rows are grouped first, then each group's first row is taken by a window.
    """
    named = [(F.col(c) if isinstance(c, str) else c).alias(f"__k{i}") for i, (c, _) in enumerate(keys)]
    names, ways = [f"__k{i}" for i in range(len(keys))], {way for _, way in keys}
    order = ordered(*((n, way) for n, (_, way) in zip(names, keys, strict=True)))
    rows = df.select(*columns, *named)
    if len(ways) == 1:
        whole = F.struct(*(x for n in names for x in (F.col(n).isNull().alias(f"{n}_null"), F.col(n))))  # null is the greatest
        first = rows.groupBy(*columns).agg((F.min if ways == {"asc"} else F.max)(whole).alias("__k")).select(*columns, "__k.*")
    else:
        window = Window.partitionBy(*columns).orderBy(*order)
        first = rows.distinct().withColumn("__n", F.row_number().over(window)).where("__n = 1")
    return first.orderBy(*order).select(*columns)


def by_position(df: DataFrame, *keys: tuple[int, str]) -> list[Column]:
    """Sort keys from (ordinal of an output column, "asc" or "desc"), counted from 1."""
    return ordered(*((df.columns[i - 1], way) for i, way in keys))


def limited(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """LIMIT n OFFSET m; no limit for None."""
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def within_budget(df: DataFrame, rows: int = 10_000_000) -> DataFrame:
    """The frame itself if a result of so few rows may go to a client; raises otherwise. Its plan runs once for the count."""
    if df.limit(rows + 1).count() > rows:
        raise RowBudgetExceeded(f"result exceeds {rows} rows")
    return df
