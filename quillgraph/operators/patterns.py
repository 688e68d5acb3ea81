"""Pattern pieces: optional branches, existence tests, collected lists, top-k, pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def collected(col: str | Column, most: int | None = None, distinct: bool = True) -> Column:
    """A sorted list of a group's values; null values are left out; sliced after sorting."""
    c = F.sort_array((F.collect_set if distinct else F.collect_list)(col))
    return F.slice(c, 1, most) if most else c


def listed(col: str | Column, most: int | None = None, distinct: bool = True, sep: str = "|") -> Column:
    """collected() as text, values joined by sep; an empty group gives an empty text."""
    return F.array_join(collected(col, most, distinct), sep)


def first_lists(pairs: DataFrame, key: str, value: str, most: int, name: str) -> DataFrame:
    """key and a sorted list of its least distinct values, at most so many.

    The rank is cut off before the shuffle and again after it (Spark's window group limit,
    for up to a thousand values), so no task sends or gathers more than most values of a key.
    """
    once = pairs.where(F.col(value).isNotNull()).select(key, value).distinct().withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(value))).where(F.col("_k") <= most)
    return once.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(name))


def first_values(pairs: DataFrame, key: str, value: str, most: int, name: str, sep: str = "|") -> DataFrame:
    """The least distinct values of each key as text, of first_lists()."""
    return first_lists(pairs, key, value, most, name).withColumn(name, F.array_join(name, sep))


def optional_branches(base: DataFrame, key: str, **branches: DataFrame) -> DataFrame:
    """Left joins of branches that are aggregated on the key each by itself.

    Independent optional patterns multiply one another's rows before distinct aggregates
    collapse them; aggregating first gives the same lists and counts without the product.
    """
    out = base
    for branch in branches.values():
        out = out.join(branch, key, "left")
    return out


def optional_match(base: DataFrame, right: DataFrame, on: str, where: Column | None = None) -> DataFrame:
    """Left join whose condition belongs to the optional side, not to the result."""
    return base.join(right.where(where) if where is not None else right, on, "left")


def exists(base: DataFrame, pattern: DataFrame, on: Sequence[str] | str) -> DataFrame:
    return base.join(pattern, on, "left_semi")


def not_exists(base: DataFrame, pattern: DataFrame, on: Sequence[str] | str) -> DataFrame:
    return base.join(pattern, on, "left_anti")


def top_k(df: DataFrame, k: int, by: str, *ties: str) -> DataFrame:
    """The k greatest by a column, ties in ascending order of others (nulls last)."""
    return df.orderBy(F.col(by).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]).limit(k)


def ordered(df: DataFrame, *cols: str) -> DataFrame:
    """Ascending with nulls last."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in cols])


def sampled(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n random rows, the same for one seed."""
    return df.orderBy(F.rand(seed)).limit(n)


def totals(df: DataFrame, *by: str) -> DataFrame:
    """Row counts for each combination and, with nulls in place, for all (roll-up)."""
    return df.rollup(*by).agg(F.count("*").alias("n"))


#: Rows of items whose pairs one task gathers.
ROWS = 200_000


def co_occurrence(items: DataFrame, group: str, item: str, least: int = 1) -> DataFrame:
    """a < b, n_both and confidence (n_both over a's groups) for items that share groups.

    Groups are baskets of bounded size (an order's lines, a commit's files). The number of tasks
    follows the rows, so that a task counts as many pairs in memory whatever the table's size.
    """
    tasks = max(items.sparkSession.sparkContext.defaultParallelism, -(-items.count() // ROWS))
    pairs = items.select(group, item).repartition(tasks, group).distinct()
    count = pairs.groupBy(item).agg(F.count("*").alias("n_a"))
    both = pairs.select(group, F.col(item).alias("a")).join(pairs.select(group, F.col(item).alias("b")), group).where("a < b").repartition(tasks, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= least)
    return both.join(count.withColumnRenamed(item, "a"), "a").select("a", "b", "n_both", (F.col("n_both") / F.col("n_a")).alias("confidence"))
