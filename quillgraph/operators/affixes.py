"""Joins of texts with the patterns they begin with or contain, by equal keys.

A condition such as startswith or contains makes Spark compare every text with every pattern.
Here both sides are given keys, so that only equal keys meet: a text has its prefixes of just
those lengths that patterns have, or its grams, of which a pattern names its rarest one. What
contains needs more than the key is tested on the rows that met. Nothing is broadcast by
decree; Spark measures the sides.

Every row of either side counts by itself, repeated ones too. Null meets nothing. An empty
pattern is met by every text, as in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram at most; shorter patterns are a gram of their own length.
GRAM = 8


def _lengths(df: DataFrame, length: Column) -> Column:
    """All lengths that occur, as one value: paths and patterns have a few thousand of them at most."""
    return df.agg(F.collect_set(length)).scalar()


def begins(texts: DataFrame, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """texts joined with the patterns they start with."""
    lengths = _lengths(patterns, F.length(pattern))
    keyed = texts.withColumn("_lengths", lengths).withColumn("_key", F.explode(F.expr(f"transform(filter(_lengths, n -> n <= length(`{text}`)), n -> left(`{text}`, n))"))).drop("_lengths")
    return keyed.join(patterns.withColumn("_key", F.col(pattern)), "_key").drop("_key")


def contains(texts: DataFrame, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """texts joined with the patterns they contain, by the pattern's gram that the fewest texts have."""
    asked = patterns.where(F.col(pattern).isNotNull())
    lengths = _lengths(asked, F.least(F.length(pattern), F.lit(GRAM)))
    grams = f"array_distinct(flatten(transform(_lengths, n -> if(n > length(`{text}`), array(), if(n = 0, array(''), transform(sequence(1, length(`{text}`) - n + 1), k -> substring(`{text}`, k, n)))))))"
    keyed = texts.where(F.col(text).isNotNull()).withColumn("_lengths", lengths).withColumn("_key", F.explode(F.expr(grams))).drop("_lengths")
    counts = keyed.groupBy("_key").agg(F.count("*").alias("_n"))
    own = f"array_distinct(if(length(`{pattern}`) <= {GRAM}, array(`{pattern}`), transform(sequence(1, length(`{pattern}`) - {GRAM - 1}), k -> substring(`{pattern}`, k, {GRAM}))))"
    each = asked.select(pattern).distinct()
    # a gram that no text has ends its pattern's search, so it counts as the rarest
    rare = each.withColumn("_key", F.explode(F.expr(own))).join(counts, "_key", "left").groupBy(pattern).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_key").alias("k"))).alias("_r"))
    rare = rare.where("_r.n > 0").select(pattern, F.col("_r.k").alias("_key"))
    return keyed.join(asked.join(rare, pattern), "_key").where(F.col(text).contains(F.col(pattern))).drop("_key")
