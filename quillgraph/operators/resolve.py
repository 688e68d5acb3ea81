"""Name resolution as joins: longest prefix, ranked candidates, elections, registries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def prefixes(path: Column, sep: str) -> Column:
    """All leading runs of a path's segments, the whole one included."""
    parts = F.split(path, "\\" + sep if sep in ".|" else sep, -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), sep))


def _by_text(left: DataFrame, text: str, best: DataFrame, how: str = "inner") -> DataFrame:
    """left joined with best (_text, _best) by the text itself; equal texts are resolved once."""
    return left.join(best, F.col(text) == F.col("_text"), how).drop("_text")


def _tries(left: DataFrame, text: str, sep: str) -> DataFrame:
    """_text and each leading run of its segments as _prefix, for the distinct texts of a column."""
    return left.select(F.col(text).alias("_text")).where("_text IS NOT NULL").distinct().select("_text", F.explode(prefixes(F.col("_text"), sep)).alias("_prefix"))


def longest_prefix(left: DataFrame, path: str, owners: DataFrame, owner_path: str, owner: str, sep: str = "/", keep_unowned: bool = False) -> DataFrame:
    """left with the owner whose path is the longest leading run of segments of path.

    The ancestors of distinct paths are exploded and equi-joined, so no row meets every owner.
    """
    own = owners.select(F.col(owner_path).alias("_prefix"), F.col(owner).alias("_owner")).where(F.col("_prefix").isNotNull() & (F.col("_prefix") != ""))
    best = _tries(left, path, sep).join(own, "_prefix").groupBy("_text").agg(F.max(F.struct(F.length("_prefix").alias("n"), F.col("_owner"))).alias("_best"))
    out = _by_text(left, path, best, "left" if keep_unowned else "inner")
    return out.withColumn("owner", F.col("_best")["_owner"]).drop("_best")


def raw_prefix(left: DataFrame, name: str, table: DataFrame, prefix: str, value: str) -> DataFrame:
    """The value of the longest entry that name begins with, ending at a segment's end.

    An entry that ends in a dot wants more segments. Names' leading runs of segments are
    equi-joined with the entries, so no name meets every entry.
    """
    entry = table.select(F.regexp_replace(prefix, r"\.$", "").alias("_prefix"), F.col(prefix).endswith(".").alias("_more"), F.length(prefix).alias("_n"), F.col(value).alias("_v")).where(F.col(prefix) != "")
    hit = _tries(left, name, ".").join(entry, "_prefix").where(~F.col("_more") | (F.length("_text") > F.length("_prefix")))
    best = hit.groupBy("_text").agg(F.max(F.struct(F.col("_n").alias("n"), F.col("_v").alias("v"))).alias("_best"))
    return _by_text(left, name, best).withColumn(value, F.col("_best")["v"]).drop("_best")


def best_candidate(candidates: DataFrame, row: Sequence[str], name: str, priority: str, known: DataFrame, known_key: str) -> DataFrame:
    """For each row the known candidate of least priority (ties: least name).

    Joined by sorting: names read out of a small table's text would be taken for small too and
    sent through the driver, all of them.
    """
    met = candidates.join(known.select(F.col(known_key).alias(name)).distinct().hint("merge"), name, "left_semi")
    return met.groupBy(*row).agg(F.min(F.struct(F.col(priority).alias("p"), F.col(name).alias("c"))).alias("_b")).select(*row, F.col("_b")["c"].alias(name), F.col("_b")["p"].alias(priority))


def elect(df: DataFrame, contested: str, *order: Column) -> DataFrame:
    """The first row of each contested key under the order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(contested).orderBy(*order))).where("_n = 1").drop("_n")


def registry(entries: DataFrame, key: str, seq: str, priority: str | None = None, last: bool = True) -> DataFrame:
    """One entry a key: of least priority first, then the last (or first) registered."""
    by_seq = F.col(seq).desc() if last else F.col(seq).asc()
    return elect(entries, key, *([F.col(priority).asc()] if priority else []), by_seq)


def version_key(version: Column) -> Column:
    """A struct that orders versions: numbers part by part, releases over pre-releases."""
    lead = F.regexp_extract(version, r"^[vV]?([0-9]+(?:[._][0-9]+)*)", 1)
    numbers = F.transform(F.filter(F.split(lead, "[._]"), lambda x: x != ""), lambda x: x.try_cast("long"))
    padded = F.slice(F.concat(numbers, F.array_repeat(F.lit(0).cast("long"), 6)), 1, 6)
    rest = F.lower(F.regexp_replace(version, r"^[vV]?[0-9]+(?:[._][0-9]+)*", ""))
    release = F.when(rest.rlike(r"alpha|beta|snapshot|milestone|preview|(^|[^a-z])(rc|cr|m|ea|dev|pre)[0-9]*($|[^a-z])"), 0).otherwise(1)
    flavour = F.when(rest.contains("jre"), 2).when(rest.contains("android"), 0).otherwise(1)
    return F.struct(padded.alias("numbers"), release.alias("release"), flavour.alias("flavour"), rest.alias("qualifier"), version.alias("raw"))


def ordered_pairs(df: DataFrame, group: Sequence[str], *order: str) -> DataFrame:
    """Pairs (earlier, later) within each group under a total order; groups are small."""
    ranked = df.withColumn("_k", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    a, b = ranked.select(*group, F.struct(*df.columns).alias("first"), F.col("_k").alias("_a")), ranked.select(*group, F.struct(*df.columns).alias("second"), F.col("_k").alias("_b"))
    return a.join(b, list(group)).where("_a < _b").select(*group, "first", "second")


def carry_section(lines: DataFrame, doc: str, line_no: str, header: Column) -> DataFrame:
    """lines with section: the last header at or above each line of its document."""
    return lines.withColumn("section", F.last(header, ignorenulls=True).over(W.partitionBy(doc).orderBy(line_no)))
