"""Library usage of a full build: packages of the build tool's archive caches, joined to imports."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.extract import java
from quillgraph.operators import resolve
from quillgraph.sources import archives as A


def main_archives(archives: DataFrame) -> DataFrame:
    """coordinate, version, path: the main file of every version of each artifact.

    All versions count, as which library owns a package does not depend on the one chosen.
    """
    c = F.col
    plain = archives.where(~c("path").rlike(r"-(?:sources|javadoc|tests?)\.jar$"))
    main = F.when(F.substring_index("path", "/", -1) == F.concat("artifact", F.lit("-"), "version", F.lit(".jar")), 0).otherwise(1)
    order = W.partitionBy("group", "artifact", "version").orderBy(main, F.length("path"), "path")
    return plain.withColumn("k", F.row_number().over(order)).where("k = 1").select(F.concat("group", F.lit(":"), "artifact").alias("coordinate"), "version", "path")


def cached_packages(spark: SparkSession, roots: list[str], keep: str | None = None, lockfile: str | None = None) -> DataFrame:
    """coordinate, version, package of all archives below the roots; kept at keep until they change."""
    found = A.archives(spark, roots)

    def make() -> DataFrame:
        main = main_archives(found.select("group", "artifact", "version", "path"))
        return java.archive_packages(found.join(main.select("path"), "path", "left_semi")).join(main, "path").select("coordinate", "version", "package")

    if keep is None:
        return make()
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jar").load(roots)
    seen = listing.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("h")).first()
    return A.kept(spark, keep, f"{A.signature(roots, lockfile)} {seen['n']} {seen['h']}", make)


def owners(packages: DataFrame, libraries: DataFrame) -> DataFrame:
    """package -> coordinate among the graph's libraries.

    Of several owners the one that has it in its own version (the graph's, else the greatest
    cached), the one whose group is nearest, then the shortest and least name.
    """
    c = F.col
    known = packages.join(libraries.select("coordinate", c("latestVersion").alias("wanted")), "coordinate")
    exact = F.when(c("version") == c("wanted"), 0).otherwise(1)
    versions = known.select("coordinate", "version", exact.alias("off")).distinct()
    chosen = resolve.elect(versions, "coordinate", c("off"), resolve.version_key(c("version")).desc()).select("coordinate", "version", F.lit(0).alias("chosen"))
    ranked = known.join(chosen, ["coordinate", "version"], "left").groupBy("package", "coordinate").agg(F.min(F.coalesce("chosen", F.lit(1))).alias("chosen"))
    group = F.substring_index("coordinate", ":", 1)
    near = F.when((c("package") == group) | c("package").startswith(F.concat(group, F.lit("."))), F.length(group)).otherwise(0)
    return resolve.elect(ranked, "package", c("chosen"), -near, F.length("coordinate"), c("coordinate")).select("package", "coordinate")


def extractor(roots: list[str] | None = None, keep: str | None = None, lockfile: str | None = None, manual: DataFrame | None = None) -> Callable[[DataFrame, dict[str, DataFrame]], dict[str, DataFrame]]:
    """The lib_usage extractor; roots: archive caches, by default those of the build tool's homes."""

    def lib_usage(files: DataFrame, graph: dict[str, DataFrame]) -> dict[str, DataFrame]:
        spark = files.sparkSession
        places = A.cache_roots() if roots is None else roots
        if places:
            packages = owners(cached_packages(spark, places, keep, lockfile), graph["ExternalLibrary"])
        else:
            logging.getLogger(__name__).warning("no archive cache found: USES_LIBRARY comes from the manual prefixes alone")
            packages = spark.createDataFrame([], "package string, coordinate string")
        return java.library_usage(files, graph, packages, manual)

    return lib_usage
