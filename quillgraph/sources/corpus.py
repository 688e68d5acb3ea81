"""Source trees as frames of (path, content), read once and shared by all extractors."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _below(spark: SparkSession, root: str) -> Column:
    """A file's path below root, from the metadata alone."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    start = len(base.replace("file:///", "file:/")) + 2
    whole = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.substring(F.regexp_replace(whole, "^file:/+", "file:/"), start, 1 << 20)


def tree(spark: SparkSession, root: str, globs: Sequence[str] = ("*",)) -> DataFrame:
    """path (relative to root) and content (text) of the files below root that match a glob.

    The path comes from the files' metadata, so a condition on it is decided on the listing:
    a file that fails it is not opened. Each extractor reads its own files therefore, and
    nobody those that none asks for. Hidden files, which Spark's readers pass over, are added
    by hidden().
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(globs) + "}").load(root)
    return files.select(_below(spark, root).alias("path"), F.decode(F.col("content"), "UTF-8").alias("content"))


def text_lines(spark: SparkSession, root: str, *patterns: str) -> DataFrame:
    """path, chunk, line of the files below root whose name matches a pattern whole, of any size.

    A large file is read in splits, by all cores; chunk is where a split begins. The rows of a
    chunk stand in the file's order as long as they are not shuffled.
    """
    read = spark.read.option("recursiveFileLookup", "true").text(root)
    return named(read.select(_below(spark, root).alias("path"), F.col("_metadata.file_block_start").alias("chunk"), F.col("value").alias("line")), *patterns)


def hidden(spark: SparkSession, root: str, names: Sequence[str], most_bytes: int = 1 << 26) -> DataFrame:
    """path and content of files whose names begin with a dot, or that lie in such folders.

    names: patterns that a name matches whole. The driver reads these files, so one over
    most_bytes is an error, not left out.
    """
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    prefix = fs.makeQualified(base).toString().rstrip("/") + "/"
    rows, found = [], fs.listFiles(base, True)
    while found.hasNext():
        status = found.next()
        path = status.getPath().toString()
        rel = path[len(prefix) :]
        if "/." in f"/{rel}" and any(re.fullmatch(n, rel.rpartition("/")[2]) for n in names):
            if status.getLen() > most_bytes:
                raise ValueError(f"{rel} has {status.getLen()} bytes, more than {most_bytes}")
            stream = fs.open(status.getPath())
            try:
                rows.append((rel, bytes(stream.readAllBytes()).decode("utf-8", "replace")))
            finally:
                stream.close()
    return spark.createDataFrame(rows, "path string, content string")


def file_name(path: Column | str = "path") -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column | str = "path") -> Column:
    """The folder of a path; empty for a file at the root."""
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(p, "/?[^/]*$", "")


def stem(path: Column | str = "path") -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def named(files: DataFrame, *patterns: str) -> DataFrame:
    """Files whose name matches one of the regular expressions whole."""
    return files.where(file_name().rlike("^(?:" + "|".join(patterns) + ")$"))


def without(files: DataFrame, *parts: str) -> DataFrame:
    """Files whose path (with a leading slash) holds none of the parts."""
    keep = F.lit(True)
    for p in parts:
        keep = keep & ~F.concat(F.lit("/"), "path").contains(p)
    return files.where(keep)


def java_files(files: DataFrame) -> DataFrame:
    """Java sources: below a src folder, outside build output and caches."""
    kept = without(named(files, r".*\.java"), "/build/", "/generated/", "node_modules/", "/.gradle/", "/.idea/")
    return kept.where(F.concat(F.lit("/"), "path").contains("/src/"))


def rule_files(files: DataFrame) -> DataFrame:
    """Expression rule definitions, no folders and no tests."""
    return without(named(files, r"SYSTEM_SYSRULES_.*\.xml").where(~file_name().contains("FOLDER")), "/test/", "/tests/")


def script_files(files: DataFrame) -> DataFrame:
    return without(named(files, r".*\.(?:tsx?|jsx?|less|css)"), "node_modules/", "/build/", "/dist/")


def gradle_files(files: DataFrame, build_src: bool = True) -> DataFrame:
    """Build scripts outside hidden and output folders."""
    kept = named(files, r".*\.gradle(?:\.kts)?").where(~F.concat(F.lit("/"), "path").rlike(r"/\.")).where(~F.concat(F.lit("/"), "path").rlike("/(?:node_modules|build)/"))
    return kept if build_src else without(kept, "/buildSrc/")


def lines(files: DataFrame) -> DataFrame:
    """path, line_no (from 1), line."""
    return files.select("path", F.posexplode(F.split("content", r"\r\n|\n|\r", -1)).alias("k", "line")).select("path", (F.col("k") + 1).alias("line_no"), "line")


def lines_of(files: DataFrame) -> DataFrame:
    """text_lines() of files that are at hand whole: each is one chunk."""
    return lines(files).select("path", F.lit(0).cast("long").alias("chunk"), "line")


def is_comment(line: Column) -> Column:
    return line.rlike(r"^\s*(?://|/\*|\*)")


def properties(files: DataFrame) -> DataFrame:
    """path, line_no, key, value of a properties file; # lines and lines without = are left out."""
    t = lines(files).withColumn("t", F.trim("line")).where((F.col("t") != "") & ~F.col("t").startswith("#") & F.col("t").contains("="))
    parts = F.split("t", "=", 2)
    return t.select("path", "line_no", F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"))
