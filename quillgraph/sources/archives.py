"""Library archives in build caches: where they are, what they are, packages kept between runs."""

from __future__ import annotations

import io
import json
import os
import re
import zipfile
from collections.abc import Callable, Mapping
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Layout below a cache root: group/artifact/version/hash/file.
LAYOUT = r"/([^/]+)/([^/]+)/([^/]+)/[^/]+/[^/]+\.jar$"
#: Packages under which a kept table is taken to be incomplete.
LEAST_PACKAGES = 100


def cache_roots(env: Mapping[str, str] | None = None) -> list[str]:
    """Existing archive caches of the build tool's homes, in order, each once."""
    env = os.environ if env is None else env
    homes = [env.get("GRADLE_USER_HOME"), os.path.join(env.get("HOME", os.path.expanduser("~")), ".gradle"), env.get("GRADLE_HOME")]
    found = [os.path.join(h, "caches", "modules-2", "files-2.1") for h in homes if h]
    return [p for p in dict.fromkeys(found) if os.path.isdir(p)]


def archives(spark: SparkSession, roots: list[str]) -> DataFrame:
    """group, artifact, version, path, n_bytes of every archive below the roots; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jar").load(roots)
    part = lambda k: F.regexp_extract("path", LAYOUT, k)
    return files.select(part(1).alias("group"), part(2).alias("artifact"), part(3).alias("version"), "path", F.col("length").alias("n_bytes")).where("group <> ''")


def opened(path: str) -> IO[bytes]:
    """A file of any store that Arrow knows, to be read at any place."""
    if re.match(r"file:/|/", path):
        return open(re.sub(r"^file:/+", "/", path), "rb")
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    return store.open_input_file(place)


def directory(path: str, content: bytes | None = None) -> list[str]:
    """Names of an archive's entries, from its directory alone; none of what is no archive."""
    try:
        with io.BytesIO(content) if content is not None else opened(path) as f, zipfile.ZipFile(f) as z:
            return z.namelist()
    except zipfile.BadZipFile:
        return []


def signature(roots: list[str], lockfile: str | None, scanner: int = 1) -> str:
    """What a kept table depends on: the scanner, the lock file's size and time, the roots."""
    lock = None
    if lockfile and os.path.exists(lockfile):
        st = os.stat(lockfile)
        lock = [st.st_size, int(st.st_mtime)]
    return json.dumps({"scanner": scanner, "lock": lock, "roots": sorted(roots)}, sort_keys=True)


def kept(spark: SparkSession, path: str, mark: str, make: Callable[[], DataFrame], least: int = LEAST_PACKAGES) -> DataFrame:
    """The table at path if it was made under the same mark and has over least rows; else made anew."""
    jvm = spark._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/mark/_SUCCESS")
    fs = done.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(done):
        row = spark.read.json(f"{path}/mark").first()
        if row is not None and row["mark"] == mark and row["n"] > least:
            return spark.read.parquet(f"{path}/rows")
        fs.delete(done.getParent(), True)
    make().write.mode("overwrite").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    rows.agg(F.count("*").alias("n")).withColumn("mark", F.lit(mark)).coalesce(1).write.mode("overwrite").json(f"{path}/mark")
    return rows
