"""Script sources: imports and components of TypeScript and JavaScript, loads of K."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.extract.build import contained
from quillgraph.extract.web import _normal_path
from quillgraph.functions import text as T
from quillgraph.operators import merge, resolve
from quillgraph.sources import corpus as C

# Endings that an import without one is tried with, in order.
ENDINGS = (".tsx", ".ts", ".js", ".jsx", ".less", ".css", "/index.tsx", "/index.ts", "/index.js")
# Folders that name the engine of a K file.
ENGINES = ("personalization", "exec", "design", "collaboration", "forums", "portal", "channels", "analytics", "notifications", "process", "gateway")
# The forms of a K load, with the groups that make the loaded name.
LOADS = ((r"\\l\s+(\S+)", 1), (r'\.a\.s\.l\[\s*"([^"]+)"\s*\]', 1), (r'\.a\.s\.l\s*`"?(\w[\w-]*)"?', 1), (r'\.a\.s\.ld\[\s*"([^"]+)"\s*;\s*"([^"]+)"\s*\]', 2))

_IMPORT = r"""(?ms)^\s*import\s+(?:type\s+)?(?:([\w$*{][^;'"]*?)\s+from\s+)?['"]([^'"]+)['"]"""


def is_test(path: Column) -> Column:
    return path.contains("__tests__") | path.contains("__test__") | path.rlike(r"\.test\.[tj]sx?$|\.spec\.tsx?$") | path.contains("-test.")


def first_name(clause: Column) -> Column:
    """The first name that an import clause brings in: its default, or the first in braces."""
    plain = F.regexp_extract(clause, r"^\s*([\w$]+)", 1)
    braced = F.regexp_extract(clause, r"^\s*\{\s*(?:type\s+)?([\w$]+)", 1)
    return F.when(plain != "", plain).otherwise(braced)


def typescript(files: DataFrame, graph: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """TsFile, TS_IMPORTS, CSS_IMPORTS, RENDERS, CONTAINS."""
    c = F.col
    src = C.script_files(files)
    ext = F.regexp_extract("path", r"\.([^.]+)$", 1)
    style = ext.isin("css", "less")
    nodes = src.select("path", C.file_name().alias("name"), (~style & c("content").rlike(r"<[A-Z]\w+")).alias("isComponent"), is_test(c("path")).alias("isTest"), ext.alias("language"))
    found = src.where(~style).select("path", F.posexplode(T.find_groups(c("content"), _IMPORT, 2)).alias("n", "m"))
    found = found.where(c("m.g2").startswith(".") | c("m.g2").startswith("/")).select(c("path").alias("from_id"), "n", first_name(c("m.g1")).alias("importedName"), c("m.g2").alias("source"))
    target = _normal_path(F.when(c("source").startswith("."), F.concat_ws("/", C.folder("from_id"), "source")).otherwise(c("source")))
    found = found.withColumn("target", target)
    whole = c("target").rlike(r"\.(?:tsx?|jsx?|less|css)$")
    tries = F.when(whole, F.array(F.struct(F.lit(0).alias("rank"), c("target").alias("to_id")))).otherwise(F.array(*[F.struct(F.lit(k).alias("rank"), F.concat("target", F.lit(e)).alias("to_id")) for k, e in enumerate(ENDINGS)]))
    tried = found.withColumn("t", F.explode(tries)).select("from_id", "n", "importedName", c("t.rank").alias("rank"), c("t.to_id").alias("to_id"))
    resolved = resolve.best_candidate(tried, ["from_id", "n", "importedName"], "to_id", "rank", nodes, "path")
    css = c("to_id").rlike(r"\.(?:less|css)$")
    imports = resolved.where(~css)
    tags = src.where(~style).select(c("path").alias("from_id"), F.explode(F.array_distinct(T.find_all(c("content"), r"<([A-Z]\w+)"))).alias("importedName"))
    renders = resolve.elect(imports.withColumn("key", F.concat_ws("\n", "from_id", "importedName")), "key", c("n")).join(tags, ["from_id", "importedName"]).select("from_id", "to_id", c("importedName").alias("componentName"), c("from_id").alias("sourceFile"))
    edge = lambda df, *more: merge.merge_edges(df.select("from_id", "to_id", *more, c("from_id").alias("sourceFile")), nodes, nodes, "path", "path")
    out = {"TsFile": nodes, "TS_IMPORTS": edge(imports, "importedName"), "CSS_IMPORTS": edge(resolved.where(css)), "RENDERS": merge.merge_edges(renders, nodes, nodes, "path", "path")}
    if "Module" in graph:
        out["CONTAINS_TsFile"] = contained(nodes, graph["Module"])
    return out


def k_files(files: DataFrame, graph: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """KFile with its number of functions, LOADS, CONTAINS.

    A loaded name is looked up as a file name, then beside the loading file, then with the
    ending .k; of several files of one name the last path counts.
    """
    c = F.col
    src = C.named(files, r".*\.k")
    engine = F.coalesce(*[F.when(c("path").contains(f"/{e}/") | c("path").startswith(f"server/{e}/"), F.lit(e)) for e in ENGINES], F.lit("unknown"))
    functions = T.n_matches(c("content"), r"(?m)^[a-zA-Z_]\w*\s*:\s*\{")
    nodes = src.select("path", C.file_name().alias("name"), engine.alias("engine"), T.icontains(c("path"), "test").alias("isTest"), F.nullif(functions, F.lit(0)).alias("functionCount"))
    loads = None
    for pattern, groups in LOADS:
        m = F.explode(T.find_groups(c("content"), pattern, groups))
        x = src.select(c("path").alias("from_id"), m.alias("m")).select("from_id", F.concat(*[F.trim(c(f"m.g{k}")) for k in range(1, groups + 1)]).alias("loadedName"))
        loads = x if loads is None else loads.union(x)
    by_name = resolve.elect(nodes.select("name", "path"), "name", c("path").desc())
    named = loads.select("from_id", "loadedName", F.posexplode(F.array("loadedName", F.concat("loadedName", F.lit(".k")))).alias("k", "name")).where("k = 0 OR loadedName NOT LIKE '%.k'")
    tries = named.join(by_name, "name").select("from_id", "loadedName", (c("k") * 2).alias("rank"), c("path").alias("to_id"))
    beside = loads.select("from_id", "loadedName", F.lit(1).alias("rank"), _normal_path(F.concat_ws("/", C.folder("from_id"), "loadedName")).alias("to_id"))
    edges = resolve.best_candidate(tries.union(beside), ["from_id", "loadedName"], "to_id", "rank", nodes, "path")
    edges = edges.select("from_id", "to_id", "loadedName", c("from_id").alias("sourceFile"))
    out = {"KFile": nodes, "LOADS": merge.merge_edges(edges, nodes, nodes, "path", "path")}
    if "Module" in graph:
        out["CONTAINS_KFile"] = contained(nodes, graph["Module"])
    return out
