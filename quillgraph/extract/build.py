"""Modules and their dependencies: build scripts, package manifests, external libraries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import merge, outline, resolve
from quillgraph.sources import corpus as C

# Configurations that make a module dependency: those of the build tool's Java plugins. Projects name their own with configs=.
MODULE_CONFIGS = (
    "api", "implementation", "compileOnly", "compileOnlyApi", "runtimeOnly", "annotationProcessor",
    "testImplementation", "testCompileOnly", "testRuntimeOnly", "testAnnotationProcessor",
    "testFixturesApi", "testFixturesImplementation", "testFixturesCompileOnly", "testFixturesRuntimeOnly",
)
# Configurations of external libraries.
LIBRARY_CONFIGS = MODULE_CONFIGS
# A dependency in either notation: a configuration, its argument bare or in brackets, and what the argument is.
_CONFIG = r"\b([A-Za-z_]\w*)(?:[ \t]+|[ \t]*\([ \t]*)"
_STRING = r"""["']([^"'\s]+)["']"""
PROJECT_DEPENDENCY = _CONFIG + r"project[ \t]*\([ \t]*(?:path[ \t]*[:=][ \t]*)?" + _STRING
LIBRARY_DEPENDENCY = _CONFIG + _STRING
# A line of the settings that includes modules, any number of them; and each one's name in quotes.
INCLUDES = r"(?m)^[ \t]*include\b[ \t(]*([^\n]*)"
MODULE_NAME = r"""["'](:[^"'\s]+)["']"""
# The global registry: an entry, and how a script uses one (its configuration and the coordinate).
REGISTRY_ENTRY = r"""(?m)^dep[ \t(]+["']([^"'\n]+)["']"""
REGISTRY_USE = _CONFIG + r"globalDep[ \t]*\([ \t]*" + _STRING
# Dependency kinds of a package manifest.
MANIFEST_KINDS = {"dependencies": "dependency", "devDependencies": "devDependency", "peerDependencies": "peerDependency", "optionalDependencies": "optionalDependency"}


def gradle_path(folder: Column) -> Column:
    return F.concat(F.lit(":"), F.replace(folder, F.lit("/"), F.lit(":")))


def contained(nodes: DataFrame, modules: DataFrame, key: str = "path") -> DataFrame:
    """Module -> node by the longest module path above the node's path."""
    found = resolve.longest_prefix(nodes.select(F.col(key).alias("to_id"), F.col("path").alias("_p")), "_p", modules, "path", "gradlePath")
    return found.select(F.col("owner").alias("from_id"), "to_id").distinct()


def gradle(files: DataFrame, graph: dict[str, DataFrame], configs: tuple[str, ...] = MODULE_CONFIGS, roots: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Module and DEPENDS_ON. roots: top folders to look for modules in; none means all."""
    included = C.named(files, r"settings\.gradle").where(~F.col("path").contains("/")).select(F.explode(T.find_all(F.col("content"), INCLUDES)).alias("named")).select(F.explode(T.find_all(F.col("named"), MODULE_NAME)).alias("gradlePath"))
    scripts = C.gradle_files(files, build_src=False).where(F.col("path").contains("/"))
    if roots:
        scripts = scripts.where(F.split("path", "/")[0].isin(list(roots)))
    found = scripts.select(gradle_path(C.folder()).alias("gradlePath"))
    paths = included.union(found).distinct()
    folders = paths.withColumn("path", F.replace(F.regexp_replace("gradlePath", "^:+", ""), F.lit(":"), F.lit("/")))
    # language: the first of the signs that the folder's files show
    signs = files.select("path").withColumn("f", F.explode(resolve.prefixes(C.folder(), "/"))).where("f <> ''")
    rest = F.substring(F.col("path"), F.length("f") + 2, F.lit(1 << 20))
    signs = signs.groupBy("f").agg(F.max(rest.rlike("^src/[a-z]+App/")).alias("app"), F.max(rest == "package.json").alias("npm"), F.max(rest.startswith("src/main/java/")).alias("java"), F.max(rest.rlike(r"^[^/]*\.k$")).alias("k"))
    c = F.col
    language = F.when(c("app"), "sail").when(c("npm"), "typescript").when(c("java"), "java").when(c("k"), "k").otherwise("mixed")
    modules = folders.join(signs, folders["path"] == signs["f"], "left").select("gradlePath", F.substring_index("path", "/", -1).alias("name"), "path", language.alias("language"))
    text = C.lines(C.gradle_files(files)).where(~C.is_comment(F.col("line")))
    found = text.select("path", "line_no", F.explode(T.find_groups(F.col("line"), PROJECT_DEPENDENCY, 2)).alias("m")).where(F.col("m.g2").startswith(":"))
    deps = found.select(gradle_path(C.folder()).alias("from_id"), F.col("m.g2").alias("to_id"), F.col("m.g1").alias("config"), F.col("path").alias("sourceFile"), F.col("line_no").alias("sourceLine"))
    deps = deps.where(F.col("config").isin(list(configs)))
    return {"Module": modules, "DEPENDS_ON": merge.merge_edges(deps, modules, modules, "gradlePath", "gradlePath")}


def npm(files: DataFrame, graph: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """NpmPackage, NPM_DEPENDS_ON, USES_NPM; a manifest belongs to the longest module path above it."""
    manifests = C.without(C.named(files, r"package\.json"), "node_modules/", "/build/", "/.gradle/").where(F.try_parse_json("content").isNotNull())
    member = lambda k: F.coalesce(F.get_json_object("content", f"$.{k}"), F.lit(""))
    own = manifests.select(member("name").alias("name"), member("version").alias("version"), "path")
    entry = lambda kind: lambda e: F.struct(e["key"].alias("dep"), e["value"].alias("version"), F.lit(kind).alias("depType"))
    kinds = F.concat(*[F.transform(T.object_entries(F.col("content"), k), entry(kind)) for k, kind in MANIFEST_KINDS.items()])
    deps = manifests.select(member("name").alias("name"), "path", F.posexplode(kinds).alias("n", "d")).select("name", "path", "n", "d.dep", "d.version", "d.depType")
    workspace = own.where("name <> ''").select("name", "version", "path", F.lit(True).alias("isWorkspace"), F.col("path").alias("seq"))
    workspace = merge.merge_nodes(workspace, "name", "seq")
    first = resolve.elect(deps, "dep", F.col("path"), F.col("n")).select(F.col("dep").alias("name"), "version", F.lit("").alias("path"), F.lit(False).alias("isWorkspace"))
    packages = merge.priority_merge(workspace, first, key="name")
    seq = F.concat("path", F.format_string("%08d", "n"))
    edges = deps.where("name <> ''").select(F.col("name").alias("from_id"), F.col("dep").alias("to_id"), "depType", "version", F.col("path").alias("sourceFile"), seq.alias("seq"))
    out = {"NpmPackage": packages, "NPM_DEPENDS_ON": merge.merge_edges(edges, packages, packages, "name", "name", ["from_id", "to_id"], "seq")}
    if "Module" in graph:
        by_module = resolve.longest_prefix(deps.withColumn("seq", seq), "path", graph["Module"], "path", "gradlePath")
        uses = by_module.select(F.col("owner").alias("from_id"), F.col("dep").alias("to_id"), "depType", "version", F.col("path").alias("sourceFile"), "seq")
        out["USES_NPM"] = merge.merge_edges(uses, graph["Module"], packages, "gradlePath", "name", ["from_id", "to_id"], "seq")
    return out


def coordinate(group: Column, artifact: Column) -> Column:
    return F.concat(group, F.lit(":"), artifact)


def external_libraries(files: DataFrame, graph: dict[str, DataFrame], configs: tuple[str, ...] = LIBRARY_CONFIGS) -> dict[str, DataFrame]:
    """ExternalLibrary and DEPENDS_ON_LIB from four sources of falling priority.

    Declared in scripts, then the global registry, then the lock file, then the catalog. The
    latest version of a declared library is the greatest by version order.
    """
    c = F.col
    modules = graph["Module"].select("path", "gradlePath").union(files.sparkSession.createDataFrame([("", ":")], "path string, gradlePath string"))
    scripts = C.gradle_files(files, build_src=False)
    text = C.lines(scripts).withColumn("t", F.trim("line")).where(~C.is_comment(c("line")) & ~c("t").rlike(r"project\(|files\(|fileTree\("))
    part = F.split("m.g2", ":", 3)  # group, artifact, and the rest where there is one
    declared = text.select("path", "line_no", F.explode(T.find_groups(c("t"), LIBRARY_DEPENDENCY, 2)).alias("m")).where((F.size(part) >= 2) & F.get(part, F.lit(0)).contains("."))
    declared = declared.select("path", "line_no", c("m.g1").alias("config"), part[0].alias("group"), part[1].alias("artifact"), F.coalesce(F.get(part, F.lit(2)), F.lit("")).alias("version"))
    declared = declared.where(c("config").isin(list(configs))).withColumn("coordinate", coordinate(c("group"), c("artifact")))
    in_module = declared.withColumn("f", C.folder()).join(modules.select(c("path").alias("f"), "gradlePath"), "f")
    lib = lambda df, version: df.select("coordinate", "group", "artifact", version.alias("latestVersion"))
    direct = resolve.elect(in_module, "coordinate", resolve.version_key(c("version")).desc())
    dep = C.named(files, r"globalDependencies\.groovy").select(F.explode(T.find_all(c("content"), REGISTRY_ENTRY)).alias("d")).where(F.size(F.split("d", ":")) >= 2)
    part = F.split("d", ":")
    registry = dep.select(part[0].alias("group"), part[1].alias("artifact"), F.regexp_replace(F.regexp_replace(F.coalesce(F.get(part, F.lit(2)), F.lit("")), r"\$\{[^}]+\}", "managed"), "!+$", "").alias("version"))
    registry = registry.withColumn("coordinate", coordinate(c("group"), c("artifact"))).dropDuplicates(["coordinate"])
    locked = C.lines(C.named(files, r"gradle\.lockfile")).withColumn("t", F.trim("line")).where(~c("t").startswith("#") & c("t").contains("="))
    lock_part = F.split(F.substring_index("t", "=", 1), ":")
    locked = locked.where(F.size(lock_part) >= 3).select(lock_part[0].alias("group"), lock_part[1].alias("artifact"), lock_part[2].alias("version")).withColumn("coordinate", coordinate(c("group"), c("artifact"))).dropDuplicates(["coordinate"])
    toml = C.lines(C.named(files, r"libs\.versions\.toml")).withColumn("t", F.trim("line"))
    toml = resolve.carry_section(toml, "path", "line_no", F.when(c("t").startswith("["), c("t"))).where("section = '[libraries]'")
    # an entry is alias = { module = "group:artifact", version = "..." }, its members in any order
    member = lambda key: F.regexp_extract("t", rf"""\b{key}[ \t]*=[ \t]*["']([^"']*)["']""", 1)
    entry = toml.where(c("t").rlike(r"^[A-Za-z0-9_-]+[ \t]*=[ \t]*\{")).select(F.trim(F.substring_index("t", "=", 1)).alias("catalogAlias"), F.split(member("module"), ":").alias("module"), member(r"version(?:\.ref)?").alias("version"))
    catalog = entry.where(F.size("module") == 2).select("catalogAlias", c("module")[0].alias("group"), c("module")[1].alias("artifact"), "version")
    catalog = catalog.withColumn("coordinate", coordinate(c("group"), c("artifact"))).dropDuplicates(["coordinate"])
    merged = merge.priority_merge(lib(direct, c("version")), lib(registry, c("version")), lib(locked, c("version")), lib(catalog, c("version")), key="coordinate")
    libraries = merged.join(catalog.select("coordinate", "catalogAlias"), "coordinate", "left").select("coordinate", "group", "artifact", "latestVersion", c("artifact").alias("name"), F.coalesce("catalogAlias", F.lit("")).alias("catalogAlias"))
    uses = in_module.select(c("gradlePath").alias("from_id"), c("coordinate").alias("to_id"), "config", "version", c("path").alias("sourceFile"))
    named = C.named(scripts, r".*\.gradle").select("path", F.explode(T.find_groups(c("content"), REGISTRY_USE, 2)).alias("m")).where(c("m.g2").contains(":"))
    named = named.withColumn("f", C.folder()).join(modules.select(c("path").alias("f"), "gradlePath"), "f").withColumn("coordinate", F.substring_index("m.g2", ":", 2)).join(registry.select("coordinate", "version"), "coordinate", "left")
    named = named.select(c("gradlePath").alias("from_id"), c("coordinate").alias("to_id"), c("m.g1").alias("config"), F.coalesce("version", F.lit("")).alias("version"), c("path").alias("sourceFile"))
    ends = graph["Module"].select("gradlePath")
    return {"ExternalLibrary": libraries, "DEPENDS_ON_LIB": merge.merge_edges(uses.union(named), ends, libraries, "gradlePath", "coordinate")}


def tree_entries(lines: DataFrame) -> DataFrame:
    """Lines of dependency texts with depth, name, opens and what they say: child, group, artifact, version.

    The depth is the column of the branch sign, null on an empty line, which ends a tree.
    Constraints and lines without a branch are left out; projects have no name and no child.
    """
    c = F.col
    at = F.regexp_instr("line", F.lit(r"[+\\]--- "))
    said = lines.withColumn("at", at).where((c("at") > 0) | c("line").rlike(r"^\s*$")).withColumn("entry", F.trim(F.substring(c("line"), c("at") + 5, F.length("line"))))
    said = said.where((c("at") == 0) | ~c("entry").endswith("(c)")).withColumn("entry", F.regexp_replace("entry", r"\s*\((?:\*|n)\)\s*$", ""))
    first = F.substring_index("entry", " -> ", 1)
    said = said.withColumns({"chosen": F.trim(F.substring(c("entry"), F.length(first) + 5, F.length("entry"))), "parts": F.split(F.trim(first), ":")})
    library = (c("at") > 0) & ~c("entry").startswith("project ") & ((F.size("parts") >= 3) | ((c("chosen") != "") & (F.size("parts") >= 2)))
    part = lambda k: F.get("parts", F.lit(k))
    said = said.withColumn("child", F.when(library, coordinate(part(0), part(1))))
    version = F.when(c("chosen") != "", c("chosen")).otherwise(F.coalesce(part(2), F.lit("")))
    return said.select("path", "chunk", F.when(c("at") > 0, c("at")).alias("depth"), c("child").alias("name"), F.lit(True).alias("opens"), "child", part(0).alias("group"), part(1).alias("artifact"), version.alias("version"))


def dependency_tree(files: DataFrame, graph: dict[str, DataFrame], pattern: str = r"dependency-tree.*\.txt", lines: DataFrame | None = None) -> dict[str, DataFrame]:
    """LIB_DEPENDS_ON and libraries the tree alone mentions, from indented dependency texts.

    A line's parent is the nearest line above that is shallower and names a library; projects
    are transparent, constraints skipped. lines, as of corpus.text_lines(), take the place of
    files, so that one text of any size is read by all cores.
    """
    lines = C.lines_of(C.named(files, pattern)) if lines is None else lines
    seen = outline.parents(tree_entries(lines)).where("child IS NOT NULL").select("parent", "child", "group", "artifact", "version")
    known = graph["ExternalLibrary"]
    mentioned = resolve.elect(seen, "child", resolve.version_key(F.col("version")).desc())
    new = mentioned.join(known.select(F.col("coordinate").alias("child")), "child", "left_anti").select(F.col("child").alias("coordinate"), "group", "artifact", F.col("version").alias("latestVersion"), F.col("artifact").alias("name"), F.lit("").alias("catalogAlias"))
    libraries = known.unionByName(new, allowMissingColumns=True)
    edges = seen.where("parent IS NOT NULL AND parent <> child").select(F.col("parent").alias("from_id"), F.col("child").alias("to_id"))
    return {"ExternalLibrary": libraries, "LIB_DEPENDS_ON": merge.merge_edges(edges, libraries, libraries, "coordinate", "coordinate")}


def dependency_trees(root: str, pattern: str = r"dependency-tree.*\.txt") -> Callable[[DataFrame, dict[str, DataFrame]], dict[str, DataFrame]]:
    """dependency_tree() as an extractor that reads the texts below root in splits."""
    return lambda files, graph: dependency_tree(files, graph, lines=C.text_lines(files.sparkSession, root, pattern))
