"""The documented questions as plans over a Graph; parameters take the place of names.

Ascending orders put nulls last; top-k reports and row limits of the questions are
parameters, and every order is made total so that results are the same each time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.graph import Graph
from quillgraph.operators import patterns, traverse

QUERIES: dict[str, Callable[..., DataFrame]] = {}

c = F.col


def question(f):
    QUERIES[f.__name__] = f
    return f


def _named(g: Graph, label: str, name: str) -> DataFrame:
    """id and name of the nodes of a label with a name."""
    key = {"JavaClass": "fqn", "SailRule": "uuid", "Table": "name", "JspPage": "path"}[label]
    return g.nodes(label).where(c("name") == name).select(c(key).alias("id"), "name")


def _classes(g: Graph, *cols: str) -> DataFrame:
    return g.nodes("JavaClass").select("fqn", *cols)


@question
def class_impact(g: Graph, name: str, depth: int = 2) -> DataFrame:
    """Classes outside tests that reach the class over imports, inheritance or injection."""
    edges = traverse.reverse(g.edges("IMPORTS", "EXTENDS", "IMPLEMENTS", "INJECTS").select("src", "dst"))
    found = traverse.reach(_named(g, "JavaClass", name), edges, depth).select(c("node").alias("fqn")).distinct()
    out = g.nodes("JavaClass").where("isTest = false").join(found, "fqn", "left_semi").select("name", "path", "module").distinct()
    return patterns.ordered(out, "name", "path")


@question
def rule_impact(g: Graph, name: str, depth: int = 3) -> DataFrame:
    """Rules that call the rule over up to depth calls; the rule itself if calls lead back."""
    edges = traverse.reverse(g.edges("CALLS").select("src", "dst"))
    found = traverse.reach(_named(g, "SailRule", name), edges, depth).select(c("node").alias("uuid")).distinct()
    return patterns.ordered(g.nodes("SailRule").join(found, "uuid", "left_semi").select("name", "path").distinct(), "name", "path")


@question
def table_impact(g: Graph, name: str, most: int = 10) -> DataFrame:
    """Tables that refer to the table, its entities, and the first consumers of those."""
    t = g.nodes("Table").where(c("name") == name).select(c("name").alias("table"))
    children = g.edges("FK_TO").groupBy(c("dst").alias("table")).agg(patterns.collected("src").alias("childTables"))
    maps = g.edges("MAPS_TO").select(c("src").alias("fqn"), c("dst").alias("table"))
    entities = maps.join(_classes(g, "name"), "fqn").groupBy("table").agg(patterns.collected("name").alias("entities"))
    used = maps.join(g.edges("IMPORTS").select(c("dst").alias("fqn"), c("src").alias("consumer")), "fqn").join(_classes(g, "name", "isTest").withColumnRenamed("fqn", "consumer").where("isTest = false"), "consumer")
    consumers = patterns.first_lists(used, "table", "name", most, "topConsumers")
    return _filled(patterns.optional_branches(t, "table", children=children, entities=entities, consumers=consumers), "childTables", "entities", "topConsumers")


def _filled(df: DataFrame, *lists: str) -> DataFrame:
    return df.withColumns({x: F.coalesce(x, F.array().cast("array<string>")) for x in lists})


@question
def config_impact(g: Graph, name: str) -> DataFrame:
    """What a configuration imports and produces, and which import it."""
    base = _named(g, "JavaClass", name)
    names = _classes(g, "name")

    def side(rel: str, near: str, far: str, out: str) -> DataFrame:
        e = g.edges(rel).select(c(near).alias("id"), c(far).alias("fqn"))
        return e.join(names, "fqn").groupBy("id").agg(patterns.collected("name").alias(out))

    out = patterns.optional_branches(base, "id", a=side("SPRING_IMPORTS", "src", "dst", "imports"), b=side("PRODUCES", "src", "dst", "produces"), d=side("SPRING_IMPORTS", "dst", "src", "importedBy"))
    return _filled(out, "imports", "produces", "importedBy").drop("id")


@question
def library_impact(g: Graph, coordinate: str) -> DataFrame:
    """The library's version, how many classes and modules use it, which libraries need it."""
    lib = g.nodes("ExternalLibrary").where(c("coordinate") == coordinate).select("coordinate", c("latestVersion").alias("currentVersion"))
    use = lambda label, out: g.edges("USES_LIBRARY", source=label).groupBy(c("dst").alias("coordinate")).agg(F.countDistinct("src").alias(out))
    parents = g.edges("LIB_DEPENDS_ON").groupBy(c("dst").alias("coordinate")).agg(patterns.collected("src").alias("librariesDependingOnIt"))
    out = patterns.optional_branches(lib, "coordinate", a=use("JavaClass", "classesAffected"), b=use("Module", "modulesAffected"), d=parents)
    return _filled(out.na.fill(0, ["classesAffected", "modulesAffected"]), "librariesDependingOnIt").drop("coordinate")


@question
def package_users(g: Graph, names: Sequence[str] = ("react", "react-dom")) -> DataFrame:
    """Workspaces that depend on each of the packages, with their own version; a row each."""
    p = g.nodes("NpmPackage").where("isWorkspace = true").select(c("name").alias("src"), "version")
    out = None
    for n in names:
        one = g.edges("NPM_DEPENDS_ON").where(c("dst") == n).join(p, "src").select(c("src").alias("module"), "version")
        out = one if out is None else out.unionAll(one)
    return out


@question
def package_family(g: Graph, prefix: str = "react-") -> DataFrame:
    """Outside packages with a prefix and the workspaces that use them."""
    p = g.nodes("NpmPackage")
    libs = p.where(c("name").startswith(prefix) & ~c("isWorkspace")).select(c("name").alias("dst"), "version")
    users = p.where("isWorkspace = true").select(c("name").alias("src"))
    out = g.edges("NPM_DEPENDS_ON").join(libs, "dst").join(users, "src").select(c("dst").alias("library"), "version", c("src").alias("usedBy"))
    return patterns.ordered(out, "library", "usedBy")


@question
def function_class(g: Graph, function: str) -> DataFrame:
    e = g.nodes("CALLS_BUILTIN").where(c("functionName") == function).select(c("to_id").alias("fqn"))
    return e.join(_classes(g, "name", "path"), "fqn").select("name", "fqn", "path")


@question
def reaction_handler(g: Graph, key: str) -> DataFrame:
    e = g.nodes("CALLS_REACTION").where(c("reactionKey") == key)
    rules = g.nodes("SailRule").select(c("uuid").alias("from_id"), c("name").alias("sailCaller"))
    return e.join(rules, "from_id").join(_classes(g, c("name").alias("javaHandler"), "path"), c("to_id") == c("fqn")).select("sailCaller", "javaHandler", "path")


@question
def rule_to_tables(g: Graph, name: str, words: Sequence[str] = ("Write", "Sync"), depth: int = 3) -> DataFrame:
    """From a rule over built-in functions and services that import them to entities and tables."""
    rule = _named(g, "SailRule", name).select(c("id").alias("src"), c("name").alias("sailRule"))
    fn = rule.join(g.edges("CALLS_BUILTIN").select("src", c("dst").alias("id")), "src").select("sailRule", "id")
    near = traverse.reach(fn, traverse.reverse(g.edges("IMPORTS").select("src", "dst")), depth).select(c("start").alias("id"), c("node").alias("service"))
    has = None
    for w in words:
        has = c("serviceName").contains(w) if has is None else has | c("serviceName").contains(w)
    service = _classes(g, c("name").alias("serviceName")).where(has).select(c("fqn").alias("service"))
    entity = g.edges("IMPORTS").select(c("src").alias("service"), c("dst").alias("entityFqn"))
    maps = g.edges("MAPS_TO").select(c("src").alias("entityFqn"), c("dst").alias("dbTable"))
    out = fn.join(near, "id").join(service, "service").join(entity, "service").join(maps, "entityFqn")
    out = out.join(_classes(g, c("name").alias("javaFunction")).withColumnRenamed("fqn", "id"), "id").join(_classes(g, c("name").alias("entity")).withColumnRenamed("fqn", "entityFqn"), "entityFqn")
    return out.select("sailRule", "javaFunction", "entity", "dbTable").distinct()


@question
def toggle_scope(g: Graph, name: str) -> DataFrame:
    e = g.edges("GATES").where(c("src") == name).select(c("dst_label").alias("label"), c("dst").alias("id"))
    out = e.join(g.vertices("JavaClass", "SailRule"), ["label", "id"]).select(c("label").alias("type"), "name", "path")
    return patterns.ordered(out, "type", "name", "path")


@question
def top_toggles(g: Graph, k: int = 10) -> DataFrame:
    return patterns.top_k(g.edges("GATES").groupBy(c("src").alias("name")).agg(F.count("*").alias("gatedCount")), k, "gatedCount", "name")


@question
def class_owner(g: Graph, name: str) -> DataFrame:
    """Modules that contain the class at any depth, and their teams; several if packages span modules."""
    up = traverse.closure(_named(g, "JavaClass", name), traverse.reverse(g.edges("CONTAINS").select("src", "dst")))
    modules = g.nodes("Module").select(c("gradlePath").alias("node"), c("name").alias("module"))
    owns = g.edges("OWNS").select(c("src").alias("handle"), c("dst").alias("node"))
    out = up.join(modules, "node").join(owns, "node").join(g.nodes("Team").select("handle", c("name").alias("team")), "handle")
    return out.select(F.lit(name).alias("name"), "module", "team", "handle").distinct()


@question
def team_modules(g: Graph, word: str) -> DataFrame:
    teams = g.nodes("Team").where(c("name").contains(word)).select(c("handle").alias("src"))
    out = g.edges("OWNS").join(teams, "src").join(g.nodes("Module").select(c("gradlePath").alias("dst"), c("name").alias("module"), "path"), "dst").select("module", "path")
    return patterns.ordered(out, "module", "path")


@question
def rule_tests(g: Graph, name: str) -> DataFrame:
    rule = _named(g, "SailRule", name).select(c("id").alias("dst"))
    return g.edges("TESTS_RULE").join(rule, "dst", "left_semi").join(g.nodes("ExpressionTest").select(c("path").alias("src"), "testType"), "src").select(c("src").alias("path"), "testType")


@question
def class_tests(g: Graph, name: str) -> DataFrame:
    cls = _named(g, "JavaClass", name).select(c("id").alias("dst"))
    return g.edges("TESTS_CLASS").join(cls, "dst", "left_semi").join(g.nodes("GroovyTest").withColumnRenamed("path", "src"), "src").select(c("src").alias("path"), "name", "testFramework")


@question
def untested_rules(g: Graph, k: int = 20) -> DataFrame:
    tested = g.edges("TESTS_RULE").select(c("dst").alias("uuid"))
    out = patterns.not_exists(g.nodes("SailRule").where("isSystemOnly = false"), tested, "uuid")
    return patterns.top_k(out.select("name", "path", "definitionLineCount"), k, "definitionLineCount", "name", "path")


@question
def injected(g: Graph, name: str) -> DataFrame:
    cls = _named(g, "JavaClass", name).select(c("id").alias("from_id"))
    out = g.nodes("INJECTS").join(cls, "from_id", "left_semi").join(_classes(g, "name").withColumnRenamed("fqn", "to_id"), "to_id")
    return patterns.ordered(out.select("name", "injectionType", "isPrimary", "interfaceType", "fieldName"), "name", "fieldName")


@question
def many_implementations(g: Graph, least: int = 2, most: int = 9, k: int = 15) -> DataFrame:
    faces = g.nodes("JavaClass").where("kind = 'interface' AND isTest = false").select(c("fqn").alias("dst"), c("name").alias("interface"))
    impls = g.edges("IMPLEMENTS").join(faces, "dst").join(_classes(g, "name").withColumnRenamed("fqn", "src"), "src")
    out = impls.groupBy("dst", "interface").agg(F.count("*").alias("implCount"), patterns.collected("name", distinct=False).alias("implementations"))
    return patterns.top_k(out.where(c("implCount").between(least, most)), k, "implCount", "interface", "dst").select("interface", "implCount", "implementations")


@question
def type_users(g: Graph, name: str, k: int = 20) -> DataFrame:
    e = g.edges("REFERENCES_CDT").where(c("dst") == name).select(c("src").alias("uuid"))
    return patterns.ordered(g.nodes("SailRule").join(e, "uuid").select("name", "path"), "name", "path").limit(k)


@question
def top_types(g: Graph, k: int = 15) -> DataFrame:
    n = g.edges("REFERENCES_CDT").groupBy(c("dst").alias("name")).agg(F.count("*").alias("usageCount"))
    return patterns.top_k(n.join(g.nodes("CdtType").select("name", "kind", "fieldCount"), "name").select("name", "kind", "fieldCount", "usageCount"), k, "usageCount", "name")


def _module_edges(g: Graph) -> DataFrame:
    name = lambda k: g.nodes("Module").select(c("gradlePath").alias(k), c("name").alias(k + "Name"))
    return g.edges("DEPENDS_ON").select("src", "dst").join(name("src"), "src").join(name("dst"), "dst")


@question
def circular_modules(g: Graph, k: int | None = 10) -> DataFrame:
    """Modules that depend on each other; parallel edges give parallel rows. k: so many rows, None: all."""
    e = _module_edges(g)
    back = e.select(c("src").alias("dst"), c("dst").alias("src"))
    out = e.join(back, ["src", "dst"]).where("srcName < dstName").select(c("srcName").alias("a"), c("dstName").alias("b"))
    out = patterns.ordered(out, "a", "b")
    return out if k is None else out.limit(k)


@question
def coupled_modules(g: Graph, k: int = 10) -> DataFrame:
    out = _module_edges(g).groupBy("src", c("srcName").alias("name")).agg(F.count("*").alias("depCount"))
    return patterns.top_k(out, k, "depCount", "name", "src").select("name", "depCount")


@question
def critical_modules(g: Graph, k: int = 10) -> DataFrame:
    out = _module_edges(g).groupBy("dst", c("dstName").alias("name")).agg(F.count("*").alias("dependentCount"))
    return patterns.top_k(out, k, "dependentCount", "name", "dst").select("name", "dependentCount")


@question
def service_dependencies(g: Graph) -> DataFrame:
    s = g.nodes("DockerService").select(c("name").alias("src"), "composeFile")
    return patterns.ordered(g.edges("SERVICE_DEPENDS_ON").join(s, "src").select(c("src").alias("service"), c("dst").alias("dependsOn"), "composeFile"), "service", "dependsOn")


@question
def include_chains(g: Graph, names: Sequence[str] = ("main.jsp",), depth: int = 3, k: int | None = 10) -> DataFrame:
    """Include paths from the pages, as lists of names; a row for each path."""
    jsp = g.nodes("JspPage").select(c("path").alias("id"), "name")
    edges = g.edges("JSP_INCLUDES").select("src", "dst").withColumn("edge_id", F.concat_ws("\n", "src", "dst"))
    found = traverse.paths(jsp.where(c("name").isin(list(names))), edges, depth)
    file = lambda p: F.substring_index(p, "/", -1)
    out = found.select(file("start").alias("name"), F.transform("nodes", file).alias("includeChain"))
    out = out.orderBy("name", "includeChain")
    return out.limit(k) if k else out


@question
def unreferenced_classes(g: Graph, k: int = 30) -> DataFrame:
    base = g.nodes("JavaClass").where("isTest = false AND kind = 'class'").where(~c("name").endswith("SpringConfig"))
    left = traverse.without_incoming(base, g.edges("IMPORTS", "EXTENDS", "IMPLEMENTS", "INJECTS", "CALLS_BUILTIN", target="JavaClass"), "fqn")
    return patterns.ordered(left.select("name", "path", "module"), "module", "name", "path").limit(k)


@question
def orphaned_rules(g: Graph, least_lines: int = 10, k: int = 20) -> DataFrame:
    base = g.nodes("SailRule").where(c("isSystemOnly") & (c("definitionLineCount") > least_lines))
    left = traverse.without_incoming(base, g.edges("CALLS", "CALLS_BUILTIN", target="SailRule"), "uuid")
    return patterns.top_k(left.select("name", "path", "definitionLineCount"), k, "definitionLineCount", "name", "path")


@question
def library_closure(g: Graph, coordinate: str, depth: int = 3) -> DataFrame:
    """Libraries a library brings along, with their distance."""
    start = g.nodes("ExternalLibrary").where(c("coordinate") == coordinate).select(c("coordinate").alias("id"))
    return traverse.reach(start, g.edges("LIB_DEPENDS_ON").select("src", "dst"), depth).select(c("node").alias("coordinate"), "depth")


@question
def implementors(g: Graph, name: str, rels: Sequence[str] = ("IMPLEMENTS",)) -> DataFrame:
    """Classes that implement an interface (or, with EXTENDS, extend a class), with their modules."""
    face = _named(g, "JavaClass", name).select(c("id").alias("dst"))
    return g.edges(*rels).join(face, "dst", "left_semi").join(_classes(g, "name", "module").withColumnRenamed("fqn", "src"), "src").select("name", "module")
