"""Queries that run the extractors over source trees written from the tables, each with its SQL.

A nation is a module (folder r<region>/n<nation>), a part a Java class and an expression
rule, a supplier a script, a page, a table. What a file refers to follows from its key by
arithmetic, so SQL tells from the tables alone what the extractors have to find.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.extract import build, java, rules, scripts, web
from quillgraph.functions import tables as functions
from quillgraph.graph import Graph
from quillgraph.operators import traverse
from quillgraph.plans.overlay import Overlay
from quillgraph.session import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_H = "h AS (SELECT n_nationkey AS k, 'r' || n_regionkey || '/n' || n_nationkey AS path, ':r' || n_regionkey || ':n' || n_nationkey AS gp FROM nation)"
#: Classes: key, name, its parent's where there is one, and its module.
_C = f"""{_H},
c AS (SELECT a.p_partkey AS p, 'acme.m' || (a.p_partkey % 25) || '.Part' || a.p_partkey AS fqn, 'acme.m' || (b.p_partkey % 25) || '.Part' || b.p_partkey AS parent, path, gp
  FROM part a JOIN h ON k = a.p_partkey % 25 LEFT JOIN part b ON b.p_partkey = a.p_partkey // 2 AND a.p_partkey >= 2)"""
_RULE = "SYSTEM_SYSRULES_part"


class Tree(Overlay):
    """Files (path, content) written from the tables."""

    #: Rows of a table that a task makes files of.
    ROWS = 4_000

    def table(self, name: str) -> DataFrame:
        """A table's rows, dealt out over as many tasks as its number asks for.

        Every row becomes a file to be parsed, some hundred times the row's bytes. A table may lie in
        one row group, which one task would read, parse and cache alone.
        """
        rows = super().table(name)
        tasks = -(-rows.count() // self.ROWS)
        return rows.repartition(tasks) if tasks > 1 else rows

    def homes(self) -> DataFrame:
        return self.table("nation").selectExpr("n_nationkey AS k", "'r' || n_regionkey || '/n' || n_nationkey AS path", "':r' || n_regionkey || ':n' || n_nationkey AS gp")

    def modules(self) -> DataFrame:
        return self.homes().selectExpr("gp AS gradlePath", "'n' || k AS name", "path", "'java' AS language")

    def at_home(self, df: DataFrame, key: str) -> DataFrame:
        return df.join(self.homes(), F.expr(f"{key} = k"))

    def joined(self, df: DataFrame, path: str, line: str) -> DataFrame:
        return df.groupBy(F.expr(path).alias("path")).agg(F.array_join(F.sort_array(F.collect_set(F.expr(line))), "\n").alias("content"))

    def java(self) -> DataFrame:
        parts = self.at_home(self.table("part").selectExpr("p_partkey AS p", "p_partkey % 25 AS m", "p_partkey div 2 AS q"), "m")
        text = """concat('package acme.m', m, ';\\nimport lib.p', p % 10, '.Thing;\\n', if(p < 2, '', concat('import acme.m', q % 25, '.Part', q, ';\\n')),
          '@Service public class Part', p, if(p < 2, '', concat(' extends Part', q)), ' {\\n', if(p < 2, '', concat('  @Autowired private Part', q, ' base;\\n')),
          if(p < 40, concat('  public static final Id FN_ID = new Id(Domain.SYS, "query', p, '");\\n'), ''),
          '  public int size(int a) { return isFeatureEnabled("ae.t', p % 30, '") ? 1 : 2; }\\n  public int size(String b) { return 2; }\\n  public String mail() { return "t', m, '.ftl"; }\\n}\\n')"""
        return parts.selectExpr("concat(path, '/src/main/java/acme/m', m, '/Part', p, '.java') AS path", f"{text} AS content")

    def rules(self) -> DataFrame:
        text = f"concat('<h><rule><name>part', p, '</name><uuid>{_RULE}', p, '</uuid><definition>a!part', p div 2, '(1) fn!query', p % 40, '(2)</definition></rule></h>')"
        return self.table("part").selectExpr("p_partkey AS p").selectExpr(f"concat('rules/{_RULE}', p, '.xml') AS path", f"{text} AS content")

    def suppliers(self, path: str, content: str) -> DataFrame:
        """A file for each supplier, from its key s and half of it, t."""
        return self.table("supplier").selectExpr("s_suppkey AS s", "s_suppkey div 2 AS t").selectExpr(f"{path} AS path", f"{content} AS content")

    def nations(self, path: str, content: str) -> DataFrame:
        """A file for each nation, from its key k, the next nation's, t, its module's path and number gp."""
        return self.homes().selectExpr("k", "(k + 1) % 25 AS t", "path AS folder", "gp").selectExpr(f"{path} AS path", f"{content} AS content")

    def classes(self) -> dict[str, DataFrame]:
        graph = {"Module": self.modules()}
        return graph | java.java(self.java(), graph)


def query(sql: str):
    def add(f):
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = lambda spark, sf_dir: f(Tree(spark, sf_dir))
        ORACLES[name] = sql
        return f

    return add


# -- modules and libraries

_DEPENDS = f"""WITH {_H}, d AS (SELECT DISTINCT a.gp AS from_id, b.gp AS to_id, CASE s_suppkey % 3 WHEN 0 THEN 'implementation' ELSE 'api' END AS config
  FROM supplier JOIN h a ON s_nationkey = a.k JOIN h b ON b.k = (s_suppkey * 7) % 25 WHERE s_suppkey % 3 < 2)"""


def _modules(g: Tree) -> Graph:
    lines = g.at_home(g.table("supplier"), "s_nationkey").join(g.homes().selectExpr("k AS tk", "gp AS target"), F.expr("tk = (s_suppkey * 7) % 25"))
    line = "concat(element_at(array('implementation', 'api', 'unknownScope'), cast(s_suppkey % 3 + 1 AS int)), if(s_suppkey % 2 = 0, concat(' project(\"', target, '\")'), concat('(project(path: \"', target, '\"))')))"
    settings = g.homes().groupBy(F.lit("settings.gradle").alias("path")).agg(F.array_join(F.collect_list(F.expr("concat('include \"', gp, '\"')")), "\n").alias("content"))
    return Graph(g.spark, build.gradle(g.joined(lines, "concat(path, '/build.gradle')", line).unionByName(settings), {}))


@query(f"{_DEPENDS} SELECT * FROM d")
def q_extract_gradle(g: Tree) -> DataFrame:
    return _modules(g).frames["DEPENDS_ON"].select("from_id", "to_id", "config").distinct()


@query(f"WITH {_H} SELECT gp AS \"gradlePath\", path, 'n' || k AS name FROM h")
def q_extract_modules(g: Tree) -> DataFrame:
    return _modules(g).frames["Module"].select("gradlePath", "path", "name").where("path LIKE 'r%/n%'")


@query("""WITH v AS (SELECT 'org.s' || (p_partkey % 50) || ':lib' || (p_partkey % 20) AS coordinate, p_size % 12 AS major, p_partkey % 30 AS minor FROM part)
SELECT coordinate, (max(major * 1000 + minor) // 1000) || '.' || (max(major * 1000 + minor) % 1000) AS "latestVersion" FROM v GROUP BY coordinate""")
def q_extract_external_libs(g: Tree) -> DataFrame:
    """Versions are compared part by part, as numbers."""
    line = "concat('implementation', if(p_partkey % 2 = 0, ' ', '('), '\"org.s', p_partkey % 50, ':lib', p_partkey % 20, ':', p_size % 12, '.', p_partkey % 30, '\"', if(p_partkey % 2 = 0, '', ')'))"
    files = g.joined(g.at_home(g.table("part"), "p_partkey % 25"), "concat(path, '/build.gradle')", line)
    return build.external_libraries(files, {"Module": g.modules()})["ExternalLibrary"].select("coordinate", "latestVersion")


@query("SELECT 'org.n' || n_nationkey || ':a' AS from_id, 'org.n' || ((n_nationkey + 1) % 25) || ':a' AS to_id FROM nation")
def q_extract_lib_transitivity(g: Tree) -> DataFrame:
    files = g.nations("concat('dependency-tree-', k, '.txt')", "concat('runtimeClasspath\\n+--- org.n', k, ':a:1.0\\n|    \\\\--- org.n', t, ':a:2.', k, '\\n')")
    known = g.homes().selectExpr("concat('org.n', k, ':a') AS coordinate", "'org' AS `group`", "'a' AS artifact", "'1' AS latestVersion", "'a' AS name", "'' AS catalogAlias")
    return build.dependency_tree(files, {"ExternalLibrary": known, "Module": g.modules()})["LIB_DEPENDS_ON"].select("from_id", "to_id").distinct()


@query("""WITH l AS (SELECT p_partkey // 25 AS i, p_partkey % 25 AS n, (p_partkey * 7919) % 97 % 6 AS d, CASE WHEN p_partkey % 9 = 4 THEN NULL ELSE 'org.g' || (p_partkey % 10) || ':a' || p_partkey END AS name FROM part),
up AS (SELECT a.n, a.name, max(b.i) AS j FROM l a JOIN l b ON a.n = b.n AND b.i < a.i AND b.d < a.d AND b.name IS NOT NULL
  WHERE a.name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l x WHERE x.n = a.n AND x.i > b.i AND x.i < a.i AND x.d <= b.d) GROUP BY 1, 2)
SELECT DISTINCT l.name AS from_id, up.name AS to_id FROM up JOIN l ON l.n = up.n AND l.i = up.j""")
def q_extract_lib_trees(g: Tree) -> DataFrame:
    """Deep dependency texts, written as files and read in splits; projects are transparent."""
    parts = g.table("part").selectExpr("p_partkey AS p", "p_partkey % 25 AS n", "p_partkey div 25 AS i", "cast((p_partkey * 7919) % 97 % 6 AS int) AS d")
    line = "concat(repeat('|    ', d), if(i % 2 = 0, '+', '\\\\'), '--- ', if(p % 9 = 4, concat('project :x', p), concat('org.g', p % 10, ':a', p, ':1.', i)))"
    path = shared_path(g.spark, "trees")
    parts.repartition("n").sortWithinPartitions("n", "i").selectExpr("n", f"{line} AS value").write.partitionBy("n").text(path)
    none = g.spark.createDataFrame([], "coordinate string, group string, artifact string, latestVersion string, name string, catalogAlias string")
    found = build.dependency_trees(path, r"part-.*\.txt")(g.java(), {"ExternalLibrary": none})
    return found["LIB_DEPENDS_ON"].select("from_id", "to_id").distinct()


@query(f"WITH {_C} SELECT DISTINCT gp AS from_id, 'org.lib:p' || (p % 10) AS to_id FROM c")
def q_extract_lib_usage(g: Tree) -> DataFrame:
    """Modules use the libraries that own the packages their classes import."""
    digits = g.spark.range(10)
    owners = digits.selectExpr("concat('lib.p', id) AS package", "concat('org.lib:p', id) AS coordinate")
    libraries = digits.selectExpr("concat('org.lib:p', id) AS coordinate", "'org.lib' AS `group`", "concat('p', id) AS artifact", "'1' AS latestVersion", "'p' AS name", "'' AS catalogAlias")
    return java.library_usage(g.java(), g.classes() | {"ExternalLibrary": libraries}, owners)["USES_LIBRARY_Module"].select("from_id", "to_id").distinct()


@query("SELECT 'pkg' || n_nationkey AS from_id, 'pkg' || ((n_nationkey + 1) % 25) AS to_id, 'dependency' AS \"depType\" FROM nation UNION ALL SELECT 'pkg' || n_nationkey, 'left-pad', 'devDependency' FROM nation")
def q_extract_npm(g: Tree) -> DataFrame:
    files = g.nations("concat(folder, '/package.json')", "concat('{\"name\": \"pkg', k, '\", \"version\": \"1.', k, '\", \"dependencies\": {\"pkg', t, '\": \"^1\"}, \"devDependencies\": {\"left-pad\": \"1\"}}')")
    return build.npm(files, {"Module": g.modules()})["NPM_DEPENDS_ON"].select("from_id", "to_id", "depType")


# -- Java


@query(f"WITH {_C} SELECT fqn, gp AS module, 'class' AS kind FROM c")
def q_extract_java_classes(g: Tree) -> DataFrame:
    return g.classes()["JavaClass"].select("fqn", "module", "kind")


@query(f"WITH {_C} SELECT fqn AS from_id, parent AS to_id FROM c WHERE parent IS NOT NULL")
def q_extract_java_extends(g: Tree) -> DataFrame:
    return g.classes()["EXTENDS"].select("from_id", "to_id")


@query(f"WITH {_C} SELECT fqn AS from_id, parent AS to_id FROM c WHERE parent IS NOT NULL")
def q_extract_java_imports(g: Tree) -> DataFrame:
    """Imports of classes that the tree does not hold give no edge."""
    return g.classes()["IMPORTS"].select("from_id", "to_id")


@query(f"WITH {_C} SELECT fqn || m AS id, a AS arity FROM c, (VALUES ('#size(int)', 1), ('#size(String)', 1), ('#mail()', 0)) AS t(m, a)")
def q_extract_java_methods(g: Tree) -> DataFrame:
    return g.classes()["Method"].select("id", "arity")


@query(f"WITH {_C} SELECT fqn || '#size(String)' AS from_id, fqn || '#size(int)' AS to_id FROM c")
def q_extract_java_overloads(g: Tree) -> DataFrame:
    return g.classes()["OVERLOADS"].select("from_id", "to_id")


@query(f"WITH {_C} SELECT fqn || m AS from_id, parent || m AS to_id, 'signature' AS \"matchKind\" FROM c, (VALUES ('#size(int)'), ('#size(String)'), ('#mail()')) AS t(m) WHERE parent IS NOT NULL")
def q_extract_java_overrides(g: Tree) -> DataFrame:
    """Every method overrides the nearest one above of its signature, which its parent has."""
    return g.classes()["OVERRIDES"].select("from_id", "to_id", "matchKind")


@query(f"WITH {_C} SELECT fqn AS from_id, parent AS to_id, 'base' AS \"fieldName\", 'field' AS \"injectionType\" FROM c WHERE parent IS NOT NULL")
def q_extract_spring_di(g: Tree) -> DataFrame:
    return java.spring(g.java(), g.classes())["INJECTS"].select("from_id", "to_id", "fieldName", "injectionType")


#: Interfaces by region, the fourth with a diamond above it; classes by part, each below its half's, with two interfaces.
_HIERARCHY = """WITH RECURSIVE direct AS (
  SELECT 'acme.h.Part' || a.p_partkey AS src, 'acme.h.Part' || (a.p_partkey // 2) AS dst FROM part a WHERE p_partkey >= 2
  UNION SELECT 'acme.h.Part' || p_partkey, 'acme.h.Face' || (p_partkey % 5) FROM part UNION SELECT 'acme.h.Part' || p_partkey, 'acme.h.Face' || ((p_partkey + 1) % 5) FROM part
  UNION SELECT 'acme.h.Face' || a, 'acme.h.Face' || b FROM (VALUES (1, 0), (2, 0), (3, 1), (3, 2), (4, 3), (4, 0)) AS t(a, b)),
way AS (SELECT src AS start, dst AS node, 1 AS depth, [dst] AS bfs FROM direct UNION SELECT start, dst, depth + 1, list_append(bfs, dst) FROM way JOIN direct ON src = node),
near AS (SELECT start, node, min(depth) AS depth, arg_min(bfs, (depth, bfs)) AS bfs FROM way GROUP BY ALL),
m AS (SELECT 'acme.h.Part' || p_partkey AS owner, unnest([('run', 'int'), ('take', CASE p_partkey % 2 WHEN 0 THEN 'int' ELSE 'String' END), ('m' || (p_partkey % 5), 'String')]) AS s FROM part
  UNION ALL SELECT 'acme.h.Face' || r_regionkey, unnest([('run', 'int'), ('take', 'String'), ('m' || r_regionkey, 'String')]) FROM region),
methods AS (SELECT owner, s[1] AS name, s[2] AS type, owner || '#' || s[1] || '(' || s[2] || ')' AS id FROM m),
met AS (SELECT a.id AS from_id, b.id AS to_id, row_number() OVER (PARTITION BY a.id ORDER BY depth, bfs, CASE WHEN a.type = b.type THEN 0 ELSE 1 END, b.id) AS k, a.type = b.type AS same
  FROM methods a JOIN near ON start = a.owner JOIN methods b ON b.owner = node AND b.name = a.name)"""


def _hierarchy(g: Tree) -> DataFrame:
    parts = g.table("part").selectExpr("p_partkey AS p", "p_partkey div 2 AS q")
    text = """concat('package acme.h;\\npublic class Part', p, if(p < 2, '', concat(' extends Part', q)), ' implements Face', p % 5, ', Face', (p + 1) % 5, ' {\\n  public void run(int a) {}\\n  public void take(', if(p % 2 = 0, 'int', 'String'), ' a) {}\\n  public void m', p % 5, '(String s) {}\\n}\\n')"""
    classes = parts.selectExpr("concat('h/src/main/java/acme/h/Part', p, '.java') AS path", f"{text} AS content")
    above = "element_at(array('', ' extends Face0', ' extends Face0', ' extends Face2, Face1', ' extends Face3, Face0'), cast(r_regionkey + 1 AS int))"
    faces = f"concat('package acme.h;\\npublic interface Face', r_regionkey, {above}, ' {{\\n  void run(int x);\\n  void take(String s);\\n  void m', r_regionkey, '(String s);\\n}}\\n')"
    return classes.unionByName(g.table("region").selectExpr("concat('h/src/main/java/acme/h/Face', r_regionkey, '.java') AS path", f"{faces} AS content"))


@query(f"""{_HIERARCHY} SELECT from_id, to_id, CASE WHEN same THEN 'signature' ELSE 'arity' END AS "matchKind" FROM met WHERE k = 1""")
def q_extract_java_hierarchy(g: Tree) -> DataFrame:
    """Overrides where classes have several parents: nearest first, siblings by name, diamonds once."""
    return java.java(_hierarchy(g), {})["OVERRIDES"].select("from_id", "to_id", "matchKind")


@query(f"""{_HIERARCHY} SELECT start, node, CAST(depth AS INTEGER) AS depth, array_to_string(bfs, '>') AS way FROM near""")
def q_nearest_supertypes(g: Tree) -> DataFrame:
    """All supertypes in breadth-first order."""
    direct = java.supertypes(java.declarations(_hierarchy(g), {}))
    return traverse.nearest_supertypes(direct).select("start", "node", "depth", F.array_join("bfs", ">").alias("way"))


@query(f"WITH {_C} SELECT fqn, 'class' AS kind, CAST(CASE WHEN p < 2 THEN 1 ELSE 2 END AS BIGINT) AS n_imports FROM c")
def q_parse_in_sql(g: Tree) -> DataFrame:
    """Sources read in SQL alone, by table functions."""
    functions.register(g.spark)
    return g.spark.sql("""SELECT c.fqn, c.kind, count_if(r.kind = 'IMPORTS') AS n_imports FROM {files} f, LATERAL java_classes(f.content) c, LATERAL java_references(f.content) r
      GROUP BY c.fqn, c.kind""", files=g.java())


# -- rules and what binds to them


@query(f"SELECT '{_RULE}' || a.p_partkey AS from_id, '{_RULE}' || b.p_partkey AS to_id FROM part a JOIN part b ON b.p_partkey = a.p_partkey // 2 WHERE a.p_partkey <> b.p_partkey")
def q_extract_sail(g: Tree) -> DataFrame:
    return rules.rules(g.rules(), {})["CALLS"].select("from_id", "to_id").where("from_id <> to_id")


@query(f"WITH {_C} SELECT '{_RULE}' || p_partkey AS from_id, fqn AS to_id FROM part JOIN c ON p = p_partkey % 40")
def q_extract_cross_language(g: Tree) -> DataFrame:
    """Rules to the classes that register the functions they call."""
    files = g.rules().unionByName(g.java())
    graph = g.classes()
    return rules.bind(files, graph | rules.rules(files, graph))["CALLS_BUILTIN"].select("from_id", "to_id")


@query(f"WITH {_C} SELECT 'ae.t' || (p % 30) AS from_id, fqn AS to_id FROM c")
def q_extract_toggle(g: Tree) -> DataFrame:
    known = g.spark.range(30).groupBy(F.lit("infra/feature-toggles.properties").alias("path")).agg(F.array_join(F.collect_list(F.expr("concat('ae.t', id, '=false')")), "\n").alias("content"))
    files = g.rules().unionByName(g.java()).unionByName(known)
    graph = g.classes()
    return rules.toggles(files, graph | rules.rules(files, graph))["GATES_JavaClass"].select("from_id", "to_id")


@query("SELECT 'T' || s_suppkey AS name, CAST(s_suppkey % 5 + 1 AS INTEGER) AS \"fieldCount\" FROM supplier")
def q_extract_xsd_cdt(g: Tree) -> DataFrame:
    fields = "array_join(transform(sequence(0, cast(s % 5 AS int)), i -> concat('<x:element name=\"e', i, '\"/>')), '')"
    files = g.suppliers("concat('types/t', s, '.xsd')", f"concat('<x:schema xmlns:x=\"http://www.w3.org/2001/XMLSchema\"><x:complexType name=\"T', s, '\"><x:sequence>', {fields}, '</x:sequence></x:complexType></x:schema>')")
    return rules.data_types(files, rules.rules(g.rules(), {}))["CdtType"].select("name", F.col("fieldCount").cast("int").alias("fieldCount"))


@query(f"""WITH t AS (SELECT p_partkey AS p, 'rules/test/unit/expressions-part' || p_partkey || '.txt' AS path FROM part WHERE p_partkey % 10 = 0)
SELECT path AS from_id, '{_RULE}' || p AS to_id, 'primary' AS relationship FROM t
UNION ALL SELECT path, '{_RULE}' || p_partkey, 'references' FROM t JOIN part ON p_partkey = p // 2 WHERE p_partkey <> p""")
def q_extract_expression_tests(g: Tree) -> DataFrame:
    tests = g.table("part").where("p_partkey % 10 = 0").selectExpr("concat('rules/test/unit/expressions-part', p_partkey, '.txt') AS path", "concat('a!part', p_partkey, '() a!part', p_partkey div 2, '() a!unknown()') AS content")
    return rules.expression_tests(tests, rules.rules(g.rules(), {}))["TESTS_RULE"].select("from_id", "to_id", "relationship")


@query("SELECT 'b' || n_nationkey || '_en_US' AS name, count(*) AS \"keyCount\" FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def q_extract_resource_bundles(g: Tree) -> DataFrame:
    files = g.joined(g.at_home(g.table("supplier"), "s_nationkey"), "concat(path, '/b', k, '_en_US.properties')", "concat('key', s_suppkey, '=value')")
    return rules.resource_bundles(files, {"Module": g.modules()})["ResourceBundle"].select("name", F.col("keyCount").cast("long").alias("keyCount"))


# -- scripts


@query("SELECT 'ui/c' || a.s_suppkey || '.ts' AS from_id, 'ui/c' || b.s_suppkey || '.ts' AS to_id, 'f' || b.s_suppkey AS \"importedName\" FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey // 2 WHERE a.s_suppkey <> b.s_suppkey")
def q_extract_typescript(g: Tree) -> DataFrame:
    files = g.suppliers("concat('ui/c', s, '.ts')", "concat('import { f', t, ' } from \"./c', t, '\";\\nexport const f', s, ' = 1;')")
    return scripts.typescript(files, {})["TS_IMPORTS"].select("from_id", "to_id", "importedName").where("from_id <> to_id")


@query("SELECT 'server/exec/k' || a.s_suppkey || '.k' AS from_id, 'server/exec/k' || b.s_suppkey || '.k' AS to_id FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey // 2 WHERE a.s_suppkey <> b.s_suppkey")
def q_extract_k(g: Tree) -> DataFrame:
    files = g.suppliers("concat('server/exec/k', s, '.k')", "concat('\\\\l k', t, '.k\\nf:{x}')")
    return scripts.k_files(files, {})["LOADS"].select("from_id", "to_id").where("from_id <> to_id")


# -- web and infrastructure


@query("SELECT 't' || s_suppkey AS from_id, 't' || (s_suppkey // 2) AS to_id, 'fk' || s_suppkey AS \"constraintName\" FROM supplier")
def q_extract_db(g: Tree) -> DataFrame:
    files = g.suppliers("concat('db/c', s, '.yaml')", "concat('databaseChangeLog:\\n- changeSet:\\n    id: ', s, '\\n    changes:\\n    - createTable: {tableName: t', s, '}\\n    - addForeignKeyConstraint: {baseTableName: t', s, ', referencedTableName: t', t, ', constraintName: fk', s, '}\\n')")
    return web.database(files, {})["FK_TO"].select("from_id", "to_id", "constraintName")


@query("SELECT 'deployment/web.war/p' || a.s_suppkey || '.jsp' AS from_id, 'deployment/web.war/p' || b.s_suppkey || '.jsp' AS to_id FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey // 2 WHERE a.s_suppkey <> b.s_suppkey")
def q_extract_jsp(g: Tree) -> DataFrame:
    files = g.suppliers("concat('deployment/web.war/p', s, '.jsp')", "if(s % 2 = 0, concat('<%@ include file=\"/p', t, '.jsp\" %>'), concat('<jsp:include page=\"inc/../p', t, '.jsp\"/>'))")
    return web.pages(files, {})["JSP_INCLUDES"].select("from_id", "to_id").where("from_id <> to_id")


@query("SELECT 's' || n_nationkey AS from_id, 's' || ((n_nationkey + 1) % 25) AS to_id FROM nation")
def q_extract_services(g: Tree) -> DataFrame:
    files = g.nations("concat('docker-compose.', k, '.yml')", "concat('services:\\n  s', k, ': {image: i, depends_on: [s', t, ', gone]}\\n')")
    return web.services(files, {})["SERVICE_DEPENDS_ON"].select("from_id", "to_id")


@query(f"WITH {_H} SELECT '@acme/team' || r_regionkey AS from_id, gp AS to_id FROM h JOIN region ON starts_with(path, 'r' || r_regionkey || '/')")
def q_extract_owners(g: Tree) -> DataFrame:
    files = g.table("region").groupBy(F.lit("CODEOWNERS").alias("path")).agg(F.array_join(F.collect_list(F.expr("concat('/r', r_regionkey, '/ @acme/team', r_regionkey)")), "\n").alias("content"))
    return web.owners(files, {"Module": g.modules()})["OWNS"].select("from_id", "to_id")


@query("SELECT m || ' /n' || n_nationkey AS path, CASE m WHEN 'GET' THEN 'getN' || n_nationkey ELSE '' END AS \"operationId\" FROM nation, (VALUES ('GET'), ('POST')) AS t(m)")
def q_extract_endpoints(g: Tree) -> DataFrame:
    files = g.nations("concat('api-specs/s', k, '.yaml')", "concat('paths:\\n  /n', k, ':\\n    get: {operationId: getN', k, '}\\n    post: {}\\n')")
    return web.endpoints(files, {})["ApiEndpoint"].select("path", "operationId")


@query(f"WITH {_H} SELECT 'job' || a.k AS from_id, b.gp AS to_id FROM h a JOIN h b ON starts_with(b.path, a.path) OR starts_with(a.path, b.path)")
def q_extract_gitlab_ci(g: Tree) -> DataFrame:
    """Change patterns are compared as prefixes, so n1 meets n10 too."""
    files = g.nations("concat('infra/gitlab-ci/j', k, '.yml')", "concat('job', k, ':\\n  script: [x]\\n  rules:\\n  - changes: [\"', folder, '/**/*\"]\\n')")
    return web.pipelines(files, {"Module": g.modules()})["CI_TRIGGERED_BY"].select("from_id", "to_id").distinct()


@query(f"WITH {_C} SELECT fqn AS from_id, path || '/src/main/resources/t' || (p % 25) || '.ftl' AS to_id FROM c")
def q_extract_freemarker(g: Tree) -> DataFrame:
    files = g.nations("concat(folder, '/src/main/resources/t', k, '.ftl')", "'${a} ${b}'").unionByName(g.java())
    return web.templates(files, g.classes())["USES_TEMPLATE"].select("from_id", "to_id")


@query(f"WITH {_C} SELECT fqn, '/n' || p || ',/m' || p AS patterns FROM c WHERE p IN (SELECT k FROM h)")
def q_extract_web_xml(g: Tree) -> DataFrame:
    mapping = "'<servlet-mapping><servlet-name>s', k, '</servlet-name><url-pattern>/{}', k, '</url-pattern></servlet-mapping>'"
    text = f"concat('<web-app><servlet><servlet-name>s', k, '</servlet-name><servlet-class>acme.m', k, '.Part', k, '</servlet-class></servlet>', {mapping.format('n')}, {mapping.format('m')}, '</web-app>')"
    found = web.descriptors(g.nations("concat('deployment/w', k, '/WEB-INF/web.xml')", text), g.classes())["JavaClass"]
    return found.where("servletUrlPatterns IS NOT NULL").select("fqn", F.array_join("servletUrlPatterns", ",").alias("patterns"))


@query(f"""WITH {_C}, t AS (SELECT *, path || '/src/test/groovy/Part' || p || 'Spec.groovy' AS spec FROM c WHERE p % 20 = 0)
SELECT spec AS from_id, fqn AS to_id FROM t UNION SELECT spec, parent FROM t WHERE parent IS NOT NULL""")
def q_extract_groovy_tests(g: Tree) -> DataFrame:
    """A test belongs to the class that its name tells and to those that it imports."""
    parts = g.at_home(g.table("part").where("p_partkey % 20 = 0").selectExpr("p_partkey AS p", "p_partkey div 2 AS q"), "p % 25")
    files = parts.selectExpr("concat(path, '/src/test/groovy/Part', p, 'Spec.groovy') AS path", "concat('import acme.m', q % 25, '.Part', q, '\\nclass Part', p, 'Spec extends Specification {}') AS content")
    return web.groovy_tests(files, g.classes())["TESTS_CLASS"].select("from_id", "to_id").distinct()


# -- documented questions over the extracted graph


@query(f"{_DEPENDS} SELECT DISTINCT split_part(x.from_id, ':', 3) AS a, split_part(x.to_id, ':', 3) AS b FROM d x JOIN d y ON x.from_id = y.to_id AND x.to_id = y.from_id WHERE split_part(x.from_id, ':', 3) < split_part(x.to_id, ':', 3)")
def q_question_circular_modules(g: Tree) -> DataFrame:
    """All pairs; the report's first ten rows count parallel edges each."""
    return _modules(g).query("circular_modules", k=None).distinct()


@query(f"WITH {_C} SELECT DISTINCT 'Part' || p AS name FROM c WHERE parent = 'acme.m3.Part3'")
def q_question_subclasses(g: Tree) -> DataFrame:
    """Classes directly below one."""
    return Graph(g.spark, g.classes()).query("implementors", name="Part3", rels=("EXTENDS",)).select("name")
