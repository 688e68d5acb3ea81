"""Queries over the less regular forms of source files, written from the tables, each with its SQL.

Where trees.py has one form of every file, these have the others: nested manifests, constants in
place of literals, interfaces with several implementations, generic signatures, tests beside
sources, archives, transcripts. Files follow from keys, so SQL tells what has to be found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.evaluation import scoring, transcripts
from quillgraph.extract import build, java, libraries, rules, scripts, web
from quillgraph.functions import text as T
from quillgraph.operators import resolve
from quillgraph.plans.trees import Tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = lambda spark, sf_dir: f(Tree(spark, sf_dir))
        ORACLES[name] = sql
        return f

    return add


def _file(g: Tree, table: str, path: str, content: str) -> DataFrame:
    """A file for each row of a table, path and content as SQL over its columns."""
    return g.table(table).selectExpr(f"{path} AS path", f"{content} AS content")


def _one_file(g: Tree, table: str, path: str, line: str, head: str = "''", tail: str = "''") -> DataFrame:
    """One file with the distinct lines of a table's rows, in order."""
    lines = g.table(table).groupBy().agg(F.array_join(F.sort_array(F.collect_set(F.expr(line))), "\n").alias("t"))
    return lines.selectExpr(f"'{path}' AS path", f"concat({head}, t, {tail}) AS content")


# -- libraries


@query("""SELECT DISTINCT coordinate, version AS "latestVersion" FROM (SELECT unnest([
  {'coordinate': 'org.dir:d' || n, 'version': '1.' || n}, {'coordinate': 'org.reg:r' || n, 'version': CASE WHEN n % 2 = 0 THEN '4.' || n ELSE 'managed' END},
  {'coordinate': 'org.lock:k' || n, 'version': '2.' || n}, {'coordinate': 'org.cat:c' || n, 'version': '3.' || n}]) AS x FROM (SELECT DISTINCT p_partkey % 30 AS n FROM part)) AS t, LATERAL (SELECT x.coordinate, x.version)
UNION SELECT 'org.all:both', '9.9'""")
def q_extract_library_sources(g: Tree) -> DataFrame:
    """Build scripts, the registry, lock files and the catalog, in falling priority."""
    n = "p_partkey % 30"
    script = _one_file(g, "part", "r0/n0/build.gradle", f"concat('implementation \"org.dir:d', {n}, ':1.', {n}, '\"')", tail="'\\nimplementation \"org.all:both:9.9\"\\n// implementation \"org.no:comment:1\"\\n'")
    registry = _one_file(g, "part", "buildSrc/globalDependencies.groovy", f"concat('dep \"org.reg:r', {n}, ':', if({n} % 2 = 0, concat('4.', {n}, '!!'), concat('$', '{{v}}')), '\"')", tail="'\\ndep \"org.all:both:8\"'")
    lock = _one_file(g, "part", "gradle.lockfile", f"concat('org.lock:k', {n}, ':2.', {n}, '=compileClasspath')", head="'# a comment=1\\n'", tail="'\\norg.all:both:7=x\\nempty=\\n'")
    catalog = _one_file(g, "part", "gradle/libs.versions.toml", f"concat('alias', {n}, ' = {{ module = \"org.cat:c', {n}, '\", version = \"3.', {n}, '\" }}')", head="'[versions]\\nv = \"1\"\\n[libraries]\\n'", tail="'\\nboth = { module = \"org.all:both\", version = \"6\" }\\n[plugins]\\np = { module = \"org.no:plugin\", version = \"1\" }\\n'")
    files = script.unionByName(registry).unionByName(lock).unionByName(catalog)
    return build.external_libraries(files, {"Module": g.modules()})["ExternalLibrary"].select("coordinate", "latestVersion")


def _archives(g: Tree) -> DataFrame:
    return g.table("part").selectExpr("concat('g', p_partkey % 10) AS `group`", "concat('a', p_partkey % 20) AS artifact", "concat('1.', p_size % 12) AS version", "p_partkey % 4 AS k").distinct().selectExpr(
        "`group`", "artifact", "version", "concat('/c/', `group`, '/', artifact, '/', version, '/h/', element_at(array(concat(artifact, '-', version), concat(artifact, '-', version, '-sources'), concat('x-', artifact), concat(artifact, '-', version, '-all')), cast(k + 1 AS int)), '.jar') AS path")


_ARCHIVES = """WITH r AS (SELECT DISTINCT 'g' || (p_partkey % 10) AS g, 'a' || (p_partkey % 20) AS a, '1.' || (p_size % 12) AS v, p_size % 12 AS minor, p_partkey % 4 AS k FROM part),
f AS (SELECT *, '/c/' || g || '/' || a || '/' || v || '/h/' || [a || '-' || v, a || '-' || v || '-sources', 'x-' || a, a || '-' || v || '-all'][k + 1] || '.jar' AS path FROM r WHERE k <> 1)"""


@query(f"""{_ARCHIVES} SELECT g || ':' || a AS coordinate, v AS version, path FROM f QUALIFY row_number() OVER (PARTITION BY g, a, v ORDER BY CASE WHEN k = 0 THEN 0 ELSE 1 END, length(path), path) = 1""")
def q_main_archives(g: Tree) -> DataFrame:
    """The main file of every version; sources never, files with a classifier only where there is no other."""
    return libraries.main_archives(_archives(g))


@query(f"""{_ARCHIVES} SELECT g || ':' || a AS coordinate, v AS version, path FROM f QUALIFY row_number() OVER (PARTITION BY g, a ORDER BY CASE WHEN minor = 3 THEN 0 ELSE 1 END, minor DESC, CASE WHEN k = 0 THEN 0 ELSE 1 END, length(path), path) = 1""")
def q_ranked_archives(g: Tree) -> DataFrame:
    """The locked version of each artifact, else its greatest, numbers compared as numbers."""
    locked = _archives(g).where("version = '1.3'").select("group", "artifact", "version").distinct()
    return java.ranked_archives(_archives(g), locked)


@query("""WITH c AS (SELECT DISTINCT 'org.p' || (p_partkey % 12) || '.q' || (p_partkey % 5) AS package, 'org.p' || (p_size % 15) || ':l' || (p_partkey % 7) AS coordinate FROM part)
SELECT package, coordinate FROM c QUALIFY row_number() OVER (PARTITION BY package ORDER BY CASE WHEN ends_with(coordinate, ':l3') THEN 0 ELSE 1 END,
  CASE WHEN starts_with(package, split_part(coordinate, ':', 1)) THEN -length(split_part(coordinate, ':', 1)) ELSE 0 END, length(coordinate), coordinate) = 1""")
def q_package_owners(g: Tree) -> DataFrame:
    """One library a package: a locked one, the nearest group, the shortest name."""
    claims = g.table("part").selectExpr("concat('org.p', p_partkey % 12, '.q', p_partkey % 5) AS package", "concat('org.p', p_size % 15, ':l', p_partkey % 7) AS coordinate")
    return java.package_owners(claims, claims.where("coordinate LIKE '%:l3'").select("coordinate"))


@query("""WITH n AS (SELECT p_partkey AS k, 'acme.m' || (p_partkey % 30) || '.x' || (p_partkey % 4) || '.C' AS name FROM part),
e AS (SELECT 'acme.m' || n_nationkey AS p FROM nation UNION SELECT 'acme.m' || n_nationkey || '.x3.' FROM nation UNION SELECT 'acme.m' || n_nationkey || '.x1.C.' FROM nation UNION SELECT 'acme.m' || n_nationkey || '.x' FROM nation)
SELECT k, arg_max(p, length(p)) AS entry FROM n JOIN e ON name = p OR starts_with(name, CASE WHEN ends_with(p, '.') THEN p ELSE p || '.' END) GROUP BY k""")
def q_raw_prefix(g: Tree) -> DataFrame:
    """The longest entry that a name begins with; entries end at segments."""
    names = g.table("part").selectExpr("p_partkey AS k", "concat('acme.m', p_partkey % 30, '.x', p_partkey % 4, '.C') AS name")
    entries = g.table("nation").selectExpr("explode(array(concat('acme.m', n_nationkey), concat('acme.m', n_nationkey, '.x3.'), concat('acme.m', n_nationkey, '.x1.C.'), concat('acme.m', n_nationkey, '.x'))) AS p").selectExpr("p", "p AS entry")
    return resolve.raw_prefix(names, "name", entries, "p", "entry").select("k", "entry")


# -- modules and manifests


@query("""SELECT ':r' || (n_regionkey) || ':n' || n_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN ':ui' ELSE '' END AS from_id, 'dep' || s_suppkey AS to_id, 'peerDependency' AS "depType" FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def q_extract_npm_nested(g: Tree) -> DataFrame:
    """A manifest belongs to the longest module path above it."""
    homes = g.homes()
    modules = g.modules().unionByName(homes.selectExpr("concat(gp, ':ui') AS gradlePath", "'ui' AS name", "concat(path, '/ui') AS path", "'typescript' AS language"))
    files = g.at_home(g.table("supplier"), "s_nationkey").selectExpr("concat(path, if(s_suppkey % 2 = 0, '/ui/deep', '/other'), '/s', s_suppkey, '/package.json') AS path", "concat('{\"name\": \"w', s_suppkey, '\", \"peerDependencies\": {\"dep', s_suppkey, '\": \"^1\"}}') AS content")
    return build.npm(files, {"Module": modules})["USES_NPM"].select("from_id", "to_id", "depType")


@query("""SELECT ':m' || s_suppkey AS "gradlePath", CASE s_suppkey % 5 WHEN 0 THEN 'sail' WHEN 1 THEN 'typescript' WHEN 2 THEN 'java' WHEN 3 THEN 'k' ELSE 'mixed' END AS language FROM supplier""")
def q_module_languages(g: Tree) -> DataFrame:
    """A module's language by the first sign that its files show."""
    folder = "concat('m', s_suppkey)"
    scripts_ = g.table("supplier").selectExpr(f"concat({folder}, '/build.gradle') AS path", "'' AS content")
    sign = "element_at(array('/src/someApp/x.xml', '/package.json', '/src/main/java/A.java', '/q.k', '/readme'), cast(s_suppkey % 5 + 1 AS int))"
    more = "element_at(array('/package.json', '/src/main/java/A.java', '/q.k', '/readme', '/deep/q.k'), cast(s_suppkey % 5 + 1 AS int))"
    files = scripts_.unionByName(g.table("supplier").selectExpr(f"explode(array(concat({folder}, {sign}), concat({folder}, {more}))) AS path", "'' AS content"))
    return build.gradle(files, {})["Module"].select("gradlePath", "language")


@query("""SELECT ':r' || n_regionkey || ':n' || n_nationkey AS from_id, 'r' || n_regionkey || '/n' || n_nationkey || '/server/exec/k' || s_suppkey || '.k' AS to_id FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def q_extract_contains(g: Tree) -> DataFrame:
    """Modules hold the files below their paths."""
    files = g.at_home(g.table("supplier"), "s_nationkey").selectExpr("concat(path, '/server/exec/k', s_suppkey, '.k') AS path", "'f:{x}' AS content")
    return scripts.k_files(files, {"Module": g.modules()})["CONTAINS_KFile"].select("from_id", "to_id")


@query("""SELECT 'ui/a' || a.s_suppkey || '.tsx' AS from_id, 'ui/a' || b.s_suppkey || '.tsx' AS to_id, 'Box' || b.s_suppkey AS "componentName" FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey // 2 WHERE a.s_suppkey <> b.s_suppkey AND a.s_suppkey % 3 < 2""")
def q_extract_jsx(g: Tree) -> DataFrame:
    """Tags that name what a file imports; imports alone render nothing."""
    s, t = "s_suppkey", "s_suppkey div 2"
    content = f"concat('import ', if({s} % 2 = 0, concat('{{ Box', {t}, ' }}'), concat('Box', {t})), ' from \"./a', {t}, '\";\\nexport const Box', {s}, ' = () => ', if({s} % 3 < 2, concat('<Box', {t}, ' x=\"1\"/>'), 'null'), ';')"
    return scripts.typescript(_file(g, "supplier", f"concat('ui/a', {s}, '.tsx')", content), {})["RENDERS"].select("from_id", "to_id", "componentName").where("from_id <> to_id")


# -- Java


@query("""SELECT 'ae.t' || (p_partkey % 25) AS from_id, 'acme.u.Use' || p_partkey AS to_id FROM part UNION SELECT 'ae.lit', 'acme.u.Use' || p_partkey FROM part WHERE p_partkey % 2 = 0""")
def q_extract_toggle_constants(g: Tree) -> DataFrame:
    """Constants of one class that others name, plainly or by their class; and literals of the other calls."""
    keys = g.table("nation").groupBy().agg(F.array_join(F.sort_array(F.collect_list(F.expr("concat('  public static final String KEY_', n_nationkey, ' = \"ae.t', n_nationkey, '\";')"))), "\n").alias("t"))
    keys = keys.selectExpr("'u/src/main/java/acme/u/Keys.java' AS path", "concat('package acme.u;\\npublic class Keys {\\n', t, '\\n  static final String LIT = \"ae.lit\";\\n}') AS content")
    body = "concat('package acme.u;\\nclass Use', p_partkey, ' { boolean a() { return isFeatureEnabled(', if(p_partkey % 3 = 0, 'Keys.', ''), 'KEY_', p_partkey % 25, ')', if(p_partkey % 2 = 0, ' || getBoolean(\"ae.lit\")', ''), '; } }')"
    files = _file(g, "part", "concat('u/src/main/java/acme/u/Use', p_partkey, '.java')", body).unionByName(keys)
    graph = java.java(files, {})
    return rules.toggles(files, graph | {"SailRule": g.spark.createDataFrame([], "uuid string")})["GATES_JavaClass"].select("from_id", "to_id")


@query("""SELECT 'acme.d.User' || s_suppkey AS from_id, 'acme.d.Impl' || n_nationkey AS to_id, CASE s_suppkey % 2 WHEN 0 THEN 'field' ELSE 'constructor' END AS "injectionType", n_nationkey % 10 = 3 AS "isPrimary", 'acme.d.Face' || (s_suppkey % 5) AS "interfaceType" FROM supplier JOIN nation ON n_nationkey % 5 = s_suppkey % 5""")
def q_extract_di_implementations(g: Tree) -> DataFrame:
    """An injected interface stands for all its implementations."""
    at = "concat('d/src/main/java/acme/d/{}', {}, '.java')"
    faces = _file(g, "region", at.format("Face", "r_regionkey"), "concat('package acme.d;\\npublic interface Face', r_regionkey, ' {}')")
    impls = _file(g, "nation", at.format("Impl", "n_nationkey"), "concat('package acme.d;\\n@Service', if(n_nationkey % 10 = 3, ' @Primary', ''), ' public class Impl', n_nationkey, ' implements Face', n_nationkey % 5, ' {}')")
    user = "concat('package acme.d;\\n@Component public class User', s_suppkey, ' { ', if(s_suppkey % 2 = 0, concat('@Autowired private Face', s_suppkey % 5, ' f;'), concat('public User', s_suppkey, '(Face', s_suppkey % 5, ' f, int n) {}')), ' }')"
    files = faces.unionByName(impls).unionByName(_file(g, "supplier", at.format("User", "s_suppkey"), user))
    return java.spring(files, java.java(files, {}))["INJECTS"].select("from_id", "to_id", "injectionType", "isPrimary", "interfaceType")


@query("""SELECT 'acme.e.E' || s_suppkey || 'x' AS from_id, 't' || (s_suppkey % 20) AS to_id FROM supplier WHERE s_suppkey % 20 < 15""")
def q_extract_entities(g: Tree) -> DataFrame:
    """Entities to the tables of the change log; tables that it does not know give no edge."""
    entities = _file(g, "supplier", "concat('e/src/main/java/acme/e/E', s_suppkey, 'x.java')", "concat('package acme.e;\\n@Entity @Table(name = \"t', s_suppkey % 20, '\") public class E', s_suppkey, 'x {}')")
    log = _file(g, "nation", "concat('db/c', n_nationkey, '.yaml')", "concat('databaseChangeLog:\\n- changeSet:\\n    id: ', n_nationkey, '\\n    changes:\\n    - createTable: {tableName: t', n_nationkey % 15, '}\\n')")
    return web.database(log, java.java(entities, {}))["MAPS_TO"].select("from_id", "to_id")


@query("""SELECT 'acme.g.G' || s_suppkey || 'x' || m AS id, a AS arity FROM supplier, (VALUES ('#put(Map,List[],T)', 3), ('#each(Entry[],int[])', 2)) AS t(m, a)
UNION ALL SELECT 'acme.g.G' || s_suppkey || 'x.Inner#Inner(String)', 1 FROM supplier""")
def q_extract_generics(g: Tree) -> DataFrame:
    """Signatures without type arguments, nested classes and constructors."""
    body = "concat('package acme.g;\\npublic class G', s_suppkey, 'x<T extends Comparable<T>> {\\n  <K> void put(final Map<String, List<K>> m, java.util.List<? super K>[] l, T t) {}\\n  int each(@Nullable Map.Entry<K, V>[] e, int[] n) { return 1; }\\n  static class Inner { Inner(String s) {} }\\n}')"
    return java.java(_file(g, "supplier", "concat('g/src/main/java/acme/g/G', s_suppkey, 'x.java')", body), {})["Method"].select("id", "arity")


@query("""SELECT 'acme.t.T' || s_suppkey || 'x' AS fqn, s_suppkey % 3 > 0 AS "isTest", CASE WHEN s_suppkey % 2 = 0 THEN 'Deprecated,Service' ELSE '' END AS annotations FROM supplier""")
def q_extract_tests_and_annotations(g: Tree) -> DataFrame:
    """Test classes by their folders, and what classes are marked with."""
    path = "concat('t/src/', element_at(array('main', 'test', 'integrationTest'), cast(s_suppkey % 3 + 1 AS int)), '/java/acme/t/T', s_suppkey, 'x.java')"
    body = "concat('package acme.t;\\n', if(s_suppkey % 2 = 0, '@Service @Deprecated(since = \"1\") ', ''), 'public class T', s_suppkey, 'x {}')"
    return java.java(_file(g, "supplier", path, body), {})["JavaClass"].select("fqn", "isTest", F.array_join(F.sort_array("annotations"), ",").alias("annotations"))


@query("""WITH u AS (SELECT p_partkey AS p, 'lib.p' || (p_partkey % 15) AS package FROM part)
SELECT 'lib.p' || i || '.Thing' AS "import", count(*) AS n FROM (SELECT p_partkey % 15 AS i FROM part) WHERE i >= 10 GROUP BY 1""")
def q_unresolved_imports(g: Tree) -> DataFrame:
    """Imports that no library owns, by frequency."""
    return _usage(g)["UnresolvedImports"]


@query("""SELECT 'org.lib:p' || i AS coordinate, count(DISTINCT m) AS "moduleUsageCount" FROM (SELECT p_partkey % 15 AS i, p_partkey % 25 AS m FROM part) WHERE i < 10 GROUP BY 1""")
def q_library_usage_counts(g: Tree) -> DataFrame:
    """How many modules use each library, kept on the library."""
    return _usage(g)["ExternalLibrary"].select("coordinate", F.col("moduleUsageCount").cast("long").alias("moduleUsageCount"))


def _usage(g: Tree) -> dict[str, DataFrame]:
    files = g.at_home(g.table("part"), "p_partkey % 25").selectExpr("concat(path, '/src/main/java/acme/l/P', p_partkey, 'x.java') AS path", "concat('package acme.l;\\nimport lib.p', p_partkey % 15, '.Thing;\\nclass P', p_partkey, 'x {}') AS content")
    owned = g.spark.range(10)
    known = owned.selectExpr("concat('org.lib:p', id) AS coordinate", "'org.lib' AS `group`", "concat('p', id) AS artifact", "'1' AS latestVersion", "'p' AS name", "'' AS catalogAlias")
    graph = {"Module": g.modules(), "ExternalLibrary": known}
    return java.library_usage(files, graph | java.java(files, graph), owned.selectExpr("concat('lib.p', id) AS package", "concat('org.lib:p', id) AS coordinate"))


# -- evaluation


@query("""SELECT 'c' || c_custkey AS test_case_id, CASE c_custkey % 2 WHEN 0 THEN 'graph_assisted' ELSE 'tools_only' END AS method, CASE WHEN c_custkey % 4 = 3 THEN 'Alpha|Beta' ELSE 'i' || c_nationkey || '|z' END AS items,
  CAST(c_custkey % 3 AS BIGINT) AS grep_calls, CAST(1 AS BIGINT) AS file_reads, CAST(c_custkey % 3 + 2 AS BIGINT) AS total_tool_calls, CAST(CASE WHEN c_custkey % 4 = 3 THEN 0.0 ELSE 0.5 END AS DOUBLE) AS confidence FROM customer""")
def q_transcript_results(g: Tree) -> DataFrame:
    """Answers and tool use read from session texts: the last answer object, else the items of lists."""
    calls = "concat(repeat('<invoke name=\"grep\">x</invoke>\\n', cast(c_custkey % 3 AS int)), '<invoke name=\"read\"/>\\n<invoke name=\"graph_query\"/>\\n')"
    answer = "concat('{\"answer_items\": [\"old\"]}\\n```json\\n{\"answer_items\": [\"i', c_nationkey, '\", \"z\"], \"confidence\": 0.5}\\n```\\n')"
    sessions = g.table("customer").selectExpr("concat('/s/c', c_custkey, if(c_custkey % 2 = 0, '_graph_assisted', '_tools_only'), '.txt') AS path", f"concat({calls}, if(c_custkey % 4 = 3, '- `Alpha`\\n- Beta is one\\n- `alpha`\\n', {answer})) AS text")
    found = transcripts.results(sessions)
    return found.select("test_case_id", "method", F.array_join("answer_items", "|").alias("items"), *[F.col(c).cast("long").alias(c) for c in ("grep_calls", "file_reads", "total_tool_calls")], "confidence")


@query("""WITH r AS (SELECT n_regionkey AS k, n_nationkey AS n FROM nation), c AS (SELECT 'c' || k AS category, count(*) AS n, sum(n) AS s FROM r GROUP BY k)
SELECT advice, string_agg(category, ', ' ORDER BY category) AS categories FROM (
  SELECT 'use graph' AS advice, category FROM c WHERE s % 3 > s % 2 AND n >= 2 UNION ALL SELECT 'skip graph', category FROM c WHERE s % 3 = 0 AND s % 2 >= n / 2
  UNION ALL SELECT 'redundant', category FROM c WHERE s % 7 > 0.8 * 4 AND n >= 2 UNION ALL SELECT 'review exclusive graph items', category FROM c WHERE s % 4 > 0 UNION ALL SELECT 'graph is cheaper', category FROM c WHERE s % 5 > 1.5 AND n >= 2) GROUP BY 1""")
def q_recommendations(g: Tree) -> DataFrame:
    """Which categories of a report meet each rule of advice."""
    report = g.table("nation").groupBy(F.expr("concat('c', n_regionkey)").alias("category")).agg(F.count("*").alias("n_cases"), F.sum("n_nationkey").alias("s"))
    report = report.selectExpr("category", "n_cases", "s % 3 AS graph_wins", "s % 2 AS tools_wins", "s % 7 AS avg_overlap", "4 AS avg_graph_items", "3 AS avg_tools_items", "s % 4 AS graph_exclusive", "s % 5 AS avg_token_ratio")
    return scoring.recommendations(report)


@query("""SELECT id FROM (SELECT 'c' || c_custkey AS id, 'cat' || c_nationkey AS category, c_custkey % 6 AS t FROM customer) WHERE category IN ('cat1', 'cat7', 'cat9') AND t IN (1, 2, 3)""")
def q_select_cases(g: Tree) -> DataFrame:
    """Cases by category and any of several tags."""
    cases = g.table("customer").selectExpr("concat('c', c_custkey) AS id", "concat('cat', c_nationkey) AS category", "array(concat('t', c_custkey % 6), concat('t', (c_custkey + 1) % 6)) AS tags")
    return scoring.select_cases(cases, None, ["cat1", "cat7", "cat9"], ["t2", "t3"]).select("id")


# -- scalar functions


@query("""SELECT c_custkey AS k, 'a|b' || c_nationkey AS parts, CASE WHEN c_nationkey > 0 THEN CAST(100 * (c_custkey % 7) AS DOUBLE) / c_nationkey ELSE CAST(0 AS DOUBLE) END AS share, c_custkey % 3 = 0 OR (c_custkey % 3 = 1 AND c_nationkey < 100) AS variable, CAST(c_custkey % 9 AS INTEGER) AS last_n FROM customer""")
def q_scalar_functions(g: Tree) -> DataFrame:
    """Comma lists, guarded shares, type variables, and the last valid object of a text."""
    name = "element_at(array('T', concat('T', c_nationkey), concat('Type', c_nationkey)), cast(c_custkey % 3 + 1 AS int))"
    text = "concat('```json\\n{\"n\": 1}\\n```\\nand\\n```json\\n{\"n\": ', c_custkey % 9, '}\\n```\\n```json\\n{broken}\\n```')"
    rows = g.table("customer").selectExpr("c_custkey AS k", "concat(' a, b', c_nationkey, ' ,, ') AS list", "cast(c_custkey % 7 AS double) AS part", "cast(c_nationkey AS double) AS whole", f"{name} AS name", f"{text} AS text")
    last = T.last_valid_json(F.col("text"), "struct<n:int>")
    return rows.select("k", F.array_join(T.csv_list(F.col("list")), "|").alias("parts"), T.percentage(F.col("part"), F.col("whole")).alias("share"), T.is_type_variable(F.col("name")).alias("variable"), last["n"].alias("last_n"))
