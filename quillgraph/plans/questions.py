"""The documented questions, asked of a graph that is laid over the tables, each with its SQL.

The frames of the graph are written once, in SQL that both engines read: modules are nations,
classes are parts, rules and tables are suppliers, and so on; what refers to what follows from
orders and from keys. The Spark side asks the catalogue's question of these frames, the other
side says in SQL what the question means.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.graph import Graph
from quillgraph.plans.overlay import Overlay

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _half(x: str, by: int = 2) -> str:
    return f"CAST(floor({x} / {by}) AS BIGINT)"


_NEXT = "SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber = 1 AND b.l_linenumber = 2 AND a.l_partkey <> b.l_partkey"
_FN = "'fn' || CAST(s_suppkey % 20 AS VARCHAR(20))"
#: Frames by name; tables stand in braces.
FRAMES = {
    "Module": "SELECT ':n' || n_nationkey AS gradlePath, 'n' || n_nationkey AS name, 'r' || n_regionkey || '/n' || n_nationkey AS path FROM {nation}",
    "DEPENDS_ON": "SELECT ':n' || s_nationkey AS from_id, ':n' || ((s_suppkey * 7) % 25) AS to_id, CASE WHEN s_suppkey % 2 = 0 THEN 'api' ELSE 'implementation' END AS config FROM {supplier} WHERE s_nationkey <> (s_suppkey * 7) % 25",
    "Package": "SELECT DISTINCT 'acme.m' || (p_partkey % 25) AS name FROM {part}",
    "JavaClass": "SELECT 'acme.P' || p_partkey AS fqn, 'P' || p_partkey || CASE WHEN p_partkey % 13 = 4 THEN 'SpringConfig' WHEN p_partkey % 3 = 0 THEN 'Write' ELSE '' END AS name, 'src/P' || p_partkey || '.java' AS path, ':n' || (p_partkey % 25) AS module, CASE WHEN p_partkey % 7 = 0 THEN 'interface' ELSE 'class' END AS kind, p_partkey % 11 = 5 AS isTest FROM {part}",
    "IMPORTS": f"SELECT 'acme.P' || a AS from_id, 'acme.P' || b AS to_id FROM ({_NEXT}) AS x",
    "EXTENDS": f"SELECT 'acme.P' || p_partkey AS from_id, 'acme.P' || {_half('p_partkey')} AS to_id FROM {{part}} WHERE p_partkey >= 2 AND p_partkey % 5 = 1",
    "IMPLEMENTS": f"SELECT 'acme.P' || p_partkey AS from_id, 'acme.P' || ({_half('p_partkey', 7)} * 7) AS to_id FROM {{part}} WHERE p_partkey % 7 BETWEEN 1 AND 3 AND p_size > 15",
    "INJECTS": f"SELECT 'acme.P' || p_partkey AS from_id, 'acme.P' || {_half('p_partkey', 3)} AS to_id, 'f' || (p_partkey % 4) AS fieldName, 'field' AS injectionType, p_partkey % 2 = 0 AS isPrimary, 'acme.P0' AS interfaceType FROM {{part}} WHERE p_size % 2 = 0",
    "SPRING_IMPORTS": f"SELECT 'acme.P' || p_partkey AS from_id, 'acme.P' || {_half('p_partkey', 4)} AS to_id FROM {{part}} WHERE p_size < 30",
    "PRODUCES": f"SELECT 'acme.P' || {_half('p_partkey', 5)} AS from_id, 'acme.P' || p_partkey AS to_id FROM {{part}} WHERE p_size > 40",
    "CONTAINS_Module_Package": "SELECT ':n' || n_nationkey AS from_id, 'acme.m' || ((n_nationkey + 1) % 25) AS to_id FROM {nation}",
    "CONTAINS_JavaClass": "SELECT 'acme.m' || (p_partkey % 25) AS from_id, 'acme.P' || p_partkey AS to_id FROM {part}",
    "Team": "SELECT '@acme/team' || r_regionkey AS handle, 'team' || r_regionkey AS name FROM {region}",
    "OWNS": "SELECT '@acme/team' || n_regionkey AS from_id, ':n' || n_nationkey AS to_id FROM {nation}",
    "SailRule": "SELECT 'R' || s_suppkey AS uuid, 'rule' || s_suppkey AS name, 'rules/' || s_suppkey || '.xml' AS path, s_suppkey % 3 = 0 AS isSystemOnly, s_suppkey % 50 AS definitionLineCount FROM {supplier}",
    "CALLS": f"SELECT 'R' || s_suppkey AS from_id, 'R' || {_half('s_suppkey')} AS to_id FROM {{supplier}} WHERE s_suppkey % 4 < 3",
    "CALLS_BUILTIN": f"SELECT 'R' || s_suppkey AS from_id, 'acme.P' || (s_suppkey % 20) AS to_id, {_FN} AS functionName FROM {{supplier}}",
    "CALLS_REACTION": "SELECT 'R' || s_suppkey AS from_id, 'acme.P' || (s_suppkey % 15) AS to_id, 'key' || (s_suppkey % 5) AS reactionKey FROM {supplier}",
    "Table": "SELECT 't' || s_suppkey AS name FROM {supplier}",
    "FK_TO": f"SELECT 't' || s_suppkey AS from_id, 't' || {_half('s_suppkey')} AS to_id FROM {{supplier}}",
    "Entity": "SELECT 'acme.P' || p_partkey AS fqn FROM {part} WHERE p_partkey % 2 = 0",
    "MAPS_TO": "SELECT 'acme.P' || p_partkey AS from_id, 't' || (p_partkey % 8) AS to_id FROM {part} WHERE p_partkey % 2 = 0",
    "FeatureToggle": "SELECT DISTINCT 'ae.t' || (p_partkey % 30) AS name FROM {part}",
    "GATES_JavaClass": "SELECT 'ae.t' || (p_partkey % 30) AS from_id, 'acme.P' || p_partkey AS to_id FROM {part} WHERE p_size % 3 = 0",
    "GATES_SailRule": "SELECT 'ae.t' || (s_suppkey % 30) AS from_id, 'R' || s_suppkey AS to_id FROM {supplier}",
    "ExpressionTest": "SELECT 'test/e' || s_suppkey || '.txt' AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'unit' ELSE 'integration' END AS testType FROM {supplier}",
    "TESTS_RULE": f"SELECT 'test/e' || s_suppkey || '.txt' AS from_id, 'R' || {_half('s_suppkey', 3)} AS to_id FROM {{supplier}}",
    "GroovyTest": "SELECT 'test/P' || p_partkey || 'Spec.groovy' AS path, 'P' || p_partkey || 'Spec' AS name, 'spock' AS testFramework FROM {part}",
    "TESTS_CLASS": f"SELECT 'test/P' || p_partkey || 'Spec.groovy' AS from_id, 'acme.P' || {_half('p_partkey', 6)} AS to_id FROM {{part}}",
    "CdtType": "SELECT 'T' || n_nationkey AS name, 'complexType' AS kind, n_nationkey % 6 AS fieldCount FROM {nation}",
    "REFERENCES_CDT": "SELECT 'R' || s_suppkey AS from_id, 'T' || s_nationkey AS to_id FROM {supplier}",
    "DockerService": "SELECT 's' || n_nationkey AS name, 'docker-compose.' || n_regionkey || '.yml' AS composeFile FROM {nation}",
    "SERVICE_DEPENDS_ON": "SELECT 's' || n_nationkey AS from_id, 's' || ((n_nationkey + 1) % 25) AS to_id FROM {nation}",
    "JspPage": "SELECT 'web/p' || s_suppkey || '.jsp' AS path, 'p' || s_suppkey || '.jsp' AS name FROM {supplier}",
    "JSP_INCLUDES": "SELECT 'web/p' || a.s_suppkey || '.jsp' AS from_id, 'web/p' || b.s_suppkey || '.jsp' AS to_id FROM {supplier} a JOIN {supplier} b ON b.s_suppkey BETWEEN a.s_suppkey * 2 + 1 AND a.s_suppkey * 2 + 2",
    "ExternalLibrary": "SELECT 'org.lib:l' || s_suppkey AS coordinate, '1.' || s_suppkey AS latestVersion FROM {supplier}",
    "LIB_DEPENDS_ON": f"SELECT 'org.lib:l' || {_half('s_suppkey')} AS from_id, 'org.lib:l' || s_suppkey AS to_id FROM {{supplier}} WHERE s_suppkey > 0 UNION ALL SELECT 'org.lib:l3', 'org.lib:l1' FROM {{region}} WHERE r_regionkey = 0",
    "USES_LIBRARY_JavaClass": "SELECT DISTINCT 'acme.P' || l_partkey AS from_id, 'org.lib:l' || l_suppkey AS to_id FROM {lineitem}",
    "USES_LIBRARY_Module": "SELECT DISTINCT ':n' || (l_partkey % 25) AS from_id, 'org.lib:l' || l_suppkey AS to_id FROM {lineitem}",
    "NpmPackage": "SELECT 'w' || n_nationkey AS name, '1.' || n_nationkey AS version, n_nationkey >= 0 AS isWorkspace FROM {nation} UNION ALL SELECT name, version, false FROM (SELECT r_regionkey AS k, 'react-' || r_regionkey AS name, '9.' || r_regionkey AS version FROM {region}) AS x",
    "NPM_DEPENDS_ON": "SELECT 'w' || n_nationkey AS from_id, 'react-' || n_regionkey AS to_id FROM {nation} UNION ALL SELECT 'w' || n_nationkey, 'react-' || ((n_regionkey + 1) % 5) FROM {nation} WHERE n_nationkey % 2 = 0",
}
#: Frames that Spark reads in another form than the SQL: a range of two keys as two equal keys, where a range join compares all pairs.
EQUAL_KEYS = {
    "JSP_INCLUDES": "SELECT 'web/p' || a.s_suppkey || '.jsp' AS from_id, 'web/p' || b.s_suppkey || '.jsp' AS to_id FROM (SELECT s_suppkey, explode(array(s_suppkey * 2 + 1, s_suppkey * 2 + 2)) AS next FROM {supplier}) a JOIN {supplier} b ON b.s_suppkey = a.next",
}
TABLES = ("region", "nation", "supplier", "part", "lineitem")


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The frames; a question scans those alone that it needs."""
    tables = {t: Overlay(spark, sf_dir).table(t) for t in TABLES}
    return Graph(spark, {name: spark.sql(sql, **{t: df for t, df in tables.items() if f"{{{t}}}" in sql}) for name, sql in (FRAMES | EQUAL_KEYS).items()})


def _frames_sql(sql: str) -> str:
    """The frames that sql names, as common table expressions."""
    used = [n for n in FRAMES if re.search(rf"\b{n}\b", sql)]
    return ",\n".join(f"{n} AS MATERIALIZED ({FRAMES[n].format(**{t: t for t in TABLES})})" for n in used)


def question(which: str, sql: str, /, **params) -> None:
    """Registers question_<which>; lists are joined to text on both sides, which compare exactly."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = graph(spark, sf_dir).query(which, **params)
        return found.select(*[F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in found.dtypes])

    QUERIES[f"question_{which}"] = run
    recursive, own = "RECURSIVE " * sql.startswith("RECURSIVE "), sql.removeprefix("RECURSIVE ")
    ORACLES[f"question_{which}"] = f"WITH {recursive}{_frames_sql(own)}" + (f",\n{own.removeprefix('WITH ')}" if own.startswith("WITH ") else f"\n{own}")


def _list(value: str, most: int | None = None, distinct: bool = True) -> str:
    sorted_ = f"list_sort(list({'DISTINCT ' if distinct else ''}{value}) FILTER ({value} IS NOT NULL))"
    return f"coalesce(array_to_string({f'list_slice({sorted_}, 1, {most})' if most else sorted_}, '|'), '')"


question("class_impact", """WITH e AS (SELECT * FROM IMPORTS UNION SELECT * FROM EXTENDS UNION SELECT * FROM IMPLEMENTS UNION SELECT from_id, to_id FROM INJECTS ),
r AS (SELECT from_id AS n FROM e WHERE to_id = 'acme.P8' UNION SELECT a.from_id FROM e a JOIN e b ON a.to_id = b.from_id WHERE b.to_id = 'acme.P8')
SELECT DISTINCT name, path, module FROM JavaClass JOIN r ON fqn = n WHERE NOT isTest""", name="P8")
question("rule_impact", """RECURSIVE WITH r AS (SELECT from_id AS n, 1 AS d FROM CALLS WHERE to_id = 'R1' UNION SELECT from_id, d + 1 FROM CALLS JOIN r ON to_id = n WHERE d < 3)
SELECT DISTINCT name, path FROM SailRule JOIN r ON uuid = n""", name="rule1")
question("table_impact", f"""SELECT 't2' AS "table", (SELECT {_list('from_id')} FROM FK_TO WHERE to_id = 't2') AS "childTables",
  (SELECT {_list('name')} FROM MAPS_TO JOIN JavaClass ON fqn = from_id WHERE to_id = 't2') AS entities,
  (SELECT {_list('c.name', 10)} FROM MAPS_TO m JOIN IMPORTS i ON i.to_id = m.from_id JOIN JavaClass c ON c.fqn = i.from_id WHERE m.to_id = 't2' AND NOT c.isTest) AS "topConsumers" """, name="t2")
question("config_impact", f"""SELECT 'P4SpringConfig' AS name, (SELECT {_list('name')} FROM SPRING_IMPORTS JOIN JavaClass ON fqn = to_id WHERE from_id = 'acme.P4') AS imports,
  (SELECT {_list('name')} FROM PRODUCES JOIN JavaClass ON fqn = to_id WHERE from_id = 'acme.P4') AS produces,
  (SELECT {_list('name')} FROM SPRING_IMPORTS JOIN JavaClass ON fqn = from_id WHERE to_id = 'acme.P4') AS "importedBy" """, name="P4SpringConfig")
question("library_impact", f"""SELECT "latestVersion" AS "currentVersion", (SELECT count(DISTINCT from_id) FROM USES_LIBRARY_JavaClass WHERE to_id = coordinate) AS "classesAffected",
  (SELECT count(DISTINCT from_id) FROM USES_LIBRARY_Module WHERE to_id = coordinate) AS "modulesAffected",
  (SELECT {_list('from_id')} FROM LIB_DEPENDS_ON WHERE to_id = coordinate) AS "librariesDependingOnIt" FROM ExternalLibrary WHERE coordinate = 'org.lib:l3'""", coordinate="org.lib:l3")
question("package_users", """SELECT from_id AS module, version FROM NPM_DEPENDS_ON JOIN NpmPackage ON name = from_id WHERE to_id IN ('react-1', 'react-3') AND isWorkspace""", names=("react-1", "react-3"))
question("package_family", """SELECT a.name AS library, a.version, b.name AS "usedBy" FROM NPM_DEPENDS_ON JOIN NpmPackage a ON a.name = to_id JOIN NpmPackage b ON b.name = from_id WHERE starts_with(a.name, 'react-') AND NOT a.isWorkspace AND b.isWorkspace""")
question("function_class", """SELECT name, fqn, path FROM CALLS_BUILTIN JOIN JavaClass ON fqn = to_id WHERE functionName = 'fn3'""", function="fn3")
question("reaction_handler", """SELECT r.name AS "sailCaller", c.name AS "javaHandler", c.path FROM CALLS_REACTION JOIN SailRule r ON uuid = from_id JOIN JavaClass c ON fqn = to_id WHERE reactionKey = 'key2'""", key="key2")
question("rule_to_tables", """RECURSIVE WITH e AS (SELECT to_id AS fn FROM CALLS_BUILTIN WHERE from_id = 'R3'),
r AS (SELECT fn, from_id AS n, 1 AS d FROM e JOIN IMPORTS ON to_id = fn UNION SELECT fn, from_id, d + 1 FROM IMPORTS JOIN r ON to_id = n WHERE d < 3)
SELECT DISTINCT 'rule3' AS "sailRule", f.name AS "javaFunction", x.name AS entity, m.to_id AS "dbTable" FROM r JOIN JavaClass f ON f.fqn = fn JOIN JavaClass s ON s.fqn = n JOIN IMPORTS i ON i.from_id = n
JOIN JavaClass x ON x.fqn = i.to_id JOIN MAPS_TO m ON m.from_id = i.to_id WHERE contains(s.name, 'Write') OR contains(s.name, 'Sync')""", name="rule3")
question("toggle_scope", """SELECT 'JavaClass' AS type, name, path FROM GATES_JavaClass JOIN JavaClass ON fqn = to_id WHERE from_id = 'ae.t3' UNION ALL SELECT 'SailRule', name, path FROM GATES_SailRule JOIN SailRule ON uuid = to_id WHERE from_id = 'ae.t3'""", name="ae.t3")
question("top_toggles", """SELECT from_id AS name, count(*) AS "gatedCount" FROM (SELECT from_id FROM GATES_JavaClass UNION ALL SELECT from_id FROM GATES_SailRule ) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
question("class_owner", """SELECT DISTINCT 'P8' AS name, m.name AS module, t.name AS team, handle FROM CONTAINS_JavaClass a JOIN CONTAINS_Module_Package b ON b.to_id = a.from_id JOIN Module m ON gradlePath = b.from_id
JOIN OWNS o ON o.to_id = gradlePath JOIN Team t ON handle = o.from_id WHERE a.to_id = 'acme.P8'""", name="P8")
question("team_modules", """SELECT m.name AS module, m.path FROM OWNS JOIN Team t ON handle = from_id JOIN Module m ON gradlePath = to_id WHERE contains(t.name, 'm1')""", word="m1")
question("rule_tests", """SELECT path, "testType" FROM TESTS_RULE JOIN ExpressionTest ON path = from_id WHERE to_id = 'R2'""", name="rule2")
question("class_tests", """SELECT path, name, "testFramework" FROM TESTS_CLASS JOIN GroovyTest ON path = from_id WHERE to_id = 'acme.P8'""", name="P8")
question("untested_rules", """SELECT name, path, "definitionLineCount" FROM SailRule WHERE NOT isSystemOnly AND uuid NOT IN (SELECT to_id FROM TESTS_RULE) ORDER BY 3 DESC, 1, 2 LIMIT 20""")
question("injected", """SELECT name, "injectionType", "isPrimary", "interfaceType", "fieldName" FROM INJECTS JOIN JavaClass ON fqn = to_id WHERE from_id IN (SELECT fqn FROM JavaClass WHERE name = 'P8')""", name="P8")
question("many_implementations", f"""SELECT interface, "implCount", implementations FROM (SELECT i.fqn, i.name AS interface, count(*) AS "implCount", {_list('c.name', distinct=False)} AS implementations FROM IMPLEMENTS JOIN JavaClass i ON i.fqn = to_id JOIN JavaClass c ON c.fqn = from_id
WHERE i.kind = 'interface' AND NOT i.isTest GROUP BY 1, 2) WHERE "implCount" BETWEEN 2 AND 9 ORDER BY 2 DESC, 1, fqn LIMIT 15""")
question("type_users", """SELECT name, path FROM REFERENCES_CDT JOIN SailRule ON uuid = from_id WHERE to_id = 'T1' ORDER BY 1, 2 LIMIT 20""", name="T1")
question("top_types", """SELECT name, kind, "fieldCount", n AS "usageCount" FROM CdtType JOIN (SELECT to_id, count(*) AS n FROM REFERENCES_CDT GROUP BY 1) ON to_id = name ORDER BY n DESC, name LIMIT 15""")
question("coupled_modules", """SELECT name, n AS "depCount" FROM (SELECT from_id, count(*) AS n FROM DEPENDS_ON GROUP BY 1) JOIN Module ON gradlePath = from_id ORDER BY n DESC, name LIMIT 10""")
question("critical_modules", """SELECT name, n AS "dependentCount" FROM (SELECT to_id, count(*) AS n FROM DEPENDS_ON GROUP BY 1) JOIN Module ON gradlePath = to_id ORDER BY n DESC, name LIMIT 10""")
question("service_dependencies", """SELECT from_id AS service, to_id AS "dependsOn", "composeFile" FROM SERVICE_DEPENDS_ON JOIN DockerService ON name = from_id""")
question("include_chains", """RECURSIVE WITH r AS (SELECT to_id AS n, [split_part(from_id, '/', -1), split_part(to_id, '/', -1)] AS c, 1 AS d FROM JSP_INCLUDES WHERE from_id IN ('web/p0.jsp', 'web/p1.jsp')
UNION ALL SELECT to_id, list_append(c, split_part(to_id, '/', -1)), d + 1 FROM JSP_INCLUDES JOIN r ON from_id = n WHERE d < 3)
SELECT c[1] AS name, array_to_string(c, '|') AS "includeChain" FROM r""", names=("p0.jsp", "p1.jsp"), k=None)
question("unreferenced_classes", """SELECT name, path, module FROM JavaClass WHERE NOT isTest AND kind = 'class' AND NOT ends_with(name, 'SpringConfig') AND fqn NOT IN
(SELECT to_id FROM IMPORTS UNION SELECT to_id FROM EXTENDS UNION SELECT to_id FROM IMPLEMENTS UNION SELECT to_id FROM INJECTS UNION SELECT to_id FROM CALLS_BUILTIN ) ORDER BY 3, 1, 2 LIMIT 30""")
question("orphaned_rules", """SELECT name, path, "definitionLineCount" FROM SailRule WHERE isSystemOnly AND "definitionLineCount" > 10 AND uuid NOT IN (SELECT to_id FROM CALLS ) ORDER BY 3 DESC, 1, 2 LIMIT 20""")
question("library_closure", """RECURSIVE WITH r AS (SELECT to_id AS n, 1 AS d FROM LIB_DEPENDS_ON WHERE from_id = 'org.lib:l1' UNION SELECT to_id, d + 1 FROM LIB_DEPENDS_ON JOIN r ON from_id = n WHERE d < 3)
SELECT n AS coordinate, CAST(min(d) AS INTEGER) AS depth FROM r GROUP BY 1""", coordinate="org.lib:l1")
question("implementors", """SELECT name, module FROM IMPLEMENTS JOIN JavaClass ON fqn = from_id WHERE to_id = 'acme.P7'""", name="P7")
