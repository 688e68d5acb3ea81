import io
import zipfile

import pytest

from quillgraph import cli
from quillgraph.extract import build, java, libraries, registry
from quillgraph.extract.java_syntax import Reader
from quillgraph.graph import Graph

J = "libs/records/records-java/src/main/java/com/acme/rec/"
FILES = {
    "settings.gradle": "include ':libs:records'\ninclude \":libs:records:records-java\"\ninclude 'nocolon'\n",
    "libs/records/records-java/build.gradle": "dependencies {\n  implementation project(':libs:core')\n  api project(\":libs:core\")\n  // implementation project(':libs:records')\n  weird project(':libs:core')\n  implementation 'com.fasterxml.jackson.core:jackson-databind:2.9.1'\n  implementation \"org.slf4j:slf4j-api\"\n  testImplementation globalDep('junit:junit')\n}\n",
    "libs/core/build.gradle.kts": "implementation(project(\":libs:records:records-java\"))\nimplementation(\"com.fasterxml.jackson.core:jackson-databind:2.10.0\")\n",
    "libs/core/package.json": '{"name": "core-ui", "version": "1.2.0", "dependencies": {"react": "17.0.1", "react-redux": "7.0.0"}, "devDependencies": {"react": "18"}}',
    "libs/broken/package.json": "{nope",
    "gradle/scripts/globalDependencies.groovy": 'dep "junit:junit:4.12!!"\ndep "org.x:y:${ver}"\n',
    "deployment/gradle.lockfile": "# note\norg.slf4j:slf4j-api:1.7.30=runtimeClasspath\norg.lock:only:3=a\n",
    "gradle/libs.versions.toml": '[versions]\na = "1"\n[libraries]\nslf = { module = "org.slf4j:slf4j-api", version.ref = "slf" }\n[plugins]\nx = { module = "no:no", version = "1" }\n',
    "dependency-tree.txt": "runtimeClasspath\n+--- com.fasterxml.jackson.core:jackson-databind:2.10.0\n|    +--- com.fasterxml.jackson.core:jackson-core:2.10.0\n|    \\--- project :libs:core\n|         \\--- a.b:c:1.0 -> 1.1 (*)\n\\--- d.e:f:1 (c)\n",
    J + "Sync.java": "package com.acme.rec;\n/** doc {@link X} */ public interface Sync<T> extends Base, java.io.Serializable { void run(java.util.List<String> xs, int... n) throws Exception; default int k() { return 1; } }\n",
    J + "Base.java": "package com.acme.rec;\ninterface Base { String name(Object o); }",
    J + "SyncImpl.java": 'package com.acme.rec;\nimport com.acme.util.Helper;\nimport org.slf4j.Logger;\nimport static com.acme.util.Helper.*;\n@Service @Primary\npublic class SyncImpl extends Helper.Inner implements Sync<String> {\n  @Autowired @Qualifier("fast") private Base base;\n  public SyncImpl(Helper h) {}\n  SyncImpl() { String s = "class X {"; }\n  @Override public void run(List<String> a, int[] n) { if (isFeatureEnabled("ae.one")) {} new Object() { int z; }; }\n  @Override public String name(Foo f) { return "mail.ftl"; }\n  static class Nested<A extends Comparable<A>> { enum E { P(1) { void q() {} }, Q; void m() {} } record R(int a, String b) { R { } } }\n}\n',
    J + "RecConfig.java": "package com.acme.rec;\nimport com.acme.util.*;\n@Configuration @Import({OtherConfig.class})\nclass RecConfig { @Bean public Sync sync(Base b) { return null; } }",
    J + "OtherConfig.java": "package com.acme.rec;\n@Configuration class OtherConfig {}",
    J + "Rec.java": 'package com.acme.rec;\nimport com.acme.rec.SyncImpl;\n@Entity @Table(name = "record_type") public class Rec { static final String ONE = "ae.one"; public static final Id FN_ID = new Id(Domain.SYS, "queryRec"); }',
    J + "RefreshReaction.java": 'package com.acme.rec;\nclass RefreshReaction extends Helper { static final String REACTION_KEY = "rec.refresh"; boolean b = isFeatureEnabled(Rec.ONE); }',
    "libs/core/src/main/java/com/acme/util/Helper.java": "package com.acme.util;\npublic class Helper { public static class Inner { public String name(Object o) { return null; } } }",
    "libs/core/src/test/java/com/acme/rec/Rec.java": "package com.acme.rec; class Rec {}",
    "libs/app/rules/SYSTEM_SYSRULES_top.xml": "<h xmlns='u:x'><rule><name>top</name><uuid>SYSTEM_SYSRULES_top</uuid><description>d</description><metadataExpr>systemOnly: fn!true()</metadataExpr><definition><![CDATA[a!low(1)\na!low (2) fn!queryRec(3) a!externalReaction(\"rec.refresh\") 'type!{urn:x}Paging' a!isFeatureEnabled(\"ae.two\") a!gone()]]></definition></rule></h>",
    "libs/app/rules/SYSTEM_SYSRULES_low.xml": "<h><rule><name>low</name><uuid>SYSTEM_SYSRULES_low</uuid><definition>a!top() & a!low()</definition></rule></h>",
    "libs/app/rules/SYSTEM_SYSRULES_FOLDER_x.xml": "<h><rule><name>f</name><uuid>f</uuid></rule></h>",
    "infra/feature-toggles.properties": "# c\nae.two = false\nae.three=true=x\nnovalue\n",
    "libs/app/t.xsd": "<x:schema xmlns:x='http://www.w3.org/2001/XMLSchema'><x:complexType name='Paging'><x:annotation><x:appinfo>HIDDEN</x:appinfo></x:annotation><x:sequence><x:element name='a'/><x:element name='b'/></x:sequence></x:complexType><x:simpleType name='Dir'><x:restriction><x:enumeration value='1'/></x:restriction></x:simpleType></x:schema>",
    "libs/app/test/unit/expressions-top.txt": "a!top() a!low() a!nope()",
    "libs/app/msg_en_US.properties": "a=1\n #b=2\n#c=3\n\nd\n",
    "libs/core/ui/app.tsx": "import React from 'react';\nimport { Button, Other as O } from './widgets/Button';\nimport './app.less';\nimport Page from '/libs/core/ui/pages';\nexport const A = () => <Button><Page/></Button>;",
    "libs/core/ui/widgets/Button.ts": "export const x = 1", "libs/core/ui/app.less": "", "libs/core/ui/pages/index.tsx": "", "libs/core/ui/app.test.tsx": "",
    "server/exec/a.k": "\\l b.k\n\\l sub/c\n.a.s.l[\"d\"]\nf:{x}\n g:{y}\nh:{[z] z}", "server/exec/b.k": ".a.s.ld[\"./\";\"a.k\"]", "server/exec/sub/c": "", "server/exec/d.k": ".a.s.l`b",
    "db/changelog/one.yaml": "databaseChangeLog:\n- changeSet:\n    id: 7\n    changes:\n    - createTable: {tableName: record_type}\n    - addForeignKeyConstraint: {baseTableName: child, referencedTableName: record_type, constraintName: fk1, baseColumnNames: r, referencedColumnNames: id}\n- changeSet:\n    addForeignKeyConstraint: {baseTableName: child2, referencedTableName: record_type}\n",
    "deployment/web.war/main.jsp": '<%@ include file="/inc/head.jsp" %><jsp:include page="inc/../foot.jsp"/>', "deployment/web.war/inc/head.jsp": '<%@include file="../foot.jsp"%>', "deployment/web.war/foot.jsp": "",
    "docker-compose.yml": "services:\n  web: {image: w, depends_on: [db, gone]}\n  db: {image: p}\n  job:\n    depends_on:\n      db: {condition: x}\n", "sub/docker-compose.yml": "services: {no: {}}",
    ".github/CODEOWNERS": "# x\n/libs/records/ @acme/data-fabric @solo\n**/core @acme/core\nlibs/* notateam\n",
    "api-specs/v1.yaml": "paths:\n  /a:\n    get: {operationId: getA}\n    post: {}\n    x-foo: {}\n",
    ".gitlab-ci.yml": "stages: [a]\n.hidden: {script: [x]}\nbuild:\n  script: [x]\n  rules:\n  - changes: ['libs/core/**/*']\n  - changes: {paths: [libs/records/records-java/x]}\nold: {only: {changes: [libs/nope/**]}}\nnothing: {stage: a}\n",
    "libs/core/src/main/resources/mail.ftl": "${a} ${b} ${a}",
    "deployment/web.war/WEB-INF/web.xml": "<!DOCTYPE web-app SYSTEM 'x.dtd'><web-app xmlns='u'><servlet><servlet-name>s</servlet-name><servlet-class>com.acme.rec.Rec</servlet-class></servlet><servlet-mapping><servlet-name>s</servlet-name><url-pattern>/a</url-pattern></servlet-mapping><servlet-mapping><servlet-name>s</servlet-name><url-pattern>/b</url-pattern></servlet-mapping></web-app>",
    "deployment/web.war/WEB-INF/x.tld": "<taglib><tag><tag-class>com.acme.util.Helper</tag-class></tag></taglib>",
    "deployment/my-uri-templates.xml": "<t><template/><x pattern='p'/></t>",
    "libs/core/src/test/groovy/SyncImplSpec.groovy": "import com.acme.rec.Rec\nimport org.junit.Test\nclass S extends Specification {}",
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string").coalesce(2).cache()
    graph, summary = registry.run(spark, files)
    assert [(r.extractor, r.error) for r in summary.where("status <> 'success'").collect()] == []
    path = str(tmp_path_factory.mktemp("graph"))
    graph.write(path)
    stored = type(graph).read(spark, path)
    assert set(stored.frames) == set(graph.frames)
    return stored, files


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_modules(built):
    g = built[0]
    assert rows(g.nodes("Module"), "gradlePath", "path", "language") == [(":libs:core", "libs/core", "typescript"), (":libs:records", "libs/records", "mixed"), (":libs:records:records-java", "libs/records/records-java", "java")]
    assert rows(g.nodes("DEPENDS_ON"), "from_id", "to_id", "config", "sourceLine") == [(":libs:core", ":libs:records:records-java", "implementation", 1), (":libs:records:records-java", ":libs:core", "api", 3), (":libs:records:records-java", ":libs:core", "implementation", 2)]
    assert rows(g.query("circular_modules"), "a", "b") == [("core", "records-java")] * 2
    assert rows(g.query("coupled_modules"), "name", "depCount") == [("core", 1), ("records-java", 2)]
    assert rows(g.query("critical_modules"), "name", "dependentCount") == [("core", 2), ("records-java", 1)]


def test_libraries(built):
    g = built[0]
    got = {r.coordinate: (r.latestVersion, r.catalogAlias) for r in g.nodes("ExternalLibrary").collect()}
    assert got == {
        "com.fasterxml.jackson.core:jackson-databind": ("2.10.0", ""), "org.slf4j:slf4j-api": ("", "slf"), "junit:junit": ("4.12", ""), "org.x:y": ("managed", ""), "org.lock:only": ("3", ""),
        "com.fasterxml.jackson.core:jackson-core": ("2.10.0", ""), "a.b:c": ("1.1", ""),
    }
    assert rows(g.nodes("LIB_DEPENDS_ON"), "from_id", "to_id") == [("com.fasterxml.jackson.core:jackson-databind", "a.b:c"), ("com.fasterxml.jackson.core:jackson-databind", "com.fasterxml.jackson.core:jackson-core")]
    assert ("junit:junit", "testImplementation", "4.12") in rows(g.nodes("DEPENDS_ON_LIB"), "to_id", "config", "version")
    assert rows(g.query("library_closure", coordinate="com.fasterxml.jackson.core:jackson-databind"), "coordinate", "depth") == [("a.b:c", 1), ("com.fasterxml.jackson.core:jackson-core", 1)]


def test_npm(built):
    g = built[0]
    assert rows(g.nodes("NpmPackage"), "name", "version", "isWorkspace") == [("core-ui", "1.2.0", True), ("react", "17.0.1", False), ("react-redux", "7.0.0", False)]
    assert rows(g.nodes("NPM_DEPENDS_ON"), "from_id", "to_id", "depType") == [("core-ui", "react", "dependency"), ("core-ui", "react-redux", "dependency")]
    assert rows(g.nodes("USES_NPM"), "from_id", "to_id") == [(":libs:core", "react"), (":libs:core", "react-redux")]
    assert rows(g.query("package_users"), "module", "version") == [("core-ui", "1.2.0")]
    assert rows(g.query("package_family"), "library", "usedBy") == [("react-redux", "core-ui")]


def test_java(built):
    g = built[0]
    p = "com.acme.rec."
    kinds = {r.fqn: (r.kind, r.isTest, r.module) for r in g.nodes("JavaClass").collect()}
    assert kinds[p + "Rec"] == ("class", False, ":libs:records:records-java") and kinds[p + "SyncImpl.Nested.E"][0] == "enum" and kinds[p + "SyncImpl.Nested.R"][0] == "record" and len(kinds) == 12
    assert rows(g.nodes("EXTENDS"), "from_id", "to_id") == [(p + "Sync", p + "Base"), (p + "SyncImpl", "com.acme.util.Helper.Inner")]
    assert rows(g.nodes("IMPLEMENTS"), "from_id", "to_id") == [(p + "SyncImpl", p + "Sync")]
    assert rows(g.nodes("SPRING_IMPORTS"), "from_id", "to_id") == [(p + "RecConfig", p + "OtherConfig")]
    assert (p + "SyncImpl", "com.acme.util.Helper") in rows(g.nodes("IMPORTS"), "from_id", "to_id") and (p + "Rec", p + "SyncImpl") in rows(g.nodes("IMPORTS"), "from_id", "to_id")
    methods = {r.id: r for r in g.nodes("Method").collect()}
    assert p + "Sync#run(List,int[])" in methods and methods[p + "Sync#run(List,int[])"].isAbstract and not methods[p + "Sync#k()"].isAbstract
    assert methods[p + "SyncImpl#SyncImpl(Helper)"].isConstructor and methods[p + "SyncImpl.Nested.R#R()"].isConstructor and p + "SyncImpl.Nested.E#m()" in methods
    assert rows(g.nodes("OVERLOADS"), "from_id", "to_id") == [(p + "SyncImpl#SyncImpl()", p + "SyncImpl#SyncImpl(Helper)")]
    assert rows(g.nodes("OVERRIDES"), "from_id", "to_id", "matchKind", "annotated") == [(p + "SyncImpl#name(Foo)", "com.acme.util.Helper.Inner#name(Object)", "arity", True), (p + "SyncImpl#run(List,int[])", p + "Sync#run(List,int[])", "signature", True)]
    assert rows(g.nodes("Entity"), "fqn", "tableName") == [(p + "Rec", "record_type")]
    assert rows(g.nodes("INJECTS"), "from_id", "to_id", "fieldName", "injectionType", "qualifier") == [(p + "RecConfig", p + "Base", "b", "bean_method_param", ""), (p + "SyncImpl", p + "Base", "base", "field", "fast"), (p + "SyncImpl", "com.acme.util.Helper", "h", "constructor", "")]
    assert rows(g.nodes("PRODUCES"), "from_id", "to_id", "methodName") == [(p + "RecConfig", p + "Sync", "sync")]
    assert rows(g.query("class_impact", name="Base"), "name") == [("Rec",), ("RecConfig",), ("Sync",), ("SyncImpl",)]
    assert rows(g.query("config_impact", name="RecConfig"), "imports", "produces", "importedBy") == [(["OtherConfig"], ["Sync"], [])]
    assert rows(g.query("implementors", name="Sync"), "name") == [("SyncImpl",)]
    assert ("RecConfig",) in rows(g.query("unreferenced_classes"), "name") and ("OtherConfig",) in rows(g.query("unreferenced_classes"), "name")
    assert g.constraint_violations().count() == 0


def test_rules(built):
    g = built[0]
    s = "SYSTEM_SYSRULES_"
    assert rows(g.nodes("SailRule"), "name", "isSystemOnly", "definitionLineCount", "_fnCalls") == [("low", False, 1, []), ("top", True, 2, ["queryRec"])]
    assert rows(g.nodes("CALLS"), "from_id", "to_id") == [(s + "low", s + "top"), (s + "top", s + "low")]
    assert rows(g.query("rule_impact", name="low"), "name") == [("low",), ("top",)]
    assert rows(g.query("function_class", function="queryRec"), "fqn") == [("com.acme.rec.Rec",)]
    assert rows(g.query("reaction_handler", key="rec.refresh"), "sailCaller", "javaHandler") == [("top", "RefreshReaction")]
    assert rows(g.nodes("FeatureToggle"), "name", "defaultValue") == [("ae.one", ""), ("ae.three", "true=x"), ("ae.two", "false")]
    assert rows(g.nodes("GATES_JavaClass"), "from_id", "to_id") == [("ae.one", "com.acme.rec.RefreshReaction"), ("ae.one", "com.acme.rec.SyncImpl")]
    assert rows(g.nodes("GATES_SailRule"), "from_id", "to_id") == [("ae.two", s + "top")] and rows(g.nodes("DEFINED_IN"), "from_id", "to_id", "constantName") == [("ae.one", "com.acme.rec.Rec", "ONE")]
    assert rows(g.query("top_toggles"), "name", "gatedCount") == [("ae.one", 2), ("ae.two", 1)] and rows(g.query("toggle_scope", name="ae.two"), "type", "name") == [("SailRule", "top")]
    assert rows(g.nodes("CdtType"), "name", "kind", "fieldCount", "isHidden") == [("Dir", "simpleType", 1, False), ("Paging", "complexType", 2, True)]
    assert rows(g.query("type_users", name="Paging"), "name") == [("top",)] and rows(g.query("top_types"), "name", "usageCount") == [("Paging", 1)]
    assert rows(g.nodes("TESTS_RULE"), "to_id", "relationship") == [(s + "low", "references"), (s + "top", "primary")] and rows(g.nodes("ExpressionTest"), "testType") == [("unit",)]
    assert rows(g.query("rule_tests", name="top"), "testType") == [("unit",)] and g.query("untested_rules").count() == 0 and g.query("orphaned_rules", least_lines=0).count() == 0
    assert rows(g.nodes("ResourceBundle"), "name", "keyCount") == [("msg_en_US", 2)]


def test_scripts(built):
    g = built[0]
    u = "libs/core/ui/"
    assert rows(g.nodes("TS_IMPORTS"), "from_id", "to_id", "importedName") == [(u + "app.tsx", u + "pages/index.tsx", "Page"), (u + "app.tsx", u + "widgets/Button.ts", "Button")]
    assert rows(g.nodes("CSS_IMPORTS"), "to_id") == [(u + "app.less",)] and rows(g.nodes("RENDERS"), "componentName") == [("Button",), ("Page",)]
    assert (u + "app.tsx", True, False, "tsx") in rows(g.nodes("TsFile"), "path", "isComponent", "isTest", "language") and (u + "app.test.tsx", True) in rows(g.nodes("TsFile"), "path", "isTest")
    k = "server/exec/"
    assert rows(g.nodes("LOADS"), "from_id", "to_id", "loadedName") == [(k + "a.k", k + "b.k", "b.k"), (k + "a.k", k + "d.k", "d"), (k + "b.k", k + "a.k", "./a.k"), (k + "d.k", k + "b.k", "b")]
    assert rows(g.nodes("KFile"), "name", "engine", "functionCount")[0] == ("a.k", "exec", 2)
    assert (":libs:core", u + "app.tsx") in rows(g.nodes("CONTAINS_TsFile"), "from_id", "to_id")


def test_web(built):
    g = built[0]
    assert rows(g.nodes("Table"), "name", "migrationId") == [("child", ""), ("child2", ""), ("record_type", "7")]
    assert rows(g.nodes("FK_TO"), "from_id", "constraintName") == [("child", "fk1"), ("child2", "")] and rows(g.nodes("MAPS_TO"), "from_id", "to_id") == [("com.acme.rec.Rec", "record_type")]
    assert rows(g.query("table_impact", name="record_type"), "childTables", "entities", "topConsumers") == [(["child", "child2"], ["Rec"], [])]
    w = "deployment/web.war/"
    assert rows(g.nodes("JSP_INCLUDES"), "from_id", "to_id") == [(w + "inc/head.jsp", w + "foot.jsp"), (w + "main.jsp", w + "foot.jsp"), (w + "main.jsp", w + "inc/head.jsp")]
    assert [r.includeChain for r in g.query("include_chains").collect()] == [["main.jsp", "foot.jsp"], ["main.jsp", "head.jsp"], ["main.jsp", "head.jsp", "foot.jsp"]]
    assert rows(g.query("service_dependencies"), "service", "dependsOn") == [("job", "db"), ("web", "db")]
    assert rows(g.nodes("OWNS"), "from_id", "to_id") == [("@acme/core", ":libs:core"), ("@acme/data-fabric", ":libs:records"), ("@acme/data-fabric", ":libs:records:records-java"), ("@solo", ":libs:records"), ("@solo", ":libs:records:records-java")]
    assert rows(g.query("team_modules", word="data-fabric"), "module") == [("records",), ("records-java",)]
    assert rows(g.query("class_owner", name="Rec"), "module", "team") == [("records-java", "data-fabric"), ("records-java", "solo")]
    assert rows(g.nodes("ApiEndpoint"), "path", "operationId") == [("GET /a", "getA"), ("POST /a", "")]
    assert rows(g.nodes("CiPipeline"), "name") == [("build",), ("old",)] and rows(g.nodes("CI_TRIGGERED_BY"), "from_id", "to_id") == [("build", ":libs:core"), ("build", ":libs:records"), ("build", ":libs:records:records-java")]
    assert rows(g.nodes("USES_TEMPLATE"), "from_id") == [("com.acme.rec.SyncImpl",)] and rows(g.nodes("FtlTemplate"), "variables") == [(["a", "b"],)]
    classes = {r.fqn: r for r in g.nodes("JavaClass").collect()}
    assert classes["com.acme.rec.Rec"].servletUrlPatterns == ["/a", "/b"] and classes["com.acme.util.Helper"].isTldTag and rows(g.nodes("UriTemplates"), "n_templates") == [(2,)]
    assert rows(g.nodes("TESTS_CLASS"), "to_id") == [("com.acme.rec.Rec",), ("com.acme.rec.SyncImpl",)] and rows(g.query("class_tests", name="SyncImpl"), "testFramework") == [("spock",)]
    assert rows(g.query("rule_to_tables", name="top"), "dbTable") == []


def test_library_usage(spark, built):
    g, files = built
    jar = io.BytesIO()
    with zipfile.ZipFile(jar, "w") as z:
        for n in ("org/slf4j/Logger.class", "META-INF/versions/9/org/slf4j/spi/X.class", "bad-dir/Y.class", "readme.txt"):
            z.writestr(n, "")
    archives = spark.createDataFrame([("a.jar", bytearray(jar.getvalue())), ("b.jar", bytearray(b"no zip"))], "path string, content binary")
    packages = java.archive_packages(archives)
    assert rows(packages, "package") == [("org.slf4j",), ("org.slf4j.spi",)]
    claims = spark.createDataFrame([("org.slf4j", "org.slf4j:slf4j-api"), ("org.slf4j", "a.fat:jar"), ("x", "l:ong"), ("x", "k:s")], "package string, coordinate string")
    owners = java.package_owners(claims, spark.createDataFrame([("l:ong",)], "coordinate string"))
    assert rows(owners, "package", "coordinate") == [("org.slf4j", "org.slf4j:slf4j-api"), ("x", "l:ong")]
    manual = spark.createDataFrame([("com.acme", "m:m"), ("com.acme.ut", "z:z")], "prefix string, coordinate string")
    used = java.library_usage(files, g.frames, owners, manual)
    assert rows(used["USES_LIBRARY_Module"], "from_id", "to_id") == [(":libs:records:records-java", "org.slf4j:slf4j-api")]
    assert {r.coordinate: r.moduleUsageCount for r in used["ExternalLibrary"].collect()}["org.slf4j:slf4j-api"] == 1
    jars = spark.createDataFrame([("g", "a", v, f"g/a-{v}{s}.jar") for v, s in (("1.9", ""), ("1.10", ""), ("1.10", "-sources"), ("2.0-rc1", ""), ("2.0", "-all"), ("2.0", ""))], "group string, artifact string, version string, path string")
    none = spark.createDataFrame([], "group string, artifact string, version string")
    assert rows(java.ranked_archives(jars, none), "path") == [("g/a-2.0.jar",)] and rows(java.ranked_archives(jars, spark.createDataFrame([("g", "a", "1.9")], none.schema)), "path") == [("g/a-1.9.jar",)]


def test_full_build_has_library_usage(spark, tmp_path):
    def jar(group, artifact, version, *names):
        path = tmp_path / "gradle/caches/modules-2/files-2.1" / group / artifact / version / "hash" / f"{artifact}-{version}.jar"
        path.parent.mkdir(parents=True)
        with zipfile.ZipFile(path, "w") as z:
            for n in names:
                z.writestr(n, "")

    jar("org.slf4j", "slf4j-api", "1.0", "org/slf4j/Logger.class", "org/slf4j/old/X.class")
    jar("org.slf4j", "slf4j-api", "9.0", "org/slf4j/Logger.class")
    jar("a.fat", "jar", "1", "org/slf4j/Logger.class")
    root, out = tmp_path / "root", str(tmp_path / "out")
    for name, content in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    caches = str(tmp_path / "gradle/caches/modules-2/files-2.1")
    for _ in range(2):
        assert cli.main(["build", "--root", str(root), "--out", out, "--archives", caches, "--only", "gradle", "java", "external_libs", "lib_usage"], spark) == 0
    g = Graph.read(spark, out)
    assert rows(g.nodes("USES_LIBRARY_Module"), "from_id", "to_id") == [(":libs:records:records-java", "org.slf4j:slf4j-api")]
    impact = g.query("library_impact", coordinate="org.slf4j:slf4j-api").first()
    assert impact.classesAffected > 0 and impact.modulesAffected == 1
    assert "lib_usage" in registry.REGISTRY
    known = spark.createDataFrame([("org.slf4j:slf4j-api", "9.0"), ("b.c:d", "managed"), ("b:e", "2")], "coordinate string, latestVersion string")
    claims = spark.createDataFrame([("org.slf4j:slf4j-api", "1.0", "org.slf4j.old"), ("b.c:d", "1.9", "b.c"), ("b.c:d", "1.10", "b.x"), ("b:e", "2", "b.c"), ("b:e", "1", "b.x"), ("no:lib", "1", "n")], "coordinate string, version string, package string")
    assert rows(libraries.owners(claims, known), "package", "coordinate") == [("b.c", "b:e"), ("b.x", "b.c:d"), ("org.slf4j.old", "org.slf4j:slf4j-api")]


def test_graph_storage(spark, built, tmp_path):
    g, files = built
    stats = {(r.kind, r.name): r.n for r in g.stats().collect()}
    assert stats[("node", "SailRule")] == 2 and stats[("node", None)] == sum(n for (k, name), n in stats.items() if k == "node" and name)
    small = type(g)(spark, {k: g.frames[k] for k in ("Module", "DEPENDS_ON")})
    small.write(str(tmp_path / "g"))
    more = spark.createDataFrame([(":libs:core", "renamed", "libs/core", "k"), (":new", "new", "new", "k")], "gradlePath string, name string, path string, language string")
    type(g)(spark, {"Module": more}).write(str(tmp_path / "g"), "append")
    back = type(g).read(spark, str(tmp_path / "g"))
    assert rows(back.nodes("Module"), "name") == [("new",), ("records",), ("records-java",), ("renamed",)] and back.nodes("DEPENDS_ON").count() == 3
    assert g.broken_paths(files).first().asDict()["valid"] > 20
    g.views()
    assert spark.sql("SELECT count(*) AS n FROM edges WHERE rel = 'CALLS'").first().n == 2 and "uuid" in g.schema()["SailRule"]


def test_reader_on_odd_sources():
    for src in ("", "class", "class A {", "package a; class A { void m( }", "@interface X { int v() default 1; }", "class A<T extends B<C<D>>> { T[] f(T... x)[] {} int a = 1, b[] = {1}; { } static { } }", 'class A { String s = """\n class B { """; char c = \'{\'; }'):
        Reader(src)
    r = Reader("class A { A a() { return new A() { void hidden() {} }; } sealed interface S permits T {} non-sealed class T implements S {} }")
    assert [c["fqn"] for c in r.classes] == ["A", "A.S", "A.T"] and [m["id"] for m in r.methods] == ["A#a()"]


def test_contained_takes_the_longest_module(spark):
    modules = spark.createDataFrame([("a", ":a"), ("a/b", ":a:b"), ("a/bb", ":a:bb")], "path string, gradlePath string")
    nodes = spark.createDataFrame([("a/b/c.x",), ("a/z",), ("q/z",), ("a/bc/d",)], "path string")
    assert rows(build.contained(nodes, modules), "from_id", "to_id") == [(":a", "a/bc/d"), (":a", "a/z"), (":a:b", "a/b/c.x")]
