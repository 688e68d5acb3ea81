"""Java classes, methods, injection and library use: parsed per file, resolved by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import merge, resolve, traverse
from quillgraph.session import ship
from quillgraph.sources import corpus as C

# Public types of java.lang, which every file sees: interfaces, classes, exceptions, errors, annotations.
JAVA_LANG = tuple(
    "Appendable AutoCloseable CharSequence Cloneable Comparable Iterable Readable Runnable "
    "Boolean Byte Character Class ClassLoader ClassValue Double Enum Float InheritableThreadLocal Integer Long Math Module ModuleLayer Number Object Package Process ProcessBuilder ProcessHandle Record Runtime RuntimePermission "
    "ScopedValue Short StackTraceElement StackWalker StrictMath String StringBuffer StringBuilder System Thread ThreadGroup ThreadLocal Throwable Void "
    "ArithmeticException ArrayIndexOutOfBoundsException ArrayStoreException ClassCastException ClassNotFoundException CloneNotSupportedException EnumConstantNotPresentException Exception IllegalArgumentException "
    "IllegalCallerException IllegalMonitorStateException IllegalStateException IllegalThreadStateException IndexOutOfBoundsException InstantiationException InterruptedException LayerInstantiationException MatchException "
    "NegativeArraySizeException NoSuchFieldException NoSuchMethodException NullPointerException NumberFormatException ReflectiveOperationException RuntimeException SecurityException StringIndexOutOfBoundsException "
    "TypeNotPresentException UnsupportedOperationException WrongThreadException "
    "AbstractMethodError AssertionError BootstrapMethodError ClassCircularityError ClassFormatError Error ExceptionInInitializerError IllegalAccessError IncompatibleClassChangeError InstantiationError InternalError LinkageError "
    "NoClassDefFoundError NoSuchFieldError NoSuchMethodError OutOfMemoryError StackOverflowError ThreadDeath UnknownError UnsatisfiedLinkError UnsupportedClassVersionError VerifyError VirtualMachineError "
    "Deprecated FunctionalInterface Override SafeVarargs SuppressWarnings IllegalAccessException".split()
)
_NOTE = "array<struct<name:string,value:string>>"
UNIT = f"""struct<package:string,imports:array<string>,statics:array<string>,wildcards:array<string>,
classes:array<struct<fqn:string,name:string,kind:string,isAbstract:boolean,isFinal:boolean,isNested:boolean,isStatic:boolean,enclosingFqn:string,isSpringConfig:boolean,package:string,lineNumber:int,annotations:array<string>,tableName:string>>,
methods:array<struct<id:string,name:string,ownerFqn:string,signature:string,arity:int,returnType:string,isAbstract:boolean,isStatic:boolean,isConstructor:boolean,visibility:string,hasOverrideAnnotation:boolean,lineNumber:int,annotations:{_NOTE},rawReturn:string,params:array<struct<name:string,raw:string,erased:string,qualifier:string>>,ownerAnnotations:array<string>>>,
refs:array<struct<from_id:string,kind:string,raw:string,enclosing:string>>,
fields:array<struct<ownerFqn:string,name:string,raw:string,annotations:{_NOTE}>>>"""


def units(files: DataFrame) -> DataFrame:
    """path, isTest and unit (see UNIT) of every Java source."""

    def parse(batches):
        import json

        import pandas as pd

        from quillgraph.extract.java_syntax import Reader

        for batch in batches:
            out = []
            for content in batch["content"]:
                r = Reader(content or "")
                out.append(json.dumps({"package": r.package, "imports": r.imports, "statics": r.statics, "wildcards": r.wildcards, "classes": r.classes, "methods": r.methods, "refs": r.refs, "fields": r.fields}))
            yield pd.DataFrame({"path": batch["path"], "json": out})

    ship(files.sparkSession)
    parsed = C.java_files(files).select("path", "content").mapInPandas(parse, "path string, json string")
    test = F.concat(F.lit("/"), "path").rlike(r"/src/(?:test|integrationTest|unitTest|systemTest|sharedTest|testFixtures)[^/]*/")
    return parsed.select("path", test.alias("isTest"), F.from_json("json", UNIT).alias("unit"))


def _classes(parsed: DataFrame) -> DataFrame:
    """One row a class; of one name the one outside tests, with the shortest, then least path."""
    flat = parsed.select("path", "isTest", F.explode("unit.classes").alias("c")).select("c.*", "path", "isTest")
    return resolve.elect(flat, "fqn", F.col("isTest"), F.length("path"), F.col("path"))


def references(parsed: DataFrame, classes: DataFrame) -> DataFrame:
    """kind, from_id, to_id, sourceFile of supertype references, by Java's order of scopes.

    Every rule proposes names with its rank, and the first that is a known class is taken;
    the ranks follow the language: full name, same file, nested, single import, scoped by
    an import, static import, same package, wildcard import.
    """
    c = F.col
    u = parsed.select("path", "unit", F.explode("unit.refs").alias("r"))
    raw, simple, head = c("r.raw"), F.substring_index("r.raw", ".", -1), F.substring_index("r.raw", ".", 1)
    scoped = raw.contains(".")
    rest = F.substring(raw, F.length(head) + 1, F.lit(1 << 16))
    ends = lambda arr, name: F.filter(arr, lambda i: i.endswith(F.concat(F.lit("."), name)) | (i == name))
    local = F.filter("unit.classes", lambda k: (k["fqn"] == F.concat_ws(".", "unit.package", raw)) | (k["name"] == raw) | k["fqn"].endswith(F.concat(F.lit("."), raw)))
    local_head = F.filter("unit.classes", lambda k: scoped & (k["name"] == head))
    name = lambda arr: F.transform(arr, lambda k: k["fqn"])
    single = ends(c("unit.imports"), simple)
    single = F.filter(single, lambda i: ~scoped | i.endswith(F.concat(F.lit("."), raw)))
    rules = [
        F.when(scoped, F.array(raw)),
        F.slice(name(local), 1, 1),
        F.transform(F.slice(name(local_head), 1, 1), lambda k: F.concat(k, rest)),
        F.when(c("r.enclosing") != "", F.array(F.concat_ws(".", "r.enclosing", raw))),
        F.array(F.concat_ws(".", "r.from_id", raw)),
        F.slice(single, 1, 1),
        F.when(scoped, F.transform(F.slice(ends(c("unit.imports"), head), 1, 1), lambda i: F.concat(i, rest))),
        F.filter(F.transform("unit.statics", lambda i: F.regexp_replace(i, r"\.[^.]+$", "")), lambda i: F.substring_index(i, ".", -1) == simple),
        F.when(c("unit.package") != "", F.array(F.concat_ws(".", "unit.package", raw))),
        F.transform("unit.wildcards", lambda w: F.concat_ws(".", w, raw)),
    ]
    ranked = lambda rank: lambda x: F.struct(F.lit(rank).alias("rank"), x.alias("to_id"))
    proposed = F.flatten(F.array(*[F.transform(F.coalesce(r, F.array().cast("array<string>")), ranked(k)) for k, r in enumerate(rules)]))
    usable = ~(~scoped & (raw.isin(list(JAVA_LANG)) | T.is_type_variable(raw)))
    tried = u.where(usable).select("path", c("r.from_id").alias("from_id"), c("r.kind").alias("kind"), raw.alias("raw"), F.explode(proposed).alias("p")).select("path", "from_id", "kind", "raw", c("p.rank").alias("rank"), c("p.to_id").alias("to_id"))
    return resolve.best_candidate(tried, ["path", "from_id", "kind", "raw"], "to_id", "rank", classes, "fqn").select("kind", "from_id", "to_id", c("path").alias("sourceFile"))


def overrides(methods: DataFrame, direct: DataFrame) -> DataFrame:
    """from_id, to_id, matchKind, annotated: the nearest supertype's method of the same name.

    Nearest first, siblings by name; within a supertype the same signature goes before the
    same number of parameters, then the least id. Methods are written once, and nothing that
    grows with them is sent through the driver.
    """
    c = F.col
    methods = traverse.kept(methods.where("NOT isConstructor").select("id", "name", "ownerFqn", "signature", "arity", "isStatic", "hasOverrideAnnotation"))
    mine = methods.where("NOT isStatic").drop("isStatic")
    theirs = methods.select(c("ownerFqn").alias("upper"), "name", "arity", c("signature").alias("s"), c("id").alias("to_id"))
    asked = mine.select(c("ownerFqn").alias("start"), "name", "arity").distinct()
    above = traverse.nearest_with(asked, theirs.withColumnRenamed("upper", "node"), direct, ["name", "arity"])
    # one supertype a name: a path ends with its node, so depth and path tell nodes apart
    above = above.groupBy(c("start").alias("ownerFqn"), "name", "arity").agg(F.min(F.struct("depth", "bfs", "node"))["node"].alias("upper"))
    met = mine.join(above.hint("merge"), ["ownerFqn", "name", "arity"]).join(theirs.hint("merge"), ["upper", "name", "arity"]).withColumn("rank", F.when(c("s") == c("signature"), 0).otherwise(1))
    best = resolve.elect(met, "id", c("rank"), c("to_id"))
    return best.select(c("id").alias("from_id"), "to_id", F.when(c("rank") == 0, "signature").otherwise("arity").alias("matchKind"), c("hasOverrideAnnotation").alias("annotated"))


def supertypes(graph: dict[str, DataFrame]) -> DataFrame:
    """src, dst: what a class extends or implements itself."""
    return graph["EXTENDS"].union(graph["IMPLEMENTS"]).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).distinct()


def java(files: DataFrame, graph: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """JavaClass (entities carry tableName), Package, Method and all edges among them."""
    out = declarations(files, graph)
    return out | {"OVERRIDES": overrides(out["Method"], supertypes(out))}


def declarations(files: DataFrame, graph: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """java() without OVERRIDES, whose search upwards runs at once; this runs when it is asked for."""
    c = F.col
    parsed = units(files).cache()
    classes = _classes(parsed)
    owned = classes
    if "Module" in graph:
        owner = resolve.longest_prefix(classes.select("fqn", "path"), "path", graph["Module"], "path", "gradlePath").select("fqn", c("owner").alias("module"))
        owned = classes.join(owner, "fqn", "left")
    nodes = owned.withColumn("module", F.coalesce("module", F.lit(""))) if "module" in owned.columns else owned.withColumn("module", F.lit(""))
    known = classes.select("fqn", "path")
    refs = references(parsed, classes).cache()
    out = {"JavaClass": nodes, "Entity": nodes.where("tableName IS NOT NULL")}
    for kind in ("EXTENDS", "IMPLEMENTS", "SPRING_IMPORTS"):
        out[kind] = merge.valid_edges(refs.where(c("kind") == kind).select("from_id", "to_id", "sourceFile"), known, "fqn")
    imports = parsed.select("path", F.explode("unit.classes.fqn").alias("from_id"), "unit.imports").select("from_id", F.explode("imports").alias("to_id"), c("path").alias("sourceFile"))
    out["IMPORTS"] = merge.valid_edges(imports, known, "fqn")
    methods = parsed.select("path", F.explode("unit.methods").alias("m")).select("m.*", "path")
    methods = resolve.elect(methods.join(known.withColumnRenamed("fqn", "ownerFqn").hint("merge"), ["ownerFqn", "path"], "left_semi"), "id", c("lineNumber")).drop("annotations", "params", "rawReturn", "ownerAnnotations")
    out["Method"] = methods
    out["DECLARES"] = methods.select(c("ownerFqn").alias("from_id"), c("id").alias("to_id"))
    pairs = resolve.ordered_pairs(methods.select("id", "name", "ownerFqn", "isConstructor", "arity", "signature"), ["ownerFqn", "name", "isConstructor"], "arity", "signature")
    out["OVERLOADS"] = pairs.select(c("first.id").alias("from_id"), c("second.id").alias("to_id"), "ownerFqn")
    packages = classes.where("package <> ''").select(c("package").alias("name")).distinct()
    out["Package"] = packages.withColumn("path", F.replace("name", F.lit("."), F.lit("/")))
    out["CONTAINS_JavaClass"] = classes.where("package <> ''").select(c("package").alias("from_id"), c("fqn").alias("to_id"))
    up = packages.select(T.parent_name(c("name")).alias("from_id"), c("name").alias("to_id")).where("from_id IS NOT NULL")
    out["CONTAINS_Package"] = up.join(packages.select(c("name").alias("from_id")), "from_id", "left_semi")
    out["CONTAINS_Module_Package"] = nodes.where("module <> '' AND package <> ''").select(c("module").alias("from_id"), c("package").alias("to_id")).distinct()
    return out


def _simple_type(raw: str, unit: str = "unit"):
    """A type name by single imports, else in the same package."""
    hit = F.get(F.filter(f"{unit}.imports", lambda i: i.endswith(F.concat(F.lit("."), F.col(raw)))), F.lit(0))
    return F.coalesce(hit, F.when(F.col(f"{unit}.package") != "", F.concat_ws(".", f"{unit}.package", raw)).otherwise(F.col(raw)))


def spring(files: DataFrame, graph: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """INJECTS and PRODUCES. A known target stands for all its implementations, else for itself."""
    c = F.col
    marks = r"@(?:Autowired|Inject|Bean|Configuration|Component|Service|Repository|Controller|Primary|Qualifier)\b"
    parsed = units(files.where(c("content").rlike(marks)))
    note = lambda arr, n: F.exists(arr, lambda a: a["name"] == n)
    value = lambda arr, n: F.get(F.filter(arr, lambda a: a["name"] == n), F.lit(0))["value"]
    fields = parsed.select("path", "unit", F.explode("unit.fields").alias("f")).where(note("f.annotations", "Autowired") | note("f.annotations", "Inject"))
    fields = fields.select(c("f.ownerFqn").alias("from_id"), _simple_type("f.raw").alias("target"), c("f.name").alias("fieldName"), F.lit("field").alias("injectionType"), value("f.annotations", "Qualifier").alias("qualifier"), c("path").alias("sourceFile"))
    m = parsed.select("path", "unit", F.explode("unit.methods").alias("m"))
    managed = F.arrays_overlap("m.ownerAnnotations", F.array(*map(F.lit, ("Configuration", "Component", "Service", "Repository", "Controller"))))
    from_params = lambda df, kind: df.select("path", "unit", c("m.ownerFqn").alias("from_id"), F.explode("m.params").alias("p")).where(~c("p.raw").rlike("^(?:int|long|short|byte|char|float|double|boolean)$")).select("from_id", _simple_type("p.raw").alias("target"), c("p.name").alias("fieldName"), F.lit(kind).alias("injectionType"), c("p.qualifier").alias("qualifier"), c("path").alias("sourceFile"))
    beans = m.where(note("m.annotations", "Bean") & ~c("m.isConstructor"))
    points = fields.union(from_params(m.where(c("m.isConstructor") & managed), "constructor")).union(from_params(beans, "bean_method_param"))
    classes = graph["JavaClass"].select("fqn", "annotations")
    primary = classes.where(F.array_contains("annotations", "Primary")).select(c("fqn").alias("to_id"), F.lit(True).alias("p"))
    implementations = graph["IMPLEMENTS"].select(c("to_id").alias("target"), c("from_id").alias("impl"))
    known = points.join(classes.select(c("fqn").alias("target")), "target", "left_semi")
    edges = known.join(implementations, "target", "left").withColumn("to_id", F.coalesce("impl", "target")).join(primary, "to_id", "left")
    edges = edges.select("from_id", "to_id", "fieldName", "injectionType", F.coalesce("qualifier", F.lit("")).alias("qualifier"), F.coalesce("p", F.lit(False)).alias("isPrimary"), F.when(c("impl").isNotNull(), c("target")).otherwise("").alias("interfaceType"), "sourceFile", F.concat_ws("\n", "injectionType", "sourceFile").alias("seq"))
    made = beans.select(c("m.ownerFqn").alias("from_id"), _simple_type("m.rawReturn").alias("to_id"), c("m.name").alias("methodName"), note("m.annotations", "Primary").alias("isPrimary"), F.coalesce(value("m.annotations", "Qualifier"), F.lit("")).alias("qualifier"), c("path").alias("sourceFile"), c("path").alias("seq"))
    return {
        "INJECTS": merge.merge_edges(edges, classes, classes, "fqn", "fqn", ["from_id", "to_id", "fieldName"], "seq"),
        "PRODUCES": merge.merge_edges(made, classes, classes, "fqn", "fqn", ["from_id", "to_id", "methodName"], "seq"),
    }


# -- libraries


def archive_packages(archives: DataFrame) -> DataFrame:
    """path and package for each package with classes in an archive.

    An archive's directory stands at its end: only that is read, from where the archive lies,
    whatever its size (or from its bytes, where a column content has them). Entries below
    META-INF/versions/n count as those they stand for; segments that are no identifiers drop an
    entry; what is no archive has no packages.
    """
    known = [c for c in ("content",) if c in archives.columns]

    def scan(batches):
        import re

        import pandas as pd

        from quillgraph.sources.archives import directory

        good = re.compile(r"[A-Za-z_$][\w$]*(?:/[A-Za-z_$][\w$]*)*\Z")
        for batch in batches:
            rows = set()
            for k, path in enumerate(batch["path"]):
                for n in directory(path, batch["content"][k] if known else None):
                    n = re.sub(r"^META-INF/versions/\d+/", "", n)
                    folder, _, name = n.rpartition("/")
                    if name.endswith(".class") and good.match(folder):
                        rows.add((path, folder.replace("/", ".")))
            yield pd.DataFrame(sorted(rows), columns=["path", "package"])

    ship(archives.sparkSession)
    return archives.select("path", *known).mapInPandas(scan, "path string, package string")


def package_owners(packages: DataFrame, preferred: DataFrame) -> DataFrame:
    """package -> coordinate: of several owners the locked one, the one whose group is nearest, then the shortest and least name.

    packages: package, coordinate; preferred: coordinates of the lock file.
    """
    c = F.col
    group = F.substring_index("coordinate", ":", 1)
    near = F.when(c("package").startswith(group), F.length(group)).otherwise(0)
    tagged = packages.distinct().join(preferred.select("coordinate", F.lit(0).alias("locked")).distinct(), "coordinate", "left")
    return resolve.elect(tagged, "package", F.coalesce("locked", F.lit(1)), -near, F.length("coordinate"), c("coordinate")).select("package", "coordinate")


def library_usage(files: DataFrame, graph: dict[str, DataFrame], packages: DataFrame, manual: DataFrame | None = None) -> dict[str, DataFrame]:
    """USES_LIBRARY from classes and modules, and ExternalLibrary with moduleUsageCount.

    packages: package, coordinate (see package_owners); manual: prefix, coordinate for
    imports that no package owns.
    """
    c = F.col
    src = C.java_files(files).select("path", T.java_fqn(c("path")).alias("fqn"), F.explode(F.array_distinct(T.find_all(c("content"), r"(?m)^\s*import\s+([\w.]+)\s*;"))).alias("import"))
    src = src.join(graph["JavaClass"].select("fqn", "module"), "fqn")
    by_package = resolve.longest_prefix(src, "import", packages, "package", "coordinate", ".")
    found = by_package.select("fqn", "module", "import", c("owner").alias("coordinate"))
    if manual is not None:
        left = src.join(found.select("fqn", "import"), ["fqn", "import"], "left_anti")
        found = found.unionByName(resolve.raw_prefix(left, "import", manual, "prefix", "coordinate").select("fqn", "module", "import", "coordinate"))
    libraries = graph["ExternalLibrary"]
    by_class = merge.merge_edges(found.select(c("fqn").alias("from_id"), c("coordinate").alias("to_id")), graph["JavaClass"], libraries, "fqn", "coordinate")
    pairs = found.where("module <> ''").select(c("module").alias("from_id"), c("coordinate").alias("to_id")).distinct()
    by_module = merge.merge_edges(pairs, graph["Module"], libraries, "gradlePath", "coordinate")
    counts = by_module.groupBy(c("to_id").alias("coordinate")).agg(F.count("*").alias("moduleUsageCount"))
    unresolved = src.join(found.select("fqn", "import"), ["fqn", "import"], "left_anti").groupBy("import").agg(F.count("*").alias("n"))
    return {"USES_LIBRARY_JavaClass": by_class, "USES_LIBRARY_Module": by_module, "ExternalLibrary": merge.set_properties(libraries, counts, "coordinate"), "UnresolvedImports": unresolved}


def ranked_archives(archives: DataFrame, locked: DataFrame) -> DataFrame:
    """The archive to read of each artifact: the locked version, else the greatest; the main file.

    archives: group, artifact, version, path; sources and javadoc files are left out, and a
    file named artifact-version goes before one with a classifier.
    """
    c = F.col
    plain = archives.where(~c("path").rlike(r"-(?:sources|javadoc|tests?)\.jar$"))
    exact = locked.select("group", "artifact", "version", F.lit(0).alias("locked"))
    main = F.when(F.substring_index("path", "/", -1) == F.concat("artifact", F.lit("-"), "version", F.lit(".jar")), 0).otherwise(1)
    tagged = plain.join(exact, ["group", "artifact", "version"], "left").withColumn("coordinate", F.concat("group", F.lit(":"), "artifact"))
    order = W.partitionBy("coordinate").orderBy(F.coalesce("locked", F.lit(1)), resolve.version_key(c("version")).desc(), main, F.length("path"), "path")
    return tagged.withColumn("k", F.row_number().over(order)).where("k = 1").select("coordinate", "version", "path")
