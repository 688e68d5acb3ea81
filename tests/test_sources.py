import io
import zipfile

import pytest

from quillgraph.evaluation import record
from quillgraph.extract import java
from quillgraph.functions import tables
from quillgraph.sources import archives, corpus


def test_caches(spark, tmp_path):
    home = tmp_path / "home"
    jar = home / ".gradle/caches/modules-2/files-2.1/org.x/lib/1.2/abc/lib-1.2.jar"
    jar.parent.mkdir(parents=True)
    jar.write_bytes(b"zip")
    roots = archives.cache_roots({"HOME": str(home), "GRADLE_HOME": str(tmp_path / "none")})
    assert len(roots) == 1
    assert [tuple(r)[:3] for r in archives.archives(spark, roots).collect()] == [("org.x", "lib", "1.2")]
    made = []

    def make():
        made.append(1)
        return spark.range(5)

    path = str(tmp_path / "kept")
    for mark, least, n in (("a", 3, 1), ("a", 3, 1), ("b", 3, 2), ("b", 9, 3)):
        assert archives.kept(spark, path, mark, make, least).count() == 5 and len(made) == n
    lock = tmp_path / "lock"
    before = archives.signature(roots, str(lock))
    lock.write_text("x")
    assert archives.signature(roots, str(lock)) != before == archives.signature(roots, None)


def test_tree(spark, tmp_path):
    for name in ("a/b/c.txt", "d.k", ".github/CODEOWNERS", "a/.gitlab-ci.yml", "x/build/src/A.java", "x/src/A.java"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"é {name}\nk = v=1\n#c")
    files = corpus.tree(spark, str(tmp_path)).unionByName(corpus.hidden(spark, str(tmp_path), ("CODEOWNERS", ".gitlab-ci.yml")))
    assert sorted(r.path for r in files.collect()) == [".github/CODEOWNERS", "a/.gitlab-ci.yml", "a/b/c.txt", "d.k", "x/build/src/A.java", "x/src/A.java"]
    assert all(r.content.startswith(f"é {r.path}") for r in files.collect())
    assert [r.path for r in corpus.java_files(files).collect()] == ["x/src/A.java"]
    assert {(r.key, r.value, r.line_no) for r in corpus.properties(corpus.named(files, r".*\.k")).collect()} == {("k", "v=1", 2)}


def test_record(spark, tmp_path):
    path = str(tmp_path / "results")
    record.record(spark, path, "c1", "graph_assisted", " a, b ,", total_tokens_in=5)
    record.record(spark, path, "c1", "tools_only", ["x"])
    record.record(spark, path, "c2", "tools_only", [])
    got = record.recorded(spark, path)
    assert sorted((r.test_case_id, r.answer_items) for r in record.paired(got).collect()) == [("c1", ["a", "b"]), ("c1", ["x"])]
    with pytest.raises(ValueError):
        record.record(spark, path, "c1", "other", [])


def test_only_the_directory_of_an_archive_is_read(spark, tmp_path, monkeypatch):
    jar = tmp_path / "org.big/lib/1.0/abc/lib-1.0.jar"
    jar.parent.mkdir(parents=True)
    with zipfile.ZipFile(jar, "w") as z:
        z.writestr("assets/blob.bin", b"x" * 30_000_000)
        z.writestr("org/big/A.class", "")
    (tmp_path / "bad.jar").write_bytes(b"no archive")
    found = archives.archives(spark, [str(tmp_path)])
    assert [(r.path.rpartition("/")[2], r.package) for r in java.archive_packages(found).collect()] == [("lib-1.0.jar", "org.big")]
    read = []

    class Counting(io.FileIO):
        def readinto(self, b):
            n = super().readinto(b)
            read.append(n)
            return n

        def read(self, n=-1):
            data = super().read(n)
            read.append(len(data))
            return data

    monkeypatch.setattr(archives, "opened", lambda path: Counting(path))
    assert archives.directory(str(jar)) == ["assets/blob.bin", "org/big/A.class"] and sum(read) < 300_000
    assert archives.directory(str(tmp_path / "bad.jar")) == []


def test_parsers_in_sql(spark):
    tables.register(spark)
    spark.createDataFrame([("package a.b; import x.Y; class A extends Y { int f(String s) { return 1; } interface B {} }",), (None,), ("",)], "content string").createOrReplaceTempView("java_sources")
    got = spark.sql("SELECT c.fqn, c.kind FROM java_sources, LATERAL java_classes(content) c ORDER BY 1").collect()
    assert [tuple(r) for r in got] == [("a.b.A", "class"), ("a.b.A.B", "interface")]
    assert spark.sql("SELECT m.id FROM java_sources, LATERAL java_methods(content) m").first().id == "a.b.A#f(String)"
    assert sorted(r.name for r in spark.sql("SELECT r.name FROM java_sources, LATERAL java_references(content) r").collect()) == ["Y", "x.Y"]
