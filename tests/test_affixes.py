"""Joins by prefixes and parts against brute force, and their plans."""

import random

import pytest

from quillgraph.extract import web
from quillgraph.operators import affixes, resolve


def words(rng, n):
    return ["".join(rng.choice("ab/") for _ in range(rng.choice([0, 1, 3, 8, 9, 20]))) for _ in range(n)] + [None, "é/%_", "a" * 40]


@pytest.mark.parametrize("join, test", [(affixes.begins, str.startswith), (affixes.contains, lambda t, p: p in t)])
def test_equal_brute_force(spark, join, test):
    rng = random.Random(1)
    texts, patterns = words(rng, 150), words(rng, 80)
    a = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    b = spark.createDataFrame(list(enumerate(patterns)), "j int, p string")
    got = [(r.i, r.j) for r in join(a, "t", b, "p").collect()]
    assert sorted(got) == [(i, j) for i, t in enumerate(texts) for j, p in enumerate(patterns) if t is not None and p is not None and test(t, p)]


def test_raw_prefix(spark):
    rng = random.Random(2)
    names = [".".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    entries = list({".".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) + rng.choice(["", "."]) for _ in range(25)})
    got = resolve.raw_prefix(spark.createDataFrame([(n,) for n in names], "n string"), "n", spark.createDataFrame([(e, e) for e in entries], "p string, v string"), "p", "v")
    hit = lambda n, e: n == e or n.startswith(e if e.endswith(".") else e + ".")
    want = [(n, max((e for e in entries if hit(n, e)), key=len)) for n in names if any(hit(n, e) for e in entries)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def globs(rng, n):
    return ["/".join(rng.choice(["ab", "a", "b", "ba*", "*", "**"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "/", "/**/*", "*"]) for _ in range(n)]


def test_owners_and_pipelines_on_random_globs(spark):
    import re

    rng = random.Random(3)
    paths = list({"/".join(rng.choice(["ab", "a", "b", "ba"]) for _ in range(rng.randint(1, 4))) for _ in range(40)})
    modules = spark.createDataFrame([(":" + p.replace("/", ":"), p) for p in paths], "gradlePath string, path string")
    rules = [(rng.choice(["", "/", "**/"]) + g, rng.sample(["@x/a", "@x/b", "@c"], rng.randint(1, 2))) for g in globs(rng, 30)]
    text = "\n".join(" ".join([p, *o]) for p, o in rules)
    jobs = {f"j{k}": globs(rng, rng.randint(1, 3)) for k in range(20)}
    ci = "\n".join(f"{j}:\n  script: [x]\n  rules:\n  - changes: {p!r}" for j, p in jobs.items())
    files = spark.createDataFrame([("CODEOWNERS", text), (".gitlab-ci.yml", ci)], "path string, content string")

    def owned(rule, path):
        p = rule.strip("/")
        return p[3:] in path if p.startswith("**/") else path.startswith(re.sub(r"\*$", "", p))

    def meant(p, path):
        return p.startswith(path) or path.startswith(re.sub(r"(/?\*+)+(/\*)*$", "", p)) or path in p

    found = web.owners(files, {"Module": modules})
    got = {(r.from_id, r.to_id) for r in found["OWNS"].collect()}
    assert got == {(o, ":" + p.replace("/", ":")) for r, os in rules for o in os for p in paths if owned(r, p)}
    seen = web.pipelines(files, {"Module": modules})
    got = {(r.from_id, r.to_id, r.pattern) for r in seen["CI_TRIGGERED_BY"].collect()}
    assert got == {(j, ":" + p.replace("/", ":"), g) for j, gs in jobs.items() for g in gs for p in paths if meant(g, p)}
    for df in (found["OWNS"], seen["CI_TRIGGERED_BY"]):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
