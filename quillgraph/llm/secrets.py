"""Secret scan (operator 4, native): three base patterns and a sliding entropy window.

Candidate strings are maximal runs of token characters. A window of 20 characters slides
over each; its Shannon entropy is kept up to date from the counts of the character that
enters and the one that leaves. The threshold depends on the run's character class. Runs
on the allow list (placeholders, UUIDs, alphabets written out) get no span of this kind;
spans of the base patterns always stay. Work grows in proportion to the text: characters of
a run are split once, and the places of matches are summed up in parts of ``PART``.

Defined results: null text counts as empty; every row gets a row, repeated ones too; other
columns are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
WIDTH = 20
#: The characters of a run.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: Bits per character that a window of a class needs.
HEX_BITS, BASE_BITS = 3.0, 3.8
#: What sums of logarithms may be off by.
SLACK = 1e-9
ALLOW = r"(?i)example|sample|dummy|placeholder|changeme|your_|0123456789|abcdefghij|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: Matches whose places are summed up together.
PART = 256

SPAN = "array<struct<s:int,k:int,e:int,m:string>>"


def located(text: str, pattern: str, kind: int) -> str:
    """SQL for the spans of a pattern: lengths of what lies between matches, summed up.

    Sums run over parts first and then inside each, so appending copies short arrays only.
    """
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    part = f"slice(p, cast(b * {PART} + 1 AS int), {PART})"
    return f"""transform(array(zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (g, m) -> named_struct('g', length(g), 'm', m))), p ->
      flatten(transform(
        aggregate(sequence(0, cast((size(p) - 1) div {PART} AS int)),
          named_struct('at', 0, 'out', cast(array() AS array<int>)),
          (a, b) -> named_struct('at', a.at + aggregate({part}, 0, (n, x) -> n + x.g + coalesce(length(x.m), 0)), 'out', array_append(a.out, a.at)),
          a -> a.out),
        (base, b) -> aggregate({part},
          named_struct('at', base, 'out', cast(array() AS {SPAN})),
          (a, x) -> named_struct('at', a.at + x.g + coalesce(length(x.m), 0), 'out',
            if(x.m IS NULL, a.out, array_append(a.out, named_struct('s', a.at + x.g, 'k', {kind}, 'e', a.at + x.g + length(x.m), 'm', x.m)))),
          a -> a.out))))[0]"""


def _none() -> Column:
    return F.expr(f"cast(array() AS {SPAN})")


def base_spans(text: str, allowed_kinds: tuple[int, ...] = (0, 1, 2)) -> dict[int, Column]:
    """Spans of the base kinds: 0 assign, 1 access, 2 hex. Cheap tests go first."""
    low = F.lower(F.col(text))
    keyed = low.contains(KEYWORDS[0])
    for k in KEYWORDS[1:]:
        keyed = keyed | low.contains(k)
    value = "'" + ASSIGN.replace("\\", "\\\\").replace("'", "\\'") + "'"
    assign = F.expr(f"filter({located(text, ASSIGN, 0)}, x -> length(regexp_extract(x.m, {value}, 2)) >= {ASSIGN_VALUE})")
    return {
        0: F.when(keyed, assign).otherwise(_none()),
        1: F.when(F.col(text).contains("AKIA"), F.expr(located(text, ACCESS, 1))).otherwise(_none()),
        2: F.when(F.col(text).rlike(HEX), F.expr(located(text, HEX, 2))).otherwise(_none()),
    }


def window_state(run: str, width: int = WIDTH) -> str:
    """SQL: slides the window over a run's characters; first and last window at or over the bits.

    State: w (the window's characters), h (sum of c log2 c over its counts), and where the
    threshold was met. A step counts the character that leaves and the one that enters in the
    window, so it costs the window's width, whatever the length of the run.
    """
    f = "array(" + ",".join(f"{c * math.log2(c) if c else 0.0:.17g}D" for c in range(width + 2)) + ")"
    n = lambda window, x: f"(length({window}) - length(replace({window}, {x}, '')))"
    change = f"""if(x.i > {width} AND x.c = x.o, 0D, if(x.i > {width}, get({f}, {n('a.w', 'x.o')} - 1) - get({f}, {n('a.w', 'x.o')}), 0D)
        + get({f}, {n('x.r', 'x.c')} + 1) - get({f}, {n('x.r', 'x.c')}))"""
    met = f"x.i >= {width} AND log2({width}D) - h / {width} >= {run}.need"
    return f"""aggregate(sequence(1, size({run}.c)),
      named_struct('w', '', 'h', 0D, 'first', 0, 'last', 0),
      (a, i) -> transform(array(named_struct('i', i, 'c', get({run}.c, i - 1), 'o', left(a.w, 1), 'r', if(i > {width}, substring(a.w, 2), a.w))), x ->
        transform(array(a.h + {change}), h -> named_struct(
          'w', concat(x.r, x.c),
          'h', h,
          'first', if(a.first = 0 AND {met}, x.i - {width - 1}, a.first),
          'last', if({met}, x.i, a.last)))[0])[0])"""


def entropy_spans(text: str) -> Column:
    """Spans of kinds 3 (hex class) and 4 (base64 class) from high-entropy windows."""
    allow = "'" + ALLOW.replace("\\", "\\\\") + "'"
    runs = f"filter({located(text, RUN, 0)}, x -> x.m rlike '[0-9]' AND x.m rlike '[A-Za-z]' AND NOT x.m rlike {allow})"
    hexed = "(x.m rlike '^[0-9a-f]+$' OR x.m rlike '^[0-9A-F]+$')"
    chars = "filter(split(x.m, ''), y -> y <> '')"
    classed = f"transform({runs}, x -> named_struct('s', x.s, 'm', x.m, 'c', {chars}, 'k', if({hexed}, 3, 4), 'need', if({hexed}, {HEX_BITS - SLACK!r}D, {BASE_BITS - SLACK!r}D)))"
    met = f"transform({classed}, r -> named_struct('r', r, 'w', {window_state('r')}))"
    return F.when(F.col(text).rlike(RUN), F.expr(f"transform(filter({met}, z -> z.w.first > 0), z -> named_struct('s', z.r.s + z.w.first - 1, 'k', z.r.k, 'e', z.r.s + z.w.last, 'm', z.r.m))")).otherwise(_none())


KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and found: array of (s, k, e, m) by start, then kind as listed in KINDS."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base_spans("text")
    found = text.select("doc_id", base[0].alias("a"), base[1].alias("b"), base[2].alias("c"), entropy_spans("text").alias("d"))
    return found.select("doc_id", F.array_sort(F.concat("a", "b", "c")).alias("base"), F.array_sort(F.concat("a", "b", "c", "d")).alias("found"))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
pat(k, p) AS (VALUES (0, $p${ASSIGN}$p$), (1, $p${ACCESS}$p$), (2, $p${HEX}$p$), (3, $p${RUN}$p$)),
found AS (SELECT rid, k, p, regexp_extract_all(t, p) AS ms, string_split_regex(t, p) AS gs FROM d, pat WHERE regexp_matches(t, p)),
each AS (SELECT rid, k, p, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM found),
placed AS (
  SELECT rid, k, p, ms[i] AS m, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM each),
base AS (SELECT rid, k, s, s + length(m) AS e FROM placed WHERE k < 3 AND (k > 0 OR length(regexp_extract(m, p, 2)) >= {ASSIGN_VALUE})),
runs AS (
  SELECT rid, s, m, regexp_full_match(m, '[0-9a-f]+|[0-9A-F]+') AS hexed FROM placed
  WHERE k = 3 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT regexp_matches(m, '{ALLOW}')),
windows AS (SELECT rid, s, m, hexed, unnest(range(1, length(m) - {WIDTH} + 2)) AS j FROM runs),
chars AS (SELECT rid, s, hexed, j, unnest(string_split(substr(m, j, {WIDTH}), '')) AS c FROM windows),
counts AS (SELECT rid, s, hexed, j, c, count(*) AS n FROM chars GROUP BY ALL),
bits AS (SELECT rid, s, hexed, j, log2({WIDTH}) - sum(n * log2(n)) / {WIDTH} AS h FROM counts GROUP BY ALL),
more AS (
  SELECT rid, CASE WHEN hexed THEN 3 ELSE 4 END AS k, s + min(j) - 1 AS s, s + max(j) + {WIDTH - 1} AS e FROM bits
  WHERE h >= CASE WHEN hexed THEN {HEX_BITS} ELSE {BASE_BITS} END - {SLACK} GROUP BY rid, bits.s, hexed),
named AS (SELECT rid, k, s, [{", ".join(f"'{k}'" for k in KINDS)}][k + 1] || ':' || s || ':' || e AS x FROM (SELECT * FROM base UNION ALL SELECT * FROM more)),
per AS (
  SELECT rid, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
    string_agg(x, ',' ORDER BY s, k) FILTER (k < 3) AS own, string_agg(x, ',' ORDER BY s, k) AS every FROM named GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(own, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN per USING (rid)
"""
