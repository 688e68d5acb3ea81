"""Scalar text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(c: Column) -> Column:
    """Trimmed and in lower case, as answers are compared."""
    return F.lower(F.trim(c))


def find_all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), group)


def find_groups(c: Column, pattern: str, groups: int) -> Column:
    """All matches of a pattern with several groups, as structs g1, g2, ..."""
    lists = [F.regexp_extract_all(c, F.lit(pattern), k).alias(f"g{k}") for k in range(1, groups + 1)]
    return F.arrays_zip(*lists)


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null where there is none."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def n_matches(c: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(pattern), 0))


def line_count(c: Column) -> Column:
    """Line feeds plus one; 0 for an empty or null text."""
    return F.when((c.isNull()) | (c == ""), 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit("\n"))) + 1)


def icontains(c: Column, word: str) -> Column:
    return F.lower(c).contains(word.lower())


def last_segment(c: Column, sep: str = ".") -> Column:
    return F.substring_index(c, sep, -1)


def parent_name(c: Column, sep: str = ".") -> Column:
    """All but the last segment; null for a single one."""
    return F.when(F.instr(c, sep) > 0, F.substring(c, F.lit(1), F.length(c) - F.length(F.substring_index(c, sep, -1)) - len(sep)))


def java_fqn(path: Column, strict: bool = False) -> Column:
    """Class name of a Java source path: below src/main/java, or below any java folder."""
    marker = "src/main/java/" if strict else "/java/"
    tail = F.regexp_extract(F.concat(F.lit("/"), path), ".*?" + marker + r"(.+)\.java$", 1)
    return F.when(tail != "", F.replace(tail, F.lit("/"), F.lit(".")))


def stripped(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(c) / 4)


def csv_list(c: Column) -> Column:
    """Trimmed, non-empty parts of a comma-separated text."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)


def is_type_variable(c: Column) -> Column:
    """A single capital, or a capital and up to two digits."""
    return c.rlike("^[A-Z][0-9]{0,2}$")


def object_entries(json: Column, *path: str) -> Column:
    """Keys and values of a JSON object member as an array of (key, value)."""
    member = F.get_json_object(json, "$." + ".".join(path)) if path else json
    return F.map_entries(F.coalesce(F.from_json(member, "map<string,string>"), F.create_map().cast("map<string,string>")))


def last_valid_json(c: Column, schema: str) -> Column:
    """The last fenced JSON block of a text that parses as an object of the schema.

    Where no fenced one does, the last inline object of one line is tried.
    """
    def pick(pattern: str) -> Column:
        blocks = F.regexp_extract_all(c, F.lit(pattern), 1)
        whole = F.filter(blocks, lambda b: F.try_parse_json(b).isNotNull())
        return F.from_json(F.get(F.reverse(whole), F.lit(0)), schema)

    return F.coalesce(pick(r"(?s)```(?:json)?\s*\n(\{.*?\})\s*\n```"), pick(r"(\{[^{}\n]*(?:\{[^{}\n]*\}[^{}\n]*)*\})"))


def xpath_local(*names: str, attribute: str | None = None) -> str:
    """An XPath to elements by local name, whatever their namespace."""
    steps = "".join(f"//*[local-name()='{n}']" if k == 0 else f"/*[local-name()='{n}']" for k, n in enumerate(names))
    return steps + (f"/@{attribute}" if attribute else "/text()")
