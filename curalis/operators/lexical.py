"""Counts between marker lines of declaration files, read as lines and not as their formats.

A file is one row, its lines an array in it; which section and which entry a line belongs to is told by the places of the markers. Nothing is shuffled or sorted. Files are bounded by their readers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalis.functions.nested import let

# fixed values: where lines end, the shapes of a stage, a field, a locked stage and a manifest's path, and how short a digest may be
ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
SPACE, OTHER = r"[\s\x1c-\x1f\x85\p{Z}]", r"[^\s\x1c-\x1f\x85\p{Z}]"
STAGE = rf"^{SPACE}{{2}}([A-Za-z0-9_.-]+):{SPACE}*(?:#.*)?$"
FIELD = rf"^{SPACE}{{4}}(cmd|deps|outs|params|metrics):(?:{SPACE}|$)"
LOCKED = rf"^  [^ #][^:]*:{SPACE}*(?:#.*)?$"
SAFE_PATH = r"^[^/][^\r\n]*$"
LEAST_DIGEST = 16


def lines(text: Column) -> Column:
    """The lines of a text; nothing stands behind a last line end."""
    return let(F.split(text, ENDS), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def _after(ls: Column, head: Callable[[Column], Column], again: bool) -> Column:
    """The lines behind the first heading up to the next line that is not indented; where headings may come again they do not end the section, nor are they of it."""
    inside = lambda x: (x == "") | x.rlike("^" + SPACE) | (head(x) if again else F.lit(False))
    first = lambda flags, rest: let(F.array_position(flags, True), rest)
    rest = first(F.transform(ls, head), lambda at: F.when(at > 0, F.slice(ls, at.cast("int") + 1, F.size(ls))))
    some = let(rest, lambda r: first(F.transform(r, lambda x: ~inside(x)), lambda at: F.when(at > 0, F.slice(r, 1, at.cast("int") - 1)).otherwise(r)))
    return F.filter(some, lambda x: ~head(x)) if again else some


def stages(files: DataFrame, key: str) -> DataFrame:
    """(key, ordinal, stage, fields) of the stages of pipeline files, fields in the order of their first lines."""
    title = lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "") == "stages:"

    def told(section: Column) -> Column:
        """The stages of a section's lines: each from its name to the line before the next."""

        def parts(names: Column) -> Column:
            at = F.filter(F.sequence(F.lit(1), F.size(names)), lambda i: F.get(names, i - 1) != "")
            ends = lambda a: F.concat(F.slice(a, 2, F.size(a)), F.array(F.size(names) + 1))
            fields = lambda z: F.array_distinct(F.filter(F.transform(F.slice(section, z.a + 1, z.e - z.a - 1), lambda x: F.regexp_extract(x, FIELD, 1)), lambda f: f != ""))
            return let(at, lambda a: F.transform(F.slice(F.arrays_zip(a.alias("a"), ends(a).alias("e")), 1, F.size(a)), lambda z: F.struct(F.get(names, z.a - 1).alias("stage"), fields(z).alias("fields"))))

        return F.when(F.size(section) > 0, let(F.transform(section, lambda x: F.regexp_extract(x, STAGE, 1)), parts))

    found = let(lines(F.col("text")), lambda ls: let(_after(ls, title, True), told))
    s = files.select(key, F.posexplode(found).alias("ordinal", "x"))
    return s.select(key, (F.col("ordinal") + 1).cast("long").alias("ordinal"), "x.stage", "x.fields")


def locked_stages(files: DataFrame, key: str) -> DataFrame:
    """(key, stages): how many stages a lock file names; the heading must be the whole line."""
    section = let(lines(F.col("text")), lambda ls: _after(ls, lambda x: x == "stages:", False))
    n = let(section, lambda x: F.when(x.isNotNull(), F.size(F.filter(x, lambda y: y.rlike(LOCKED)))).otherwise(0))
    return files.select(key, n.cast("long").alias("stages"))


def config_keys(text: Column) -> Column:
    """How many lines set a key: with an equals sign and not behind a number sign."""
    return F.size(F.filter(F.split(text, ENDS), lambda x: x.contains("=") & ~x.rlike(f"^{SPACE}*#"))).cast("long")


def manifest_entries(files: DataFrame, key: str) -> DataFrame:
    """(key, entries): lines of a digest, two blanks somewhere, and a path without empty, '.' and '..' parts."""

    def entry(line: Column) -> Column:
        digest, path = F.regexp_extract(line, f"(?s)^{SPACE}*({OTHER}+){SPACE}+(.*)$", 1), F.regexp_replace(F.regexp_extract(line, f"(?s)^{SPACE}*{OTHER}+{SPACE}+(.*)$", 1), f"{SPACE}+$", "")
        return line.contains("  ") & (F.length(digest) >= LEAST_DIGEST) & let(path, lambda p: p.rlike(SAFE_PATH) & F.forall(F.split(p, "/"), lambda q: ~q.isin("", ".", "..")))

    found = F.filter(lines(F.col("text")), entry)
    return files.select(key, F.when(F.col("text").isNotNull(), F.size(found)).otherwise(0).cast("long").alias("entries"))
