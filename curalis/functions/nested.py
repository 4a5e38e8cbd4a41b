"""Nested JSON values walked, rewritten and written canonically by column expressions, at any depth.

A document stays one row. Its nodes are an array in document order, which starts with the whole value; a step puts the children of each open node
right behind it, so that order holds and a budget of nodes can cut the array at every level. There are as many steps as the deepest document of
the table has levels (one aggregate over brackets); no step shuffles.

A node is struct(top, key, kind, text, around): top is a label that children take over, key the name in an object, kind one of O A S N B V (object, list, string,
number, truth value, null), text the string or the JSON text, around the brackets that hold it, outermost first. A document in which an object names a key twice is no JSON here, nor
is one with text behind its value; a lone surrogate reads as '?'.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalis.functions.columns import json_string

NODE = "struct<top:string,key:string,kind:string,text:string,around:string>"
LEVELS_A_STEP = 16  # levels between two checkpoints
_STRINGS = r'"(?:[^"\\]|\\.)*+"'


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def nesting(json: Column) -> Column:
    """How many levels of brackets a JSON text has at most."""
    brackets = F.split(F.regexp_replace(F.regexp_replace(json, "(?s)" + _STRINGS, ""), r"[^\[\]{}]", ""), "")
    step = F.aggregate(brackets, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, x: let(a.now + F.when(x.isin("[", "{"), 1).when(x.isin("]", "}"), -1).otherwise(0), lambda n: F.struct(n.alias("now"), F.greatest(a.most, n).alias("most"))))
    return F.coalesce(step.most, F.lit(0))


def kind(v: Column) -> Column:
    s = F.schema_of_variant(v)
    return F.when(s.startswith("OBJECT"), "O").when(s.startswith("ARRAY"), "A").when(s == "STRING", "S").when(s == "BOOLEAN", "B").when(s.isNull() | (s == "VOID"), "V").otherwise("N")


def node(key: Column, k: Column, text: Column, around: Column, top: Column) -> Column:
    return F.struct(top.cast("string").alias("top"), key.cast("string").alias("key"), k.alias("kind"), text.alias("text"), around.alias("around"))


def members(text: Column, ordered: bool = False) -> Column:
    """array<struct(key, kind, text)> of an object's text, as they come or by key."""
    texts, kinds = F.from_json(text, "map<string,string>"), F.from_json(text, "map<string,variant>")
    rows = F.transform(F.arrays_zip(F.map_keys(kinds).alias("a"), F.map_values(kinds).alias("b"), F.map_values(texts).alias("c")), lambda x: F.struct(x.a.alias("key"), kind(x.b).alias("kind"), x.c.alias("text")))
    return F.array_sort(rows) if ordered else rows


def items(text: Column) -> Column:
    """array<struct(kind, text)> of a list's text."""
    return F.transform(F.arrays_zip(F.from_json(text, "array<variant>").alias("a"), F.from_json(text, "array<string>").alias("b")), lambda x: F.struct(kind(x.a).alias("kind"), x.b.alias("text")))


def _children(n: Column, ordered: bool) -> Column:
    inside = lambda b: F.concat(n.around, F.lit(b))
    of_object = F.transform(members(n.text, ordered), lambda x: node(x.key, x.kind, x.text, inside("{"), n.top))
    of_list = F.transform(items(n.text), lambda x: node(F.lit(None), x.kind, x.text, inside("["), n.top))
    return F.when(n.kind == "O", of_object).when(n.kind == "A", of_list)


def walk(df: DataFrame, nodes: str, levels: int, most: int | None = None, ordered: bool = False, closed: Callable[[Column], Column] | None = None) -> DataFrame:
    """df with the array `nodes` (of nodes with `around` '' to begin with) expanded by `levels` levels, cut behind `most` + 1 nodes.

    closed(node): nodes whose children are not visited. ordered: members by key in place of document order."""
    for level in range(levels):
        shut = (lambda n: F.lit(False)) if closed is None else closed
        step = lambda n: F.concat(F.array(n), F.coalesce(F.when((F.length(n.around) == level) & ~shut(n), _children(n, ordered)), F.array().cast(f"array<{NODE}>")))  # noqa: E731, B023
        grown = F.flatten(F.transform(nodes, step))
        df = df.withColumn(nodes, grown if most is None else F.slice(grown, 1, most + 1))
        if level % LEVELS_A_STEP == LEVELS_A_STEP - 1:
            from curalis.operators.duplicates import kept

            df = kept(df)
    return df


def deepest(df: DataFrame, json: str) -> int:
    return df.agg(F.max(nesting(F.col(json)))).first()[0] or 0


def document(json: Column) -> Column:
    """The nodes to begin with: the whole value, or null where json is none."""
    v = F.try_parse_json(json)
    text = F.when(kind(v) == "S", F.try_variant_get(v, "$", "string")).when(kind(v) == "N", F.regexp_replace(json, r"^\s+|\s+$", "")).otherwise(json)
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"a":'), json, F.lit(',"b":0}'))), "$.b", "int") == 0  # the parser ignores what follows a value
    return F.when(v.isNotNull() & alone, F.array(node(F.lit(None), kind(v), text, F.lit(""), F.lit(None))))


def number(text: Column) -> Column:
    """A JSON number as Python writes it: whole numbers as they are, others with the fewest digits that give the same double."""
    d = text.cast("double")
    java = F.regexp_replace(d.cast("string"), "^-", "")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    whole, part, power = F.regexp_extract(java, r"^(\d+)", 1), F.regexp_extract(java, r"\.(\d+)", 1), F.coalesce(F.nullif(F.regexp_extract(java, r"E(-?\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    both = F.concat(whole, part)
    lead = F.length(both) - F.length(F.regexp_replace(both, "^0+", ""))
    parts = F.struct(F.regexp_replace(F.regexp_replace(both, "^0+", ""), "0+$", "").alias("digits"), (F.length(whole) - 1 - lead + power).alias("e"))

    def shorter(x: Column) -> Column:
        """One digit less, rounded, where it reads as the same double: Java at times writes one too many."""
        n = F.length(x.digits)
        up = F.substring(x.digits, F.lit(1), n - 1).cast("long") + F.when(F.substring(x.digits, n, F.lit(1)) >= "5", 1).otherwise(0)
        less = F.struct(F.regexp_replace(up.cast("string"), "0+$", "").alias("digits"), (x.e + F.length(up.cast("string")) - n + 1).alias("e"))
        same = F.concat(sign, up.cast("string"), F.lit("E"), (x.e - n + 2).cast("string")).cast("double") == d
        return F.when((n >= 2) & same, less).otherwise(x)

    def written(x: Column) -> Column:
        n = F.length(x.digits)
        plain = F.when(x.e >= n - 1, F.concat(x.digits, F.repeat(F.lit("0"), x.e - n + 1), F.lit(".0"))).when(x.e >= 0, F.concat(F.substring(x.digits, F.lit(1), x.e + 1), F.lit("."), F.substring(x.digits, x.e + 2, n))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -x.e - 1), x.digits))
        power = F.concat(F.lit("e"), F.when(x.e < 0, "-").otherwise("+"), F.lpad(F.abs(x.e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(x.e).cast("string"))), F.lit("0")))
        short = F.concat(F.substring(x.digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(x.digits, F.lit(2), n))).otherwise(""), power)
        return F.concat(sign, F.when(x.digits == "", "0.0").when((x.e >= -4) & (x.e < 16), plain).otherwise(short))

    return F.when(~text.rlike("[.eE]"), F.regexp_replace(text, "^-0$", "0")).otherwise(let(let(let(parts, shorter), shorter), written))


def _written(nodes: Column) -> Column:
    """Canonical JSON of a document's nodes, members by key: each node writes its comma, its key, itself, and the brackets that end behind it."""

    def piece(x: Column) -> Column:
        n, deep = x.n, F.length(x.n.around)
        comma = F.when((deep > 0) & (x.before >= deep), ",").otherwise("")
        key = F.when(n.around.endswith("{"), F.concat(json_string(n.key), F.lit(":"))).otherwise("")
        own = F.when(n.kind == "S", json_string(n.text)).when(n.kind == "N", number(n.text)).when(n.kind == "V", "null").when(n.kind == "O", F.when(x.behind > deep, "{").otherwise("{}")).when(n.kind == "A", F.when(x.behind > deep, "[").otherwise("[]")).otherwise(n.text)
        ends = F.when(x.behind < deep, F.translate(F.reverse(F.substring(n.around, x.behind + 1, deep - x.behind)), "{[", "}]")).otherwise("")
        return F.concat(comma, key, own, ends)

    def whole(ns: Column) -> Column:
        deep = F.transform(ns, lambda n: F.length(n.around))
        before, behind = F.concat(F.array(F.lit(-1)), deep), F.concat(F.slice(deep, 2, F.size(deep)), F.array(F.lit(0)))
        return F.array_join(F.transform(F.arrays_zip(ns.alias("n"), F.slice(before, 1, F.size(deep)).alias("before"), behind.alias("behind")), piece), "")

    return let(nodes, whole)


def canonical_json(df: DataFrame, json: str, out: str, change: Callable[[Column], Column] | None = None, gather: tuple[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """df with `out`: canonical JSON of the column `json` (keys in order, no white space, ASCII only, numbers as Python writes them), null where it is no JSON.

    change(text) rewrites each string value (not keys). gather = (name, f): one more column with the sorted set of the values that f(text), an array, gives
    for the strings before they are changed. Keys order by code points."""
    d = walk(df.withColumn("_nodes", document(F.col(json))), "_nodes", deepest(df, json), ordered=True)
    nodes = F.col("_nodes")
    if gather is not None:
        found = F.flatten(F.transform(F.filter(nodes, lambda n: n.kind == "S"), lambda n: gather[1](n.text)))
        d = d.withColumn(gather[0], F.array_sort(F.array_distinct(found)))
    if change is not None:
        nodes = F.transform(nodes, lambda n: node(n.key, n.kind, F.when(n.kind == "S", change(n.text)).otherwise(n.text), n.around, n.top))
    return d.withColumn(out, _written(nodes)).drop("_nodes")
