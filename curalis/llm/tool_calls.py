"""Tool-call linking (8): calls and results hash-joined by identifier, ordered topologically, arguments validated, canonical JSON.

link(calls, results): calls(conversation, call_id, position, name, arguments, depends) and results(conversation, call_id, position, content).
An identifier names a call within its conversation only. `depends` lists identifiers of calls of the same conversation whose
results a call uses; `level` is a call's depth in that order, 0 for calls that use none, and null on or behind a cycle. The calls of
a conversation of up to SMALL calls and dependencies are ordered together in one row; those of larger ones are
peeled level by level in distributed rounds, one a level, so that no conversation of unbounded size is gathered anywhere.

Cases: of several different rows of an identifier the one with the smallest (position, text) is linked, the others are rows of status
`conflicting`, and `copies` counts all rows of the identifier; a call without a result is `unanswered`, or `silent` where its tool gives none; a result
without a call is `orphan`; a null identifier is `unidentified` and not linked; arguments that are null or not JSON are invalid;
dependencies on unknown calls are reported and do not order; a null conversation is one conversation; null columns stay null; texts of any
length are read whole; extra columns are not read, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, ship

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and value.is_integer())
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES[kind])


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What a value breaks of a JSON Schema (type, enum, const, bounds, lengths, pattern, properties, required, items)."""
    out, kinds = [], schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: type"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: enum")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: const")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: {k}" for k, bad in (("minimum", lambda m: value < m), ("maximum", lambda m: value > m)) if k in schema and bad(schema[k])]
    if isinstance(value, str):
        out += [f"{at}: {k}" for k, bad in (("minLength", lambda m: len(value) < m), ("maxLength", lambda m: len(value) > m), ("pattern", lambda m: not re.search(m, value))) if k in schema and bad(schema[k])]
    if isinstance(value, list):
        out += [f"{at}: {k}" for k, bad in (("minItems", lambda m: len(value) < m), ("maxItems", lambda m: len(value) > m)) if k in schema and bad(schema[k])]
        for i, x in enumerate(value if "items" in schema else []):
            out += violations(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: required" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    return out


def canonical(value) -> str:
    """Sorted keys, no white space, no escapes but those JSON needs."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _refuse(x: str):
    raise ValueError(x)


SMALL = 200_000


def _depths(ids: list, needs: list) -> list[int | None]:
    """Depth of each call by the calls it needs (positions in the list); None on or behind a cycle."""
    left, users, depth = [len(x) for x in needs], [[] for _ in ids], [0] * len(ids)
    for k, x in enumerate(needs):
        for q in x:
            users[q].append(k)
    ready = [k for k, n in enumerate(left) if not n]
    for k in ready:  # grows while it is read
        for u in users[k]:
            depth[u] = max(depth[u], depth[k] + 1)
            left[u] -= 1
            if not left[u]:
                ready.append(u)
    return [None if n else d for n, d in zip(left, depth)]


def _ordered(conversations: pd.Series) -> pd.Series:
    out = []
    for calls in conversations:
        at = {c["call_id"]: k for k, c in enumerate(calls)}
        needs = [sorted({x for x in (c["depends"] if c["depends"] is not None else []) if x is not None}) for c in calls]
        level = _depths(list(at), [[at[x] for x in n if x in at] for n in needs])
        out.append([{"call_id": c["call_id"], "level": d, "missing": [x for x in n if x not in at] or None} for c, n, d in zip(calls, needs, level)])
    return pd.Series(out, dtype=object)


def _same(a: DataFrame, b: DataFrame, *keys: str):
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def _peeled(calls: DataFrame) -> DataFrame:
    """(conversation, call_id, level, missing) by distributed rounds."""
    edge = calls.select("conversation", "call_id", F.explode("depends").alias("needs")).filter("needs is not null").distinct()
    known = calls.select(F.col("conversation").alias("kc"), F.col("call_id").alias("ki"))
    j = materialize(edge.join(known, F.col("conversation").eqNullSafe(F.col("kc")) & (F.col("needs") == F.col("ki")), "left"), "needs")
    missing = j.filter("ki is null").groupBy("conversation", "call_id").agg(F.array_sort(F.collect_set("needs")).alias("missing"))
    rest, edges = materialize(calls.select("conversation", "call_id"), "rest"), materialize(j.filter("ki is not null").select("conversation", "call_id", "needs"), "ordering")
    done, level = None, 0
    while not rest.isEmpty():
        ready = materialize(rest.join(edges, _same(rest, edges, "conversation", "call_id"), "left_anti").withColumn("level", F.lit(level).cast("long")), "level")
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        rest = materialize(rest.join(ready, _same(rest, ready, "conversation", "call_id"), "left_anti"), "rest")
        edges = materialize(edges.join(ready, edges["conversation"].eqNullSafe(ready["conversation"]) & (edges["needs"] == ready["call_id"]), "left_anti"), "ordering")
        level += 1
    out = rest.withColumn("level", F.lit(None).cast("long"))
    out = out if done is None else done.unionByName(out)
    m = missing.select(F.col("conversation").alias("mc"), F.col("call_id").alias("mi"), "missing")
    return out.join(m, F.col("conversation").eqNullSafe(F.col("mc")) & (F.col("call_id") == F.col("mi")), "left").select("conversation", "call_id", "level", "missing")


def order(calls: DataFrame, small: int = SMALL) -> DataFrame:
    """(conversation, call_id, level, missing) for calls(conversation, call_id, depends) of distinct identifiers; missing lists dependencies that are no calls."""
    calls = calls.select("conversation", "call_id", "depends")
    sizes = calls.groupBy("conversation").agg(F.sum(1 + F.coalesce(F.greatest(F.size("depends"), F.lit(0)), F.lit(0))).alias("n"))
    large = materialize(sizes.filter(F.col("n") > small).select(F.col("conversation").alias("lc")), "large")
    on = F.col("conversation").eqNullSafe(F.col("lc"))
    one = calls.join(large, on, "left_anti").groupBy("conversation").agg(F.collect_list(F.struct("call_id", "depends")).alias("calls"))
    out = one.select("conversation", F.explode(F.pandas_udf(_ordered, "array<struct<call_id:string,level:long,missing:array<string>>>")("calls")).alias("x")).select("conversation", "x.call_id", "x.level", "x.missing")
    if large.isEmpty():
        return out
    return out.unionByName(_peeled(materialize(calls.join(large, on, "left_semi"), "calls")))


def _first(df: DataFrame, cols: list[str], copies: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each identifier with how many it has, and the distinct others that differ from it."""
    own = df.filter("call_id is not null").select("conversation", "call_id", F.struct(*cols).alias("x"))
    first = materialize(own.groupBy("conversation", "call_id").agg(F.min("x").alias("x"), F.max("x").alias("_y"), F.count("*").alias(copies)), "first")
    mixed = first.filter("not (x <=> _y)").select(F.col("conversation").alias("fc"), F.col("call_id").alias("fi"), F.col("x").alias("fx"), copies)
    other = own.join(mixed, F.col("conversation").eqNullSafe(F.col("fc")) & (F.col("call_id") == F.col("fi"))).filter("not (x <=> fx)").select("conversation", "call_id", "x", copies).distinct()
    flat = lambda d: d.select("conversation", "call_id", *[F.col(f"x.{c}").alias(c) for c in cols], copies)
    return flat(first), flat(other)


LINKED = "call_id string, conversation long, level long, call_position long, result_position long, status string, valid boolean, violations string, copies long, canonical string"


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], silent: tuple[str, ...] = ()) -> DataFrame:
    """A row for each call, each result without a call, and each conflicting copy of either. silent: tools that give no result."""
    ship(calls.sparkSession)
    none = lambda t: F.lit(None).cast(t)
    c, more_c = _first(calls, ["position", "name", "arguments", "depends"], "call_copies")
    r, more_r = _first(results, ["position", "content"], "result_copies")
    o = order(c).select(F.col("conversation").alias("oc"), F.col("call_id").alias("oi"), "level", "missing")
    c = c.join(o, F.col("conversation").eqNullSafe(F.col("oc")) & (F.col("call_id") == F.col("oi")), "left").drop("oc", "oi")
    r = r.select(F.col("conversation").alias("rc"), F.col("call_id").alias("ri"), F.col("position").alias("result_position"), "content", "result_copies")
    j = c.join(r, F.col("conversation").eqNullSafe(F.col("rc")) & (F.col("call_id") == F.col("ri")), "full_outer")
    status = F.when(F.col("call_copies").isNull(), "orphan").when(F.col("result_copies").isNotNull(), "linked").when(F.coalesce(F.col("name").isin(*silent), F.lit(False)), "silent").otherwise("unanswered")
    j = j.select(F.coalesce("call_id", "ri").alias("call_id"), F.when(F.col("call_copies").isNull(), F.col("rc")).otherwise(F.col("conversation")).alias("conversation"), "level", F.col("position").alias("call_position"), "result_position", "name", "arguments", "content", "missing", status.alias("status"), (F.coalesce("call_copies", F.lit(0)) + F.coalesce("result_copies", F.lit(0))).alias("copies"))

    def alone(d: DataFrame, is_call: bool, state: str, copies) -> DataFrame:
        v = lambda n, yes, t: (F.col(n) if yes else none(t))
        return d.select("call_id", "conversation", none("long").alias("level"), v("position", is_call, "long").alias("call_position"), v("position", not is_call, "long").alias("result_position"), v("name", is_call, "string").alias("name"), v("arguments", is_call, "string").alias("arguments"), v("content", not is_call, "string").alias("content"), none("array<string>").alias("missing"), F.lit(state).alias("status"), copies.cast("long").alias("copies"))

    for part in (alone(calls.filter("call_id is null"), True, "unidentified", F.lit(1)), alone(results.filter("call_id is null"), False, "unidentified", F.lit(1)), alone(more_c, True, "conflicting", F.col("call_copies")), alone(more_r, False, "conflicting", F.col("result_copies"))):
        j = j.unionByName(part)

    @F.pandas_udf("struct<valid boolean, violations string, canonical string>")
    def check(ids: pd.Series, names: pd.Series, arguments: pd.Series, content: pd.Series, missing: pd.Series, is_call: pd.Series) -> pd.DataFrame:
        out = []
        for i, n, a, c, m, called in zip(ids, names, arguments, content, missing, is_call):
            value, bad = None, []
            if not called:
                bad.append("$: no call")
            else:
                if n not in schemas:
                    bad.append("$: unknown tool")
                try:
                    value = json.loads(a, parse_constant=_refuse) if a is not None else None
                    if n in schemas:
                        bad += violations(value, schemas[n])
                except (ValueError, RecursionError):
                    value = None
                    bad.append("$: not JSON")
            bad += [f"depends: {x}" for x in (m if m is not None else [])]
            out.append((not bad, "; ".join(bad), canonical({"arguments": value, "id": i, "name": n, "result": c})))
        return pd.DataFrame(out, columns=["valid", "violations", "canonical"])

    called = F.col("status").isin("linked", "unanswered", "silent") | F.col("call_position").isNotNull() | F.col("arguments").isNotNull() | F.col("name").isNotNull()
    j = j.withColumn("x", check("call_id", "name", "arguments", "content", "missing", called))
    return j.select("call_id", "conversation", "level", "call_position", "result_position", "status", "x.valid", "x.violations", "copies", "x.canonical")


TURN_SCHEMA = {"type": "object", "required": ["role", "text"], "additionalProperties": False, "properties": {"role": {"enum": ["user"]}, "text": {"type": "string", "minLength": 1}}}
SYSTEM_SCHEMA = {"type": "object", "required": ["role", "text"], "additionalProperties": False, "properties": {"role": {"enum": ["system"]}, "text": {"type": "string"}}}
TURN_SCHEMAS = {"reply": TURN_SCHEMA, "context": SYSTEM_SCHEMA}


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every turn as a call or a result: assistant turns are results of the turn before, user turns calls of the tool `reply` that use the answer of the
    call two turns earlier, system turns calls of the silent tool `context`, turns of any other role calls of a tool of that name."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conversation"), F.col("turn").cast("long").alias("position"), "role", "text")
    name = lambda k: (F.col("position") - k).cast("string")
    tool = F.when(F.col("role") == "user", "reply").when(F.col("role") == "system", "context").otherwise(F.col("role"))
    uses = F.when((F.col("role") == "user") & (F.col("position") >= 2), F.array(name(2))).otherwise(F.array().cast("array<string>"))
    calls = c.filter("not (role <=> 'assistant')").select("conversation", name(0).alias("call_id"), "position", tool.alias("name"), F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("arguments"), uses.alias("depends"))
    results = c.filter("role = 'assistant'").select("conversation", name(1).alias("call_id"), "position", F.col("text").alias("content"))
    return calls, results
