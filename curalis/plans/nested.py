"""Nested documents bound to the driver's tables: graph references, canonical JSON and redaction at any depth, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from curalis.functions import columns as C
from curalis.functions.nested import canonical_json
from curalis.operators import graphs as G
from curalis.plans.bindings import _SQL_REDACT, _SQL_SECRETS, query

# a graph for each order, in words that both engines read alike: nested lists and objects, names in and out of the graph, faulty items, and now and then each bound
_MANY = "".join(f'{{"@id":"e{i:03d}"}},' for i in range(300))
_NAMES = "".join(f'{{"@id":"x{i:03d}"}},' for i in range(70))
GRAPH = f"""CASE WHEN k % 17 = 0 THEN '{{' WHEN k % 31 = 0 THEN '[' ELSE '{{"@context":"c",' END || '"@graph":[' ||
 CASE WHEN k % 7 = 0 THEN '' ELSE '{{"@id":"ro-crate-metadata.json","@type":' || CASE WHEN k % 23 = 0 THEN '"Thing"' ELSE '["A","CreativeWork"]' END || ',"about":{{"@id":"' || CASE WHEN k % 29 = 0 THEN 'gone' ELSE './' END || '"}}}},' END ||
 '{{"@id":"./","@type":' || CASE WHEN k % 37 = 0 THEN '7' ELSE '"Dataset"' END || ',"hasPart":[{{"@id":"a' || k % 5 || '"}},[{{"@id":"b"}},{{"deep":[[{{"x":{{"@id":"c' || k % 3 || '","own":{{"@id":"hidden"}}}}}}]]}}],{{"name":"n","author":{{"@id":"https://o.org/' || k % 10 || '"}}}}],"zz":null,"aa":{{"@id":"","q":{{"@id":"b"}}}},"@reverse":{{"@id":"never"}}}},' ||
 '{{"p":{{"@id":"./"}},"@id":"a1"}},{{"@id":"b","p":[1,2.5,true,"c0",[[]],{{}}]}},' ||
 CASE WHEN k % 4 = 0 THEN '{{"@id":"b","late":{{"@id":"late"}}}},7,{{"@id":""}},{{"@id":3}},' ELSE '' END ||
 CASE WHEN k % 41 = 0 THEN '{{"@id":"l","list":[' || repeat('{{"@id":"m"}},', 600) || '0],"more":[{_NAMES}0]}},' ELSE '' END ||
 CASE WHEN k % 170 = 3 THEN '{{"@id":"l2","list":[' || repeat('[0],', 5000) || '0],"z":{{"@id":"late"}}}},' ELSE '' END ||
 CASE WHEN k % 43 = 0 THEN '{_MANY}' ELSE '' END || '{{"@id":"c0"}}]' || CASE WHEN k % 31 = 0 THEN ']' ELSE '}}' END"""


def _keys(t):
    """The numbers of all orders, spread before documents are made of them."""
    o = t("orders")
    return o.select(F.col("o_orderkey").alias("k")).repartition(4 * o.sparkSession.sparkContext.defaultParallelism)


def _graphs(t):
    return _keys(t).select(F.col("k").cast("string").alias("graph"), F.expr(GRAPH).alias("json"))


# the same by recursion: an item's values are visited in document order, objects that name an id are not entered
_WALK = f"""WITH RECURSIVE g AS (SELECT CAST(o_orderkey AS VARCHAR) AS graph, o_orderkey AS k FROM orders),
j AS (SELECT graph, CASE WHEN json_valid(s) THEN CAST(s AS JSON) END AS v FROM (SELECT graph, {GRAPH} AS s FROM g)),
ok AS (SELECT graph, v FROM j WHERE json_type(v) = 'OBJECT' AND (v -> '$."@context"') IS NOT NULL AND json_type((v -> '$."@graph"')) = 'ARRAY'),
it AS (SELECT graph, e.id AS pos, e.value AS v, CASE WHEN json_type(e.value) = 'OBJECT' AND json_type((e.value -> '$."@id"')) = 'VARCHAR' THEN nullif((e.value ->> '$."@id"'), '') END AS id FROM ok, json_each((ok.v -> '$."@graph"')) e),
f AS (SELECT *, id IS NOT NULL AND row_number() OVER (PARTITION BY graph, id ORDER BY pos) = 1 AS first FROM it),
b AS (SELECT *, coalesce(sum(CAST(first AS INTEGER)) OVER (PARTITION BY graph ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= {G.MOST_ENTITIES} AS over FROM f),
ft AS (SELECT DISTINCT graph, CASE WHEN over THEN 'RO_CRATE_ENTITY_LIMIT' WHEN id IS NULL THEN 'RO_CRATE_ENTITY_MALFORMED' WHEN NOT first THEN 'RO_CRATE_DUPLICATE_ENTITY_ID' END AS l FROM b UNION SELECT graph, 'RO_CRATE_GRAPH_SHAPE_INVALID' FROM j WHERE graph NOT IN (SELECT graph FROM ok)),
en AS (SELECT graph, id, v FROM b WHERE first AND NOT over),
n(graph, id, property, path, v) AS (SELECT graph, en.id, e.key, [e.id], e.value FROM en, json_each(en.v) e WHERE e.key NOT LIKE '@%'
  UNION ALL SELECT graph, n.id, property, list_append(n.path, e.id), e.value FROM n, json_each(n.v) e WHERE json_type(n.v) = 'ARRAY' OR json_type(n.v) = 'OBJECT' AND NOT (json_type((n.v -> '$."@id"')) IS NOT DISTINCT FROM 'VARCHAR' AND (n.v ->> '$."@id"') <> '')),
o AS (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY id, property, path) AS r, CASE WHEN json_type(v) = 'OBJECT' AND json_type((v -> '$."@id"')) = 'VARCHAR' THEN nullif((v ->> '$."@id"'), '') END AS target FROM n),
rf AS (SELECT graph, o.id AS source, property, target, r, row_number() OVER (PARTITION BY graph ORDER BY r) AS q FROM o WHERE r <= {G.MOST_NODES} AND target IS NOT NULL),
rp AS (SELECT rf.*, en.id IS NOT NULL AS present FROM rf LEFT JOIN en ON en.graph = rf.graph AND en.id = rf.target)
"""


@query("s109_graph_references", _WALK + f"SELECT graph, source, property, target, present, count(*) AS times FROM rp WHERE q <= {G.MOST_REFERENCES} GROUP BY ALL")
def _(t):
    r = G.observe(_graphs(t)).select("graph", F.explode("references").alias("r")).select("graph", "r.*")
    return r.groupBy("graph", "source", "property", "target", "present").agg(F.count("*").alias("times"))


@query("s109_graph_limits", _WALK + f""", ty AS (SELECT graph, id, CASE WHEN json_type((v -> '$."@type"')) = 'VARCHAR' THEN [(v ->> '$."@type"')] WHEN json_type((v -> '$."@type"')) = 'ARRAY' THEN CAST((v -> '$."@type"') AS VARCHAR[]) ELSE [] END AS types, (v ->> '$.about."@id"') AS about FROM en),
ds AS (SELECT ok.graph, d.id, d.types, d.about, r.id AS root, r.types AS root_types FROM ok LEFT JOIN ty d ON d.graph = ok.graph AND d.id = 'ro-crate-metadata.json' LEFT JOIN ty r ON r.graph = d.graph AND r.id = d.about),
ls AS (SELECT graph, l FROM ft WHERE l IS NOT NULL UNION SELECT graph, 'RO_CRATE_VALUE_NODE_LIMIT' FROM o WHERE r > {G.MOST_NODES} UNION SELECT graph, 'RO_CRATE_REFERENCE_LIMIT' FROM rp WHERE q > {G.MOST_REFERENCES}
 UNION SELECT graph, CASE WHEN regexp_matches(target, '{G.SCHEME}') THEN 'RO_CRATE_EXTERNAL_REFERENCE_NOT_RETRIEVED' ELSE 'RO_CRATE_REFERENCE_UNRESOLVED' END FROM rp WHERE NOT present
 UNION SELECT graph, CASE WHEN regexp_matches(target, '{G.SCHEME}') THEN 'RO_CRATE_EXTERNAL_REFERENCE_LIMIT' ELSE 'RO_CRATE_UNRESOLVED_REFERENCE_LIMIT' END FROM rp WHERE NOT present GROUP BY graph, regexp_matches(target, '{G.SCHEME}') HAVING count(DISTINCT target) > 64
 UNION SELECT graph, CASE WHEN id IS NULL THEN 'RO_CRATE_DESCRIPTOR_MISSING' WHEN NOT list_contains(types, 'CreativeWork') THEN 'RO_CRATE_DESCRIPTOR_INVALID' WHEN root IS NULL THEN 'RO_CRATE_ROOT_MISSING' ELSE 'RO_CRATE_ROOT_INVALID' END FROM ds WHERE id IS NULL OR NOT list_contains(types, 'CreativeWork') OR root IS NULL OR NOT list_contains(root_types, 'Dataset')),
lg AS (SELECT graph, string_agg(l, ',' ORDER BY l) AS limitations FROM ls GROUP BY 1), c AS (SELECT graph, count(*) AS n FROM en GROUP BY 1), rc AS (SELECT graph, count(*) AS n FROM rp WHERE q <= {G.MOST_REFERENCES} GROUP BY 1)
SELECT j.graph, CASE WHEN ok.graph IS NULL THEN 'UNAVAILABLE' WHEN limitations IS NULL THEN 'OBSERVED' ELSE 'OBSERVED_WITH_LIMITATIONS' END AS status, CAST(coalesce(c.n, 0) AS INTEGER) AS entity_count, CAST(coalesce(rc.n, 0) AS INTEGER) AS reference_count, coalesce(limitations, '') AS limitations,
 CASE WHEN ds.id IS NOT NULL AND list_contains(ds.types, 'CreativeWork') AND list_contains(ds.root_types, 'Dataset') THEN ds.root END AS root_id
FROM j LEFT JOIN ok USING (graph) LEFT JOIN lg USING (graph) LEFT JOIN c USING (graph) LEFT JOIN rc USING (graph) LEFT JOIN ds USING (graph)""")
def _(t):
    return G.observe(_graphs(t)).select("graph", "status", "entity_count", "reference_count", F.array_join("limitations", ",").alias("limitations"), "root_id")


# a small crate for each order: sound but for what its number says
CRATE = f"""'{{"@context":"c","@graph":[{{"@id":"ro-crate-metadata.json","@type":"CreativeWork","about":{{"@id":"./"}}}},{{"@id":"./","@type":"Dataset","run":' || CASE k % 4 WHEN 0 THEN 'true' WHEN 1 THEN '"false"' ELSE 'false' END || ',"v":' || CASE WHEN k % 5 = 0 THEN '1' ELSE '"1"' END ||
 ',"conformsTo":' || CASE k % 6 WHEN 0 THEN '"prof"' WHEN 1 THEN '[]' WHEN 2 THEN '{{"@id":"prof"}}' ELSE '[{{"@id":"./"}},7,{{"@id":"prof"}}]' END || CASE WHEN k % 7 = 0 THEN ',"more":[[{{"@id":"gone"}}]]' ELSE '' END || '}},{{"@id":"prof"}}' ||
 CASE WHEN k % 9 = 0 THEN ',{{"@id":"./"}}' ELSE '' END || CASE WHEN k % 110 = 0 THEN ',{_MANY[:-1]}' ELSE '' END || ']}}'"""


@query("s130_crate_findings", """WITH c AS (SELECT o_orderkey AS k, [CASE WHEN k % 9 = 0 THEN 'RO_CRATE_DUPLICATE_ENTITY_ID' END, CASE WHEN k % 7 = 0 THEN 'LOCAL_REFERENCE_UNRESOLVED' END, CASE WHEN k % 9 > 0 AND k % 4 < 2 THEN 'EXECUTION_AUTHORITY_NOT_FALSE' END,
 CASE WHEN k % 9 > 0 AND k % 5 = 0 THEN 'EXPORT_SCHEMA_UNSUPPORTED' END, CASE WHEN k % 9 > 0 AND k % 6 < 2 THEN 'EVIDENCE_PROFILE_MISSING' END] AS f FROM orders),
s AS (SELECT k, list_sort(list_filter(f, lambda x: x IS NOT NULL)) AS f FROM c)
SELECT CAST(k AS VARCHAR) AS graph, CASE WHEN len(f) > 0 THEN 'NONCONFORMANT' WHEN k % 110 = 0 THEN 'INCOMPLETE' ELSE 'BOUNDED_PROFILE_CONFORMANT' END AS status, array_to_string(f, ',') AS findings FROM s""")
def _(t):
    g = _keys(t).select(F.col("k").cast("string").alias("graph"), F.expr(CRATE).alias("json"))
    r = G.crate_findings(g, "run", "v", "1", "prof")
    return r.select("graph", "status", F.array_join("findings", ",").alias("findings"))


def _records(t):
    """A nested record for each conversation: its turns behind lists and objects, names out of order."""
    c = t("conversations").select("conv_id", "turn", F.struct(F.col("turn").alias("turn"), F.struct(F.col("text").alias("text"), F.col("role").alias("role")).alias("body"), (F.col("turn") / 4).alias("at"), F.concat(F.lit("token="), F.col("role")).alias("auth")).alias("x"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "x"))).alias("x"))
    turns = F.transform("x", lambda x: F.array(x.x))
    return g.select("conv_id", F.to_json(F.struct(F.struct(turns.alias("turns"), F.lit(None).cast("string").alias("gone")).alias("zeta"), F.col("conv_id").cast("long").alias("id"), F.lit(True).alias("live")), {"ignoreNullFields": "false"}).alias("json"))


def _esc(x: str) -> str:
    """An SQL text as a JSON string in ASCII."""
    unit = r"""CASE WHEN ord(c) BETWEEN 32 AND 126 AND c NOT IN ('"', '\') THEN c WHEN c IN ('"', '\') THEN '\' || c WHEN c = chr(10) THEN '\n' WHEN c = chr(13) THEN '\r' WHEN c = chr(9) THEN '\t' WHEN c = chr(8) THEN '\b' WHEN c = chr(12) THEN '\f' WHEN ord(c) < 65536 THEN printf('\u%04x', ord(c)) ELSE printf('\u%04x\u%04x', 55296 + (ord(c) - 65536) // 1024, 56320 + (ord(c) - 65536) % 1024) END"""
    return f"""CASE WHEN {x} IS NULL THEN 'null' ELSE '"' || array_to_string(list_transform(string_split({x}, ''), lambda c: {unit}), '') || '"' END"""


def _record_sql(text: str, auth: str, categories: str) -> str:
    at = "CASE turn % 4 WHEN 0 THEN (turn // 4) || '.0' WHEN 1 THEN (turn // 4) || '.25' WHEN 2 THEN (turn // 4) || '.5' ELSE (turn // 4) || '.75' END"
    return f"""WITH t AS (SELECT conv_id, turn, '[{{"at":' || {at} || ',"auth":' || {auth} || ',"body":{{"role":' || {_esc('role')} || ',"text":' || {text} || '}},"turn":' || turn || '}}]' AS j, {categories} AS cats FROM conversations)
SELECT conv_id, sha256('{{"id":' || conv_id || ',"live":true,"zeta":{{"gone":null,"turns":[' || string_agg(j, ',' ORDER BY turn) || ']}}}}') AS canonical_sha256, array_to_string(list_sort(list_distinct(flatten(list(cats)))), ',') AS categories FROM t GROUP BY 1"""


@query("s114_canonical_nested", f"SELECT conv_id, canonical_sha256 FROM ({_record_sql(_esc('text'), _esc(chr(39) + 'token=' + chr(39) + ' || role'), '[]::VARCHAR[]')})")
def _(t):
    return canonical_json(_records(t), "json", "c").select("conv_id", F.sha2("c", 256).alias("canonical_sha256"))


@query("s101_redacted_metadata", _record_sql(_esc(f"({_SQL_REDACT})"), "'\"[REDACTED:TOKEN]\"'", f"list_append(list_filter([{_SQL_SECRETS}], lambda x: x IS NOT NULL), 'TOKEN')"))
def _(t):
    d = canonical_json(_records(t), "json", "c", change=C.redact, gather=("categories", C.secret_categories))
    return d.select("conv_id", F.sha2("c", 256).alias("canonical_sha256"), F.array_join("categories", ",").alias("categories"))
