"""Graphs, archives, scans and approvals bound to the driver's tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from curalis.operators import approvals as A, crates as G, scans as S
from curalis.operators.graphs import read_crates
from curalis.plans.bindings import W, inventory, query


def _graphs(t):
    """A graph for each order: a descriptor, a data set, its lines as files, and an action that uses them."""
    k = F.col("o_orderkey")
    key = k.cast("string")
    ref = lambda n: F.concat(F.lit('{"@id":"f'), n.cast("string"), F.lit('"}'))
    parts = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("n"))
    files = F.array_join(F.transform("n", lambda x: F.concat(F.lit('{"@id":"f'), x.cast("string"), F.lit('","@type":"File"}'))), ",")
    uses = F.array_join(F.transform(F.concat("n", F.array((k % 9 + 1).cast(t("lineitem").schema["l_linenumber"].dataType))), ref), ",")
    name = F.when(k % 3 == 0, "ro-crate-metadata.jsonld").otherwise("ro-crate-metadata.json")
    descriptor = F.when(k % 11 == 0, "").otherwise(F.concat(F.lit('{"@id":"'), name, F.lit('","@type":'), F.when(k % 7 == 0, '"Thing"').otherwise('["CreativeWork"]'), F.lit(',"about":{"@id":"'), F.when(k % 5 == 0, "gone").otherwise("./"), F.lit('"}},')))
    state = F.when(k % 4 == 0, '"http://schema.org/CompletedActionStatus"').when(k % 4 == 1, '{"@id":"FailedActionStatus"}').when(k % 4 == 2, '"Other"').otherwise("7")
    action = F.concat(F.lit('{"@id":"#a'), key, F.lit('","@type":["https://schema.org/CreateAction"],"actionStatus":'), state, F.lit(',"object":['), uses, F.when(k % 2 == 0, ',"loose"').otherwise(""), F.lit('],"result":{"@id":"f1"}}'))
    data = F.concat(F.lit('{"@id":"./","@type":"'), F.when(k % 13 == 0, "Person").otherwise("Dataset"), F.lit('"},'))
    j = F.concat(F.lit('{"@graph":['), descriptor, data, F.lit('5,{"@id":""},'), files, F.lit(","), action, F.lit("]}"))
    return t("orders").join(parts, "o_orderkey").select(key.alias("graph"), j.alias("json"))


_GR = """WITH g AS (SELECT o_orderkey AS k, list_distinct(list(l_linenumber)) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
r AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'RO_CRATE_DESCRIPTOR_MISSING' WHEN k % 7 = 0 THEN 'RO_CRATE_DESCRIPTOR_INVALID' WHEN k % 5 = 0 THEN 'RO_CRATE_ROOT_MISSING' WHEN k % 13 = 0 THEN 'RO_CRATE_ROOT_INVALID' END AS limitation FROM g) """


@query("s140_graph_roots", _GR + "SELECT k::VARCHAR AS graph, CASE WHEN k % 11 > 0 THEN CASE WHEN k % 3 = 0 THEN 'ro-crate-metadata.jsonld' ELSE 'ro-crate-metadata.json' END END AS descriptor_id, CASE WHEN limitation IS NULL THEN './' END AS root_id, limitation FROM r")
def _(t):
    return G.roots(read_crates(_graphs(t)))


@query("s108_graph_actions", _GR + """SELECT k::VARCHAR AS graph, '#a' || k AS action_id, CASE k % 4 WHEN 0 THEN 'COMPLETED_DECLARED' WHEN 1 THEN 'FAILED_DECLARED' ELSE 'UNRESOLVED' END AS status,
 array_to_string(list_transform(list_sort(list_distinct(list_append(n, (k % 9 + 1)))), lambda x: 'f' || x), ',') AS input_ids, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS malformed_input_count, CASE WHEN list_contains(n, (k % 9 + 1)) THEN '' ELSE 'f' || (k % 9 + 1) END AS unresolved_input_ids,
 'f1' AS output_ids, CASE WHEN list_contains(n, 1) THEN '' ELSE 'f1' END AS unresolved_output_ids FROM r WHERE limitation IS NULL""")
def _(t):
    a = G.actions(read_crates(_graphs(t)))
    ids = ["input_ids", "unresolved_input_ids", "output_ids", "unresolved_output_ids"]
    return a.select("graph", "action_id", "status", "malformed_input_count", *[F.array_join(c, ",").alias(c) for c in ids])


@query("s145_action_summary", _GR + """, dd AS (SELECT l_orderkey AS k, count(*) > count(DISTINCT l_linenumber) AS dup FROM lineitem GROUP BY 1)
SELECT k::VARCHAR AS graph, CASE WHEN limitation IS NOT NULL THEN 'UNAVAILABLE' ELSE 'OBSERVED_WITH_LIMITATIONS' END AS status, CASE WHEN limitation IS NULL THEN 1 ELSE 0 END AS actions, 0 AS omitted,
 array_to_string(list_sort(list_filter([limitation, 'RO_CRATE_ENTITY_MALFORMED', CASE WHEN dup THEN 'RO_CRATE_DUPLICATE_ENTITY_ID' END, CASE WHEN limitation IS NULL AND k % 2 = 0 THEN 'WORKFLOW_RUN_ACTION_INPUT_MALFORMED' END, CASE WHEN limitation IS NULL AND k % 4 >= 2 THEN 'WORKFLOW_RUN_ACTION_STATUS_UNRESOLVED' END], lambda x: x IS NOT NULL)), ',') AS limitations FROM r JOIN dd USING (k)""")
def _(t):
    g = _graphs(t).withColumn("json", F.concat(F.lit('{"@context":1,'), F.substring("json", F.lit(2), F.length("json"))))
    return G.action_summary(read_crates(g)).withColumn("limitations", F.array_join("limitations", ","))


@query("s119_archive_members", """WITH m AS (SELECT l_orderkey AS archive, l_linenumber AS ordinal, CASE WHEN l_partkey % 31 = 0 THEN '../x' || l_linenumber WHEN l_partkey % 29 = 0 THEN 'D/F1' ELSE 'd/f' || l_linenumber END AS name, CASE WHEN l_suppkey % 10 = 3 AND l_linenumber = 2 THEN 9 ELSE 8 END AS flag, CASE WHEN l_partkey % 37 = 0 THEN 1 ELSE 100 END AS c, 101 AS s, l_partkey AS crc FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2)),
w AS (SELECT *, CASE WHEN name LIKE '../%' THEN 'ARCHIVE_PATH_UNSAFE' WHEN row_number() OVER (PARTITION BY archive, lower(name) ORDER BY ordinal) > 1 THEN 'ARCHIVE_DUPLICATE_MEMBER' WHEN flag = 9 THEN 'ARCHIVE_ENCRYPTED' WHEN c = 1 THEN 'RESOURCE_LIMIT_REACHED' END AS why FROM m),
g AS (SELECT archive, arg_min(why, ordinal) FILTER (why IS NOT NULL) AS limitation, count(*) AS n, 'zip-manifest-v1:' || sha256('[' || string_agg('{"crc":' || crc || ',"name":"' || name || '","size":' || s || '}', ',' ORDER BY name) || ']') AS id FROM w GROUP BY 1)
SELECT archive, CASE WHEN limitation IS NULL THEN 'INSPECTED' ELSE 'LIMITED' END AS status, limitation, CASE WHEN limitation IS NULL THEN n END AS member_count, CASE WHEN limitation IS NULL THEN id END AS member_manifest_id FROM g""")
def _(t):
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    name = F.when(p % 31 == 0, F.concat(F.lit("../x"), n.cast("string"))).when(p % 29 == 0, "D/F1").otherwise(F.concat(F.lit("d/f"), n.cast("string")))
    m = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey")).select(F.col("l_orderkey").alias("archive"), n.alias("ordinal"), name.alias("name"), F.when((F.col("l_suppkey") % 10 == 3) & (n == 2), 9).otherwise(8).alias("flag_bits"), F.when(p % 37 == 0, 1).otherwise(100).alias("compress_size"), F.lit(101).alias("file_size"), p.alias("crc"))
    return G.archive_members(m)


@query("s115_code_fences", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '`' || p_brand || '`' WHEN 1 THEN '```a``' || p_brand || '```' WHEN 2 THEN '`` `' || p_brand || ' ``' ELSE '`q\\\"\\n\\u00e9`' END AS code FROM part")
def _(t):
    k = F.col("p_partkey") % 4
    x = F.when(k == 0, F.col("p_brand")).when(k == 1, F.concat(F.lit("a``"), "p_brand")).when(k == 2, F.concat(F.lit("`"), "p_brand")).otherwise('q"\né')
    return t("part").select("p_partkey", G.code_fence(x).alias("code"))


@query("s004_link_warnings", """SELECT 'd/s/l' || p_partkey AS path, 'sha256-symlink-target-v1:' || sha256(CASE p_partkey % 9 WHEN 0 THEN '/etc/x' WHEN 1 THEN '../f' WHEN 2 THEN '../../../f' WHEN 3 THEN 'none' WHEN 4 THEN '../f/g' WHEN 5 THEN '../k/f' WHEN 6 THEN './/..' WHEN 7 THEN '../none/../../../x' ELSE '../../d/s/../f' END) AS fingerprint,
 CASE p_partkey % 9 WHEN 0 THEN 'SYMLINK_TARGET_OUTSIDE_ROOT' WHEN 2 THEN 'SYMLINK_TARGET_OUTSIDE_ROOT' WHEN 3 THEN 'SYMLINK_TARGET_MISSING' WHEN 4 THEN 'SYMLINK_TARGET_MISSING' WHEN 5 THEN 'SYMLINK_TARGET_OUTSIDE_ROOT' WHEN 7 THEN 'SYMLINK_TARGET_MISSING' END AS warning FROM part""")
def _(t):
    targets = ["/etc/x", "../f", "../../../f", "none", "../f/g", "../k/f", ".//..", "../none/../../../x", "../../d/s/../f"]
    p = t("part").select(F.concat(F.lit("d/s/l"), F.col("p_partkey").cast("string")).alias("path"), F.get(F.array(*map(F.lit, targets)), (F.col("p_partkey") % 9).cast("int")).alias("target"))
    tree = p.sparkSession.createDataFrame([("d", "DIRECTORY"), ("d/s", "DIRECTORY"), ("d/f", "REGULAR_FILE"), ("d/k", "SYMLINK")], "path string, object_type string")
    return S.link_warnings(p, tree)


@query("s005_boundaries", W + """SELECT path, NULL AS warning FROM inv WHERE NOT path LIKE 'src1/%' AND NOT path LIKE 'src2/de/%' AND NOT path LIKE 'src3/%'
UNION ALL SELECT * FROM (VALUES ('src1', 'NESTED_REPOSITORY_BOUNDARY'), ('src1/.git', 'NESTED_REPOSITORY_BOUNDARY'), ('src2/de', 'PYTHON_VIRTUAL_ENVIRONMENT_BOUNDARY_NOT_RECURSED'), ('src3', 'NESTED_REPOSITORY_BOUNDARY'), ('src3/.git', 'NESTED_REPOSITORY_BOUNDARY'), ('.git', 'PROTECTED_GIT_CONTROL'))""")
def _(t):
    i = inventory(t).select("path", F.lit("REGULAR_FILE").alias("object_type"))
    more = [("src1", "DIRECTORY"), ("src1/.git", "DIRECTORY"), ("src1/.git/config", "REGULAR_FILE"), ("src2/de", "DIRECTORY"), ("src2/de/pyvenv.cfg", "REGULAR_FILE"), ("src2/de/x/.git", "DIRECTORY"), ("src3", "DIRECTORY"), ("src3/.git", "REGULAR_FILE"), ("src3/pyvenv.cfg", "REGULAR_FILE"), (".git", "DIRECTORY"), (".git/HEAD", "REGULAR_FILE")]
    return S.boundaries(i.unionByName(i.sparkSession.createDataFrame(more, "path string, object_type string")))


@query("s066_marker_counts", "WITH m AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'statepoint' WHEN 1 THEN 'job_document' WHEN 2 THEN 'project_config' WHEN 3 THEN 'statepoint_cache' WHEN 4 THEN 'project_document' END AS category, p_partkey || CASE p_partkey % 7 WHEN 0 THEN '/signac_statepoint.json' WHEN 1 THEN '/signac_job_document.json' WHEN 2 THEN '/.signac/config' WHEN 3 THEN '/.signac/statepoint_cache.json.gz' ELSE '/signac_project_document.json' END AS path FROM part WHERE p_partkey % 7 < 5 AND p_partkey % 10 > 0), f AS (SELECT category, row_number() OVER (ORDER BY path) AS r FROM m) SELECT category, count(*) AS files, count(*) FILTER (r <= 256) AS markers FROM f GROUP BY 1")
def _(t):
    names = ["/signac_statepoint.json", "/signac_job_document.json", "/.signac/config", "/.signac/statepoint_cache.json.gz", "/signac_project_document.json", "/signac.rc", "/x"]
    p = t("part").select(F.concat(F.col("p_partkey").cast("string"), F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % 7).cast("int"))).alias("path"), F.when(F.col("p_partkey") % 10 == 0, "SYMLINK").otherwise("REGULAR_FILE").alias("object_type"))
    return S.signac_counts(p)


@query("s032_roles", W + """SELECT path, CASE WHEN doc_id % 6 = 0 THEN 'HISTORICAL_EVIDENCE' WHEN doc_id % 6 = 2 THEN 'REQUIRED_COMPATIBILITY' WHEN doc_id % 4 = 1 AND doc_id % 3 = 0 THEN 'ACTIVE_MAINLINE' ELSE 'UNRESOLVED' END AS role,
 CASE WHEN doc_id % 6 IN (0, 2) THEN 'DECLARED_ROLE_NOT_EXECUTION_AUTHORITY' WHEN doc_id % 4 = 1 AND doc_id % 3 = 0 THEN 'PYTHON_SYNTAX_NOT_RUNTIME_BEHAVIOR' ELSE 'NO_ROLE_EVIDENCE' END AS limitation FROM inv WHERE doc_id % 10 <> 7""")
def _(t):
    i, k = inventory(t).withColumn("object_type", F.when(F.col("doc_id") % 10 == 7, "SYMLINK").otherwise("REGULAR_FILE")), F.col("doc_id")
    early = i.filter(k % 2 == 0).select("path", F.when(k % 6 == 4, "AUTHOR").otherwise("REQUIRED_COMPATIBILITY").alias("role"), F.lit(1).alias("ordinal"))
    late = i.filter(k % 6 == 0).select("path", F.lit("HISTORICAL_EVIDENCE").alias("role"), F.lit(2).alias("ordinal"))
    return S.roles(i, early.unionByName(late), i.select("path", (k % 4 == 1).alias("has_main_guard")), i.select("path", F.when(k % 3 == 0, "ACTIVE_MAINLINE").otherwise("REQUIRED").alias("status")))


@query("s128_approval_errors", """WITH a AS (SELECT o_custkey AS k, o_orderkey AS a, o_orderkey % 8 AS x, o_orderkey % 1000 AS b FROM orders),
e AS (SELECT k, count(*) FILTER (a % 9 > 0) AS n, sum(b) FILTER (a % 9 > 0) AS b, count(*) FILTER (a % 9 = 0) AS lost, bool_or(x = 1) FILTER (a % 9 > 0) AS e1, bool_or(x = 2) FILTER (a % 9 > 0) AS e2, bool_or(x = 3) FILTER (a % 9 > 0) AS e3, bool_or(x = 4) FILTER (a % 9 > 0) AS e4, bool_or(x = 5) FILTER (a % 9 > 0) AS e5, bool_or(x = 6) FILTER (a % 9 > 0) AS e6 FROM a GROUP BY 1)
SELECT c_custkey AS plan_key, concat_ws(',', CASE WHEN e2 THEN 'ACTION_UNSUPPORTED_TYPE' END, CASE WHEN c_custkey % 11 = 0 THEN 'APPROVAL_BUDGET_EXPANSION' END, CASE WHEN c_custkey % 5 = 0 THEN 'APPROVAL_MALFORMED' END, CASE WHEN c_custkey % 7 = 0 THEN 'APPROVAL_PLAN_HASH_MISMATCH' END, CASE WHEN c_custkey % 6 = 0 THEN 'APPROVAL_POLICY_HASH_MISMATCH' END, CASE WHEN c_custkey % 5 = 1 THEN 'APPROVAL_SCOPE_EXPANSION' END, CASE WHEN lost > 0 THEN 'APPROVAL_UNKNOWN_ACTION' END,
 CASE WHEN n > 12 THEN 'BUDGET_ACTION_COUNT' END, CASE WHEN b > 5000 THEN 'BUDGET_AFFECTED_BYTES' END, CASE WHEN n > 10 THEN 'BUDGET_BLAST_RADIUS' END, CASE WHEN e6 THEN 'BUNDLE_PARTIAL_MOVEMENT' END, CASE WHEN e5 THEN 'CROSS_FILESYSTEM_MOVE_UNSUPPORTED' END, CASE WHEN e3 THEN 'PATH_PROTECTED' END, CASE WHEN e1 THEN 'PATH_TRAVERSAL' END, CASE WHEN e4 THEN 'RETENTION_CLOSURE_INCOMPLETE' END) AS errors FROM customer LEFT JOIN e ON c_custkey = k""")
def _(t):
    c, key = t("customer"), F.col("c_custkey")
    plan = F.concat(F.lit("plan"), key.cast("string"))
    hashes = [F.lit("h").alias(h) for h in A.BOUND]
    plans = c.select(key.alias("plan_key"), plan.alias("plan_text"), plan.alias("plan_id"), F.array(F.lit("r1")).alias("recommendation_ids"), *hashes, F.when(key % 11 == 0, 11).otherwise(20).alias("max_actions"), F.lit(5000).alias("max_affected_bytes"), F.lit(10).alias("max_blast_radius"))
    o = t("orders").select(F.col("o_custkey").alias("plan_key"), F.col("o_orderkey").cast("string").alias("action_id"), F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 1000).cast("long").alias("affected_bytes"))
    ids = o.groupBy("plan_key").agg(F.collect_list("action_id").alias("ids"))
    fields = F.array(*map(F.lit, A.REQUIRED))
    fields = F.when(key % 5 == 0, F.slice(fields, 1, 5)).when(key % 5 == 1, F.concat(fields, F.array(F.lit("wildcards")))).otherwise(fields)
    ap = c.join(ids, key == ids.plan_key, "left").select(key.alias("plan_key"), fields.alias("fields"), F.lit("v1").alias("approval_schema_version"), F.concat(F.lit("sha256:"), F.when(key % 7 == 0, F.lit("x")).otherwise(F.sha2(plan, 256))).alias("approved_plan_sha256"), plan.alias("approved_plan_id"), F.coalesce("ids", F.array().cast("array<string>")).alias("approved_action_ids"), F.array(F.lit("r1")).alias("approved_recommendation_ids"),
        *hashes, *[F.when((key % 6 == 0) & F.lit(h.startswith("effective")), "y").otherwise("h").alias("context_" + h) for h in A.BOUND], F.lit(12).alias("max_actions"), F.lit(5000).alias("max_affected_bytes"), F.lit(10).alias("max_blast_radius"))
    x = F.col("k") % 8
    acts = o.filter("k % 9 > 0").select("plan_key", "action_id", F.when(x == 2, "DELETE").otherwise("QUARANTINE").alias("type"), F.lit(True).alias("executable_in_supported_scope"), F.lit(True).alias("approval_required"), F.lit("GIT_WORKTREE").alias("repository_mode"),
        F.when(x == 1, "a/../b").when(x == 3, ".git/config").otherwise("a/b").alias("source_path"), F.concat(F.lit(A.MANAGED + "/quarantine/plan"), F.col("plan_key").cast("string"), F.when(x == 2, "/../q").otherwise("/q")).alias("destination_path"), F.lit(False).alias("source_external_symlink"), F.lit(False).alias("destination_exists"), F.lit(False).alias("case_collision"), (x != 5).alias("same_filesystem"), "affected_bytes",
        F.lit(True).alias("retention_closure_satisfied"), F.when(x == 4, F.array(F.lit(""))).otherwise(F.array(F.lit("e"))).alias("retention_evidence_ids"), F.array("action_id").alias("affected_artifact_ids"), F.lit(True).alias("bundle_complete"), F.when(x == 6, F.array("action_id", F.lit("other"))).otherwise(F.array("action_id")).alias("bundle_member_artifact_ids"))
    acts = acts.withColumn("destination_path", F.when(F.col("type") == "DELETE", F.lit("q/x")).otherwise(F.col("destination_path")))
    return A.approval_errors(ap, plans, acts, "v1").withColumn("errors", F.array_join("errors", ","))


@query("s141_records_digest", """SELECT c_nationkey, 'sha256:' || sha256('[' || string_agg('{"id":' || c_custkey || '}', ',' ORDER BY c_custkey) || ']') AS records_sha256 FROM customer GROUP BY 1""")
def _(t):
    return A.records_digest(t("customer").select("c_nationkey", "c_custkey", F.concat(F.lit('{"id":'), F.col("c_custkey").cast("string"), F.lit("}")).alias("j")), "c_nationkey", "c_custkey", "j")


@query("s150_brief_binding", """SELECT p_partkey, '{"json_file":"curation-brief.json","json_sha256":"' || sha256(p_name) || '","markdown_file":"curation-brief.md","markdown_sha256":"' || sha256(p_brand) || '"}' AS curation_brief FROM part""")
def _(t):
    return t("part").select("p_partkey", A.binding(F.col("p_name"), F.col("p_brand")).alias("curation_brief"))


@query("s151_selected_cases", W + """, s AS (SELECT source, path, row_number() OVER (PARTITION BY source ORDER BY path) AS r, dense_rank() OVER (ORDER BY source) AS n FROM inv), d AS (SELECT content_id, min(artifact_id) AS a, min(source) AS source FROM inv GROUP BY 1 HAVING count(*) > 1),
z AS (SELECT 'wave3-inventory-' || source || '-' || lpad(r::VARCHAR, 3, '0') AS case_id, source, 'ASSERTED' AS prediction FROM s WHERE r <= CASE WHEN n <= 3 THEN 6 ELSE 5 END UNION ALL SELECT 'wave3-inventory-' || source || '-control-00' || k, source, 'ABSTAINED' FROM (SELECT DISTINCT source FROM inv), range(1, 3) t(k)
UNION ALL SELECT 'wave3-duplicate-' || source || '-' || split_part(a, '_', -1), source, 'ASSERTED' FROM d UNION ALL SELECT 'wave3-duplicate-' || source || '-control-00' || k, source, 'ABSTAINED' FROM (SELECT source FROM inv GROUP BY 1 HAVING count(DISTINCT content_id) >= 4), range(1, 3) t(k)) SELECT case_id, source, prediction FROM z""")
def _(t):
    i = inventory(t)
    d = i.groupBy("content_id").agg(F.count("*").alias("n"), F.min("artifact_id").alias("relationship_id"), F.min("source").alias("source")).filter("n > 1")
    return A.selected_cases(i.select("source", "path", "artifact_id", "content_id"), d.select("source", "relationship_id"), "source", 5, 1, 3, 2, "__negative_control__").select("case_id", "source", "prediction")
