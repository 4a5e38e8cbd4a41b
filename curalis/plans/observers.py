"""Parsers, declarations, bundles and reports bound to the driver's tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from curalis.functions import columns as C
from curalis.operators import decisions, observers as O
from curalis.plans.bindings import W, inventory, query


def _kinds(t):
    """The inventory with types, modes and some files at the root."""
    k = F.col("doc_id")
    path = F.when(k % 40 == 0, F.concat(F.lit("doc"), k.cast("string"), F.lit(".md"))).otherwise(F.col("path"))
    mode = F.when(k % 29 == 0, 0o040755).when(k % 31 == 0, 0o120777).when(k % 37 == 0, 0o010644).otherwise(0o100644)
    return inventory(t).withColumn("path", path).withColumn("mode", mode).withColumn("object_type", O.object_type(mode))


_K = W + ", kk AS (SELECT * REPLACE (CASE WHEN doc_id % 40 = 0 THEN 'doc' || doc_id || '.md' ELSE path END AS path), CASE WHEN doc_id % 29 = 0 THEN 'DIRECTORY' WHEN doc_id % 31 = 0 THEN 'SYMLINK' WHEN doc_id % 37 = 0 THEN 'SPECIAL_FILE' ELSE 'REGULAR_FILE' END AS object_type FROM inv) "


@query("s006_object_types", _K + "SELECT object_type, count(*) AS n FROM kk GROUP BY 1")
def _(t):
    return _kinds(t).groupBy("object_type").agg(F.count("*").alias("n"))


@query("s018_regular_files", _K + "SELECT artifact_id FROM kk WHERE object_type = 'REGULAR_FILE'")
def _(t):
    return _kinds(t).filter("object_type = 'REGULAR_FILE'").select("artifact_id")


@query("s019_near_eligible", _K + "SELECT artifact_id FROM kk WHERE object_type = 'REGULAR_FILE' AND regexp_extract(lower(path), '(\\.[^./]*)$', 1) IN ('.csv', '.json', '.md', '.py', '.rst', '.txt', '.yaml', '.yml') AND size_bytes * 100 <= 1048576")
def _(t):
    return _kinds(t).filter(O.near_eligible(F.col("object_type"), F.col("path"), F.col("size_bytes") * 100)).select("artifact_id")


@query("s020_selectable", _K + "SELECT artifact_id FROM kk WHERE object_type = 'REGULAR_FILE' AND doc_id % 3 > 0 AND doc_id % 8 > 0 AND doc_id % 5 > 0")
def _(t):
    k = F.col("doc_id")
    d = _kinds(t).withColumn("profile_eligibility", F.when(k % 3 > 0, "ELIGIBLE").otherwise("NOT_APPLICABLE")).withColumn("content_id", F.when(k % 8 > 0, F.col("content_id"))).withColumn("warnings", F.when(k % 5 == 0, F.array(F.lit("W"))).when(k % 2 == 0, F.array().cast("array<string>")))
    return O.selectable(d).select("artifact_id")


@query("s022_safe_tokens", "SELECT p_partkey, CASE WHEN regexp_full_match(p_brand || CASE WHEN p_size % 3 = 0 THEN ' x' ELSE '' END, '[A-Za-z0-9][A-Za-z0-9._#-]{0,63}') THEN p_brand END AS token FROM part")
def _(t):
    return t("part").select("p_partkey", C.safe_token(F.concat("p_brand", F.when(F.col("p_size") % 3 == 0, " x").otherwise("")), r"^[A-Za-z0-9][A-Za-z0-9._#-]{0,63}$").alias("token"))


_PATHS = "SELECT p_partkey AS k, CASE p_partkey % 9 WHEN 0 THEN 'a/' || p_type WHEN 1 THEN '../' || p_type WHEN 2 THEN 'a//b' WHEN 3 THEN './x' WHEN 4 THEN '/abs' WHEN 5 THEN 'c:\\x' WHEN 6 THEN '../../../x' WHEN 7 THEN '' ELSE 'a/../b/./' || p_type END AS path FROM part"


def _paths(t):
    b, k = F.col("p_type"), F.col("p_partkey") % 9
    some = ["a/", "../", "a//b", "./x", "/abs", "c:\\x", "../../../x", ""]
    p = F.concat(F.lit("a/../b/./"), b)
    for i, x in enumerate(some):
        p = F.when(k == i, F.concat(F.lit(x), b) if i < 2 else F.lit(x)).otherwise(p)
    return t("part").select(F.col("p_partkey").alias("k"), p.alias("path"))


@query("s023_safe_paths", f"WITH p AS ({_PATHS}) SELECT k, path <> '' AND NOT regexp_matches(path, '[\\\\\\x00-\\x1F]') AND NOT list_has_any(string_split(path, '/'), ['', '.', '..']) AS safe FROM p")
def _(t):
    return _paths(t).select("k", C.safe_path(F.col("path")).alias("safe"))


@query("s023_resolved_paths", f"WITH p AS ({_PATHS}) SELECT k, CASE k % 9 WHEN 0 THEN 'data/x/' || path WHEN 1 THEN 'data/' || substr(path, 4) WHEN 2 THEN 'data/x/a/b' WHEN 3 THEN 'data/x/x' WHEN 8 THEN 'data/x/b/' || substr(path, 10) END AS resolved FROM p")
def _(t):
    return _paths(t).select("k", C.resolve_path(F.lit("data/x/datapackage.json"), F.col("path")).alias("resolved"))


@query("s024_identifiers", "SELECT doc_id, doc_id % 3 = 0 AS is_sha256, doc_id % 3 = 1 AS is_swhid FROM documents")
def _(t):
    h, k = F.sha2("text", 256), F.col("doc_id") % 3
    x = F.when(k == 0, F.concat(F.lit("sha256:"), h)).when(k == 1, F.concat(F.lit("swh:1:rev:"), F.substring(h, 1, 40))).otherwise(F.concat(F.lit("sha256:"), F.upper(h), F.lit("G")))
    return t("documents").select("doc_id", C.is_sha256(x).alias("is_sha256"), C.is_swhid(x).alias("is_swhid"))


@query("s025_protected", W + "SELECT path, path LIKE 'src1/%' OR path LIKE 'src10/de/%' AS protected FROM inv")
def _(t):
    return inventory(t).select("path", C.protected(F.col("path"), ["src1", "src10/de"]).alias("protected"))


@query("s053_top_level_folders", _K + "SELECT CASE WHEN path LIKE '%/%' THEN split_part(path, '/', 1) END AS folder, sum(CASE WHEN object_type = 'REGULAR_FILE' THEN size_bytes ELSE 0 END)::BIGINT AS bytes, count(*) FILTER (object_type = 'REGULAR_FILE') AS files, count(*) AS items FROM kk GROUP BY 1")
def _(t):
    return O.folder_summary(_kinds(t))


@query("s084_folder_table", _K + "SELECT *, greatest(count(*) OVER () - 7, 0) AS omitted FROM (SELECT split_part(path, '/', 1) AS folder, sum(CASE WHEN object_type = 'REGULAR_FILE' THEN size_bytes ELSE 0 END)::BIGINT AS bytes, count(*) FILTER (object_type = 'REGULAR_FILE') AS files, count(*) AS items FROM kk WHERE path LIKE '%/%' GROUP BY 1) ORDER BY bytes DESC, folder LIMIT 7")
def _(t):
    return O.folder_table(_kinds(t), 7)


_CO = _K + ", co AS (SELECT count(*) AS files, sum(size_bytes)::BIGINT AS bytes, arg_min(artifact_id, (-size_bytes, path)) AS largest_id, arg_min(path, (-size_bytes, path)) AS largest_path, max(size_bytes) AS largest_bytes FROM kk WHERE object_type = 'REGULAR_FILE') "


@query("s054_checkout_summary", _CO + "SELECT * FROM co")
def _(t):
    return O.checkout_summary(_kinds(t))


@query("s055_concern_ratios", _CO + "SELECT round(files / 50000, 6) AS current_checkout_file_count, round(bytes / 1000000000, 6) AS current_checkout_size_bytes, round(largest_bytes / 10000000, 6) AS max_regular_file_size_bytes, round(1234567 / 500000, 6) AS reachable_commit_count, round(77 / 25000, 6) AS reference_count FROM co")
def _(t):
    s = O.checkout_summary(_kinds(t))
    r = O.concern_ratios(current_checkout_file_count=F.col("files"), current_checkout_size_bytes=F.col("bytes"), max_regular_file_size_bytes=F.col("largest_bytes"), reachable_commit_count=F.lit(1234567), reference_count=F.lit(77))
    return s.select(r.alias("r")).select("r.*")


@query("s104_count_objects", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size END AS loose_objects, CASE WHEN p_partkey % 5 = 0 THEN p_size * 1024 END AS packed_size_bytes, p_partkey % 5 = 0 AS parsed FROM part")
def _(t):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    lines = lambda *x: F.concat_ws("\n", *x)
    base = [F.concat(F.lit("count: "), n), F.lit("size: 4"), F.lit("in-pack: 7"), F.lit("packs: 1"), F.concat(F.lit("size-pack: "), n), F.lit("prune-packable: 0"), F.lit("garbage: 0")]
    last, alt = F.lit("size-garbage: 0"), F.lit("alternate: /x")
    text = F.when(k == 0, lines(*base, last, alt)).when(k == 1, lines(*base)).when(k == 2, lines(*base, last, F.lit("packs: 1"))).when(k == 3, lines(*base, F.lit("size-garbage: 18014398509481985"))).otherwise(lines(*base, last, F.lit("other: 1")))
    return t("part").select("p_partkey", O.parse_count_objects(text).alias("c")).select("p_partkey", F.col("c.loose_objects").cast("long").alias("loose_objects"), F.col("c.packed_size_bytes").cast("long").alias("packed_size_bytes"), F.col("c").isNotNull().alias("parsed"))


@query("s103_commit_history", "SELECT o_custkey, CASE WHEN bool_or(o_orderkey % 50 = 0) THEN NULL ELSE count(*) END AS commits, CASE WHEN bool_or(o_orderkey % 50 = 0) THEN NULL ELSE (count(*) FILTER (o_orderkey % 2 = 0) * 2)::BIGINT END AS parents, CASE WHEN bool_or(o_orderkey % 50 = 0) THEN NULL ELSE sum(o_orderkey)::BIGINT END AS times FROM orders GROUP BY 1")
def _(t):
    k, h = F.col("o_orderkey"), F.sha1(F.col("o_orderkey").cast("string"))
    one = F.concat(h, F.lit("\0"), F.when(k % 2 == 0, F.concat(h, F.lit(" "), h)).otherwise(""), F.lit("\0"), F.when(k % 50 == 0, "soon").otherwise(k.cast("string")), F.lit("\0"))
    g = t("orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(one), "").alias("log")).select("o_custkey", O.parse_history(F.col("log")).alias("h"))
    total = lambda f: F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + f(x))
    return g.select("o_custkey", F.size("h").cast("long").alias("commits"), total(lambda x: F.size(x["parent_ids"]).cast("long")).alias("parents"), total(lambda x: x["committed_at"]).alias("times")).withColumn("commits", F.when(F.col("parents").isNotNull(), F.col("commits")))


@query("s106_source_types", "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'SCOPED_RULE' WHEN 1 THEN 'DELIVERY_WIRING' WHEN 2 THEN 'DELIVERY_WIRING' WHEN 3 THEN 'DOCUMENTATION' WHEN 4 THEN 'DOCUMENTATION' WHEN 5 THEN 'DOCUMENTATION' WHEN 6 THEN 'DOCUMENTATION' END AS source_type FROM part")
def _(t):
    names = ["x/AGENTS.md", ".github/workflows/ci.yml", "a/Dockerfile", "README.rst", "a/Contributing.md", "docs/a.txt", "package.json", "src/main.py"]
    return t("part").select("p_partkey", O.source_type(F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % 8).cast("int"))).alias("source_type"))


_CLAIMS = W + """, dc AS (SELECT doc_id, path AS target, CASE doc_id % 4 WHEN 0 THEN 'README.md' WHEN 1 THEN source || '/AGENTS.md' WHEN 2 THEN 'docs/plan' || (doc_id % 10) || '.md' ELSE 'src/notes.py' END AS source_path, CASE doc_id % 5 WHEN 0 THEN 'ACTIVE_MAINLINE' WHEN 1 THEN 'REQUIRED_COMPATIBILITY' WHEN 2 THEN 'HISTORICAL_EVIDENCE' ELSE 'REQUIRED' END AS status FROM inv WHERE doc_id % 6 = 0 OR doc_id % 35 = 1),
ic AS (SELECT source_path, CASE WHEN source_path LIKE '%AGENTS.md' THEN 'SCOPED_RULE' ELSE 'DOCUMENTATION' END AS source_type, target AS path, status FROM dc WHERE source_path NOT LIKE 'src/%') """


def _claims(t):
    i, k = inventory(t), F.col("doc_id")
    own = F.regexp_replace("path", "^[^/]*/", "")
    src = F.when(k % 4 == 0, "README.md").when(k % 4 == 1, F.concat("source", F.lit("/AGENTS.md"))).when(k % 4 == 2, F.concat(F.lit("docs/plan"), (k % 10).cast("string"), F.lit(".md"))).otherwise("src/notes.py")
    label = F.when(k % 5 == 0, "Entry point: ").when(k % 5 == 1, "retain-compatibility : ").when(k % 5 == 2, "  ARCHIVE:").otherwise("Keep: ")
    line = F.concat(label, F.when(k % 4 == 1, own).otherwise(F.col("path")), F.lit("\nArchive: no/such.file\nKeep: ../x\nplain text"))
    docs = i.filter((k % 6 == 0) | (k % 35 == 1)).groupBy(src.alias("path")).agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    return O.intent_claims(docs, i)


@query("s105_intent_claims", _CLAIMS + "SELECT * FROM ic")
def _(t):
    return _claims(t)


@query("s137_retention_rules", _CLAIMS + "SELECT DISTINCT path, source_path, status FROM ic")
def _(t):
    return O.retention_rules(_claims(t))


_ST = _CLAIMS + ", na AS (SELECT count(DISTINCT path) AS n FROM ic WHERE status = 'ACTIVE_MAINLINE'), sx AS (SELECT path, CASE WHEN count(DISTINCT status) > 1 OR (min(status) = 'ACTIVE_MAINLINE' AND (SELECT n FROM na) > 1) THEN 'UNRESOLVED' ELSE min(status) END AS status FROM ic GROUP BY 1) "


@query("s125_project_intent", _ST + "SELECT (SELECT n FROM na) AS entry_points, count(*) FILTER (status = 'UNRESOLVED') AS conflicts, CASE WHEN count(*) FILTER (status = 'UNRESOLVED') > 0 OR (SELECT n FROM na) = 0 THEN 'UNRESOLVED' ELSE 'SUPPORTED' END AS status, CASE WHEN count(*) FILTER (status = 'UNRESOLVED') > 0 THEN 'CONFLICTING_INTENT_EVIDENCE' WHEN (SELECT n FROM na) = 0 THEN 'NO_ACTIVE_DELIVERY_OR_ENTRY_POINT_EVIDENCE' END AS uncertainty FROM sx")
def _(t):
    c = _claims(t)
    return O.project_intent(c, decisions.mainline_status(c))


@query("s148_conflict_records", _ST + ", b AS (SELECT path FROM sx WHERE status = 'UNRESOLVED'), act AS (SELECT DISTINCT path FROM ic WHERE status = 'ACTIVE_MAINLINE' AND path IN (SELECT path FROM b)) SELECT path, string_agg(DISTINCT source_path || ':' || status, ',' ORDER BY source_path || ':' || status) AS claims FROM (SELECT ic.path, source_path, status FROM ic JOIN b USING (path) WHERE NOT (path IN (SELECT path FROM act) AND (SELECT count(*) FROM act) > 1) UNION ALL SELECT act.path, source_path, status FROM act, ic WHERE status = 'ACTIVE_MAINLINE' AND (SELECT count(*) FROM act) > 1) GROUP BY 1")
def _(t):
    c = _claims(t)
    return O.conflict_records(c, decisions.mainline_status(c)).withColumn("claims", F.array_join("claims", ","))


_CLASSES = _ST + """, b AS (SELECT path FROM sx WHERE status = 'UNRESOLVED'), o AS (SELECT ic.* FROM ic JOIN b USING (path)), act AS (SELECT DISTINCT path FROM o WHERE status = 'ACTIVE_MAINLINE'),
cl AS (SELECT o.*, CASE WHEN path IN (SELECT path FROM act) AND (SELECT count(*) FROM act) > 1 THEN '*' ELSE '/' || path END AS class FROM o) """


@query("s148_conflict_members", _CLASSES + "SELECT DISTINCT path, class FROM cl")
def _(t):
    c = _claims(t)
    return O.conflict_classes(c, decisions.mainline_status(c))[0]


@query("s148_conflict_claims", _CLASSES + "SELECT class, source_path, status, count(*) AS n FROM cl WHERE class <> '*' OR status = 'ACTIVE_MAINLINE' GROUP BY 1, 2, 3")
def _(t):
    c = _claims(t)
    return O.conflict_classes(c, decisions.mainline_status(c))[1].groupBy("class", "source_path", "status").agg(F.count("*").alias("n"))


def _names(t, names):
    k = F.col("p_partkey")
    return t("part").filter(k < len(names)).select(F.get(F.array(*map(F.lit, names)), k.cast("int")).alias("path"))


_ENV = ["x/y.md", "requirements.txt", "binder/environment.yml", "binder/pyproject.toml", "a/Dockerfile", "Dockerfile", "pyproject.toml", "binder/postBuild", "x.md"]


@query("s110_environment_markers", "SELECT * FROM (VALUES ('requirements.txt', 'PIP', 'SHADOWED'), ('binder/environment.yml', 'CONDA', 'ACTIVE'), ('Dockerfile', 'CONTAINER', 'SHADOWED'), ('pyproject.toml', 'PYTHON_PROJECT', 'SHADOWED'), ('binder/postBuild', 'POST_BUILD_SCRIPT', 'ACTIVE')) v(path, kind, scope_status)")
def _(t):
    return O.environment_markers(_names(t, _ENV))


_PATHS = ["CITATION.cff", ".dvc/config", "workflow/Snakefile", "x/dvc.yaml", "data/{k}.dvc", "a/b{k}/Snakefile", "MLProject", "a/MLproject", ".noworkflow/db{k}", "{k}.dvcx", "codemeta.json"]
_PATH = "replace(CASE p_partkey % 11 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PATHS)) + " END, '{k}', CAST(p_partkey AS STRING))"


@query("s111_declaration_families", f"""SELECT p_partkey, {_PATH} AS path, CASE WHEN p_partkey % 11 = 1 OR p_partkey % 11 = 4 AND p_size % 4 > 0 THEN 'DVC' WHEN p_partkey % 11 IN (2, 5) AND (p_partkey % 11 = 2 OR p_size % 4 > 0) THEN 'SNAKEMAKE'
 WHEN p_partkey % 11 = 6 THEN 'MLFLOW' WHEN p_partkey % 11 = 8 THEN 'NOWORKFLOW' WHEN p_partkey % 11 = 0 AND p_size % 4 > 0 THEN 'CITATION_CFF' WHEN p_partkey % 11 = 10 AND p_size % 4 > 0 THEN 'CODEMETA' END AS family FROM part""")
def _(t):
    p = t("part").select("p_partkey", F.expr(_PATH).alias("path"), F.when(F.col("p_size") % 4 > 0, "REGULAR_FILE").otherwise("SYMLINK").alias("o"))
    return p.select("p_partkey", "path", O.declaration_family(F.col("path"), F.col("o")).alias("family"))


@query("s112_validation_status", """WITH r AS (SELECT p_brand, p_size, CASE WHEN p_size = 1 THEN 1 WHEN p_size = 2 THEN 2 WHEN p_size = 3 THEN 3 WHEN p_size = 4 THEN 4 END AS r FROM part), g AS (SELECT p_brand, min(r) AS r, bool_or(p_size = 50) AS l FROM r GROUP BY 1)
SELECT p_brand, CASE r WHEN 1 THEN 'MALFORMED' WHEN 2 THEN 'SIZE_LIMIT' WHEN 3 THEN 'UNAVAILABLE' WHEN 4 THEN 'CHANGED' ELSE 'SYNTAX_VALIDATED' END AS validation, CASE WHEN l THEN 'PARTIAL' WHEN r = 1 THEN 'MALFORMED' WHEN r IS NULL THEN 'PRESENT' ELSE 'PRESENT_UNVALIDATED' END AS status FROM g""")
def _(t):
    z = F.col("p_size")
    r = t("part").select("p_brand", F.when(z == 1, "MALFORMED").when(z == 2, "SIZE_LIMIT").when(z == 3, "UNAVAILABLE").when(z == 4, "CHANGED").otherwise("SYNTAX_VALIDATED").alias("result"), (z == 50).alias("limited"))
    return O.validation_status(r, "p_brand", limited="limited")


@query("s144_source_kinds", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND n > 0 THEN 'MULTIPLE_SOURCES' WHEN p_size % 2 = 0 THEN 'INLINE_DATA' WHEN n = 0 THEN 'MISSING_SOURCE' WHEN r > 0 AND n > r THEN 'MIXED_PATHS' WHEN r > 0 THEN 'REMOTE_PATH' WHEN u > 0 AND l = 0 THEN 'UNSAFE_PATH' WHEN n > 1 THEN 'MULTIPART_LOCAL' ELSE 'LOCAL_PATH' END AS kind FROM (SELECT *, p_partkey % 3 AS l, p_partkey // 3 % 2 AS r, p_partkey // 6 % 2 AS u, l + r + u AS n FROM part)")
def _(t):
    k = F.col("p_partkey")
    l, r, u = k % 3, F.floor(k / 3) % 2, F.floor(k / 6) % 2
    return t("part").select("p_partkey", O.source_kind(F.col("p_size") % 2 == 0, l + r + u, l, r, u).alias("kind"))


@query("s144_schema_kinds", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'ABSENT' WHEN 1 THEN 'INLINE_OBJECT' WHEN 2 THEN 'REFERENCE_STRING' WHEN 3 THEN 'UNSUPPORTED' ELSE 'ABSENT' END AS kind FROM orders")
def _(t):
    k = F.col("o_orderkey") % 5
    return t("orders").select("o_orderkey", O.schema_kind(F.when(k == 1, "{}").when(k == 2, '"s.json"').when(k == 3, "[1]").when(k == 4, "null")).alias("kind"))


@query("s040_resource_status", _K + "SELECT r.path, CASE WHEN kk.path IS NULL THEN 'MISSING' WHEN object_type = 'REGULAR_FILE' THEN 'PRESENT' ELSE 'PRESENT_NON_REGULAR' END AS inventory_status FROM (SELECT path FROM inv UNION ALL SELECT 'no/' || path FROM inv WHERE doc_id % 9 = 0) r LEFT JOIN kk ON kk.path = r.path")
def _(t):
    i = inventory(t)
    return O.resource_status(i.select("path").unionByName(i.filter("doc_id % 9 = 0").select(F.concat(F.lit("no/"), "path").alias("path"))), _kinds(t))


@query("s039_unresolved_references", "SELECT l_orderkey AS action, CASE WHEN l_linenumber % 2 = 0 THEN 'input' ELSE 'output' END AS role, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS unresolved FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40) GROUP BY 1, 2")
def _(t):
    r = t("lineitem").select(F.col("l_orderkey").alias("action"), F.when(F.col("l_linenumber") % 2 == 0, "input").otherwise("output").alias("role"), F.col("l_partkey").cast("string").alias("target"))
    return O.unresolved_references(r, t("part").filter("p_size < 40").select(F.col("p_partkey").cast("string").alias("id"))).withColumn("unresolved", F.array_join("unresolved", ","))


@query("s041_control_pairs", W.replace("WITH ", "WITH RECURSIVE ", 1) + """, r AS (SELECT source, artifact_id AS a, content_id AS c, row_number() OVER (PARTITION BY source ORDER BY artifact_id) AS k FROM inv),
f(source, k, waiting, c, pairs) AS (SELECT DISTINCT source, 0::BIGINT, []::VARCHAR[], '', []::VARCHAR[] FROM r
 UNION ALL SELECT r.source, r.k, CASE WHEN len(pairs) = 4 THEN waiting WHEN len(waiting) > 0 AND r.c <> f.c THEN waiting[2:] ELSE list_append(waiting, r.a) END, CASE WHEN len(pairs) = 4 OR len(waiting) > 0 AND r.c <> f.c THEN f.c ELSE r.c END,
  CASE WHEN len(pairs) < 4 AND len(waiting) > 0 AND r.c <> f.c THEN list_append(pairs, waiting[1] || ',' || r.a) ELSE pairs END FROM f JOIN r ON r.source = f.source AND r.k = f.k + 1),
l AS (SELECT source, arg_max(pairs, k) AS pairs FROM f GROUP BY 1) SELECT source, unnest(pairs) AS pair FROM l""")
def _(t):
    return O.controls(inventory(t), "source", 4).select("source", F.concat_ws(",", "left", "right").alias("pair"))


@query("s041_nonmatch_controls", W + "SELECT source, count(*) AS eligible FROM inv GROUP BY 1")
def _(t):
    i = inventory(t)
    c = O.controls(i, "source", 10)
    used = c.select("source", F.explode(F.array("left", "right")).alias("a"))
    bad = used.groupBy("source", "a").agg(F.count("*").alias("n")).filter("n > 1").select("source")
    n = i.groupBy("source").agg(F.count("*").alias("eligible"))
    return n.join(bad, "source", "left_anti")


_ATTEMPTS = """WITH a AS (SELECT o_orderkey AS k, 'p' || (o_orderkey % 2000) AS output, CASE WHEN o_orderkey % 3 > 0 THEN ['p' || (o_custkey % 300), 'p' || (o_orderkey % 2000)] END AS inputs, CASE WHEN o_orderkey % 4 > 0 THEN ['p1'] ELSE [] END AS configuration, ['p2', 'p2'] AS generator, ['p3'] AS validation, CASE WHEN o_orderkey % 5 > 0 THEN ['q' || (o_custkey % 10)] END AS reviewer_record FROM orders),
i AS (SELECT 'p' || p_partkey AS path FROM part UNION ALL SELECT 'q' || n FROM range(0, 8) r(n)),
m AS (SELECT DISTINCT k, role, path FROM (SELECT k, 'OUTPUT' AS role, output AS path FROM a UNION ALL SELECT k, 'INPUT', unnest(inputs) FROM a UNION ALL SELECT k, 'CONFIGURATION', unnest(configuration) FROM a UNION ALL SELECT k, 'GENERATOR', unnest(generator) FROM a UNION ALL SELECT k, 'VALIDATION', unnest(validation) FROM a UNION ALL SELECT k, 'REVIEWER_RECORD', unnest(reviewer_record) FROM a)),
u AS (SELECT k, list_sort(list_distinct(list_concat(list_filter([CASE WHEN k % 3 = 0 THEN 'inputs' END, CASE WHEN k % 4 = 0 THEN 'configuration' END, CASE WHEN k % 5 = 0 THEN 'reviewer_record' END], lambda x: x IS NOT NULL), coalesce(list(path) FILTER (path NOT IN (SELECT path FROM i)), [])))) AS un, count(*) AS members FROM m GROUP BY 1),
b AS (SELECT k AS attempt_id, CASE WHEN len(un) = 0 THEN 'COMPLETE_IN_ANALYZED_SCOPE' ELSE 'MISSING_REQUIRED_LINK' END AS completeness, members, un FROM u) """


def _bundles(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    p = lambda x: F.concat(F.lit("p"), x.cast("string"))
    a = t("orders").select(k.alias("attempt_id"), p(k % 2000).alias("output"), F.when(k % 3 > 0, F.array(p(c % 300), p(k % 2000))).alias("inputs"), F.when(k % 4 > 0, F.array(F.lit("p1"))).otherwise(F.array().cast("array<string>")).alias("configuration"), F.array(F.lit("p2"), F.lit("p2")).alias("generator"), F.array(F.lit("p3")).alias("validation"), F.when(k % 5 > 0, F.array(F.concat(F.lit("q"), (c % 10).cast("string")))).alias("reviewer_record"))
    i = t("part").select(p(F.col("p_partkey")).alias("path")).unionByName(t("part").sparkSession.range(8).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("path"))).withColumn("artifact_id", F.col("path"))
    return O.bundles(a, i)


@query("s127_bundles", _ATTEMPTS + "SELECT attempt_id, completeness, members, array_to_string(un, ',') AS unresolved FROM b")
def _(t):
    return _bundles(t).withColumn("unresolved", F.array_join("unresolved", ","))


@query("s078_gap_order", _ATTEMPTS + "SELECT attempt_id, len(un) AS n, array_to_string(un[1:2], ',') AS unresolved, greatest(len(un) - 2, 0) AS omitted FROM b WHERE len(un) > 0 ORDER BY n DESC, attempt_id LIMIT 25")
def _(t):
    return O.gap_order(_bundles(t), 25, 2).withColumn("unresolved", F.array_join("unresolved", ","))


@query("s042_declared_chains", _ATTEMPTS + ", f AS (SELECT * FROM b ORDER BY completeness = 'COMPLETE_IN_ANALYZED_SCOPE', attempt_id LIMIT 25), e AS (SELECT l_orderkey AS k, l_linenumber || '-' || l_partkey AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber || '-' || l_partkey) AS n FROM lineitem) SELECT attempt_id, completeness, count(r) AS edges, coalesce(string_agg(r, ',' ORDER BY r) FILTER (n <= 3), '') AS reported, greatest(count(r) - 3, 0) AS omitted FROM f LEFT JOIN e ON k = attempt_id GROUP BY 1, 2")
def _(t):
    e = t("lineitem").select(F.col("l_orderkey").alias("attempt_id"), F.concat_ws("-", "l_linenumber", "l_partkey").alias("relationship_id"))
    return O.chains(_bundles(t), e, 25, 3).withColumn("reported", F.array_join("reported", ","))


@query("s072_budget_errors", "SELECT l_orderkey AS plan, concat_ws(',', CASE WHEN min(l_quantity) < 2 THEN 'ACTION_MALFORMED' END, CASE WHEN count(*) > 5 THEN 'BUDGET_ACTION_COUNT' END, CASE WHEN min(l_quantity) >= 2 AND sum(l_quantity) > 120 THEN 'BUDGET_AFFECTED_BYTES' END, CASE WHEN min(l_quantity) >= 2 AND (SELECT count(DISTINCT x) FROM (SELECT unnest(list(l_partkey) || list(l_suppkey)) AS x)) > 8 THEN 'BUDGET_BLAST_RADIUS' END) AS errors FROM lineitem GROUP BY 1")
def _(t):
    q = F.col("l_quantity")
    a = t("lineitem").select(F.col("l_orderkey").alias("plan"), F.when(q >= 2, q.cast("long")).otherwise(F.lit(-1).cast("long")).alias("affected_bytes"), F.array("l_partkey", "l_suppkey").alias("affected_artifact_ids"))
    return O.budget_errors(a, "plan", 5, 120, 8).withColumn("errors", F.array_join("errors", ","))


@query("s129_outcomes", "SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'NOT_STARTED' WHEN 2 THEN 'PREPARED' WHEN 3 THEN 'MOVED' WHEN 4 THEN 'FAILED' WHEN 5 THEN 'PREPARED' ELSE 'AMBIGUOUS' END AS outcome FROM orders")
def _(t):
    k = F.col("o_orderkey") % 7
    ev = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    types = F.when(k == 0, ev(*O.VERIFIED)).when(k == 1, ev()).when(k == 2, ev(O.VERIFIED[0])).when(k == 3, ev(*O.VERIFIED[:2])).when(k == 4, ev(*O.VERIFIED[:3], "ACTION_FAILED")).when(k == 5, ev(O.VERIFIED[0], "ACTION_FAILED")).otherwise(ev(*O.VERIFIED))
    src, dst = F.when(k.isin(1, 2, 3, 5), "REGULAR").otherwise("ABSENT"), F.when(k.isin(0, 3, 4, 6), "REGULAR").otherwise("ABSENT")
    return t("orders").select("o_orderkey", O.outcome(types, F.lit(True), k == 0, src, dst, F.lit("ABSENT")).alias("outcome"))


@query("s133_component_states", "SELECT p_brand, CASE WHEN bool_or(p_size = 5) THEN 'COMPLETED_WITH_LIMITATIONS' ELSE 'COMPLETED' END AS state FROM part GROUP BY 1")
def _(t):
    return t("part").groupBy("p_brand").agg(F.collect_set(F.when(F.col("p_size") == 5, "LIMIT")).alias("w")).select("p_brand", O.component_state(F.col("w")).alias("state"))


@query("s073_corpus_card", "SELECT count(*) AS repositories, count(*) FILTER (p_size > 10) AS public, count(*) FILTER (p_size <= 10) AS private, count(DISTINCT p_brand) AS families, count(*) FILTER (p_partkey % 3 = 0) AS swhids, count(*) FILTER (p_partkey % 3 = 0 AND p_size > 10) AS public_swhids FROM part")
def _(t):
    return O.corpus_card(t("part").select(F.col("p_partkey").alias("repository_id"), F.col("p_brand").alias("repository_family"), F.when(F.col("p_size") > 10, "public-git").otherwise("private").alias("access"), F.when(F.col("p_partkey") % 3 == 0, "swh").alias("swhid")))


@query("s135_evidence_candidates", "SELECT 'profile' AS source_type, CASE WHEN page_id % 3 = 0 THEN 'o' || page_id WHEN page_id % 3 = 1 THEN 'p' || page_id ELSE 'unidentified-observation' END AS source_record_id, 'OBSERVED' AS assertion_origin, CASE WHEN page_id % 2 = 0 THEN 'FULL' ELSE 'OBSERVATION_ONLY' END AS scope, 'repository_relative_path=' || url || CASE WHEN page_id % 5 = 0 THEN ',artifact_id=' || page_id ELSE '' END AS subject FROM pages")
def _(t):
    k, s = F.col("page_id"), F.col("page_id").cast("string")
    o = t("pages").select(F.when(k % 3 == 0, F.concat(F.lit("o"), s)).otherwise("").alias("observation_id"), F.when(k % 3 < 2, F.concat(F.lit("p"), s)).alias("profile_id"), F.when(k % 2 == 0, "FULL").alias("coverage"), F.when(k % 5 == 0, s).alias("artifact_id"), F.col("url").alias("repository_relative_path"))
    e = O.evidence_candidates(o, "profile", "OBSERVED")
    get = lambda x: F.element_at("subject", x)
    return e.withColumn("subject", F.concat(F.lit("repository_relative_path="), get("repository_relative_path"), F.coalesce(F.concat(F.lit(",artifact_id="), get("artifact_id")), F.lit(""))))


@query("s065_notebook_counts", "WITH c AS (SELECT conv_id, CASE role WHEN 'user' THEN 'cell:code' WHEN 'assistant' THEN 'cell:markdown' ELSE 'cell:unknown' END AS k FROM conversations UNION ALL SELECT conv_id, CASE WHEN turn % 3 = 0 THEN 'output:stream' ELSE 'output:unknown' END FROM conversations WHERE role = 'user'), g AS (SELECT conv_id, k, count(*) AS n FROM c GROUP BY 1, 2) SELECT CAST(conv_id AS VARCHAR) AS notebook, string_agg(k || '=' || n, ',' ORDER BY k) AS counts FROM g GROUP BY 1")
def _(t):
    r, q = F.col("role"), F.lit
    cell = F.concat(q('{"cell_type":"'), F.when(r == "user", "code").when(r == "assistant", "markdown").otherwise("odd"), q('","outputs":['), F.when(r == "user", F.concat(q('{"output_type":"'), F.when(F.col("turn") % 3 == 0, "stream").otherwise("smoke"), q('"}'))).otherwise(""), q("]}"))
    n = t("conversations").groupBy(F.col("conv_id").cast("string").alias("notebook")).agg(F.concat(q('{"cells":['), F.array_join(F.collect_list(cell), ","), q("]}")).alias("json"))
    return O.notebook_counts(n).withColumn("counts", F.array_join(F.transform(F.map_entries("counts"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ","))


_RUN = """CASE WHEN o_orderkey % 9 = 0 THEN 'src/mlruns/' ELSE 'mlruns/' END || CASE WHEN o_custkey % 10 = 0 THEN '.trash' ELSE CAST(o_custkey % 20 AS STRING) END || '/r' || (o_custkey % 7) || CASE o_orderkey % 4 WHEN 0 THEN '/params/' WHEN 1 THEN '/metrics/' WHEN 2 THEN '/artifacts/' ELSE '/' END || o_orderkey"""


@query("s067_mlflow_counts", f"""WITH a AS (SELECT {_RUN} AS path FROM orders), m AS (SELECT path FROM a WHERE path LIKE 'mlruns/%'), p AS (SELECT path FROM m ORDER BY 1 LIMIT 256)
SELECT count(DISTINCT CASE WHEN split_part(path, '/', 2) <> '.trash' THEN split_part(path, '/', 2) || '/' || split_part(path, '/', 3) END) AS runs, count(*) FILTER (path LIKE '%/params/%') AS parameters, count(*) FILTER (path LIKE '%/metrics/%') AS metrics, count(*) FILTER (path LIKE '%/artifacts/%') AS artifacts,
 CASE WHEN (SELECT count(*) FROM m) > 256 THEN 'ADAPTER_RECORD_LIMIT,' ELSE '' END || 'MLFLOW_METADATA_KEYS_ONLY,MLFLOW_PROJECT_NOT_EXECUTED' AS limitations FROM p""")
def _(t):
    return O.mlflow_counts(t("orders").select(F.expr(_RUN).alias("path"))).withColumn("limitations", F.array_join("limitations", ","))


@query("s113_codemeta", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE 'author,name' END AS fields, CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN p_partkey % 4 = 0 THEN 2 ELSE 1 END AS authors FROM part")
def _(t):
    k, q = F.col("p_partkey") % 4, F.lit
    x = F.when(k == 3, "[1]").otherwise(F.concat(q('{"name":"'), "p_brand", q('","secret":1,"author":'), F.when(k == 0, '[{"a":1},{"a":2}]').otherwise('{"a":1}'), q("}")))
    return t("part").select("p_partkey", O.codemeta(x, ["@id", "author", "name", "version"]).alias("m")).select("p_partkey", F.array_join("m.fields", ",").alias("fields"), "m.authors")


@query("s131_staged_large", _K + ", f AS (SELECT path, size_bytes * 100 AS size_bytes FROM kk WHERE object_type = 'REGULAR_FILE' AND size_bytes * 100 > 512000 AND doc_id % 2 = 0) SELECT *, greatest((SELECT count(*) FROM f) - 20, 0) AS omitted FROM f ORDER BY path LIMIT 20")
def _(t):
    k = _kinds(t).withColumn("size_bytes", F.col("size_bytes") * 100)
    return O.staged_large(k, k.filter("doc_id % 2 = 0").select("path"), most=20)


@query("s139_history_findings", W + ", c AS (SELECT doc_id, doc_id % 5 AS commit_id, path, text, regexp_matches(text, '(?i)token[ \\t]*[=:][ \\t]*[^\\s]+') AS t, regexp_matches(text, '(?i)password[ \\t]*[=:][ \\t]*[^\\s]+') AS p FROM inv) SELECT commit_id, path, category, CASE WHEN count(*) OVER () > 256 THEN 'GIT_SECRET_HISTORY_FINDING_LIMIT' END AS limitation FROM (SELECT commit_id, path, 'TOKEN' AS category FROM c WHERE t UNION SELECT commit_id, path, 'PASSWORD' FROM c WHERE p) ORDER BY commit_id, path, category LIMIT 256")
def _(t):
    i = inventory(t)
    only = lambda x: F.array_intersect(C.secret_categories(x), F.array(F.lit("TOKEN"), F.lit("PASSWORD")))
    return O.history_findings(i.select(F.col("content_id").alias("blob"), (F.col("doc_id") % 5).alias("commit_id"), "path"), i.select(F.col("content_id").alias("blob"), "text"), only)


@query("s099_safe_prefix", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'abcdéé' WHEN 1 THEN 'a[REDACTED:X]' WHEN 2 THEN 'short' ELSE '[REDACTED]' END AS prefix FROM documents")
def _(t):
    k = F.col("doc_id") % 4
    x = F.when(k == 0, "abcdéééééé").when(k == 1, "ab[REDACTED:X]cd").when(k == 2, "short").otherwise("a[REDACTED:LONG_CATEGORY]b")
    cut = F.when(k == 0, O.safe_prefix(x, 9)).when(k == 1, O.safe_prefix(x, 13)).otherwise(O.safe_prefix(x, 12))
    return t("documents").select("doc_id", cut.alias("prefix"))


@query("s095_jaccard", "SELECT l_orderkey, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0), 9) AS similarity FROM (SELECT l_orderkey, coalesce(list(DISTINCT l_suppkey % 5) FILTER (l_linenumber % 2 = 0), []) AS a, coalesce(list(DISTINCT l_suppkey % 5) FILTER (l_linenumber % 2 = 1 AND l_quantity > 5), []) AS b FROM lineitem GROUP BY 1)")
def _(t):
    s, n = F.col("l_suppkey") % 5, F.col("l_linenumber") % 2
    g = t("lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(n == 0, s)).alias("a"), F.collect_set(F.when((n == 1) & (F.col("l_quantity") > 5), s)).alias("b"))
    return g.select("l_orderkey", F.round(C.jaccard(F.col("a"), F.col("b")), 9).alias("similarity"))


@query("s100_format_sniff", "SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'DATA_PACKAGE' WHEN 1 THEN 'NOTEBOOK' WHEN 2 THEN 'PDF' WHEN 3 THEN 'BINARY' WHEN 4 THEN 'JSON' WHEN 5 THEN 'JSON' WHEN 6 THEN 'CSV' WHEN 7 THEN 'MARKDOWN' WHEN 8 THEN 'LOG' ELSE 'TEXT' END AS format FROM part")
def _(t):
    k = (F.col("p_partkey") % 10).cast("int")
    texts = ["x", "{}", "%PDF-1.4 x", "", '  {"a":1}', "{not-json", 'a,b\n"x,y",2\n', "text\n## Head\nmore, or less\n", "2026-01-02 started\n", "a, b\nc"]
    names = ["a/DataPackage.json", "n.IPYNB", "x", "x", "x.txt", "x", "x.bin", "notes.json", "x", "x"]
    pick = lambda a: F.get(F.array(*map(F.lit, a)), k)
    content = F.when(k == 3, F.unhex(F.lit("FF00FE"))).otherwise(F.encode(pick(texts), "UTF-8"))
    return t("part").select("p_partkey", C.sniff(pick(names), content).alias("format"))


@query("s102_lfs_pointers", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'sha256:' || sha256(text) END AS oid, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS size_bytes FROM documents")
def _(t):
    k = F.col("doc_id") % 2
    x = F.concat(F.lit("version https://git-lfs.github.com/spec/v1\noid sha256:"), F.sha2("text", 256), F.when(k == 0, "\nsize ").otherwise("\nsizes "), F.col("n_chars").cast("string"), F.lit("\n"))
    return t("documents").select("doc_id", C.lfs_pointer(x).alias("p")).select("doc_id", "p.oid", "p.size_bytes")


@query("s118_archive_kinds", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'ZIP' WHEN 1 THEN 'ZIP' WHEN 2 THEN '7Z' WHEN 3 THEN 'RAR' WHEN 4 THEN 'TAR' END AS kind FROM part")
def _(t):
    k = (F.col("p_partkey") % 6).cast("int")
    heads = ["504B030400", "504B0506", "377ABCAF271C", "526172211A0700", "00" * 257 + "7573746172", "504B0102"]
    return t("part").select("p_partkey", C.archive_kind(F.unhex(F.get(F.array(*map(F.lit, heads)), k))).alias("kind"))


@query("s116_human_sizes", "SELECT doc_id, CASE WHEN n < 1000 THEN n || ' B' WHEN n < 1000000 THEN printf('%.1f KB', n / 1000.0::DOUBLE) WHEN n < 1000000000 THEN printf('%.1f MB', n / 1000.0::DOUBLE / 1000.0::DOUBLE) ELSE printf('%.1f GB', n / 1000.0::DOUBLE / 1000.0::DOUBLE / 1000.0::DOUBLE) END AS size FROM (SELECT doc_id, n_chars * CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 700 ELSE 190000 END AS n FROM documents)")
def _(t):
    k = F.col("doc_id") % 3
    return t("documents").select("doc_id", C.human_size(F.col("n_chars") * F.when(k == 0, 1).when(k == 1, 700).otherwise(190000)).alias("size"))


@query("s149_decision_hashes", """SELECT p_partkey, 'sha256:' || sha256('{"answer":"' || p_brand || '","counter_evidence_ids":["e1","e2"],"question_id":"q' || p_partkey || '","reason":"because","scope":"REPOSITORY","supporting_evidence_ids":[]}') AS decision_set_hash FROM part""")
def _(t):
    h = O.decision_hash(F.col("p_brand"), F.lit("because"), F.concat(F.lit("q"), F.col("p_partkey").cast("string")), F.lit("REPOSITORY"), F.array().cast("array<string>"), F.array(F.lit("e1"), F.lit("e2")))
    return t("part").select("p_partkey", h.alias("decision_set_hash"))


@query("s082_first_commits", "SELECT c_nationkey, c_custkey, rank, omitted FROM (SELECT c_nationkey, c_custkey, row_number() OVER w AS rank, greatest(count(*) OVER (PARTITION BY c_nationkey) - 3, 0) AS omitted FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)) WHERE rank <= 3")
def _(t):
    return decisions.top_k_per(t("customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", "rank", "omitted")


@query("s079_smallest_paths", W + "SELECT path, greatest((SELECT count(*) FROM inv) - 64, 0) AS omitted FROM inv ORDER BY path LIMIT 64")
def _(t):
    return decisions.top_k(inventory(t).select("path"), [F.col("path")], 64)
