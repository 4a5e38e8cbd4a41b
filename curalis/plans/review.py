"""Decision, evaluation and ledger operators bound to the driver's tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalis.functions import columns as C
from curalis.operators import decisions, duplicates, evaluation, ledgers, relationships, snapshots
from curalis.plans.bindings import W, inventory, query


def _sides(t) -> dict[str, DataFrame]:
    """The tables that meet in the classification, made from documents, labels and benchmark by rules on their keys."""
    inv, ID = inventory(t).join(t("labels"), "doc_id", "left"), F.col("doc_id").cast("string")
    k, none = F.col("doc_id"), F.array().cast("array<string>")
    one = lambda p, c: F.array(F.concat(F.lit(p), ID)) if c is None else F.when(c, F.array(F.concat(F.lit(p), ID))).otherwise(none)
    good, toxic, bad = F.col("quality") == 1, F.col("toxic") == 1, F.col("quality") == 0
    status = F.when(toxic, "UNRESOLVED").when(good, "ACTIVE_MAINLINE").when(bad, "HISTORICAL_EVIDENCE").otherwise("UNRESOLVED")
    mainline = inv.select("artifact_id", F.lit(1).alias("ordinal"), status.alias("status"), F.when(F.col("quality").isNotNull(), F.array(F.concat(F.lit("m"), ID))).otherwise(none).alias("support"), F.when(toxic, F.array(F.concat(F.lit("c"), ID))).otherwise(none).alias("counter"), F.when(F.col("quality").isNull(), F.array(F.lit("NO_MAINLINE_EVIDENCE"))).otherwise(none).alias("uncertainty"))
    role = F.when(k % 7 == 0, "EXPERIMENTAL_ACTIVE").when(k % 11 == 0, "ACTIVE_MAINLINE").otherwise("UNRESOLVED")
    roles = inv.select("artifact_id", F.lit(1).alias("ordinal"), role.alias("role"), one("r", (k % 7 == 0) | (k % 11 == 0)).alias("support"), F.when((k % 7 != 0) & (k % 11 != 0), F.array(F.lit("NO_ROLE_EVIDENCE"))).otherwise(none).alias("limits"))
    attempts = inv.filter(k % 13 == 0)
    attempts = attempts.select("path", F.lit(1).alias("ordinal"), F.lit("FAILED").alias("result"), F.lit("old").alias("tag"), "doc_id").unionByName(attempts.select("path", F.lit(2).alias("ordinal"), F.when(k % 2 == 0, "ACCEPTED").when(k % 3 == 0, "INCONCLUSIVE").otherwise("RUNNING").alias("result"), F.lit("a").alias("tag"), "doc_id"))
    attempts = attempts.select("path", "ordinal", "result", F.array(F.concat("tag", ID)).alias("support"), none.alias("limits"))
    docs = inv.filter(k % 50 == 0).select(F.col("source").alias("topic"), "path", F.col("lang").alias("audience"), F.lit(None).cast("string").alias("lifecycle"), F.when(k % 100 == 0, "AUDIT_RECORD").alias("role"), F.lit(None).cast("string").alias("claim"), F.when(k % 250 == 0, "x").when(k % 150 == 0, "y").alias("value"), F.lit(None).cast("string").alias("status"))
    dup = duplicates.replacements(inv)
    return {
        "inventory": inv.select("artifact_id", "path", F.when(k % 97 == 0, "DIRECTORY").when(k % 89 == 0, "SYMLINK").otherwise("REGULAR_FILE").alias("object_type"), F.when(k % 19 == 0, F.array(F.lit("CASE_COLLISION"))).otherwise(none).alias("warnings")),
        "mainline": mainline, "roles": roles, "attempts": attempts, "candidates": inv.filter(k % 26 == 13).select("path"), "comparisons": relationships.document_pairs(docs),
        "members": inv.filter(k % 17 == 0).select("artifact_id", F.concat(F.lit("b"), (k % 5).cast("string")).alias("bundle"), F.when(k % 5 < 3, decisions.COMPLETE).otherwise("MISSING_REQUIRED_LINK").alias("completeness")),
        "duplicates": dup.select("artifact_id", F.array(F.concat(F.lit("d:"), "replacement")).alias("support")),
        "declarations": inv.filter(k % 23 == 0).select("artifact_id", one("e", None).alias("support"), F.array(F.lit("DECLARATION_CONTENT_NOT_PARSED")).alias("limits"))}


def classified(t) -> DataFrame:
    return decisions.classify(decisions.fan_in(**_sides(t)))


_SIDES = W + """, i AS (SELECT inv.*, quality, toxic, doc_id AS k, min(artifact_id) OVER (PARTITION BY content_id) AS keeper,
  CASE WHEN doc_id % 97 = 0 THEN 'DIRECTORY' WHEN doc_id % 89 = 0 THEN 'SYMLINK' ELSE 'REGULAR_FILE' END AS object_type FROM inv LEFT JOIN labels USING (doc_id)),
pd AS (SELECT source AS topic, path, lang AS audience, CASE WHEN k % 100 = 0 THEN 'AUDIT_RECORD' END AS role, CASE WHEN k % 250 = 0 THEN 'x' WHEN k % 150 = 0 THEN 'y' END AS value FROM i WHERE k % 50 = 0),
pairs AS (SELECT a.path AS left_path, b.path AS right_path, CASE WHEN a.value <> b.value THEN 'DO_NOT_MERGE' WHEN a.audience <> b.audience OR a.role IS NOT NULL OR b.role IS NOT NULL THEN 'CANONICALIZE_WITHOUT_MERGE' ELSE 'MANUAL_REVIEW' END AS subtype FROM pd a JOIN pd b ON a.topic = b.topic AND a.path < b.path),
clash AS (SELECT left_path AS path FROM pairs WHERE subtype = 'DO_NOT_MERGE' UNION SELECT right_path FROM pairs WHERE subtype = 'DO_NOT_MERGE'),
f AS (SELECT *, CASE WHEN toxic = 1 THEN 'UNRESOLVED' WHEN quality = 1 THEN 'ACTIVE_MAINLINE' WHEN quality = 0 THEN 'HISTORICAL_EVIDENCE' ELSE 'UNRESOLVED' END AS ms,
  CASE WHEN k % 7 = 0 THEN 'EXPERIMENTAL_ACTIVE' WHEN k % 11 = 0 THEN 'ACTIVE_MAINLINE' END AS rs, CASE WHEN k % 13 = 0 THEN CASE WHEN k % 2 = 0 THEN 'ACCEPTED' WHEN k % 3 = 0 THEN 'INCONCLUSIVE' ELSE 'RUNNING' END END AS ar,
  k % 26 = 13 AS cand, path IN (SELECT path FROM clash) AS dc, k % 19 = 0 AS warned, k % 17 = 0 AS bundled, k % 17 = 0 AND k % 5 >= 3 AS guard, artifact_id <> keeper AS dup, object_type = 'REGULAR_FILE' AND k % 23 = 0 AS decl FROM i),
g AS (SELECT *, CASE WHEN ms <> 'UNRESOLVED' THEN ms END AS m, CASE WHEN ar = 'INCONCLUSIVE' THEN 'HISTORICAL_EVIDENCE' WHEN ar = 'ACCEPTED' OR (ar IS NOT NULL AND cand) THEN 'EXPERIMENTAL_ACTIVE' END AS tr FROM f),
h AS (SELECT *, len(list_distinct(list_filter([m, rs, tr], lambda x: x IS NOT NULL))) > 1 AS mixed, coalesce(toxic = 1, false) AS intent FROM g),
h2 AS (SELECT *, CASE WHEN mixed OR dc OR warned OR intent OR guard THEN 'UNRESOLVED' ELSE coalesce(tr, rs, m, CASE WHEN object_type = 'DIRECTORY' THEN 'PROTECTED' WHEN decl THEN 'DECLARATION_EVIDENCE' ELSE 'UNRESOLVED' END) END AS s0 FROM h),
h3 AS (SELECT *, s0 IN ('UNRESOLVED', 'DECLARATION_EVIDENCE') AND dup AND NOT dc AND NOT warned AND NOT guard AS isdup FROM h2),
c AS (SELECT artifact_id, path, k, bundled, CASE WHEN isdup THEN 'EXACT_DUPLICATE_REVIEW' ELSE s0 END AS state,
  list_sort(list_filter([CASE WHEN decl THEN 'e' || k END, CASE WHEN quality IS NOT NULL THEN 'm' || k END, CASE WHEN rs IS NOT NULL THEN 'r' || k END, CASE WHEN ar IS NOT NULL THEN 'a' || k END, CASE WHEN isdup THEN 'd:' || keeper END], lambda x: x IS NOT NULL)) AS sup,
  CASE WHEN toxic = 1 THEN ['c' || k] ELSE [] END AS cnt,
  list_sort(list_filter([CASE WHEN object_type <> 'REGULAR_FILE' THEN 'NON_REGULAR_ARTIFACT_PRESERVED' END, CASE WHEN decl THEN 'DECLARATION_CONTENT_NOT_PARSED' END, CASE WHEN quality IS NULL THEN 'NO_MAINLINE_EVIDENCE' END, CASE WHEN rs IS NULL THEN 'NO_ROLE_EVIDENCE' END, CASE WHEN mixed THEN 'MATERIAL_ROLE_CONFLICT' END,
   CASE WHEN dc THEN 'MATERIAL_DOCUMENT_CONFLICT' END, CASE WHEN warned THEN 'INVENTORY_COVERAGE_LIMITATION' END, CASE WHEN intent THEN 'MATERIAL_INTENT_CONFLICT' END, CASE WHEN guard THEN 'BUNDLE_MOVEMENT_GUARD' END, CASE WHEN isdup THEN 'EXACT_BYTES_DO_NOT_ESTABLISH_COMMON_PURPOSE' END], lambda x: x IS NOT NULL)) AS lim0 FROM h3),
d AS (SELECT *, CASE WHEN len(lim0) = 0 THEN ['NO_CLASSIFICATION_EVIDENCE'] ELSE lim0 END AS lim, CASE WHEN len(sup) > 0 AND len(cnt) = 0 AND state <> 'UNRESOLVED' THEN 'SUFFICIENT_FOR_SHADOW_REVIEW' ELSE 'INSUFFICIENT' END AS coverage FROM c),
r AS (SELECT *, CASE WHEN state = 'UNRESOLVED' THEN CASE WHEN lim = ['NO_MAINLINE_EVIDENCE', 'NO_ROLE_EVIDENCE'] THEN 'KEEP' ELSE 'MANUAL_REVIEW' END WHEN state IN ('HISTORICAL_EVIDENCE', 'EXACT_DUPLICATE_REVIEW') AND bundled THEN 'MANUAL_REVIEW' WHEN state = 'HISTORICAL_EVIDENCE' THEN 'ARCHIVE' WHEN state = 'EXACT_DUPLICATE_REVIEW' THEN 'REVIEW_EXACT_DUPLICATE' ELSE 'KEEP' END AS rec,
  list_sort(list_distinct(list_concat(lim, CASE WHEN state = 'UNRESOLVED' THEN ['PRESERVE_UNRESOLVED'] WHEN state IN ('HISTORICAL_EVIDENCE', 'EXACT_DUPLICATE_REVIEW') AND bundled THEN ['BUNDLE_GUARD:b' || (k % 5)] WHEN state = 'HISTORICAL_EVIDENCE' THEN ['ARCHIVE_REQUIRES_FUTURE_AVAILABILITY_VALIDATION'] WHEN state = 'EXACT_DUPLICATE_REVIEW' THEN ['EXACT_BYTES_DO_NOT_ESTABLISH_COMMON_PURPOSE', 'NO_MOVE_OR_DELETE_AUTHORIZED'] ELSE [] END))) AS rlim FROM d),
pl AS (SELECT artifact_id AS subject, rec, state, CASE WHEN rec = 'ARCHIVE' THEN 'LOCATION_ONLY_AFTER_APPROVED_MOVE' ELSE 'NONE' END AS loss, rlim, len(cnt) AS cn FROM r UNION ALL SELECT left_path || '|' || right_path, CASE WHEN subtype = 'DO_NOT_MERGE' THEN 'MANUAL_REVIEW' ELSE 'MERGE' END, NULL, 'DOCUMENT_HISTORY_AND_AUDIT_RECORDS_MUST_BE_RETAINED', ['DECLARED_DOCUMENT_METADATA_ONLY', 'MERGE_AND_DELETE_NEVER_EXECUTABLE'], CASE WHEN subtype = 'DO_NOT_MERGE' THEN 2 ELSE 0 END FROM pairs) """


@query("s026_classification_inputs", _SIDES + "SELECT artifact_id, ms AS mainline_status, coalesce(rs, 'UNRESOLVED') AS role_role, ar AS attempt_result, cand AND true AS candidate, dc AS document_conflict, guard AS bundle_guard, CASE WHEN bundled THEN 'b' || (k % 5) END AS bundles, CASE WHEN dup THEN 'd:' || keeper END AS duplicate_support, CASE WHEN k % 23 = 0 THEN 'e' || k END AS declaration_support FROM f")
def _(t):
    f = decisions.fan_in(**_sides(t))
    j = lambda c: F.array_join(c, ",").alias(c)
    return f.select("artifact_id", "mainline_status", "role_role", "attempt_result", "candidate", "document_conflict", "bundle_guard", j("bundles"), j("duplicate_support"), j("declaration_support"))


@query("s120_classification", _SIDES + "SELECT artifact_id, state, array_to_string(lim, ',') AS limitations, array_to_string(sup, ',') AS supporting, array_to_string(cnt, ',') AS counter FROM d")
def _(t):
    return classified(t).select("artifact_id", "state", *[F.array_join(c, ",").alias(c) for c in ("limitations", "supporting", "counter")])


@query("s121_evidence_sufficiency", _SIDES + "SELECT artifact_id, coverage FROM d")
def _(t):
    return classified(t).select("artifact_id", "coverage")


@query("s122_recommendation", _SIDES + "SELECT artifact_id, rec AS recommendation, CASE WHEN rec = 'ARCHIVE' THEN 'LOCATION_ONLY_AFTER_APPROVED_MOVE' ELSE 'NONE' END AS expected_loss, CASE WHEN rec = 'REVIEW_EXACT_DUPLICATE' THEN 'EXACT_BYTE_REPLACEMENT_OBSERVED' ELSE 'NOT_ESTABLISHED' END AS availability, array_to_string(rlim, ',') AS limitations FROM r")
def _(t):
    return decisions.recommend(classified(t)).select("artifact_id", "recommendation", "expected_loss", "availability", F.array_join("limitations", ",").alias("limitations"))


def _plan(t, c: DataFrame | None = None) -> DataFrame:
    """The plan of a classification, made here where there is none."""
    s = _sides(t)
    return decisions.plan(decisions.recommend(decisions.classify(decisions.fan_in(**s)) if c is None else c), s["comparisons"])


@query("s147_document_recommendations", _SIDES + "SELECT subject, rec AS recommendation, loss AS expected_loss, array_to_string(rlim, ',') AS limitations FROM pl WHERE state IS NULL")
def _(t):
    return decisions.document_recommendations(_sides(t)["comparisons"]).select("subject", "recommendation", "expected_loss", F.array_join("limitations", ",").alias("limitations"))


@query("s143_plan_summary", _SIDES + "SELECT rec AS recommendation, count(*) AS n, count(*) FILTER (loss <> 'NONE') AS location_changes FROM pl GROUP BY 1")
def _(t):
    return decisions.plan_summary(_plan(t))


_ATT = _SIDES + ", att AS (SELECT subject, rec AS recommendation, CASE WHEN rec = 'MANUAL_REVIEW' AND (cn > 0 OR len(list_filter(rlim, lambda x: x LIKE 'MATERIAL\\_%' ESCAPE '\\' OR x LIKE 'BUNDLE\\_%' ESCAPE '\\')) > 0) THEN 0 ELSE CASE rec WHEN 'ARCHIVE' THEN 1 WHEN 'MERGE' THEN 2 WHEN 'REVIEW_EXACT_DUPLICATE' THEN 3 WHEN 'MANUAL_REVIEW' THEN 4 ELSE 5 END END AS priority FROM pl WHERE rec <> 'KEEP' AND state IS DISTINCT FROM 'PROTECTED') "


@query("s076_attention_report", _ATT + "SELECT subject, recommendation, priority, greatest((SELECT count(*) FROM att) - 25, 0) AS omitted FROM att ORDER BY priority, subject LIMIT 25")
def _(t):
    return decisions.attention(_plan(t))


@query("s077_attention_priorities", _ATT + "SELECT priority, count(*) AS n FROM att GROUP BY 1")
def _(t):
    p = _plan(t).filter("recommendation <> 'KEEP' and not (state <=> 'PROTECTED')")
    return p.groupBy(decisions.attention_priority(F.col("recommendation"), F.col("counter"), F.col("limitations")).alias("priority")).agg(F.count("*").alias("n"))


@query("s132_next_action", _ATT + "SELECT CASE WHEN (SELECT count(*) FROM d WHERE len(cnt) > 0) > 0 THEN 'REVIEW_DECISION_QUESTION' WHEN (SELECT count(*) FROM att) > 0 THEN 'REVIEW_HIGHEST_PRIORITY_ITEM' ELSE 'RETAIN_SHADOW_REPORT' END AS action")
def _(t):
    c = duplicates.kept(classified(t))
    items = decisions.attention(_plan(t, c)).count()
    return c.agg(F.count_if(F.size("counter") > 0).alias("questions")).select(decisions.next_action(F.col("questions"), F.lit(items)).alias("action"))


@query("s092_evidence_coverage", _SIDES + "SELECT 'CLASSIFICATION' AS claim_kind, artifact_id AS claim_id, CASE WHEN len(sup) = 0 THEN 'UNSUPPORTED' WHEN len(cnt) = 0 AND len(lim) = 0 THEN 'SUPPORTED' ELSE 'PARTIAL' END AS status FROM d UNION ALL SELECT 'RECOMMENDATION', subject, 'REVIEW_REQUIRED' FROM pl UNION ALL SELECT 'NEAR_DUPLICATE_CANDIDATE', CAST(item_id AS VARCHAR), 'REVIEW_REQUIRED' FROM benchmark")
def _(t):
    c = duplicates.kept(classified(t))
    return decisions.evidence_coverage(c, _plan(t, c), t("benchmark").select(F.col("item_id").cast("string").alias("candidate_id")))


@query("s037_document_pairs", """WITH d AS (SELECT s_nationkey AS topic, s_name AS path, CASE WHEN s_acctbal > 5000 THEN 'expert' WHEN s_acctbal > 0 THEN 'user' END AS audience, CASE WHEN s_suppkey > 50 THEN 'current' ELSE 'draft' END AS lifecycle, CASE WHEN s_acctbal > 9000 THEN 'AUDIT_RECORD' WHEN s_acctbal > 8500 THEN 'DECISION_RECORD' END AS role,
 CASE WHEN s_suppkey % 5 = 0 THEN 'p' WHEN s_suppkey % 5 = 1 THEN 'q' END AS claim, CASE WHEN s_acctbal < -500 THEN 'x' WHEN s_acctbal < 1000 THEN 'y' END AS value, CASE WHEN s_suppkey % 10 = 0 THEN 'CURRENT' ELSE NULL END AS status FROM supplier),
k AS (SELECT l.topic, l.path AS left_path, r.path AS right_path, concat_ws(',', CASE WHEN l.claim <> r.claim THEN 'claim' END, CASE WHEN l.value <> r.value THEN 'value' END, CASE WHEN l.status <> r.status THEN 'status' END) AS conflicting, l.audience IS DISTINCT FROM r.audience OR l.role IS NOT NULL OR r.role IS NOT NULL AS other, l.lifecycle <> r.lifecycle AS cycle FROM d l JOIN d r ON l.topic = r.topic AND l.path < r.path)
SELECT topic, left_path, right_path, conflicting, CASE WHEN conflicting <> '' THEN 'DO_NOT_MERGE' WHEN other THEN 'CANONICALIZE_WITHOUT_MERGE' WHEN cycle THEN 'PARTIAL_MERGE_CANDIDATE' ELSE 'MANUAL_REVIEW' END AS subtype FROM k""")
def _(t):
    b, n = F.col("s_acctbal"), F.col("s_suppkey")
    d = t("supplier").select(F.col("s_nationkey").alias("topic"), F.col("s_name").alias("path"), F.when(b > 5000, "expert").when(b > 0, "user").alias("audience"), F.when(n > 50, "current").otherwise("draft").alias("lifecycle"), F.when(b > 9000, "AUDIT_RECORD").when(b > 8500, "DECISION_RECORD").alias("role"), F.when(n % 5 == 0, "p").when(n % 5 == 1, "q").alias("claim"), F.when(b < -500, "x").when(b < 1000, "y").alias("value"), F.when(n % 10 == 0, "CURRENT").alias("status"))
    return relationships.document_pairs(d).withColumn("conflicting", F.array_join("conflicting", ","))


@query("s138_canonical_entries", """SELECT a.s_nationkey, a.s_name AS entry_point, coalesce(string_agg(b.s_name, ',' ORDER BY b.s_name), '') AS retained
FROM supplier a LEFT JOIN supplier b ON b.s_nationkey = a.s_nationkey AND b.s_name <> a.s_name WHERE a.s_suppkey % 5 = 0 GROUP BY 1, 2""")
def _(t):
    d = t("supplier").select("s_nationkey", F.col("s_name").alias("path"), (F.col("s_suppkey") % 5 == 0).alias("canonical_entry"))
    return relationships.canonical_entries(d, "s_nationkey").withColumn("retained", F.array_join("retained", ","))


@query("s088_status_transitions", """WITH s AS (SELECT o_orderkey AS path, CASE o_orderstatus WHEN 'O' THEN 'UNRESOLVED' WHEN 'F' THEN 'ACTIVE_MAINLINE' END AS a, CASE WHEN o_orderpriority LIKE '1%' THEN 'ACTIVE_MAINLINE' WHEN o_orderpriority LIKE '2%' THEN 'REQUIRED' ELSE 'UNRESOLVED' END AS b FROM orders),
x AS (SELECT path, CASE WHEN coalesce(a, 'UNRESOLVED') = 'UNRESOLVED' AND b <> 'UNRESOLVED' THEN 'NEWLY_LINKED' WHEN a <> 'UNRESOLVED' AND b = 'UNRESOLVED' THEN 'NEWLY_CONFLICTING' WHEN coalesce(a, 'UNRESOLVED') = b THEN 'STILL_UNRESOLVED' END AS transition FROM s) SELECT * FROM x WHERE transition IN ('NEWLY_LINKED', 'NEWLY_CONFLICTING') OR (transition = 'STILL_UNRESOLVED' AND path IN (SELECT path FROM s WHERE b = 'UNRESOLVED'))""")
def _(t):
    o, p = t("orders"), F.col("o_orderpriority")
    a = o.select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderstatus") == "O", "UNRESOLVED").when(F.col("o_orderstatus") == "F", "ACTIVE_MAINLINE").alias("status"))
    b = o.select(F.col("o_orderkey").alias("path"), F.when(p.startswith("1"), "ACTIVE_MAINLINE").when(p.startswith("2"), "REQUIRED").otherwise("UNRESOLVED").alias("status"))
    return snapshots.status_transitions(a, b)


@query("s093_expected_state", W + "SELECT path FROM inv WHERE doc_id % 9 <> 4")
def _(t):
    i = inventory(t)
    return snapshots.unchanged_state(i.select("path"), i.filter("doc_id % 9 = 4"))


@query("s093_expected_state_hash", W + """, l AS (SELECT source, path, '["' || path || '","FILE",' || size_bytes || ',420,"' || sha256(text) || '"]' AS j FROM inv WHERE doc_id % 9 <> 4 UNION ALL SELECT DISTINCT source, '.git/HEAD', '[".git/HEAD","GIT_HEAD","h-' || source || '"]' FROM inv)
SELECT source, 'sha256:' || sha256('[' || string_agg(j, ',' ORDER BY path) || ']') AS state FROM l GROUP BY 1""")
def _(t):
    i = inventory(t)
    base = i.select("source", "path", F.lit("FILE").alias("kind"), F.col("size_bytes").alias("size"), F.lit(0o644).alias("mode"), F.sha2("text", 256).alias("digest"))
    heads = i.select("source").distinct().withColumn("head", F.concat(F.lit("h-"), "source"))
    return snapshots.expected_state(base, i.filter("doc_id % 9 = 4").select("source", "path"), heads, "source")


@query("s034_set_mismatch", "SELECT coalesce(c, o) AS custkey, CASE WHEN c IS NULL THEN 'RIGHT_ONLY' ELSE 'LEFT_ONLY' END AS side FROM (SELECT DISTINCT c_custkey AS c FROM customer WHERE c_custkey % 10 <> 0) FULL JOIN (SELECT DISTINCT o_custkey AS o FROM orders WHERE o_orderkey % 3 = 0) ON c = o WHERE c IS NULL OR o IS NULL")
def _(t):
    return snapshots.set_mismatch(t("customer").filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("custkey")), t("orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("custkey")), "custkey")


_GOLD = """WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS n, ps.p_brand AS repo, substr(ps.p_brand, 1, 7) AS fam, l_linestatus AS language, l_returnflag AS repository_type, l_linenumber AS ln, l_quantity AS q, l_tax AS x FROM lineitem l JOIN part ps ON ps.p_partkey = l.l_partkey),
c AS (SELECT n AS case_id, CASE WHEN ln <= 2 THEN 'inventory_artifact' WHEN ln = 3 THEN 'exact_byte_duplicate' WHEN ln = 4 THEN 'capability_family' WHEN ln = 5 THEN 'change_episode' ELSE 'intent' END AS claim_type, CASE WHEN q > 30 THEN 'HIGH' WHEN q > 10 THEN 'STRONG' ELSE 'LOW' END AS confidence,
 language, repository_type, CASE WHEN q = 7 AND ln < 3 AND x > 0.05 THEN 'ABSTAINED' WHEN ln = 3 AND q > 45 THEN 'UNRESOLVED' ELSE 'ASSERTED' END AS prediction, repo, fam, q, x, ln, CASE WHEN q = 50 THEN 'v1' ELSE 'v2' END AS version,
 CASE WHEN q = 1 THEN NULL WHEN q = 2 THEN 'DISAGREED' WHEN (ln <= 2 AND q = 3) OR (ln = 3 AND q > 45) OR (ln = 4 AND (q = 4 OR q < 10 AND x < 0.05)) OR (ln = 5 AND q BETWEEN 11 AND 14) THEN 'UNSUPPORTED' ELSE 'SUPPORTED' END AS truth FROM b) """


def gold(t) -> DataFrame:
    """Cases of both versions from line items: reviewers, repositories and predictions by rules on their columns."""
    b = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    q, ln, x = F.col("l_quantity"), F.col("l_linenumber"), F.col("l_tax")
    bad = ((ln <= 2) & (q == 3)) | ((ln == 3) & (q > 45)) | ((ln == 4) & ((q == 4) | ((q < 10) & (x < 0.05)))) | ((ln == 5) & q.between(11, 14))
    s, u = F.lit("SUPPORTED"), F.lit("UNSUPPORTED")
    c = b.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("case_id"), F.when(ln <= 2, "inventory_artifact").when(ln == 3, "exact_byte_duplicate").when(ln == 4, "capability_family").when(ln == 5, "change_episode").otherwise("intent").alias("claim_type"),
        F.when(q > 30, "HIGH").when(q > 10, "STRONG").otherwise("LOW").alias("confidence"), F.col("l_linestatus").alias("language"), F.when((q == 7) & (ln < 3) & (x > 0.05), "ABSTAINED").when((ln == 3) & (q > 45), "UNRESOLVED").otherwise("ASSERTED").alias("prediction"),
        F.col("l_returnflag").alias("repository_type"), F.when(q == 1, F.array(s)).when(q == 2, F.array(s, u)).when(bad, F.array(u, u)).otherwise(F.array(s, s, s)).alias("labels"), F.col("p_brand").alias("repository_id"), F.substring("p_brand", 1, 7).alias("repository_family"), q.alias("q"))
    return evaluation.normalize_cases(c.filter("q = 50"), c.filter("q <> 50"))


@query("s146_normalized_cases", _GOLD + "SELECT version, claim_type, truth, count(*) AS n, count(DISTINCT CASE WHEN version = 'v2' THEN repo END) AS repositories FROM c GROUP BY 1, 2, 3")
def _(t):
    return evaluation.unique_cases(gold(t)).groupBy("version", "claim_type", "truth").agg(F.count("*").alias("n"), F.count_distinct("repository_id").alias("repositories"))


_LOW = "round((tp / t + 3.8414588206941236 / (2 * t) - 1.959963984540054 * sqrt(((tp / t) * (1 - tp / t) + 3.8414588206941236 / (4 * t)) / t)) / (1 + 3.8414588206941236 / t), 12)"
_GATE = _GOLD + f""", gt(gate, claim_type, wanted, metric, threshold, bounded, lc, lu) AS (VALUES ('inventory-recall', 'inventory_artifact', NULL, 'recall', 0.999, false, 1000, 100), ('exact-byte-duplicate-precision', 'exact_byte_duplicate', NULL, 'precision', 1.0, false, 1000, 100), ('capability-family-high-precision', 'capability_family', 'HIGH', 'precision', 0.95, true, 100, 50), ('change-episode-strong-precision', 'change_episode', 'STRONG', 'precision', 0.9, true, 100, 50)),
j AS (SELECT gt.*, c.*, wanted IS NULL OR confidence = wanted AS ch, truth IN ('SUPPORTED', 'UNSUPPORTED') AS sure FROM gt JOIN c ON c.claim_type = gt.claim_type),
a AS (SELECT gate, count(*) FILTER (ch AND sure) AS reviewed, count(*) FILTER (ch AND sure AND version = 'v2') AS cases, count(DISTINCT CASE WHEN ch AND sure AND version = 'v2' THEN repo END) AS repos, count(DISTINCT CASE WHEN ch AND sure AND version = 'v2' THEN fam END) AS fams,
 count(*) FILTER (version = 'v2' AND truth = 'UNSUPPORTED') AS bad, count(*) FILTER (ch AND version = 'v2' AND truth = 'SUPPORTED' AND prediction = 'ASSERTED') AS tp, count(*) FILTER (ch AND sure AND version = 'v2' AND prediction = 'ASSERTED') AS asserted, count(*) FILTER (ch AND version = 'v2' AND truth = 'SUPPORTED') AS sup FROM j GROUP BY 1),
v AS (SELECT gt.*, a.* EXCLUDE (gate), CASE metric WHEN 'precision' THEN asserted ELSE sup END AS t FROM gt LEFT JOIN a USING (gate)),
w AS (SELECT gate, threshold, CASE WHEN coalesce(reviewed, 0) = 0 THEN 'NO_REVIEWED_CASES' WHEN repos < 5 OR fams < 3 THEN 'INSUFFICIENT_REPOSITORY_DIVERSITY' WHEN cases < lc THEN 'INSUFFICIENT_REVIEWED_CASES' WHEN bad < lu THEN 'INSUFFICIENT_LABEL_DISTRIBUTION' END AS reason, CASE WHEN t > 0 THEN CASE WHEN bounded THEN {_LOW} ELSE round(tp / t, 12) END END AS value FROM v),
z AS (SELECT gate, CASE WHEN reason IS NULL AND value >= threshold THEN 'PASSED' ELSE 'BLOCKED' END AS status, reason, CASE WHEN reason IS NULL THEN value END AS value FROM w)"""


@query("s058_admission_gates", _GATE + " SELECT gate, status, reason, round(value, 9) AS value FROM z")
def _(t):
    return evaluation.metric_gates(gold(t)).withColumn("value", F.round("value", 9))


_MUT = """, mc AS (SELECT CASE event_type WHEN 'purchase' THEN 'ARCHIVE' ELSE 'QUARANTINE' END AS op, event_id, user_id, event_id % 4 AS fam, value < -1 AS unsafe, event_id % 6 = 0 AS old FROM events WHERE event_type IN ('purchase', 'error')),
mg AS (SELECT op, count(*) FILTER (NOT old) AS n, count(DISTINCT CASE WHEN NOT old THEN user_id END) AS r, count(DISTINCT CASE WHEN NOT old THEN fam END) AS f, count(*) FILTER (NOT old AND unsafe) AS bad FROM mc GROUP BY 1),
mz AS (SELECT 'mutation-risk-corpus:' || o.op AS gate, CASE WHEN n IS NOT NULL AND r >= 5 AND f >= 3 AND n >= 3000 AND bad = 0 THEN 'PASSED' ELSE 'BLOCKED' END AS status, CASE WHEN n IS NULL THEN 'NO_RISK_CASES' WHEN r < 5 OR f < 3 THEN 'INSUFFICIENT_REPOSITORY_DIVERSITY' END AS reason, coalesce(n, 0) AS cases FROM (VALUES ('ARCHIVE'), ('QUARANTINE'), ('DELETE')) o(op) LEFT JOIN mg USING (op))"""


def mutations(t) -> DataFrame:
    e = t("events").filter(F.col("event_type").isin("purchase", "error"))
    unsafe = F.col("value") < -1
    op = F.when(F.col("event_type") == "purchase", "ARCHIVE").otherwise("QUARANTINE").alias("operation_class")
    v1 = e.filter("event_id % 6 = 0").select(F.col("event_id").alias("candidate_id"), op, F.lit(True).alias("invariants_passed"), unsafe.alias("unsafe_false_positive"))
    v2 = e.filter("event_id % 6 <> 0").select(F.col("event_id").alias("candidate_id"), op, F.when(unsafe, "UNSAFE_FALSE_POSITIVE").otherwise("SAFE").alias("outcome"), F.array(F.lit("PASSED"), F.lit("PASSED")).alias("invariants"), F.col("user_id").cast("string").alias("repository_id"), (F.col("event_id") % 4).cast("string").alias("repository_family"))
    return evaluation.normalize_mutations(v1, v2)


@query("s060_mutation_gates", "WITH one AS (SELECT 1)" + _MUT + " SELECT gate, status, reason, cases FROM mz")
def _(t):
    return evaluation.mutation_gates(mutations(t), ["ARCHIVE", "QUARANTINE", "DELETE"])


@query("s061_verdict", _GATE + _MUT + " SELECT count(*) AS gates, count(*) FILTER (status = 'PASSED') AS passed, CASE WHEN bool_and(status = 'PASSED') THEN 'ADMISSION_READY' ELSE 'SHADOW_ONLY' END AS verdict FROM (SELECT gate, status FROM z UNION ALL SELECT gate, status FROM mz WHERE gate NOT LIKE '%DELETE')")
def _(t):
    return evaluation.verdict(evaluation.metric_gates(gold(t)).select("gate", "status").unionByName(evaluation.mutation_gates(mutations(t)).select("gate", "status")))


_EPI = "SELECT p_brand, count(*) FILTER (p_size > 47) AS d, count(*) FILTER (p_retailprice > 1950) AS c, bool_or(p_size = 1) AS h, bool_or(p_size = 2) AS o FROM part GROUP BY 1"


@query("s049_episode_coverage", f"""WITH g AS ({_EPI}) SELECT p_brand, CASE WHEN c > 0 AND d > 0 THEN 'AVAILABLE_MIXED_EVIDENCE' WHEN c > 0 THEN 'AVAILABLE_GIT_COCHANGE_ONLY' WHEN d > 0 THEN 'AVAILABLE_DECLARED_ONLY' WHEN h THEN 'AVAILABLE_GIT_COCHANGE_ONLY' ELSE 'UNAVAILABLE' END AS status,
 CASE WHEN c > 0 THEN concat_ws(',', CASE WHEN d > 0 THEN 'CHANGE_EPISODE_DECLARED_ONLY' END, CASE WHEN o THEN 'GIT_COCHANGE_MEMBER_LIMIT' END, 'GIT_COCHANGE_NOT_COMMON_PURPOSE') WHEN d > 0 THEN concat_ws(',', 'CHANGE_EPISODE_DECLARED_ONLY', CASE WHEN o THEN 'GIT_COCHANGE_MEMBER_LIMIT' END) WHEN h THEN CASE WHEN o THEN 'GIT_COCHANGE_MEMBER_LIMIT' ELSE 'NO_MULTI_ARTIFACT_CURRENT_COCHANGE' END ELSE 'CHANGE_EPISODE_EVIDENCE_UNAVAILABLE' END AS limitations FROM g""")
def _(t):
    z = F.col("p_size")
    g = t("part").groupBy("p_brand").agg(F.count_if(z > 47).alias("d"), F.count_if(F.col("p_retailprice") > 1950).alias("c"), F.bool_or(z == 1).alias("h"), F.bool_or(z == 2).alias("o"))
    status, limits = relationships.episode_coverage(F.col("d"), F.col("c"), F.col("h"), F.col("o"))
    return g.select("p_brand", status.alias("status"), F.array_join(limits, ",").alias("limitations"))


@query("s049_family_and_role_coverage", """WITH g AS (SELECT p_brand, count(*) FILTER (p_size > 47) AS f, count(*) FILTER (p_size = 40) AS r, bool_or(p_size = 3) AS x, bool_or(p_size = 4) AS d FROM part GROUP BY 1)
SELECT p_brand, CASE WHEN f > 0 THEN 'AVAILABLE_DECLARED_ONLY' WHEN x THEN 'PARTIAL_SYNTAX_ONLY' ELSE 'UNAVAILABLE' END AS family_status, CASE WHEN f > 0 THEN 'CAPABILITY_FAMILY_DECLARED_ONLY' WHEN x THEN 'CAPABILITY_FAMILY_SYNTAX_ONLY_NO_EQUIVALENCE,PYTHON_SYNTAX_NOT_RUNTIME_BEHAVIOR' ELSE 'CAPABILITY_FAMILY_EVIDENCE_UNAVAILABLE' END AS family_limitations,
 CASE WHEN d AND r > 0 THEN 'PARTIAL_DECLARED_ONLY' WHEN x THEN 'PARTIAL_SYNTAX_ONLY' ELSE 'UNAVAILABLE' END AS role_status, CASE WHEN d AND r > 0 THEN 'IMPLEMENTATION_ROLE_DECLARED_ONLY' WHEN x THEN 'PYTHON_SYNTAX_NOT_RUNTIME_BEHAVIOR' ELSE 'IMPLEMENTATION_ROLE_EVIDENCE_UNAVAILABLE' END AS role_limitations FROM g""")
def _(t):
    z = F.col("p_size")
    g = t("part").groupBy("p_brand").agg(F.count_if(z > 47).alias("f"), F.count_if(z == 40).alias("r"), F.bool_or(z == 3).alias("x"), F.bool_or(z == 4).alias("d"))
    (fs, fl), (rs, rl) = relationships.family_coverage(F.col("f"), F.col("x")), relationships.role_coverage(F.col("d"), F.col("r"), F.col("x"))
    return g.select("p_brand", fs.alias("family_status"), F.array_join(fl, ",").alias("family_limitations"), rs.alias("role_status"), F.array_join(rl, ",").alias("role_limitations"))


@query("s030_git_overlay", W + """, s AS (SELECT path, CASE WHEN doc_id % 6 = 0 THEN '??' WHEN doc_id % 6 = 1 THEN ' M' WHEN doc_id % 6 = 2 THEN '  ' END AS code, lang = 'en' AS t, path LIKE 'src3/%' OR path LIKE 'src4/de/%' AS ign, CASE doc_id % 10 WHEN 9 THEN 'DIRECTORY' WHEN 8 THEN 'SPECIAL_FILE' WHEN 7 THEN 'SYMLINK' ELSE 'REGULAR_FILE' END AS o FROM inv),
c AS (SELECT path, o, t, coalesce(code, CASE WHEN ign THEN '!!' END) AS code FROM s),
x AS (SELECT path, o, t AS tracked, t AND coalesce(code <> '  ', false) AS modified, NOT t AND coalesce(code = '??', false) AS untracked, NOT t AND coalesce(code = '!!', false) AS ignored_included, CASE WHEN t OR code IN ('??', '!!') THEN code END AS index_status FROM c)
SELECT path, o AS object_type, CASE WHEN o IN ('REGULAR_FILE', 'SYMLINK') THEN tracked END AS tracked, CASE WHEN o IN ('REGULAR_FILE', 'SYMLINK') THEN modified END AS modified, CASE WHEN o IN ('REGULAR_FILE', 'SYMLINK') THEN untracked END AS untracked,
 CASE WHEN o IN ('REGULAR_FILE', 'SYMLINK') THEN ignored_included END AS ignored_included, CASE WHEN o IN ('REGULAR_FILE', 'SYMLINK') THEN index_status END AS index_status FROM x""")
def _(t):
    i, k = inventory(t), F.col("doc_id") % 6
    folders = i.sparkSession.createDataFrame([("src3/", "!!"), ("src4/de/", "!!")], "path string, code string")
    codes = i.filter(k < 3).select("path", F.when(k == 0, "??").when(k == 1, " M").otherwise("  ").alias("code"))
    return relationships.overlay_status(i.select("path", F.when(F.col("doc_id") % 10 == 9, "DIRECTORY").when(F.col("doc_id") % 10 == 8, "SPECIAL_FILE").when(F.col("doc_id") % 10 == 7, "SYMLINK").otherwise("REGULAR_FILE").alias("object_type")), i.filter("lang = 'en'"), codes.unionByName(folders))


@query("s124_mainline_status", """WITH c AS (SELECT o_custkey AS path, CASE o_orderstatus WHEN 'F' THEN 'REQUIRED' WHEN 'O' THEN 'HISTORICAL_EVIDENCE' ELSE 'ACTIVE_MAINLINE' END AS status FROM orders), a AS (SELECT count(DISTINCT path) AS n FROM c WHERE status = 'ACTIVE_MAINLINE')
SELECT path, CASE WHEN count(DISTINCT status) > 1 OR (min(status) = 'ACTIVE_MAINLINE' AND (SELECT n FROM a) > 1) THEN 'UNRESOLVED' ELSE min(status) END AS status FROM c GROUP BY 1""")
def _(t):
    s = F.col("o_orderstatus")
    return decisions.mainline_status(t("orders").select(F.col("o_custkey").alias("path"), F.when(s == "F", "REQUIRED").when(s == "O", "HISTORICAL_EVIDENCE").otherwise("ACTIVE_MAINLINE").alias("status")))


@query("s080_decision_question", """WITH c AS (SELECT p_name || '/' || p_partkey AS path, p_size % 4 AS s, p_partkey % 3 AS k, p_size AS a, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS amb, CASE WHEN length(repeat(p_type, 8)) < 128 THEN 1 ELSE 2 END AS cost FROM part),
v AS (SELECT path, greatest(1, s + k) * greatest(1, a) * amb * CASE WHEN k > 0 THEN 2 ELSE 1 END + cost AS score FROM c) SELECT path, score, 'Which scoped intent claim governs ' || path || '?' AS question FROM v ORDER BY score DESC, path LIMIT 1""")
def _(t):
    ids = lambda n: F.array_repeat(F.lit("e"), n.cast("int"))
    c = t("part").select(F.concat("p_name", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"), ids(F.col("p_size") % 4).alias("supporting"), ids(F.col("p_partkey") % 3).alias("counter"), ids(F.col("p_size")).alias("affected"), F.when(F.col("p_partkey") % 2 == 0, "CONFLICT").otherwise("OPEN").alias("status"), F.repeat("p_type", F.lit(8)).alias("scope"))
    return decisions.decision_question(c)


@query("s081_hash_chain", """WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, sha256(event_id || ':' || event_type) AS h FROM events), c AS (SELECT *, coalesce(lag(h) OVER (PARTITION BY user_id ORDER BY seq), CASE WHEN user_id % 7 <> 4 THEN 'sha256:' || repeat('0', 64) END) AS prev FROM e),
b AS (SELECT user_id, CASE WHEN user_id % 7 = 1 AND seq >= 3 THEN seq + 1 WHEN user_id % 7 = 5 AND seq = 3 THEN 2 ELSE seq END AS seq, CASE WHEN user_id % 7 = 2 AND seq = 2 THEN 'x' ELSE prev END AS prev, CASE WHEN user_id % 7 = 3 AND seq = 2 THEN 'y' ELSE h END AS own, h FROM c),
x AS (SELECT user_id, seq + 1 AS seq, min(own) AS lo, max(own) AS hi FROM b GROUP BY 1, 2),
l AS (SELECT b.*, row_number() OVER (PARTITION BY b.user_id ORDER BY b.seq) AS r, CASE WHEN b.seq = 1 THEN 'sha256:' || repeat('0', 64) WHEN lo = hi THEN lo END AS want FROM b LEFT JOIN x ON x.user_id = b.user_id AND x.seq = b.seq)
SELECT user_id, count(*) AS events, bool_and(seq = r) AS contiguous, bool_and(want IS NOT DISTINCT FROM prev) AS linked, bool_and(own = h) AS hashed FROM l GROUP BY 1""")
def _(t):
    from pyspark.sql import Window

    w, u = Window.partitionBy("user_id").orderBy("ts", "event_id"), F.col("user_id") % 7
    h = F.sha2(F.concat(F.col("event_id").cast("string"), F.lit(":"), "event_type"), 256)
    e = t("events").withColumn("n", F.row_number().over(w)).withColumn("prev", F.coalesce(F.lag(h).over(w), F.when(u != 4, ledgers.ZERO)))  # chains with gaps, repeated numbers, false links, no beginning and false hashes
    n = F.col("n")
    e = e.withColumn("seq", F.when((u == 1) & (n >= 3), n + 1).when((u == 5) & (n == 3), 2).otherwise(n)).withColumn("prev", F.when((u == 2) & (n == 2), "x").otherwise(F.col("prev"))).withColumn("own", F.when((u == 3) & (n == 2), "y").otherwise(h))
    return ledgers.verify_chain(e, "user_id", "seq", "prev", "own", h)


def _nodes(t) -> DataFrame:
    """The inventory with its directories and, in one of them, a file without identity."""
    i = inventory(t)
    none = F.array().cast("array<string>")
    deep = F.when(F.col("doc_id") % 10 == 0, F.regexp_replace("path", "/doc", "/deep/er/doc")).otherwise(F.col("path"))
    files = i.select(deep.alias("path"), F.lit("REGULAR_FILE").alias("object_type"), F.when(F.col("doc_id") != 30, F.col("content_id")).alias("content_id"), (F.col("doc_id") % 2 == 0).alias("executable"), F.lit(None).cast("string").alias("symlink_target_text"), F.when(F.col("doc_id") == 30, F.array(F.lit("RESOURCE_LIMIT_REACHED"))).otherwise(none).alias("warnings"))
    parts = F.split("path", "/")
    up = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("path")).distinct().unionByName(files.sparkSession.createDataFrame([(".",)], "path string"))
    return files.unionByName(up.select("path", F.lit("DIRECTORY").alias("object_type"), F.lit(None).cast("string").alias("content_id"), F.lit(True).alias("executable"), F.lit(None).cast("string").alias("symlink_target_text"), F.when(F.col("path") == "src2/de", F.array(F.lit("DIRECTORY_ENTRY_LIMIT"))).otherwise(none).alias("warnings")))


_CHILD = "'{\"content_id\":\"' || content_id || '\",\"executable\":' || executable || ',\"name\":\"' || split_part(path, '/', -1) || '\",\"object_type\":\"' || object_type || '\",\"symlink_target_text\":null}'"
_MERKLE = W + """, n4 AS (SELECT CASE WHEN doc_id % 10 = 0 THEN replace(path, '/doc', '/deep/er/doc') ELSE path END AS path, 'REGULAR_FILE' AS object_type, CASE WHEN doc_id <> 30 THEN content_id END AS content_id, doc_id % 2 = 0 AS executable, CASE WHEN doc_id = 30 THEN ['RESOURCE_LIMIT_REACHED'] ELSE []::VARCHAR[] END AS w FROM inv), """ + ", ".join(
    f"""c{k} AS (SELECT * FROM n4 WHERE len(string_split(path, '/')) = {k} {f"UNION ALL SELECT path, 'DIRECTORY', content_id, true, w FROM g{k}" if k < 5 else ""}),
g{k - 1} AS (SELECT p AS path, CASE WHEN ok AND p <> 'src2/de' THEN 'merkle-dir-v1:' || sha256('[' || m || ']') END AS content_id, list_sort(list_distinct(list_concat(CASE WHEN p = 'src2/de' THEN ['DIRECTORY_ENTRY_LIMIT'] ELSE []::VARCHAR[] END, CASE WHEN ok THEN []::VARCHAR[] ELSE coalesce(tw, []::VARCHAR[]) END))) AS w
 FROM (SELECT CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS p, string_agg({_CHILD}, ',' ORDER BY split_part(path, '/', -1)) AS m, bool_and(content_id IS NOT NULL) AS ok, flatten(list(w) FILTER (content_id IS NULL)) AS tw FROM c{k} GROUP BY 1))""" for k in (5, 4, 3, 2, 1))


@query("s070_merkle_directories", _MERKLE + " " + " UNION ALL ".join(f"SELECT path, content_id, array_to_string(w, ',') AS warnings FROM g{k}" for k in range(5)))
def _(t):
    return ledgers.merkle_directories(_nodes(t)).withColumn("warnings", F.array_join("warnings", ","))


@query("s071_state_identity", W + """, a AS (SELECT source, path, '{"content_id":"' || content_id || '","executable":' || (doc_id % 2 = 0) || ',"mode":420,"mtime_ns":' || (1000000007 * doc_id) || ',"object_type":"REGULAR_FILE","repository_relative_path":"' || path || '","size_bytes":' || size_bytes || '}' AS j FROM inv)
SELECT source, 'sha256-repo-state-v1:' || sha256('{"artifacts":[' || string_agg(j, ',' ORDER BY path) || '],"repository_root_realpath":"/r/' || source || '","scheme":"sha256-repo-state-v1"}') AS state FROM a GROUP BY 1""")
def _(t):
    i = inventory(t).select("source", "path", "content_id", "size_bytes", (F.col("doc_id") % 2 == 0).alias("executable"), F.lit(420).alias("mode"), (F.lit(1000000007) * F.col("doc_id")).alias("mtime_ns"), F.lit("REGULAR_FILE").alias("object_type"))
    return ledgers.state_identity(i, "source", "/r/")


@query("s114_canonical_json", """SELECT doc_id, sha256('{"lang":' || coalesce('"' || lang || '"', 'null') || ',"n_chars":' || n_chars || ',"source":"' || source || '"}') AS canonical_sha256 FROM documents""")
def _(t):
    j = C.json_object([("source", C.json_string(F.col("source"))), ("n_chars", F.col("n_chars").cast("string")), ("lang", C.json_string(F.col("lang")))])
    return t("documents").select("doc_id", F.sha2(j, 256).alias("canonical_sha256"))


@query("s074_dense_ids", W + "SELECT path, text, 'ev_' || lpad(CAST(row_number() OVER (ORDER BY path) - 1 AS VARCHAR), 8, '0') AS evidence_id FROM inv")
def _(t):
    return duplicates.dense_ids(inventory(t).select("path", "text").repartition(40), ["path"], "evidence_id", "ev_")


@query("s069_case_collisions", r"SELECT lower(nfc_normalize(x)) AS key, count(DISTINCT x) AS paths FROM (SELECT p_brand AS x FROM part UNION ALL SELECT upper(p_brand) FROM part WHERE p_size < 20 UNION ALL SELECT 'é/' || p_brand FROM part UNION ALL SELECT 'é/' || p_brand FROM part WHERE p_size = 7) GROUP BY 1 HAVING count(DISTINCT x) > 1")
def _(t):
    p = t("part")
    paths = p.select(F.col("p_brand").alias("path")).unionByName(p.filter("p_size < 20").select(F.upper("p_brand").alias("path"))).unionByName(p.select(F.concat(F.lit("é/"), "p_brand").alias("path"))).unionByName(p.filter("p_size = 7").select(F.concat(F.lit("é/"), "p_brand").alias("path")))
    return duplicates.case_collisions(paths)
