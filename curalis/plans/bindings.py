"""The library's operators bound to the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalis.functions import columns as C
from curalis.operators import budgets, decisions, duplicates, evaluation, ledgers, relationships, snapshots

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            SQL[name] = sql
        return f

    return add


# documents as an inventory of artifacts: the format of a file follows its language
EXT = {"en": "md", "fr": "txt", "de": "rst", "es": "json"}


def inventory(t) -> DataFrame:
    ext = F.coalesce(*[F.when(F.col("lang") == k, v) for k, v in EXT.items()], F.lit("bin"))
    d = t("documents")
    return d.select(
        F.concat(F.lit("art_run_"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("artifact_id"), F.concat("source", F.lit("/"), "lang", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"),
        F.octet_length("text").cast("long").alias("size_bytes"), C.content_id(F.col("text")).alias("content_id"), "doc_id", "text", "lang", "source")


INV = """SELECT 'art_run_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS artifact_id,
  source || '/' || lang || '/doc' || doc_id || '.' || CASE lang WHEN 'en' THEN 'md' WHEN 'fr' THEN 'txt' WHEN 'de' THEN 'rst' WHEN 'es' THEN 'json' ELSE 'bin' END AS path,
  CAST(strlen(text) AS BIGINT) AS size_bytes, 'sha256-file-v1:' || sha256(text) AS content_id, doc_id, text, lang, source FROM documents"""
W = f"WITH inv AS ({INV}) "


@query("s021_inventory_projection", W + "SELECT artifact_id, path, size_bytes, content_id FROM inv")
def _(t):
    return inventory(t).select("artifact_id", "path", "size_bytes", "content_id")


@query("s044_exact_duplicate_groups", W + "SELECT content_id, count(*) AS member_count, string_agg(artifact_id, ',' ORDER BY artifact_id) AS members FROM inv GROUP BY 1 HAVING count(*) >= 2")
def _(t):
    return duplicates.exact_groups(inventory(t)).select("content_id", "member_count", F.array_join("members", ",").alias("members"))


@query("s045_duplicate_replacements", W + ", k AS (SELECT artifact_id, min(artifact_id) OVER (PARTITION BY content_id) AS replacement FROM inv) SELECT * FROM k WHERE artifact_id <> replacement")
def _(t):
    return duplicates.replacements(inventory(t))


_TOK = r"list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[A-Za-z0-9_]+|[^\s\pZ\x0B\x1C-\x1F\x85A-Za-z0-9_]'))"


@query("s050_near_duplicate_pairs", W + rf""", d AS (SELECT artifact_id, regexp_extract(lower(path), '(\.[^./]*)$', 1) AS suffix, length(bin(size_bytes)) // 2 AS bucket, content_id, {_TOK} AS toks FROM inv),
e AS (SELECT artifact_id, suffix, bucket, content_id, len(toks) AS n, unnest(toks) AS tok FROM d WHERE len(toks) >= 3),
p AS (SELECT a.artifact_id AS left_id, b.artifact_id AS right_id, a.n + b.n AS s, count(*) AS i FROM e a JOIN e b ON a.suffix = b.suffix AND a.bucket = b.bucket AND a.tok = b.tok AND a.artifact_id < b.artifact_id AND a.content_id <> b.content_id GROUP BY 1, 2, 3)
SELECT left_id, right_id, round(i / (s - i), 6) AS similarity FROM p WHERE 10 * i >= 7 * (s - i)""")
def _(t):
    return duplicates.near_pairs(inventory(t))


@query("s094_token_counts", rf"SELECT doc_id, CAST(len({_TOK}) AS BIGINT) AS n_tokens FROM documents")
def _(t):
    return t("documents").select("doc_id", F.size(C.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("s096_size_buckets", "SELECT CAST(length(bin(strlen(text))) // 2 AS BIGINT) AS bucket, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return t("documents").groupBy(C.size_bucket(F.octet_length("text")).alias("bucket")).agg(F.count("*").alias("n"))


@query("s097_path_parts", W + r"SELECT path, regexp_extract(lower(path), '(\.[^./]*)$', 1) AS suffix, regexp_replace(path, '/[^/]*$', '') AS parent, split_part(path, '/', -1) AS basename, CAST(len(string_split(path, '/')) AS BIGINT) AS depth FROM inv")
def _(t):
    p = F.col("path")
    return inventory(t).select("path", C.suffix(p).alias("suffix"), C.parent(p).alias("parent"), C.basename(p).alias("basename"), C.depth(p).cast("long").alias("depth"))


@query("s117_destinations", W + "SELECT path, 'archive/' || substr(sha256(path), 1, 16) || '-' || split_part(path, '/', -1) AS destination FROM inv")
def _(t):
    return inventory(t).select("path", C.destination("archive", F.col("path")).alias("destination"))


_SQL_SECRETS = ", ".join("CASE WHEN regexp_matches(text, '{}') THEN '{}' END".format(p.replace("[\\s\\S]*?", "(?:.|\\n)*?"), n) for n, p in C.SECRETS)


@query("s027_secret_categories", f"SELECT doc_id, array_to_string(list_sort(list_filter([{_SQL_SECRETS}], lambda x: x IS NOT NULL)), ',') AS categories FROM documents")
def _(t):
    return t("documents").select("doc_id", F.array_join(C.secret_categories(F.col("text")), ",").alias("categories"))


_SQL_REDACT = "text"
for _n, _p in C.SECRETS:
    _SQL_REDACT = "regexp_replace({}, '{}', '[REDACTED:{}]', 'g')".format(_SQL_REDACT, _p.replace("[\\s\\S]*?", "(?:.|\\n)*?"), _n)


@query("s027_redacted_text", f"SELECT doc_id, sha256({_SQL_REDACT}) AS redacted_sha256 FROM documents")
def _(t):
    return t("documents").select("doc_id", F.sha2(C.redact(F.col("text")), 256).alias("redacted_sha256"))


@query("s086_snapshot_changes", W + """, a AS (SELECT path, content_id FROM inv), b AS (SELECT CASE WHEN source = 'src7' THEN 'moved/' || path ELSE path END AS path, CASE WHEN lang = 'fr' THEN 'sha256-file-v1:' || sha256(text || ' ') ELSE content_id END AS content_id FROM inv WHERE source <> 'src5')
SELECT path, CASE WHEN a.path IS NULL THEN 'ADDED' WHEN b.path IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change FROM a FULL JOIN b USING (path) WHERE a.path IS NULL OR b.path IS NULL OR a.content_id IS DISTINCT FROM b.content_id""")
def _(t):
    return snapshots.changes(*_snapshots(t)).select("path", "change")


def _snapshots(t):
    a = inventory(t)
    b = a.filter("source <> 'src5'").select(F.when(F.col("source") == "src7", F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), F.when(F.col("lang") == "fr", C.content_id(F.concat("text", F.lit(" ")))).otherwise(F.col("content_id")).alias("content_id"))
    return a.select("path", "content_id"), b


@query("s087_moves", W + """, a AS (SELECT path, content_id FROM inv), b AS (SELECT CASE WHEN source = 'src7' THEN 'moved/' || path ELSE path END AS path, CASE WHEN lang = 'fr' THEN 'sha256-file-v1:' || sha256(text || ' ') ELSE content_id END AS content_id FROM inv WHERE source <> 'src5'),
r AS (SELECT content_id, min(path) AS moved_from FROM a WHERE path NOT IN (SELECT path FROM b) GROUP BY 1 HAVING count(*) = 1), n AS (SELECT content_id, min(path) AS moved_to FROM b WHERE path NOT IN (SELECT path FROM a) GROUP BY 1 HAVING count(*) = 1)
SELECT content_id, moved_from, moved_to FROM r JOIN n USING (content_id)""")
def _(t):
    return snapshots.moves(snapshots.changes(*_snapshots(t)))


@query("s090_duplicate_keys", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return snapshots.duplicate_keys(t("part"), "p_name")


@query("s091_purge_descendants", W + "SELECT path FROM inv WHERE NOT (path LIKE 'src1/%' OR path LIKE 'src2/fr/%')")
def _(t):
    inv = inventory(t).select("path")
    return snapshots.purge_descendants(inv, inv.sparkSession.createDataFrame([("src1",), ("src2/fr",)], "path string"))


_CASES = """WITH c AS (SELECT lang, source, CASE WHEN n_chars > 1500 THEN 'ASSERTED' WHEN n_chars > 500 THEN 'UNRESOLVED' ELSE 'ABSTAINED' END AS prediction,
  CASE WHEN n_chars > 6000 THEN 'STRONG' WHEN n_chars > 3000 THEN 'HIGH' WHEN n_chars > 1500 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  CASE WHEN l.doc_id IS NULL THEN NULL WHEN quality <> toxic THEN 'SUPPORTED' WHEN quality = 1 THEN 'DISAGREED' ELSE 'UNSUPPORTED' END AS t FROM documents d LEFT JOIN labels l USING (doc_id)) """


def cases(t) -> DataFrame:
    """Two reviewers of each labelled document; the prediction is a rule on its length."""
    n = F.col("n_chars")
    s = lambda c: F.when(c, "SUPPORTED").otherwise("UNSUPPORTED")
    q, x = F.col("quality") == 1, F.col("toxic") == 1
    first = F.when(q, "SUPPORTED").when(x, "SUPPORTED").otherwise("UNSUPPORTED")
    second = F.when(q & x, "UNSUPPORTED").otherwise(first)
    d = t("documents").join(t("labels"), "doc_id", "left")
    return d.select(
        "doc_id", "lang", "source", F.when(n > 1500, "ASSERTED").when(n > 500, "UNRESOLVED").otherwise("ABSTAINED").alias("prediction"),
        F.when(n > 6000, "STRONG").when(n > 3000, "HIGH").when(n > 1500, "MEDIUM").otherwise("LOW").alias("confidence"), F.when(F.col("quality").isNotNull(), F.array(first, second)).otherwise(F.array().cast("array<string>")).alias("labels"))


@query("s056_reviewer_truth", _CASES + "SELECT t AS truth, count(*) AS n FROM c GROUP BY 1")
def _(t):
    return cases(t).groupBy(evaluation.truth(F.col("labels")).alias("truth")).agg(F.count("*").alias("n"))


_METRICS = """SELECT {keys}, count(*) AS candidates, count(*) FILTER (t IN ('SUPPORTED','UNSUPPORTED')) AS consensus, count(*) FILTER (t = 'DISAGREED') AS disagreement, count(*) FILTER (t IS NULL) AS unreviewed,
count(*) FILTER (prediction = 'ASSERTED' AND t = 'SUPPORTED') AS tp, count(*) FILTER (prediction = 'ASSERTED' AND t = 'UNSUPPORTED') AS fp, count(*) FILTER (prediction <> 'ASSERTED' AND t = 'SUPPORTED') AS fn,
round(tp / nullif(tp + fp, 0), 12) AS "precision", round(tp / nullif(tp + fn, 0), 12) AS recall, round(consensus / candidates, 12) AS coverage,
round(count(*) FILTER (prediction = 'ABSTAINED') / count(*), 12) AS abstention, round(count(*) FILTER (prediction = 'UNRESOLVED') / count(*), 12) AS unresolved FROM c GROUP BY {keys}"""


@query("s057_slice_metrics", _CASES + _METRICS.format(keys="lang, source"))
def _(t):
    return evaluation.slice_metrics(cases(t), ["lang", "source"])


@query("s062_risk_coverage", _CASES + """, s AS (SELECT *, CASE confidence WHEN 'STRONG' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS r FROM c WHERE t IN ('SUPPORTED','UNSUPPORTED')),
l AS (SELECT DISTINCT lang, confidence, r FROM s)
SELECT l.lang, l.confidence AS threshold, count(*) FILTER (prediction = 'ASSERTED' AND s.r >= l.r) AS accepted, round(count(*) FILTER (prediction = 'ASSERTED' AND s.r >= l.r) / count(*), 12) AS coverage,
round(count(*) FILTER (prediction = 'ASSERTED' AND s.r >= l.r AND t = 'UNSUPPORTED') / nullif(count(*) FILTER (prediction = 'ASSERTED' AND s.r >= l.r), 0), 12) AS selective_risk FROM l JOIN s ON s.lang = l.lang GROUP BY 1, 2""")
def _(t):
    return evaluation.risk_coverage(cases(t), ["lang"])


_WILSON = "round(greatest((tp / n + 3.841458820694124 / (2 * n) - 1.959963984540054 * sqrt(((tp / n) * (1 - tp / n) + 3.841458820694124 / (4 * n)) / n)) / (1 + 3.841458820694124 / n), 0), 9)"


@query("s059_wilson_bounds", _CASES + f", g AS (SELECT lang, count(*) FILTER (t = 'SUPPORTED') AS tp, count(*) FILTER (t IN ('SUPPORTED','UNSUPPORTED')) AS n FROM c GROUP BY 1) SELECT lang, tp, n, CASE WHEN n > 0 THEN {_WILSON} END AS lower_bound FROM g")
def _(t):
    c = cases(t).withColumn("t", evaluation.truth(F.col("labels")))
    g = c.groupBy("lang").agg(F.count_if(F.coalesce(F.col("t") == "SUPPORTED", F.lit(False))).alias("tp"), F.count_if(F.coalesce(F.col("t").isin("SUPPORTED", "UNSUPPORTED"), F.lit(False))).alias("n"))
    return g.select("lang", "tp", "n", C.wilson_lower(F.col("tp"), F.col("n"), 9).alias("lower_bound"))


@query("s063_identity_conflicts", "SELECT p_brand AS repository_id, count(DISTINCT (p_type, p_size)) AS identities FROM part GROUP BY 1 HAVING count(DISTINCT (p_type, p_size)) > 1")
def _(t):
    return evaluation.identity_conflicts(t("part").select(F.col("p_brand").alias("repository_id"), F.col("p_type").alias("repository_family"), F.col("p_size").alias("repository_snapshot_hash")))


@query("s046_declared_episodes", "SELECT p_brand AS episode, count(*) AS member_count, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS members FROM part GROUP BY 1 HAVING count(*) >= 2")
def _(t):
    return relationships.groups(t("part").select(F.col("p_brand").alias("episode"), "p_partkey"), "episode", "p_partkey").select("episode", "member_count", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query("s047_cochange_episodes", "SELECT l_orderkey AS commit_id, count(DISTINCT l_partkey) AS member_count, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS members FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) BETWEEN 2 AND 64")
def _(t):
    c = t("lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").cast("string").alias("path"))
    return relationships.cochange_episodes(c, "commit_id", "path").select("commit_id", "member_count", F.array_join("members", ",").alias("members"))


@query("s047_oversized_commits", "SELECT l_suppkey AS commit_id, count(DISTINCT l_partkey) AS member_count FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 64")
def _(t):
    return relationships.oversized(t("lineitem").select(F.col("l_suppkey").alias("commit_id"), F.col("l_partkey").alias("path")), "commit_id", "path")


@query("s031_commit_current_members", "SELECT l_orderkey AS commit_id, count(DISTINCT l_partkey) AS member_count FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1 HAVING count(DISTINCT l_partkey) BETWEEN 2 AND 64")
def _(t):
    c = t("lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("path"))
    return relationships.cochange_episodes(c, "commit_id", "path", t("part").filter("p_size > 25").select(F.col("p_partkey").alias("path"))).select("commit_id", "member_count")


@query("s048_capability_families", "SELECT p_type AS responsibility, count(*) AS member_count FROM part GROUP BY 1 HAVING count(*) >= 2")
def _(t):
    return relationships.groups(t("part"), "p_type", "p_partkey").select(F.col("p_type").alias("responsibility"), "member_count")


_BUNDLE = "WITH m AS (SELECT l_orderkey AS bundle, l_linenumber AS line, p.p_partkey AS artifact_id, CASE WHEN p.p_partkey IS NULL THEN 'MISSING' ELSE 'PRESENT' END AS status FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 40) p ON l_partkey = p.p_partkey) "


def bundle_members(t):
    m = t("lineitem").select(F.col("l_orderkey").alias("bundle"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("path"))
    return relationships.resolve_members(m, t("part").filter("p_size <= 40").select(F.col("p_partkey").alias("path"), F.col("p_partkey").alias("artifact_id")), "path")


@query("s029_bundle_members", _BUNDLE + "SELECT bundle, line, CAST(artifact_id AS VARCHAR) AS artifact_id, status FROM m")
def _(t):
    return bundle_members(t).select("bundle", "line", F.col("artifact_id").cast("string").alias("artifact_id"), "status")


@query("s064_bundle_completeness", _BUNDLE + "SELECT bundle, count(*) AS members, count(*) FILTER (status = 'MISSING') AS missing, CASE WHEN count(*) FILTER (status = 'MISSING') = 0 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS completeness FROM m GROUP BY 1")
def _(t):
    return relationships.bundle_completeness(bundle_members(t), "bundle")


@query("s064_incomplete_guard", _BUNDLE + ", c AS (SELECT bundle, bool_or(status = 'MISSING') AS bad FROM m GROUP BY 1) SELECT artifact_id, bool_or(bad) AS guarded FROM m JOIN c USING (bundle) WHERE artifact_id IS NOT NULL GROUP BY 1")
def _(t):
    m = bundle_members(t)
    return relationships.incomplete_guard(m, relationships.bundle_completeness(m, "bundle"), "bundle", "artifact_id").filter("artifact_id is not null")


@query("s136_declared_edges", _BUNDLE + """, k AS (SELECT bundle AS source, artifact_id AS target, line, artifact_id AS a, 'DECLARED_' || CASE WHEN line < 3 THEN 'INPUT' ELSE 'OUTPUT' END AS type FROM m WHERE artifact_id IS NOT NULL)
SELECT 'relationship_run_declared_' || lpad(CAST(row_number() OVER (ORDER BY source, type, line, a) AS VARCHAR), 8, '0') AS relationship_id, source, target, type FROM k""")
def _(t):
    m = bundle_members(t)
    line = F.concat(F.lpad(F.col("line").cast("string"), 3, "0"), F.lpad(F.coalesce(F.col("artifact_id"), F.lit(0)).cast("string"), 12, "0"))
    return relationships.declared_edges(m.withColumn("role", F.when(F.col("line") < 3, "input").otherwise("output")).withColumn("path", line), "bundle", "role", "path", "artifact_id").drop("path")


@query("s126_first_attempts", "WITH r AS (SELECT o_custkey AS attempt, o_orderkey AS ordinal, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) - 1 AS gaps FROM orders) SELECT attempt, ordinal, gaps FROM r WHERE k = 1")
def _(t):
    return relationships.first_declared(t("orders").select(F.col("o_custkey").alias("attempt"), F.col("o_orderkey").alias("ordinal")), "attempt", "ordinal")


@query("s038_reference_resolution", "SELECT conv_id AS source, role AS property, CASE WHEN turn = 0 THEN 'https://example.org/' || conv_id ELSE CAST(conv_id + turn AS VARCHAR) END AS target, CASE WHEN turn > 0 AND conv_id + turn IN (SELECT doc_id FROM labels) THEN 'PRESENT' WHEN turn = 0 THEN 'EXTERNAL' ELSE 'UNRESOLVED' END AS resolution FROM conversations")
def _(t):
    r = t("conversations").select(F.col("conv_id").alias("source"), F.col("role").alias("property"), F.when(F.col("turn") == 0, F.concat(F.lit("https://example.org/"), F.col("conv_id").cast("string"))).otherwise((F.col("conv_id") + F.col("turn")).cast("string")).alias("target"))
    return relationships.resolve_references(r, t("labels").select(F.col("doc_id").cast("string").alias("id")))


@query("s043_paired_records", "SELECT user_id, CASE WHEN bool_or(event_type = 'signup') AND bool_or(event_type = 'purchase') THEN 'COMPLETE' ELSE 'PARTIAL' END AS status FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1")
def _(t):
    e = t("events")
    return relationships.pair_full(e.filter("event_type = 'signup'"), e.filter("event_type = 'purchase'"), "user_id")


@query("s051_evidence_by_artifact", "SELECT l_partkey AS artifact_id, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS evidence_ids FROM lineitem GROUP BY 1")
def _(t):
    o = t("lineitem").select(F.col("l_partkey").alias("artifact_id"), F.array(F.col("l_suppkey").cast("string")).alias("e"))
    return relationships.evidence_by_artifact(o, "artifact_id", "e").select("artifact_id", F.array_join("evidence_ids", ",").alias("evidence_ids"))


@query("s052_value_counts", "WITH g AS (SELECT event_type AS k, count(*) AS n FROM events GROUP BY 1) SELECT string_agg(k || '=' || n, ',' ORDER BY k) AS counts FROM g")
def _(t):
    c = decisions.value_counts(t("events"), "event_type")
    return c.select(F.array_join(F.transform(F.map_entries("counts"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("counts"))


@query("s083_first_per_repository", "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, greatest(count(*) OVER (PARTITION BY source) - 5, 0) AS omitted FROM documents) SELECT * FROM r WHERE rank <= 5")
def _(t):
    return decisions.top_k_per(t("documents").select("source", "doc_id"), ["source"], [F.col("doc_id")], 5)


@query("s085_event_sequences", "SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS sequence FROM events GROUP BY 1")
def _(t):
    return ledgers.event_sequences(t("events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", F.array_join("sequence", ">").alias("sequence"))


@query("s075_prefix_budget", """WITH r AS (SELECT doc_id, source, row_number() OVER w AS k, sum(n_chars) OVER w AS s FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)), x AS (SELECT *, bool_or(k > 256 OR s > 100000) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS stop FROM r) SELECT doc_id, source FROM x WHERE NOT stop""")
def _(t):
    return ledgers.prefix_budget(t("documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], "n_chars", 256, 100_000).select("doc_id", "source")


_BUDGET = """WITH RECURSIVE r AS (SELECT doc_id, source, n_chars AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE n_chars <= {most}),
f(source, doc_id, k, n, rest, fits) AS (SELECT source, doc_id, k, n, CASE WHEN n <= {total} THEN {total} - n ELSE {total} END, n <= {total} FROM r WHERE k = 1
  UNION ALL SELECT r.source, r.doc_id, r.k, r.n, CASE WHEN r.n <= f.rest THEN f.rest - r.n ELSE f.rest END, r.n <= f.rest FROM f JOIN r ON r.source = f.source AND r.k = f.k + 1) """


@query("s036_greedy_budget", _BUDGET.format(most=1 << 40, total=20_000) + "SELECT doc_id, source, n AS n_chars FROM f WHERE fits")
def _(t):
    return budgets.greedy_budget(t("documents").select("doc_id", "source", "n_chars"), "source", "doc_id", "n_chars", 20_000)


@query("s003_content_budgets", _BUDGET.format(most=3000, total=25_000) + """SELECT d.doc_id, CASE WHEN d.n_chars > 3000 THEN 'CONTENT_HASH_SKIPPED_SIZE_LIMIT' WHEN NOT coalesce(f.fits, false) THEN 'CONTENT_HASH_SKIPPED_TOTAL_BYTES_LIMIT' END AS limitation,
 CASE WHEN f.fits THEN 'sha256-file-v1:' || sha256(text) END AS content_id FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id""")
def _(t):
    d = t("documents").select("doc_id", "source", "n_chars", "text")
    return budgets.content_budgets(d, "source", "doc_id", "n_chars", C.content_id(F.col("text")), 3000, 25_000).select("doc_id", "limitation", "content_id")


_ENTRIES = """WITH f AS (SELECT 'r' || doc_id % 5 AS a, 's' || doc_id % (3 + 4 * (doc_id % 5)) AS b, 'doc' || doc_id AS c FROM documents),
e AS (SELECT a || '/' || b || '/' || c AS path, a || '/' || b AS parent FROM f UNION SELECT a || '/' || b, a FROM f UNION SELECT a, '.' FROM f UNION SELECT '.', NULL),
w AS (SELECT parent AS wide FROM e WHERE parent IS NOT NULL GROUP BY 1 HAVING count(*) > 10) """


def entries(t) -> DataFrame:
    """Documents as files in two levels of directories of unequal width, with all directories above them."""
    k = F.col("doc_id")
    f = t("documents").select(F.concat(F.lit("r"), (k % 5).cast("string")).alias("a"), F.concat(F.lit("s"), (k % (3 + 4 * (k % 5))).cast("string")).alias("b"), F.concat(F.lit("doc"), k.cast("string")).alias("c"))
    d = f.select("a", "b").distinct()
    up = d.select(F.concat_ws("/", "a", "b").alias("path"), F.col("a").alias("parent")).unionByName(d.select(F.col("a").alias("path"), F.lit(".").alias("parent")).distinct())
    root = d.sparkSession.createDataFrame([(".", None)], "path string, parent string")
    return f.select(F.concat_ws("/", "a", "b", "c").alias("path"), F.concat_ws("/", "a", "b").alias("parent")).unionByName(up).unionByName(root)


@query("s002_listed_entries", _ENTRIES + """SELECT path, parent, CASE WHEN path IN (SELECT wide FROM w) THEN 'DIRECTORY_ENTRY_LIMIT' ELSE '' END AS warnings FROM e
WHERE NOT EXISTS (SELECT 1 FROM w WHERE wide = '.' AND path <> '.' OR starts_with(path, wide || '/'))""")
def _(t):
    return budgets.bounded_listing(entries(t), "parent", "path", 10).withColumn("warnings", F.array_join("warnings", ","))


@query("s002_bounded_listing", W + "SELECT regexp_replace(path, '/[^/]*$', '') AS parent, count(*) AS children, count(*) <= 10 AS listed FROM inv GROUP BY 1")
def _(t):
    return ledgers.wide_parents(inventory(t).select(C.parent(F.col("path")).alias("parent")), "parent", 10)


@query("s089_evidence_union", "SELECT 'documents' AS source_type, CAST(doc_id AS VARCHAR) AS record_id FROM documents UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR) FROM pages UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR) FROM benchmark UNION ALL SELECT 'conversations', conv_id || ':' || turn FROM conversations")
def _(t):
    s = lambda n, c: t(n).select(F.lit(n).alias("source_type"), c.alias("record_id"))
    out = s("documents", F.col("doc_id").cast("string"))
    for x in (s("pages", F.col("page_id").cast("string")), s("benchmark", F.col("item_id").cast("string")), s("conversations", F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")))):
        out = out.unionByName(x)
    return out


@query("s098_location_ids", W + "SELECT path, sha256(unhex('0000000000000004') || encode('root') || unhex(lpad(hex(strlen(path)), 16, '0')) || encode(path)) AS location_id FROM inv")
def _(t):
    return inventory(t).select("path", C.length_prefixed_hash([F.lit("root"), F.col("path")]).alias("location_id"))
