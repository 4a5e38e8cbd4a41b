"""Lexical counts and bound registries over files made of the tables' rows, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from curalis.operators import bindings as B
from curalis.operators import lexical as X
from curalis.plans.bindings import query
from curalis.plans.rawrecords import _L, _lines


@query("s068_pipeline_stages", _L + "SELECT k AS o_orderkey, 's' || n || '-' || s AS stage, row_number() OVER (PARTITION BY k ORDER BY n, p, s) AS ordinal, CASE WHEN n % 2 = 0 THEN 'cmd,deps' ELSE 'cmd,deps,outs' END AS fields FROM l WHERE k % 4 > 0")
def _(t):
    one = lambda x: F.concat(F.lit("  s"), x.n.cast("string"), F.lit("-"), x.s.cast("string"), F.lit(":  # a stage\n    cmd: run\n    deps:\n      - a\n    other: 1\n"), F.when(x.n % 2 == 1, "    outs:\n    cmd: again\n").otherwise("\n"), F.when((x.n % 3 == 0) & (F.col("k") % 4 > 0), "  stages:\n").otherwise(""))
    text = F.concat(F.lit("  early:\n    cmd: no\nvars: 1\n"), F.when(F.col("k") % 4 > 0, "stages:\n").otherwise("stagess:\n"), F.array_join(F.transform("x", one), ""), F.lit("after:\n  late:\n    cmd: no\n"), F.when(F.col("k") % 4 > 0, "stages:\n  never:\n").otherwise(""))
    s = X.stages(_lines(t).select(F.col("k").alias("o_orderkey"), text.alias("text")), "o_orderkey")
    return s.select("o_orderkey", "stage", "ordinal", F.array_join("fields", ",").alias("fields"))


@query("s068_locked_stages", _L + "SELECT k AS o_orderkey, CASE WHEN k % 4 > 0 THEN count(*) FILTER (n % 3 > 0) ELSE 1 END AS stages FROM l GROUP BY k")
def _(t):
    one = lambda x: F.concat(F.when(x.n % 3 == 0, "   deep").otherwise("  key "), x.n.cast("string"), F.lit(":\n    md5: 1\n\n"))
    text = F.concat(F.when(F.col("k") % 4 > 0, "stages:\n").otherwise(" stages:\n"), F.array_join(F.transform("x", one), ""), F.lit("stages:\n  not:\n"))
    return X.locked_stages(_lines(t).select(F.col("k").alias("o_orderkey"), text.alias("text")), "o_orderkey")


@query("s068_manifest_entries", _L + "SELECT k AS o_orderkey, count(*) FILTER (n >= 3 AND p % 5 > 0 AND p % 7 > 0 AND p % 11 > 0) AS entries, count(*) FILTER (n % 2 = 0) AS keys FROM l GROUP BY k")
def _(t):
    path = lambda x: F.when(x.p % 5 == 0, "../up").when(x.p % 11 == 0, "/root").otherwise(F.concat(F.lit("data/é "), x.p.cast("string")))
    one = lambda x: F.concat(F.repeat(F.lit("a"), x.n * 2 + 10), F.when(x.p % 7 == 0, " ").otherwise("  "), path(x), F.lit(" \n"))
    keys = lambda x: F.when(x.n % 2 == 0, "  a = b\n").when(x.n % 3 == 0, "  # a = b\n").otherwise("[section]\n")
    f = _lines(t).select(F.col("k").alias("o_orderkey"), F.array_join(F.transform("x", one), "").alias("text"), X.config_keys(F.array_join(F.transform("x", keys), "")).alias("keys"))
    return X.manifest_entries(f, "o_orderkey").join(f.select("o_orderkey", "keys"), "o_orderkey")


def _registries(t):
    """Repositories, runs and their files of customers, each broken in its own way by its number."""
    k = F.col("c_custkey")
    c = t("customer").select(k.cast("string").alias("id"), k.alias("k"))
    k = F.col("k")
    sha = lambda x: F.concat(F.lit("sha256:"), F.sha2(x, 256))
    d = F.concat(F.lit('{"repository_id":"'), F.when(k % 12 == 4, "other").otherwise(F.col("id")), F.lit('","git_commit_sha":"c'), F.when(k % 12 == 5, "x").otherwise(F.col("id")), F.lit('"}'))
    hashes = F.concat(F.lit('{"inventory.jsonl":"'), F.sha2(F.concat(F.lit("i"), F.col("id"), F.when(k % 12 == 10, "x").otherwise("")), 256), F.lit('","relationships.jsonl":"'), F.sha2(F.concat(F.lit("r"), F.col("id")), 256), F.lit('"}'))
    run = F.concat(F.lit('{"run_id":"'), F.when(k % 12 == 7, "x").otherwise(F.col("id")), F.lit('","git_head":"c'), F.when(k % 12 == 8, "x").otherwise(F.col("id")), F.lit('","output_file_hashes":'), F.when(k % 12 == 9, "3").otherwise(hashes), F.lit("}"))
    c = c.withColumn("d", d).withColumn("run", run)
    repositories = c.select(F.col("id").alias("repository_id"), F.concat(F.lit("d/"), "id").alias("snapshot_descriptor_path"), F.when(k % 12 == 2, sha(F.lit("x"))).otherwise(sha(F.col("d"))).alias("snapshot_descriptor_sha256"), F.concat(F.lit("c"), "id").alias("commit_sha"))
    runs = c.filter(k % 12 != 1).select(F.col("id").alias("repository_id"), F.when(k % 12 == 3, sha(F.lit("x"))).otherwise(sha(F.col("d"))).alias("snapshot_descriptor_sha256"), F.concat(F.lit("r/"), "id", F.lit("/run.json")).alias("run_path"), F.when(k % 12 == 6, sha(F.lit("x"))).otherwise(sha(F.col("run"))).alias("run_sha256"), F.col("id").alias("run_id"))
    file = lambda path, body, json: c.select(path.alias("path"), sha(body).alias("sha256"), json.cast("string").alias("json"))
    at = lambda n: F.concat(F.lit("r/"), "id", F.lit("/" + n))
    files = file(F.concat(F.lit("d/"), "id"), F.col("d"), F.col("d")).unionByName(file(at("run.json"), F.col("run"), F.col("run")))
    files = files.unionByName(file(at("inventory.jsonl"), F.concat(F.lit("i"), "id"), F.lit(None))).unionByName(file(at("relationships.jsonl"), F.concat(F.lit("r"), "id"), F.lit(None)).filter(~F.col("path").rlike("r/[0-9]*9/")))
    return c.select(F.col("id").alias("repository_id")), repositories, runs, files


@query("s033_broken_bindings", """SELECT CAST(c_custkey AS VARCHAR) AS repository_id, CASE c_custkey % 12 WHEN 1 THEN 'missing frozen source for ' WHEN 2 THEN 'snapshot descriptor hash mismatch for ' WHEN 3 THEN 'audit snapshot binding mismatch for ' WHEN 4 THEN 'snapshot descriptor repository mismatch for ' WHEN 5 THEN 'snapshot descriptor commit mismatch for ' WHEN 6 THEN 'audit run hash mismatch for '
 WHEN 7 THEN 'audit run ID mismatch for ' WHEN 8 THEN 'audit run head mismatch for ' WHEN 9 THEN 'audit output hashes are malformed for ' WHEN 10 THEN 'inventory hash mismatch for ' ELSE CASE WHEN c_custkey % 10 = 9 THEN 'relationship hash mismatch for ' END END || c_custkey AS error FROM customer""")
def _(t):
    return B.broken_bindings(*_registries(t)).select("repository_id", "error")


@query("s033_bound_sources", "SELECT CAST(c_custkey AS VARCHAR) AS repository_id, CAST(c_custkey AS VARCHAR) AS run_id, 'c' || c_custkey AS commit_sha FROM customer WHERE c_custkey % 12 IN (0, 11) AND c_custkey % 10 <> 9")
def _(t):
    asked, *rest = _registries(t)
    k = F.col("repository_id").cast("long")
    return B.bound_sources(asked.filter((k % 12).isin(0, 11) & (k % 10 != 9)), *rest)


@query("s134_resolved_evidence", """WITH l AS (SELECT o_custkey AS c, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey), e AS (SELECT p_partkey AS p, 'e' || p_size AS evidence_id FROM part WHERE p_size % 3 > 0),
g AS (SELECT c, string_agg(DISTINCT evidence_id, ',' ORDER BY evidence_id) AS ids FROM l LEFT JOIN e USING (p) GROUP BY 1) SELECT c AS o_custkey, coalesce(ids, '') AS evidence_ids FROM g""")
def _(t):
    s = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.collect_list(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("ids"))
    e = t("part").filter("p_size % 3 > 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("source_id"), F.concat(F.lit("e"), F.col("p_size").cast("string")).alias("evidence_id"))
    return B.resolve_evidence(s, "o_custkey", "ids", e).withColumn("evidence_ids", F.array_join("evidence_ids", ","))
