"""Registries whose entries must agree: declared bindings checked in the plan of the result itself, and ids resolved to evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalis.functions.columns import parent, sorted_set

# fixed values: files whose hashes a run binds, and what each is called where it differs
OUTPUTS = {"inventory.jsonl": "inventory", "relationships.jsonl": "relationship"}


def broken_bindings(asked: DataFrame, repositories: DataFrame, runs: DataFrame, files: DataFrame) -> DataFrame:
    """(repository_id, error) of each id asked for: the first binding that does not hold, in a fixed order, or null.

    asked(repository_id); repositories(repository_id, snapshot_descriptor_path, snapshot_descriptor_sha256, commit_sha); runs(repository_id, snapshot_descriptor_sha256, run_path, run_sha256, run_id);
    files(path, sha256, json) holds the descriptors, runs and outputs named: hashes with 'sha256:', but bare ones in a run's output_file_hashes. A value that is not there agrees with none."""
    f = lambda n, json=False: files.select(F.col("path").alias(f"{n}_path"), F.col("sha256").alias(f"{n}_hash"), *([F.col("json").alias(f"{n}_json")] if json else []))
    r = repositories.select("repository_id", F.col("snapshot_descriptor_path").alias("descriptor_path"), F.col("snapshot_descriptor_sha256").alias("declared"), "commit_sha", F.lit(True).alias("has_repository"))
    u = runs.select("repository_id", F.col("snapshot_descriptor_sha256").alias("bound"), "run_path", "run_sha256", "run_id", F.lit(True).alias("has_run"))
    j = asked.select("repository_id").join(r, "repository_id", "left").join(u, "repository_id", "left").join(f("descriptor", True), "descriptor_path", "left")
    j = j.join(f("run", True).withColumnRenamed("run_hash", "found"), "run_path", "left")
    for name, what in OUTPUTS.items():
        j = j.withColumn(f"{what}_path", F.concat(parent(F.col("run_path")), F.lit("/" + name))).join(f(what), f"{what}_path", "left")
    field = lambda doc, name: F.try_variant_get(F.try_parse_json(doc), f"$.{name}", "string")
    outputs = F.from_json("run_json", "output_file_hashes map<string,string>")["output_file_hashes"]
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    checks: list[tuple[Column, str]] = [
        (F.coalesce(F.col("has_repository") & F.col("has_run"), F.lit(False)), "missing frozen source for"), (same(F.col("descriptor_hash"), F.col("declared")), "snapshot descriptor hash mismatch for"),
        (same(F.col("descriptor_hash"), F.col("bound")), "audit snapshot binding mismatch for"), (same(field("descriptor_json", "repository_id"), F.col("repository_id")), "snapshot descriptor repository mismatch for"),
        (same(field("descriptor_json", "git_commit_sha"), F.col("commit_sha")), "snapshot descriptor commit mismatch for"), (same(F.col("found"), F.col("run_sha256")), "audit run hash mismatch for"),
        (same(field("run_json", "run_id"), F.col("run_id")), "audit run ID mismatch for"), (same(field("run_json", "git_head"), field("descriptor_json", "git_commit_sha")), "audit run head mismatch for"),
        (outputs.isNotNull(), "audit output hashes are malformed for")]
    checks += [(same(F.col(f"{what}_hash"), F.concat(F.lit("sha256:"), F.try_element_at(outputs, F.lit(name)))), f"{what} hash mismatch for") for name, what in OUTPUTS.items()]
    error = F.lit(None).cast("string")
    for ok, message in reversed(checks):
        error = F.when(~ok, F.concat(F.lit(message + " "), "repository_id")).otherwise(error)
    return j.select("repository_id", "run_id", "commit_sha", error.alias("error"))


def bound_sources(asked: DataFrame, repositories: DataFrame, runs: DataFrame, files: DataFrame) -> DataFrame:
    """(repository_id, run_id, commit_sha) of the ids asked for; the job that reads it fails with the first broken binding of any of them."""
    b = broken_bindings(asked, repositories, runs, files)
    sure = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string")).otherwise(F.col("repository_id"))
    return b.select(sure.alias("repository_id"), "run_id", "commit_sha")


def run_records(records: DataFrame, sources: DataFrame, what: str) -> DataFrame:
    """records(repository_id, run_id, ...) of bound sources; one of another run fails the job."""
    s = sources.select("repository_id", F.col("run_id").alias("_run"))
    wrong = F.concat(F.lit(f"{what} run binding mismatch for "), "repository_id")
    j = records.join(s, "repository_id")
    return j.withColumn("run_id", F.when(F.col("run_id").eqNullSafe(F.col("_run")), F.col("run_id")).otherwise(F.raise_error(wrong).cast("string"))).drop("_run")


def resolve_evidence(sources: DataFrame, key: str, ids: str, evidence: DataFrame) -> DataFrame:
    """(key, evidence_ids): the sorted distinct evidence of each row's source ids by evidence(source_id, evidence_id); ids without evidence are left out. Of two with one source id the last evidence_id holds."""
    e = evidence.groupBy("source_id").agg(F.max("evidence_id").alias("evidence_id"))
    found = sources.select(key, F.explode(ids).alias("source_id")).join(e, "source_id").groupBy(key).agg(sorted_set(F.collect_set("evidence_id")).alias("evidence_ids"))
    return sources.select(key).distinct().join(found, key, "left").select(key, F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"))
