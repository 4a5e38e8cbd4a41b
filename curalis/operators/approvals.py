"""Approvals of plans, and what binds records to each other: every broken rule by its code, digests of records, selected cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalis.functions.columns import json_object, json_string, protected, safe_path, sorted_set
from curalis.operators.decisions import top_k_per
from curalis.operators.observers import controls

# fixed values: kinds of action that may be carried out; fields of an approval that must be, may be, and would widen it
KINDS = ["ARCHIVE", "QUARANTINE"]
REQUIRED = ["approval_id", "approval_created_at", "approval_schema_version", "approved_action_ids", "approved_plan_id", "approved_plan_sha256", "approved_recommendation_ids", "approving_actor", "decision_set_hash", "effective_policy_hash", "mutation_budget", "repository_state_hash"]
OPTIONAL = ["reviewer_notes", "supersedes_approval_id"]
# fixed values: hashes that plan, approval and context share, with the code of each
BOUND = {"repository_state_hash": "DRIFT_REPOSITORY_STATE", "effective_policy_hash": "APPROVAL_POLICY_HASH_MISMATCH", "decision_set_hash": "APPROVAL_DECISION_SET_HASH_MISMATCH"}
BUDGET = ["max_actions", "max_affected_bytes", "max_blast_radius"]
MANAGED = ".curalis"


def _no(c: Column) -> Column:
    """Not true, null included."""
    return ~F.coalesce(c, F.lit(False))


def action_errors(managed: str = MANAGED, more: tuple[str, ...] = ()) -> Column:
    """Codes of the rules that an action of the plan `plan_id` breaks, by columns of its fields. Folders of `managed` are protected but for the plan's own quarantine."""
    codes = [F.when(_no(F.col("type").isin(KINDS)), "ACTION_UNSUPPORTED_TYPE"), F.when(_no(F.col("executable_in_supported_scope") & F.col("approval_required")), "ACTION_NOT_EXECUTABLE"), F.when(_no(F.col("repository_mode") == "GIT_WORKTREE"), "PREFLIGHT_REPOSITORY_MODE")]
    own = (F.col("type") == "QUARANTINE") & (F.col("plan_id") != "") & ~F.col("plan_id").rlike(r"[/\\]") & F.col("destination_path").startswith(F.concat(F.lit(managed + "/quarantine/"), "plan_id", F.lit("/")))
    for name in ("source_path", "destination_path"):
        safe, hit = F.coalesce(safe_path(F.col(name)), F.lit(False)), protected(F.col(name), [".git", managed, *more])
        codes += [F.when(~safe, "PATH_TRAVERSAL").when(hit & (_no(own) if name == "destination_path" else F.lit(True)), "PATH_PROTECTED")]
    codes += [F.when(F.col("source_external_symlink"), "PATH_EXTERNAL_SYMLINK"), F.when(F.col("destination_exists"), "PATH_DESTINATION_EXISTS"), F.when(F.col("case_collision"), "PATH_CASE_COLLISION"), F.when(_no(F.col("same_filesystem")), "CROSS_FILESYSTEM_MOVE_UNSUPPORTED")]
    kept = F.col("retention_closure_satisfied") & (F.size("retention_evidence_ids") > 0) & F.forall("retention_evidence_ids", lambda x: x != "")
    affected, members = F.col("affected_artifact_ids"), F.col("bundle_member_artifact_ids")
    same = (F.size(F.array_except(affected, members)) == 0) & (F.size(F.array_except(members, affected)) == 0)
    codes += [F.when(_no(F.col("affected_bytes") >= 0) | affected.isNull(), "ACTION_MALFORMED"), F.when(_no(kept), "RETENTION_CLOSURE_INCOMPLETE")]
    codes += [F.when(affected.isNotNull() & _no(F.col("bundle_complete")), "BUNDLE_INCOMPLETE"), F.when(affected.isNotNull() & _no(same), "BUNDLE_PARTIAL_MOVEMENT")]
    return F.array_compact(F.array(*codes))


def approval_errors(approvals: DataFrame, plans: DataFrame, actions: DataFrame, schema_version: str, managed: str = MANAGED) -> DataFrame:
    """(plan_key, errors): sorted distinct codes of each approval of a plan; none of them means that it holds.

    approvals(plan_key, fields, the fields' values, context_* hashes, max_*), plans(plan_key, plan_text, plan_id, recommendation_ids, hashes, max_*),
    actions(plan_key, action_id, ...). Approved actions meet the plan's by one join; sums are taken before anything is gathered.
    """
    p = plans.select("plan_key", *[F.col(c).alias("p_" + c) for c in plans.columns if c != "plan_key"])
    j = approvals.join(p, "plan_key")
    eq = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    text = lambda xs: F.array(*map(F.lit, xs))
    digest = F.concat(F.lit("sha256:"), F.sha2("p_plan_text", 256))
    ids, recs = F.col("approved_action_ids"), F.col("approved_recommendation_ids")
    lost = lambda a: a.isNull() | (F.size(F.array_distinct(a)) != F.size(a))
    known = F.coalesce("p_recommendation_ids", F.array().cast("array<string>"))
    budget = lambda pre: ~_no((F.col(pre + BUDGET[0]) >= 0) & (F.col(pre + BUDGET[1]) >= 0) & (F.col(pre + BUDGET[2]) >= 0))
    wide = (F.col("max_actions") > F.col("p_max_actions")) | (F.col("max_affected_bytes") > F.col("p_max_affected_bytes")) | (F.col("max_blast_radius") > F.col("p_max_blast_radius"))
    own = [F.when((F.size(F.array_except(text(REQUIRED), F.col("fields"))) > 0) | _no(F.col("approval_schema_version") == schema_version), "APPROVAL_MALFORMED"), F.when(F.size(F.array_except(F.col("fields"), text(REQUIRED + OPTIONAL))) > 0, "APPROVAL_SCOPE_EXPANSION"),
           F.when(_no(F.col("approved_plan_sha256") == digest), "APPROVAL_PLAN_HASH_MISMATCH"), F.when(~eq("approved_plan_id", "p_plan_id"), "APPROVAL_PLAN_ID_MISMATCH")]
    own += [F.when(~eq("context_" + h, "p_" + h) | ~eq(h, "p_" + h), code) for h, code in BOUND.items()]
    own += [F.when(lost(ids), "APPROVAL_ACTIONS_MALFORMED"), F.when(lost(recs), "APPROVAL_RECOMMENDATIONS_MALFORMED"), F.when(F.col("p_recommendation_ids").isNull(), "PLAN_RECOMMENDATIONS_MALFORMED"), F.when(~lost(recs) & (F.size(F.array_except(recs, known)) > 0), "APPROVAL_UNKNOWN_RECOMMENDATION"),
            F.when(~budget(""), "APPROVAL_BUDGET_MALFORMED").when(~budget("p_"), "PLAN_BUDGET_MALFORMED").when(wide, "APPROVAL_BUDGET_EXPANSION")]
    base = j.select("plan_key", F.col("p_plan_id").alias("plan_id"), F.when(~lost(ids), ids).alias("ids"), (budget("") & budget("p_")).alias("counted"), *BUDGET, F.array_compact(F.array(*own)).alias("own"))
    a = base.select("plan_key", "plan_id", F.explode("ids").alias("action_id")).join(actions.withColumn("there", F.lit(True)), ["plan_key", "action_id"], "left")
    a = a.withColumn("e", F.when(F.col("there"), action_errors(managed)).otherwise(F.array(F.lit("APPROVAL_UNKNOWN_ACTION"))))
    code = a.select("plan_key", F.explode("e").alias("e")).groupBy("plan_key").agg(F.collect_set("e").alias("of_actions"))
    n = a.filter("there").groupBy("plan_key").agg(F.count("*").alias("n"), F.sum("affected_bytes").alias("b"), F.count_if(_no(F.col("affected_bytes") >= 0)).alias("bad"))
    blast = a.filter("there").select("plan_key", F.explode("affected_artifact_ids").alias("x")).groupBy("plan_key").agg(F.count_distinct("x").alias("blast"))
    r = base.join(code, "plan_key", "left").join(n, "plan_key", "left").join(blast, "plan_key", "left")
    spent = F.when(F.col("counted"), F.array_compact(F.array(F.when(F.col("n") > F.col("max_actions"), "BUDGET_ACTION_COUNT"), F.when((F.col("bad") == 0) & (F.col("b") > F.col("max_affected_bytes")), "BUDGET_AFFECTED_BYTES"), F.when((F.col("bad") == 0) & (F.col("blast") > F.col("max_blast_radius")), "BUDGET_BLAST_RADIUS"))))
    none = F.array().cast("array<string>")
    return r.select("plan_key", sorted_set(F.concat("own", F.coalesce("of_actions", none), F.coalesce(spent, none))).alias("errors"))


def records_digest(records: DataFrame, part: str, order: str, json: str) -> DataFrame:
    """(part, records_sha256): the hash of a part's canonical JSON records in order. The hash of a sequence is one value, so a part comes together."""
    g = records.groupBy(part).agg(F.array_sort(F.collect_list(F.struct(order, json))).alias("x"))
    return g.select(part, F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("["), F.array_join(F.transform("x", lambda x: x[json]), ","), F.lit("]")), 256)).alias("records_sha256"))


def binding(json: Column, markdown: Column) -> Column:
    """What binds a plan to its two reports: canonical JSON of their names and hashes."""
    return json_object([("json_file", json_string(F.lit("curation-brief.json"))), ("json_sha256", json_string(F.sha2(json, 256))), ("markdown_file", json_string(F.lit("curation-brief.md"))), ("markdown_sha256", json_string(F.sha2(markdown, 256)))])


def selected_cases(eligible: DataFrame, duplicates: DataFrame, part: str, each: int, more: int, first: int, without: int, folder: str) -> DataFrame:
    """(case_id, part, claim_type, prediction, expected): the first eligible(part, path, artifact_id, content_id) of each part (the first `first` parts, in order, take `more`
    as well), as many made-up paths and pairs of different content as `without`, and every group of duplicates(part, relationship_id). A part with too few of either fails the job that reads it."""
    three = lambda n: F.lpad(n.cast("string"), 3, "0")
    parts = eligible.select(part).distinct()
    extra = parts.orderBy(part).limit(first).withColumn("more", F.lit(more))
    some = top_k_per(eligible.select(part, "path"), [part], [F.col("path")], each + more).join(extra, part, "left").filter(F.col("rank") <= each + F.coalesce("more", F.lit(0)))
    made = parts.select(part, F.explode(F.sequence(F.lit(1), F.lit(without))).alias("rank"))
    pairs = controls(eligible, part, without).select(part, F.concat_ws(",", "left", "right").alias("subject"), F.lit(1).alias("one"))
    pairs = top_k_per(pairs, [part], [F.col("subject")], without)

    def case(df: DataFrame, kind: str, tail: Column, subject: Column, yes: bool) -> DataFrame:
        head = "wave3-inventory-" if kind == "inventory_artifact" else "wave3-duplicate-"
        return df.select(F.concat(F.lit(head), part, F.lit("-"), tail).alias("case_id"), part, F.lit(kind).alias("claim_type"), subject.alias("subject"), F.lit("ASSERTED" if yes else "ABSTAINED").alias("prediction"), F.lit("SUPPORTED" if yes else "UNSUPPORTED").alias("expected"))

    count = lambda df, n: df.groupBy(part).agg(F.count("*").alias(n))
    few = parts.join(extra, part, "left").join(count(eligible, "n"), part, "left").join(count(pairs, "p"), part, "left")
    why = F.when(F.coalesce("n", F.lit(0)) < each + F.coalesce("more", F.lit(0)), F.concat(F.lit("insufficient eligible inventory for "), part)).when(F.coalesce("p", F.lit(0)) < without, F.concat(F.lit("insufficient nonmatch controls for "), part))
    few = few.select(part, why.alias("why")).filter("why is not null").select(part, F.raise_error(F.col("why")).cast("string").alias("why"))  # no rows, or a failure
    failed = case(few.withColumn("rank", F.lit(0)), "inventory_artifact", F.col("why"), F.col("why"), True)
    no = lambda n: F.concat(F.lit("control-"), three(n))
    return failed.unionByName(
        case(some, "inventory_artifact", three(F.col("rank")), F.col("path"), True).unionByName(case(made, "inventory_artifact", no(F.col("rank")), F.concat(F.lit(folder + "/case-"), three(F.col("rank"))), False))
        .unionByName(case(duplicates, "exact_byte_duplicate", F.element_at(F.split("relationship_id", "_"), -1), F.col("relationship_id"), True)).unionByName(case(pairs, "exact_byte_duplicate", no(F.col("rank")), F.col("subject"), False)))
