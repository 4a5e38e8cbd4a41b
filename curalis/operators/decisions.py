"""Classification and recommendation of artifacts, plans, priorities, questions and top-k reports with omitted counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curalis.functions.columns import sorted_set
from curalis.operators.duplicates import kept

# fixed values: states that a role, mainline or attempt may assert, limitations and recommendation codes
ROLE_STATES = ["ACTIVE_MAINLINE", "REQUIRED_COMPATIBILITY", "HISTORICAL_EVIDENCE", "EXPERIMENTAL_ACTIVE"]
ABSENCE_ONLY = ["NO_MAINLINE_EVIDENCE", "NO_ROLE_EVIDENCE"]
PRIORITY = {"ARCHIVE": 1, "MERGE": 2, "REVIEW_EXACT_DUPLICATE": 3, "MANUAL_REVIEW": 4, "KEEP": 5}
COMPLETE = "COMPLETE_IN_ANALYZED_SCOPE"

STRINGS = "array<string>"


def latest(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row a key, the one with the greatest ordinal: later declarations of a key replace earlier ones. Of equal ordinals the greatest row counts."""
    rest = [c for c in df.columns if c not in (key, ordinal)]
    return df.groupBy(key).agg(F.max(F.struct(ordinal, *rest)).alias("_v")).select(key, *[F.col(f"_v.{c}").alias(c) for c in rest])


def _by_key(sides: dict[str, DataFrame], key: str) -> DataFrame:
    """One row a key with a struct column for each side, null where the side has none: the sides are stacked and taken together in one aggregation, in which of several rows of a side the greatest counts."""
    kinds = {n: f"struct<{','.join(f'{c}:{d}' for c, d in df.drop(key).dtypes)}>" for n, df in sides.items()}
    tall = None
    for n, df in sides.items():
        rest = [c for c in df.columns if c != key]
        one = df.select(key, *[F.struct(*rest).cast(k).alias(m) if m == n else F.lit(None).cast(k).alias(m) for m, k in kinds.items()])
        tall = one if tall is None else tall.unionByName(one)
    return tall.groupBy(key).agg(*[F.max(n).alias(n) for n in kinds])


def fan_in(inventory: DataFrame, mainline: DataFrame, roles: DataFrame, attempts: DataFrame, candidates: DataFrame, comparisons: DataFrame, members: DataFrame, duplicates: DataFrame, declarations: DataFrame) -> DataFrame:
    """Everything known of each artifact, for `classify`: all that is known by artifact_id in one table and all that is known by path in another, each joined once.

    inventory(artifact_id, path, object_type, warnings); mainline(artifact_id, ordinal, status, support, counter, uncertainty); roles(artifact_id, ordinal,
    role, support, limits); attempts(path, ordinal, result, support, limits); candidates(path); comparisons(left_path, right_path, subtype);
    members(artifact_id, bundle, completeness); duplicates(artifact_id, support); declarations(artifact_id, support, limits).
    """
    yes = F.lit(True)
    clash = comparisons.filter("subtype = 'DO_NOT_MERGE'").select(F.explode(F.array("left_path", "right_path")).alias("path")).distinct().select("path", yes.alias("is"))
    bundled = members.filter("artifact_id is not null").groupBy("artifact_id").agg(sorted_set(F.collect_set("bundle")).alias("bundles"), F.bool_or(F.col("completeness") != COMPLETE).alias("guard"))
    by_id = _by_key({"mainline": mainline.select("artifact_id", "ordinal", "status", "support", "counter", "uncertainty"), "role": roles.select("artifact_id", "ordinal", "role", "support", "limits"), "bundled": bundled, "duplicate": duplicates.select("artifact_id", "support"), "declaration": declarations.select("artifact_id", "support", "limits")}, "artifact_id")
    by_path = _by_key({"attempt": attempts.select("path", "ordinal", "result", "support", "limits"), "candidate": candidates.select("path", yes.alias("is")), "clash": clash}, "path")
    j = inventory.select("artifact_id", "path", "object_type", "warnings").join(by_id, "artifact_id", "left").join(by_path, "path", "left")
    of = lambda side, *cs: [F.col(f"{side}.{c}").alias(f"{side}_{c}") for c in cs]
    flag = lambda c, name: F.coalesce(F.col(c), F.lit(False)).alias(name)
    return j.select("artifact_id", "path", "object_type", "warnings", *of("mainline", "status", "support", "counter", "uncertainty"), *of("role", "role", "support", "limits"), *of("attempt", "result", "support", "limits"),
                    flag("candidate.is", "candidate"), flag("clash.is", "document_conflict"), F.col("bundled.bundles").alias("bundles"), flag("bundled.guard", "bundle_guard"), *of("duplicate", "support"), *of("declaration", "support", "limits"))


def _all(*arrays: Column) -> Column:
    return F.flatten(F.array(*[F.coalesce(a, F.array().cast(STRINGS)) for a in arrays]))


def classify(a: DataFrame) -> DataFrame:
    """State, limitations, evidence and coverage of each artifact of `fan_in`, by rules in a fixed order. Material conflicts, limitations of the
    inventory and incomplete bundles leave an artifact UNRESOLVED whatever else asserts a state."""
    regular = F.col("object_type") == "REGULAR_FILE"
    declared = regular & F.col("declaration_support").isNotNull()
    main = F.when(F.col("mainline_status").isin(ROLE_STATES), F.col("mainline_status"))
    role = F.when(F.col("role_role").isin(ROLE_STATES), F.col("role_role"))
    tried = F.when(F.col("attempt_result").isin("FAILED", "INCONCLUSIVE", "PARTIAL"), "HISTORICAL_EVIDENCE").when((F.col("attempt_result") == "ACCEPTED") | (F.col("attempt_result").isNotNull() & F.col("candidate")), "EXPERIMENTAL_ACTIVE")
    s = a.withColumn("_m", main).withColumn("_r", role).withColumn("_t", tried)
    mixed = F.size(F.array_distinct(F.array_compact(F.array("_m", "_r", "_t")))) > 1
    warned = F.size(F.coalesce("warnings", F.array().cast(STRINGS))) > 0
    intent = (F.col("mainline_status") == "UNRESOLVED") & (F.size("mainline_counter") > 0)
    guards = F.col("document_conflict") | warned | F.col("bundle_guard")
    base = F.coalesce("_t", "_r", "_m", F.when(F.col("object_type") == "DIRECTORY", "PROTECTED").when(declared, "DECLARATION_EVIDENCE").otherwise("UNRESOLVED"))
    stated = F.when(mixed | guards | F.coalesce(intent, F.lit(False)), "UNRESOLVED").otherwise(base)
    s = s.withColumn("_s", stated)
    dup = F.col("_s").isin("UNRESOLVED", "DECLARATION_EVIDENCE") & F.col("duplicate_support").isNotNull() & ~guards
    flags = F.array_compact(F.array(
        F.when(~regular, "NON_REGULAR_ARTIFACT_PRESERVED"), F.when(mixed, "MATERIAL_ROLE_CONFLICT"), F.when(F.col("document_conflict"), "MATERIAL_DOCUMENT_CONFLICT"), F.when(warned, "INVENTORY_COVERAGE_LIMITATION"),
        F.when(intent, "MATERIAL_INTENT_CONFLICT"), F.when(F.col("bundle_guard"), "BUNDLE_MOVEMENT_GUARD"), F.when(dup, "EXACT_BYTES_DO_NOT_ESTABLISH_COMMON_PURPOSE")))
    limits = sorted_set(_all(F.when(declared, F.col("declaration_limits")), F.col("mainline_uncertainty"), F.col("role_limits"), F.col("attempt_limits"), flags))
    support = sorted_set(_all(F.when(declared, F.col("declaration_support")), F.col("mainline_support"), F.col("role_support"), F.col("attempt_support"), F.when(dup, F.col("duplicate_support"))))
    s = s.select("artifact_id", "path", F.when(dup, "EXACT_DUPLICATE_REVIEW").otherwise(F.col("_s")).alias("state"), limits.alias("limitations"), support.alias("supporting"), sorted_set(_all(F.col("mainline_counter"))).alias("counter"), F.coalesce("bundles", F.array().cast(STRINGS)).alias("bundles"))
    enough = (F.size("supporting") > 0) & (F.size("counter") == 0) & (F.col("state") != "UNRESOLVED")
    return s.withColumn("coverage", F.when(enough, "SUFFICIENT_FOR_SHADOW_REVIEW").otherwise("INSUFFICIENT")).withColumn("limitations", F.when(F.size("limitations") > 0, F.col("limitations")).otherwise(F.array(F.lit("NO_CLASSIFICATION_EVIDENCE"))))


def recommend(c: DataFrame) -> DataFrame:
    """What to do with each classified artifact, what would be lost, and the limitations that come with it; a bundled artifact is never moved alone."""
    state, bundled = F.col("state"), F.size("bundles") > 0
    moved = (state == "HISTORICAL_EVIDENCE") | (state == "EXACT_DUPLICATE_REVIEW")
    kind = (
        F.when(state == "UNRESOLVED", F.when(F.col("limitations") == F.array(*map(F.lit, ABSENCE_ONLY)), "KEEP").otherwise("MANUAL_REVIEW")).when(moved & bundled, "MANUAL_REVIEW")
        .when(state == "HISTORICAL_EVIDENCE", "ARCHIVE").when(state == "EXACT_DUPLICATE_REVIEW", "REVIEW_EXACT_DUPLICATE").otherwise("KEEP"))
    more = (
        F.when(state == "UNRESOLVED", F.array(F.lit("PRESERVE_UNRESOLVED"))).when(moved & bundled, F.transform("bundles", lambda b: F.concat(F.lit("BUNDLE_GUARD:"), b)))
        .when(state == "HISTORICAL_EVIDENCE", F.array(F.lit("ARCHIVE_REQUIRES_FUTURE_AVAILABILITY_VALIDATION"))).when(state == "EXACT_DUPLICATE_REVIEW", F.array(F.lit("EXACT_BYTES_DO_NOT_ESTABLISH_COMMON_PURPOSE"), F.lit("NO_MOVE_OR_DELETE_AUTHORIZED"))))
    r = c.withColumn("recommendation", kind).withColumn("limitations", sorted_set(_all(F.col("limitations"), more)))
    return r.withColumn("expected_loss", F.when(F.col("recommendation") == "ARCHIVE", "LOCATION_ONLY_AFTER_APPROVED_MOVE").otherwise("NONE")).withColumn("availability", F.when(F.col("recommendation") == "REVIEW_EXACT_DUPLICATE", "EXACT_BYTE_REPLACEMENT_OBSERVED").otherwise("NOT_ESTABLISHED"))


def document_recommendations(pairs: DataFrame) -> DataFrame:
    """(subject, recommendation, state, expected_loss, limitations, counter) of document pairs; merges are never executed."""
    kind = F.when(F.col("subtype") == "DO_NOT_MERGE", "MANUAL_REVIEW").otherwise("MERGE")
    return pairs.select(
        F.concat_ws("|", "left_path", "right_path").alias("subject"), kind.alias("recommendation"), F.lit(None).cast("string").alias("state"), F.lit("DOCUMENT_HISTORY_AND_AUDIT_RECORDS_MUST_BE_RETAINED").alias("expected_loss"),
        F.array(F.lit("DECLARED_DOCUMENT_METADATA_ONLY"), F.lit("MERGE_AND_DELETE_NEVER_EXECUTABLE")).alias("limitations"), F.when(kind == "MANUAL_REVIEW", F.array("left_path", "right_path")).otherwise(F.array().cast(STRINGS)).alias("counter"))


def plan(recommendations: DataFrame, pairs: DataFrame) -> DataFrame:
    """All recommendations of a plan: those for artifacts and those for document pairs."""
    return recommendations.select(F.col("artifact_id").alias("subject"), "recommendation", "state", "expected_loss", "limitations", "counter").unionByName(document_recommendations(pairs))


def plan_summary(p: DataFrame) -> DataFrame:
    """Per recommendation: how many, and how many would change a location."""
    return p.groupBy("recommendation").agg(F.count("*").alias("n"), F.count_if(F.col("expected_loss") != "NONE").alias("location_changes"))


def attention_priority(recommendation: Column, counter: Column, limitations: Column) -> Column:
    """0 for a manual review with counter evidence or a material or bundle limitation, else by recommendation."""
    hot = (recommendation == "MANUAL_REVIEW") & ((F.size(counter) > 0) | F.exists(limitations, lambda x: x.startswith("MATERIAL_") | x.startswith("BUNDLE_")))
    out = F.when(hot, 0)
    for k, v in PRIORITY.items():
        out = out.when(recommendation == k, v)
    return out.otherwise(99)


def attention(p: DataFrame, k: int = 25) -> DataFrame:
    """The k most urgent recommendations of a plan, and how many are omitted; what is kept or protected needs none."""
    told = kept(p.select("subject", "recommendation", "state", attention_priority(F.col("recommendation"), F.col("counter"), F.col("limitations")).alias("priority")))
    some = told.filter((F.col("recommendation") != "KEEP") & ~F.coalesce(F.col("state") == "PROTECTED", F.lit(False))).drop("state")
    return _first(some, [F.col("priority"), F.col("subject")], k)


def next_action(questions: Column, items: Column) -> Column:
    return F.when(questions > 0, "REVIEW_DECISION_QUESTION").when(items > 0, "REVIEW_HIGHEST_PRIORITY_ITEM").otherwise("RETAIN_SHADOW_REPORT")


def mainline_status(claims: DataFrame, path: str = "path", status: str = "status") -> DataFrame:
    """(path, status): UNRESOLVED where a path has two statuses, or is ACTIVE_MAINLINE while several paths are."""
    active = claims.filter(F.col(status) == "ACTIVE_MAINLINE").agg(F.count_distinct(path).alias("active"))
    g = claims.groupBy(path).agg(F.count_distinct(status).alias("n"), F.min(status).alias("s")).withColumn("active", active.scalar())
    return g.select(path, F.when((F.col("n") > 1) | ((F.col("s") == "ACTIVE_MAINLINE") & (F.col("active") > 1)), "UNRESOLVED").otherwise(F.col("s")).alias("status"))


def top_k(df: DataFrame, keys: list[Column], k: int) -> DataFrame:
    """The first k rows and, on each, how many the report omits. df is computed once, for the count and for the rows."""
    return _first(kept(df), keys, k)


def _first(df: DataFrame, keys: list[Column], k: int) -> DataFrame:
    return df.orderBy(*keys).limit(k).withColumn("omitted", F.lit(max(df.count() - k, 0)))


def top_k_per(df: DataFrame, part: list[str], keys: list[Column], k: int) -> DataFrame:
    """The first k rows of each part, with how many it omits. The limit is asked of the window, so each task keeps k rows of a part before the shuffle."""
    w = Window.partitionBy(*part).orderBy(*keys)
    first = df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    n = df.groupBy(*part).agg(F.greatest(F.count("*") - k, F.lit(0)).alias("omitted"))
    on = [f.eqNullSafe(n[c]) for c in part for f in [first[c]]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return first.join(n, cond).select(*[first[c] for c in first.columns], n["omitted"])


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """One row with a map value -> count, sorted by value; for columns of few values."""
    g = df.groupBy(col).agg(F.count("*").alias("n"))
    return g.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(col).cast("string"), "n")))).alias("counts"))


def information_value(supporting: Column, counter: Column, affected: Column, status: Column, scope: Column) -> Column:
    """Score by which a conflict is asked about first: evidence * fan-out * ambiguity * risk + cost of review."""
    n = F.greatest(F.lit(1), F.size(supporting) + F.size(counter))
    return n * F.greatest(F.lit(1), F.size(affected)) * F.when(status.isin("UNRESOLVED", "CONFLICT"), 2).otherwise(1) * F.when(F.size(counter) > 0, 2).otherwise(1) + F.when(F.length(scope) < 128, 1).otherwise(2)


def decision_question(conflicts: DataFrame, advanced: bool = True) -> DataFrame:
    """The one conflict to ask about: the most informative one (or simply the first), ties by path."""
    s = conflicts.withColumn("score", information_value(F.col("supporting"), F.col("counter"), F.col("affected"), F.col("status"), F.col("scope")))
    s = s.orderBy(*([F.desc("score")] if advanced else []), "path").limit(1)
    return s.select("path", "score", F.concat(F.lit("Which scoped intent claim governs "), "path", F.lit("?")).alias("question"))


def evidence_coverage(c: DataFrame, recommendations: DataFrame, near: DataFrame) -> DataFrame:
    """(claim_kind, claim_id, status) of classifications, recommendations and near-duplicate candidates(candidate_id)."""
    status = F.when(F.size("supporting") == 0, "UNSUPPORTED").when((F.size("counter") == 0) & (F.size("limitations") == 0), "SUPPORTED").otherwise("PARTIAL")
    review = F.lit("REVIEW_REQUIRED").alias("status")
    return (
        c.select(F.lit("CLASSIFICATION").alias("claim_kind"), F.col("artifact_id").alias("claim_id"), status.alias("status"))
        .unionByName(recommendations.select(F.lit("RECOMMENDATION").alias("claim_kind"), F.col("subject").alias("claim_id"), review))
        .unionByName(near.select(F.lit("NEAR_DUPLICATE_CANDIDATE").alias("claim_kind"), F.col("candidate_id").alias("claim_id"), review)))
