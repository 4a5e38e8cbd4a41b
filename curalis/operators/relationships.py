"""Groups, episodes, bundles and document pairs from declarations and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curalis.functions.columns import sorted_set
from curalis.operators.duplicates import dense_ids


def groups(df: DataFrame, key: str, member: str, least: int = 2, most: int | None = None) -> DataFrame:
    """(key, member_count, members) of declared groups with at least `least` distinct members; beyond `most` they are flagged, not listed."""
    g = df.filter(F.col(key).isNotNull()).select(key, member).distinct().groupBy(key).agg(F.count("*").alias("member_count"), F.sort_array(F.collect_list(member)).alias("members")).filter(F.col("member_count") >= least)
    if most is None:
        return g
    return g.withColumn("oversized", F.col("member_count") > most).withColumn("members", F.when(~F.col("oversized"), F.col("members")))


def cochange_episodes(changes: DataFrame, commit: str, path: str, current: DataFrame | None = None, least: int = 2, most: int = 64) -> DataFrame:
    """Commits that touch least..most current files. Counted before members are gathered, so an oversized commit is never held as a list."""
    c = changes.select(commit, path).distinct()
    if current is not None:
        c = c.join(current.select(path).distinct(), path, "left_semi")
    n = c.groupBy(commit).agg(F.count("*").alias("member_count")).filter(F.col("member_count").between(least, most))
    return c.join(n, commit).groupBy(commit, "member_count").agg(F.sort_array(F.collect_list(path)).alias("members"))


def oversized(changes: DataFrame, commit: str, path: str, most: int = 64) -> DataFrame:
    return changes.groupBy(commit).agg(F.count_distinct(path).alias("member_count")).filter(F.col("member_count") > most)


def episode_coverage(declared: Column, cochange: Column, history: Column, oversized: Column) -> tuple[Column, Column]:
    """(status, limitations) of change episodes from their counts, whether there is a history, and whether a commit of it was too large."""
    many = F.when(oversized, "GIT_COCHANGE_MEMBER_LIMIT")
    status = (
        F.when((cochange > 0) & (declared > 0), "AVAILABLE_MIXED_EVIDENCE").when(cochange > 0, "AVAILABLE_GIT_COCHANGE_ONLY").when(declared > 0, "AVAILABLE_DECLARED_ONLY")
        .when(history, "AVAILABLE_GIT_COCHANGE_ONLY").otherwise("UNAVAILABLE"))
    limits = (
        F.when(cochange > 0, F.array(F.when(declared > 0, "CHANGE_EPISODE_DECLARED_ONLY"), many, F.lit("GIT_COCHANGE_NOT_COMMON_PURPOSE"))).when(declared > 0, F.array(F.lit("CHANGE_EPISODE_DECLARED_ONLY"), many))
        .when(history, F.array(F.coalesce(many, F.lit("NO_MULTI_ARTIFACT_CURRENT_COCHANGE")))).otherwise(F.array(F.lit("CHANGE_EPISODE_EVIDENCE_UNAVAILABLE"))))
    return status, F.array_sort(F.array_compact(limits))


def family_coverage(families: Column, syntax: Column) -> tuple[Column, Column]:
    """(status, limitations) of capability families from their count and whether there is syntax that was observed."""
    status = F.when(families > 0, "AVAILABLE_DECLARED_ONLY").when(syntax, "PARTIAL_SYNTAX_ONLY").otherwise("UNAVAILABLE")
    only = F.array(F.lit("CAPABILITY_FAMILY_SYNTAX_ONLY_NO_EQUIVALENCE"), F.lit("PYTHON_SYNTAX_NOT_RUNTIME_BEHAVIOR"))
    return status, F.when(families > 0, F.array(F.lit("CAPABILITY_FAMILY_DECLARED_ONLY"))).when(syntax, only).otherwise(F.array(F.lit("CAPABILITY_FAMILY_EVIDENCE_UNAVAILABLE")))


def role_coverage(declared: Column, resolved: Column, syntax: Column) -> tuple[Column, Column]:
    """(status, limitations) of implementation roles: whether there is a manifest that declares, how many roles are resolved, and whether there is syntax that was observed."""
    told = declared & (resolved > 0)
    status = F.when(told, "PARTIAL_DECLARED_ONLY").when(syntax, "PARTIAL_SYNTAX_ONLY").otherwise("UNAVAILABLE")
    return status, F.when(told, F.array(F.lit("IMPLEMENTATION_ROLE_DECLARED_ONLY"))).when(syntax, F.array(F.lit("PYTHON_SYNTAX_NOT_RUNTIME_BEHAVIOR"))).otherwise(F.array(F.lit("IMPLEMENTATION_ROLE_EVIDENCE_UNAVAILABLE")))


# fixed values: roles of documents that are never merged
RECORD_ROLES = ["DECISION_RECORD", "AUDIT_RECORD"]
PART = 512  # left documents of a topic that one task pairs with all of the topic


def document_pairs(docs: DataFrame, topic: str = "topic", path: str = "path") -> DataFrame:
    """Every pair of documents of a topic with how to treat it: conflicting claim, value or status, other audience or a record's role, other lifecycle, review.

    The left documents of a topic are dealt in parts of about PART, each of which meets all right ones, so that no task makes the pairs of a whole topic. Rows are few and pairs many: the
    number of partitions is given, lest Spark join small ones by their bytes."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = docs.groupBy(topic).agg(F.ceil(F.count("*") / PART).cast("int").alias("_parts"))
    d = docs.join(n, topic)
    l = d.withColumn("_part", F.pmod(F.xxhash64(path), F.col("_parts")).cast("int")).repartition(tasks, topic, "_part").select([F.col(c).alias(f"l_{c}") for c in (*docs.columns, "_part")])
    r = d.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).repartition(tasks, topic, "_part").select([F.col(c).alias(f"r_{c}") for c in (*docs.columns, "_part")])
    on = (F.col(f"l_{topic}") == F.col(f"r_{topic}")) & (F.col("l__part") == F.col("r__part"))
    j = l.join(r.hint("shuffle_hash"), on & (F.col(f"l_{path}") < F.col(f"r_{path}")))
    fields = F.array_compact(F.array(*[F.when(F.col(f"l_{c}") != F.col(f"r_{c}"), c) for c in ("claim", "value", "status")]))
    other = ~F.col("l_audience").eqNullSafe(F.col("r_audience")) | F.coalesce(F.col("l_role").isin(RECORD_ROLES), F.lit(False)) | F.coalesce(F.col("r_role").isin(RECORD_ROLES), F.lit(False))
    kind = F.when(F.size("conflicting") > 0, "DO_NOT_MERGE").when(other, "CANONICALIZE_WITHOUT_MERGE").when(~F.col("l_lifecycle").eqNullSafe(F.col("r_lifecycle")), "PARTIAL_MERGE_CANDIDATE").otherwise("MANUAL_REVIEW")
    return j.withColumn("conflicting", fields).select(F.col(f"l_{topic}").alias("topic"), F.col(f"l_{path}").alias("left_path"), F.col(f"r_{path}").alias("right_path"), "conflicting", kind.alias("subtype"))


def canonical_entries(docs: DataFrame, manifest: str) -> DataFrame:
    """(manifest, entry_point, retained): each canonical entry with all other documents of its manifest, in path order. A manifest's documents come together in one row: its reader bounds it."""
    all_ = docs.groupBy(manifest).agg(sorted_set(F.collect_set("path")).alias("paths"))
    e = docs.filter("canonical_entry").select(manifest, F.col("path").alias("entry_point")).join(all_, manifest)
    return e.select(manifest, "entry_point", F.array_remove("paths", F.col("entry_point")).alias("retained"))


def first_declared(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The first declaration of each key, and how many later ones became gaps."""
    w = Window.partitionBy(key).orderBy(ordinal)
    return df.withColumn("_r", F.row_number().over(w)).withColumn("gaps", F.count("*").over(Window.partitionBy(key)) - 1).filter("_r = 1").drop("_r")


def resolve_members(members: DataFrame, inventory: DataFrame, path: str, artifact: str = "artifact_id") -> DataFrame:
    """Declared members with what the inventory knows; unknown ones stay as MISSING."""
    j = members.join(inventory.select(path, artifact), path, "left")
    return j.withColumn("status", F.when(F.col(artifact).isNull(), "MISSING").otherwise("PRESENT"))


def bundle_completeness(members: DataFrame, bundle: str, status: str = "status") -> DataFrame:
    """(bundle, members, missing, completeness)."""
    g = members.groupBy(bundle).agg(F.count("*").alias("members"), F.count_if(F.col(status) == "MISSING").alias("missing"))
    return g.withColumn("completeness", F.when(F.col("missing") == 0, "COMPLETE").otherwise("INCOMPLETE"))


def incomplete_guard(members: DataFrame, completeness: DataFrame, bundle: str, artifact: str) -> DataFrame:
    """Artifacts that belong to any incomplete bundle."""
    return members.join(completeness.select(bundle, "completeness"), bundle).groupBy(artifact).agg(F.bool_or(F.col("completeness") != "COMPLETE").alias("guarded"))


def declared_edges(members: DataFrame, bundle: str, role: str, path: str, artifact: str, prefix: str = "relationship_run_declared_") -> DataFrame:
    """DECLARED_<ROLE> edges bundle -> artifact, numbered by bundle, role and path; members without an artifact have none and no number."""
    e = members.filter(F.col(artifact).isNotNull()).select(F.col(bundle).alias("source"), F.col(artifact).alias("target"), F.upper(role).alias("_r"), F.col(path).alias("path"))
    n = dense_ids(e, ["source", "_r", "path"], "relationship_id", prefix, first=1)
    return n.select("relationship_id", "source", "target", F.concat(F.lit("DECLARED_"), "_r").alias("type"), "path")


def resolve_references(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """refs(source, property, target) ⟕ entities(id): PRESENT, EXTERNAL (has a scheme) or UNRESOLVED."""
    e = entities.select(F.col("id").alias("_id")).distinct()
    j = refs.join(e, F.col("target") == F.col("_id"), "left")
    return j.select("source", "property", "target", F.when(F.col("_id").isNotNull(), "PRESENT").when(F.col("target").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "EXTERNAL").otherwise("UNRESOLVED").alias("resolution"))


def pair_full(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two halves of a record by key; PARTIAL where one is absent."""
    l, r = left.select(key, F.lit(1).alias("_l")).distinct(), right.select(key, F.lit(1).alias("_r")).distinct()
    return l.join(r, key, "full_outer").select(key, F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "COMPLETE").otherwise("PARTIAL").alias("status"))


def evidence_by_artifact(observations: DataFrame, artifact: str, evidence: str) -> DataFrame:
    """Sorted distinct evidence ids of each artifact, from an array column."""
    return observations.select(artifact, F.explode(evidence).alias("_e")).groupBy(artifact).agg(sorted_set(F.collect_list("_e")).alias("evidence_ids"))


def overlay_status(artifacts: DataFrame, tracked: DataFrame, status: DataFrame, path: str = "path") -> DataFrame:
    """artifacts with tracked, modified, untracked, ignored_included and index_status.

    tracked(path); status(path, code) by two letters, '??' for untracked and '!!' for ignored paths, where a folder ends in '/'. A path without a code
    of its own takes that of an ignored folder above it; folders are joined by equality with a path's ancestors, not by prefix. artifacts may have object_type: what is neither a
    regular file nor a link has no state, all five are null.
    """
    parts = F.split(F.col(path), "/")
    up = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))
    folders = status.filter((F.col("code") == "!!") & F.col("path").endswith("/")).select(F.col("path").alias("_d")).distinct()
    under = artifacts.select(path, F.explode(up).alias("_d")).join(folders, "_d", "left_semi").select(F.col(path).alias("_u")).distinct()
    t = tracked.select(F.col("path").alias("_t")).distinct()
    s = status.groupBy(F.col("path").alias("_s")).agg(F.max("code").alias("_c"))
    j = artifacts.join(t, F.col(path) == F.col("_t"), "left").join(s, F.col(path) == F.col("_s"), "left").join(under, F.col(path) == F.col("_u"), "left")
    code = F.coalesce("_c", F.when(F.col("_u").isNotNull(), "!!"))
    yes = F.col("_t").isNotNull()
    j = j.withColumn("_code", code)
    stated = (
        j.withColumn("tracked", yes).withColumn("modified", yes & F.coalesce(F.col("_code") != "  ", F.lit(False))).withColumn("untracked", ~yes & F.coalesce(F.col("_code") == "??", F.lit(False)))
        .withColumn("ignored_included", ~yes & F.coalesce(F.col("_code") == "!!", F.lit(False))).withColumn("index_status", F.when(yes | F.col("_code").isin("??", "!!"), F.col("_code"))).drop("_t", "_s", "_c", "_u", "_code"))
    if "object_type" not in artifacts.columns:
        return stated
    own = F.col("object_type").isin("REGULAR_FILE", "SYMLINK")
    return stated.withColumns({c: F.when(own, F.col(c)) for c in ("tracked", "modified", "untracked", "ignored_included", "index_status")})
