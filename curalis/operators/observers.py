"""What files, histories, declarations and manifests say: parsers as column expressions, and the tables that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curalis.functions.columns import basename, casefold, content_id, json_object, json_string, parent, sorted_set, suffix
from curalis.operators.duplicates import kept

STRINGS = "array<string>"

# fixed values: suffixes of texts that near duplicates are looked for in, and their largest size
TEXT_SUFFIXES = [".csv", ".json", ".md", ".py", ".rst", ".txt", ".yaml", ".yml"]
MOST_TEXT_BYTES = 1 << 20
# fixed values: scales of the size of a repository
SCALES = {"current_checkout_file_count": 50_000, "current_checkout_size_bytes": 1_000_000_000, "max_regular_file_size_bytes": 10_000_000, "reachable_commit_count": 500_000, "reference_count": 25_000}
# fixed values: the counting report of a repository, by key and name, those in KiB, and the largest count
COUNT_KEYS = {"count": "loose_objects", "garbage": "garbage", "in-pack": "in_pack", "packs": "pack_count", "prune-packable": "prune_packable", "size": "loose_size_bytes", "size-garbage": "garbage_size_bytes", "size-pack": "packed_size_bytes"}
KIB_KEYS = ["size", "size-garbage", "size-pack"]
MOST_COUNT = (1 << 64) - 1
# fixed values: labels of intent in documents
ENTRY_POINT = r"(?im)^\s*(?:entry[ _-]?point|mainline|deploy(?:ment)?[ _-]?entry[ _-]?point)\s*:\s*([^\s]+)\s*$"
RETENTION = r"(?im)^\s*(retain|protect|keep|archive|historical|prototype)\s*:\s*([^\s]+)\s*$"
COMPATIBILITY = r"(?im)^\s*(?:retain[ _-]?)?compatibility\s*:\s*([^\s]+)\s*$"
# fixed values: files that declare an environment, those that are instructions, those that count at the root only
MARKERS = {"DESCRIPTION": "R_PACKAGE", "Dockerfile": "CONTAINER", "JuliaProject.toml": "JULIA", "Manifest.toml": "JULIA_LOCK", "Pipfile": "PIPENV", "Pipfile.lock": "PIPENV_LOCK", "Project.toml": "JULIA", "REQUIRE": "JULIA_LEGACY", "apt.txt": "SYSTEM_PACKAGES", "default.nix": "NIX", "environment.yaml": "CONDA", "environment.yml": "CONDA",
           "install.R": "R_INSTALL_SCRIPT", "postBuild": "POST_BUILD_SCRIPT", "pyproject.toml": "PYTHON_PROJECT", "requirements.txt": "PIP", "requirements3.txt": "PIP_SERVER", "runtime.txt": "RUNTIME", "start": "START_SCRIPT"}
ROOT_ONLY = ["DESCRIPTION", "pyproject.toml"]
# fixed values: files that declare a family of metadata
FAMILIES = {"CITATION_CFF": ["CITATION.cff"], "CODEMETA": ["codemeta.json"], "DATA_PACKAGE": ["datapackage.json"], "DVC": ["dvc.yaml", "dvc.lock", ".dvc/config"], "DATALAD": [".datalad/config"], "MLFLOW": ["MLproject"], "RO_CRATE": ["ro-crate-metadata.json"], "BAGIT": ["bagit.txt"], "SNAKEMAKE": ["Snakefile", "workflow/Snakefile"],
            "NEXTFLOW": ["nextflow.config", "main.nf"], "RENKU": [".renku"], "SHOWYOURWORK": ["showyourwork.yml"], "SIGNAC": [".signac/config"], "NOWORKFLOW": [".noworkflow"]}
# fixed values: families of regular files alone, and marks beside whole paths
ONLY_FILES = ["CITATION_CFF", "CODEMETA"]
NAMED_OTHERWISE = {"DVC": ("ending", ".dvc"), "SNAKEMAKE": ("name", "Snakefile"), "MLFLOW": ("folded", "mlproject"), "NOWORKFLOW": ("folder", ".noworkflow/")}
# fixed values: fields of an attempt that a bundle needs besides its output
BUNDLE_FIELDS = {"inputs": "INPUT", "configuration": "CONFIGURATION", "generator": "GENERATOR", "validation": "VALIDATION", "reviewer_record": "REVIEWER_RECORD"}
MLFLOW_LIMITS = ["MLFLOW_METADATA_KEYS_ONLY", "MLFLOW_PROJECT_NOT_EXECUTED"]
HISTORY_LIMIT = "GIT_SECRET_HISTORY_FINDING_LIMIT"
CELLS = ["code", "markdown", "raw"]
OUTPUTS = ["display_data", "error", "execute_result", "stream", "update_display_data"]


def object_type(mode: Column) -> Column:
    kind = mode.bitwiseAND(0o170000)
    return F.when(kind == 0o040000, "DIRECTORY").when(kind == 0o100000, "REGULAR_FILE").when(kind == 0o120000, "SYMLINK").otherwise("SPECIAL_FILE")


def near_eligible(kind: Column, path: Column, size: Column) -> Column:
    return (kind == "REGULAR_FILE") & suffix(path).isin(TEXT_SUFFIXES) & (size <= MOST_TEXT_BYTES)


def selectable(df: DataFrame) -> DataFrame:
    """Regular, eligible artifacts with both ids and no warnings."""
    return df.filter("object_type = 'REGULAR_FILE' and profile_eligibility = 'ELIGIBLE' and artifact_id is not null and content_id is not null and size(coalesce(warnings, array())) = 0")


def concern_ratios(**values: Column) -> Column:
    return F.struct(*[F.round(values[k] / F.lit(float(s)), 6).alias(k) for k, s in SCALES.items()])


def checkout_summary(df: DataFrame) -> DataFrame:
    """One row: number, bytes and largest of the regular files; ties to the first path."""
    big = F.min_by(F.struct("artifact_id", "path", "size_bytes"), F.struct(-F.col("size_bytes"), F.col("path")))
    g = df.filter("object_type = 'REGULAR_FILE' and size_bytes is not null").agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), big.alias("m"))
    return g.select("files", "bytes", F.col("m.artifact_id").alias("largest_id"), F.col("m.path").alias("largest_path"), F.coalesce("m.size_bytes", F.lit(0)).alias("largest_bytes"))


def folder_summary(df: DataFrame) -> DataFrame:
    """(folder, bytes, files, items) of each top-level folder; files at the root have folder null."""
    file = F.coalesce(F.col("object_type") == "REGULAR_FILE", F.lit(False))
    size = F.when(file & (F.col("size_bytes") >= 0), F.col("size_bytes")).otherwise(0)
    folder = F.when(F.col("path").contains("/"), F.split("path", "/")[0])
    return df.filter("path not in ('', '.')").groupBy(folder.alias("folder")).agg(F.sum(size).alias("bytes"), F.count_if(file).alias("files"), F.count("*").alias("items"))


def folder_table(df: DataFrame, most: int = 256) -> DataFrame:
    """The largest folders, and beside each how many are left out."""
    all_ = kept(folder_summary(df).filter("folder is not null"))
    return all_.orderBy(F.desc("bytes"), "folder").limit(most).withColumn("omitted", F.lit(max(all_.count() - most, 0)))


def parse_count_objects(text: Column) -> Column:
    """A struct of eight counts; null where a line is malformed, a key unknown, repeated or absent, or a count too large."""
    lines = F.filter(F.split(F.regexp_replace(text, r"(\r\n|\r|\n)$", ""), r"\r\n|\r|\n"), lambda x: ~x.startswith("alternate: "))
    good = F.forall(lines, lambda x: x.rlike(r"^(" + "|".join(COUNT_KEYS) + r"): [0-9]{1,20}$"))
    keys = F.transform(lines, lambda x: F.substring_index(x, ": ", 1))
    get = lambda k: F.substring_index(F.element_at(F.filter(lines, lambda x: x.startswith(k + ": ")), 1), ": ", -1).try_cast("decimal(20,0)")
    whole = (F.size(keys) == len(COUNT_KEYS)) & (F.size(F.array_distinct(keys)) == len(COUNT_KEYS))
    small = F.lit(True)
    for k in COUNT_KEYS:
        small = small & (get(k) <= F.lit(str(MOST_COUNT // 1024 if k in KIB_KEYS else MOST_COUNT)).cast("decimal(20,0)"))
    fields = [(get(k) * (F.lit(1024) if k in KIB_KEYS else F.lit(1))).cast("decimal(20,0)").alias(n) for k, n in sorted(COUNT_KEYS.items(), key=lambda x: x[1])]
    return F.when(F.coalesce(good & whole & small, F.lit(False)), F.struct(*fields))


def parse_history(text: Column) -> Column:
    """array of struct(commit_id, parent_ids, committed_at) from records of three fields, all ended by NUL; null where any is malformed."""
    ids = r"^[0-9a-f]{40,64}$"

    def records(parts: Column) -> Column:
        n = F.floor(F.size(parts) / 3).cast("int")
        rows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(parts, 3 * i).alias("commit_id"), F.filter(F.split(F.get(parts, 3 * i + 1), r"\s+"), lambda x: x != "").alias("parent_ids"), F.get(parts, 3 * i + 2).alias("at")))
        return _let(rows, lambda r: parsed(parts, r))

    def parsed(parts: Column, rows: Column) -> Column:
        good = (F.size(parts) % 3 == 0) & F.forall(rows, lambda r: r["commit_id"].rlike(ids) & r["at"].rlike("^[0-9]+$") & F.forall(r["parent_ids"], lambda p: p.rlike(ids)))
        return F.when(good, F.transform(rows, lambda r: F.struct(r["commit_id"].alias("commit_id"), r["parent_ids"].alias("parent_ids"), r["at"].cast("long").alias("committed_at"))))

    found = _let(F.split(F.regexp_replace(text, r"\x00+$", ""), r"\x00"), records)
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<struct<commit_id:string,parent_ids:array<string>,committed_at:bigint>>")).otherwise(found)


def source_type(path: Column) -> Column:
    """What a document is to the intent of a project, by its name and place; null for none."""
    name = F.lower(basename(path))
    return (
        F.when(name.isin("agents.md", "claude.md"), "SCOPED_RULE").when(path.startswith(".github/workflows/") | name.isin("docker-compose.yml", "docker-compose.yaml", "dockerfile"), "DELIVERY_WIRING")
        .when(name.startswith("readme") | name.startswith("contributing") | path.startswith("docs/") | name.isin("context.md", "pyproject.toml", "package.json"), "DOCUMENTATION"))


def _scoped(source: Column, target: Column) -> Column:
    t = F.replace(target, F.lit("\\"), F.lit("/"))
    bad = t.startswith("/") | t.contains(":") | F.exists(F.split(t, "/"), lambda p: p.isin("", ".", ".."))
    up = F.when((source_type(source) == "SCOPED_RULE") & source.contains("/"), F.concat(parent(source), F.lit("/"))).otherwise("")
    return F.when(~bad, F.concat(up, t))


def intent_claims(documents: DataFrame, inventory: DataFrame) -> DataFrame:
    """(source_path, source_type, path, status) of labels in documents(path, text) that name a path of inventory(path)."""
    all_ = lambda p, g: F.regexp_extract_all("text", F.lit(p), F.lit(g))
    kept = F.zip_with(all_(RETENTION, 1), all_(RETENTION, 2), lambda v, x: F.struct(F.when(F.lower(v).isin("archive", "historical", "prototype"), "HISTORICAL_EVIDENCE").otherwise("REQUIRED").alias("status"), x.alias("target")))
    some = lambda p, s: F.transform(all_(p, 1), lambda x: F.struct(F.lit(s).alias("status"), x.alias("target")))
    d = documents.withColumn("source_type", source_type(F.col("path"))).filter("source_type is not null")
    c = d.select(F.col("path").alias("source_path"), "source_type", F.explode(F.concat(some(ENTRY_POINT, "ACTIVE_MAINLINE"), some(COMPATIBILITY, "REQUIRED_COMPATIBILITY"), kept)).alias("c"))
    c = c.select("source_path", "source_type", _scoped(F.col("source_path"), F.col("c.target")).alias("path"), F.col("c.status").alias("status")).filter("path is not null")
    return c.join(inventory.select("path").distinct(), "path", "left_semi").select("source_path", "source_type", "path", "status")


def project_intent(claims: DataFrame, statuses: DataFrame) -> DataFrame:
    """One row: SUPPORTED where an entry point is claimed and no path conflicts. statuses(path, status) as `mainline_status` gives them."""
    a = claims.agg(F.count_distinct(F.when(F.col("status") == "ACTIVE_MAINLINE", F.col("path"))).alias("entry_points"))
    n = statuses.agg(F.count_if(F.col("status") == "UNRESOLVED").alias("n"))
    a = a.withColumn("conflicts", n.scalar())
    why = F.when(F.col("conflicts") > 0, "CONFLICTING_INTENT_EVIDENCE").when(F.col("entry_points") == 0, "NO_ACTIVE_DELIVERY_OR_ENTRY_POINT_EVIDENCE")
    return a.select("entry_points", "conflicts", F.when(why.isNull(), "SUPPORTED").otherwise("UNRESOLVED").alias("status"), why.alias("uncertainty"))


def retention_rules(claims: DataFrame) -> DataFrame:
    """One rule a claim; what no rule lists stays required."""
    return claims.select("path", "source_path", "status").distinct()


RIVALS = "ACTIVE_MAINLINE"


def conflict_classes(claims: DataFrame, statuses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members(path, class), class_claims(class, and the columns of claims but path)) of unresolved paths: what is claimed once for each class, and which paths share it.

    Entry points that are not the only one are one class, with all that is claimed of any of them; every other path is a class of its own, named by it. Both tables are as long as the claims."""
    bad = statuses.filter("status = 'UNRESOLVED'").select("path")
    own = claims.join(bad, "path", "left_semi")
    active = own.filter(F.col("status") == RIVALS).select("path").distinct()
    several = active.agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(RIVALS).alias("status"))  # one row or none
    rivals = active.withColumn("status", F.lit(RIVALS)).join(F.broadcast(several), "status", "left_semi").select("path", F.lit("*").alias("class"))
    j = own.join(rivals, "path", "left")
    members = j.select("path", F.coalesce("class", F.concat(F.lit("/"), "path")).alias("class")).distinct()
    told = j.filter(F.col("class").isNull() | (F.col("status") == RIVALS)).select(F.coalesce("class", F.concat(F.lit("/"), "path")).alias("class"), *[c for c in claims.columns if c != "path"])
    return members, told


def conflict_records(claims: DataFrame, statuses: DataFrame) -> DataFrame:
    """(path, claims) of unresolved paths with all that is claimed of their class; a class of many paths is repeated at each: ask conflict_classes where there may be many."""
    members, told = conflict_classes(claims, statuses)
    text = told.select("class", F.concat_ws(":", "source_path", "status").alias("t")).groupBy("class").agg(sorted_set(F.collect_set("t")).alias("claims"))
    return members.join(text, "class").select("path", "claims")


def declaration_family(path: Column, object_type: Column | None = None) -> Column:
    """The family of metadata that a path declares, or null: by its whole path, and some by an ending, a name at any depth, a name in any case or a folder. object_type: what the path is, regular files if not told; some
    families are declared by regular files alone."""
    regular = F.lit(True) if object_type is None else object_type == "REGULAR_FILE"
    out = F.lit(None).cast("string")
    for family, names in reversed(FAMILIES.items()):
        hit = path.isin(names)
        if family in ONLY_FILES:
            hit = hit & regular
        if family in NAMED_OTHERWISE:
            kind, text = NAMED_OTHERWISE[family]
            hit = hit | {"ending": regular & path.endswith(text), "name": regular & (basename(path) == text), "folded": ~path.contains("/") & (casefold(path) == text), "folder": path.startswith(text)}[kind]
        out = F.when(hit, family).otherwise(out)
    return out


def environment_markers(paths: DataFrame) -> DataFrame:
    """(path, kind, scope_status) of files that declare an environment: at the root, in `binder` or in `.binder`, of which one is in force; both is a conflict."""
    p = F.col("path")
    scope = F.when(~p.contains("/"), "ROOT").when(p.rlike("^binder/[^/]+$"), "BINDER").when(p.rlike(r"^\.binder/[^/]+$"), "DOT_BINDER")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in MARKERS.items() for x in kv]), basename(p))
    have = paths.agg(F.bool_or(p.startswith("binder/") | (p == "binder")).alias("b"), F.bool_or(p.startswith(".binder/") | (p == ".binder")).alias("d"))
    m = paths.select("path", kind.alias("kind"), scope.alias("scope")).filter("kind is not null and scope is not null").filter(~basename(p).isin(ROOT_ONLY) | (F.col("scope") == "ROOT")).crossJoin(F.broadcast(have))
    force = F.when(F.col("b"), "BINDER").when(F.col("d"), "DOT_BINDER").otherwise("ROOT")
    return m.select("path", "kind", F.when(F.col("b") & F.col("d"), "UNRESOLVED").when(F.col("scope") == force, "ACTIVE").otherwise("SHADOWED").alias("scope_status"))


def validation_status(results: DataFrame, part: str, result: str = "result", limited: str | None = None) -> DataFrame:
    """(part, validation, status) of several files' results: the gravest counts. limited: a truth value of the rows; a part with a limitation before validation is PARTIAL whatever its files say."""
    rank = F.array_position(F.array(*map(F.lit, ["MALFORMED", "SIZE_LIMIT", "UNAVAILABLE", "CHANGED"])), F.col(result))
    g = results.groupBy(part).agg(F.min(F.when(rank > 0, rank)).alias("r"), F.bool_or(F.coalesce(F.col(limited), F.lit(False)) if limited else F.lit(False)).alias("l"))
    v = F.coalesce(F.get(F.array(*map(F.lit, ["MALFORMED", "SIZE_LIMIT", "UNAVAILABLE", "CHANGED"])), F.col("r").cast("int") - 1), F.lit("SYNTAX_VALIDATED"))
    return g.select(part, v.alias("validation"), F.when(F.col("l"), "PARTIAL").when(v == "MALFORMED", "MALFORMED").when(v == "SYNTAX_VALIDATED", "PRESENT").otherwise("PRESENT_UNVALIDATED").alias("status"))


def source_kind(inline: Column, paths: Column, local: Column, remote: Column, unsafe: Column) -> Column:
    """Where a data resource's content is, from counts of its paths."""
    return (
        F.when(inline & (paths > 0), "MULTIPLE_SOURCES").when(inline, "INLINE_DATA").when(paths == 0, "MISSING_SOURCE").when((remote > 0) & ((local > 0) | (unsafe > 0)), "MIXED_PATHS").when(remote > 0, "REMOTE_PATH")
        .when((unsafe > 0) & (local == 0), "UNSAFE_PATH").when(paths > 1, "MULTIPART_LOCAL").otherwise("LOCAL_PATH"))


def schema_kind(v: Column) -> Column:
    """Kind of a JSON value given as text."""
    return F.when(v.isNull() | (v == "null"), "ABSENT").when(v.startswith("{"), "INLINE_OBJECT").when(v.startswith('"'), "REFERENCE_STRING").otherwise("UNSUPPORTED")


def resource_status(refs: DataFrame, inventory: DataFrame) -> DataFrame:
    """refs(path, ...) with PRESENT, PRESENT_NON_REGULAR or MISSING."""
    i = inventory.select("path", F.col("object_type").alias("_o"))
    return refs.join(i, "path", "left").withColumn("inventory_status", F.when(F.col("_o").isNull(), "MISSING").when(F.col("_o") == "REGULAR_FILE", "PRESENT").otherwise("PRESENT_NON_REGULAR")).drop("_o")


def unresolved_references(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """(action, role, unresolved): of each action's inputs, outputs and instruments those that name no entity, sorted."""
    lost = refs.join(entities.select(F.col("id").alias("target")).distinct(), "target", "left_anti")
    return lost.groupBy("action", "role").agg(sorted_set(F.collect_set("target")).alias("unresolved"))


def bundles(attempts: DataFrame, inventory: DataFrame) -> DataFrame:
    """(attempt_id, completeness, members, unresolved) of attempts(attempt_id, output, and arrays for each field a bundle needs)."""
    one = F.array(F.struct(F.lit("OUTPUT").alias("role"), F.col("output").alias("path")))
    def of(field: str, role: str) -> Column:
        return F.transform(F.coalesce(field, F.array().cast(STRINGS)), lambda x: F.struct(F.lit(role).alias("role"), x.alias("path")))

    rest = [of(f, r) for f, r in BUNDLE_FIELDS.items()]
    absent = F.array_compact(F.array(*[F.when(F.coalesce(F.size(f), F.lit(-1)) <= 0, f) for f in BUNDLE_FIELDS]))
    a = attempts.select("attempt_id", absent.alias("absent"), F.explode(F.array_distinct(F.concat(one, *rest))).alias("m")).select("attempt_id", "absent", "m.role", "m.path")
    j = a.join(inventory.select("path", "artifact_id").distinct(), "path", "left")
    g = j.groupBy("attempt_id").agg(F.first("absent").alias("absent"), F.count("*").alias("members"), F.collect_set(F.when(F.col("artifact_id").isNull(), F.col("path"))).alias("lost"))
    u = sorted_set(F.concat("absent", "lost"))
    return g.select("attempt_id", F.when(F.size(u) == 0, "COMPLETE_IN_ANALYZED_SCOPE").otherwise("MISSING_REQUIRED_LINK").alias("completeness"), "members", u.alias("unresolved"))


def gap_order(b: DataFrame, most: int = 25, items: int = 64) -> DataFrame:
    """The gaps with most unresolved items first, each with its first items and how many are left out."""
    g = b.filter(F.size("unresolved") > 0).withColumn("n", F.size("unresolved"))
    return g.orderBy(F.desc("n"), "attempt_id").limit(most).select("attempt_id", "n", F.slice("unresolved", 1, items).alias("unresolved"), F.greatest(F.col("n") - items, F.lit(0)).alias("omitted"))


def chains(b: DataFrame, edges: DataFrame, most: int = 25, items: int = 64) -> DataFrame:
    """The first bundles, incomplete ones first, with their declared edges(attempt_id, relationship_id): how many, the first of them, how many are left out."""
    first = b.orderBy(F.col("completeness") == "COMPLETE_IN_ANALYZED_SCOPE", "attempt_id").limit(most)
    e = edges.join(F.broadcast(first.select("attempt_id")), "attempt_id").withColumn("r", F.row_number().over(Window.partitionBy("attempt_id").orderBy("relationship_id")))
    g = e.groupBy("attempt_id").agg(F.count("*").alias("edges"), F.array_sort(F.collect_list(F.when(F.col("r") <= items, F.col("relationship_id")))).alias("reported"))
    return first.join(g, "attempt_id", "left").select("attempt_id", "completeness", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("reported", F.array().cast(STRINGS)).alias("reported"), F.greatest(F.coalesce("edges", F.lit(0)) - items, F.lit(0)).alias("omitted"))


def budget_errors(actions: DataFrame, part: str, max_actions: int, max_bytes: int, max_blast: int) -> DataFrame:
    """(part, errors) of actions(part, affected_bytes, affected_artifact_ids) against an approved budget."""
    n = actions.groupBy(part).agg(F.count("*").alias("n"), F.sum("affected_bytes").alias("b"), F.count_if(F.col("affected_bytes").isNull() | (F.col("affected_bytes") < 0)).alias("bad"))
    blast = actions.select(part, F.explode_outer("affected_artifact_ids").alias("a")).groupBy(part).agg(F.count_distinct("a").alias("blast"))
    e = F.array_compact(F.array(F.when(F.col("n") > max_actions, "BUDGET_ACTION_COUNT"), F.when(F.col("bad") > 0, "ACTION_MALFORMED"), F.when((F.col("bad") == 0) & (F.col("b") > max_bytes), "BUDGET_AFFECTED_BYTES"), F.when((F.col("bad") == 0) & (F.col("blast") > max_blast), "BUDGET_BLAST_RADIUS")))
    return n.join(blast, part).select(part, F.array_sort(e).alias("errors"))


# fixed values: the events of an action that was carried out
VERIFIED = ["ACTION_VALIDATION_STARTED", "MOVE_STARTED", "DESTINATION_OBSERVED", "SOURCE_REMOVAL_OBSERVED", "ACTION_VERIFIED"]


def outcome(types: Column, verified: Column, committed: Column, source: Column, destination: Column, provenance: Column) -> Column:
    """State of an action from its events in order and what is seen at its places (REGULAR, ABSENT, other)."""
    is_ = lambda *x: types == F.array(*map(F.lit, x)) if x else F.size(types) == 0
    early = is_() | is_(VERIFIED[0]) | is_(VERIFIED[0], "ACTION_FAILED")
    return (
        F.when(verified & committed & is_(*VERIFIED), "VERIFIED").when((source == "REGULAR") & (destination == "ABSENT") & (provenance == "ABSENT") & early, F.when(F.size(types) == 0, "NOT_STARTED").otherwise("PREPARED"))
        .when(F.array_contains(types, "MOVE_STARTED") & (source == "REGULAR") & (destination == "REGULAR"), "MOVED").when(F.array_contains(types, "ACTION_FAILED"), "FAILED").otherwise("AMBIGUOUS"))


def component_state(warnings: Column) -> Column:
    return F.when(F.size(warnings) > 0, "COMPLETED_WITH_LIMITATIONS").otherwise("COMPLETED")


def corpus_card(repositories: DataFrame) -> DataFrame:
    """One row of counts of repositories(repository_id, repository_family, access, swhid); a repeated id fails."""
    public = F.col("access").startswith("public-")
    g = repositories.agg(F.count("*").alias("repositories"), F.count_distinct("repository_id").alias("ids"), F.count_if(public).alias("public"), F.count_distinct("repository_family").alias("families"), F.count_if(F.col("swhid").isNotNull()).alias("swhids"), F.count_if(public & F.col("swhid").isNotNull()).alias("public_swhids"))
    n = F.when(F.col("ids") < F.col("repositories"), F.raise_error(F.lit("snapshot registry repository IDs are duplicated")).cast("long")).otherwise(F.col("repositories"))
    return g.select(n.alias("repositories"), "public", (F.col("repositories") - F.col("public")).alias("private"), "families", "swhids", "public_swhids")


def evidence_candidates(observations: DataFrame, source_type: str, origin: str) -> DataFrame:
    """Observations as candidates of evidence: the first id that is there, where it applies, and a sparse subject."""
    c = lambda n: F.col(n) if n in observations.columns else F.lit(None).cast("string")
    keys = ["artifact_id", "repository_relative_path", "source_artifact_id", "source_location_id"]
    subject = F.map_filter(F.create_map(*[x for k in keys for x in (F.lit(k), c(k))]), lambda k, v: v.isNotNull())
    first = F.coalesce(*[F.nullif(c(n), F.lit("")) for n in ("observation_id", "profile_id", "structure_id")], c("evidence_id"), F.lit("unidentified-observation"))
    return observations.select(F.lit(source_type).alias("source_type"), first.alias("source_record_id"), F.coalesce(c("assertion_origin"), F.lit(origin)).alias("assertion_origin"), F.coalesce(c("coverage"), F.lit("OBSERVATION_ONLY")).alias("scope"), subject.alias("subject"))


def notebook_counts(cells: DataFrame) -> DataFrame:
    """(notebook, cells by type, outputs by type) of notebooks(notebook, json): non-zero counts only, unknown types together."""
    schema = "cells array<struct<cell_type:string,execution_count:int,outputs:array<struct<output_type:string>>>>"
    c = cells.select("notebook", F.explode_outer(F.from_json("json", schema)["cells"]).alias("c"))
    kind = lambda x, known: F.when(x.isin(known), x).otherwise("unknown")
    a = c.filter("c is not null").select("notebook", F.concat(F.lit("cell:"), kind(F.col("c.cell_type"), CELLS)).alias("k"))
    o = c.select("notebook", F.explode("c.outputs").alias("o")).select("notebook", F.concat(F.lit("output:"), kind(F.col("o.output_type"), OUTPUTS)).alias("k"))
    g = a.unionByName(o).groupBy("notebook", "k").agg(F.count("*").alias("n"))
    return g.groupBy("notebook").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("counts"))


def mlflow_counts(paths: DataFrame, most: int = 256) -> DataFrame:
    """Runs, parameters, metrics and artifacts below mlruns/, by the first paths; limitations say so where there are more. No row without such a path."""
    mine = paths.filter(F.col("path").startswith("mlruns/"))
    more = mine.orderBy("path").limit(most + 1).withColumn("r", F.row_number().over(Window.orderBy("path")))  # of a bounded number of rows
    p = more.select("r", "path", F.split("path", "/").alias("x"), F.concat(F.lit("/"), "path").alias("q"))
    run = F.when((F.size("x") >= 3) & (F.col("x")[1] != ".trash"), F.array_join(F.slice("x", 1, 3), "/"))
    kind = F.when(F.col("q").contains("/params/"), "p").when(F.col("q").contains("/metrics/"), "m").when(F.col("q").contains("/artifacts/"), "a")
    first = F.col("r") <= most
    limits = F.when(F.count("*") > most, F.array(*map(F.lit, ["ADAPTER_RECORD_LIMIT", *MLFLOW_LIMITS]))).otherwise(F.array(*map(F.lit, MLFLOW_LIMITS)))
    g = p.agg(F.count_distinct(F.when(first, run)).alias("runs"), *[F.count_if(first & (kind == k)).alias(n) for k, n in (("p", "parameters"), ("m", "metrics"), ("a", "artifacts"))], limits.alias("limitations"), F.count("*").alias("n"))
    return g.filter("n > 0").drop("n")


def codemeta(text: Column, allowed: list[str]) -> Column:
    """Which allowed fields a metadata object declares, and how many authors and languages."""
    keys = F.json_object_keys(text)
    many = lambda p: F.when(F.get_json_object(text, p).isNull(), 0).when(F.get_json_object(text, p).startswith("["), F.json_array_length(F.get_json_object(text, p))).otherwise(1)
    return F.when(keys.isNotNull(), F.struct(F.array_sort(F.array_intersect(keys, F.array(*map(F.lit, allowed)))).alias("fields"), many("$.author").alias("authors"), many("$.programmingLanguage").alias("languages")))


def staged_large(files: DataFrame, staged: DataFrame, most_kib: int = 500, most: int = 256) -> DataFrame:
    """Staged regular files above a size, the first by path, with how many are omitted."""
    f = files.filter(f"object_type = 'REGULAR_FILE' and size_bytes > {most_kib} * 1024").join(staged.select("path").distinct(), "path", "left_semi")
    n = f.agg(F.count("*").alias("n"))
    return f.select("path", "size_bytes").orderBy("path").limit(most).withColumn("omitted", F.greatest(n.scalar() - most, F.lit(0)))


def history_findings(occurrences: DataFrame, blobs: DataFrame, categories, most: int = 256) -> DataFrame:
    """(commit_id, path, category, limitation) of occurrences(blob, commit_id, path) of blobs(blob, text) with secrets, each blob read once; the first ones in order, all with the limitation where there are more."""
    found = blobs.dropDuplicates(["blob"]).select("blob", F.explode(categories(F.col("text"))).alias("category"))
    more = occurrences.join(found, "blob").select("commit_id", "path", "category").distinct().orderBy("commit_id", "path", "category").limit(most + 1)
    w = Window.orderBy("commit_id", "path", "category")  # of a bounded number of rows
    more = more.withColumn("r", F.row_number().over(w)).withColumn("n", F.max("r").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return more.filter(F.col("r") <= most).select("commit_id", "path", "category", F.when(F.col("n") > most, HISTORY_LIMIT).alias("limitation"))


def _let(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.transform(F.array(value), f)[0]


def _utf8_prefix(value: Column, n: Column) -> Column:
    def cut(b: Column) -> Column:
        tries = [F.substring(b, F.lit(1), F.greatest(n - k, F.lit(0))) for k in range(4)]
        return F.when(F.length(b) <= n, value).otherwise(F.coalesce(*[F.when(F.is_valid_utf8(x), F.decode(x, "UTF-8")) for x in tries]))

    return _let(F.encode(value, "UTF-8"), cut)


def safe_prefix(value: Column, most_bytes: int) -> Column:
    """At most so many bytes of a text, cut neither inside a letter nor inside a redaction marker: one that would be cut is put whole at the end."""
    n = F.lit(most_bytes)

    def whole(head: Column) -> Column:
        last = F.substring_index(head, "[REDACTED:", -1)
        start = F.length(head) - F.length(last) - 10

        def put(marker: Column) -> Column:
            return F.when(marker.isNull(), head).when(F.octet_length(marker) > n, F.lit("[REDACTED]"[:most_bytes])).otherwise(F.concat(_utf8_prefix(F.substring(value, F.lit(1), start), n - F.octet_length(marker)), marker))

        rest = F.substring(value, start + 1, F.length(value))
        marker = F.when(rest.contains("]"), F.concat(F.substring_index(rest, "]", 1), F.lit("]")))
        return F.when(head.contains("[REDACTED:") & ~last.contains("]"), _let(marker, put)).otherwise(head)

    return _let(_utf8_prefix(value, n), whole)


def decision_hash(answer: Column, reason: Column, question: Column, scope: Column, supporting: Column, counter: Column) -> Column:
    """Identity of a user's decision: the hash of its canonical JSON."""
    ids = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, json_string), ","), F.lit("]"))
    return F.concat(F.lit("sha256:"), F.sha2(json_object([("answer", json_string(answer)), ("counter_evidence_ids", ids(counter)), ("question_id", json_string(question)), ("reason", json_string(reason)), ("scope", json_string(scope)), ("supporting_evidence_ids", ids(supporting))]), 256))


def controls(df: DataFrame, part: str, count: int) -> DataFrame:
    """(part, left, right): up to `count` pairs of artifacts of different content, each artifact in one pair at most, first ids first.

    Greedy in the order of ids, as it must be: each artifact takes the next free one of another content. A pair has one artifact of a content at most,
    so only its first `count` ones can be in pairs; of those that are left, free ones wait with one content, so the first 3 * count hold all pairs: a
    part's rows in the one task that pairs them are bounded by that.
    """
    own = Window.partitionBy(part, "content_id").orderBy("artifact_id")
    some = df.select(part, "artifact_id", "content_id").withColumn("r", F.row_number().over(own)).filter(F.col("r") <= count)
    some = some.withColumn("r", F.row_number().over(Window.partitionBy(part).orderBy("artifact_id"))).filter(F.col("r") <= 3 * count).drop("r")

    def pairs(key, f):
        import pandas as pd

        out, waiting, content = [], [], None
        for a, c in f.sort_values("artifact_id")[["artifact_id", "content_id"]].itertuples(index=False):
            if len(out) == count:
                break
            if waiting and c != content:
                out.append((key[0], waiting.pop(0), a))
            else:
                content = c
                waiting.append(a)
        return pd.DataFrame(out, columns=[part, "left", "right"])

    return some.groupBy(part).applyInPandas(pairs, f"{part} string, left string, right string")
