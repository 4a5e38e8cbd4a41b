"""What a scan of a tree tells beside its files: links, boundaries, markers, roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalis.functions.columns import basename, parent

# fixed values: roles that a declaration may give
ROLES = ["ACTIVE_MAINLINE", "REQUIRED_COMPATIBILITY", "HISTORICAL_EVIDENCE", "EXPERIMENTAL_ACTIVE"]
# fixed values: files that a data space leaves, by whole path or by name, and how many are kept
SIGNAC_PATHS = {"project_config": ".signac/config", "statepoint_cache": ".signac/statepoint_cache.json.gz"}
SIGNAC_NAMES = {"project_document": "signac_project_document.json", "statepoint": "signac_statepoint.json", "job_document": "signac_job_document.json"}
SIGNAC_MOST = 256


def link_warnings(links: DataFrame, inventory: DataFrame) -> DataFrame:
    """(path, fingerprint, warning) of links(path, target), followed one part at a time through inventory(path, object_type).

    Leaving the root or passing another link: outside; a part that is not there, or a file before the last part: missing. The first such part counts.
    """
    up = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    start = F.when(parent(F.col("path")) == ".", F.array().cast("array<string>")).otherwise(F.split(parent(F.col("path")), "/"))
    parts = F.filter(F.split("target", "/"), lambda x: ~x.isin("", "."))

    def step(acc, x):
        out = (x == "..") & (F.size(acc["at"]) == 0)
        at = F.when(x == "..", up(acc["at"])).otherwise(F.concat(acc["at"], F.array(x)))
        return F.struct(at.alias("at"), F.concat(acc["seen"], F.array(F.struct(F.array_join(at, "/").alias("at"), (x == "..").alias("up"), out.alias("out")))).alias("seen"))

    none = F.array().cast("array<struct<at:string,up:boolean,out:boolean>>")
    s = links.select("path", "target", F.aggregate(parts, F.struct(start.alias("at"), none.alias("seen")), step)["seen"].alias("seen"))
    walk = s.filter("target not like '/%'").select("path", F.size("seen").alias("n"), F.posexplode("seen").alias("i", "s"))
    i = inventory.select(F.col("path").alias("at"), F.col("object_type").alias("o"))
    w = walk.select("path", "n", "i", "s.at", "s.up", "s.out").join(i, "at", "left")
    file = F.col("o").isNotNull() & ~F.col("o").isin("DIRECTORY", "SYMLINK")
    event = (
        F.when(F.col("out"), "SYMLINK_TARGET_OUTSIDE_ROOT").when(F.col("up"), None).when(F.col("o").isNull(), "SYMLINK_TARGET_MISSING").when(F.col("o") == "SYMLINK", "SYMLINK_TARGET_OUTSIDE_ROOT")
        .when(file & (F.col("i") < F.col("n") - 1), "SYMLINK_TARGET_MISSING"))
    bad = w.withColumn("e", event).filter("e is not null").groupBy("path").agg(F.min_by("e", "i").alias("e"))
    return links.join(bad, "path", "left").select("path", F.concat(F.lit("sha256-symlink-target-v1:"), F.sha2("target", 256)).alias("fingerprint"), F.when(F.col("target").startswith("/"), "SYMLINK_TARGET_OUTSIDE_ROOT").otherwise(F.col("e")).alias("warning"))


def boundaries(inventory: DataFrame) -> DataFrame:
    """(path, warning) of inventory(path, object_type) without what lies behind a boundary: nested repositories and virtual environments.

    The control folder of the root and of a nested repository is listed itself, and nothing in it.
    """
    up = F.col("path").contains("/")
    git = inventory.filter(basename(F.col("path")) == ".git").select("path", F.when(up, "NESTED_REPOSITORY_BOUNDARY").otherwise("PROTECTED_GIT_CONTROL").alias("w"))
    nested = git.filter(up).select(parent(F.col("path")).alias("path"), F.col("w"))
    venv = inventory.filter((basename(F.col("path")) == "pyvenv.cfg") & (F.col("object_type") == "REGULAR_FILE") & up).select(parent(F.col("path")).alias("path"), F.lit("PYTHON_VIRTUAL_ENVIRONMENT_BOUNDARY_NOT_RECURSED").alias("w"))
    edge = nested.unionByName(venv).unionByName(git).groupBy("path").agg(F.min("w").alias("w"))
    parts = F.split("path", "/")
    above = inventory.filter(up).select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("above"))
    # behind a boundary: all but the control folder that makes a repository a nested one, unless that one is itself behind another
    own = (basename(F.col("path")) == ".git") & (parent(F.col("path")) == F.col("above"))
    behind = above.filter(~own).join(edge.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct()
    return inventory.join(behind, "path", "left_anti").join(edge, "path", "left").select("path", F.col("w").alias("warning"))


def signac_counts(inventory: DataFrame) -> DataFrame:
    """(category, files, markers): markers of a data space by kind; of all kinds together the first ones by path are kept as markers."""
    p, kind = F.col("path"), F.lit(None).cast("string")
    for k, v in SIGNAC_NAMES.items():
        kind = F.when(basename(p) == v, k).otherwise(kind)
    for k, v in SIGNAC_PATHS.items():
        kind = F.when((p == v) | p.endswith("/" + v), k).otherwise(kind)
    c = inventory.filter("object_type = 'REGULAR_FILE'").select("path", kind.alias("category")).filter("category is not null")
    kept = c.orderBy("path").limit(SIGNAC_MOST).groupBy("category").agg(F.count("*").alias("markers"))
    return c.groupBy("category").agg(F.count("*").alias("files")).join(kept, "category", "left").select("category", "files", F.coalesce("markers", F.lit(0)).alias("markers"))


def roles(inventory: DataFrame, declared: DataFrame, structures: DataFrame, mainline: DataFrame) -> DataFrame:
    """(path, role, limitation) of regular files: the last declaration(path, role, ordinal); else a main guard in a file that is the mainline; else unresolved."""
    d = declared.filter(F.col("role").isin(ROLES)).groupBy("path").agg(F.max_by("role", "ordinal").alias("role"))
    m = structures.filter("has_main_guard").select("path").join(mainline.filter("status = 'ACTIVE_MAINLINE'").select("path"), "path", "left_semi").distinct().withColumn("m", F.lit(True))
    j = inventory.filter("object_type = 'REGULAR_FILE'").select("path").join(d, "path", "left").join(m, "path", "left")
    role = F.coalesce("role", F.when(F.col("m"), "ACTIVE_MAINLINE"), F.lit("UNRESOLVED"))
    why = F.when(F.col("role").isNotNull(), "DECLARED_ROLE_NOT_EXECUTION_AUTHORITY").when(F.col("m"), "PYTHON_SYNTAX_NOT_RUNTIME_BEHAVIOR").otherwise("NO_ROLE_EVIDENCE")
    return j.select("path", role.alias("role"), why.alias("limitation"))
