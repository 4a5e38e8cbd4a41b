"""Differences between two snapshots of an inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalis.functions.columns import json_string


def changes(prior: DataFrame, current: DataFrame, path: str = "path", content: str = "content_id") -> DataFrame:
    """(path, change): ADDED, REMOVED or CHANGED; null contents are equal to each other. One full outer join."""
    a = prior.select(path, F.col(content).alias("_a"), F.lit(1).alias("_in_a"))
    b = current.select(path, F.col(content).alias("_b"), F.lit(1).alias("_in_b"))
    j = a.join(b, path, "full_outer")
    kind = F.when(F.col("_in_a").isNull(), "ADDED").when(F.col("_in_b").isNull(), "REMOVED").when(~F.col("_a").eqNullSafe(F.col("_b")), "CHANGED")
    return j.select(path, kind.alias("change"), F.coalesce("_b", "_a").alias(content)).filter("change is not null")


def moves(diff: DataFrame, path: str = "path", content: str = "content_id") -> DataFrame:
    """(from, to) where a content is the only removed and the only added one of its kind."""
    def single(kind: str, name: str) -> DataFrame:
        return diff.filter(F.col("change") == kind).groupBy(content).agg(F.count("*").alias("_n"), F.min(path).alias(name)).filter(f"_n = 1 and {content} is not null").drop("_n")

    return single("REMOVED", "moved_from").join(single("ADDED", "moved_to"), content)


def summarize(prior: DataFrame, current: DataFrame) -> DataFrame:
    """Counts of added, removed, changed and moved paths; a moved path is neither added nor removed."""
    d = changes(prior, current)
    m = moves(d)
    paths = m.select(F.explode(F.array("moved_from", "moved_to")).alias("path")).distinct()
    rest = d.join(paths, "path", "left_anti").select("change").union(m.select(F.lit("MOVED").alias("change")))
    return rest.groupBy("change").agg(F.count("*").alias("n"))


def status_transitions(prior: DataFrame, current: DataFrame, key: str = "path", status: str = "status") -> DataFrame:
    """(key, transition) of keys in both tables that leave UNRESOLVED (NEWLY_LINKED), enter it (NEWLY_CONFLICTING) or stay in it; a null status is UNRESOLVED."""
    none = F.lit("UNRESOLVED")
    a, b = prior.select(key, (F.coalesce(status, none) == none).alias("_a")), current.select(key, (F.coalesce(status, none) == none).alias("_b"))
    t = F.when(F.col("_a") & ~F.col("_b"), "NEWLY_LINKED").when(~F.col("_a") & F.col("_b"), "NEWLY_CONFLICTING").when(F.col("_a") & F.col("_b"), "STILL_UNRESOLVED")
    return a.join(b, key).withColumn("transition", t).filter("transition is not null").select(key, "transition")


def set_mismatch(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: none if the two are equal sets."""
    l, r = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    return l.join(r, key, "full_outer").filter("_l is null or _r is null").select(key, F.when(F.col("_l").isNull(), "RIGHT_ONLY").otherwise("LEFT_ONLY").alias("side"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def unchanged_state(baseline: DataFrame, moved: DataFrame, key: str = "path") -> DataFrame:
    """Rows of a baseline that are expected to be left after the moves that have been completed."""
    return baseline.join(moved.select(key).distinct(), key, "left_anti")


def expected_state(baseline: DataFrame, moved: DataFrame, heads: DataFrame, part: str) -> DataFrame:
    """(part, state): the identity that a part is expected to have after the moves completed so far: the hash of canonical JSON of its records that are left and of its head, in the order of paths.

    baseline(part, path, kind, size, mode, digest); moved(part, path); heads(part, head), one for each part. A part's lines meet in one row, as its identity is a hash of them all."""
    left = baseline.join(moved.select(part, "path").distinct(), [part, "path"], "left_anti")
    text, number = lambda c: json_string(F.col(c)), lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    row = lambda *x: F.concat(F.lit("["), F.concat_ws(",", *x), F.lit("]"))
    lines = left.select(part, "path", row(text("path"), text("kind"), number("size"), number("mode"), text("digest")).alias("j"))
    lines = lines.unionByName(heads.select(part, F.lit(".git/HEAD").alias("path"), row(F.lit('".git/HEAD"'), F.lit('"GIT_HEAD"'), text("head")).alias("j")))
    g = lines.groupBy(part).agg(F.array_sort(F.collect_list(F.struct("path", "j"))).alias("x"))
    return g.select(part, F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("["), F.array_join(F.transform("x", lambda x: x.j), ","), F.lit("]")), 256)).alias("state"))


def purge_descendants(paths: DataFrame, dirs: DataFrame, path: str = "path") -> DataFrame:
    """Rows that lie under none of dirs(path): each row's ancestors are looked up, not each directory compared."""
    parts = F.split(F.col(path), "/")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.when(i < F.size(parts), F.array_join(F.slice(parts, 1, i), "/")))
    under = paths.select(path, F.explode(F.array_compact(up)).alias("_d")).join(dirs.select(F.col(path).alias("_d")).distinct(), "_d", "left_semi").select(path).distinct()
    return paths.join(under, path, "left_anti")
