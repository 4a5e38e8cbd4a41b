"""Ordered logs and budgets: hash chains, event sequences, running limits; directory digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curalis.functions.columns import basename, depth, json_object, json_string, parent, sorted_set
from curalis.operators.duplicates import kept


ZERO = "sha256:" + "0" * 64  # fixed value: what the first event names


def verify_chain(events: DataFrame, part: str, seq: str, prev: str, own: str, payload, genesis: str = ZERO) -> DataFrame:
    """Per chain: whether sequence is 1, 2, 3 ..., each event names the hash of the one before it (the first one genesis), and each hash is its own.

    The event before is joined by its number, so a chain of any length is spread over all tasks. A chain with gaps or with two events of one number is not contiguous: then a number
    is missing below the largest, so that some event has none before it, or the largest is not the count. A false link is one to what is, or should be, there."""
    e = events.withColumn("_h", payload)
    before = events.groupBy(F.col(part).alias("_p"), (F.col(seq) + 1).alias("_s")).agg(F.min(own).alias("_l"), F.max(own).alias("_m"))
    j = e.join(before, (F.col(part) == F.col("_p")) & (F.col(seq) == F.col("_s")), "left")
    first, n = F.col(seq) == 1, F.count("*")
    whole = (F.min(seq) == 1) & (F.max(seq) == n) & F.bool_and(first | F.col("_s").isNotNull())
    link = F.when(first, F.lit(genesis)).otherwise(F.when(F.col("_l") == F.col("_m"), F.col("_l")))
    return j.groupBy(part).agg(n.alias("events"), whole.alias("contiguous"), F.bool_and(link.eqNullSafe(F.col(prev))).alias("linked"), F.bool_and(F.col("_h").eqNullSafe(F.col(own))).alias("hashed"))


def event_sequences(events: DataFrame, part: str, order: list[str], kind: str) -> DataFrame:
    """Each part's kinds in order, as an array."""
    g = events.groupBy(part).agg(F.sort_array(F.collect_list(F.struct(*order, kind))).alias("_e"))
    return g.select(part, F.transform("_e", lambda x: x[kind]).alias("sequence"))


def prefix_budget(df: DataFrame, part: list[str], order: list[str], size: str, most_rows: int, most_bytes: int) -> DataFrame:
    """Rows before the first that breaks a running limit, as in a scan that stops there."""
    w = Window.partitionBy(*part).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_over", (F.row_number().over(w) > most_rows) | (F.sum(size).over(run) > most_bytes))
    return d.withColumn("_stop", F.max("_over").over(run)).filter("not _stop").drop("_over", "_stop")


def wide_parents(df: DataFrame, parent: str, most: int) -> DataFrame:
    """Parents with more children than allowed: nothing of them is scanned."""
    return df.groupBy(parent).agg(F.count("*").alias("children")).withColumn("listed", F.col("children") <= most)


def ordered_digest(df: DataFrame, part: list[str], order: list[str], line) -> DataFrame:
    """SHA-256 over the lines of each part in order."""
    g = df.withColumn("_line", line).groupBy(*part).agg(F.sort_array(F.collect_list(F.struct(*order, "_line"))).alias("_x"), F.count("*").alias("entries"))
    return g.select(*part, "entries", F.sha2(F.array_join(F.transform("_x", lambda x: x["_line"]), "\n"), 256).alias("digest"))


STATE_SCHEME = "sha256-repo-state-v1"


def state_identity(df: DataFrame, part: str, root: str = "") -> DataFrame:
    """(part, state): identity of all artifacts(content_id, executable, mode, mtime_ns, object_type, path, size_bytes) of a part, in the order of their paths,
    as the hash of canonical JSON. A part's lines meet in one row, as its identity is a hash of them all."""
    one = json_object([("content_id", json_string(F.col("content_id"))), ("executable", F.col("executable").cast("string")), ("mode", F.col("mode").cast("string")), ("mtime_ns", F.col("mtime_ns").cast("string")),
                       ("object_type", json_string(F.col("object_type"))), ("repository_relative_path", json_string(F.col("path"))), ("size_bytes", F.col("size_bytes").cast("string"))])
    g = df.groupBy(part).agg(F.array_sort(F.collect_list(F.struct("path", one.alias("j")))).alias("x"))
    whole = json_object([("artifacts", F.concat(F.lit("["), F.array_join(F.transform("x", lambda x: x["j"]), ","), F.lit("]"))), ("repository_root_realpath", json_string(F.concat(F.lit(root), F.col(part)))), ("scheme", json_string(F.lit(STATE_SCHEME)))])
    return g.select(part, F.concat(F.lit(STATE_SCHEME + ":"), F.sha2(whole, 256)).alias("state"))


def merkle_directories(nodes: DataFrame) -> DataFrame:
    """(path, content_id, warnings) of every directory, from the deepest level up; '.' is the root.

    nodes(path, object_type, content_id, executable, symlink_target_text, warnings) hold all entries, directories without content_id. A directory's
    identity is the hash of its children's manifest in the order of their names; it has none where a child has none, whose warnings it takes over, or
    where it has warnings of its own. A level is one aggregation, written down, so that the next one reads its rows; all levels count, however deep.
    """
    none = F.array().cast("array<string>")
    d = kept(nodes.withColumn("_depth", depth(F.col("path"))).withColumn("_p", parent(F.col("path"))).withColumn("warnings", F.coalesce("warnings", none)))
    deepest = d.agg(F.max("_depth")).first()[0] or 0
    folder = F.col("object_type") == "DIRECTORY"
    empty = F.concat(F.lit("merkle-dir-v1:"), F.sha2(F.lit("[]"), 256))
    below, levels = None, []
    for level in range(deepest, -1, -1):
        dirs = d.filter((F.col("_depth") == level) & folder).select("path", "_p", "executable", F.col("warnings").alias("own"))
        if below is None:
            now = dirs.withColumn("content_id", F.when(F.size("own") == 0, empty)).withColumnRenamed("own", "warnings")
        else:
            child = json_object([("content_id", json_string(F.col("content_id"))), ("executable", F.coalesce("executable", F.lit(False)).cast("string")), ("name", json_string(basename(F.col("path")))), ("object_type", json_string(F.col("object_type"))), ("symlink_target_text", json_string(F.col("symlink_target_text")))])
            g = below.groupBy(F.col("_p").alias("path")).agg(F.array_sort(F.collect_list(F.struct(basename(F.col("path")).alias("k"), child.alias("j")))).alias("x"), F.bool_and(F.col("content_id").isNotNull()).alias("ok"), F.flatten(F.collect_set(F.when(F.col("content_id").isNull(), F.col("warnings")))).alias("taken"))
            j = dirs.join(g, "path", "left")
            manifest = F.concat(F.lit("["), F.array_join(F.transform("x", lambda x: x["j"]), ","), F.lit("]"))
            identity = F.when(F.col("x").isNull(), empty).otherwise(F.concat(F.lit("merkle-dir-v1:"), F.sha2(manifest, 256)))
            ok = F.coalesce("ok", F.lit(True))
            now = j.select("path", "_p", "executable", F.when(ok & (F.size("own") == 0), identity).alias("content_id"), sorted_set(F.when(ok, F.col("own")).otherwise(F.concat("own", "taken"))).alias("warnings"))
        now = kept(now)
        levels.append(now)
        files = d.filter((F.col("_depth") == level) & ~folder).select("path", "_p", "object_type", "content_id", "executable", "symlink_target_text", "warnings")
        below = files.unionByName(now.select("path", "_p", F.lit("DIRECTORY").alias("object_type"), "content_id", "executable", F.lit(None).cast("string").alias("symlink_target_text"), "warnings"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.select("path", "content_id", "warnings")
