"""Budgets that skip what does not fit and go on: exact over any number of tasks.

Rows of a part are taken in order as long as they fit what is left of its budget; one that does not is skipped, and a later, smaller one may still fit. Rows are dealt
by range into blocks of at most BLOCK_ROWS of one part. A round adds up, for each block, the rows that still can fit (those no larger than what is left), finds
each part's first block that goes over, decides that block's rows one by one, and goes on behind it with what is left then. All blocks before it are taken whole, but
for rows too large. So a round is one aggregation over all parts at once, and rounds are as many as a part has blocks in which something is skipped that was small
enough when the block before ended: what is left shrinks with each, so that few remain. No task or row holds a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curalis.operators.duplicates import kept

BLOCK_ROWS = 1024
SMALL_ROWS = 500_000  # rows of a few numbers that are broadcast; a larger table is joined by shuffle
# fixed values: why a file's content is not read
TOO_LARGE = "CONTENT_HASH_SKIPPED_SIZE_LIMIT"
NO_BUDGET = "CONTENT_HASH_SKIPPED_TOTAL_BYTES_LIMIT"


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def _fold(left: Column, rows: Column) -> Column:
    """struct(left, taken): rows(_o, _n) in order against what is left."""
    start = F.struct(left.alias("left"), F.filter(rows, lambda x: F.lit(False)).alias("taken"))

    def step(a, x):
        fits = x["_n"] <= a["left"]
        return F.struct((a["left"] - F.when(fits, x["_n"]).otherwise(0)).alias("left"), F.when(fits, F.concat(a["taken"], F.array(x))).otherwise(a["taken"]).alias("taken"))

    return F.aggregate(rows, start, step)


def greedy_rounds(df: DataFrame, part: str, order: str, size: str, most: int) -> tuple[DataFrame, int]:
    """((_p, _o) of the rows taken, number of rounds). order is unique in its part and a null size never fits."""
    d = df.select(F.col(part).alias("_p"), F.col(order).alias("_o"), F.col(size).cast("long").alias("_n")).filter("_n is not null")
    d = d.repartitionByRange("_p", "_o").sortWithinPartitions("_p", "_o").withColumn("_b", F.expr(f"monotonically_increasing_id() div {BLOCK_ROWS}"))
    d = kept(d)
    state = kept(d.groupBy("_p").agg(F.lit(-1).cast("long").alias("_from"), F.lit(most).cast("long").alias("_left")))
    parts, rounds, out = state.count(), 0, None
    while True:
        alive = d.join(_small(state, parts), d["_p"].eqNullSafe(state["_p"])).drop(state["_p"]).filter((F.col("_b") > F.col("_from")) & (F.col("_n") <= F.col("_left")))
        blocks = kept(alive.groupBy("_p", "_from", "_left", "_b").agg(F.sum("_n").alias("_s")))
        before = F.coalesce(F.sum("_s").over(Window.partitionBy("_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        over = blocks.withColumn("_before", before).filter(F.col("_before") + F.col("_s") > F.col("_left"))
        hit = kept(over.groupBy("_p", "_from", "_left").agg(F.min_by(F.struct("_b", "_before"), "_b").alias("h")).select("_p", "_from", "_left", F.col("h._b").alias("_hit"), F.col("h._before").alias("_before")))
        hits = hit.count()
        rounds += 1
        h = hit.select(F.col("_p").alias("_q"), "_hit", "_before")
        mine = F.col("_p").eqNullSafe(F.col("_q"))
        whole = alive.join(_small(h, hits), mine, "left").filter(F.col("_hit").isNull() | (F.col("_b") < F.col("_hit"))).select("_p", "_o")
        out = whole if out is None else out.unionByName(whole)
        if not hits:
            return out, rounds
        here = alive.join(_small(h, hits), mine & (F.col("_b") == F.col("_hit"))).groupBy("_p", "_hit", "_left", "_before").agg(F.array_sort(F.collect_list(F.struct("_o", "_n"))).alias("x"))
        done = kept(here.select("_p", "_hit", _fold(F.col("_left") - F.col("_before"), F.col("x")).alias("f")))
        out = out.unionByName(done.select("_p", F.explode("f.taken").alias("t")).select("_p", F.col("t._o").alias("_o")))
        state, parts = done.select("_p", F.col("_hit").alias("_from"), F.col("f.left").alias("_left")), hits


def greedy_budget(df: DataFrame, part: str, order: str, size: str, most_bytes: int) -> DataFrame:
    """Rows taken in order as long as they fit what is left; a later smaller row may still fit."""
    taken, _ = greedy_rounds(df, part, order, size, most_bytes)
    return df.join(taken, df[part].eqNullSafe(taken["_p"]) & (df[order] == taken["_o"]), "left_semi")


def content_budgets(files: DataFrame, part: str, order: str, size: str, content_id: Column, most_file: int, most_total: int) -> DataFrame:
    """files with `limitation` and `content_id`: files above the limit of one file are skipped and cost nothing, of the others those that the part's total leaves no room for."""
    some = files.filter(F.col(size) <= most_file)
    taken, _ = greedy_rounds(some, part, order, size, most_total)
    j = files.join(taken.withColumn("_t", F.lit(True)), files[part].eqNullSafe(taken["_p"]) & (files[order] == taken["_o"]), "left")
    why = F.when(F.col(size) > most_file, TOO_LARGE).when(F.col("_t").isNull(), NO_BUDGET)
    return j.withColumn("limitation", why).withColumn("content_id", F.when(F.col("limitation").isNull(), content_id)).drop("_p", "_o", "_t")


def bounded_listing(entries: DataFrame, parent: str, path: str, most: int) -> DataFrame:
    """(path, parent, warnings) of the entries that a scan lists: below a directory of more than `most` entries nothing is listed, at any depth, and the
    directory itself carries DIRECTORY_ENTRY_LIMIT. Each path looks its own ancestors up by equality."""
    wide = kept(entries.groupBy(F.col(parent).alias("_w")).agg(F.count("*").alias("_c")).filter(F.col("_c") > most).select("_w"))
    rows = wide.count()
    parts = F.split(F.col(path), "/")
    above = F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    above = F.when(F.size(parts) == 1, F.array(F.lit("."))).otherwise(above)
    below = entries.select(F.col(path).alias("_x"), F.explode(above).alias("_a")).filter(F.col("_x") != ".").join(_small(wide, rows), F.col("_a") == F.col("_w")).select("_x").distinct()
    rest = entries.join(below, F.col(path) == F.col("_x"), "left_anti")
    told = rest.join(_small(wide, rows), F.col(path) == F.col("_w"), "left")
    return told.select(path, parent, F.when(F.col("_w").isNotNull(), F.array(F.lit("DIRECTORY_ENTRY_LIMIT"))).otherwise(F.array().cast("array<string>")).alias("warnings"))
