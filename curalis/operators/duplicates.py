"""Exact and near duplicates of artifacts."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curalis.functions.columns import size_bucket, suffix, tokens
from curalis.functions.nested import let


BUCKETS = 1 << 20  # by which tokens are counted: a table of 8 MB, whatever the data
TILE = 64  # ids of a cluster that meet those of another part of it in one place
SKETCH = 16  # 64-bit words of a token set's parity sketch


def kept(df: DataFrame) -> DataFrame:
    """df computed once: a checkpoint in the shared folder where the session names one, else kept by the executors."""
    return df.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df.persist()


def exact_groups(artifacts: DataFrame, content: str = "content_id", member: str = "artifact_id") -> DataFrame:
    """Content that at least two artifacts share: members in order, the first is the keeper."""
    g = artifacts.filter(F.col(content).isNotNull()).groupBy(content).agg(F.sort_array(F.collect_list(member)).alias("members"))
    return g.filter(F.size("members") >= 2).withColumn("member_count", F.size("members").cast("long"))


def replacements(artifacts: DataFrame, content: str = "content_id", member: str = "artifact_id") -> DataFrame:
    """(member, replacement) for every member of a duplicate group but its keeper; the keeper is found with partial sums."""
    keep = artifacts.filter(F.col(content).isNotNull()).groupBy(content).agg(F.min(member).alias("replacement"), F.count("*").alias("n")).filter("n >= 2")
    return artifacts.join(keep, content).filter(F.col(member) != F.col("replacement")).select(member, "replacement")


def parity(hashes: str) -> Column:
    """A parity sketch of a set of 64-bit hashes, array<long>: bit i is the parity of how many fall on it. Sets that differ in n values have sketches that differ in n bits at most."""
    one = "aggregate(filter({h}, x -> (shiftright(x, 6) & {m}) = {i}), 0L, (a, x) -> a ^ shiftleft(1L, cast(x & 63 as int)))"
    return F.array(*[F.expr(one.format(h=hashes, m=SKETCH - 1, i=i)) for i in range(SKETCH)])


def _first(buckets, tenths: int):
    """Rows (id, suffix, bucket, toks) to (id, suffix, bucket, n, r): r holds the rarest tokens first, by how many fall on each token's bucket and then by value, as many as a larger set needs."""
    def run(batches):
        counts = buckets.value
        for b in batches:
            toks = b.column("toks")
            t, ends = toks.flatten().to_numpy(), np.diff(toks.offsets.to_numpy())
            doc = np.repeat(np.arange(len(ends)), ends)
            order = np.lexsort((t, counts[t & (len(counts) - 1)], doc))
            at = np.arange(len(t)) - np.repeat(np.cumsum(ends) - ends, ends)
            keep = ends - (tenths * ends + 9) // 10 + 1
            r = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)]), pa.int32()), pa.array(t[order][at < np.repeat(keep, ends)]))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("suffix"), b.column("bucket"), pa.array(ends, pa.int32()), r], names=["id", "suffix", "bucket", "n", "r"])

    return run


def _tiles(pairs: DataFrame) -> DataFrame:
    """pairs(ia, ib) with the tile where the two meet. Ids that share a least neighbour are a cluster, cut into parts of about TILE; a tile is two parts. So an id goes to few places, however many pairs it is
    in, and no place grows with the cluster."""
    ends = pairs.select("ia", "ib").unionByName(pairs.select(F.col("ib").alias("ia"), F.col("ia").alias("ib")))
    lead = ends.groupBy(F.col("ia").alias("id")).agg(F.least("id", F.min("ib")).alias("lead"))
    parts = lead.groupBy("lead").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    label = kept(lead.join(parts, "lead").select("id", F.xxhash64("lead", F.pmod(F.xxhash64("id"), "parts")).alias("label")))
    at = lambda x: label.select(F.col("id").alias(f"i{x}"), F.col("label").alias(f"l{x}"))
    return pairs.join(at("a"), "ia").join(at("b"), "ib").select("ia", "ib", F.xxhash64(F.least("la", "lb"), F.greatest("la", "lb")).alias("tile"))


def near_classes(artifacts: DataFrame, tenths: int = 7) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes, members): pairs(suffix, bucket, ca, cb, similarity) of unlike contents in one (suffix, size bucket) block whose token sets have a
    Jaccard similarity of tenths/10 or more, and members(artifact_id, suffix, bucket, content_id).

    artifacts(artifact_id, path, size_bytes, content_id, text). Exact up to collisions of 64-bit token hashes. Equal contents are one class. Tokens are
    ordered by rarity, told by a table of counts of fixed size: only the first n - ceil(n*tenths/10) + 1 of them can hold a pair's first common one, in the smaller set
    n - ceil(n*2*tenths/(10+tenths)) + 1, and its places in the two lists bound how many can be common at all; a pair's sizes must lie within the threshold. Tests are in integers.
    Pairs that are left meet by sketches first, which are short and pass every pair that is similar enough: token sets travel only for the pairs that pass, once to each tile of a cluster of them.
    """
    spark = artifacts.sparkSession
    blocks = artifacts.select("artifact_id", suffix(F.col("path")).alias("suffix"), size_bucket(F.col("size_bytes")).alias("bucket"), "content_id", "text")
    members = blocks.select("artifact_id", "suffix", "bucket", "content_id")
    hashes = F.array_sort(F.array_distinct(F.transform(tokens(F.col("text")), lambda x: F.xxhash64(x))))
    one = blocks.groupBy("suffix", "bucket", "content_id").agg(F.min("artifact_id").alias("artifact_id"))
    d = blocks.join(one, ["suffix", "bucket", "content_id", "artifact_id"], "left_semi").select(F.xxhash64("suffix", "bucket", "content_id").alias("id"), "suffix", "bucket", "content_id", hashes.alias("toks"))
    d = kept(d.filter("size(toks) >= 3").withColumn("sketch", parity("toks"))).withColumn("n", F.size("toks"))  # texts are read and split once for the uses below
    # any order of tokens that is the same for all documents will do: tokens of one bucket count together
    table = np.zeros(BUCKETS, "int64")
    found = d.select(F.explode("toks").alias("t")).groupBy(F.col("t").bitwiseAND(BUCKETS - 1).alias("t")).agg(F.count("*").alias("df")).toArrow()
    table[found["t"].to_numpy()] = found["df"].to_numpy()
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package
    kind = dict(d.dtypes)["bucket"]
    rare = d.select("id", "suffix", "bucket", "toks").mapInArrow(_first(spark.sparkContext.broadcast(table), tenths), f"id long, suffix string, bucket {kind}, n int, r array<long>")
    # sizes that differ by less than the threshold are in one class or in two that are next to each other
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(10.0 / tenths)) + 1e-9).cast("int")
    short = (F.col("n") - F.floor((2 * tenths * F.col("n") + 9 + tenths) / (10 + tenths)) + 1).cast("int")
    listed = lambda sizes, r: rare.withColumn("size", F.explode(sizes)).select("id", "n", "suffix", "bucket", "size", F.posexplode(r).alias("at", "tok")).select("id", "n", "at", F.xxhash64("suffix", "bucket", "size", "tok").alias("key"))
    a, b = listed(F.array(size, size + 1), F.slice("r", 1, short)).alias("a"), listed(F.array(size), F.col("r")).alias("b")
    # common tokens of a pair that shares its first one here: at most one more than the fewer that are left in either list
    most = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    enough = 10 * most >= tenths * (F.col("a.n") + F.col("b.n") - most)
    smaller = (F.col("a.n") < F.col("b.n")) | (F.col("a.n") == F.col("b.n")) & (F.col("a.id") < F.col("b.id"))
    c = a.join(b, [F.col("a.key") == F.col("b.key"), smaller, tenths * F.col("b.n") <= 10 * F.col("a.n"), enough]).select(F.least("a.id", "b.id").alias("ia"), F.greatest("a.id", "b.id").alias("ib")).distinct()
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    drawn = lambda x: d.select(F.col("id").alias(f"i{x}"), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    # of i common tokens n - 2 i are not, and (10 + tenths) i is at least tenths n, n being the tokens of both
    c = c.join(drawn("a"), "ia").join(drawn("b"), "ib").filter((10 + tenths) * apart <= (10 - tenths) * (F.col("na") + F.col("nb"))).select("ia", "ib")
    c = _tiles(c.persist()).persist()  # thin rows
    goes = c.select("tile", F.col("ia").alias("id")).unionByName(c.select("tile", F.col("ib").alias("id"))).distinct()
    sets = goes.join(d.select("id", "toks", "suffix", "bucket", "content_id"), "id").groupBy("tile").agg(F.collect_list(F.struct("id", "toks", "suffix", "bucket", "content_id")).alias("e"))
    asked = c.groupBy("tile").agg(F.collect_list(F.struct("ia", "ib")).alias("p"))
    one_of = lambda i: F.get("e", F.array_position("ids", i).cast("int") - 1)

    def met(a: Column, b: Column) -> Column:
        same = (a.suffix == b.suffix) & (a.bucket == b.bucket)
        return F.struct(a.suffix.alias("suffix"), a.bucket.alias("bucket"), a.content_id.alias("ca"), b.content_id.alias("cb"), F.when(same, F.size(F.array_intersect(a.toks, b.toks))).otherwise(0).alias("i"), (F.size(a.toks) + F.size(b.toks)).alias("n"))

    told = F.transform("p", lambda x: let(one_of(x.ia), lambda a: let(one_of(x.ib), lambda b: met(a, b))))
    hit = sets.join(asked, "tile").withColumn("ids", F.transform("e", lambda x: x.id)).select(F.inline(F.filter(told, lambda x: 10 * x.i >= tenths * (x.n - x.i))))
    return hit.select("suffix", "bucket", "ca", "cb", F.round(F.col("i") / (F.col("n") - F.col("i")), 6).alias("similarity")), members


def near_pairs(artifacts: DataFrame, tenths: int = 7) -> DataFrame:
    """The pairs of artifacts of `near_classes`: (left_id, right_id, similarity). Copies of a content are each paired; ask near_classes where groups are large."""
    hit, members = near_classes(artifacts, tenths)
    l, r = members.select("suffix", "bucket", F.col("content_id").alias("ca"), F.col("artifact_id").alias("x")), members.select("suffix", "bucket", F.col("content_id").alias("cb"), F.col("artifact_id").alias("y"))
    out = hit.join(l, ["suffix", "bucket", "ca"]).join(r, ["suffix", "bucket", "cb"])
    return out.select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"), "similarity")


def case_collisions(artifacts: DataFrame, path: str = "path") -> DataFrame:
    """Paths that are one path where case and composition of letters do not count."""
    from curalis.functions.columns import collision_key

    return artifacts.groupBy(collision_key(F.col(path)).alias("key")).agg(F.count_distinct(path).alias("paths")).filter("paths > 1")


def dense_ids(df: DataFrame, keys: list[str], name: str = "id", prefix: str = "", width: int = 8, first: int = 0) -> DataFrame:
    """Numbers rows in the order of keys without a single-task sort: the rows are sorted by ranges once and kept with their places in
    their partitions, and the number of rows in the partitions before is added. Ties are in the order of a hash of the whole row, so that only equal rows may change places."""
    at = f"_at_{name}"
    rest = [c for c, kind in df.dtypes if c not in keys and "map<" not in kind and "variant" not in kind]
    p = df.orderBy(*keys, *([F.xxhash64(*rest)] if rest else [])).withColumn(at, F.monotonically_increasing_id())
    p = kept(p)
    part = F.shiftright(at, 33)
    counts = p.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    base = counts.select(F.col("_p").alias("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # one row a partition
    out = p.join(F.broadcast(base), part == F.col("_p"))
    number = F.col("_b") + F.col(at) - F.shiftleft(F.col("_p"), 33) + first
    return out.select(*df.columns, F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0")).alias(name))
