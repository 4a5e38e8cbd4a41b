"""Connected components and bucket linking without collecting edges or expanding groups into all pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id on an edge (a, b); component is the smallest id reachable.

    Alternates large-star and small-star; each round is a written table, so a lost executor
    costs one round at most. Ends when a round leaves the edge set as it was.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    e = materialize(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if e.isEmpty():
        return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e2 = materialize(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = e2.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        e = e2
        if tuple(now) == before or now[0] == 0:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).union(
        e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


PROBES = 4
PART = 256


def _leaders(b: DataFrame, payload: DataFrame, distance: Callable, r: int) -> DataFrame:
    """(bid, a, ca): one member of each bucket that has not led yet. The first is any; later ones are central: the member
    with the least sum of distances to PROBES members, taken by hash."""
    may = b.filter("not led")
    if r == 0:
        lead = may.groupBy("bid").agg(F.min(F.struct(F.xxhash64(F.col("id"), F.lit(r)).alias("h"), "id", "c")).alias("l"))
        return lead.select("bid", F.col("l.id").alias("a"), F.col("l.c").alias("ca"))
    full = b.join(payload, "id")
    value = F.struct(*[c for c in payload.columns if c != "id"])
    probes = full.groupBy("bid").agg(*[F.min_by(value, F.xxhash64(F.col("id"), F.lit(r), F.lit(i))).alias(f"p{i}") for i in range(PROBES)])
    far = sum(distance(F.col, lambda c, i=i: F.col(f"p{i}.{c}")) for i in range(PROBES))
    lead = full.filter("not led").join(probes, "bid").groupBy("bid").agg(F.min(F.struct(far.alias("far"), F.xxhash64("id").alias("h"), "id", "c")).alias("l"))
    return lead.select("bid", F.col("l.id").alias("a"), F.col("l.c").alias("ca"))


def _sides(b: DataFrame, payload: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All members with their bucket's part, and those that each part meets, named x_: the members outside the bucket's largest component.

    Two members of different components are never both in the largest, so each such pair of a bucket lies in one of its parts.
    few: the member is on both sides."""
    most = b.groupBy("bid", "c").agg(F.count("*").alias("k")).groupBy("bid").agg(F.max_by("c", F.struct("k", "c")).alias("most"))
    y = b.join(most, "bid").withColumn("few", F.col("c") != F.col("most")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    y = y.select("bid", "id", "c", "few", "parts").join(payload, "id")
    x = y.filter("few").select(F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("x_part"), *[F.col(c).alias(f"x_{c}") for c in y.columns if c not in ("few", "parts")])
    return y.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")), x


def bucket_links(buckets: DataFrame, confirm: Callable[[DataFrame], DataFrame], payload: DataFrame, close: Callable, distance: Callable, rounds: int = 2) -> DataFrame:
    """Confirmed links (a, b) whose components are those of all confirmed pairs inside any bucket.

    buckets: (bid, id), distinct. A bucket of n members costs n - 1 pairs per star round, not n*(n-1)/2: every
    member is tested against one leader, members already in the leader's component are skipped, and
    another leader is taken in the next round. Buckets that still hold several components after the
    star rounds are finished exactly: each remaining pair of different components is tested, where members of a bucket's
    largest component meet only the members outside it.
    confirm takes distinct pairs (a, b) and returns those that are links. payload has columns for each id;
    close(column of a, column of b) says in their terms, by name, whether a pair can be a link at all, which the
    last step asks inside its join, and distance(...) how far apart two members are, by which leaders are chosen.
    """
    b = buckets.join(buckets.groupBy("bid").agg(F.count("*").alias("n")).filter("n > 1"), "bid")
    b = materialize(b.select("bid", "id", "n", F.col("id").alias("c"), F.lit(False).alias("led")), "buckets")
    if b.isEmpty():
        return b.select(F.col("id").alias("a"), F.col("id").alias("b"))
    found: DataFrame | None = None
    for r in range(rounds + 1):
        if r < rounds:
            lead = _leaders(b, payload, distance, r)
            if r:
                lead = materialize(lead, "leaders")
            pairs = b.join(lead, "bid").filter("c <> ca").select("a", F.col("id").alias("b"))
        else:
            y, x = _sides(b, payload)
            once = ~F.col("few") | (F.col("x_c") < F.col("c"))
            pairs = y.join(x, (F.col("bid") == F.col("x_bid")) & (F.col("part") == F.col("x_part")) & (F.col("x_c") != F.col("c")) & once & close(lambda c: F.col(f"x_{c}"), F.col)).select(F.col("x_id").alias("a"), F.col("id").alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = materialize(confirm(pairs), "links")
        found = links if found is None else found.union(links)
        if r == rounds:
            break
        c = materialize(components(found), "components")
        b = b.drop("c").join(c, "id", "left").select("bid", "id", "n", F.coalesce("component", "id").alias("c"), "led")
        mixed = b.groupBy("bid").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("bid")
        b = b.filter("n > 2").join(mixed, "bid").join(lead.select("bid", "a"), "bid", "left")
        b = materialize(b.select("bid", "id", "n", "c", (F.col("led") | F.coalesce(F.col("id") == F.col("a"), F.lit(False))).alias("led")), "buckets")
        if b.isEmpty():
            break
    return found
