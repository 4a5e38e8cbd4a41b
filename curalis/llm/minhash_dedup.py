"""Near-duplicate groups by odd sketches (6): banded MinHash candidates, parity-bitmap estimates, exact confirmation.

1. Each document's distinct word shingles give SAMPLES minima; groups of ROWS minima are band keys. Two further
   samples are folded into parity bitmaps of SKETCH_BITS, in which each minimum flips one bit: the smallest hash
   in each of SKETCH_SAMPLES ranges of hashes, and, for sets that are not large, in ranges so narrow that each hash is its own
   minimum. The second holds the whole set, so its XOR counts the sets' difference with no sampling error.
2. Documents with equal shingle sets become one node at once; only nodes meet in bands.
3. Inside a band nodes are tested against one leader, a central one by the sketches, not all against all (`_graph.bucket_links`). A pair's XOR
   population count estimates its similarity; pairs estimated far below the threshold are dropped, the
   rest is confirmed on the full shingle sets in groups of bounded size, so no accepted link is an estimate.
Missed links: a pair at similarity 0.8 shares none of 26 bands of 5 rows with probability 3e-5; the parity
bounds lie DEVIATIONS standard deviations out (or at the difference itself, which the whole set's count can't exceed).

Cases: a null text, an empty text or one without words has no shingles and is linked with nothing. A null doc_id
is its own group with a null component. Rows of one doc_id are one document: what is linked to any of them is
linked to it, and n_shingles is each row's own. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ascii_hashes, bitmap, enter, materialize, mix, plain_hashes, shingles, ship, signed, split_by
from ._graph import bucket_links, components

SKETCH_BITS, SKETCH_SAMPLES = 1024, 1024
DEVIATIONS = 5.0
MEMBERS_PER_TASK_GROUP = 64
WHOLE_UP_TO = 2048
SKETCH = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary, flips long, whole binary"


class Minima:
    """Sample minima, band keys and odd sketch of a set of 64-bit shingle hashes."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, k = bands, rows, bands * rows
        self.mul = rng.integers(1, 1 << 32, k, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.add = rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32)
        self.row = np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def minima(self, s: np.ndarray) -> np.ndarray:
        h = (s ^ (s >> np.uint64(32))).astype(np.uint32)
        out = np.full(len(self.mul), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(h), 256):
            x = h[i : i + 256, None] * self.mul
            x += self.add
            np.minimum(out, x.min(axis=0), out=out)
        return out

    def of(self, s: np.ndarray) -> tuple[np.ndarray, bytes, int, bytes]:
        """Band keys, parity bitmap and the number of its flips, and the whole set's bitmap, for sorted hashes."""
        m = mix(self.minima(s).astype(np.uint64) + self.row)
        b = mix(m.reshape(self.bands, self.rows).cumsum(axis=1, dtype=np.uint64)[:, -1])
        where = (s >> np.uint64(32)) * np.uint64(SKETCH_SAMPLES) >> np.uint64(32)
        low = s[np.append(True, where[1:] != where[:-1])]
        return signed(b), parity(low), len(low), parity(s)


def parity(hashes: np.ndarray) -> bytes:
    """A bitmap in which each hash flips one bit."""
    bit = np.bincount((mix(hashes) >> np.uint64(20)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return np.packbits(bit.astype(np.uint8)).tobytes()


def most_bits(similarity: float, flips: int) -> int:
    """The XOR population count that two sketches of `flips` flips together exceed with the chance of DEVIATIONS only.

    Of R ranges those filled by the union, m, follow from `flips`: each document leaves 1 - flips / 2R of them empty, and
    the union is 2 / (1 + similarity) documents large. Each has equal minima with the chance `similarity`. The sample's
    variance shrinks as it comes to hold the whole union; twice the share left out is reckoned with.
    """
    empty = max(1 - flips / (2.0 * SKETCH_SAMPLES), 1e-9)
    union = -2 / (1 + similarity) * SKETCH_SAMPLES * math.log(empty)
    filled = SKETCH_SAMPLES * (1 - math.exp(-union / SKETCH_SAMPLES))
    unequal = max(flips - 2 * similarity * filled, 0.0)
    rest = min(1.0, 2 * (1 - filled / max(union, 1e-6)))
    fade = math.exp(-4 * unequal / SKETCH_BITS)
    mean = SKETCH_BITS / 2 * (1 - math.sqrt(fade))
    parity = SKETCH_BITS / 4 * (1 - fade)
    return math.ceil(mean + DEVIATIONS * math.sqrt(4 * similarity * (1 - similarity) * filled * rest * fade + parity - min(parity, 0.8 * unequal * fade))) + 4


def most_whole_bits(difference: int) -> int:
    """The XOR population count that the bitmaps of two whole sets exceed with the chance of DEVIATIONS only, where the sets
    differ in at most `difference` members: the parities of so many balls thrown into SKETCH_BITS bins."""
    n, d = SKETCH_BITS, difference
    one, two = (1 - 2 / n) ** d, (1 - 4 / n) ** d
    var = n / 4 * (1 - two) + n * n / 4 * (two - one * one)
    return min(d, math.ceil(n / 2 * (1 - one) + DEVIATIONS * math.sqrt(max(var, 0.0))))


def _word_hashes(words: str):
    return {"ascii": ascii_hashes, "plain": plain_hashes}[words]


def shingle_set(text: str | None, width: int, words: str) -> np.ndarray:
    return np.unique(shingles(_word_hashes(words)(text), width))


def sketches(docs: DataFrame, width: int, words: str, bands: int, rows: int) -> DataFrame:
    def make(batches):
        enter("sets")
        m = Minima(bands, rows)
        for b in batches:
            out = []
            for d, t in zip(b["doc_id"].astype("Int64"), b["text"]):
                s = shingle_set(t, width, words)
                if not len(s):
                    out.append((d, 0, None, None, None, None, None, None))
                    continue
                k = xxhash.xxh3_128_intdigest(s.tobytes())
                out.append((d, len(s), (k & (1 << 64) - 1) - (1 << 63), (k >> 64) - (1 << 63), *m.of(s)))
            f = pd.DataFrame(out, columns=["doc_id", "n_shingles", "k1", "k2", "bands", "sketch", "flips", "whole"])
            for c in ("doc_id", "k1", "k2", "flips"):
                f[c] = f[c].astype("Int64")
            yield f

    return docs.mapInPandas(make, SKETCH)


def _confirm_sets(pairs: DataFrame, docs: DataFrame, width: int, words: str, percent: int) -> DataFrame:
    """Of pairs (a, b) those with 100 * intersection >= percent * union, on full sets.

    Pairs are dealt by a and a salt, at most about MEMBERS_PER_TASK_GROUP of them in a group, each group with a's text.
    """
    size = pairs.groupBy("a").agg(F.count("*").alias("n"))
    p = pairs.join(size, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / MEMBERS_PER_TASK_GROUP)).cast("int"))
    p = materialize(p.select("a", "b", "salt"), "pairs")
    rows = p.select("a", "salt", F.col("b").alias("doc_id")).union(p.select("a", "salt", F.col("a").alias("doc_id")).distinct())
    some, _ = split_by(docs, F.col("doc_id"), bitmap(rows, "doc_id"))
    given = rows.join(some, "doc_id").select("a", "salt", "doc_id", "text")

    def check(f: pd.DataFrame) -> pd.DataFrame:
        enter("sets")
        a = f["a"].iloc[0]
        own = [shingle_set(t, width, words) for t in f.loc[f["doc_id"] == a, "text"]]
        hit = set()
        for d, t in zip(f["doc_id"], f["text"]):
            if d != a and d not in hit:
                s = shingle_set(t, width, words)
                for o in own:
                    both = len(np.intersect1d(o, s, assume_unique=True))
                    if both and 100 * both >= percent * (len(o) + len(s) - both):
                        hit.add(d)
        return pd.DataFrame({"a": a, "b": sorted(hit)}, dtype="int64")

    return given.groupBy("a", "salt").applyInPandas(check, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, words: str = "plain", percent: int = 80, bands: int = 26, rows: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text, ...)."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sk = materialize(sketches(docs, width, words, bands, rows), "sketches")
    named = sk.filter("doc_id is not null and k1 is not null")
    nodes = materialize(named.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "nodes")
    # a node's own row carries its bands; the rows of one doc_id may be of several nodes
    heads = named.join(nodes.select(F.col("node").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"])
    bids = heads.select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("i", "v"))
    buckets = bids.select(F.xxhash64("i", "v").alias("bid"), "id").distinct()
    words_ = range(SKETCH_BITS // 64)

    def split(c: str, to: str):
        return [F.conv(F.hex(F.substring(c, 8 * i + 1, 8)), 16, -10).cast("long").alias(f"{to}{i}") for i in words_]

    light = heads.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"), "flips", *split("sketch", "s"), *split("whole", "w"))
    names, light = [c for c in light.columns if c != "id"], materialize(light, "light")
    limits = F.expr(f"array({', '.join(str(most_bits(percent / 100, n)) for n in range(2 * SKETCH_SAMPLES + 1))})")
    whole_limits = F.expr(f"array({', '.join(str(most_whole_bits(d)) for d in range(WHOLE_UP_TO + 1))})")

    def unlike(a, b, kind):
        return sum((F.bit_count(a(f"{kind}{i}").bitwiseXOR(b(f"{kind}{i}"))) for i in words_), F.lit(0))

    def close(a, b):
        # 100 * shared >= percent * union, where shared = (sum - difference) / 2 and union = (sum + difference) / 2
        most = F.floor((a("size") + b("size")) * (100 - percent) / (100 + percent) + 1e-6)
        whole = unlike(a, b, "w") <= F.coalesce(F.get(whole_limits, most.cast("int")), F.lit(SKETCH_BITS))
        return (F.abs(a("size") - b("size")) <= most) & whole & (unlike(a, b, "s") <= F.get(limits, (a("flips") + b("flips")).cast("int")))

    def distance(a, b):
        return unlike(a, b, "s")

    def confirm(pairs: DataFrame) -> DataFrame:
        x = pairs
        for side in "ab":
            x = x.join(light.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}{c}") for c in names]), side)
        return _confirm_sets(x.filter(close(lambda c: F.col(f"a{c}"), lambda c: F.col(f"b{c}"))).select("a", "b").distinct(), docs, width, words, percent)

    links = bucket_links(buckets, confirm, light, close, distance)
    member = named.join(nodes, ["k1", "k2"]).select("doc_id", "node")
    several = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b")
    extra = member.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).filter("a <> b")
    comp = materialize(components(links.unionByName(extra)), "components")
    full = sk.join(nodes.select("k1", "k2", "node"), ["k1", "k2"], "left").join(comp, F.col("node") == comp.id, "left")
    c = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return full.select("doc_id", "n_shingles", c.alias("component_id"), F.coalesce(F.col("doc_id") == c, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents of a group other than its smallest doc_id; rows with a null doc_id stay."""
    gone = near_duplicates(docs, **options).filter("not kept").select("doc_id").distinct()
    gone = materialize(gone, "gone")
    row = docs.select(F.col("doc_id").cast("long").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    maybe, stay = split_by(row, F.col("_id"), bitmap(gone, "doc_id"))
    kept = stay.select("_doc").union(maybe.join(gone.select(F.col("doc_id").alias("_id")), "_id", "left_anti").select("_doc"))
    return kept.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
