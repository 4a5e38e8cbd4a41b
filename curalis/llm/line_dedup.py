"""Fuzzy line dedup (5): normalised lines, join on pigeonhole runs of words, edit similarity, one line a group.

A line is compared by its words in lower case, letters and digits only, digits alike. Equal lines meet by hash. Different
lines are linked whose word edit similarity, 1 - distance / words of the longer, is at least 0.8. At that similarity
d = n // 5 edits cut a line of n words into at most d + 1 untouched runs, so by the pigeonhole principle one run has at least
4 words (3 below 20 words, 2 below 6): the blocks are the runs of that many words. A line of up to KEYS + 3 words gives all of its
blocks, so no link between such lines is lost; of a longer line those KEYS blocks are taken whose hashes are smallest, and two
lines at exactly 0.8 with random edits share one of them with a chance of about 0.96 (tests measure it). SimHash bit blocks
at this similarity would need 34 blocks of under four bits each, which is why the blocks are of words here; a 128-bit parity sketch of the
words, of which an edit flips at most two bits, takes the place of the Hamming test: linked lines differ in at most 2 d bits, so it loses none.
Lines of more than WIDE words would fill it, so that all pairs passed: they have a second sketch of eight to sixteen bits a word, in which equal words of a line are numbered.
Of each pair that is left the edit distance is computed on whole lines.

Blocks that many lines share are split by line length, and their lines meet LEADERS of them first, not each other. Of each
connected group the occurrence with the smallest doc_id stays, the earliest there.

Lines of fewer than FUZZY_WORDS words have no different line at 0.8; they meet by hash only. Lines without a word stay.
Cases: null and empty texts are unchanged; rows of one doc_id are one document; rows without a doc_id are documents by their text,
after all others; other columns pass through whatever their names, and where one is called n_removed already the count is n_removed_; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import GOLD, bitmap, enter, free_name, materialize, mix, order_of, runs, ship, signed, split_by, with_order
from ._graph import components

LEAST_WORDS = 1
FUZZY_WORDS = 4
KEYS = 8
WIDTHS = {2: (4, 5), 3: (5, 19), 4: (16, 1 << 62)}  # words of a block: lines of so many words, with a partner on either side of a limit
LARGE, LEADERS, PART = 16, 4, 1024
WIDE = 64
FINE = 8  # words for each 64 bits of the wide sketch that lines are compared by
SMALL_MAP = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of the normalised words; 0 where nothing is left of a word."""
    w = pc.utf8_lower(words)
    odd = pc.invert(pc.utf8_is_alpha(w))
    plain = pc.replace_substring_regex(pc.filter(w, odd), r"[^\pL\pN]+", "")
    w = pc.replace_with_mask(w, odd, pc.replace_substring_regex(plain, "[0-9]+", "0"))
    ends = np.frombuffer(w.buffers()[1], np.int64)[w.offset : w.offset + len(w) + 1]
    out, some = np.zeros(len(w), np.uint64), np.diff(ends) > 0
    if some.any():
        letters = np.frombuffer(w.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        out[some] = np.maximum(runs(letters.astype(np.uint64), ends[:-1][some] - ends[0]), np.uint64(1))
    return out


def lines_of_all(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text numbers, line numbers, word hashes, first word of each) of the lines of texts that are compared."""
    split = pc.split_pattern(pa.array(texts, pa.large_string()), "\n")
    words = pc.utf8_split_whitespace(split.flatten())
    flat = pc.dictionary_encode(words.flatten())
    if not len(flat):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    h = _hashes(flat.dictionary)[flat.indices.to_numpy(zero_copy_only=False)]
    line = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))[h != 0]
    h = h[h != 0]
    ok = np.bincount(line, minlength=len(words)) >= LEAST_WORDS
    h, line = h[ok[line]], line[ok[line]]
    at = np.flatnonzero(ok)
    begin = split.offsets.to_numpy()
    of = np.searchsorted(begin, at, side="right") - 1
    return of, at - begin[of], h, np.searchsorted(line, at)


def lines_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line numbers, word hashes, first word of each) of the lines that are compared."""
    return lines_of_all([text])[1:]


def _few(batches):
    """Parts of the batches: at most 1,000 rows, or one long text and those before it."""
    for x in batches:
        long = np.cumsum([len(t) if t else 0 for t in x["text"]]) // 4_000_000
        for _, y in x.groupby(long):
            for k in range(0, len(y), 1000):
                yield y.iloc[k : k + 1000]


def blocks(words: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of the KEYS smallest distinct block hashes of each width that a line has; lines in order."""
    n = np.diff(np.append(heads, len(words)))
    lines, keys = [], []
    line = np.repeat(np.arange(len(heads)), n)
    left = np.repeat(heads + n, n) - np.arange(len(words))  # words from here to the line's end
    for width, (least, most) in WIDTHS.items():
        at = np.flatnonzero((left >= width) & ((n >= least) & (n <= most))[line])
        if not len(at):
            continue
        h = np.zeros(len(at), np.uint64)
        for i in range(width):
            h = mix(h + words[at + i] + np.uint64(width))
        of = line[at]
        # of long lines only hashes that may be among the smallest are sorted; a line left with too few keeps all
        count = np.maximum(n - width + 1, 1)
        low = (h >> np.uint64(40)).astype(np.int64) < (np.minimum((3 * KEYS + 8) / count, 1.0) * (1 << 24)).astype(np.int64)[of]
        few = np.bincount(of[low], minlength=len(n)) < 2 * KEYS
        low |= few[of]
        h, of = h[low], of[low]
        order = np.argsort(of.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
        h, of = h[order], of[order]
        new = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))
        h, of = h[new], of[new]
        ok = np.arange(len(of)) - np.searchsorted(of, of) < KEYS
        lines.append(of[ok])
        keys.append(h[ok])
    if not lines:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    of, h = np.concatenate(lines), np.concatenate(keys)
    order = np.argsort(of, kind="stable")
    return of[order], signed(h[order])


def parity(words: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Two 64-bit words for each run: bit i is the parity of the number of its words hashed to i."""
    if not len(heads):
        return np.empty((0, 2), np.uint64)
    x = mix(words ^ np.uint64(GOLD))
    bit, side = np.uint64(1) << (x & np.uint64(63)), x >> np.uint64(63)
    return np.stack([np.bitwise_xor.reduceat(bit * (side == np.uint64(i)), heads) for i in range(2)], axis=1)


def times(words: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How many equal words of the same run were counted before each word; in which order is left open."""
    key = mix(words + mix(of.astype(np.uint64)))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    out = np.empty(len(key), np.int64)
    out[order] = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    return out


def wide_parity(words: np.ndarray, heads: np.ndarray, each: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit words, how many of them for each run): a parity sketch of at least 64 bits for `each` words, its size a power of two, for runs of more than WIDE words; none for others.

    The second, third, ... of equal words in a run count as words of their own: else they cancelled out, and runs of a few words over and over all passed.
    A sketch of twice the size, its halves xored, is the sketch of the size."""
    n = np.diff(np.append(heads, len(words)))
    long = n > WIDE
    size = np.where(long, 1 << np.ceil(np.log2(np.maximum(n, 1) / each)).astype(np.int64).clip(0), 0)
    begin = np.cumsum(size) - size
    words, of = words[np.repeat(long, n)], np.repeat(np.flatnonzero(long), n[long])
    x = mix((words + times(words, of).astype(np.uint64) * np.uint64(GOLD)) ^ np.uint64(GOLD))
    at = (x >> np.uint64(12)).astype(np.int64)
    out = np.zeros(int(size.sum()), np.uint64)
    np.bitwise_xor.at(out, begin[of] + (at & (size[of] - 1)), np.uint64(1) << ((x >> np.uint64(6)) & np.uint64(63)))
    return out, size


OCCURRENCES = "_ord long, th long, h long, s0 long, s1 long, m long, at array<int>, keys array<long>, wide array<long>"


def _occurrences(batches):
    """The distinct lines of each text, and where they stand in it."""
    enter("lines")
    for batch in batches:
        for b in _few([batch.to_pandas()]):
            b = b[b["text"].notna()]
            of, number, w, heads = lines_of_all(list(b["text"]))
            if not len(heads):
                continue
            h = runs(w, heads)
            order = np.lexsort((h, of))
            new = np.flatnonzero(np.append(True, (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])))
            times, by = np.diff(np.append(new, len(order))), np.argsort(order[new])
            first, new, times = order[new][by], new[by], times[by]
            # one batch names a line's blocks once: its other occurrences there add nothing to the join
            named = np.zeros(len(h), bool)
            named[first[np.unique(h[first], return_index=True)[1]]] = True
            s, m = parity(w, heads), np.diff(np.append(heads, len(w)))
            line, key = blocks(w, heads)
            bits, many = wide_parity(w, heads, FINE)
            begin, many = np.cumsum(many) - many, np.where(named, many, 0)[first]
            span = lambda start, n: np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
            lists = lambda n, x: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(x))
            yield pa.RecordBatch.from_arrays([
                pa.array(b["_ord"].to_numpy()[of[first]]), pa.array(b["th"].to_numpy()[of[first]]), pa.array(signed(h[first])), *[pa.array(signed(np.ascontiguousarray(s[first, i]))) for i in range(2)], pa.array(m[first]),
                lists(times, number[order[span(new, times)]].astype(np.int32)), lists(np.bincount(line[named[line]], minlength=len(heads))[first], key[named[line]]),
                lists(many, signed(bits[span(begin[first], many)]))], names=["_ord", "th", "h", "s0", "s1", "m", "at", "keys", "wide"])


def _close(x: str, y: str):
    """Whether the lengths and parities of two lines allow an edit similarity of 0.8."""
    a, b = F.col(f"{x}m"), F.col(f"{y}m")
    bits = F.bit_count(F.col(f"{x}s0").bitwiseXOR(F.col(f"{y}s0"))) + F.bit_count(F.col(f"{x}s1").bitwiseXOR(F.col(f"{y}s1")))
    most = F.floor(F.greatest(a, b) / 5)
    flips = 2 * most - F.abs(a - b)  # a word more or less flips one bit where another word flips two
    return (F.abs(a - b) <= most) & (bits <= flips) & F.coalesce(_apart(F.col(f"{x}wide"), F.col(f"{y}wide")) <= flips, F.lit(True))


def _apart(a, b):
    """In how many bits two wide sketches differ, the larger one folded; null where a line has none."""
    xor = lambda p, q: p.bitwiseXOR(q)
    fold = lambda p, q: F.when(F.size(p) > F.size(q), F.zip_with(F.slice(p, 1, F.size(q)), F.slice(p, F.size(q) + 1, F.size(q)), xor)).otherwise(p)
    return F.aggregate(F.zip_with(fold(a, b), fold(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)


def _buckets(keys: DataFrame, lines: DataFrame, wide: DataFrame) -> DataFrame:
    """(bid, id, m, s0, s1, wide, n) of the blocks that several lines share; those of more than LARGE lines are split by length."""
    w = Window.partitionBy("bid")
    b = keys.withColumn("lo", F.min("id").over(w)).withColumn("hi", F.max("id").over(w)).filter("lo < hi").select("bid", "id")
    b = b.dropDuplicates(["bid", "id"]).withColumn("n", F.count("*").over(w)).withColumn("all", F.bit_xor(F.xxhash64("id")).over(w))
    # near lines share several blocks: those of the same lines are one bucket
    b = b.select(F.xxhash64("all", "n").alias("bid"), "id", "n").distinct()
    # lines at 0.8 lie in one length class or in neighbouring ones
    size = F.floor(F.log("m") / F.log(F.lit(1.26)))
    bids = F.when(F.col("n") > LARGE, F.array(F.xxhash64("bid", size), F.xxhash64("bid", size + 1))).otherwise(F.array("bid"))
    b = materialize(b, "shared")
    shared = bitmap(b.select("id").distinct(), "id")
    some, _ = split_by(lines, F.col("id"), shared)
    long, _ = split_by(wide, F.col("id"), shared)
    some = some.join(long.groupBy("id").agg(F.min("wide").alias("wide")), "id", "left")
    return materialize(b.join(some, "id").withColumn("bid", F.explode(bids)), "buckets")


def _links(b: DataFrame, confirm) -> DataFrame:
    """Confirmed links (a, b) whose components are those of all confirmed pairs inside any bucket.

    In buckets of more than LARGE lines all meet LEADERS of them first; then each pair of different components that may be a link is tested,
    a large bucket's lines dealt in parts of about PART lines, each of which meets all.
    """
    large = b.filter(F.col("n") > LARGE)
    lead = large.groupBy("bid").agg(*[F.min(F.struct(F.xxhash64("id", F.lit(i)).alias("x"), "id", "m", "s0", "s1", "wide")).alias(f"l{i}") for i in range(LEADERS)])
    lead = lead.select("bid", F.explode(F.array(*[f"l{i}" for i in range(LEADERS)])).alias("l")).select("bid", *[F.col(f"l.{c}").alias(f"x_{c}") for c in ("id", "m", "s0", "s1", "wide")])
    pairs = large.join(lead, "bid").filter((F.col("id") != F.col("x_id")) & _close("", "x_")).select(F.least("id", "x_id").alias("a"), F.greatest("id", "x_id").alias("b")).distinct()
    first = materialize(confirm(pairs), "links")
    c = materialize(components(first), "components")
    maybe, stay = split_by(b, F.col("id"), bitmap(c, "id"))
    y = maybe.join(c, "id", "left").withColumn("c", F.coalesce("component", "id"))
    y = y.select("bid", "id", "m", "s0", "s1", "wide", "n", "c").union(stay.select("bid", "id", "m", "s0", "s1", "wide", "n", F.col("id").alias("c")))
    parts = F.ceil(F.col("n") / PART).cast("int")
    other = lambda d: d.select(*[F.col(c).alias(f"x_{c}") for c in d.columns])
    unlike = (F.col("bid") == F.col("x_bid")) & (F.col("x_id") < F.col("id")) & (F.col("x_c") != F.col("c")) & _close("", "x_")
    # both sides of a small bucket's join are one shuffle
    small, huge = y.filter(F.col("n") <= PART).repartition("bid"), y.filter(F.col("n") > PART)
    dealt = huge.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    each = other(huge.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))))
    pairs = small.join(other(small), unlike).select("x_id", "id").union(dealt.join(each, unlike & (F.col("part") == F.col("x_part"))).select("x_id", "id"))
    return first.union(materialize(confirm(pairs.select(F.col("x_id").alias("a"), F.col("id").alias("b")).distinct()), "links"))


def _letters(words: np.ndarray, heads: np.ndarray) -> pa.Array:
    """Each line as a string of one character a word, so that a character edit distance is a word edit distance."""
    c = (words % np.uint64(0xD0000) + np.uint64(0x10000)).astype(np.uint32)  # four bytes each in UTF-8
    utf8 = np.stack([c >> k & (0x3F if k < 18 else 7) | (0x80 if k < 18 else 0xF0) for k in (18, 12, 6, 0)], axis=1).astype(np.uint8)
    return pa.StringArray.from_buffers(len(heads), pa.py_buffer((4 * np.append(heads, len(words))).astype(np.int32)), pa.py_buffer(utf8.tobytes()))


def _fetch(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(h, line) for wanted(h, _ord): the line with that hash in that document, a character a word. Lines meet in a shuffle, not their documents."""
    both = F.xxhash64("h", "_ord")
    by = materialize(wanted.select("h", "_ord", both.alias("k")), "wanted")
    some, _ = split_by(docs, F.col("_ord"), bitmap(by, "_ord"))

    def run(batches):
        enter("lines")
        for b in (y for x in batches for y in _few([x.to_pandas()])):
            of, _, w, heads = lines_of_all(list(b["text"]))
            if len(heads):
                yield pa.RecordBatch.from_arrays([pa.array(b["_ord"].to_numpy()[of]), pa.array(signed(runs(w, heads))), _letters(w, heads)], names=["_ord", "h", "line"])

    found, _ = split_by(some.filter("text is not null").mapInArrow(run, "_ord long, h long, line string"), both, bitmap(by, "k"))
    return found.join(by, ["h", "_ord"], "left_semi").groupBy("h", "_ord").agg(F.min("line").alias("line")).select("h", "line")


def _cut(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """docs without the lines that removed(_ord, th, gone) names by their numbers, and how many these are; only documents that it names may meet in a shuffle.

    n_chars, where there is one, follows the text; all other columns are carried in one struct, so no name can clash with a name used here."""
    rest = [c for c in docs.columns if c != "text"]  # the text is carried once
    row = docs.select(order_of(docs).alias("_ord"), F.xxhash64("text").alias("th"), "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_doc"))
    maybe, stay = split_by(row, F.col("_ord"), bitmap(removed, "_ord"))
    left = lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: x[i]), "\n")
    j = maybe.join(removed.hint("shuffle_hash"), ["_ord", "th"], "left")
    j = j.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.transform(F.array(F.split("text", "\n", -1)), left)[0]))
    new = {}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("gone").isNull(), F.col("_doc.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    name, old = free_name(docs, "n_removed"), [F.col("text" if c == "text" else f"_doc.`{c}`").alias(c) for c in docs.columns]
    j = j.select(*[new[c].alias(c) if c in new else o for c, o in zip(docs.columns, old)], F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(name))
    return stay.select(*old, F.lit(0).cast("long").alias(name)).union(j)


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated and nearly repeated lines removed from text, and how many: n_removed."""
    ship(docs.sparkSession)
    conf = docs.sparkSession.conf
    before = conf.get(SMALL_MAP, "0b")
    conf.set(SMALL_MAP, "16m")  # sides of small partitions meet unsorted
    try:
        return _cut(docs, _removed(docs))
    finally:
        conf.set(SMALL_MAP, before)


def _removed(docs: DataFrame) -> DataFrame:
    """(_ord, th, gone): the numbers of the lines that go, for each text, named by its document and its hash, that loses any."""
    d = with_order(docs).withColumn("th", F.xxhash64("text"))
    occ = materialize(d.mapInArrow(_occurrences, OCCURRENCES), "lines")
    lines = materialize(occ.groupBy("h").agg(F.min("_ord").alias("lo"), F.max("_ord").alias("hi"), F.min("m").alias("m"), F.min("s0").alias("s0"), F.min("s1").alias("s1")), "distinct")
    keys = occ.filter(F.size("keys") > 0).select(F.explode("keys").alias("bid"), F.col("h").alias("id"))

    def confirm(pairs: DataFrame) -> DataFrame:
        p = materialize(pairs, "close")
        ids = materialize(p.select(F.col("a").alias("h")).union(p.select("b")).distinct(), "wanted")
        some, _ = split_by(lines.select("h", F.col("lo").alias("_ord")), F.col("h"), bitmap(ids, "h"))
        text = materialize(_fetch(some.join(ids, "h"), d), "texts")
        x = p.join(text.select(F.col("h").alias("a"), F.col("line").alias("la")), "a").join(text.select(F.col("h").alias("b"), F.col("line").alias("lb")), "b")
        return x.filter("levenshtein(la, lb, cast(floor(greatest(length(la), length(lb)) / 5) as int)) >= 0").select("a", "b")

    comp = materialize(components(_links(_buckets(keys, lines.select(F.col("h").alias("id"), "m", "s0", "s1"), occ.filter(F.size("wide") > 0).select(F.col("h").alias("id"), "wide")), confirm)), "components")
    near = lines.join(comp, F.col("h") == comp.id).select("h", "lo", "component")
    keep = near.groupBy("component").agg(F.min(F.struct("lo", "h")).alias("k"))
    near = near.join(keep, "component").select("h", F.col("k.lo").alias("lo"), (F.col("h") == F.col("k.h")).alias("keeper"))
    rule = lines.filter("lo < hi").join(comp, F.col("h") == comp.id, "left_anti").select("h", "lo", F.lit(True).alias("keeper")).union(near)
    rule = materialize(rule, "rule")
    some, _ = split_by(occ.select("_ord", "th", "h", "at"), F.col("h"), bitmap(rule, "h"))
    later = some.join(rule, "h").filter("_ord > lo or not keeper").select("_ord", "th", "at")
    later = later.union(occ.filter("size(at) > 1").select("_ord", "th", F.expr("slice(at, 2, size(at) - 1)")))
    return materialize(later.groupBy("_ord", "th").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("gone")), "removed")
