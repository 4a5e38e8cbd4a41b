"""Payloads of raw records built out of orders and their lines, parsed, with SQL twins that tell from the tables what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from curalis.operators import rawrecords as R
from curalis.plans.bindings import query


def _hash(n):
    return F.lpad(F.lower(F.hex(n.cast("long"))), 40, "0")


_HASH = "lpad(printf('%x', CAST({} AS BIGINT)), 40, '0')"


def _lines(t):
    """(k, c, x): each order with its lines in order."""
    x = t("lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").cast("int").alias("n"), F.col("l_partkey").cast("long").alias("p"), F.col("l_suppkey").cast("long").alias("s")).alias("x"))
    g = x.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set("x")).alias("x"))
    return g.join(t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")), "k")


# fixed shape of the twins: the distinct lines of each order
_L = "WITH l AS (SELECT DISTINCT l_orderkey AS k, CAST(l_linenumber AS INTEGER) AS n, CAST(l_partkey AS BIGINT) AS p, CAST(l_suppkey AS BIGINT) AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey) "


@query("s103_raw_changes", _L + f""", o AS (SELECT o_custkey AS c, l.k, l.p FROM l JOIN orders ON o_orderkey = l.k),
m AS (SELECT c, k, string_agg(DISTINCT CASE WHEN k % 5 = 0 THEN {_HASH.format('k + 1')} ELSE 'p/' || p END, ',' ORDER BY CASE WHEN k % 5 = 0 THEN {_HASH.format('k + 1')} ELSE 'p/' || p END) AS paths FROM o GROUP BY 1, 2),
g AS (SELECT c, count(*) AS n, string_agg({_HASH.format('k')} || '=' || paths, ';' ORDER BY k) AS changes FROM m GROUP BY 1)
SELECT c AS o_custkey, CASE WHEN c % 11 = 0 OR c % 13 = 0 OR c % 7 = 0 AND n > 1 THEN 'GIT_CHANGE_HISTORY_MALFORMED' END AS limitation, CASE WHEN c % 11 = 0 OR c % 13 = 0 OR c % 7 = 0 AND n > 1 THEN '' ELSE changes END AS changes FROM g""")
def _(t):
    meta = lambda mode, x: F.concat(F.lit(f":100644 {mode} "), _hash(x.p), F.lit(" "), _hash(x.s), F.lit(" M"))
    path = lambda o, x: F.when(o.k % 5 == 0, _hash(o.k + 1)).otherwise(F.concat(F.lit("p/"), x.p.cast("string")))  # noqa: E731  (a path may read like a commit)
    g = _lines(t).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("o"))
    tokens = F.flatten(F.transform("o", lambda o: F.concat(F.array(_hash(o.k)), F.flatten(F.transform(o.x, lambda x: F.array(F.when(F.col("c") % 13 == 0, meta("10064x", x)).otherwise(meta("100755", x)), path(o, x)))))))
    tokens = F.when(F.col("c") % 11 == 0, F.slice(tokens, 1, F.size(tokens) - 1)).otherwise(tokens)
    commits = F.transform("o", lambda o: _hash(o.k))
    asked = F.when(F.col("c") % 7 == 0, F.reverse(commits)).otherwise(commits)
    g = g.select("c", F.concat(F.array_join(tokens, "\0"), F.lit("\0")).alias("payload"), asked.alias("asked"))
    r = g.select("c", R.changed_paths(F.col("payload"), F.col("asked")).alias("r"))
    return r.select(F.col("c").alias("o_custkey"), "r.limitation", F.array_join(F.transform("r.changes", lambda x: F.concat(x.commit, F.lit("="), F.array_join(x.paths, ","))), ";").alias("changes"))


@query("s103_tree_blobs", _L + f""", b AS (SELECT k, string_agg(DISTINCT 'd ' || n || '=' || {_HASH.format('p')} || ':' || s, ',' ORDER BY 'd ' || n || '=' || {_HASH.format('p')} || ':' || s) FILTER ((n + k) % 4 < 2) AS blobs, max(n) AS last, bool_or((n + k) % 4 = 0) AS has FROM l GROUP BY 1)
SELECT k AS o_orderkey, CASE WHEN k % 9 = 0 OR k % 10 = 0 OR k % 21 = 1 AND has THEN 'GIT_SECRET_HISTORY_TREE_MALFORMED' END AS limitation, CASE WHEN k % 9 = 0 OR k % 10 = 0 OR k % 21 = 1 AND has THEN '' ELSE coalesce(blobs, '') END AS blobs FROM b""")
def _(t):
    k = F.col("k")
    mode = lambda x: F.element_at(F.array(*map(F.lit, ["100644", "100755", "120000", "160000"])), ((x.n + k) % 4 + 1).cast("int"))
    kind = lambda x: F.when((k % 21 == 1) & ((x.n + k) % 4 == 0), "tree").when((x.n + k) % 4 == 3, "commit").otherwise("blob")
    entry = lambda x: F.concat(mode(x), F.lit(" "), kind(x), F.lit(" "), _hash(x.p), F.lit(" "), F.when((x.n + k) % 4 == 3, "-").otherwise(F.lpad(x.s.cast("string"), 7, " ")), F.lit("\td "), x.n.cast("string"))
    entries = F.concat(F.transform("x", entry), F.when(k % 9 == 0, F.array(F.lit("100644 blob\td 1"))).otherwise(F.array().cast("array<string>")))
    asked = F.when(k % 10 == 0, F.array(F.lit("elsewhere"))).otherwise(F.transform("x", lambda x: F.concat(F.lit("d "), x.n.cast("string"))))
    g = _lines(t).select("k", F.concat(F.array_join(entries, "\0"), F.lit("\0")).alias("payload"), asked.alias("asked"))
    r = g.select("k", R.tree_blobs(F.col("payload"), F.col("asked")).alias("r"))
    return r.select(F.col("k").alias("o_orderkey"), "r.limitation", F.array_join(F.transform("r.blobs", lambda b: F.concat(b.path, F.lit("="), b.blob, F.lit(":"), b["size"].cast("string"))), ",").alias("blobs"))


@query("s103_status_codes", _L + """, e AS (SELECT k, n, p, s, 's' || s % 3 AS path, CASE (n + p) % 4 WHEN 0 THEN '??' WHEN 1 THEN '!!' WHEN 2 THEN ' M' ELSE 'A ' END AS code FROM l WHERE (k + n) % 6 > 0),
c AS (SELECT k, path, arg_max(code, (n, p, s)) AS code FROM e GROUP BY 1, 2), m AS (SELECT k, bool_or((k + n) % 6 = 0) AS bad FROM l GROUP BY 1)
SELECT m.k AS o_orderkey, any_value(CASE WHEN bad THEN 'GIT_STATUS_MALFORMED' END) AS limitation, coalesce(string_agg(path || '=' || code, ',' ORDER BY path), '') AS codes FROM m LEFT JOIN c USING (k) GROUP BY m.k""")
def _(t):
    k = F.col("k")
    code = lambda x: F.element_at(F.array(*map(F.lit, ["??", "!!", " M", "A "])), ((x.n + x.p) % 4 + 1).cast("int"))
    entry = lambda x: F.when((k + x.n) % 6 == 0, F.when(k % 2 == 0, "M x").otherwise("Mxpath")).otherwise(F.concat(code(x), F.lit(" s"), (x.s % 3).cast("string")))
    g = _lines(t).select("k", F.concat(F.array_join(F.transform("x", entry), "\0"), F.lit("\0")).alias("payload"))
    r = g.select("k", R.status_codes(F.col("payload")).alias("r"))
    return r.select(F.col("k").alias("o_orderkey"), "r.limitation", F.array_join(F.transform("r.codes", lambda c: F.concat(c.path, F.lit("="), c.code)), ",").alias("codes"))


@query("s103_hygiene_status", _L + """, e AS (SELECT k, n, (n + k) % 6 AS o, CASE WHEN k % 14 = 0 THEN 'f' ELSE 'f' || n END AS path, p % 2 = 0 AS same FROM l),
b AS (SELECT k, count(*) FILTER (o < 3) > count(DISTINCT path) FILTER (o < 3) OR k % 15 = 0 OR k % 16 = 0 OR bool_or(o = 3) AND k % 8 = 3 AS bad, string_agg(path, ',' ORDER BY path) FILTER (o = 0) AS added,
 string_agg(path || '=' || CASE WHEN same THEN 'CONTENT_ID_EQUAL' ELSE 'MODE_CHANGE_CANDIDATE' END, ',' ORDER BY path) FILTER (o = 1) AS findings, count(*) FILTER (o = 1) AS n, bool_or(o = 1 AND NOT same) AS differs, bool_or(o > 2) AS others FROM e GROUP BY 1)
SELECT k AS o_orderkey, CASE WHEN bad THEN 'GIT_REPOSITORY_HYGIENE_STATUS_MALFORMED' ELSE concat_ws(',', CASE WHEN differs THEN 'GIT_DESTROYED_SYMLINK_CONTENT_NOT_COMPARED' END, CASE WHEN others THEN 'GIT_REPOSITORY_HYGIENE_NONORDINARY_RECORD_NOT_EVALUATED' END) END AS limitations,
 CASE WHEN bad THEN '' ELSE coalesce(added, '') END AS added, CASE WHEN bad THEN '' ELSE coalesce(findings, '') END AS findings, CAST(CASE WHEN bad THEN 0 ELSE n END AS INTEGER) AS found FROM b""")
def _(t):
    k, two = F.col("k"), lambda x: F.concat(_hash(x.p), F.lit(" "), _hash(F.when(x.p % 2 == 0, x.p).otherwise(x.p + 1)))
    path = lambda x: F.when(k % 14 == 0, "f").otherwise(F.concat(F.lit("f"), x.n.cast("string")))
    o = lambda x: (x.n + k) % 6

    def entry(x):
        one = F.concat(F.lit("1 "), F.when(o(x) == 0, "A. N... 000000 100644 100644 ").when(o(x) == 1, "T. N... 120000 100644 100644 ").otherwise("M. N... 120000 120000 100644 "), two(x), F.lit(" "), path(x))
        name = F.concat(F.lit("2 R. N... 100644 100644 100644 "), two(x), F.lit(" "), F.when(k % 8 == 3, "X9").otherwise("R100"), F.lit(" new"))
        merge = F.concat(F.lit("u UU N... 100644 100644 100644 100644 "), two(x), F.lit(" "), _hash(x.p), F.lit(" both"))
        return F.when(o(x) < 3, F.array(one)).when(o(x) == 3, F.array(name, F.lit("1 old name"))).when(o(x) == 4, F.array(merge)).otherwise(F.array(F.lit("? new file")))

    entries = F.flatten(F.transform("x", entry))
    entries = F.when(k % 15 == 0, F.concat(entries, F.array(F.lit("9 what")))).otherwise(entries)
    g = _lines(t).select("k", F.concat(F.array_join(entries, "\0"), F.when(k % 16 == 0, "").otherwise("\0")).alias("payload"))
    r = g.select("k", R.hygiene_status(F.col("payload")).alias("r"))
    return r.select(F.col("k").alias("o_orderkey"), F.array_join("r.limitations", ",").alias("limitations"), F.array_join("r.added", ",").alias("added"), F.array_join(F.transform("r.findings", lambda f: F.concat(f.path, F.lit("="), f.match_status)), ",").alias("findings"), F.col("r.count").alias("found"))
