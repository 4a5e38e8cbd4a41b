"""Host-level quality rules: failures of each rule by host, rates shrunk by an empirical beta prior, verdicts joined back to documents.

Main path in column expressions only. A document's measures come from its own text in one pass and are written once, thin and without the
text; hosts are sums of those rows (combined before the shuffle, so a host with a third of all rows is no large group), and the two numbers of
each rule's prior come from one row of sums over all hosts. Verdicts go back by join: hosts with more than a thousandth of all rows are fewer
than a thousand and are broadcast; all others meet their rows in a shuffle, where none of them is large.

Cases: a null or empty text has no words and fails the base rule; a null host is no host, so that only the document's own rules judge it (an
empty name is a host like any other); repeated rows of one doc_id are each measured, counted and returned; ties at a limit pass (a limit must be
exceeded); texts are read whole, in memory of some hundred bytes a word; an empty table gives no rows; extra columns are ignored, whatever their
names. Words are runs without the six ASCII white space characters, so other spaces belong to words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bitmap, join_by_size, materialize, ship, split_by

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
#: a document fails a rule where it holds; measures are integers, so shares are compared without division
RULES: dict[str, str] = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * word_chars",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars > 12 * n_words or word_chars < 2 * n_words",
}
BASE = ("short", "repetitive")
MOST = 0.5  # a host fails a rule whose shrunk rate is above this
STRENGTHS = (1e-3, 1e4)  # the prior weighs at least and at most so many documents


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs and MEASURES of each text.

    n_repeat_words: words inside a window of three words that the text holds at least twice. The windows are sorted with their places, so that
    equal ones are neighbours; the places found cover at most three words each, less where the next is nearer.
    """
    own = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)]
    k = [f"_k{i}" for i in range(len(keep))]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(*own, text.alias("t"))
    d = d.select(*k, F.array_remove(F.split("t", WHITE), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"), F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    n, m = F.size("w"), F.size("w") - 2
    windows = F.sort_array(F.arrays_zip(F.slice("w", 1, m).alias("a"), F.slice("w", 2, m).alias("b"), F.slice("w", 3, m).alias("c"), F.sequence(F.lit(0), n - 3).alias("i")))
    d = d.select(*k, "n_symbols", n.cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), F.size("l").cast("long").alias("n_lines"),
                 (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), F.when(n >= 4, windows).alias("z"))
    rest = ["n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines"]
    near = F.arrays_zip(F.slice("z", 1, F.size("z") - 1).alias("x"), F.slice("z", 2, F.size("z") - 1).alias("y"))
    same = F.filter(near, lambda p: (p.x.a == p.y.a) & (p.x.b == p.y.b) & (p.x.c == p.y.c))
    d = d.select(*k, *rest, same.alias("s"))
    d = d.select(*k, *rest, F.sort_array(F.array_union(F.transform("s", lambda p: p.x.i), F.transform("s", lambda p: p.y.i))).alias("p"))
    gaps = F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("x"), F.slice("p", 2, F.size("p") - 1).alias("y"))
    covered = F.when(F.size("p") > 0, F.lit(3) + F.aggregate(gaps, F.lit(0), lambda acc, g: acc + F.least(F.lit(3), g.y - g.x))).otherwise(0)
    return d.select(*[F.col(a).alias(b) for a, b in zip(k, keep)], *rest, covered.cast("long").alias("n_repeat_words"))


@dataclass
class Prior:
    """Beta(a, b) of a rule's failure rate among hosts."""

    a: float
    b: float


def priors(hosts: DataFrame, rules: list[str]) -> dict[str, Prior]:
    """Each rule's beta prior by the method of moments, from hosts(n, k_<rule>): mean failures over all documents, and how much more the hosts'
    rates differ than chance makes them. Where hosts tell nothing of it (fewer than two, or no document or all of them fail) it is Beta(1/2, 1/2)."""
    sums = [F.sum(F.col(f"k_{r}")).alias(f"s_{r}") for r in rules] + [F.sum(F.col(f"k_{r}") * F.col(f"k_{r}") / F.col("n")).alias(f"q_{r}") for r in rules]
    x = hosts.agg(F.count("*").alias("h"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), *sums).first()
    out = {}
    for r in rules:
        out[r] = Prior(0.5, 0.5)
        if not x.h or x.h < 2 or not 0 < x[f"s_{r}"] < x.n:
            continue
        p = x[f"s_{r}"] / x.n
        spread = x[f"q_{r}"] - x.n * p * p
        chance = p * (1 - p)
        within = (spread - chance * (x.h - 1)) / (chance * (x.n - x.nn / x.n - (x.h - 1))) if x.n - x.nn / x.n > x.h - 1 else 0.0
        weight = min(max((1 - within) / within, STRENGTHS[0]), STRENGTHS[1]) if within > 0 else STRENGTHS[1]
        out[r] = Prior(p * weight, (1 - p) * weight)
    return out


def host_counts(measured: DataFrame, host: str, rules: dict[str, str]) -> DataFrame:
    """(host, n, k_<rule>): documents of each host and how many fail each rule."""
    return measured.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *[F.count_if(F.expr(e)).alias(f"k_{r}") for r, e in rules.items()])


def verdicts(hosts: DataFrame, prior: dict[str, Prior], most: float = MOST) -> DataFrame:
    """(host, n, host_failures): names of the rules whose shrunk rate is above `most`, in the rules' order, joined by commas."""
    bad = [F.when((F.col(f"k_{r}") + F.lit(p.a)) / (F.col("n") + F.lit(p.a + p.b)) > most, r) for r, p in prior.items()]
    return hosts.select("host", "n", F.array_join(F.array_compact(F.array(*bad)), ",").alias("host_failures"))


def base_failed(rules: dict[str, str] = RULES, base: tuple[str, ...] = BASE) -> Column:
    return F.expr(" or ".join(f"({rules[r]})" for r in base))


def judge(docs: DataFrame, key: str = "doc_id", host: str = "source", rules: dict[str, str] = RULES, base: tuple[str, ...] = BASE, most: float = MOST) -> DataFrame:
    """(key, MEASURES, base_failed, host_failures, kept) of each row of docs. host_failures is null without a host; a document is kept where it
    passes the base rules and its host fails none."""
    ship(docs.sparkSession)
    own = measure(docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{host}`").alias("_host"), "text"), ["_id", "_host"])
    measured = materialize(own, "measures")
    hosts = materialize(host_counts(measured, "_host", rules), "hosts")
    told = verdicts(hosts, priors(hosts, list(rules)), most)
    j = join_by_size(measured, "_host", told.withColumnRenamed("host", "_host"), "n")
    failed = base_failed(rules, base)
    return j.select(F.col("_id").alias(key), *MEASURES, failed.alias("base_failed"), "host_failures", (~failed & (F.coalesce("host_failures", F.lit("")) == "")).alias("kept"))


def keep(docs: DataFrame, host: str = "source", rules: dict[str, str] = RULES, base: tuple[str, ...] = BASE, most: float = MOST) -> DataFrame:
    """The rows of docs, with all their columns, that judge() keeps. Only rows of hosts that may have failed meet the verdicts in a shuffle."""
    some = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{host}`").alias("_host"), "text")
    measured = measure(some, ["_doc", "_host"]).filter(~base_failed(rules, base))
    hosts = materialize(host_counts(measure(some, ["_host"]), "_host", rules), "hosts")
    bad = materialize(verdicts(hosts, priors(hosts, list(rules)), most).filter("host_failures <> ''").select(F.col("host").alias("_host")), "failed-hosts")
    maybe, stay = split_by(measured, F.col("_host"), bitmap(bad, "_host"))
    return maybe.join(bad, "_host", "left_anti").select("_doc").union(stay.select("_doc")).select("_doc.*")
