"""Predictions against independent reviewers: truth, slice metrics, gates, bounds, risk-coverage curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curalis.functions.columns import ratio, wilson_lower

# fixed values: ranks of the confidence levels
RANKS = {"DETERMINISTIC": 5, "STRONG": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
UNRANKED = 0


def truth(labels: Column) -> Column:
    """Of an array of labels: null for fewer than two, the label where all agree, else DISAGREED."""
    return F.when(F.size(labels) < 2, None).when(F.size(F.array_distinct(labels)) == 1, labels[0]).otherwise("DISAGREED")


def slice_metrics(cases: DataFrame, keys: list[str]) -> DataFrame:
    """cases(prediction, labels, keys...). Coverage over cases with consensus; abstention and unresolved over all cases."""
    c = cases.withColumn("t", truth(F.col("labels")))
    asserted, sure = F.col("prediction") == "ASSERTED", F.col("t").isin("SUPPORTED", "UNSUPPORTED")
    n = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    g = c.groupBy(*keys).agg(
        F.count("*").alias("candidates"), n(sure).alias("consensus"), n(F.col("t") == "DISAGREED").alias("disagreement"), F.count_if(F.col("t").isNull()).alias("unreviewed"),
        n(asserted & (F.col("t") == "SUPPORTED")).alias("tp"), n(asserted & (F.col("t") == "UNSUPPORTED")).alias("fp"), n(~asserted & (F.col("t") == "SUPPORTED")).alias("fn"),
        n(F.col("prediction") == "ABSTAINED").alias("abstained"), n(F.col("prediction") == "UNRESOLVED").alias("unresolved_n"))
    r = lambda a, b: ratio(a, b, 12)
    return g.select(
        *keys, "candidates", "consensus", "disagreement", "unreviewed", "tp", "fp", "fn", r(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), r(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        r(F.col("consensus"), F.col("candidates")).alias("coverage"), r(F.col("abstained"), F.col("candidates")).alias("abstention"), r(F.col("unresolved_n"), F.col("candidates")).alias("unresolved"))


# fixed values: the four semantic gates (claim type, confidence asked for, metric, threshold, whether by its lower bound, least cases, least
# unsupported ones), least repositories and families of each, and the operation classes with their least cases
GATES = [
    ("inventory-recall", "inventory_artifact", None, "recall", 0.999, False, 1000, 100),
    ("exact-byte-duplicate-precision", "exact_byte_duplicate", None, "precision", 1.0, False, 1000, 100),
    ("capability-family-high-precision", "capability_family", "HIGH", "precision", 0.95, True, 100, 50),
    ("change-episode-strong-precision", "change_episode", "STRONG", "precision", 0.9, True, 100, 50),
]
LEAST_REPOSITORIES, LEAST_FAMILIES = 5, 3
OPERATIONS, LEAST_MUTATIONS = ["ARCHIVE", "QUARANTINE"], 3000
GATE = "gate string, claim_type string, wanted string, metric string, threshold double, bounded boolean, least_cases long, least_unsupported long"


def normalize_cases(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Gold cases of both versions in one table with their truth; the first version knows no repository."""
    known = "case_id claim_type confidence language prediction repository_type labels".split()
    none = F.lit(None).cast("string")
    a = v1.select(*known, none.alias("repository_id"), none.alias("repository_family"), F.lit("v1").alias("version"))
    b = v2.select(*known, "repository_id", "repository_family", F.lit("v2").alias("version"))
    return a.unionByName(b).withColumn("truth", truth(F.col("labels")))


def unique_cases(cases: DataFrame) -> DataFrame:
    """cases, whose use fails if two have one case_id."""
    twice = cases.groupBy("case_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"))
    return cases.filter(F.when(twice.scalar() > 1, F.raise_error(F.lit("EVALUATION_CASE_DUPLICATE")).cast("boolean")).otherwise(True))


def metric_gates(cases: DataFrame, gates: list[tuple] = GATES) -> DataFrame:
    """(gate, status, reason, value): of normalized cases, one row a gate, in one pass over the cases.

    Conditions in their order: any reviewed case, repositories and families, number of cases, number of unsupported ones, the metric. Diversity, numbers
    and the metric count cases of the second version only; unsupported ones count over the gate's claim type whatever the confidence.
    """
    g = cases.sparkSession.createDataFrame(gates, GATE)
    c = cases.join(F.broadcast(g), "claim_type")
    chosen = F.col("wanted").isNull() | F.coalesce(F.col("confidence") == F.col("wanted"), F.lit(False))
    sure = F.coalesce(F.col("truth").isin("SUPPORTED", "UNSUPPORTED"), F.lit(False))
    new = sure & (F.col("version") == "v2")
    own, yes, good = chosen & new, F.col("prediction") == "ASSERTED", F.col("truth") == "SUPPORTED"
    a = c.groupBy("gate").agg(
        F.count_if(chosen & sure).alias("reviewed"), F.count_if(own).alias("cases"), F.count_distinct(F.when(own, F.col("repository_id"))).alias("repositories"), F.count_distinct(F.when(own, F.col("repository_family"))).alias("families"),
        F.count_if(new & ~good).alias("unsupported"), F.count_if(own & yes & good).alias("tp"), F.count_if(own & yes).alias("asserted"), F.count_if(own & good).alias("supported"))
    j = g.join(a, "gate", "left")
    total = F.when(F.col("metric") == "precision", F.col("asserted")).otherwise(F.col("supported"))
    value = F.when(F.col("bounded"), wilson_lower(F.col("tp"), total)).otherwise(ratio(F.col("tp"), total, 12))
    reason = (
        F.when(F.coalesce("reviewed", F.lit(0)) == 0, "NO_REVIEWED_CASES").when((F.col("repositories") < LEAST_REPOSITORIES) | (F.col("families") < LEAST_FAMILIES), "INSUFFICIENT_REPOSITORY_DIVERSITY")
        .when(F.col("cases") < F.col("least_cases"), "INSUFFICIENT_REVIEWED_CASES").when(F.col("unsupported") < F.col("least_unsupported"), "INSUFFICIENT_LABEL_DISTRIBUTION"))
    passed = reason.isNull() & F.coalesce(value >= F.col("threshold"), F.lit(False))
    return j.select("gate", F.when(passed, "PASSED").otherwise("BLOCKED").alias("status"), reason.alias("reason"), F.when(reason.isNull(), value).alias("value"))


def normalize_mutations(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Mutation cases of both versions: v1(candidate_id, operation_class, invariants_passed, unsafe_false_positive), v2(candidate_id, operation_class, outcome, invariants, repository_id, repository_family)."""
    none = F.lit(None).cast("string")
    a = v1.select("candidate_id", "operation_class", "invariants_passed", "unsafe_false_positive", none.alias("repository_id"), none.alias("repository_family"), F.lit("v1").alias("version"))
    b = v2.select("candidate_id", "operation_class", F.forall("invariants", lambda x: x == "PASSED").alias("invariants_passed"), (F.col("outcome") == "UNSAFE_FALSE_POSITIVE").alias("unsafe_false_positive"), "repository_id", "repository_family", F.lit("v2").alias("version"))
    return a.unionByName(b)


def mutation_gates(cases: DataFrame, operations: list[str] = OPERATIONS, least: int = LEAST_MUTATIONS) -> DataFrame:
    """(gate, status, reason, cases) of each operation class; two cases of a class with one candidate_id fail the query."""
    new = F.col("version") == "v2"
    g = cases.groupBy("operation_class").agg(
        F.count("*").alias("n"), F.count_distinct("candidate_id").alias("d"), F.count_if(new).alias("cases"), F.count_distinct(F.when(new, F.col("repository_id"))).alias("r"), F.count_distinct(F.when(new, F.col("repository_family"))).alias("f"),
        F.count_if(new & F.col("unsafe_false_positive")).alias("unsafe"), F.count_if(new & ~F.col("invariants_passed")).alias("broken"))
    ops = cases.sparkSession.createDataFrame([(o,) for o in operations], "operation_class string")
    reason = F.when(F.col("n").isNull(), "NO_RISK_CASES").when(F.col("d") < F.col("n"), F.raise_error(F.lit("EVALUATION_RISK_CASE_DUPLICATE")).cast("string")).when((F.col("r") < LEAST_REPOSITORIES) | (F.col("f") < LEAST_FAMILIES), "INSUFFICIENT_REPOSITORY_DIVERSITY")
    j = ops.join(g, "operation_class", "left").withColumn("reason", reason)
    ok = F.col("reason").isNull() & (F.col("cases") >= least) & (F.col("unsafe") == 0) & (F.col("broken") == 0)
    return j.select(F.concat(F.lit("mutation-risk-corpus:"), "operation_class").alias("gate"), F.when(ok, "PASSED").otherwise("BLOCKED").alias("status"), "reason", F.coalesce("cases", F.lit(0)).alias("cases"))


def verdict(gates: DataFrame) -> DataFrame:
    """ADMISSION_READY where there are gates and all have passed, else SHADOW_ONLY."""
    n = gates.agg(F.count("*").alias("gates"), F.count_if(F.col("status") == "PASSED").alias("passed"))
    return n.select("gates", "passed", F.when((F.col("gates") > 0) & (F.col("gates") == F.col("passed")), "ADMISSION_READY").otherwise("SHADOW_ONLY").alias("verdict"))


def risk_coverage(cases: DataFrame, keys: list[str]) -> DataFrame:
    """For each confidence level present among cases with consensus: how many asserted ones rank at least as high, coverage and selective risk.

    Levels are counted first; the cumulative window runs over at most one row a level and slice.
    """
    c = cases.withColumn("t", truth(F.col("labels"))).filter(F.col("t").isin("SUPPORTED", "UNSUPPORTED"))
    rank = F.lit(UNRANKED)
    for k, v in RANKS.items():
        rank = F.when(F.col("confidence") == k, v).otherwise(rank)
    asserted = F.col("prediction") == "ASSERTED"
    g = c.withColumn("rank", rank).groupBy(*keys, "confidence", "rank").agg(F.count("*").alias("n"), F.count_if(asserted).alias("a"), F.count_if(asserted & (F.col("t") == "UNSUPPORTED")).alias("bad"))
    up, all_ = Window.partitionBy(*keys).orderBy(F.desc("rank")).rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    g = g.withColumn("accepted", F.sum("a").over(up)).withColumn("wrong", F.sum("bad").over(up)).withColumn("total", F.sum("n").over(all_)).filter(F.col("rank") > UNRANKED)
    return g.select(*keys, F.col("confidence").alias("threshold"), "accepted", ratio(F.col("accepted"), F.col("total"), 12).alias("coverage"), ratio(F.col("wrong"), F.col("accepted"), 12).alias("selective_risk"))


def identity_conflicts(cases: DataFrame) -> DataFrame:
    """Repositories that appear with more than one (family, snapshot)."""
    return cases.groupBy("repository_id").agg(F.count_distinct(F.struct("repository_family", "repository_snapshot_hash")).alias("identities")).filter("identities > 1")
