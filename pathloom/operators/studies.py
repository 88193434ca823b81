"""Tables for studies over many runs of the engine."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators import evaluation


def parameter_study(runs: DataFrame, keys: list[str], metric: str) -> DataFrame:
    return runs.groupBy(*keys).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count("*").alias("n_runs"))


def near_best(study: DataFrame, group: str, tolerance: float = 0.01) -> DataFrame:
    """Settings of each group whose mean is within tolerance of the group's best."""
    return study.withColumn("best", F.max("mean").over(Window.partitionBy(group))).filter(F.round(F.col("best") - F.col("mean"), 12) <= tolerance)


def pivot_mean_std(runs: DataFrame, row: str, column: str, values: list, metric: str) -> DataFrame:
    return runs.groupBy(row).pivot(column, values).agg(F.avg(metric).alias("mean"), (2 * F.stddev_pop(metric)).alias("two_sigma"))


def ablation(runs: DataFrame, name: str, pattern: str, metrics: list[str]) -> DataFrame:
    """Means and deviations per removed metaedge, whose name a pattern finds in the run's name; none is the baseline."""
    removed = F.regexp_extract(name, pattern, 1)
    keyed = runs.withColumn("metaedge", F.when(removed == "", "Baseline").otherwise(removed))
    return keyed.groupBy("metaedge").agg(*(f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))))


def ranks(values: DataFrame, value: str, *by: str) -> DataFrame:
    """by, value, t (rows of that value) and rank (the mean of their places): a row a distinct value; n (all rows)."""
    ties = evaluation.ranged(values.groupBy(*by, value).agg(F.count("*").cast("double").alias("t")), value, *by)
    below = evaluation.summed_below(ties, value, {"before": F.col("t")}, *by)
    return below.select(*by, value, "t", (F.col("before") + (F.col("t") + 1) / 2).alias("rank"), F.col("all_before").alias("n"))


def _tested(sums: DataFrame, keys: list[str], corrected: bool) -> DataFrame:
    """The rank-sum test from n1, n (counts), r1 (ranks of the members), ss (squared ranks of all) and tie."""
    n1, n = F.col("n1").cast("double"), F.col("n").cast("double")
    n2, u = n - n1, F.col("r1") - n1 * (n1 + 1) / 2
    variance = n1 * n2 / 12 * ((n + 1) - (F.try_divide(F.col("tie"), n * (n - 1)) if corrected else F.lit(0.0)))
    z = F.try_divide(u - n1 * n2 / 2 - (0.5 if corrected else 0.0), F.sqrt(variance))
    spread = F.sqrt(n1 * n2 * (F.col("ss") / n - ((n + 1) / 2) * ((n + 1) / 2)))
    correlation = F.try_divide(F.col("r1") - n1 * (n + 1) / 2, spread)
    out = sums.select(*keys, F.col("n1").cast("long").alias("n1"), n2.cast("long").alias("n2"), u.alias("u"), (F.try_divide(2 * u, n1 * n2) - 1).alias("effect"), correlation.alias("correlation"), normal_tail(z).alias("p_value"))
    tests = out.agg(F.count("*").alias("_k"))
    return out.crossJoin(F.broadcast(tests)).withColumn("p_adjusted", F.least(F.col("p_value") * F.col("_k"), F.lit(1.0))).drop("_k")  # one row


def rank_sum(values: DataFrame, group: str, value: str, member: str, corrected: bool = False) -> DataFrame:
    """Per group: one-sided rank-sum test that member rows have larger values than the rest.

    group, n1, n2, u, effect (rank-biserial), correlation (of ranks and membership), p_value (normal approximation; corrected:
    for ties and continuity), p_adjusted (Bonferroni).
    """
    members = values.groupBy(group, value).agg(F.count_if(F.col(member)).cast("double").alias("m"))
    both = ranks(values, value, group).join(members, [group, value])
    square = F.col("rank") * F.col("rank") * F.col("t")
    sums = both.groupBy(group).agg(F.sum("m").alias("n1"), F.max("n").alias("n"), F.sum(F.col("rank") * F.col("m")).alias("r1"), F.sum(square).alias("ss"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tie"))
    return _tested(sums, [group], corrected)


def influence(rules: DataFrame, confidences: DataFrame, corrected: bool = False) -> DataFrame:
    """Per metapath: whether the rules (rule_id, items) that hold it have a higher confidence (rule_id, confidence) than the others.

    mp_id and the columns of rank_sum.  All metapaths are tested on the same rules, so these are ranked once, and a metapath
    adds up the ranks of its own: nothing pairs metapaths with rules that lack them.
    """
    known = rules.select("rule_id", "items").join(confidences.select("rule_id", "confidence"), "rule_id")
    ranked = ranks(known, "confidence")
    square, tie = F.col("rank") * F.col("rank") * F.col("t"), F.col("t") * F.col("t") * F.col("t") - F.col("t")
    all_ = ranked.agg(F.max("n").alias("n"), F.sum(square).alias("ss"), F.sum(tie).alias("tie"))
    own = known.select("rule_id", "confidence", F.explode(F.array_distinct("items")).alias("mp_id")).join(ranked.select("confidence", "rank"), "confidence")
    sums = own.groupBy("mp_id").agg(F.count("*").alias("n1"), F.sum("rank").alias("r1")).crossJoin(F.broadcast(all_))  # one row
    return _tested(sums, ["mp_id"], corrected)


def element_shares(tested: DataFrame, notations: DataFrame, alpha: float = 0.01) -> DataFrame:
    """element, n, share (in percent): in how many notations of significant metapaths (mp_id, p_adjusted) an element stands between the ends.

    notations: mp_id, notation.  Elements are runs of capitals, and what stands between two of them.
    """
    kept = notations.join(tested.filter(F.col("p_adjusted") < alpha).select("mp_id"), "mp_id")
    parts = F.regexp_extract_all("notation", F.lit("[A-Z]+|[^A-Z]+"), F.lit(0))
    inner = kept.select(F.array_distinct(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))).alias("parts"))
    total = kept.agg(F.count("*").alias("_n"))
    by = inner.select(F.explode("parts").alias("element")).groupBy("element").agg(F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(total)).select("element", "n", (100.0 * F.col("n") / F.col("_n")).alias("share"))  # one row


def normal_tail(z: F.Column) -> F.Column:
    """How often a standard normal value exceeds z, good to the last digits on both sides, far tails included.

    Near the middle, the density times the series x + x^3 / 3 + x^5 / (3 * 5) + ... is the share between 0 and x; further
    out, the tail is the density over the continued fraction x + 1 / (x + 2 / (x + 3 / ...)).
    """
    x = F.abs(z)
    density = F.exp(-x * x / 2) / F.sqrt(F.lit(2 * math.pi))
    none = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term"))

    def add(done: F.Column, k: F.Column) -> F.Column:
        term = F.when(k == 0, x).otherwise(done["term"] * x * x / (2 * k + 1))
        return F.struct((done["sum"] + term).alias("sum"), term.alias("term"))

    middle = 0.5 - density * F.aggregate(F.sequence(F.lit(0), F.lit(60)), none, add)["sum"]
    far = density / F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), x, lambda t, k: x + k / t)
    upper = F.when(x < 3, middle).otherwise(far)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def cross_table(df: DataFrame, row: str, condition: F.Column) -> DataFrame:
    return df.groupBy(row).agg(F.count_if(condition).alias("n_true"), F.count_if(~condition).alias("n_false"))


def melted(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """Long form, with the mean of each variable, by which it can be sorted."""
    long = df.unpivot(ids, values, "variable", "value")
    return long.withColumn("mean", F.avg("value").over(Window.partitionBy("variable")))


def rule_study(coverage: DataFrame, rules: DataFrame, wp: float, r: float) -> DataFrame:
    """rule_id, support, confidence, has_unification."""
    from pathloom.operators.cover import confidences

    c = confidences(coverage, r)
    return c.join(rules.select("rule_id", (F.size("clause") > 0).alias("has_unification")), "rule_id").select("rule_id", (F.col("tp") / wp).alias("support"), "confidence", "has_unification")


def best_mean_rates(mean_tpr: DataFrame) -> DataFrame:
    """One row: the largest mean TPR (1 - FPR) of a mean curve (at: FPR, mean: TPR), and where it is."""
    value = F.round(F.col("mean") * (1 - F.col("at")), 12).alias("value")
    return mean_tpr.agg(F.max(F.struct(value, F.col("at").alias("fpr"), F.col("mean").alias("tpr"))).alias("m")).select("m.value", "m.fpr", "m.tpr")


def baseline_scores(samples: DataFrame, columns: list[str], n_folds: int) -> DataFrame:
    """samples (label, weight, fold, columns) with a score each: a logistic regression learned on the other folds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=columns, outputCol="_features").transform(samples)
    out = None
    for k in range(n_folds):
        model = LogisticRegression(featuresCol="_features", labelCol="label", weightCol="weight", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y").fit(rows.filter(F.col("fold") != k))
        scored = model.transform(rows.filter(F.col("fold") == k)).withColumn("score", F.get(vector_to_array("_p"), 1)).select(*samples.columns, "score")
        out = scored if out is None else out.unionByName(scored)
    return out


def compared(methods: dict[str, DataFrame], neighbours: DataFrame, rules: DataFrame, matches: DataFrame, kind: str) -> DataFrame:
    """a, b, a probability per method, whether a matching rule passes a node type, and neighbour counts; a pair may lack any of them.

    methods: name -> (a, b, probability); neighbours: a, b, n_a, n_b, similarity; rules: rule_id, mps; matches: rule_id, a, b.
    """
    out = None
    for name, df in methods.items():
        mine = df.select("a", "b", F.col("probability").alias(name))
        out = mine if out is None else out.join(mine, ["a", "b"], "full")
    passes = rules.select("rule_id", F.exists("mps", lambda m: F.array_contains(m["nodes"], kind)).alias("passes"))
    flags = matches.join(F.broadcast(passes), "rule_id").groupBy("a", "b").agg(F.max("passes").alias("passes_type"))  # rules of the chosen set
    return out.join(neighbours, ["a", "b"], "left").join(flags, ["a", "b"], "left").withColumn("min_neighbours", F.least("n_a", "n_b")).withColumn("passes_type", F.coalesce("passes_type", F.lit(False)))
